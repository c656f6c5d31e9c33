"""Connected components of an edge table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Copies of a node's least neighbour that its links are dealt to, so that a hub's links spread.
SALTS = 16


def _joined(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links (u, v) with ``m``, the least of ``u``. The copies compress well, so their size in bytes would make them look fit to broadcast."""
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(copies.hint("merge"), (F.col("u") == F.col("x")) & (dealt["salt"] == copies["salt"]))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); ``root`` is the component's least node.

    Alternates large stars (link larger neighbours to the least one) and small stars (link the
    others too) until nothing changes: about log^2 of the nodes rounds. Least neighbours come from a
    partial aggregate and are joined back, so a hub's neighbours are never gathered in one task.
    Each round is written to the shared folder. Null ends and loops are ignored.
    """
    pairs = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut(pairs.distinct(), "links")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = _joined(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "links")
        # Now every pair has its larger node first.
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = _joined(large, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = cut(small.distinct(), "links")
    else:
        raise RuntimeError("components: no end after the allowed rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
