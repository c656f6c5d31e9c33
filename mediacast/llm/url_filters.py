"""URL filters: a stated rule list, then association rules mined from labels (operator 2).

A url is cut into tokens (host labels, path segments, query keys). FP-growth finds the token
combinations that are frequent among labelled urls; those that imply the bad label with enough
confidence become rules. Both kinds of rule are looked up through an inverted index: a map from a host to
the caller's few listed rules, and a table of mined rules by an anchor token that urls' tokens are joined with.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, free_name

BAD = "!bad"
MIN_CONFIDENCE = 0.8
MIN_SUPPORT = 0.002
#: A combination seen on fewer labelled urls than this is chance, however small the table.
MIN_COUNT = 10


def host_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null and for a url without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: ``h:`` host labels, ``p:`` path segments, ``q:`` query keys."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    part = lambda kind, values: F.transform(F.array_remove(values, ""), lambda x: F.concat(F.lit(kind), x))
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(part("h:", F.split(host, r"\.")), part("p:", F.split(path, "/")), part("q:", keys)))


def classes(labelled: DataFrame, least: float) -> DataFrame:
    """(token, rep): the tokens of at least ``least`` rows of ``labelled`` (row, items); those that occur in exactly the same rows share ``rep``, the least of them.

    Rows are compared by 128 bits summed over them and their number. A row of L tokens has L at most, so
    there are L * rows / ``least`` of them on average: a bound that doesn't grow with the table.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"m{k}") for k in (1, 2)]
    found = labelled.select("row", F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks)
    found = found.where(F.col("n") >= least)
    return found.select("token", F.min("token").over(Window.partitionBy("n", "m1", "m2")).alias("rep"))


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Rules (items, confidence, support) of ``labelled`` (items array<string>, bad boolean), and the ``classes`` whose representatives they are of.

    Every labelled url counts. Tokens that always occur together are one item: a rule with two of
    them is no surer than with one, so a url that is repeated, however long, adds one item. A frequent
    combination holds for ``min_support`` of the urls, and with C such items in a url there are at most
    2^C / min_support of them, whatever the table's size. A rule is dropped if one with fewer items is as confident.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    empty = spark.createDataFrame([], "items array<string>, confidence double, support double")
    if n < min_count:
        return empty, spark.createDataFrame([], "token string, rep string")
    share = max(min_support, min_count / n)
    rows = labelled.withColumn("row", F.monotonically_increasing_id())
    same = cut(classes(rows, share * n), "url-classes")
    folded = rows.select("row", "bad", F.explode("items").alias("token")).join(F.broadcast(same), "token").groupBy("row", "bad").agg(F.collect_set("rep").alias("items"))
    # Urls without a frequent token still count.
    rest = rows.join(folded.select("row"), "row", "left_anti").select("bad", F.array().cast("array<string>").alias("items"))
    folded = cut(folded.select("bad", "items").union(rest), "url-folded")
    baskets = folded.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BAD)
    rules = cut(rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "url-rules")
    # A rule is compared with those that begin with one of its items.
    less = rules.select(F.col("items").alias("fewer"), F.col("confidence").alias("as_sure"), F.element_at("items", 1).alias("t"))
    wide = rules.select("*", F.explode("items").alias("t"))
    worse = wide.join(less, "t").where(
        (F.size("fewer") < F.size("items")) & (F.size(F.array_except("fewer", "items")) == 0) & (F.col("as_sure") >= F.col("confidence"))
    )
    kept = cut(rules.join(worse.select("items").distinct(), "items", "left_anti"), "url-kept")
    used = kept.select(F.explode("items").alias("rep")).distinct()
    return kept, same.join(used, "rep", "left_semi").select("token", "rep")


def _held(out: DataFrame, t: str, rules: DataFrame, same: DataFrame) -> DataFrame:
    """(t, best): for each distinct array of tokens that holds all items of a rule, the surest such rule; the index is joined by anchor."""
    anchored = rules.withColumn("anchor", F.element_at("items", 1))
    own = out.select(F.col(t).alias("t")).distinct()
    named = own.select("t", F.explode("t").alias("token")).join(same, "token").groupBy("t").agg(F.collect_set("rep").alias("reps"))
    met = named.select("t", "reps", F.explode("reps").alias("anchor")).join(anchored, "anchor").where(F.size(F.array_except("items", "reps")) == 0)
    return met.groupBy("t").agg(F.max(F.struct("confidence", "items")).alias("best"))


def _rule_index(spark: SparkSession, listed: list[tuple[str, str]]) -> Column:
    """host -> the listed rules of that host, as a map; the list is the caller's, so small."""
    rows = [(rule.partition("/")[0].lower(), "/" + rule.partition("/")[2], rule, verdict) for verdict, rule in listed]
    schema = "host string, path string, rule string, verdict string"
    by_host = spark.createDataFrame(rows, schema).groupBy("host").agg(F.collect_list(F.struct("path", "rule", "verdict")).alias("rules"))
    return by_host.agg(F.map_from_entries(F.collect_list(F.struct("host", "rules"))).alias("m")).scalar()


def judge(pages: DataFrame, labels: DataFrame, listed: list[tuple[str, str]], id_col: str = "page_id", **limits) -> DataFrame:
    """Every row of ``pages`` with ``host, path, rule, verdict, mined`` (these replace columns so named).

    ``listed``: (verdict, "host/path") pairs. A listed rule fits its host and all subdomains if the
    url's path starts with its path; the longest wins (ties: the lesser string). Else the url is
    blocked if the items of a mined rule are all among its tokens (``mined``: the most confident),
    and allowed if not. Null urls have no tokens and are allowed. ``labels`` are tied to pages by
    equal id; an id with several labels is bad if one of them is; ids that repeat count once a row.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    t, li, mi = free_name(pages, "t"), free_name(pages, "li"), free_name(pages, "mi")
    out = pages.withColumns({"host": host, "path": path})
    out = out.withColumn(t, tokens(F.col("url"), F.col("host"), F.col("path")))

    bad = labels.groupBy(F.col("doc_id").alias(id_col)).agg(
        F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))).alias("bad")
    )
    marked = out.select(id_col, F.col(t).alias("items")).join(bad, id_col).select("items", "bad")
    rules, same = mine(cut(marked, "url-baskets"), **limits)
    out = out.withColumn(li, _rule_index(spark, listed))
    best_rule = _held(out, t, rules, same).select(F.col("t").alias(t), F.col("best").alias(mi))
    out = out.join(cut(best_rule, "url-held"), t, "left")

    labels_of = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels_of)), lambda i: F.array_join(F.slice(labels_of, i, F.size(labels_of)), "."))
    known = lambda m: lambda k: F.coalesce(F.try_element_at(F.col(m), k), F.array())
    fits = F.filter(F.flatten(F.transform(suffixes, known(li))), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_min(F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    out = out.withColumn(li, best)
    mined = F.when(F.col(f"{li}.rule").isNull(), F.col(f"{mi}.items"))
    verdict = F.coalesce(F.col(f"{li}.verdict"), F.when(F.col(f"{mi}.items").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    out = out.withColumns({"rule": F.col(f"{li}.rule"), "verdict": verdict, "mined": mined})
    return out.select(*pages.columns, *[c for c in ("host", "path", "rule", "verdict", "mined") if c not in pages.columns])
