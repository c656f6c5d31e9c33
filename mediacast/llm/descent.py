"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search (operator 13).

Equal vectors are one node. All nodes get one more component that gives them a common norm; so nearest
by inner product and nearest by angle are the same, and no long vector is everybody's neighbour.

The neighbour graph begins with two deals of the nodes into blocks, by random hyperplanes and by
chance, in which each node finds its nearest. Then rounds of joins: each node's fresh and older
neighbours, in both directions and sampled, meet at it; neighbours of neighbours that are nearer than
the farthest of a node's list enter the list. The rounds end when few lists change.

A query is a greedy search: of the best nodes seen, those not yet opened are opened, all
queries' at once; a join brings their neighbours, another the vectors of those not seen before.
A query whose vector is a node begins there, any other at nodes spread over the graph. It ends when
all of its ``BEAM`` best are open. The best are scored again on the original vectors in double precision.

Nothing is collected to the driver; what a round writes grows with the nodes, and a round is written
to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free, ship

K = 20
#: Neighbours in a node's list, beyond the ``k`` that a search returns.
SPARE = 20
#: Neighbours of a node, of each age and direction, that meet in a round.
SAMPLE = 20
#: Rounds end when a smaller share of all list entries is new.
SETTLED = 0.03
#: Nodes of a block in which the first lists are searched whole.
BLOCK = 512
#: Nodes that a task's group works on together.
GROUP = 1024
#: Searches that a task's group works on together; each meets some thousand nodes in a step.
SEARCHES = 64
#: Best nodes that a query opens, and how many at a time.
BEAM = 144
OPENED = 48
#: Where queries that are no nodes begin.
ENTRIES = 64
#: Best nodes that are scored again in double precision, beyond ``k``.
RESCORED = 12
SALTS = 16
LIST = "node long, half binary, nbrs array<long>, sims array<float>, fresh array<boolean>, entered int"


def nodes(vectors: DataFrame, k: int) -> DataFrame:
    """(node, v, ids): a row for each distinct vector of ``vectors`` (id, v), with its ``k`` + 1 least ids, nulls last."""
    order = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"))
    # Few rows of a vector leave each task, however many have it.
    least = vectors.select("v", "id").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    per = least.groupBy("v").agg(F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("x"))
    return cut(per.select(F.monotonically_increasing_id().alias("node"), "v", F.col("x.id").alias("ids")), "nodes")


def _mark(v: Column) -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64(v).alias("m1"), F.xxhash64(F.lit("second"), v).alias("m2")]


def _flat(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column; a null list is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    return np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lengths), column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _lists(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values, kind))


def _matrix(halves: pa.ChunkedArray) -> np.ndarray:
    """Vectors of 16-bit floats as lines; shorter ones, which never meet the longer, end in zeros."""
    held = halves.to_pylist()
    width = max((len(h) for h in held), default=0) // 2
    if all(len(h) == 2 * width for h in held):
        return np.frombuffer(b"".join(held), np.float16).reshape(len(held), width).astype(np.float32)
    out = np.zeros((len(held), width), np.float32)
    for line, h in zip(out, held, strict=True):
        line[: len(h) // 2] = np.frombuffer(h, np.float16)
    return out


def _ranked(owner: np.ndarray, other: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Places of each owner's ``most`` best entries, best first, ties to the smaller other."""
    order = np.lexsort((other, -sims, owner))
    sorted_ = owner[order]
    first = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
    return order[place < most]


def _once(owner: np.ndarray, other: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Places of one entry for each (owner, other), that with the least ``later``."""
    order = np.lexsort((later, other, owner))
    a, b = owner[order], other[order]
    return order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]] if len(order) else order


def _ready(held: DataFrame, bits: int, scale: float, norm: float) -> DataFrame:
    """(node, half, dim, code): vectors with a common norm, and the side of random hyperplanes they are on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            node = batch.column(0).to_numpy()
            lengths, flat = _flat(batch.column(1), np.float64)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = flat[starts[at][:, None] + np.arange(dim)[None, :]] / scale
                rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", x, x), 0))
                x = (np.hstack([x, rest[:, None]]) / norm).astype(np.float16)
                if dim not in planes:
                    planes[dim] = np.random.default_rng(dim).standard_normal((dim + 1, bits))
                code = ((x.astype(np.float32) @ planes[dim]) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[at]), pa.array([line.tobytes() for line in x], pa.binary()), pa.array(np.full(len(at), dim, np.int32)), pa.array(code.astype(np.int64))],
                    ["node", "half", "dim", "code"],
                )

    return cut(held.select("node", "v").mapInArrow(run, "node long, half binary, dim int, code long"), "halves")


def _dealt(ready: DataFrame, per: int, by: list[str], seed: int, most: int) -> DataFrame:
    """(node, nbrs, sims): each node's nearest among the nodes of its block; a class of ``by`` has as many blocks as its size asks for."""
    sizes = ready.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / per).alias("parts"))
    dealt = ready.join(sizes, by).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("parts")))

    def run(t: pa.Table) -> pa.Table:
        node, x = t["node"].to_numpy(), _matrix(t["half"])
        order = np.argsort(node)
        node, x = node[order], x[order]
        n = min(most, len(node) - 1)
        best, sims = np.empty((len(node), n), np.int64), np.empty((len(node), n), np.float32)
        for at in range(0, len(node), 1024):
            s = x[at : at + 1024] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
            near = np.argpartition(-s, max(n - 1, 0), axis=1)[:, :n]
            best[at : at + 1024], sims[at : at + 1024] = node[near], np.take_along_axis(s, near, axis=1)
        lengths = np.full(len(node), n)
        return pa.table({"node": node, "nbrs": _lists(lengths, best.ravel(), pa.int64()), "sims": _lists(lengths, sims.ravel(), pa.float32())})

    return dealt.select("node", "half", *by, "block").groupBy(*by, "block").applyInArrow(run, "node long, nbrs array<long>, sims array<float>")


def _merged(state: DataFrame, found: DataFrame, groups: int, most: int) -> DataFrame:
    """The lists of ``state`` (node, half, nbrs, sims, fresh) with what was ``found`` (node, nbrs, sims) among them, each node's ``most`` best."""

    def run(t: pa.Table) -> pa.Table:
        node, kept = t["node"].to_numpy(), ~t["half"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        lengths, nbrs = _flat(t["nbrs"], np.int64)
        sims = _flat(t["sims"], np.float32)[1]
        old = np.repeat(kept, lengths)
        fresh = np.ones(len(nbrs), bool)
        fresh[old] = _flat(t["fresh"].filter(pa.array(kept)), bool)[1]
        owner = np.repeat(node, lengths)
        at = _once(owner, nbrs, ~old)
        owner, nbrs, sims, fresh, old = owner[at], nbrs[at], sims[at], fresh[at], old[at]
        at = _ranked(owner, nbrs, sims, most)
        owner, nbrs, sims, fresh, old = owner[at], nbrs[at], sims[at], fresh[at], old[at]
        places = np.flatnonzero(kept)
        places = places[np.argsort(node[places])]
        begins = np.searchsorted(owner, node[places])
        sizes = np.searchsorted(owner, node[places], side="right") - begins
        entered = np.add.reduceat(np.r_[~old, False].astype(np.int64), begins) * (sizes > 0) if len(places) else sizes
        return pa.table({
            "node": node[places], "half": t["half"].take(pa.array(places)), "nbrs": _lists(sizes, nbrs, pa.int64()),
            "sims": _lists(sizes, sims, pa.float32()), "fresh": _lists(sizes, fresh, pa.bool_()), "entered": pa.array(entered.astype(np.int32)),
        })

    news = found.select("node", F.lit(None).cast("binary").alias("half"), "nbrs", "sims", F.lit(None).cast("array<boolean>").alias("fresh"))
    both = state.select("node", "half", "nbrs", "sims", "fresh").union(news)
    return cut(both.groupBy(F.pmod(F.xxhash64("node"), F.lit(groups)).alias("g")).applyInArrow(run, LIST), "neighbours")


def _aged(fresh: bool):
    return lambda e: e["fresh"] == F.lit(fresh)


def _met(state: DataFrame, groups: int, most: int, sample: int) -> DataFrame:
    """(node, nbrs, sims): neighbours of neighbours that are nearer to ``node`` than the last of its list.

    ``sample`` neighbours of each age are a node's own choice, best first; of those that chose it, as many
    are taken by chance.
    """
    chosen = state.select("node", F.arrays_zip("nbrs", "fresh").alias("x"))
    ages = [F.slice(F.filter("x", _aged(f)), 1, sample) for f in (True, False)]
    own = chosen.select("node", F.explode(F.concat(*ages)).alias("x")).select(F.col("node").alias("at"), F.col("x.nbrs").alias("node"), F.col("x.fresh").alias("fresh"))
    chance = Window.partitionBy("at", "fresh").orderBy(F.xxhash64("node", "at"), "node")
    by_others = own.select(F.col("node").alias("at"), F.col("at").alias("node"), "fresh")
    by_others = by_others.withColumn("place", F.row_number().over(chance)).where(F.col("place") <= sample).drop("place")
    worst = F.when(F.size("sims") >= most, F.element_at("sims", -1)).otherwise(F.lit(-2.0).cast("float"))
    members = own.union(by_others).join(state.select("node", "half", worst.alias("worst")), "node")

    def run(t: pa.Table) -> pa.Table:
        at, node, fresh, worst = (t[c].to_numpy() for c in ("at", "node", "fresh", "worst"))
        once = _once(at, node, ~fresh)
        at, node, fresh, worst = at[once], node[once], fresh[once], worst[once]
        halves = t["half"].take(pa.array(once))
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sizes = np.diff(np.r_[starts, len(at)])
        live = np.logical_or.reduceat(fresh, starts) & (sizes > 1)
        starts, sizes = starts[live], sizes[live]
        x = _matrix(halves)
        width = int(sizes.max(initial=1))
        out: list[tuple] = []
        step = max(1, 2_000_000 // (width * width))
        for b in range(0, len(starts), step):
            place = starts[b : b + step, None] + np.arange(width)[None, :]
            real = np.arange(width)[None, :] < sizes[b : b + step, None]
            place = np.where(real, place, starts[b : b + step, None])
            v = x[place]
            s = v @ v.transpose(0, 2, 1)
            near = s > worst[place][:, :, None]
            near &= (real[:, :, None] & real[:, None, :]) & (fresh[place][:, :, None] | fresh[place][:, None, :])
            near &= ~np.eye(width, dtype=bool)[None]
            g, i, j = np.nonzero(near)
            # A row for each node of a meeting that met nearer ones: so many rows a node at most, whatever the number of groups.
            first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]) if len(g) else g
            out.append((node[place[g[first], i[first]]], np.diff(np.r_[first, len(g)]), node[place[g, j]], s[g, i, j]))
        none = np.zeros(0, np.int64)
        owner, sizes, other, sims = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (none, none, none, none.astype(np.float32))
        return pa.table({"node": owner, "nbrs": _lists(sizes, other, pa.int64()), "sims": _lists(sizes, sims, pa.float32())})

    grouped = members.groupBy(F.pmod(F.xxhash64(F.lit("meet"), "at"), F.lit(groups)).alias("g"))
    return grouped.applyInArrow(run, "node long, nbrs array<long>, sims array<float>")


def graph(held: DataFrame, most: int = K + SPARE, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """((node, nbrs, sims), (node, half)): each node's ``most`` nearest others found, best first, for ``held`` (node, v)."""
    spark = held.sparkSession
    ship(spark)
    size = lambda f: F.aggregate("v", F.lit(0.0), lambda a, x: f(a, x.cast("double")))
    n, scale = held.agg(F.count(F.lit(1)), F.max(size(lambda a, x: F.greatest(a, F.abs(x))))).first()
    scale = scale or 1.0
    norm = held.agg(F.max(size(lambda a, x: a + x / scale * (x / scale)))).first()[0]
    bits = max(0, int(np.log2(max(1, n / BLOCK))))
    ready = _ready(held, bits, scale, float(norm or 1.0) ** 0.5)
    groups = max(1, -(-n // GROUP))
    none = "cast(array() as array<{}>) as {}"
    empty = ready.selectExpr("node", "half", none.format("bigint", "nbrs"), none.format("float", "sims"), none.format("boolean", "fresh"))
    found = _dealt(ready, BLOCK, ["dim", "code"], 1, most).union(_dealt(ready, BLOCK, ["dim"], 2, most))
    state = _merged(empty, found, groups, most)
    while True:
        met = _met(state, groups, most, sample)
        # What met is older in the next round: the first fresh ones of each list.
        aged = F.transform("fresh", lambda f, i: f & (F.size(F.filter(F.slice("fresh", F.lit(1), i + 1), lambda e: e)) > sample))
        after = _merged(state.withColumn("fresh", aged), met, groups, most)
        free(state)
        state = after
        entered = state.agg(F.sum("entered")).first()[0] or 0
        if entered <= SETTLED * n * most:
            return state.select("node", "nbrs", "sims"), ready.select("node", "half")


def _both_ways(lists: DataFrame, most: int) -> DataFrame:
    """(node, nbrs): each node's list and the ``most`` nearest of those whose lists it is in."""
    edges = lists.select("node", F.explode(F.arrays_zip("nbrs", "sims")).alias("x")).select(F.col("x.nbrs").alias("node"), F.col("node").alias("nbr"), F.col("x.sims").alias("sim"))
    near = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    back = edges.withColumn("place", F.row_number().over(near)).where(F.col("place") <= most).groupBy("node").agg(F.collect_list("nbr").alias("back"))
    joined = lists.join(back, "node", "left")
    return cut(joined.select("node", F.array_union("nbrs", F.coalesce("back", F.array().cast("array<long>"))).alias("nbrs")), "edges")


def _opened(asked: DataFrame, found: DataFrame, groups: int, beam: int, opened: int) -> DataFrame:
    """One more step of all searches. ``asked``: (q, half, seen, sims, open, todo); ``found``: (p, node, half) newly met nodes of search ``p``."""

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        q = a["q"].to_numpy()
        order = np.argsort(q)
        a, q = a.take(pa.array(order)), q[order]
        lengths, seen = _flat(a["seen"], np.int64)
        sims, done = _flat(a["sims"], np.float32)[1], _flat(a["open"], bool)[1]
        of = np.repeat(np.arange(len(q)), lengths)
        if b.num_rows:
            at = np.searchsorted(q, b["p"].to_numpy())
            x, y = _matrix(a["half"]), _matrix(b["half"])
            width = min(x.shape[1], y.shape[1])
            s = np.einsum("ij,ij->i", x[at, :width], y[:, :width])
            of, seen, sims = np.r_[of, at], np.r_[seen, b["node"].to_numpy()], np.r_[sims, s]
            done = np.r_[done, np.zeros(len(s), bool)]
        order = np.lexsort((seen, -sims, of))
        of, seen, sims, done = of[order], seen[order], sims[order], done[order]
        begins = np.searchsorted(of, np.arange(len(q)))
        place = np.arange(len(of)) - begins[of]
        closed = np.cumsum(~done & (place < beam))
        before = np.r_[0, closed][begins]
        todo = ~done & (place < beam) & (closed - before[of] <= opened)
        sizes = np.bincount(of, minlength=len(q))
        return pa.table({
            "q": q, "half": a["half"], "seen": _lists(sizes, seen, pa.int64()), "sims": _lists(sizes, sims, pa.float32()),
            "open": _lists(sizes, done | todo, pa.bool_()), "todo": _lists(np.bincount(of[todo], minlength=len(q)), seen[todo], pa.int64()),
        })

    g = lambda df, q: df.groupBy(F.pmod(F.xxhash64(q), F.lit(groups)).alias("g"))
    schema = "q long, half binary, seen array<long>, sims array<float>, open array<boolean>, todo array<long>"
    return cut(g(asked.select("q", "half", "seen", "sims", "open"), "q").cogroup(g(found, "p")).applyInArrow(run, schema), "searches")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner products found, all if fewer.

    Rows whose vector is null, empty, zero or holds a null or non-finite component take no part on either
    side; a vector meets only vectors of its own length. Rows with the query's id are its own and left
    out. Of query rows with one id the greatest vector counts; a row repeated with its id counts
    once; equal vectors with several ids are found each, by their ids. A row without id can be found, last among ties,
    but asks nothing. No queries or no vectors: no rows.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = finite & F.exists(vector_col, lambda x: x != 0)
    taken = lambda df: df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x + F.lit(0).cast("float")).alias("v"))
    asked = taken(queries).where("id is not null").groupBy("id").agg(F.max("v").alias("v"))
    asked = cut(asked.select("id", "v", *_mark(F.col("v"))), "queries")
    held = nodes(taken(vectors), k)
    lists, halves = graph(held, k + SPARE)
    edges = _both_ways(lists, k + SPARE)

    # Queries with one vector are one search.
    distinct = asked.groupBy("m1", "m2").agg(F.first("v").alias("v"))
    distinct = cut(distinct.select(F.monotonically_increasing_id().alias("q"), "v", "m1", "m2"), "searched")
    at_nodes = held.select("node", *_mark(F.col("v")))
    started = distinct.join(at_nodes, ["m1", "m2"], "left").select("q", "node", F.size("v").alias("dim"), "v")
    entries = halves.join(held.select("node", F.size("v").alias("dim")), "node").select("node", "dim")
    spread = Window.partitionBy("dim").orderBy(F.xxhash64("node"))
    entries = entries.withColumn("place", F.row_number().over(spread)).where(F.col("place") <= ENTRIES).groupBy("dim").agg(F.collect_list("node").alias("entries"))
    started = started.join(entries, "dim").select("q", "v", F.when(F.col("node").isNotNull(), F.array("node")).otherwise(F.col("entries")).alias("first"))
    n = distinct.count()
    groups = max(1, -(-n // SEARCHES))
    # The query's added component is zero, so that all nodes' products with it are theirs with its vector, scaled.
    none = "cast(array() as array<{}>) as {}"
    state = cut(
        started.select("q", F.col("v"), "first").mapInArrow(_halved, "q long, half binary, first array<long>")
        .selectExpr("q", "half", none.format("bigint", "seen"), none.format("float", "sims"), none.format("boolean", "open"), "first as todo"), "searches"
    )
    first = True
    while True:
        near = state.select(F.col("q").alias("p"), F.explode("todo").alias("node"))
        if not first:
            near = near.join(edges, "node").select("p", F.explode("nbrs").alias("node")).groupBy("p").agg(F.collect_set("node").alias("near"))
            near = near.join(state.select(F.col("q").alias("p"), "seen"), "p").select("p", F.explode(F.array_except("near", "seen")).alias("node"))
        after = _opened(state, near.join(halves, "node").select("p", "node", "half"), groups, beam, OPENED)
        free(state)
        state, first = after, False
        if state.where(F.size("todo") > 0).limit(1).count() == 0:
            break

    near = state.select("q", F.explode(F.slice("seen", 1, k + RESCORED)).alias("node"))
    scored = near.join(distinct.select("q", F.col("v").alias("x")), "q").join(held, "node")
    scored = scored.mapInArrow(_scored, "q long, ids array<long>, score double")
    each = scored.select("q", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    # One more than asked for, as a query leaves itself out.
    each = each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    results = each.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    results = results.join(distinct.select("q", "m1", "m2"), "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = asked.select("id", "m1", "m2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = mine.join(results, ["m1", "m2", "salt"])
    others = F.slice(F.filter("near", lambda x: ~x["vec_id"].eqNullSafe(F.col("id"))), 1, k)
    return joined.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query's vector, at most 1 in each component, and 0 for the component that nodes have in addition."""
    for batch in batches:
        lengths, flat = _flat(batch.column(1), np.float64)
        ends = np.cumsum(lengths)
        parts = [flat[b:e] for b, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        halves = [np.r_[x / np.abs(x).max(), 0.0].astype(np.float16).tobytes() for x in parts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves, pa.binary()), batch.column(2)], ["q", "half", "first"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, ids, score) from (node, q, x, v, ids): inner products in double precision, summed in the same order for all."""
    for batch in batches:
        names = batch.schema.names
        lengths, x = _flat(batch.column(names.index("x")), np.float64)
        v = _flat(batch.column(names.index("v")), np.float64)[1]
        starts, score = np.cumsum(lengths) - lengths, np.zeros(len(lengths))
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            place = starts[at][:, None] + np.arange(dim)[None, :]
            score[at] = np.einsum("ij,ij->i", x[place], v[place])
        yield pa.RecordBatch.from_arrays([batch.column(names.index("q")), batch.column(names.index("ids")), pa.array(score)], ["q", "ids", "score"])
