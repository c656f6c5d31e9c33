"""Exact top-k search by no-random-access aggregation (operator 3).

A score is a sum over dimensions, and each dimension of a block of vectors is a sorted list, read
from its large end for a query's positive weights and from its small end for negative ones. After
each round of reading, what is read gives every vector a lower and an upper bound; a query stops
when no vector outside its candidates can reach its k-th best lower bound, and the candidates'
final scores are resolved. Reading a list to its end makes bounds and scores equal, so the answer
is exact however late a query stops. All queries of a block read together: bounds are matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship

K = 20
SCALE = 64
QUERY_BLOCK = 1024
VECTOR_BLOCK = 4096
#: Shares of each list read by the end of a round; after the last the lists are read whole.
ROUNDS = (0.75, 0.9, 0.95)
#: A query stops once no more than this many times k candidates are left.
NEAR = 4
NO_ID = np.iinfo(np.int64).max


def _kind(q: np.ndarray, x: np.ndarray) -> type:
    """The fastest number type in which all sums of products are exact."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1]) * 2
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _best(scores: np.ndarray, columns: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, column, score) entries the k best of each row, ties to the smaller id."""
    order = np.lexsort((ids[columns], -scores, rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0)) if len(rows) else rows
    keep = place < k
    return rows[keep], columns[keep], scores[keep]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int = K, rounds: tuple = ROUNDS):
    """(query index, vector index, score) of each query's k best vectors with another id than its own."""
    kind = _kind(q, x)
    own = q_ids[:, None] == ids[None, :]
    n = len(ids)
    out = []
    open_ = np.arange(len(q_ids))
    if kind is not object and q.shape[1] and n > NEAR * k:
        q, x = q.astype(kind), x.astype(kind)
        order = np.argsort(x, axis=0, kind="stable")
        lists = np.take_along_axis(x, order, axis=0)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
        for share in rounds:
            if not len(open_):
                break
            depth = min(n, max(k, int(n * share)))
            up, down = np.maximum(q[open_], 0), np.minimum(q[open_], 0)
            high, low = rank >= n - depth, rank < depth
            read = np.hstack([x * high, x * low, ~high, ~low]).astype(kind).T
            # An unread value lies between the far end of its list and the last value read.
            upper = np.hstack([up, down, up * lists[n - depth], down * lists[depth - 1]]) @ read
            lower = np.hstack([up, down, up * lists[0], down * lists[-1]]) @ read
            upper[own[open_]] = lower[own[open_]] = -np.inf
            reach = np.partition(lower, n - k, axis=1)[:, n - k]
            left = upper >= reach[:, None]
            done = (left.sum(axis=1) <= NEAR * k) & np.isfinite(reach)
            rows, columns = np.nonzero(left & done[:, None])
            if len(rows):
                scores = np.einsum("ij,ij->i", q[open_[rows]], x[columns])
                r, c, s = _best(scores, columns, open_[rows], ids, k)
                out.append((r, c, s))
            open_ = open_[~done]
    if len(open_):
        whole = q[open_].astype(kind) @ x.astype(kind).T
        whole = whole.astype(np.float64) if kind is np.float32 else whole
        allowed = ~own[open_]
        if n > k and kind is not object:
            masked = np.where(allowed, whole, -np.inf)
            allowed &= masked >= np.partition(masked, n - k, axis=1)[:, n - k][:, None]
        rows, columns = np.nonzero(allowed)
        scores = whole[rows, columns]
        if kind is object:
            scores = np.array([min(max(int(s), -NO_ID), NO_ID) for s in scores], np.int64)
        out.append(_best(scores, columns, open_[rows], ids, k))
    return [np.concatenate(z) if out else np.zeros(0, np.int64) for z in (zip(*out, strict=True) if out else ([], [], []))]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the highest inner product, all if fewer.

    Components become floor(scale * x). Rows whose vector is null or holds a null or non-finite
    component take no part on either side; a vector meets only vectors of its own length. Rows with
    the query's id are its own and left out; a row without id can be found (last among ties) but
    asks nothing. Of query rows with one id the greatest vector counts; repeated vectors are found
    each. Scores beyond a long are clamped to it. No queries or no vectors: no rows.

    The query set is dealt into blocks, and each block meets each block of vectors once.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ready = lambda df: df.where(finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    asked = ready(queries).where("id is not null").groupBy("id").agg(F.max("v").alias("v"))
    found = ready(vectors)
    n_query, n_vector = (max(1, -(-n // size)) for n, size in ((queries.count(), QUERY_BLOCK), (vectors.count(), VECTOR_BLOCK)))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_query)).cast("int").alias("qb")).select("*", upto(n_vector).alias("vb"))
    # Dealt by content as well as id, so that rows without an id or with one id spread too.
    right = found.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(n_vector)).cast("int").alias("vb")).select("*", upto(n_query).alias("qb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        for (q_ids, q), (ids, x) in _by_length(a, b):
            rows, columns, scores = search_block(q_ids, q, ids, x, k)
            for held, new in zip(out, (q_ids[rows], ids[columns], scores), strict=True):
                held.append(np.asarray(new, np.int64))
        query, vec, score = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in out)
        return pa.table({"query_id": query, "vec_id": pa.array(vec, mask=vec == NO_ID), "score": score})

    ship(vectors.sparkSession)
    near = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(a: pa.Table, b: pa.Table):
    """Pairs of (ids, matrix) for the vector lengths that both tables hold."""

    def split(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        ids = t["id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        v = t["v"].combine_chunks()
        sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        return {
            int(d): (ids[sizes == d], flat[starts[sizes == d][:, None] + np.arange(d)[None, :]].astype(np.int64)) for d in np.unique(sizes)
        }

    left, right = split(a), split(b)
    return [(left[d], right[d]) for d in left.keys() & right.keys()]
