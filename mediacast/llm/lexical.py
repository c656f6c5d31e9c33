"""Ranked lexical search by sort-based accumulation (operator 11).

The documents are read once. Each task turns blocks of texts into the postings of the terms that
queries hold: which document has which term how often. These blocks, with their share of the
collection's counts, are the index; it is written to the shared folder. From it come the number of
documents, of terms, and the documents of each term; then every block is scored: for all queries'
terms its matched (query, document, impact) arrays are concatenated, their packed keys sorted by a
radix sort and the impacts of equal keys added with ``reduceat``. A block is a range of documents, so
no two blocks hold parts of one score, and a task keeps a heap of the best documents of each query.
A last shuffle by ranges of queries selects the best of all tasks.

Queries are the stated set of a search: they are dealt into groups of at most about
``GROUP_BYTES`` of text, by the set's measured size. A group's terms and the documents that hold
each are what the driver and every task keep; the documents are read once for each group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free, ship

K = 20
#: Bytes of query texts whose terms are searched together.
GROUP_BYTES = 4_000_000
#: Bytes of text after which a block of the index is full.
BLOCK_BYTES = 8_000_000
#: (query, document, impact) entries that are sorted at a time.
ENTRIES = 2_000_000
#: ASCII letters and digits and all that isn't ASCII belong to terms; A-Z become a-z.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys: a radix sort by 16-bit digits, without the digits that are in order already."""
    order, most, shift = np.arange(len(keys)), int(keys.max(initial=0)), 0
    while most >> shift:
        digit = (keys[order] >> np.uint64(shift)).astype(np.uint16)
        if np.any(digit[1:] < digit[:-1]):
            # NumPy's stable sort of 16-bit numbers is a radix sort.
            order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


def index(docs: DataFrame, ids: dict[bytes, int], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: its documents with a term, their terms in all, and its postings by document.

    ``keys`` and ``sizes``: ids and numbers of terms of the documents that hold a term of ``ids``;
    ``postings``: for each of these in turn its term numbers and counts; ``df_terms`` and ``df``:
    documents of each term.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(ids)  # of a group of queries, so bounded by GROUP_BYTES
    schema = pa.schema(
        [("docs", pa.int64()), ("tokens", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("postings", pa.binary()),
         ("df_terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, n_terms, pack = held.value.get, np.uint64(max(1, len(held.value))), zstandard.ZstdCompressor(level=3).compress
        keys, sizes, found, size, n_docs, n_tokens = [], [], [], 0, 0, 0

        def full() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in found], np.int64)
            packed = np.repeat(np.arange(len(found), dtype=np.uint64), lengths) * n_terms + (np.concatenate(found).astype(np.uint64) if found else np.zeros(0, np.uint64))
            packed = packed[radix_order(packed)]
            first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, np.int64)
            doc, term = np.divmod(packed[first], n_terms)
            counts = np.diff(np.r_[first, len(packed)])
            df = np.bincount(term.astype(np.int64), minlength=1)
            data = b"".join(x.tobytes() for x in (np.array([len(first)], np.int64), doc.astype(np.uint32), term.astype(np.uint32), counts.astype(np.int64)))
            row = [[n_docs], [n_tokens], [keys], [sizes], [pack(data)], [np.flatnonzero(df)], [df[df > 0]]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = terms(text)
                    size += len(text or b"") + 8
                    if words:
                        n_docs, n_tokens = n_docs + 1, n_tokens + len(words)
                        known = np.array([x for x in map(get, words) if x is not None], np.uint32)
                        if len(known):
                            keys.append(key)
                            sizes.append(len(words))
                            found.append(known)
                    if size >= block_bytes:
                        yield full()
                        keys, sizes, found, size, n_docs, n_tokens = [], [], [], 0, 0, 0
        if n_docs:
            yield full()

    ship(spark)
    ready = docs.select(F.col("key").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return ready.mapInArrow(run, "docs long, tokens long, keys array<long>, sizes array<long>, postings binary, df_terms array<int>, df array<long>")


class Best:
    """The ``k`` best (score, id) of each query, ties to the smaller id; null ids come last."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(n)], np.zeros(n, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: list[int | None]) -> None:
        near = np.flatnonzero(score >= np.maximum(self.least[query], 1))
        for q, s, at in zip(query[near].tolist(), score[near].tolist(), near.tolist(), strict=True):
            heap, key = self.heaps[q], ids[at]
            entry = (s, key is not None, -(key or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[q] = heap[0][0]

    def rows(self) -> tuple[list[int], list[int | None], list[int]]:
        flat = [(q, -key if has else None, s) for q, heap in enumerate(self.heaps) for s, has, key in heap]
        return tuple(map(list, zip(*flat, strict=True))) if flat else ([], [], [])


def accumulate(n_queries: int, starts: np.ndarray, at_query: np.ndarray, at_times: np.ndarray, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray):
    """(query, document, score) of a slice's postings, sorted by query and document.

    Term t belongs to queries ``at_query[starts[t]:starts[t + 1]]``, so often as ``at_times`` says.
    """
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    many = starts[term + 1] - starts[term]
    of = np.repeat(np.arange(len(term)), many)
    place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + starts[term][of]
    keys = (at_query[place].astype(np.uint64) << np.uint64(32)) | doc[of].astype(np.uint64)
    values = impact[of] * at_times[place]
    order = radix_order(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    scores = np.add.reduceat(values, first) if len(first) else values
    return (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), scores


def _scored(blocks: DataFrame, asked: list[tuple[int, list[tuple[int, int]]]], n_terms: int, df: np.ndarray, n_docs: int, n_tokens: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's ``k`` best documents of each query."""
    spark = blocks.sparkSession
    with np.errstate(divide="ignore"):
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    by_term = sorted((t, q, c) for q, (_, held) in enumerate(asked) for t, c in held)
    lists = np.array(by_term, np.int64).reshape(-1, 3)
    starts = np.searchsorted(lists[:, 0], np.arange(n_terms + 1))
    shared = spark.sparkContext.broadcast((np.array([i for i, _ in asked], np.int64), starts, lists[:, 1].copy(), lists[:, 2].copy(), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, starts, at_query, at_times, weights = shared.value
        best, unpack = Best(len(items), k), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                keys, sizes, data = (batch.column(c)[row] for c in range(3))
                keys, sizes, data = keys.as_py(), np.array(sizes.as_py(), np.int64), unpack(data.as_py())
                m = 100 - 25 + (25 * sizes * n_docs) // n_tokens
                n = int(np.frombuffer(data, np.int64, 1)[0])
                doc = np.frombuffer(data, np.uint32, n, 8).astype(np.int64)
                term = np.frombuffer(data, np.uint32, n, 8 + 4 * n).astype(np.int64)
                tf = np.frombuffer(data, np.int64, n, 8 + 8 * n)
                # Slices end between documents: a score is summed in one of them.
                entries, ends, at = np.cumsum(starts[term + 1] - starts[term]), np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) + 1, 0
                while at < n:
                    before = entries[at - 1] if at else 0
                    fits = ends[(ends > at) & (entries[ends - 1] - before <= ENTRIES)]
                    to = int(fits[-1]) if len(fits) else int(ends[ends > at][0])
                    query, of, scores = accumulate(len(items), starts, at_query, at_times, weights, doc[at:to], term[at:to], tf[at:to], m)
                    best.add(query, scores, _Taken(keys, of))
                    at = to
        query, ids, scores = best.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(items[np.array(query, np.int64)]), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"]
        )

    return blocks.select("keys", "sizes", "postings").mapInArrow(run, "item_id long, doc_id long, score long")


class _Taken:
    """``keys[of[i]]`` as item ``i``, looked up when it is asked for."""

    def __init__(self, keys: list, of: np.ndarray):
        self.keys, self.of = keys, of

    def __getitem__(self, at: int):
        return self.keys[self.of[at]]


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query with a score above 0, all if fewer.

    A null or empty text has no terms: such a document is never found and counts in no statistic,
    such a query finds nothing. Rows that share a query id are one query, that of the greatest text; a
    query without id asks nothing. Rows that share a document id are documents of their own; one
    without id can be found and comes last among equals. No queries or no documents: no rows.
    """
    spark = docs.sparkSession
    asked = items.where(F.col(item_col).isNotNull()).groupBy(F.col(item_col).cast("long").alias("item_id")).agg(F.max(item_text).alias("text"))
    asked = cut(asked, "queries")
    total = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    groups = -(-int(total) // group_bytes)
    ready = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for g in range(groups):
        found = found.union(_group(ready, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g), k))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = cut(found, "found").repartitionByRange("item_id").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _group(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    ids: dict[bytes, int] = {}
    queries = []
    for row in asked.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        counts: dict[int, int] = {}
        for word in terms(bytes(row["text"]) if row["text"] is not None else None):
            t = ids.setdefault(word, len(ids))
            counts[t] = counts.get(t, 0) + 1
        queries.append((row["item_id"], sorted(counts.items())))
    blocks = cut(index(docs, ids), "postings")
    n_docs, n_tokens = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    df = np.zeros(len(ids), np.int64)
    per_term = blocks.select(F.explode(F.arrays_zip("df_terms", "df")).alias("x")).groupBy(F.col("x.df_terms").alias("t")).agg(F.sum("x.df").alias("n"))
    for row in per_term.toLocalIterator():  # of the group's terms, so bounded as they are
        df[row["t"]] = row["n"]
    found = cut(_scored(blocks, queries, len(ids), df, n_docs, n_tokens, k), "best") if n_docs else docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    free(blocks)
    return found
