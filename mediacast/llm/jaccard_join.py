"""N-gram Jaccard join with a token-group matrix (operator 9).

A document's tokens are its distinct word shingles. Every query is bounded by the tokens that it
shares with a group of documents, and only groups that can still hold a partner are opened:

1. The first group is the whole rest of the corpus. A token that no other text has can't be in an
   intersection; a document with too many of them has no partner and is done. A fixed share of all
   token values, the same in every document, mostly holds enough of them; what it leaves open goes
   on, so the share changes no result.
2. The others are partitioned into small groups of similar documents by the least hash of their
   shared tokens. The matrix has a row for each token and group; documents and groups meet over
   their rarest tokens alone, of which linked documents share one at least.
3. Where two groups meet, each document's overlap with the other group's token union bounds its
   similarity; if that suffices, the group is opened and its members are compared exactly.

Copies with equal token sets are one class throughout. Only spanning links leave a pair of groups.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import cut, free, free_name, ship

#: Bytes of text after which a block of documents is full, and whose tokens a shard holds, about.
BLOCK_BYTES, SHARD_BYTES = 5_000_000, 16_000_000
#: Step 1 looks at this many times the share of tokens that linked documents may differ in.
LOOK = 2.5
#: Copies of each class' answer that its rows are dealt to, so that the rows of a hot class spread.
SALTS = 8
#: Members of a group, about.
GROUP = 256
REMEMBERED = 250_000
MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]

_hashes: dict[bytes, int] = {}


def _word(word: bytes) -> int:
    if len(_hashes) >= REMEMBERED:
        _hashes.clear()
    _hashes[word] = h = xxhash.xxh3_64_intdigest(word)
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ x >> np.uint64(32)
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ x >> np.uint64(29)


def tokens(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _hashes
    h = np.array([known.get(w) or _word(w) for w in words], np.uint64)
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, m, np.uint64)
    for k in range(m):
        # The running mix makes every word's place count, for shingles of any length.
        out = _mix(out * np.uint64(MULTIPLIERS[k % 5]) + h[k : len(h) - m + 1 + k])
    return np.unique(out)


def _cut_up(shard: np.ndarray, shards: int, *columns: np.ndarray):
    order = np.lexsort((columns[0], shard))
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in range(shards):
        at = order[ends[k] : ends[k + 1]]
        if len(at):
            yield k, [c[at] for c in columns]


def _packed(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


_NAMES, _KINDS = ["shard", "block", "own", "data"], [pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
_SCHEMA = "shard int, block long, own boolean, data binary"


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _exchange(docs: DataFrame, n: int, shards: int, bits: int, share: float, reply, block_bytes: int) -> DataFrame:
    """Sends each block's (token, document) pairs to the tokens' shards, and ``reply``'s answers and the block's own row back.

    ``docs``: id, h, text; no text leaves its task. Only ``share`` of the token values are sent, cut
    to their top ``bits`` bits. Rows of the result: shard, block, own, data.
    """
    drop, below = np.uint64(64 - bits), np.uint64(min(int(share * 2**32), 2**32))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        block, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def full() -> pa.Table:
            sets = [tokens(text, n) for _, _, text in rows]
            marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            own = {"ids": [r[0] for r in rows], "h": [r[1] for r in rows], "n": np.array([len(s) for s in sets]), "marks": marks}
            out = [(block % shards, block, True, pack(pickle.dumps(own)))]
            flat = np.concatenate(sets) >> drop
            doc = np.repeat(np.arange(len(sets), dtype=np.uint32), own["n"])
            mixed = _mix(flat)
            if share < 1:
                at = np.flatnonzero(mixed >> np.uint64(32) < below)
                flat, doc, mixed = flat[at], doc[at], mixed[at]
            # Half of a mark, 64 bits, tells a text from its copies.
            short = np.array([int.from_bytes(m[:8], "little") for m in marks], np.uint64)
            shard = (mixed % np.uint64(shards)).astype(np.int64)
            for k, (t, d) in _cut_up(shard, shards, flat, doc):
                gaps, of = np.diff(t, prepend=np.uint64(0)), np.unique(d)
                out.append((k, block, False, pack(pickle.dumps((_packed(gaps), _packed(d), _packed(short[of]), _packed(of))))))
            return _table(out)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    rows.append(row)
                    size += len(row[2] or "") + 8
                    if size >= block_bytes:
                        yield from full().to_batches()
                        block, rows, size = block + 1, [], 0
        if rows:
            yield from full().to_batches()

    def meet(t: pa.Table) -> pa.Table:
        out, held = [], []
        for row in t.to_pylist():
            if row["own"]:
                out.append((row["shard"], row["block"], True, row["data"]))
                continue
            gaps, doc, short, of = pickle.loads(zstandard.ZstdDecompressor().decompress(row["data"]))
            doc, of = _unpacked(doc, np.uint32), _unpacked(of, np.uint32)
            short = _unpacked(short, np.uint64)
            held.append((row["block"], np.cumsum(_unpacked(gaps, np.uint64), dtype=np.uint64), doc, short[np.searchsorted(of, doc)]))
        if held:
            token = np.concatenate([x[1] for x in held])
            mark = np.concatenate([x[3] for x in held])
            order = np.lexsort((mark, token))
            new_token = np.r_[True, token[order][1:] != token[order][:-1]]
            new_mark = new_token | np.r_[True, mark[order][1:] != mark[order][:-1]]
            df = np.empty(len(order), np.int64)
            df[order] = np.add.reduceat(new_mark.astype(np.int64), np.flatnonzero(new_token))[np.cumsum(new_token) - 1]
            at = 0
            for block, t_, doc, _ in held:
                out.append((0, block, False, reply(t_, doc, df[at : at + len(doc)])))
                at += len(doc)
        return _table(out)

    ship(docs.sparkSession)
    return docs.select("id", "h", "text").mapInArrow(send, _SCHEMA).groupBy("shard").applyInArrow(meet, _SCHEMA)


def _bounded(docs: DataFrame, n: int, num: int, den: int, shards: int, bits: int, share: float, block_bytes: int) -> DataFrame:
    """Step 1: (doc_id, h, mark, n, open) of every row; ``open`` unless no partners other than copies are possible."""

    def reply(token: np.ndarray, doc: np.ndarray, df: np.ndarray) -> bytes:
        return pickle.dumps(np.bincount(doc[df == 1]).astype(np.uint32))

    def bound(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = pickle.loads(zstandard.ZstdDecompressor().decompress(next(r["data"] for r in rows if r["own"])))
        alone = np.zeros(len(own["n"]), np.int64)
        for r in rows:
            if not r["own"]:
                x = pickle.loads(r["data"])
                alone[: len(x)] += x
        open_ = (own["n"] > 0) & (den * (own["n"] - alone) >= num * own["n"])
        marks = [m if k else None for m, k in zip(own["marks"], own["n"], strict=True)]
        columns = zip([own["ids"], own["h"], marks, own["n"], open_], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()], strict=True)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in columns], names=["doc_id", "h", "mark", "n", "open"])

    met = _exchange(docs, n, shards, bits, share, reply, block_bytes)
    return met.groupBy("block").applyInArrow(bound, "doc_id long, h long, mark binary, n long, open boolean")


def _shared(left: DataFrame, n: int, num: int, den: int, shards: int, block_bytes: int) -> DataFrame:
    """Step 2 for the documents left: (id, mark, n, key, tokens, rare): their shared tokens, sorted and as packed integers, and the rarest."""

    def reply(token: np.ndarray, doc: np.ndarray, df: np.ndarray) -> bytes:
        keep = df > 1
        parts = _packed(np.diff(token[keep], prepend=np.uint64(0))), _packed(doc[keep]), np.minimum(df[keep], 255).astype(np.uint8)
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts))

    def gather(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        unpack = zstandard.ZstdDecompressor().decompress
        own = pickle.loads(unpack(next(r["data"] for r in rows if r["own"])))
        parts = [pickle.loads(unpack(r["data"])) for r in rows if not r["own"]]
        token = np.concatenate([np.cumsum(_unpacked(x[0], np.uint64), dtype=np.uint64) for x in parts]) if parts else np.zeros(0, np.uint64)
        doc = np.concatenate([_unpacked(x[1], np.uint32) for x in parts]) if parts else np.zeros(0, np.uint32)
        df = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, np.uint8)
        order = np.lexsort((token, df, doc))
        token, doc = token[order], doc[order]
        ends = np.searchsorted(doc, np.arange(len(own["n"]) + 1))
        out = []
        for k, size in enumerate(own["n"].tolist()):
            mine = token[ends[k] : ends[k + 1]]
            # The least overlap with any partner; of so many shared tokens less one, two partners' rarest meet.
            least = -(-num * size // den)
            if size and len(mine) >= least:
                rare = mine[: len(mine) - least + 1]
                key = int(_mix(mine).min() >> np.uint64(1))
                out.append((own["ids"][k], own["marks"][k], size, key, np.sort(mine).tobytes(), rare.view(np.int64).tolist()))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names=["id", "mark", "n", "key", "tokens", "rare"])

    met = _exchange(left, n, shards, 64, 1.0, reply, block_bytes)
    return met.groupBy("block").applyInArrow(gather, "id long, mark binary, n long, key long, tokens binary, rare array<long>")


def compare(left: list[tuple], right: list[tuple] | None, num: int, den: int) -> list[tuple]:
    """Spanning links of members (name, n, tokens) of two groups, or within one (``right`` None)."""
    members = left + (right or [])
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first = len(left)
    out = []
    others = range(first, len(members)) if right is not None else range(len(members))
    union = np.unique(np.concatenate([members[j][2] for j in others])) if right is not None else None
    for i in range(first):
        mark, n, mine = members[i]
        if union is not None and den * np.isin(mine, union, assume_unique=True).sum() < num * n:
            continue
        for j in others if right is not None else range(i):
            other, size, theirs = members[j]
            # An intersection is no larger than either set's shared tokens.
            most = min(len(mine), len(theirs))
            if den * most < num * (n + size - most) or find(i) == find(j):
                continue
            both = len(np.intersect1d(mine, theirs, assume_unique=True))
            if den * both >= num * (n + size - both):
                root[find(i)] = find(j)
                out.append((mark, other))
    return out


def _links(shared: DataFrame, num: int, den: int, group: int) -> DataFrame:
    """Step 3: spanning links (u, v) between classes, named by (whether the least id is null, it, mark): in the order of ids."""
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.xxhash64("mark"), F.ceil(F.col("size") / group).cast("long"))
    grouped = cut(shared.join(sizes, "key").withColumn("g", F.xxhash64("key", part)).drop("key", "size"), "jaccard-groups")
    matrix = cut(grouped.select("g", F.explode("rare").alias("token")).distinct(), "jaccard-matrix")
    pairs = matrix.join(matrix.select("token", F.col("g").alias("h")), "token").where("g < h").select("g", "h").distinct()
    within = grouped.groupBy("g").count().where("count > 1").select("g", F.col("g").alias("h"))
    units = cut(pairs.union(within).withColumn("unit", F.xxhash64("g", "h")), "jaccard-units")
    free(matrix)
    sides = units.select("unit", "g", F.lit(0).alias("side")).union(units.where("g <> h").select("unit", "h", F.lit(1)))

    def open_(t: pa.Table) -> pa.Table:
        sides = [[], []]
        for row in t.to_pylist():
            sides[row["side"]].append(((row["id"], row["mark"]), row["n"], np.frombuffer(row["tokens"], np.uint64)))
        for side in sides:
            side.sort(key=lambda x: x[0][1])
        found = compare(sides[0], sides[1] or None, num, den)
        ends = [pa.array([link[end][k] for link in found], kind) for end in (0, 1) for k, kind in ((0, pa.int64()), (1, pa.binary()))]
        return pa.Table.from_arrays(ends, names=["u_id", "u_mark", "v_id", "v_mark"])

    met = sides.join(grouped.select("g", "id", "mark", "n", "tokens"), "g")
    found = met.groupBy("unit").applyInArrow(open_, "u_id long, u_mark binary, v_id long, v_mark binary")
    node = lambda x: F.struct(F.isnull(f"{x}_id").alias("none"), F.col(f"{x}_id").alias("id"), F.col(f"{x}_mark").alias("mark"))
    return found.select(node("u").alias("u"), node("v").alias("v"))


def _representatives(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, h, text) of one row for each open class, that with the least id; texts are read again, not carried along.

    The list of representatives grows with the corpus, so it is never broadcast: both sides are
    shuffled by id and text hash at every size.
    """
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h")).alias("x")
    chosen = rows.where("open").groupBy("mark").agg(first)
    chosen = cut(chosen.select(F.col("x.doc_id").alias("i"), F.col("x.h").alias("x")), "jaccard-chosen")
    left = docs.join(chosen.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("x")), "left_semi")
    # Only rows that repeat whole can be chosen more than once.
    repeats = rows.where("open").groupBy("doc_id", "h").count().where("count > 1")
    return left if repeats.isEmpty() else left.dropDuplicates(["id", "h"])


def components(
    docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, group: int = GROUP, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents are linked if den * |intersection| >= num * |union| of their distinct ``n``-word
    shingles (A-Z lower-cased); ``component_id`` is the least doc_id of those reachable. A text with
    fewer than ``n`` words is one shingle; null, empty and blank texts have none and are linked with
    nothing. Rows with a null id take part and get the least id of the others, or null. Repeated
    rows come back as often. Texts are read whole. Shingles are compared by 64-bit hashes, classes by
    128-bit ones.
    """
    return _labelled(docs, n, num, den, group, block_bytes, shard_bytes).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, n: int, num: int, den: int, group: int, block_bytes: int, shard_bytes: int) -> DataFrame:
    """``components`` with ``h``, the hash of the row's text, ``name``, the class that names the component, and ``first``: whether it is the row's."""
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    size = int(slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    # In step 1 chance agreements only keep a document longer; 13 bits beyond the tokens make them rare.
    bits = min(64, max(32, (size // 4).bit_length() + 13))
    share = min(1.0, LOOK * (den - num) / den)
    rows = cut(_bounded(slim, n, num, den, max(8, int(size * share / shard_bytes)), bits, share, block_bytes), "jaccard-rows")
    left = cut(_representatives(slim, rows), "jaccard-left")
    size = int(left.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    shared = cut(_shared(left, n, num, den, max(8, size // shard_bytes), block_bytes), "jaccard-shared")
    free(left)
    linked = graph.components(_links(shared, num, den, group))
    linked = linked.select(F.col("node.mark").alias("mark"), F.col("root").alias("root"))
    classes = rows.where("mark is not null").groupBy("mark").agg(
        F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), "mark")).alias("least"), F.count(F.lit(1)).alias("copies")
    )
    # A row alone with its text and without links needs no answer; the others' rows are dealt over copies of it.
    named = classes.join(linked, "mark", "left").where("copies > 1 or root is not null")
    named = named.select("mark", F.coalesce("root", "least").alias("root"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int")
    # The copies compress well, so their size in bytes would make them look fit to broadcast.
    out = rows.withColumn("salt", salt).join(cut(named, "jaccard-named").hint("merge"), ["mark", "salt"], "left")
    return out.select(
        "doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("root.id")).alias("component_id"),
        (F.col("root").isNull() | (F.col("root.mark") == F.col("mark"))).alias("first"), F.coalesce("root.mark", "mark").alias("name"),
    )


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the least id's, with that of its texts which the component is named by.

    Rows that repeat there, and several texts of one id in a component, leave one. A row with a null
    id stays: nothing tells it from others, and it stands for no group.
    """
    found = _labelled(docs, n, num, den, GROUP, BLOCK_BYTES, SHARD_BYTES)
    gone = "doc_id is not null and not (first and doc_id <=> component_id)"
    found = cut(found.withColumn("gone", F.expr(gone)), "jaccard-components")
    own = docs.columns
    dropped = cut(found.where("gone").select(F.col("doc_id").alias("i"), F.col("h").alias("x")).distinct(), "jaccard-dropped")
    i, x = F.col("doc_id").cast("long"), F.xxhash64("text")
    # The list grows with the corpus: never broadcast.
    out = docs.join(dropped.hint("merge"), (i == F.col("i")) & (x == F.col("x")), "left_anti")
    # Only rows that repeat, whole or but for case and white space, stand for a component more than once.
    kept = found.where("not gone and doc_id is not null and n_shingles > 0")
    again = kept.groupBy(F.col("doc_id").alias("j"), F.col("name").alias("m")).agg(F.min("h").alias("least"), F.count(F.lit(1)).alias("times"))
    again = cut(again.where("times > 1").drop("times"), "jaccard-again")
    if again.isEmpty():
        return out
    extra = kept.join(again, (F.col("doc_id") == F.col("j")) & (F.col("name") == F.col("m"))).where("h <> least").select("j", "h").distinct()
    text = free_name(docs, "h")
    out = out.withColumn(text, x).join(cut(extra.withColumnRenamed("h", "y"), "jaccard-extra"), (i == F.col("j")) & (F.col(text) == F.col("y")), "left_anti")
    same = (i == F.col("j")) & (F.col(text) == F.col("least"))
    some = out.join(again, same, "left_semi").dropDuplicates(["doc_id", text])
    return out.join(again, same, "left_anti").union(some).select(*own)
