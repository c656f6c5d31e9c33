"""Language-model scoring with a probabilistic suffix tree (operator 8).

The symbols are words and the end of a text; words unknown to the training documents are one more
symbol. The root of the tree has the corpus' smoothed word frequencies. A context of one, two or three
words is kept if what follows it in training diverges from what its parent, the context without its
oldest word, expects; each word is scored in the state of the longest suffix kept, whose
distribution is smoothed with its parent's.

Documents are cut into blocks of some MB, in which words are numbers. A block sends its distinct
words, compressed, to the vocabulary's shards by their hash; these answer with ids that follow the
words' counts in the whole corpus. Then every block sends its words with the three
before each, compressed, to the shards of the nearest of these; a shard holds the whole subtree of the contexts
that end in its words, tests them, and answers with what each document gains over the root. Words
too frequent for one shard are dealt by the word before them; the counts of what follows such a
word are summed over its shards first, so that its context is tested like any other.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks as count_blocks
from .common import cut, free, ship

#: Bytes of text after which a block is full.
BLOCK_BYTES = 8_000_000
#: Least gain in log-likelihood, in nats over the training documents, of a context over its parent.
MIN_GAIN = 3.0
END = "\n"
ADDED = 0.1
#: Gains are rounded to so many parts of a unit of log10, a word: whole numbers add up to the same sum in any order and dealing.
UNIT = 2**20
#: The rank of a word that training doesn't have.
UNSEEN = 0xFFFFFFFF
#: What a message holds: a block's own sums, occurrences, counts of pairs that begin with a hot word, or all such pairs of a shard.
OWN, OCCURRENCES, HOT, PAIRS = range(4)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def held_out(doc_id) -> bool:
    """Every tenth document by the CRC of its id; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def make_blocks(docs: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: ids, token counts and tokens of its documents, the shard of each word, and for each shard its words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3).compress
        ids, tokens, numbers, size = [], [], _Numbers({END.encode(): 0}), 0

        def full() -> pa.RecordBatch:
            lengths = [len(t) for t in tokens]
            flat = np.concatenate(tokens)
            trains = np.repeat([not held_out(i) for i in ids], lengths)
            counts = np.bincount(flat[trains], minlength=len(numbers))
            shard = np.fromiter((zlib.crc32(w) % shards for w in numbers), np.uint32, len(numbers))
            words = pa.array([*numbers], pa.binary())
            sent = [pack(pickle.dumps((b" ".join(words.take(pa.array(at)).to_pylist()), _planes(counts[at])))) for at in _places(shard, shards)]
            row = [[block], [ids], [lengths], [pack(flat.tobytes())], [pack(_planes(shard))], [sent]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = (text or "").encode().lower()
                    ids.append(i)
                    tokens.append(np.array([*map(numbers.__getitem__, data.split()), 0], np.uint32))
                    size += len(data) + 8
                    if size >= block_bytes:
                        yield full()
                        block, ids, tokens, numbers, size = block + 1, [], [], _Numbers({END.encode(): 0}), 0
        if ids:
            yield full()

    schema = pa.schema(
        [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary()),
         ("parts", pa.binary()), ("words", pa.list_(pa.binary()))]
    )
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(
        run, "block long, ids array<long>, lengths array<int>, tokens binary, parts binary, words array<binary>"
    )


def merge(t: pa.Table) -> pa.Table:
    """A shard of the vocabulary, from its blocks' words: each block's words as ranks among the shard's, most frequent first, and how many words have each count."""
    rows = sorted(t.to_pylist(), key=lambda r: r["block"])
    words, counts = [], []
    for row in rows:
        joined, planes = pickle.loads(zstandard.ZstdDecompressor().decompress(row["data"]))
        counts.append(_joined(planes, np.int64))
        words.append(pa.array(joined.split(b" ") if len(counts[-1]) else [], pa.binary()))
    codes = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    total = np.bincount(codes, weights=np.concatenate(counts)).astype(np.int64)
    order = np.argsort(-total, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    rank[total == 0] = UNSEEN
    pack = zstandard.ZstdCompressor(level=3).compress
    ranks = [pack(_planes(x)) for x in np.split(rank[codes], np.cumsum([len(c) for c in counts])[:-1])]
    c, n = np.unique(total[total > 0], return_counts=True)
    row = [[rows[0]["shard"]], [[r["block"] for r in rows]], [ranks], [c[::-1]], [n[::-1]]]
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["shard", "blocks", "ranks", "c", "n"])


def number(merged: DataFrame, counts: Counts) -> DataFrame:
    """(b, k, data): the ids, 0, 1, 2 ... from the most frequent word of all shards on, of block ``b``'s words in shard ``k``.

    A word's id: the words with higher counts, those with its count in earlier shards, and its
    place in its own. No task sees more than a shard, or the shards' sizes for one count.
    """
    sizes = merged.select("shard", F.explode(F.arrays_zip("c", "n")).alias("x")).select("shard", "x.c", "x.n")
    earlier = Window.partitionBy("c").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "c", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    sizes = sizes.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("c", "earlier")), asc=False).alias("x"))
    placed = merged.join(sizes.select("shard", F.col("x.earlier").alias("earlier")), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ends = np.cumsum(row["n"])
                moved = counts.starts(np.array(row["c"])) + np.array(row["earlier"]) - (ends - np.array(row["n"]))
                data = []
                for blob in row["ranks"]:
                    rank = _joined(unpack(blob), np.uint32).astype(np.int64)
                    seen = rank != UNSEEN
                    ids = np.full(len(rank), counts.known, np.int64)
                    ids[seen] = rank[seen] + moved[np.searchsorted(ends, rank[seen], "right")]
                    data.append(pack(_planes(ids.astype(np.uint32))))
                n = len(data)
                yield pa.RecordBatch.from_arrays([pa.array(row["blocks"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array(data, pa.binary())], ["b", "k", "data"])

    return placed.select("shard", "blocks", "ranks", "c", "n", "earlier").mapInArrow(run, "b long, k int, data binary")


class Counts:
    """Counts by id: as ids follow the counts, one step for each count that occurs, at most sqrt(2 N) of them."""

    def __init__(self, steps: list[tuple[int, int]]) -> None:
        steps = sorted(steps, reverse=True)
        self.values = np.array([c for c, _ in steps] + [0], np.int64)
        self.ends = np.cumsum([n for _, n in steps]) if steps else np.zeros(0, np.int64)
        self.known = int(self.ends[-1]) if steps else 0
        self.tokens = int(sum(c * n for c, n in steps))
        self.room = self.tokens + ADDED * (self.known + 1)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.ends, ids, "right")]

    def starts(self, c: np.ndarray) -> np.ndarray:
        """How many words have higher counts than ``c``."""
        return np.r_[0, self.ends][np.searchsorted(-self.values[:-1], -c)]

    def root(self, ids: np.ndarray) -> np.ndarray:
        return (self.of(ids) + ADDED) / self.room


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _joined(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _places(parts: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of ``n`` parts, where it occurs."""
    return np.split(np.argsort(parts, kind="stable"), np.cumsum(np.bincount(parts, minlength=n))[:-1])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by the columns, and in it where a new row of values starts."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, new


def _gains(p: np.ndarray, c: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """What next words seen ``c`` times gain over the parent's ``p`` in a context of ``total`` occurrences and ``kinds`` next words, each left out of its own count."""
    own = (np.maximum(c - 1, 0) + kinds * p) / np.maximum(total - 1 + kinds, 1)
    return c * np.log(np.where(c > 0, own / p, 1.0))


def _smoothed(p: np.ndarray, c: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return (c + kinds * p) / np.maximum(total + kinds, 1)


def _sent(k: np.ndarray, key: np.ndarray, c: np.ndarray) -> bytes:
    """Counts of pairs by shard, sorted by both and packed."""
    order = np.lexsort((key, k))
    planes = [_planes(x) for x in (k[order].astype(np.uint32), np.diff(key[order], prepend=0), c[order].astype(np.int64))]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(planes))


def _received(messages: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards, pairs and counts of several messages, the counts of the same pair and shard summed."""
    parts = []
    for data in messages:
        planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
        k, gaps, c = (_joined(x, t) for x, t in zip(planes, (np.uint32, np.int64, np.int64), strict=True))
        parts.append((k.astype(np.int64), np.cumsum(gaps), c))
    return _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _summed(k: np.ndarray, key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, new = _groups(k, key)
    at = order[new]
    return k[at], key[at], np.bincount(np.cumsum(new) - 1, weights=c[order]).astype(np.int64)


def subtree(
    z: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, count: np.ndarray, counts: Counts, hot: np.ndarray, min_gain: float,
    shared: np.ndarray | None = None,
):
    """For occurrences of word ``n`` after ``z a b``, with training counts: the natural log of its probability, and of the root's.

    ``b``, ``a b`` and ``z a b`` are kept by their test: the gain in log-likelihood of their own
    smoothed distribution over the parent's, each occurrence left out of the counts that predict it,
    so that a context seen once gains nothing. Of a hot ``b`` only some occurrences are here, so the
    probability of ``n`` in its state is given by ``shared``.
    """
    order, new = _groups(b, a, z, n)
    whole = np.empty(len(order), np.int64)
    whole[order] = np.cumsum(new) - 1
    at = order[new]
    z, a, b, n, hot = z[at], a[at], b[at], n[at], hot[at]
    c = np.bincount(whole, weights=count, minlength=len(at))
    p = counts.root(n)
    root = p.copy()

    def state(p: np.ndarray, *context: np.ndarray) -> np.ndarray:
        """``p`` moved to the contexts that pass their test; rows that differ in older words alone count as one."""
        order, new = _groups(*context, n)
        row = np.empty(len(order), np.int64)
        row[order] = np.cumsum(new) - 1
        first = order[new]
        p, times = p[first], np.bincount(row, weights=c)
        of = np.zeros(len(first), np.int64)
        of[1:] = np.cumsum(np.any([x[first][1:] != x[first][:-1] for x in context], axis=0))
        total = np.bincount(of, weights=times)[of]
        kinds = np.bincount(of, weights=times > 0)[of]
        gain = np.bincount(of, weights=_gains(p, times, total, kinds))[of]
        return np.where((gain >= min_gain) & (total > 1), _smoothed(p, times, total, kinds), p)[row]

    if len(at):
        p = state(p, b)
        if shared is not None:
            p = np.where(hot, shared[at], p)
        p = state(p, b, a)
        p = state(p, b, a, z)
    return np.log(p)[whole], np.log(root)[whole]


def score(docs: DataFrame, min_gain: float = MIN_GAIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Learns from the rows whose crc32(doc_id) mod 10 is not 0. Null and empty texts are the end token
    alone. A null id counts as held out. Rows that repeat train and are scored as often. Without
    training rows every token is the unknown symbol, with probability 1. Texts may be of any length:
    a block holds at least one whole. A word that alone has more than one shard's share of all
    tokens is hot: its occurrences are dealt by the word before too, and its own context is tested
    on counts summed over them; which words are hot changes no result.
    """
    vocabulary_shards = max(4, count_blocks(docs) // 4)
    blocks = cut(make_blocks(docs, vocabulary_shards, block_bytes), "lm-blocks")
    words = blocks.select("block", F.posexplode("words").alias("shard", "data"))
    merged = cut(
        words.groupBy("shard").applyInArrow(merge, "shard int, blocks array<long>, ranks array<binary>, c array<long>, n array<long>"), "lm-words"
    )
    counts = Counts([tuple(r) for r in merged.select(F.explode(F.arrays_zip("c", "n")).alias("x")).groupBy("x.c").agg(F.sum("x.n")).collect()])
    if counts.known + 2 >= UNSEEN:
        raise ValueError("ids of 32 bits cannot number so many distinct words")
    shards = max(4, blocks.count())
    few = max(4, shards // 8)
    # Ids follow the counts: the hot words are the first.
    hottest = int(counts.starts(np.array(max(1, counts.tokens // shards))))
    unknown, before = counts.known, counts.known + 1

    def renumber(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block with its tokens as ids."""
        out = []
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for row in left.to_pylist():
            parts = _joined(unpack(row["parts"]), np.uint32)
            places = _places(parts, vocabulary_shards)
            number_of = np.full(len(parts), unknown, np.uint32)
            for answer in right.to_pylist():
                number_of[places[answer["k"]]] = _joined(unpack(answer["data"]), np.uint32)
            out.append((row["block"], row["ids"], row["lengths"], pack(_planes(number_of[np.frombuffer(unpack(row["tokens"]), np.uint32)]))))
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["block", "ids", "lengths", "tokens"])

    def opened(row: dict) -> tuple[np.ndarray, ...]:
        """A block's words with the three before each, the document of each, and whether that is held out."""
        n = _joined(zstandard.ZstdDecompressor().decompress(row["tokens"]), np.uint32).astype(np.int64)
        lengths = np.array(row["lengths"])
        place = np.arange(len(n)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        z, a, b = (np.where(place >= k, np.roll(n, k), before) for k in (3, 2, 1))
        return z, a, b, n, np.repeat(np.arange(len(lengths)), lengths), np.array([held_out(x) for x in row["ids"]])

    def dealt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (_mixed(np.where(b < hottest, b * np.int64(0x10001) + a, b)) % np.uint64(shards)).astype(np.int64)

    def useful(b: np.ndarray, n: np.ndarray, c: np.ndarray, train: np.ndarray) -> np.ndarray:
        """Which of a block's occurrences a context of words can be kept on or change; the others have the root's probability.

        No context that training has once passes the test, and none whose next words all differ: it
        loses by its own distribution. So a word that training has twice needs the same next word
        twice, and one that training has in this block only needs a next word that repeats here.
        """
        times = counts.of(b)
        use = times > 1
        if min_gain > 0 and train.any():
            use &= ~(train & (times == 2) & (c < 2))
            pairs, repeats = np.unique(b[train] << 32 | n[train], return_counts=True)
            words, first = np.unique(pairs >> 32, return_index=True)
            here = np.add.reduceat(repeats, first) == counts.of(words)
            use &= ~np.isin(b, words[here & (np.maximum.reduceat(repeats, first) == 1)])
        return use

    def each(body):
        """``body``, which makes (shard, block, kind, data) rows of one row, for mapInArrow."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    out = body(batch.slice(at, 1).to_pylist()[0])
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        return run

    def send(row: dict) -> list[tuple]:
        """A block's own sums, and its triples for every shard."""
        out = []
        pack = zstandard.ZstdCompressor(level=3).compress
        z, a, b, n, doc, held = opened(row)
        lengths = np.array(row["lengths"])
        starts = np.cumsum(lengths) - lengths
        c = counts.of(n)
        own = {"ids": row["ids"], "held": held, "lengths": lengths, "known": np.add.reduceat((c > 0).astype(np.int64), starts)}
        own["base"] = np.add.reduceat(np.log10((c + ADDED) / counts.room), starts)
        out.append((int(row["block"] % shards), row["block"], OWN, pickle.dumps(own)))
        use = np.flatnonzero((b == before) | useful(b, n, c, ~held[doc]))
        del c
        z, a, b, n, doc = z[use], a[use], b[use], n[use], doc[use]
        shard = dealt(a, b)
        order = np.lexsort((n, a, b, shard))
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for k in range(shards):
            at = order[cuts[k] : cuts[k + 1]]
            if len(at):
                # Sorted pairs as gaps, and bytes of one weight together: most high bytes are 0.
                gaps = np.diff(b[at] << 32 | a[at], prepend=0)
                planes = [_planes(x) for x in (gaps, *(y[at].astype(np.uint32) for y in (n, z, doc)))]
                out.append((k, row["block"], OCCURRENCES, pack(pickle.dumps((planes, np.packbits(held))))))
        return out

    def messages(to: np.ndarray, block: int, k: np.ndarray, key: np.ndarray, c: np.ndarray) -> list[tuple]:
        return [(i, block, HOT, _sent(k[at], key[at], c[at])) for i, at in enumerate(_places(to, few)) if len(at)]

    def ask(row: dict) -> list[tuple]:
        """The pairs of a hot word and the next that each shard has from a block, with training counts."""
        _, a, b, n, doc, held = opened(row)
        use = np.flatnonzero(b < hottest)
        k, key, c = _summed(dealt(a[use], b[use]), b[use] << 32 | n[use], ~held[doc[use]])
        return messages(k % few, row["block"], k, key, c)

    def gather(t: pa.Table) -> pa.Table:
        """The same pairs of all blocks, sent on by pair."""
        k, key, c = _received(t.column("data").to_pylist())
        return as_table(messages((_mixed(key) % np.uint64(few)).astype(np.int64), int(k[0] % few), k, key, c))

    def total(t: pa.Table) -> pa.Table:
        """The pairs' counts over all shards: a row for each shard that asks, and one of all pairs."""
        k, key, c = _received(t.column("data").to_pylist())
        _, pairs, sums = _summed(np.zeros_like(k), key, c)
        c = sums[np.searchsorted(pairs, key)]
        out = [(0, -1, PAIRS, _sent(np.zeros_like(pairs), pairs, sums))]
        ends = np.flatnonzero(np.r_[k[1:] != k[:-1], True]) + 1
        out += [(int(k[i]), -1, HOT, _sent(k[i:j], key[i:j], c[i:j])) for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        return as_table(out)

    def as_table(out: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def by_word(pairs: DataFrame, value) -> np.ndarray:
        """For each hot word the sum of ``value`` over the words that follow it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    _, key, c = _received([data])
                    sums = np.bincount(key >> 32, weights=value(key >> 32, key & 0xFFFFFFFF, c), minlength=hottest)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(hottest)), pa.array(sums)], ["b", "x"])

        found = np.zeros(hottest)
        for b, x in pairs.mapInArrow(run, "b long, x double").groupBy("b").agg(F.sum("x")).collect():
            found[b] = x
        return found

    def test(t: pa.Table) -> pa.Table:
        """A shard: passes the blocks' own sums on, and adds what their documents gain over the root."""
        out, blobs, occurrences, told = [], [], [], []
        for row in t.to_pylist():
            if row["kind"] == OWN:
                out.append((row["shard"], row["block"], OWN, row["data"]))
            elif row["kind"] == HOT:
                told.append(row["data"])
            else:
                planes, held = pickle.loads(zstandard.ZstdDecompressor().decompress(row["data"]))
                pairs = np.cumsum(_joined(planes[0], np.int64))
                n, z, doc = (_joined(x, np.uint32) for x in planes[1:])
                blobs.append((row["block"], doc))
                occurrences.append((pairs, n, z, np.unpackbits(held)[doc] == 0))
        if blobs:
            pairs, n, z, train = (np.concatenate(x) for x in zip(*occurrences, strict=True))
            occurrences.clear()
            a, b, n = pairs & 0xFFFFFFFF, pairs >> 32, n.astype(np.int64)
            del pairs
            hot, shared = b < hottest, None
            if told:
                _, key, c = _received(told)
                of, p = key >> 32, counts.root(key & 0xFFFFFFFF)
                p = np.where(hot_kept[of], _smoothed(p, c, counts.of(of), hot_kinds[of]), p)
                shared = np.zeros(len(b))
                shared[hot] = p[np.searchsorted(key, b[hot] << 32 | n[hot])]
            lp, root = subtree(z, a, b, n, train.astype(np.float64), counts, hot, min_gain, shared)
            gain = np.rint((lp - root) / np.log(10) * UNIT)
            at = 0
            for block, doc in blobs:
                sums = np.bincount(doc, weights=gain[at : at + len(doc)]).astype(np.int64)
                at += len(doc)
                some = np.flatnonzero(sums)
                planes = _planes(np.diff(some, prepend=0).astype(np.uint32)), _planes(sums[some] << 1 ^ sums[some] >> 63)
                out.append((0, block, OCCURRENCES, zstandard.ZstdCompressor(level=3).compress(pickle.dumps(planes))))
        return as_table(out)

    def finish(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = pickle.loads(next(r["data"] for r in rows if r["kind"] == OWN))
        gained = np.zeros(len(own["lengths"]), np.int64)
        for data in (r["data"] for r in rows if r["kind"] != OWN):
            planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
            sums = _joined(planes[1], np.int64)
            gained[np.cumsum(_joined(planes[0], np.uint32))] += sums >> 1 ^ -(sums & 1)
        total = own["base"] + gained / UNIT
        n = len(own["lengths"])
        return pa.table(
            [pa.array(own["ids"], pa.int64()), pa.array(own["held"]), pa.array(own["lengths"], pa.int64()), pa.array(own["known"]),
             pa.array(np.full(n, counts.tokens)), pa.array(own["base"]), pa.array(total)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    names, kinds = ["shard", "block", "kind", "data"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    schema = "shard int, block long, kind int, data binary"
    texts = blocks.select("block", "ids", "lengths", "tokens", "parts")
    texts = texts.groupBy("block").cogroup(number(merged, counts).groupBy("b"))
    numbered = cut(texts.applyInArrow(renumber, "block long, ids array<long>, lengths array<int>, tokens binary"), "lm-numbered")
    free(blocks)
    sent = numbered.mapInArrow(each(send), schema)
    hot_kinds = hot_kept = np.zeros(0)
    if hottest:
        asked = numbered.mapInArrow(each(ask), schema).groupBy("shard").applyInArrow(gather, schema)
        told = cut(asked.groupBy("shard").applyInArrow(total, schema), "lm-hot")
        pairs = told.where(F.col("kind") == PAIRS).select("data")
        sums = counts.of(np.arange(hottest))
        hot_kinds = by_word(pairs, lambda b, n, c: c > 0)
        hot_kept = (by_word(pairs, lambda b, n, c: _gains(counts.root(n), c, sums[b], hot_kinds[b])) >= min_gain) & (sums > 1)
        sent = sent.unionByName(told.where(F.col("kind") == HOT))
    return sent.groupBy("shard").applyInArrow(test, schema).groupBy("block").applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
