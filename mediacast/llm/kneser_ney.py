"""Quality classifier: interpolated modified Kneser-Ney perplexity (operator 4).

A trigram model is fitted on a bounded sample of trusted documents. Its counts stay in tables that
are sharded by the middle word of a trigram, so that a shard holds all that is known of the contexts
that end in its words. Blocks of documents send their trigrams to the shards and join them there with
the counts; what comes back is a sum of log-probabilities a document. A document is rejected if its
perplexity exceeds that of nearly all held-out trusted documents of its language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ship, words

#: The training sample: at most so many documents, and texts of so many bytes (the last one whole).
MAX_DOCS, MAX_BYTES = 4_000, 8_000_000
#: One of so many trusted documents, by the hash of its id, is never fitted on: thresholds are its kind's.
HELD_OUT = 4
#: A language's threshold is this quantile of its held-out trusted documents.
QUANTILE = 0.99
#: Least number of tokens of the language's mean that every document's mean is weighed with; held-out documents may ask for more.
SHRINK = 50
#: A language with fewer held-out documents takes the threshold of all.
ENOUGH = 20
#: Shards of the counts, which the sample bounds; bytes of text in a block; bytes of text whose blocks meet one copy of a shard.
SHARDS, BLOCK_BYTES, GROUP_BYTES = 16, 8_000_000, 256_000_000
BIN = 0.01
START, UNKNOWN, FIRST = 0, 1, 2


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def discounts(n: list[int]) -> list[float]:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    if n[0] == 0 or n[1] == 0:
        return [0.0, 0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * (n[k] / n[k - 1] if n[k - 1] else 1.0) for k in (1, 2, 3)]
    return [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))]


def _order(counts: np.ndarray, context: np.ndarray, size: int, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Discounted shares of n-grams, and for each of ``size`` contexts the weight that is left to the lower order."""
    off = np.array(d)[np.minimum(counts, 3)]
    total = np.bincount(context, weights=counts, minlength=size)
    left = np.bincount(context, weights=off, minlength=size)
    return (counts - off) / total[context], np.where(total > 0, left / np.maximum(total, 1), 1.0)


def _found(held: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    """Each key's value, or the default; ``held`` is sorted."""
    out = np.full(len(keys), default)
    if len(held):
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        same = held[at] == keys
        out[same] = values[at[same]]
    return out


class Shard:
    """What the counts of trigrams ``a b n`` give for the contexts ``b`` and ``a b`` of some middle words ``b``."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, counts: np.ndarray, d2: list[float], d3: list[float]) -> None:
        pairs, kinds = np.unique(b << 32 | n, return_counts=True)
        self.pairs = pairs
        self.words, of = np.unique(pairs >> 32, return_inverse=True)
        # Lower orders count kinds of predecessors instead of occurrences.
        self.share2, self.weight1 = _order(kinds, of, len(self.words), d2)
        self.contexts, of = np.unique(b << 32 | a, return_inverse=True)
        keys = of.astype(np.int64) << 32 | n
        order = np.argsort(keys)
        share3, self.weight2 = _order(counts, of, len(self.contexts), d3)
        self.triples, self.share3 = keys[order], share3[order]

    def probability(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, one: np.ndarray) -> np.ndarray:
        p = _found(self.pairs, self.share2, b << 32 | n, 0.0) + _found(self.words, self.weight1, b, 1.0) * one[n]
        at = _found(self.contexts, np.arange(len(self.contexts), dtype=float), b << 32 | a, -1.0).astype(np.int64)
        weight = np.where(at >= 0, np.append(self.weight2, 1.0)[at], 1.0)
        return _found(self.triples, self.share3, np.where(at >= 0, at << 32 | n, -1), 0.0) + weight * p


def _trusted(labels: DataFrame) -> DataFrame:
    """Ids that every label calls good and none toxic, with ``held_out``."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = good.where((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0))
    return good.select("doc_id", (F.pmod(F.xxhash64(F.lit("held-out"), "doc_id"), F.lit(HELD_OUT)) == 0).alias("held_out"))


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> list[int]:
    """Ids of the training sample: trusted documents that are not held out, by least hash, within both bounds.

    Labels without a document, null ids and ids that a label calls bad or toxic are left out; none
    trusted gives the empty list.
    """
    ids = _trusted(labels).where("not held_out").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select("doc_id")
    ids = cut(ids, "kn-ids")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("n")).join(F.broadcast(ids), "doc_id")
    sizes = sizes.groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen, total = [], 0
    for row in sizes.limit(max_docs).collect():
        if total >= max_bytes:
            break
        chosen.append(row["doc_id"])
        total += row["n"] or 0
    return chosen


class Model:
    """A vocabulary with its unigram probabilities, which the sample's bytes bound, and the table of the shards."""

    def __init__(self, words: list[bytes], one: np.ndarray, shards: DataFrame) -> None:
        self.words, self.one, self.shards = words, one, shards


def fit(docs: DataFrame, ids: list[int]) -> Model | None:
    """The model of the documents with these ids; None if they have no word. Null texts are empty, repeated rows count each.

    Trigrams are counted by executors and stay there; the driver gets the vocabulary, a word's
    number of predecessors, and how many n-grams have each small count.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = docs.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "i long")), F.col("doc_id").cast("long") == F.col("i"), "left_semi").select("text")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(_tokens(text))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["w"])

    # At most half of the sample's bytes, as a word has one at least and a space after it.
    words = chosen.mapInArrow(words_of, "w binary").distinct().orderBy("w").toArrow()["w"].to_pylist()
    if not words:
        return None
    shared = spark.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value, FIRST)}
        for batch in batches:
            rows = [np.zeros((0, 3), np.int32)]
            for text in batch.column(0).to_pylist():
                n = np.array([START, START, *(number[w] for w in _tokens(text))], np.int32)
                rows.append(np.stack([n[:-2], n[1:-1], n[2:]], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(rows).T], ["a", "b", "n"])

    tri = cut(chosen.mapInArrow(count, "a int, b int, n int").groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("c")), "kn-trigrams")
    bi = tri.groupBy("b", "n").agg(F.count(F.lit(1)).alias("c"))
    few = lambda df: df.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    d2, d3 = discounts(list(few(bi))), discounts(list(few(tri)))
    uni = bi.groupBy("n").agg(F.count(F.lit(1)).alias("c")).toArrow()
    kinds = np.zeros(len(words) + FIRST, np.int64)
    kinds[uni["n"].to_numpy()] = uni["c"].to_numpy()
    seen = kinds[kinds > 0]
    share, weight = _order(seen, np.zeros(len(seen), np.int64), 1, discounts([int((seen == k).sum()) for k in (1, 2, 3, 4)]))
    # Every known word and the unknown one have equal parts of what is left.
    one = np.full(len(kinds), float(weight[0]) / (len(words) + 1))
    one[kinds > 0] += share
    one[START] = 0.0

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        a, b, n, c = (t[x].to_numpy().astype(np.int64) for x in "abnc")
        held = zstandard.ZstdCompressor(level=3).compress(pickle.dumps(Shard(a, b, n, c, d2, d3)))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "held": pa.array([held], pa.binary())})

    shards = tri.withColumn("shard", F.pmod("b", F.lit(SHARDS)).cast("int")).groupBy("shard").applyInArrow(pack, "shard int, held binary")
    return Model(words, one, cut(shards, "kn-shards"))


def scores(docs: DataFrame, model: Model | None, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, lang, h, n_tokens, log10_prob) of every row; ``h`` is a hash of the text. Without a model all have probability 1."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"), "text")
    if model is None:
        return slim.select("doc_id", "lang", "h", F.size(words(F.col("text"))).cast("long").alias("n_tokens"), F.lit(0.0).alias("log10_prob"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-int(size) // group_bytes))
    shared = spark.sparkContext.broadcast((model.words, model.one))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value[0], FIRST)}
        one, pack = shared.value[1], zstandard.ZstdCompressor(level=3).compress
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def full() -> pa.RecordBatch:
            lengths = np.array([len(x[3]) for x in held])
            n = np.concatenate([x[3] for x in held]).astype(np.int64)
            doc = np.repeat(np.arange(len(held)), lengths)
            first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
            second = np.r_[False, first[:-1]] & ~first
            b = np.where(first, START, np.roll(n, 1))
            a = np.where(first | second, START, np.roll(n, 2))
            # After an unknown word no context is known.
            alone = b == UNKNOWN
            sums = np.bincount(doc[alone], weights=np.log10(one[n[alone]]), minlength=len(held))
            own = {"ids": [x[0] for x in held], "lang": [x[1] for x in held], "h": [x[2] for x in held], "n": lengths, "sums": sums.astype(float)}
            group = (block * 0x9E3779B97F4A7C15 >> 16) % groups
            out = [(group, block % SHARDS, block, True, pickle.dumps(own))]
            a, b, n, doc = a[~alone], b[~alone], n[~alone], doc[~alone]
            shard = b % SHARDS
            order = np.lexsort((n, a, b, shard))
            cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            for k in range(SHARDS):
                at = order[cuts[k] : cuts[k + 1]]
                if len(at):
                    # Sorted pairs as gaps, and bytes of one weight together: most high bytes are 0.
                    gaps = np.diff(b[at] << 32 | a[at], prepend=0)
                    planes = [_planes(x) for x in (gaps, n[at].astype(np.uint32), doc[at].astype(np.uint32))]
                    out.append((group, k, block, False, pack(pickle.dumps(planes))))
            return _batch(out)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)
                for i, lang, h, text in rows:
                    held.append((i, lang, h, np.array([number.get(w, UNKNOWN) for w in _tokens(text)], np.uint32)))
                    size += len(text or "") + 8
                    if size >= block_bytes:
                        yield full()
                        block, held, size = block + 1, [], 0
        if held:
            yield full()

    def meet(key: tuple, sent: pa.Table, held: pa.Table) -> pa.Table:
        """A group's blocks in one shard: passes their own rows on, and sums the logs of the others by document."""
        out, unpack, one = [], zstandard.ZstdDecompressor().decompress, shared.value[1]
        counts = pickle.loads(unpack(held["held"][0].as_py())) if held.num_rows else None
        for row in sent.to_pylist():
            if row["own"]:
                out.append((0, -1, row["block"], True, row["data"]))
                continue
            planes = pickle.loads(unpack(row["data"]))
            pairs = np.cumsum(_joined(planes[0], np.int64))
            n, doc = (_joined(x, np.uint32).astype(np.int64) for x in planes[1:])
            p = counts.probability(pairs & 0xFFFFFFFF, pairs >> 32, n, one) if counts else one[n]
            sums = np.bincount(doc, weights=np.log10(p))
            some = np.flatnonzero(sums)
            out.append((0, key[1].as_py(), row["block"], False, pickle.dumps((some.astype(np.uint32), sums[some]))))
        return pa.Table.from_batches([_batch(out)])

    def finish(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["shard"])
        own = pickle.loads(next(r["data"] for r in rows if r["own"]))
        sums = own["sums"].copy()
        for row in rows:
            if not row["own"]:
                some, x = pickle.loads(row["data"])
                sums[some] += x
        columns = [own["ids"], own["lang"], own["h"], own["n"], sums]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table({name: pa.array(c, k) for name, c, k in zip(("doc_id", "lang", "h", "n_tokens", "log10_prob"), columns, kinds, strict=True)})

    copies = model.shards.select("shard", "held", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    sent = slim.mapInArrow(send, _SCHEMA)
    met = sent.groupBy("group", "shard").cogroup(copies.groupBy("group", "shard")).applyInArrow(meet, _SCHEMA)
    return met.groupBy("block").applyInArrow(finish, "doc_id long, lang string, h long, n_tokens long, log10_prob double")


_NAMES, _KINDS = ["group", "shard", "block", "own", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
_SCHEMA = "group int, shard int, block long, own boolean, data binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _joined(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _shrunk(nats: Column, n: Column, scale: Column) -> Column:
    """A document's log-perplexity a token, weighed with ``scale.tokens`` tokens of its language's mean.

    In units of a document of the language's usual length, which has its own: of shorter ones less is
    known, so they are closer to the mean, of longer ones more.
    """
    mean, usual, tokens = scale["mean"], scale["usual"], scale["tokens"]
    return mean + (nats - n * mean) * (tokens + usual) / (usual * (n + tokens))


def _scale() -> Column:
    """(mean, usual, tokens) of a group of held-out documents.

    The squared distance of a document's mean from the group's is, of n tokens, on average
    ``between + within / n``: a line over 1 / n, fitted by least squares. ``within / between`` is how many
    tokens say as much of a document as that it is one of its group. Where all that documents differ by is
    what so many tokens differ by, ``between`` is nothing and only a document's whole surprise counts.
    """
    x, u, n = F.col("nats") / F.col("n_tokens"), 1 / F.col("n_tokens"), F.count(F.lit(1))
    mean = F.sum("nats") / F.sum("n_tokens")
    away = F.avg(x * x) - 2 * mean * F.avg(x) + mean * mean
    away_u = F.avg(x * x * u) - 2 * mean * F.avg(x * u) + mean * mean * F.avg(u)
    spread = F.avg(u * u) - F.avg(u) * F.avg(u)
    within = F.when(spread > 1e-12, (away_u - away * F.avg(u)) / spread)
    between = F.greatest(F.coalesce(away - within * F.avg(u), F.lit(0.0)), away * 1e-6)
    within = F.when(between > away * 1e-6, within).otherwise(away / F.avg(u))
    tokens = F.when(between > 0, F.greatest(within / between, F.lit(float(SHRINK)))).otherwise(float(SHRINK))
    return F.struct(mean.alias("mean"), F.avg("n_tokens").alias("usual"), tokens.alias("tokens"), n.alias("n")).alias("scale")


def limits(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, scale, threshold) of the held-out trusted documents; the row with null ``lang`` is of all languages.

    The quantile is read off counts in bins of 0.01, so partial sums of a few numbers are all that
    moves, however many documents there are. No row without a held-out document that has a word.
    """
    held = _trusted(labels).where("held_out").select("doc_id")
    # Both scales, the language's own and that of all, come from one short table.
    held = cut(scored.where("n_tokens > 0").join(held, "doc_id", "left_semi").select("lang", "nats", "n_tokens"), "kn-held-out")
    sides = held.where("lang is not null").union(held.select(F.lit(None).cast("string"), "nats", "n_tokens"))
    scales = sides.groupBy("lang").agg(_scale())
    scales = scales.where((F.col("scale.n") >= ENOUGH) | F.col("lang").isNull()).withColumnRenamed("lang", "of")
    value = _shrunk(F.col("nats"), F.col("n_tokens"), F.col("scale"))
    bins = sides.join(scales, F.col("lang").eqNullSafe(F.col("of"))).groupBy("lang", "scale", F.floor(value / BIN).alias("bin")).count()
    upto = Window.partitionBy("lang").orderBy("bin")
    placed = bins.withColumn("upto", F.sum("count").over(upto)).where(F.col("upto") >= QUANTILE * F.col("scale.n"))
    return placed.groupBy("lang", "scale").agg(((F.min("bin") + 1) * BIN).alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, lang, h, n_tokens, log10_prob, perplexity, threshold, kept for every row of ``docs``.

    ``perplexity`` is shrunk towards the language's, by as many tokens as the held-out documents' spread
    at their own lengths asks for, so a null or empty text has the language's own and is kept. A null language, or one with few held-out trusted documents,
    takes mean and threshold of all. Where no document is held out or none is fitted on, all are kept
    and ``threshold`` is null. Repeated rows come back as often; a null id is never trusted; columns
    beside doc_id, text and lang are not read.
    """
    model = fit(docs, sample(docs, labels, max_docs, max_bytes))
    scored = cut(scores(docs, model), "kn-scores")
    scored = scored.withColumn("nats", -F.col("log10_prob") * float(np.log(10)))
    # A row a language: read back, its size is known, and Spark broadcasts it.
    found = cut(limits(scored, labels).coalesce(1), "kn-limits")
    every = found.where("lang is null").agg(F.max("scale").alias("s"), F.max("threshold").alias("t")).first()
    out = scored.join(found.where("lang is not null"), "lang", "left")
    of_all = F.struct(*[F.lit(every["s"] and every["s"][c]).cast("double").alias(c) for c in ("mean", "usual", "tokens")])
    scale = F.when(F.col("scale").isNotNull(), F.struct(*[F.col("scale")[c].alias(c) for c in ("mean", "usual", "tokens")])).otherwise(of_all)
    threshold = F.coalesce("threshold", F.lit(every["t"]).cast("double"))
    value = _shrunk(F.col("nats"), F.col("n_tokens"), scale)
    known = F.lit(model is not None) & threshold.isNotNull()
    return out.select(
        "doc_id", "lang", "h", "n_tokens", "log10_prob", F.exp(value).alias("perplexity"), F.exp(threshold).alias("threshold"),
        (~known | (F.floor(value / BIN) * BIN < threshold)).alias("kept"),
    )


def keep(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns: all but those with a rejected row's id, text hash and language."""
    gone = judge(docs, labels, **bounds).where("not kept").select(F.col("doc_id").alias("i"), F.col("h").alias("x"), F.col("lang").alias("l")).distinct()
    gone = cut(gone, "kn-rejected")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("x")) & F.col("lang").cast("string").eqNullSafe(F.col("l"))
    # The list grows with the corpus: never broadcast.
    return docs.join(gone.hint("merge"), same, "left_anti")
