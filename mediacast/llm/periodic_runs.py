"""Periodic run detection by an all-lag vectorised scan (operator 12).

Words are numbers, and for every lag from 1 to the words over the least exponent a text's array is
compared with itself shifted by the lag; stretches of equality, run-length coded, are the runs with
that period. Texts share scans: their words are numbered apart, so that no two texts' words are ever
equal, sorted by length, and a lag compares only the texts long enough for it.

The work of a text grows with the square of its words. Texts of ``LONG_BYTES`` or more are cut into
ranges of lags of about equal work, which Spark deals over all tasks; the runs found come back to
the text by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: A run repeats its period at least so often, and is at least so long.
MIN_EXP = 4
MIN_LENGTH = 6
#: Words that are scanned together; more than a text has in most cases, and few enough for a processor's cache.
SCAN_WORDS = 60_000
#: Texts of so many bytes are scanned by ranges of lags.
LONG_BYTES = 50_000
#: Comparisons of a range of lags.
RANGE_WORK = 50_000_000
SPACE = b" "


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the maximal stretches of at least ``least`` true values.

    ``held[i]`` says that values i to i + have - 1 are all true; doubling ``have`` reaches ``least`` in
    few passes over bytes, most of which end early.
    """
    none = np.zeros(0, np.int64)
    if len(equal) < least:
        return none, none
    held, have = equal, 1
    while have < least:
        step = min(have, least - have)
        held = held[:-step] & held[step:]
        have += step
        if not held.any():
            return none, none
    at = np.flatnonzero(held)
    if not len(at):
        return none, none
    first = np.r_[True, np.diff(at) > 1]
    starts, ends = at[first], at[np.r_[first[1:], True]] + least
    return starts, ends - starts


def scan(ids: np.ndarray, lengths: np.ndarray, lags: range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the stretches with that period in texts laid end to end, longest first.

    No two texts may share a number. A stretch that has a smaller period too is found under both.
    """
    starts, sizes, periods = [], [], []
    ends = np.cumsum(lengths)
    most = int(lengths[0]) // MIN_EXP if len(lengths) and lengths[0] >= MIN_LENGTH else 0
    for lag in range(1, most + 1) if lags is None else lags:
        if lag > most:
            break
        # Texts that can hold a run of this period come first.
        need = max(MIN_LENGTH, MIN_EXP * lag)
        upto = int(ends[np.searchsorted(-lengths, -need, side="right") - 1])
        x = ids[:upto]
        at, n = stretches(x[lag:] == x[:-lag], need - lag)
        if len(at):
            starts.append(at)
            sizes.append(n + lag)
            periods.append(np.full(len(at), lag, np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, periods))


def smallest(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs by start, then period, each stretch with its smallest period only.

    A stretch with periods p < q, at least four times q long, has their greatest common divisor as a
    period too, and is maximal for both or for neither: one start and length, one run.
    """
    least: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted(((s, n, p) for (s, n), p in least.items()), key=lambda r: (r[0], r[2]))


def described(words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    """The result for one text: its runs, the greatest of them, and the text without repeats."""
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    gone = np.cumsum(dropped) > 0
    return {
        "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs],
        "runs_sha256": hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        "collapsed": SPACE.join(w for w, g in zip(words, gone.tolist(), strict=False) if not g) if runs else SPACE.join(words),
    }


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
     ("runs", pa.list_(RUN)), ("runs_sha256", pa.string()), ("collapsed", pa.string())]
)
DDL = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed string"
)


class _Numbers(dict):
    def __init__(self, first: int = 0):
        self.first = first

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.first + len(self)
        return n


def _scanned(docs: list[tuple[int | None, list[bytes]]]) -> list[dict]:
    """Results of texts, scanned together in groups of ``SCAN_WORDS``."""
    docs = sorted(docs, key=lambda d: -len(d[1]))
    out, at = [], 0
    while at < len(docs):
        group, size = [], 0
        while at < len(docs) and (not group or size + len(docs[at][1]) <= SCAN_WORDS):
            group.append(docs[at])
            size += len(docs[at][1])
            at += 1
        lengths = np.array([len(words) for _, words in group], np.int64)
        ids, first = np.empty(size, np.uint16 if size < 1 << 16 else np.uint32), 0
        for (_, words), start in zip(group, (np.cumsum(lengths) - lengths).tolist(), strict=True):
            numbers = _Numbers(first)
            ids[start : start + len(words)] = [numbers[w] for w in words]
            first += len(numbers)
        starts, sizes, periods = scan(ids, lengths)
        bounds = np.cumsum(lengths) - lengths
        of = np.searchsorted(bounds, starts, side="right") - 1
        by_doc: dict[int, list] = {}
        for d, s, n, p in zip(of.tolist(), (starts - bounds[of]).tolist(), sizes.tolist(), periods.tolist(), strict=True):
            by_doc.setdefault(d, []).append((s, n, p))
        out += [{"doc_id": key, **described(words, smallest(by_doc.get(d, [])))} for d, (key, words) in enumerate(group)]
    return out


def _short(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.append((key, (text or b"").split()))
                    size += len(text or b"") + 64
                    if size > 16 * SCAN_WORDS:
                        yield pa.RecordBatch.from_pylist(_scanned(held), FIELDS)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(_scanned(held), FIELDS)

    return docs.select("key", F.col("text").cast("binary")).mapInArrow(run, DDL)


def _long(docs: DataFrame) -> DataFrame:
    """The same by ranges of lags."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row, key, text = (batch.column(c)[at].as_py() for c in range(3))
                numbers = _Numbers()
                ids = np.array([numbers[w] for w in text.split()], np.uint32)
                # Lag q compares n - q words: ranges of equal work grow in lags as lags grow.
                lags = np.arange(1, len(ids) // MIN_EXP + 1)
                work = np.cumsum(len(ids) - lags)
                cuts = np.searchsorted(work, np.arange(0, work[-1] if len(work) else 1, RANGE_WORK), side="left") + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row]), pa.array([key], pa.int64()), pa.array([text]), pa.array([ids.tobytes()]), pa.array([np.r_[cuts, len(lags) + 1]], pa.list_(pa.int64()))],
                    ["row", "key", "text", "ids", "cuts"],
                )

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row, ids, low, high = (batch.column(c)[at].as_py() for c in range(4))
                ids = np.frombuffer(ids, np.uint32)
                starts, sizes, periods = scan(ids, np.array([len(ids)]), range(low, high))
                runs = smallest(zip(starts.tolist(), sizes.tolist(), periods.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row]), pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs]], pa.list_(RUN))], ["row", "runs"]
                )

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                key, text, runs = (batch.column(c)[at].as_py() for c in range(3))
                found = smallest((r["start"], r["length"], r["period"]) for part in runs or [] for r in part)
                yield pa.RecordBatch.from_pylist([{"doc_id": key, **described(text.split(), found)}], FIELDS)

    ready = docs.select(F.monotonically_increasing_id().alias("row"), "key", F.col("text").cast("binary"))
    # Written, so that a row keeps its number whatever task is run again.
    kept = cut(ready.mapInArrow(numbered, "row long, key long, text binary, ids binary, cuts array<long>"), "long-texts")
    ranges = F.explode(F.expr("transform(sequence(0, size(cuts) - 2), i -> struct(cuts[i] as low, cuts[i + 1] as high))"))
    work = kept.select("row", "ids", ranges.alias("r")).select("row", "ids", "r.low", "r.high").where("low < high")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = work.repartition(tasks, "row", "low").mapInArrow(ranged, "row long, runs array<struct<start:long,length:long,period:long>>")
    runs = runs.where(F.size("runs") > 0).groupBy("row").agg(F.collect_list("runs").alias("runs"))
    return kept.select("row", "key", "text").join(runs, "row", "left").select("key", "text", "runs").mapInArrow(ended, DDL)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs, runs_sha256, collapsed): every text's periodic runs.

    A run is a maximal stretch of words with smallest period q, of at least ``MIN_LENGTH`` words and
    ``MIN_EXP`` periods. ``start`` to ``exponent_milli`` are of the run with the greatest exponent (ties: the
    smallest start, then period), null without any; ``collapsed`` is the text without the words that
    a run holds after its first period, one space apart. A null or empty text has no words, so no
    runs and an empty ``collapsed``. Repeated rows and null ids have a row each; other columns are left out.
    """
    ship(docs.sparkSession)
    ready = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.octet_length("text") >= long_bytes
    return _short(ready.where(~long)).union(_long(ready.where(long)))
