"""Quality rules: counting rules, then a hashed n-gram likelihood ratio (operator 10).

Every document gets its word and line counts, then the mean log-likelihood ratio of its hashed
unigrams and bigrams between two multinomials: one of trusted documents, one of the whole corpus.
All of it is DataFrame expressions over each row's own arrays. The only aggregate has
``2 ** bits`` groups, so nothing grows with the corpus but the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, free_name, let, words

SYMBOLS = "#*$%&|<>"
BITS = 16
#: Trusted documents that the target multinomial is fitted on, at most.
MAX_TRUSTED = 20_000
#: Mean log ratio, in nats an n-gram, under which a document is rejected.
THRESHOLD = -0.1
ALPHA = 0.5
#: Counts of the corpus' distribution that the target's starts from, a bucket: few trusted documents move it little.
PRIOR = 16
WINDOW = 8


def _repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that occur twice or more, by sorting window hashes."""

    def positions(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return let(
            F.sort_array(pairs),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                (
                                    F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                                    | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    # Most documents repeat nothing: array_distinct tells so without the sort.
    return let(
        hashes,
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(positions(hs), covered)),
    )


def _joined(hashes: Column, step: int) -> Column:
    """The hash of each element with the one ``step`` places on: spans of twice the words."""
    at = F.sequence(F.lit(0), F.size(hashes) - (step + 1))
    return F.when(F.size(hashes) > step, F.transform(at, lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + step)))).otherwise(
        F.array().cast("array<bigint>")
    )


def hashed_spans(docs: DataFrame, w: str, upto: int) -> tuple[DataFrame, dict[int, str]]:
    """Adds the 64-bit hashes of the 1-word, 2-word, 4-word ... spans of array ``w``; their column names by length."""
    names = {1: free_name(docs, "h1")}
    docs = docs.withColumn(names[1], F.transform(w, lambda x: F.xxhash64(x)))
    n = 1
    while n < upto:
        names[2 * n] = free_name(docs, f"h{2 * n}")
        docs = docs.withColumn(names[2 * n], _joined(F.col(names[n]), n))
        n *= 2
    return docs, names


def rule_columns(text: Column, w: Column, spans: Column) -> dict[str, Column]:
    """The counts; ``w`` is the array of the text's words, ``spans`` that of its 8-word windows' hashes."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    symbols = [F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit(c), F.lit(""))) for c in SYMBOLS]
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": sum(symbols[1:], symbols[0]).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": _repeated_words(spans),
    }


def trusted_ids(labels: DataFrame, at_most: int = MAX_TRUSTED) -> DataFrame:
    """Ids labelled good and not toxic by every row, at most ``at_most`` of them by least hash."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = good.where((F.col("q") == 1) & (F.coalesce(F.col("t"), F.lit(0)) == 0))
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most).select("doc_id")


def fit(docs: DataFrame, trusted: DataFrame, bits: int = BITS, alpha: float = ALPHA) -> DataFrame:
    """One row, ``ratios``: each bucket's log ratio in millionths, an array of ``2 ** bits`` numbers.

    The raw counts are over every document. ``trusted`` is bounded by its caller and broadcast.
    """
    size = 1 << bits
    marked = docs.select("doc_id", words(F.col("text")).alias("w")).join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left"
    )
    marked, h = hashed_spans(marked, "w", 2)
    seen = marked.select("good", F.explode(F.concat(h[1], h[2])).alias("h"))
    seen = seen.withColumn("bucket", F.col("h").bitwiseAND(F.lit(size - 1)).cast("int"))
    seen = seen.select("bucket", F.lit(1).cast("long").alias("raw"), F.coalesce("good", F.lit(0)).cast("long").alias("target"))
    # Every bucket gets a row, seen or not, so that it is its own index in the sorted array.
    none = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    row = (
        seen.union(none)
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .agg(
            F.sum("raw").alias("n_raw"),
            F.sum("target").alias("n_target"),
            F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("cells"),
        )
    )
    prior = float(PRIOR * size)

    def ratio(x: Column) -> Column:
        raw = (x["raw"] + alpha) / (F.col("n_raw") + alpha * size)
        return F.log((x["target"] + prior * raw) / ((F.col("n_target") + prior) * raw))

    return row.select(F.transform("cells", lambda x: F.round(ratio(x) * 1e6).cast("long")).alias("ratios"))


def judge(docs: DataFrame, labels: DataFrame, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score, kept`` in place of columns of those names; every row comes back.

    Null or empty text: no words, so ``base_failed``. Without trusted documents every ratio is
    about that of the smoothing alone and ``score`` is 0 for all, so that only the base rules
    decide. Null ids get counts and a score like any other. Rows may repeat; each is judged alone.
    The score is a sum of whole millionths over the number of n-grams: the same in any order.
    """
    trusted = cut(trusted_ids(labels), "trusted")
    ratios = cut(fit(docs, trusted, bits), "ratios")
    w, r = free_name(docs, "w"), free_name(docs, "ratios")
    out, h = hashed_spans(docs.withColumns({w: words(F.col("text")), r: ratios.scalar()}), w, WINDOW)
    mask = F.lit((1 << bits) - 1)
    add = lambda acc, x: acc + F.get(F.col(r), x.bitwiseAND(mask).cast("int"))
    total = F.aggregate(h[1], F.lit(0).cast("long"), add) + F.aggregate(h[2], F.lit(0).cast("long"), add)
    known = F.lit(not trusted.isEmpty())
    n = F.greatest(F.size(w) * 2 - 1, F.lit(1))
    found = rule_columns(F.col("text"), F.col(w), F.col(h[WINDOW])) | {"score": F.when(known, total / 1e6 / n).otherwise(F.lit(0.0))}
    own = [F.col(c) for c in docs.columns if c not in (*found, "base_failed", "kept")]
    # inline() of one row is a barrier: a filter on the results isn't pushed into the arrays' expressions.
    out = out.select(*own, F.inline(F.array(F.struct(*[c.alias(k) for k, c in found.items()]))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their own columns, whatever those are called."""
    own = [(c, f"own_{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    safe = docs.select("doc_id", "text", *[docs[c].alias(a) for c, a in own])
    kept = judge(safe, labels, **how).where("kept").select("doc_id", "text", *[F.col(a).alias(c) for c, a in own])
    return kept.select(*docs.columns)
