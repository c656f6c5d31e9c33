"""The queries of this subpackage, as ``__spark_entry__`` registers them: (spark, sf_dir) -> rows."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, descent, html_text, jaccard_join, kneser_ney, lexical, packing, periodic_runs, quality_rules, suffix_tree, topk, url_filters, warc,
)
from .common import later_gone, let, shared_dir, table, words

#: The rule list of op2: (verdict, host/path).
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return kneser_ney.judge(docs, table(spark, sf_dir, "labels")).drop("h")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    later_gone(spark, path)
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.fields(F.col("header"))
    return warc.read(spark, path).select(
        found["page_id"].alias("page_id"), "payload_bytes", "payload_digest",
        found["record_type"].alias("record_type"), found["refers_to"].alias("refers_to"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats that op12's contract puts into every tenth text by the CRC of its id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def periodic(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda _, i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " ")

    planted = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(""))
    return docs.withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")
    )


def op13_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return descent.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_packing, op2_url_filters, op3_topk, op4_kneser_ney, op5_warc, op6_byte_bpe, op7_html_text, op8_suffix_tree, op9_jaccard_join,
            op10_quality_rules, op11_lexical, op12_periodic_runs, op13_nn_descent,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_lexical": """
            WITH d AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents
            ), i AS (
                SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
            ), asked AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
            whole AS (SELECT count(*) AS n_all, sum(len(t)) AS l_all FROM d WHERE len(t) > 0),
            posting AS (
                SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
                WHERE term IN (SELECT term FROM asked) GROUP BY ALL
            ), weight AS (
                SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
                FROM posting, whole GROUP BY term, n_all
            ), impact AS (
                SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_all) // l_all))) AS s
                FROM posting JOIN weight USING (term), whole
            ), scored AS (
                SELECT item_id, doc_id, CAST(sum(times * s) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, doc_id
            )
            SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0) WHERE r <= 20""",
        "op3_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
                FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(v.c) + 1), lambda i: q.c[i] * v.c[i])) AS BIGINT) AS score
                FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.c) = len(v.c)
            )
            SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20""",
        "op5_warc": f"""
            WITH base AS (
                SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
            ), firsts AS (SELECT d, min(page_id) AS first FROM base WHERE n >= {warc.MIN_BYTES} GROUP BY d)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, base.d AS payload_digest,
                   CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
            FROM base LEFT JOIN firsts ON base.d = firsts.d""",
    }
