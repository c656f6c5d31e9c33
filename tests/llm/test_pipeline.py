"""The pipeline's stages on a small fixture, against brute force where a stage's result follows from the texts alone."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediacast.llm import byte_bpe, html_text, packing, quality_rules, suffix_tree, topk, url_filters

LABELS = "doc_id long, quality int, toxic int"
WORDS = "river stone garden letter winter summer window market teacher village morning evening bridge forest island".split()


def sentences(n):
    return " ".join(" ".join(random.choices(WORDS, k=9)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(3)
    folder = str(tmp_path_factory.mktemp("corpus"))
    good = [sentences(8) for _ in range(160)]
    near = [g.replace(g.split()[30], "changed", 1) for g in good[:30]]
    junk = [" ".join(f"zq{random.randint(0, 999)}" for _ in range(70)) for _ in range(40)]
    texts = [*good, *good[:20], *near, *junk, None, "", "too short", "same words again and again " * 40]
    rows = [(i, t, ["en", "fr", None][i % 3], "web", len(t or ""), str(i)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 160, 2)] + [(210 + i, 0, 0) for i in range(20)], LABELS).write.parquet(f"{folder}/labels.parquet")
    return folder, texts


def test_stages(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, folder), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert all(texts[i] == t for i, t in kept[name].items())
    rules, classifier, unique = (kept[name] for name, _ in corpus_pipeline.STAGES[:-1])
    assert not {250, 251, 252, 253} & {*rules} and len({*range(160)} & {*rules}) >= 150
    assert set(classifier) <= set(rules) and not set(range(210, 250)) & set(classifier) and len({*range(160)} & {*classifier}) >= 140
    # One of each group of near copies, by brute force: the least id of its component stays.
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, re.findall(r"[^ ]+", t.lower())) for i, t in classifier.items())}
    root = {i: i for i in shingles}
    for i in shingles:
        for j in shingles:
            both = len(shingles[i] & shingles[j]) if i < j else 0
            if both and 10 * both >= 8 * len(shingles[i] | shingles[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert set(unique) == set(root.values())
    # All tokens of what is left, in sequences without gaps.
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    encoder = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in unique.items():
        mine = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in mine) == encoder.encode(text) + bytes(4)
    for s in {r.sequence_id for r in pieces}:
        at = 0
        for r in sorted((r for r in pieces if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_run_equals_the_stages(spark, corpus):
    folder, _ = corpus
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 100 and {"doc_id", "piece", "ids", "sequence_id", "offset"} <= set(rows.columns)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, rule string, score string")
    labels = spark.createDataFrame([], LABELS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.encode(docs, path, public_tokenizers.PATTERN).count() == 0
    assert quality_rules.judge(docs, labels).count() == 0 and quality_rules.keep(docs, labels).columns == docs.columns
    assert url_filters.judge(pages, labels, [("allow", "com/")]).count() == 0
    assert html_text.extract_pages(pages).count() == 0 and suffix_tree.score(docs.select("doc_id", "text")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, score long, rank int")
    assert topk.search(vectors, vectors).count() == 0


def test_repeats_and_clashing_names(spark):
    text = sentences(3)
    docs = spark.createDataFrame([(1, text, "a", 5), (1, text, "b", 6), (None, None, "c", 7)], "doc_id long, text string, n_words string, ids int")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN).collect()
    assert len(coded) == 3 and len({bytes(r.ids) for r in coded if r.doc_id == 1}) == 1
    scored = suffix_tree.score(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in scored) == [(0, 1), (1, 28), (1, 28)]
    judged = quality_rules.judge(docs, spark.createDataFrame([(1, 1, 0)], LABELS)).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in judged) == [(0, 0), (1, 27), (1, 27)]


def test_ties_fill_bins_alike():
    packer = packing.Packer(10, 4)
    closed = [b for piece, n in [("a", 6), ("b", 6), ("c", 4), ("d", 4), ("e", 10), ("f", 5), ("g", 5)] for b in packer.add(piece, n)] + packer.finish()
    assert sorted(p for b in closed for p, _ in b) == list("abcdefg") and all(sum(n for _, n in b) == 10 for b in closed) and len(closed) == 4


def test_listed_rules_against_brute_force(spark):
    random.seed(12)
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    hosts = ["example.com", "www.example.com", "WWW.Example.com", "badexample.com", "a.net", "net", "com", "x.org", ""]
    urls = [f"{random.choice(['http', 'https', ''])}{random.choice(['://', '://', ':/'])}{random.choice(hosts)}{random.choice(['', '/', '/en/', '/en', '/es/x', '/fr/?q=1', '?a=/en/', '#x'])}" for _ in range(300)]
    pages = spark.createDataFrame([*enumerate(urls), (300, None)], "page_id long, url string")
    found = {r.page_id: r for r in url_filters.judge(pages, spark.createDataFrame([], LABELS), rules).collect()}
    for i, url in [*enumerate(urls), (300, None)]:
        host = path = ""
        if url and "://" in url:
            host, rest = re.match(r"([^/?#]*)(.*)", url.split("://", 1)[1]).groups()
            path = re.match(r"[^?#]*", rest)[0]
            host = host.lower()
        fits = []
        for verdict, rule in rules:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, verdict))
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict) == (host, path, rule, verdict), url


def test_mined_rules_decide(spark):
    """Labels that follow from a token are learnt, and block other urls that have it."""
    urls = [f"http://s{i % 7}.org/{'casino' if i % 3 == 0 else 'news'}/p{i}" for i in range(300)]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(200)], LABELS)
    found = url_filters.judge(pages, labels, []).withColumn("want", F.when(F.col("url").contains("casino"), "block").otherwise("allow"))
    assert found.where("verdict <> want").count() == 0 and found.where("mined is not null").count() == 100
