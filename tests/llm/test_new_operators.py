"""Lexical search, periodic runs and nearest neighbours against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediacast.llm import descent, lexical, periodic_runs, queries, url_filters

DOCS = "doc_id long, text string, lang string, score string, rank string, key string"
ITEMS = "item_id long, text string, score string"
VECS = "vec_id long, embedding array<float>, score string, node string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "a", "b", "c") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def ranked(texts, items, k=20):
    terms = [TERM.findall((t or "").translate(LOWER)) for t in texts]
    n_all, l_all = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for d in terms for t in set(d))
    out = []
    for item, text in items:
        asked, scores = TERM.findall((text or "").translate(LOWER)), []
        for i, d in enumerate(terms):
            tf, m = Counter(d), d and 100 - 25 + (25 * len(d) * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in asked if tf[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    words = ["the", "of", "Straße", "ÉTÉ", "naïve", "x1", "y-2", "z_3", "\x7f", "日本語"] + [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(words[: rng.randint(5, 50)]) for _ in range(n))
    return [say(rng.randint(1, 60)) for _ in range(120)] + ["the the the"] * 30 + [None, "", " .,; ", "THE " * 5000 + "w7"]


def test_lexical(spark, prose):
    items = [(i, t) for i, t in enumerate(prose[:25])] + [(90, "nothing-here zzz"), (91, None), (92, ""), (93, "the"), (94, "w7 w7 the")]
    asked = spark.createDataFrame([(i, t, "s") for i, t in items] + [(93, "of", "smaller"), (None, "the", "asks nothing")], ITEMS)
    for group_bytes in (1000, 1 << 20):
        rows = lexical.search(docs_of(spark, prose).repartition(5), asked, group_bytes=group_bytes).collect()
        assert sorted(tuple(r) for r in rows) == ranked(prose, items)


def test_lexical_edges(spark, prose):
    items = spark.createDataFrame([(1, "the", "s")], ITEMS)
    assert lexical.search(docs_of(spark, []), items).count() == 0
    assert lexical.search(docs_of(spark, [None, ""]), items).count() == 0
    assert lexical.search(docs_of(spark, prose), items.limit(0)).count() == 0
    rows = lexical.search(docs_of(spark, ["the", "the", "the"], [None, 5, 5]), items).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [5, 5, None]


def test_radix_order():
    rng = np.random.default_rng(1)
    for high in (1, 9, 1 << 16, 1 << 40, 1 << 63):
        keys = rng.integers(0, high, 500, dtype=np.uint64)
        assert np.array_equal(lexical.radix_order(keys), np.argsort(keys, kind="stable"))


def runs_of(w):
    """Every maximal stretch by its definition: for each start, end and smallest period."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_periodic_runs(spark):
    rng = random.Random(7)
    texts = [None, "", " \t ", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b c " * 3 + "a b", "a b c " * 4 + "\x0b a\x0cb", ("x " * 6 + "y ") * 5]
    texts += [" ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randint(1, 90))) for i in range(60)]
    for p in (1, 3, 7, 50):
        texts.append(" ".join(["s%d" % rng.randint(0, 9) for _ in range(30)] + [f"é{i % p}" for i in range(5 * p + 3)] + ["end"]))
    texts.append(" ".join(str(i % 997) for i in range(6000)))
    for long_bytes in (200, 1 << 30):
        got = {r.doc_id: r for r in periodic_runs.detect(docs_of(spark, texts), long_bytes=long_bytes).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            found, r = runs_of(w), got[i]
            best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
            gone = {j for s, n, q in found for j in range(s + q, s + n)}
            assert [tuple(x) for x in r.runs] == found and r.n_runs == len(found)
            assert (r.start, r.length, r.period) == (best or (None,) * 3)
            assert r.exponent_milli == (best and 1000 * best[1] // best[2])
            assert r.collapsed == " ".join(x for j, x in enumerate(w) if j not in gone)
            assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()


def test_periodic_edges(spark):
    assert periodic_runs.detect(docs_of(spark, [])).count() == 0
    rows = periodic_runs.detect(docs_of(spark, ["a " * 9, "a " * 9, None], [4, 4, None])).collect()
    assert sorted((str(r.doc_id), r.n_runs, r.collapsed) for r in rows) == [("4", 1, "a"), ("4", 1, "a"), ("None", 0, "")]


def test_planted_repeats(spark):
    texts = [" ".join(f"w{j}" for j in range(n)) for n in range(0, 200)] + [None]
    ids = [*range(len(texts) - 1), 1000]
    got = {r.doc_id: r.text for r in queries.with_repeats(docs_of(spark, texts, ids)).collect()}
    changed = 0
    for i, t in zip(ids, texts, strict=True):
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (j - a) % p] if j >= a else w[j] for j in range(n)]
            changed += 1
        assert (got[i] or "").split() == w
    assert changed > 5


def nearest(ids, x, k=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = x @ x[i]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_descent_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    x = np.vstack([centres[rng.integers(0, 12, 1500)] + 0.2 * rng.standard_normal((1500, 16)), rng.standard_normal((1500, 16)) * rng.uniform(0.2, 3, (1500, 1))]).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist(), "s", "n") for i, v in enumerate(x)], VECS)
    rows = descent.search(vectors, vectors.where(F.col("vec_id") % 20 == 0)).collect()
    want, got = nearest(np.arange(len(x)), x.astype(np.float64)), {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(x[r.query_id].astype(np.float64) @ x[r.vec_id].astype(np.float64))) < 1e-9
    assert got.keys() == want.keys()
    assert sum(len(set(want[q]) & set(got[q])) for q in want) / sum(map(len, want.values())) >= 0.95
    # Queries that are no rows of the table begin elsewhere.
    others = spark.createDataFrame([(10_000 + i, (v + 0.01).tolist(), "s", "n") for i, v in enumerate(x[:40])], VECS)
    rows = descent.search(vectors, others).collect()
    s = (x[:40] + np.float32(0.01)).astype(np.float64) @ x.T.astype(np.float64)
    hits = sum(r.vec_id in set(np.argsort(-s[r.query_id - 10_000])[:20].tolist()) for r in rows)
    assert len(rows) == 800 and hits >= 0.9 * 800


def test_descent_edges(spark):
    make = lambda rows: spark.createDataFrame([(i, v, "s", "n") for i, v in rows], VECS)
    assert descent.search(make([]), make([])).count() == 0
    bad = [(20, None), (40, [float("nan"), 1.0]), (60, [0.0, 0.0]), (80, [None, 1.0]), (100, [float("inf"), 1.0]), (120, [])]
    assert descent.search(make(bad), make(bad)).count() == 0
    one = make([(0, [1.0, 2.0])])
    assert descent.search(one, one).count() == 0
    # Many copies of a vector, of which the least ids are the nearest; other lengths; a row twice; no id.
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.5, float(i)]) for i in range(5)] + [(200, [1.0, 1.0, 1.0]), (201, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (None, [2.0, 0.0])] + bad
    got = descent.search(make(rows), make(rows).where("vec_id % 20 = 0")).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert by.keys() == {0, 20, 40, 100, 200}
    assert by[0] == [None, *range(1, 20)] and by[20] == [None, *range(19)]
    assert by[200] == [201]
    assert by[100] == [None, *range(19)]


LABELS = "doc_id long, quality int, toxic int"


def url_tokens(url):
    rest = url.partition("://")[2]
    host, _, path = rest.partition("/")
    return frozenset(["h:" + x for x in host.lower().split(".") if x] + ["p:" + x for x in path.split("/") if x])


def mined_blocks(urls, bad, labelled, confidence, least):
    """Every combination of tokens, its support and confidence; what the sure ones block."""
    sets = [url_tokens(u) for u in urls]
    counts, bads = Counter(), Counter()
    for i in labelled:
        for k in range(1, len(sets[i]) + 1):
            for c in itertools.combinations(sorted(sets[i]), k):
                counts[c] += 1
                bads[c] += bad[i]
    sure = [frozenset(c) for c, n in counts.items() if bads[c] >= least and bads[c] / n >= confidence]
    return {i for i, s in enumerate(sets) if any(c <= s for c in sure)}


def test_mined_rules_against_all_combinations(spark):
    rng = random.Random(12)
    urls, bad = [], []
    for i in range(400):
        host, path = rng.choice(["a.org", "b.org", "c.net"]), [rng.choice("uvwxyz") for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.3:
            path += ["win", "now", rng.choice(["big", "small"])]
        urls.append(f"http://{host}/{'/'.join(path)}")
        bad.append(int(("win" in path and rng.random() < 0.9) or (host == "c.net" and "u" in path and rng.random() < 0.95)))
    urls += ["http://z.org/now", "http://z.org/win/q", "http://c.net/u/q", "http://a.org/u"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - bad[i], 0) for i in range(300)], LABELS)
    for confidence, count in ((0.8, 10), (0.95, 5)):
        got = url_filters.judge(pages, labels, [], min_confidence=confidence, min_count=count, min_support=0.0).collect()
        want = mined_blocks(urls, bad, range(300), confidence, count)
        assert {r.page_id for r in got if r.verdict == "block"} == want and want


@pytest.mark.parametrize("segments", [16, 40])
def test_a_long_url_that_is_repeated(spark, segments):
    """All tokens that only this url has are one item, so its length doesn't matter."""
    long = "http://www.bad.org/" + "/".join(f"s{k}" for k in range(segments))
    urls = [long] * 20 + [f"http://www.good.org/{i % 7}" for i in range(80)] + ["http://x.net/s3", "http://x.net/t"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 20), 0) for i in range(100)], LABELS)
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, labels, []).collect()}
    assert all((got[i] == "block") == (i < 20 or i == 100) for i in range(102))
