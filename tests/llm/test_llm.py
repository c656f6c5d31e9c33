"""The operators against brute force, round trips and edge cases: nulls, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from mediacast.llm import byte_bpe, graph, html_text, jaccard_join, kneser_ney, packing, quality_rules, suffix_tree, topk, url_filters, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, w string, score string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def make(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    say = lambda n: " ".join(random.choice(WORDS) + random.choice(["", "s", "ed", "."]) for _ in range(n))
    base = [say(random.randint(1, 120)) for _ in range(60)]
    near = [b + " " + random.choice(WORDS) for b in base[:20]]
    edited = []
    for b in base[:20]:
        w = b.split()
        w[len(w) // 2] = "ODD"
        edited.append(" ".join(w))
    return [*base, *base[:10], *near, *edited, None, "", " \t\n", "x", "Straße ÉTÉ naïve " * 9, say(3000)]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_jaccard(spark, texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    rows = {r.doc_id: r for r in jaccard_join.components(make(spark, texts), n, num, den, block_bytes=3000, group=3).collect()}
    assert [rows[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert [rows[i].component_id for i in range(len(sets))] == root


def test_jaccard_edges(spark):
    assert jaccard_join.components(make(spark, [])).count() == 0
    got = jaccard_join.components(make(spark, ["a b c", "a b c", "a b c", ""], [7, None, 7, None]), n=3).collect()
    assert sorted((r.n_shingles, r.component_id) for r in got if r.n_shingles) == [(1, 7)] * 3
    assert jaccard_join.one_of_each(make(spark, ["a b c", "a b c", "a b c", "z"], [7, 8, 7, 9]), n=3).count() == 2
    # One id with two texts, copies that differ in case, a row that repeats, a null id, empty texts.
    texts = ["a b c d", "p q r s", "A b c d", "a b c d", "a b c d", "P q r s", None, "", "", "x y z"]
    kept = jaccard_join.one_of_each(make(spark, texts, [5, 5, 5, 5, 6, 7, 8, 9, 9, None]), n=3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").lower()) for r in kept) == [
        (False, 5, "a b c d"), (False, 5, "p q r s"), (False, 8, ""), (False, 9, ""), (False, 9, ""), (True, 0, "x y z"),
    ]


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 40)] + [("900", "901"), ("901", "901"), (None, "5")]
    got = dict(graph.components(spark.createDataFrame(edges, "u string, v string")).collect())
    assert set(got.values()) == {"000", "900"} and len(got) == 43


def test_quality_counts(spark, texts):
    odd = ["a b c d e f g h i " * 5, "x y\nx y\n\n \nx y", "#* $%&|<> z", *texts]
    got = {r.doc_id: r for r in quality_rules.judge(make(spark, odd), spark.createDataFrame([], LABELS)).collect()}
    for i, t in enumerate(odd):
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        hit = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_quality_ratio_separates(spark):
    random.seed(2)
    good = [" ".join(random.choices(WORDS, k=60)) for _ in range(120)]
    bad = [" ".join(f"q{random.randint(0, 300)}%" for _ in range(60)) for _ in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(None, 1, 0)], LABELS)
    kept = {r.doc_id for r in quality_rules.keep(make(spark, good + bad), labels, threshold=-0.001).collect()}
    assert kept == set(range(120))


def test_bpe(spark, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = byte_bpe.encoder(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.vocabulary.ranks, special_tokens={})
    random.seed(1)
    odd = ["".join(random.choice("aeith 's\n1中é😀-") for _ in range(80)) for _ in range(300)]
    rows = byte_bpe.encode(make(spark, [*odd, None, *texts]), path, public_tokenizers.PATTERN).collect()
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), [*odd, None, *texts], strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode()
    p = byte_bpe.Prefixes(enc.vocabulary, b"internat")
    p.append(b"ionalise")
    assert p.ids() == byte_bpe.Prefixes(enc.vocabulary, b"internationalise").ids()
    p.replace(5, 8, b"XY")
    assert p.ids() == byte_bpe.Prefixes(enc.vocabulary, b"interXYionalise").ids()


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(make(spark, texts).coalesce(1), path, width=64, open_bins=4).collect()
    for i, t in enumerate(texts):
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = [x for r in pieces for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in pieces] == [64 * r.piece for r in pieces] and all(r.length == 64 for r in pieces[:-1])
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len({r.sequence_id for r in rows}) <= 1.1 * sum(r.length for r in rows) / 64 + 1
    assert packing.pack(make(spark, []), path).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.1, 8).round(1).tolist()) for i in range(200)]
    rows += [(200, None), (201, [None] * 8), (202, [math.nan] * 8), (203, [0.1] * 3), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(df, df.where("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and i < 200}
    for q in range(0, 200, 20):
        scored = [(-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in [*ints.items(), (10**9, ints[5])] if i != q]
        want = [(k + 1, None if i == 10**9 else i, -s) for k, (s, i) in enumerate(sorted(scored)[:5])]
        assert sorted(got[q]) == want
    assert topk.search(df.where("vec_id < 0"), df.where("vec_id < 0")).count() == 0


def test_topk_stops_early():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-2, 3, (2000, 4)), rng.integers(40, 60, (30, 4))])
    q = np.array([[50, 45, 55, 60]])
    rows, columns, scores = topk.search_block(np.array([-1]), q, np.arange(len(x)), x, 20)
    want = sorted((-(x @ q[0])).tolist())[:20]
    assert sorted((-scores).tolist()) == want


def test_urls(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    urls = ["http://A.Example.com/en/1?x=/", "https://www.example.com/en/2", "http://q.com", "http://q.com/", "http://x.net/es/#y", "nothing", None, "http://spam.org/win/9"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, t string")
    rows = [r for r in url_filters.judge(pages, spark.createDataFrame([], LABELS), rules).orderBy("page_id").collect()]
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/2", "www.example.com/en/", "allow"), ("q.com", "", None, "allow"),
        ("q.com", "/", "com/", "allow"), ("x.net", "/es/", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("spam.org", "/win/9", None, "allow"),
    ]
    many = spark.createDataFrame([(i, f"http://spam{i % 2}.org/{'win' if i % 3 else 'doc'}/{i}") for i in range(120)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 3 else 1, 0) for i in range(100)], LABELS)
    verdicts = {r.page_id: r.verdict for r in url_filters.judge(many, labels, rules).collect()}
    assert all(v == ("block" if i % 3 else "allow") for i, v in verdicts.items())


def test_warc(spark, tmp_path, monkeypatch):
    big = "é<p>" * 60
    rows = [(3, "http://a\r\nX: y", big), (1, None, big), (2, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), date="2024-05-06T07:08:09Z")
    got = warc.read(spark, str(tmp_path / "w")).select("*", *[c.alias(k) for k, c in warc.fields(F.col("header")).items()]).collect()
    by = {r.page_id: r for r in got}
    assert {k: (r.record_type, r.refers_to) for k, r in by.items()} == {
        1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 1),
    }
    ids = set()
    for i, _, html in rows:
        r, payload = by[i], (html or "").encode()
        assert r.payload_digest == hashlib.sha256(payload).hexdigest() and r.payload_bytes == len(payload)
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        # As the standard asks: the mandatory fields, and a block of the stated length before two line ends.
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= {*named} and named["WARC-Date"] == "2024-05-06T07:08:09Z"
        block = rest[: int(named["Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n" and bytes(r.header) == head + b"\r\n\r\n"
        http = block.partition(b"\r\n\r\n")[0]
        assert http.startswith(b"HTTP/1.1 200") and f"Content-Length: {len(payload)}".encode() in http
        assert bytes(r.original) == http + b"\r\n\r\n" + payload
        assert block == (http + b"\r\n\r\n" if r.record_type == "revisit" else bytes(r.original))
        ids.add(named["WARC-Record-ID"])
        if r.record_type == "revisit":
            assert named["WARC-Refers-To"] == dict(x.split(": ", 1) for x in bytes(by[1].header).decode().split("\r\n")[1:] if x)["WARC-Record-ID"]
    assert len(ids) == len(rows)
    monkeypatch.setattr(warc, "SERVED", 2)
    again = pages.union(pages).withColumn("header", F.lit(1)).withColumn("digest", F.lit("x"))
    warc.write(again, str(tmp_path / "x"))
    assert warc.read(spark, str(tmp_path / "x")).count() == 2 * len(rows)
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    (spark.createDataFrame([("0" * 64, bytearray(b"x"), 1)], "digest string, payload binary, copies int").write.parquet(str(tmp_path / "bad" / "payloads")))
    head = spark.createDataFrame([("0" * 64, 0, bytearray(b"h"), bytearray(b"t"), False)], "digest string, copy int, header binary, http binary, revisit boolean")
    head.write.parquet(str(tmp_path / "bad" / "headers"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, str(tmp_path / "bad")).collect()


def test_html():
    page = (
        "<html><head><title>no</title></head><body><nav><a>menu</a></nav><div class='ad box'>buy</div><article><h1>A &amp; B</h1>"
        "<p>One  <b>two</b>\n three.<br>Four<p>Five<aside>side</aside><form>f</form><script>x('</p>')</script><div id=comments><p>nice!</p></div></article><footer>foot</footer>"
    )
    assert html_text.extract(page) == "A & B One two three. Four Five"
    assert [html_text.extract(x) for x in (None, "", "<nav>x</nav>", "<!-- x", "<p")] == [""] * 5
    plain = "<ul><li><a>Home</a><li><a>About</a></ul><div><p>" + "A long sentence, with marks, and more. " * 5 + "<p>" + "Another, longer one; indeed. " * 5 + "</div>"
    assert "Home" not in html_text.extract(plain) and html_text.extract(plain).startswith("A long")


def test_html_scores_decide_in_marked_pages():
    long = "A long sentence, with marks, and more. " * 5
    cards = "".join(f"<article><h2><a href=x>Card {i}</a></h2><p>Short</p></article>" for i in range(4))
    found = html_text.extract(f"<body><div><p>{long}<p>{long}<p>{long}</div><section>{cards}</section></body>")
    assert found == " ".join((long * 3).split())
    menu = "<ul><li><a>Home</a><li><a>About</a><li><a>Contact</a></ul>"
    found = html_text.extract(f"<main>{menu}<h1><a>Title</a></h1><p>{long}<p>See <a>this</a> and <a>that</a>.<p>{long}<ul><li>One<li>Two</ul></main><div>Copyright</div>")
    assert found == " ".join(f"Title {long} See this and that. {long} One Two".split())


def test_html_ratios_decide_without_names(spark):
    """Neither an article nor telling classes: short nodes with few marks go, in any column order; nulls and repeats stay rows."""
    say = "One sentence, then another; and so on. " * 6
    links = "".join(f"<div class=x{i % 3}><span>Item {i}</span></div>" for i in range(30))
    page = f"<body><div class=c1>{links}</div><div class=c2><p>{say}</p><p>{say}</p></div><section class=c3><span>Note</span></section></body>"
    assert html_text.extract(page) == " ".join((say * 2).split())
    rows = [(None, page, "u", 1), (7, page, None, 2), (7, page, None, 2), (8, None, "v", 3), (9, "", "v", 4)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text int")
    found = sorted(((r.page_id or 0, r.url, r.text) for r in html_text.extract_pages(pages).collect()), key=str)
    body = " ".join((say * 2).split())
    assert found == sorted([(0, "u", body), (7, None, body), (7, None, body), (8, "v", ""), (9, "v", "")], key=str)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def brute_html(page):
    """Path sums, smoothing, weights and threshold as the docstring has them, from another parser; for pages with all end tags and no links."""
    from html.parser import HTMLParser

    regions = {"article", "main", "section", "div", "td", "body", "blockquote", "nav", "header", "footer", "aside", "form"}
    said, stack = [], []

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            first = (dict(attrs).get("class") or "").split()[:1]
            outer = stack[-1][2] if stack else 0
            names = {"nav", "footer", "aside"}
            kind = -1 if outer < 0 or tag in names or first in (["ad"], ["comments"]) else 1 if outer > 0 or tag == "article" else 0
            stack.append((tag, tag + "." + first[0] if first and tag in regions else tag, kind))

        def handle_endtag(self, tag):
            assert stack.pop()[0] == tag

        def handle_data(self, data):
            if data.strip():
                said.append((data, tuple(x[1] for x in stack), stack[-1][2]))

    Parser().feed(page)
    inner = lambda path: next((path[:k] for k in range(len(path), 0, -1) if path[k - 1].split(".")[0] in regions), ())
    prior = {-1: 0.03, 0: 1.0, 1: 10.0}

    def total(match):
        texts = [t for t, path, kind in said if match(path, kind)]
        return sum(map(len, map(str.strip, texts))), sum(t.count(".") + t.count(",") for t in texts), len(texts)

    def ratio(match):
        n, marks, count = total(match)
        return n / count * (1 + marks / count)

    def weight(region, kind):
        own = total(lambda p, m: inner(p) == region and m == kind)[0] * prior[kind]
        for m in {0, kind} if region else ():
            own = max(own, weight(inner(region[:-1]), m) * (1 if m == kind == 1 else 0.5))
        return own

    heaviest = max(weight(inner(p), m) for _, p, m in said)
    plain = [
        (ratio(lambda p, m, q=q, k=k: (p, m) == (q, k)) + ratio(lambda p, m, q=q, k=k: (inner(p), m) == (inner(q), k))) / 2 * weight(inner(q), k) / heaviest
        for _, q, k in said
    ]
    mean = sum(plain) / len(plain)
    return " ".join(t.strip() for (t, _, k), x in zip(said, plain, strict=True) if x * prior[k] >= 0.25 * mean)


def test_html_against_brute_force():
    random.seed(7)
    some = lambda most: " ".join(random.choices(WORDS, k=random.randint(1, most))) + random.choice([".", ", so.", ""])
    parts = ["div", "div class=ad", "div class=comments", "div class=story", "section", "article", "nav", "footer", "aside", "blockquote", "ul"]

    def grown(depth):
        out = []
        for _ in range(random.randint(1, 4)):
            if depth and random.random() < 0.5:
                part = random.choice(parts)
                out.append(f"<{part}>{grown(depth - 1)}</{part.split()[0]}>")
            else:
                out.append(f"<p>{some(random.choice([2, 10, 60]))}</p>")
        return "".join(out)

    differ = 0
    for _ in range(300):
        page = f"<body>{grown(3)}</body>"
        assert html_text.extract(page) == brute_html(page), page
        differ += html_text.extract(page) != html_text.extract(page, share=0.0)
    assert differ > 200


def test_html_weights_of_regions():
    """A footer as rich as the article's sentences goes by its region's small share of the text, whatever it is called; a quotation inside the article stays."""
    say = "One sentence, then another; and so on. "
    page = f"<body><div class=text><p>{say * 3}</p><p>{say * 4}</p><p>{say * 3}</p></div><div class=last>{say * 2}</div></body>"
    assert html_text.extract(page) == " ".join((say * 10).split())
    page = f"<body><article><p>{say * 9}</p><blockquote><p>{say}</p></blockquote><table><tr><td>{say}</table></article><div>{say}</div></body>"
    assert html_text.extract(page) == " ".join((say * 11).split())
    # The prior is bounded: among many short texts the one that holds nearly all of the page stays, whatever its region is called.
    page = f"<body>{'<div>Up</div>' * 30}<div class=widget><p>{say * 30}</p><p>{say * 30}</p></div></body>"
    assert html_text.extract(page) == " ".join((say * 60).split())


def test_suffix_tree(spark, texts):
    rows = {r.doc_id: r for r in suffix_tree.score(make(spark, texts), block_bytes=4000).collect()}
    words = {i: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b"\n"] for i, t in enumerate(texts)}
    count = {}
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        base = sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert rows[i].base_score == pytest.approx(base) and rows[i].n_tokens == len(w) and rows[i].train_tokens == n
        assert rows[i].n_known == sum(x in count for x in w) and rows[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    assert suffix_tree.score(make(spark, [])).count() == 0


def test_suffix_tree_keeps_contexts_of_frequent_words(spark):
    """Scores follow from the counts alone, however many blocks and shards there are."""
    random.seed(8)
    texts = [" ".join(f"the {random.choice(WORDS[:6])} of {random.choice(WORDS)}" for _ in range(random.randint(1, 40))) for _ in range(120)]
    one, many = ({r.doc_id: r.score for r in suffix_tree.score(make(spark, texts).coalesce(1), block_bytes=size).collect()} for size in (10**9, 400))
    assert many == one


def brute_tree(words, held, min_gain, depth=3):
    """log10 probabilities by a tree of dictionaries: every context of up to ``depth`` words with its test."""
    from collections import Counter, defaultdict

    count = Counter(x for w, h in zip(words, held, strict=True) if not h for x in w)
    total, kinds = sum(count.values()), len(count)
    known = [[x if x in count else None for x in w] for w in words]
    after = defaultdict(Counter)
    for w, h in zip(known, held, strict=True):
        padded = ["^"] * depth + w
        for k in range(depth, len(padded) if not h else 0):
            for n in range(1, depth + 1):
                after[tuple(padded[k - n : k])][padded[k]] += 1
    kept = {}

    def p(context, x):
        if not context:
            return (count[x] + 0.1) / (total + 0.1 * (kinds + 1))
        table, above = after.get(context, {}), p(context[1:], x)
        size, different = sum(table.values()), len(table)
        if context not in kept:
            own = lambda y, c: (c - 1 + different * p(context[1:], y)) / max(size - 1 + different, 1) / p(context[1:], y)
            kept[context] = size > 1 and sum(c * math.log(own(y, c)) for y, c in table.items()) >= min_gain
        return (table[x] + different * above) / (size + different) if kept[context] else above

    padded = [["^"] * depth + w for w in known]
    return [sum(math.log10(p(tuple(w[k - depth : k]), w[k])) for k in range(depth, len(w))) for w in padded]


def test_suffix_tree_equals_the_tree_of_all_occurrences(spark):
    """Words that training has twice are contexts too: two near copies of rare words, beside frequent and single ones."""
    random.seed(9)
    rare = [" ".join(f"r{i}x{j}" for j in range(12)) for i in range(30)]
    say = lambda n: " ".join(random.choice([*WORDS, "the", "the", f"s{random.randint(0, 999)}"]) for _ in range(n))
    texts = [*(f"{say(5)} {r} {say(5)}" for r in rare * 2), *(say(random.randint(0, 40)) for _ in range(100))]
    words = [[*t.encode().split(), b"\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    expected = brute_tree(words, held, suffix_tree.MIN_GAIN)
    found = {r.doc_id: r for r in suffix_tree.score(make(spark, texts), block_bytes=1500).collect()}
    assert [found[i].score for i in range(len(texts))] == pytest.approx(expected)
    assert sum(found[i].score - found[i].base_score > 5 for i in range(60)) > 40


def test_suffix_tree_is_a_distribution():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 5, 4000)
    n[1:][rng.random(3999) < 0.5] = 0
    z, a, b, c = n[:-3], n[1:-2], n[2:-1], n[3:]
    kinds = sorted((int((n == k).sum()), 1) for k in range(5))
    order = np.argsort([-(n == k).sum() for k in range(5)], kind="stable")
    rank = np.empty(5, np.int64)
    rank[order] = np.arange(5)
    z, a, b, c = rank[z], rank[a], rank[b], rank[c]
    counts = suffix_tree.Counts([(k, 1) for k, _ in kinds])
    for x in range(5):
        for y in range(5):
            extra = np.arange(6)
            args = [np.concatenate(v) for v in ((z, np.full(6, y)), (a, np.full(6, x)), (b, np.full(6, y)), (c, extra), (np.ones(len(a)), np.zeros(6)))]
            lp, _ = suffix_tree.subtree(*args, counts, np.zeros(len(args[0]), bool), 3.0)
            assert np.exp(lp[-6:]).sum() == pytest.approx(1.0)


def brute_kneser_ney(train, texts):
    """log10 probabilities by modified Kneser-Ney as it is defined, with dictionaries."""
    from collections import Counter

    words = {w for t in train for w in kneser_ney._tokens(t)}
    tri = Counter()
    for t in train:
        w = ["", "", *kneser_ney._tokens(t)]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    bi = Counter((b, n) for _, b, n in tri)
    uni = Counter(n for _, n in bi)

    def share(table, key, context):
        d = kneser_ney.discounts([sum(c == k for c in table.values()) for k in (1, 2, 3, 4)])
        inside = {k: c for k, c in table.items() if k[:-1] == context} if context is not None else table
        total = sum(inside.values())
        if not total:
            return 0.0, 1.0
        c = table.get(key, 0)
        return (c - d[min(c, 3)]) / total, sum(d[min(x, 3)] for x in inside.values()) / total

    def p(a, b, n):
        s1, w1 = share(uni, n, None)
        s2, w2 = share(bi, (b, n), (b,))
        s3, w3 = share(tri, (a, b, n), (a, b))
        return s3 + w3 * (s2 + w2 * (s1 + w1 / (len(words) + 1)))

    out = []
    for t in texts:
        w = ["", "", *[x if x in words else "?" for x in kneser_ney._tokens(t)]]
        out.append(sum(math.log10(p(*x)) for x in zip(w, w[1:], w[2:], strict=False)))
    return out


def test_kneser_ney_probabilities(spark):
    random.seed(6)
    texts = [" ".join(random.choices(WORDS[:8], weights=range(1, 9), k=random.randint(1, 40))) for _ in range(60)]
    texts += [None, "", "alpha unseen beta Alpha", texts[0]]
    docs = make(spark, texts)
    model = kneser_ney.fit(docs, list(range(40)))
    expected = brute_kneser_ney(texts[:40], texts)
    for sizes in ((600, 1500), (8_000_000, 256_000_000)):
        found = {r.doc_id: r for r in kneser_ney.scores(docs.repartition(3), model, *sizes).collect()}
        assert [found[i].log10_prob for i in range(len(texts))] == pytest.approx(expected)
        assert [found[i].n_tokens for i in range(len(texts))] == [len((t or "").split()) for t in texts]


def test_kneser_ney(spark):
    random.seed(4)
    good = [" ".join(random.choices(WORDS, k=50)) for _ in range(200)]
    bad = [" ".join(f"q{random.randint(0, 9999)}" for _ in range(50)) for _ in range(20)]
    docs = make(spark, [*good, *bad, None, "short", good[0], bad[0]], [*range(222), 0, 200])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(None, 1, 0), (999, 1, 0), (200, 0, 0), (200, 1, 0)], LABELS)
    for bounds in ({}, {"max_docs": 40}):
        judged = kneser_ney.judge(docs, labels, **bounds).collect()
        assert all(r.threshold is not None for r in judged) and len(judged) == 224
        kept = kneser_ney.keep(docs, labels, **bounds)
        assert kept.columns == docs.columns
        kept = sorted(r.doc_id for r in kept.collect())
        assert not {*range(200, 220)} & {*kept} and len({*range(200)} & {*kept}) >= 185 and {220, 221} <= {*kept}
    assert kneser_ney.judge(docs, spark.createDataFrame([], LABELS)).where("not kept").count() == 0
    assert kneser_ney.judge(docs.limit(0), labels).count() == 0
