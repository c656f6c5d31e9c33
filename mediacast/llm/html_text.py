"""HTML extraction by tag-path ratios (operator 7).

Every text node lies under a root-to-leaf path of tags; a region's step in a path has its first class
word too, whatever that says. Text of a page's main article shares few paths, each with much text and
punctuation a node; menus and notices share paths with little. For each path the text length and the
punctuation a node are summed over the page and smoothed with the sums of its innermost region. That is
fused with the region's weight: its share of the text of the page's heaviest region, where a region
inside another has at least half of the outer one's weight, and all of it within one marked article.
What names and marks say is a bounded prior, a factor on text and score: 3/100 where a tag, role or class
names a menu, advert, comments and the like, 10 inside a marked article. A path stays if its score is
a quarter of the mean over the page's text nodes; no text is left out before. A block of nothing but
links has no bonus and is summed with such blocks alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Fixed values of HTML: tags without an end tag; tags whose content is no markup; tags that don't end a run of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Tags at whose start an open paragraph ends.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Names of regions that are rarely article text, by tag, by role and by word in class or id.
SKIP_TAGS = frozenset("nav header footer aside form button select option menu dialog svg canvas object audio video head".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus"
    " footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related reply replies"
    " respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
SECTIONS = frozenset("article main section div td body blockquote".split())
REGIONS = SECTIONS | frozenset("nav header footer aside form".split())
#: A path stays if its fused score reaches this share of the page's mean.
SHARE = 0.25
#: The prior's factors: inside a marked article, and inside a region that is named as boilerplate.
MARK, NAMED = 10.0, 0.03
#: Weight of a region, of that of the region around it.
INNER = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"""[.,;:!?。，；！？…]""")
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
RAW_END = {tag: re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z0-9]+")
CLASS = re.compile(r"""\bclass\s*=\s*["']?\s*([^\s"'>\d]+)""", re.I)


def _skipped(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is marked as the article's body."""
    if tag in SKIP_TAGS:
        return True, False
    skip, body = False, tag in ("article", "main")
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name in ("class", "id"):
                skip |= tag not in ("html", "body", "article", "main") and any(w in SKIP_WORDS for w in WORD.findall(value))
            elif name == "role":
                skip |= value in SKIP_ROLES
                body |= value in ("main", "article")
            elif name == "itemprop":
                body |= value == "articlebody"
            elif name == "hidden" or value == "true":
                skip = True
    return skip, body


def text_nodes(html: str) -> Iterator[tuple[str, tuple[str, ...], int, int]]:
    """(text, path, block number, mark) of all text in page order; the mark is 1 inside a marked article, -1 inside named boilerplate."""
    stack: list[tuple[str, bool, bool, str]] = []  # tag, skipped, in the article, step of the path
    block, at, size = 0, 0, len(html)
    while at < size:
        found = TOKEN.search(html, at)
        end = found.start() if found else size
        if end > at:
            above = stack[-1] if stack else ("", False, False, "")
            yield html[at:end], tuple(x[3] for x in stack), block, -1 if above[1] else int(above[2])
        if not found:
            return
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            block += 1
        if found[1] or found[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE | {"p"} and stack[k][0] in SECTIONS:
                    break
            continue
        if tag in RAW:
            close = RAW_END[tag].search(html, at)
            at = close.end() if close else size
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "tr", "select") and stack[k][0] != tag:
                    break
        attributes = found[3] or found[6] or ""
        if tag in VOID or attributes.endswith("/") and tag not in ENDS_P:
            continue
        skip, body = _skipped(tag, attributes)
        above = stack[-1] if stack else ("", False, False, "")
        named = CLASS.search(attributes) if tag in REGIONS else None
        stack.append((tag, above[1] or skip, above[2] or body, f"{tag}.{named[1].lower()}" if named else tag))


#: What sums are kept for: a path or region, its mark, whether its blocks are links alone.
Key = tuple[tuple[str, ...], int, bool]


def path_scores(texts: list[tuple[str, Key]], mark: float = MARK, named: float = NAMED) -> tuple[dict[Key, float], float]:
    """The fused score of each path that has text, and the mean score of the text nodes."""
    sums: dict[Key, list[int]] = {}
    around: dict[Key, list[int]] = {}
    region_of: dict[Key, Key] = {}
    for t, key in texts:
        n = len(t.strip())
        if not n:
            continue
        if key not in region_of:
            region_of[key] = (_region(key[0]), *key[1:])
        marks = len(PUNCTUATION.findall(t))
        for held, at in ((sums, key), (around, region_of[key])):
            x = held.setdefault(at, [0, 0, 0])
            x[0] += n
            x[1] += marks
            x[2] += 1
    if not sums:
        return {}, 0.0

    def ratio(x: list[int]) -> float:
        return (x[0] / x[2]) * (1 + x[1] / x[2])

    def prior(key: Key) -> float:
        return named if key[1] < 0 else mark if key[1] > 0 and not key[2] else 1.0

    weights: dict[Key, float] = {}

    def weight(region: Key) -> float:
        if region not in weights:
            own = around[region][0] * prior(region) if region in around else 0.0
            if region[0]:
                outer = _region(region[0][:-1])
                own = max(own, *(weight((outer, m, region[2])) * (1.0 if m == region[1] > 0 else INNER) for m in {0, region[1]}))
            weights[region] = own
        return weights[region]

    heaviest = max(weight(region) for region in around)
    scores = {p: (ratio(x) + ratio(around[region_of[p]])) / 2 * weight(region_of[p]) / heaviest for p, x in sums.items()}
    mean = sum(scores[p] * x[2] for p, x in sums.items()) / sum(x[2] for x in sums.values())
    return {p: score * prior(p) for p, score in scores.items()}, mean


def _region(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path of the innermost region."""
    return path[: next((k for k in range(len(path), 0, -1) if path[k - 1].partition(".")[0] in REGIONS), 0)]


def extract(html: str | None, share: float = SHARE, mark: float = MARK, named: float = NAMED) -> str:
    """The main text: blocks in page order, white space within and between them made one space."""
    nodes = [(unescape(t), path, block, kind) for t, path, block, kind in text_nodes(html or "")]
    said = {block for t, path, block, _ in nodes if not t.isspace() and ("a" not in path or HEADINGS.intersection(path))}
    nodes = [(t, (path, kind, block not in said), block) for t, path, block, kind in nodes]
    scores, mean = path_scores([(t, key) for t, key, _ in nodes], mark, named)
    stays = {key for key, score in scores.items() if score >= share * mean}
    # White space alone goes with the paths that it stands between.
    blocks: dict[int, list[str]] = {}
    for t, key, block in nodes:
        if key in stays or key not in scores:
            blocks.setdefault(block, []).append(t)
    return " ".join(" ".join(" ".join("".join(parts).split()) for parts in blocks.values()).split())


def extract_pages(pages: DataFrame, id_col: str = "page_id", share: float = SHARE) -> DataFrame:
    """(id_col, url, text) for every row of ``pages``.

    Null or empty html, and pages of boilerplate alone, give the empty text. Null ids and urls stay
    null, repeated rows come back as often. No shuffle; a page is held alone in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = pa.array([extract(h, share) for h in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], [id_col, "url", "text"])

    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col("url"), F.col("html")).mapInArrow(run, f"`{id_col}` {kind}, url string, text string")
