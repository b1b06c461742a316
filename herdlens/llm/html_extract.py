"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score positive and tags negative;
elements known as boilerplate are left out and cost nothing to cross. A linear
scan finds the contiguous region with the largest sum; where a page marks its
main text, the scan is held to the marked elements. The weights come from
labelled pages: a bounded sample of distinct pages that mark their main text
themselves (``article`` or ``main``), in which every tag's occurrences inside
and outside of the marked region are counted; elements around it are neither.
The region grows to the marked element it lies in, and boilerplate inside it
goes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import stored

# Element kinds of HTML.
RAW = "script style noscript template textarea title select svg iframe object canvas audio video".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset(("td", "th"))
MARKED = frozenset(("article", "main"))
#: Inside a marked element only these are boilerplate by name or learned class; headings, paragraphs and inline tags aren't.
CONTAINERS = frozenset("div section ul ol aside".split())
BOILER_TAGS = frozenset("nav footer aside form button dialog menu head".split())
#: Parts of class, id or role names that mark boilerplate.
BOILER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsors?|sponsored|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|alerts?|"
    r"popups?|modal|overlay|newsletters?|subscribe|subscription|signup|share|sharing|social|sidebars?|menus?|navigation|nav|navbar|breadcrumbs?|toolbar|"
    r"pagination|pager|related|recommended|recommendations|comments?|commentlist|disqus|respond|replies|feedback|footer|masthead|topbar|widgets?|login|"
    r"search|skip|copyright|legal|disclaimer|hidden|contentinfo|complementary)(?:$|[\s_-])", re.I)
#: Words that say nothing of a named part but that it is one.
PART_NAMES = re.compile(
    r"(?:area|articles?|bar|block|body|bottom|box|btns?|buttons?|card|container|content|group|holder|icons?|inner|items?|left|links?|list|"
    r"main|media|outer|panel|posts?|readers?|right|row|section|slots?|stories|top|units?|users?|widgets?|wrap|wrapper|[0-9]+)", re.I)
_WRAPPER = re.compile(r"\b(?:with|has|no|without)[_-]\w+", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?(?:</\1\s*+[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]++|<",
    re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNSEEN = re.compile(r"\bhidden\b(?!\s*=)|\baria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

WORD, INLINE, BREAK = 1.0, -0.25, -0.5
#: Weight of a tag that labelled pages have outside only; what they have inside only costs next to nothing.
OUTSIDE = -8.0


_ID = re.compile(r"\bid\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def _names(attributes: str) -> str:
    return " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""


def _agrees(name: str) -> bool:
    """All words of one class or id name mark boilerplate or say nothing, and one marks it."""
    words = [w for w in re.split(r"[\s_-]+", name) if w]
    named = [bool(BOILER_NAMES.search(w)) for w in words]
    return any(named) and all(n or PART_NAMES.fullmatch(w) for n, w in zip(named, words))


def _boiler_name(tag: str, attributes: str, names: str, marked: int) -> bool:
    if not marked:
        return bool(names and BOILER_NAMES.search(_WRAPPER.sub(" ", names)))
    if tag not in CONTAINERS:
        return False
    # Ids in an article are anchors made from its headings, unless the words of a plain container's are all boilerplate.
    named = _names(_ID.sub(" ", attributes))
    if named.strip():
        return any(_agrees(n) for n in _WRAPPER.sub(" ", named).split())
    words = [w for w in re.split(r"[\s_-]+", names) if w]
    return tag != "section" and bool(words) and all(BOILER_NAMES.search(w) for w in words)


def _is_boiler(tag: str, attributes: str, names: str, marked: int) -> bool:
    if tag in MARKED or tag in ("html", "body"):
        return bool(tag == "article" and names and re.search(r"\bcomment", names, re.I))
    if tag in BOILER_TAGS or tag == "header" and not marked:
        return True
    if _boiler_name(tag, attributes, names, marked):
        return True
    return bool(attributes) and bool(_UNSEEN.search(attributes))


def parse(page: str, learned: frozenset = frozenset()) -> list[tuple]:
    """Tokens of a page in order.

    ("text", raw text, boilerplate?, marked element or 0) and
    ("tag", feature, breaks the block?, boilerplate?, table cell?, marked element, 0, or -1 for
    a tag of an element around a marked one and an end without a start).
    ``learned`` are features (tag.class) that labelled pages have outside of
    the main text only.
    """
    out: list[tuple] = []
    open_tags: list[tuple[str, bool, int, int]] = []
    # Places in open_tags by name, and of blocks: an end tag finds its start without looking through what is open.
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    around = 0  # so many open tags are known to be around a marked element
    boiler, marked, n_marked = 0, 0, 0
    for m in _TOKEN.finditer(page):
        tag = m[3] or m[6]
        if tag is None:
            t = m[0]
            if t[0] != "<" or len(t) == 1:
                out.append(("text", t, boiler > 0, marked))
            continue
        tag, closing, attributes = tag.lower(), m[2] if m[3] else m[5], (m[4] if m[3] else m[7]) or ""
        breaks = tag in BREAKS
        if not closing:
            if tag in RAW:
                continue
            names = _names(attributes)
            feature = f"{tag}.{names.split()[0]}" if names.strip() else tag
            bad = _is_boiler(tag, attributes, names, marked) or feature in learned and (not marked or tag in CONTAINERS)
            if tag in MARKED and not bad and not marked:
                for name, _, _, at in open_tags[around:]:
                    if name != "p" and not out[at][5]:  # a paragraph ends where a block starts
                        out[at] = (*out[at][:5], -1)
                around = len(open_tags)
            if tag in MARKED and not bad and boiler:
                # An unclosed boilerplate element doesn't swallow the marked text.
                open_tags, places, blocks, around, boiler = [], {}, [], 0, 0
            out.append(("tag", feature, breaks, bad or boiler > 0, tag in CELLS, marked))
            if tag not in VOID and not attributes.endswith("/"):
                was = marked
                if tag in MARKED and not bad and not boiler:
                    n_marked += 1
                    marked = marked or n_marked
                places.setdefault(tag, []).append(len(open_tags))
                if breaks:
                    blocks.append(len(open_tags))
                open_tags.append((tag, bad, was, len(out) - 1))
                boiler += bad
        else:
            k = places[tag][-1] if places.get(tag) else -1
            # A block's end closes what was left open in it; an inline end doesn't close blocks.
            if k >= 0 and (breaks or not blocks or blocks[-1] <= k):
                out.append(("tag", "/" + tag, breaks, boiler > 0, tag in CELLS, marked or min(out[open_tags[k][3]][5], 0)))
                marked = open_tags[k][2]
                boiler -= sum(t[1] for t in open_tags[k:])
                for t in open_tags[k:]:
                    places[t[0]].pop()
                while blocks and blocks[-1] >= k:
                    blocks.pop()
                around = min(around, k)
                del open_tags[k:]
            else:
                out.append(("tag", "/" + tag, breaks, boiler > 0, tag in CELLS, marked or -(k < 0)))
    return out


def region(tokens: list[tuple], weights: dict[str, float], within: bool = False) -> tuple[int, int]:
    """(first, past the last) token of the maximum-scoring subsequence; (0, 0) if no words score.

    Boilerplate is cut out anyway, so it costs nothing to cross; ``within``: so
    does everything outside of marked elements.
    """
    best, start, end, total, since = 0.0, 0, 0, 0.0, 0
    for k, t in enumerate(tokens):
        if t[0] == "text":
            if t[2] or within and t[3] <= 0:
                continue
            total += len(t[1].split()) * WORD
        else:
            if t[3] or within and t[5] <= 0:
                continue
            total += weights.get(t[1], BREAK if t[2] else INLINE)
        if total <= 0:
            total, since = 0.0, k + 1
        elif total > best:
            best, start, end = total, since, k + 1
    return start, end


def extract(page: str, weights: dict[str, float] | None = None, learned: frozenset = frozenset()) -> str:
    """Blocks of the page's main text, one per line.

    A page that marks its main text is scored inside of marked elements only,
    and those that the best region touches are taken whole.
    """
    tokens = parse(page, learned)
    within = any(t[0] == "text" and t[3] and not t[2] and t[1].strip() for t in tokens)
    start, end = region(tokens, weights or {}, within)
    if end <= start:
        return ""
    whole = {t[3] for t in tokens[start:end] if t[0] == "text" and t[3] and not t[2] and t[1].strip()} if within else set()
    blocks, part, wanted = [], [], False

    def close():
        if wanted and (text := " ".join(entities.unescape("".join(part)).split())):
            blocks.append(text)

    for k, t in enumerate(tokens):
        if t[0] == "tag":
            if t[2]:
                close()
                part, wanted = [], False
            elif t[4]:
                part.append(" ")
        elif not t[2] and (not within or t[3] in whole):
            part.append(t[1])
            wanted = wanted or within or start <= k < end
    close()
    return "\n".join(blocks)


def tag_counts(page: str) -> Counter:
    """(feature, 1 inside, 0 outside, -1 around) -> occurrences in a page that marks its main text; empty if it doesn't."""
    tokens = parse(page)
    if not any(t[0] == "text" and t[3] for t in tokens):
        return Counter()
    out: Counter = Counter()
    for t in tokens:
        if t[0] == "tag" and not t[3]:
            out[t[1], min(t[5], 1) if t[1].lstrip("/").split(".")[0] not in MARKED else 0] += 1
    return out


def fit(pages: DataFrame, html: str = "html", sample_pages: int = 200, least_seen: int = 20) -> tuple[dict[str, float], frozenset]:
    """(weight of each tag feature, features learned as boilerplate) from at most ``sample_pages`` labelled pages.

    The sample is the distinct pages with the smallest md5 of their html among
    those with an ``article`` or ``main`` element; copies count once. Without
    any, default weights hold. A class is learned as boilerplate if the sample has it
    ``least_seen`` times, and never in or around a marked element.
    """
    text = F.col(html).cast("string")
    labelled = pages.select(text.alias("html")).where(text.rlike(r"(?i)<(article|main)\b")).select(F.md5("html").alias("_by"), "html")
    chosen = [r["_by"] for r in labelled.select("_by").distinct().orderBy("_by").limit(sample_pages).collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            rows = []
            for by, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if by not in seen:
                    seen.add(by)
                    rows += [(by, f, place, n) for (f, place), n in tag_counts(t).items()]
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))],
                                             names=["_by", "feature", "place", "n"])

    # Tasks count a page once each; its copies over tasks go here.
    counted = (labelled.where(F.col("_by").isin(chosen)).mapInArrow(count, "_by string, feature string, place int, n long")
               .dropDuplicates(["_by", "feature", "place"]))
    sums = [F.sum(F.when(F.col("place") == place, F.col("n")).otherwise(0)).alias(c) for c, place in (("within", 1), ("outside", 0), ("around", -1))]
    rows = stored(counted.groupBy("feature").agg(*sums), "html-weights").collect()
    weights, learned = {}, set()
    for r in rows:
        n = r["within"] + r["outside"]
        if not n:
            continue
        out = (r["outside"] + 0.05) / (n + 0.1)
        name = r["feature"].lstrip("/").split(".")[0]
        weights[r["feature"]] = min(-0.02, OUTSIDE * out if name in BREAKS else INLINE)
        if "." in r["feature"] and r["within"] == r["around"] == 0 and n >= least_seen and name not in MARKED and not r["feature"].startswith("body."):
            learned.add(r["feature"])
    return weights, frozenset(learned)


def main_text(pages: DataFrame, html: str = "html", sample_pages: int = 200) -> DataFrame:
    """``pages`` with ``_text``: null html gives an empty text; empty tables give empty tables."""
    weights, learned = fit(pages, html, sample_pages)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda p: extract(p, weights, learned))

    return pages.withColumn("_text", run(F.coalesce(F.col(html).cast("string"), F.lit(""))))


def op3_query(pages: DataFrame) -> DataFrame:
    out = main_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
