"""Main text of web pages by nearest-URL page differencing, checked against the markup.

Pages of a host stand in order of their URL path and query. Every page is aligned with its nearest different neighbours by
longest common subsequence of text lines, and lines both share are deleted as template. Page differencing alone can't give
whole articles: menus and adverts differ from page to page and stay, while articles repeat passages of each other and lose
them (figures in the README). So a check follows: lines in page furniture (menus, adverts, forms, comments ...) are out, and
where a page marks its article, the article's deleted lines are restored and kept lines outside it are dropped.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import partitions, small_batches, stored

#: A neighbour that shares more than this part of a page's open text may be a copy of it, not a sample of its template.
COPY_SHARE = 0.7
#: Neighbours tried on each side, and pages of one block, which also holds as many neighbours on either side.
NEIGHBOURS, BLOCK_PAGES = 3, 256
BROADCAST_ROWS = 1_000_000
# Elements by role, and words in class, id or role attributes that mark furniture or the article.
FURNITURE = set("aside button canvas dialog fieldset footer form head iframe menu nav noscript object option select svg template title".split())
RAW = ("script", "style", "textarea", "xmp")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE_WORDS = set(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer "
    "gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice popup promo promoted reply related respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo search alert".split()
)
ARTICLE_WORDS = {"articlebody", "article-body", "article-content", "entry-content", "post-body", "post-content", "story-body", "main-content", "main"}
OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)")
#: What stands between a tag's name and its end; a "<" outside quotes ends it, so that no broken tag is read twice.
ATTRIBUTES = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'"<>])*+""")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(furniture, article) of an element."""
    if tag in FURNITURE or (tag == "header" and not in_article):
        return True, False
    article = tag in ("article", "main")
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN_STYLE.search(value)):
                return True, False
            if name in ("class", "id", "role", "itemprop"):
                words = value.split()
                if not article and ARTICLE_WORDS.intersection(words):
                    article = True
                elif name != "itemprop" and FURNITURE_WORDS.intersection(words) or (name in ("class", "id") and FURNITURE_WORDS.intersection(re.split(r"[\s_-]+", value)) and not article):
                    return True, False
    return False, article


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, lower-case name, closing, attributes) of each tag, the name empty for comments and declarations; a raw
    element's content belongs to its tag. Every character is read a bounded number of times, also in broken pages."""
    end, at, bracket = len(page), 0, True

    def after(i: int) -> int:
        """End of what the next ">" closes, 0 if there is none, which then holds for all later places."""
        nonlocal bracket
        found = page.find(">", i) if bracket else -1
        bracket = found >= 0
        return found + 1

    while (at := page.find("<", at)) >= 0:
        match = OPENING.match(page, at)
        if match:
            stop = ATTRIBUTES.match(page, match.end()).end()
            closed = stop + 1 if page[stop : stop + 1] == ">" else after(match.end())
            if closed:
                tag, start = match[2].lower(), at
                attributes, at = page[match.end() : closed - 1], closed
                if tag in RAW and not match[1]:
                    closing = RAW_END[tag].search(page, at)
                    at = closing.end() if closing else end
                yield start, at, tag, bool(match[1]), attributes
                continue
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            start, at = at, stop + 3 if stop >= 0 else end
            yield start, at, "", False, ""
            continue
        elif page[at + 1 : at + 2] in ("!", "?") and (closed := after(at)):
            start, at = at, closed
            yield start, at, "", False, ""
            continue
        at += 1


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, place) of each block with text, in page order; place: 0 furniture, 1 open, 2 inside the article."""
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    standing: Counter[str] = Counter()
    place, held, at = 1, [], 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append((text, place))

    def leave() -> int:
        tag, before = stack.pop()
        standing[tag] -= 1
        return before

    for start, end, tag, closing, attributes in tags(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if not tag or tag in RAW:
            continue
        inline = tag in INLINE
        if closing:
            if standing[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                if not inline or stack[depth][1] != place:
                    flush()
                while len(stack) > depth:
                    place = leave()
            elif not inline:
                flush()
            continue
        furniture, article = _kind(tag, attributes, place == 2)
        if not inline or furniture:
            flush()
        closes = SELF_CLOSING.get(tag, ())
        while stack and (stack[-1][0] in closes or stack[-1][0] in INLINE and any(standing[t] for t in closes)):
            place = leave()
        if tag not in VOID and not attributes.endswith("/") and (not inline or furniture):
            stack.append((tag, place))
            standing[tag] += 1
            place = 0 if furniture or place == 0 else 2 if article else place
    held.append(page[at:])
    flush()
    return lines


def common_lines(own: list[int], other: list[int]) -> set[int]:
    """Places in ``own`` of one longest common subsequence with ``other``: bit-parallel rows over the lines both have."""
    first = 0
    while first < min(len(own), len(other)) and own[first] == other[first]:
        first += 1
    last = 0
    while last < min(len(own), len(other)) - first and own[-1 - last] == other[-1 - last]:
        last += 1
    found = {*range(first), *range(len(own) - last, len(own))}
    theirs = set(other[first : len(other) - last])
    places = [i for i in range(first, len(own) - last) if own[i] in theirs]
    if not places:
        return found
    masks: dict[int, int] = {}
    for k, i in enumerate(places):
        masks[own[i]] = masks.get(own[i], 0) | 1 << k
    full = (1 << len(places)) - 1
    steps = [masks[x] for x in other[first : len(other) - last] if x in masks]
    span = math.isqrt(len(steps)) + 1

    def advance(v: int, part: list[int]) -> list[int]:
        rows = [v]
        for mask in part:
            u = v & mask
            v = ((v + u) | (v - u)) & full
            rows.append(v)
        return rows

    # rows of every span-th step are kept and the others made again on the way back: memory grows with the root of the steps
    kept = [full]
    for k in range(0, len(steps), span):
        kept.append(advance(kept[-1], steps[k : k + span])[-1])
    i = len(places)
    for k in reversed(range(0, len(steps), span)):
        rows = advance(kept[k // span], steps[k : k + span])
        j = len(rows) - 1
        while i and j:
            if rows[j] >> (i - 1) & 1:
                i -= 1
            elif not rows[j - 1] >> (i - 1) & 1:
                j -= 1
            else:
                found.add(places[i - 1])
                i, j = i - 1, j - 1
    return found


def line_hash(text: str) -> int:
    raw = text.encode()
    return zlib.crc32(raw) << 31 | zlib.adler32(raw) & 0x7FFFFFFF


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path and query without fragment); both empty for a null URL."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    bare = F.regexp_replace(rest, r"#.*$", "")
    return F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), F.regexp_replace(bare, r"^[^/?]*", "")


def outlines(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, lines, places, page_hash, marked) of every page row: each page is parsed once. marked: some of its
    text is marked as an article."""

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.string()), pa.list_(pa.int8()), pa.int64(), pa.bool_()]
        for batch in batches:
            found = []
            for x in batch.column(4):
                lines = page_lines(x.as_py() or "")
                kept = [(t, p) for t, p in lines if p]
                found.append(([t for t, _ in kept], [p for _, p in kept], line_hash("\n".join(t for t, _ in kept)), any(p == 2 for _, p in kept)))
            new = [pa.array(x, t) for x, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *new], ["page_id", "url", "host", "path", "lines", "places", "page_hash", "marked"])

    host, path = url_parts(F.col("url"))
    keyed = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    schema = "page_id long, url string, host string, path string, lines array<string>, places array<tinyint>, page_hash long, marked boolean"
    return stored(keyed.mapInArrow(outline, schema), "outlines")


def ranked(pages: DataFrame) -> DataFrame:
    """Adds ``rank``, the place by host, path and page_hash over all rows: range-sorted, so a large host is spread over tasks."""
    keys = ["host", "path", "page_hash"]
    spark = pages.sparkSession
    line = stored(pages.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "by-url")
    counts = {r["b"]: r["n"] for r in line.groupBy(F.shiftright("at", 33).alias("b")).agg(F.count("*").alias("n")).collect()}
    starts, total = [0], 0
    for b in range(max(counts, default=-1) + 1):
        starts.append(total := total + counts.get(b, 0))
    rank = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.shiftright("at", 33).cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1)
    return line.withColumn("rank", rank).drop("at")


def shared_lines(own: tuple[list[int], list[int]], near: list[list[int]]) -> set[int]:
    """Places of the template's lines in a page of (line hashes, line lengths), given its neighbours' hashes, nearest first.

    The nearest neighbour that shares no more than ``COPY_SHARE`` of the text shows the template. If all share more, the page
    is short or they are copies: then lines that two neighbours share are template, unless that leaves nothing.
    """
    hashes, sizes = own
    most, votes = COPY_SHARE * sum(sizes), Counter()
    for other in near:
        shared = common_lines(hashes, other)
        if sum(sizes[i] for i in shared) <= most:
            return shared
        votes.update(shared)
    template = {i for i, n in votes.items() if n > 1}
    return template if len(template) < len(hashes) else set()


def template_lines(pages: DataFrame) -> DataFrame:
    """(host, page_hash, shared): places of the lines that a page shares with its nearest different neighbours by URL.

    Equal pages of a host are one row here. Only hashes of lines travel. Each block of ranks also gets the rows beside it, so
    a task holds one block, whatever the size of a host.
    """
    hashed = F.transform("lines", lambda t: F.xxhash64(t))
    sizes = F.transform("lines", lambda t: F.char_length(t))
    rows = pages.filter(F.size("lines") > 0).select("host", "path", "page_hash", F.struct(hashed.alias("hashes"), sizes.alias("sizes")).alias("page"))
    one = rows.groupBy("host", "page_hash").agg(F.min_by("page", "path").alias("page"), F.min("path").alias("path"))
    by_url = ranked(one.select("host", "path", "page_hash", "page.*"))
    block = F.floor(F.col("rank") / BLOCK_PAGES)
    around = F.array_distinct(F.array(*[F.floor((F.col("rank") + d) / BLOCK_PAGES) for d in (-NEIGHBOURS, 0, NEIGHBOURS)]))

    def compare(key: tuple, own: pa.Table) -> pa.Table:
        rows = own.sort_by("rank").to_pylist()
        out = []
        for k, row in enumerate(rows):
            if row["rank"] // BLOCK_PAGES != key[0].as_py():
                continue
            beside = [(common_prefix(row["path"], x["path"]), -abs(x["rank"] - row["rank"]), x["rank"], x["hashes"]) for x in rows[max(0, k - NEIGHBOURS) : k + NEIGHBOURS + 1] if x["rank"] != row["rank"] and x["host"] == row["host"]]
            shared = shared_lines((row["hashes"], row["sizes"]), [x[3] for x in sorted(beside, key=lambda x: (-x[0], -x[1], x[2]))])
            if shared:
                out.append((row["host"], row["page_hash"], sorted(shared)))
        types = (pa.string(), pa.int64(), pa.list_(pa.int32()))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["t_host", "t_hash", "shared"])

    spread = by_url.withColumn("block", F.explode(around)).filter("block >= 0")
    return stored(spread.groupBy("block").applyInArrow(compare, "t_host string, t_hash long, shared array<int>"), "template")


def common_prefix(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_template, n_restored, n_dropped) of every page row: its blocks less those its nearest different
    neighbours share; where an article is marked, checked to be the article's. Joined by one space; character references decoded.

    n_template: blocks that differencing deletes; n_restored: those of them that the check puts back; n_dropped: blocks that it
    takes out. Null or empty html gives the empty text. A host with one page, or with copies of one page only, has no neighbour to
    differ from and keeps its open lines. Rows that repeat get the same text; broken or deeply nested pages take time in proportion
    to their length. The deleted places are broadcast if they have been counted to be few, else joined by shuffle.
    """
    small_batches(pages.sparkSession)
    found = outlines(pages)
    template = template_lines(found)
    side = F.broadcast(template) if template.count() <= BROADCAST_ROWS else template
    found = found.join(side, (F.col("host") == F.col("t_host")) & (F.col("page_hash") == F.col("t_hash")), "left")
    shared = F.coalesce("shared", F.array().cast("array<int>"))
    cut = lambda i: F.array_contains(shared, i)
    outside = lambda i: F.col("marked") & (F.get("places", i) != 2)
    inside = lambda i: F.col("marked") & (F.get("places", i) == 2)
    count = lambda rule: F.size(F.filter("lines", lambda t, i: rule(i))).cast("long")
    text = F.array_join(F.filter("lines", lambda t, i: inside(i) | ~cut(i) & ~outside(i)), " ")
    counts = {"n_template": cut, "n_restored": lambda i: cut(i) & inside(i), "n_dropped": lambda i: ~cut(i) & outside(i)}
    out = found.select("page_id", "url", text.alias("text"), *[count(rule).alias(name) for name, rule in counts.items()])
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), *counts)
