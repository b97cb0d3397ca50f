"""Main text of web pages, by differencing with the pages of the nearest URLs and by the page's own containers.

A page is read into lines (blocks of text). Menus, headers, footers, asides, forms, notices, adverts,
comments and the like are left out by element, role and class; so is an article within an article, which is
a reader's comment. Every page is paired with the pages of its host whose paths are nearest in order, before
and after; lines are aligned by longest common subsequence, and the shared lines, which belong to the site
and not to the page, are deleted. An exact check follows: where the page marks its article (or main)
element, the text is the lines of that element, none of which is taken for the site's (two copies of one
article share all of them) and beside which no other line is main text.

Cases: null html has no text; markup that ends early or nests wrongly is read as far as it goes; very long
pages are read in one pass, and lines are aligned with bit vectors (lines times lines / 64 steps, memory by
the root of that); a page whose neighbours are all copies of it keeps its lines; a page alone in its host
likewise; a null url or one without a host has no neighbours; ties in the path order are settled by url,
page_id and a digest of the html; rows equal in all of these get equal texts; repeated rows stay; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinspark.llm._common import text_or_empty
from kinspark.llm.bpe import in_groups
from kinspark.llm.url_filter import host_of, path_of

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag. A quote opens a value only after an equals sign.
REST = re.compile(r"((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]|=)*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
HUMP = re.compile(r"([a-z\d])([A-Z])")
RAW = {"script", "style", "textarea", "title", "template", "iframe", "noscript", "svg", "math", "object", "canvas", "xmp"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOISE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "head", "figure-ad"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?:ads?|adverts?|advertisement|banner|sidebar|side-bar|cookies?|consent|notice|comments?|replies|respond|disqus|menu|navbar|nav|navigation|topbar|top-bar|site-header|page-header|breadcrumbs?|footer|masthead"
    r"|share|sharing|social|related|recommended|promo|popup|modal|newsletter|subscribe|signup|login|sponsor(?:ed)?|widget|pagination|pager|skip-link)(?=$|[\s_-]|\d)"
)
#: Of an article or main element, only names of this kind count: a class such as "news-with-sidebar" is no noise there.
COMMENT_NAME = re.compile(r"(?:^|\s)(?:(?:user|reader|blog|post|the)[_-])?(?:comments?|reply|replies|respond|disqus)(?=$|[\s_-]|\d)")
COPY_SHARE = 0.8


def _is_noise(rest: str, own: bool) -> bool:
    """Whether attributes say that an element is no content; ``own`` for article and main."""
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), HUMP.sub(r"\1-\2", value.strip("\"'")).lower()
        if key in ("class", "id"):
            if (COMMENT_NAME if own else NOISE_NAME).search(value):
                return True
        elif (key == "role" and value in ROLES) or (key == "hidden" and not value) or (key == "aria-hidden" and value == "true"):
            return True
    return False


def read_page(page: str | None) -> tuple[list[str], list[bool]]:
    """The lines of a page in order, without elements that are no content, and whether each is inside an article (or main).

    One pass: each character is looked at a fixed number of times, however tags nest or end.
    """
    lines: list[str] = []
    inside: list[bool] = []
    if not page:
        return lines, inside
    stack: list[tuple[str, bool, bool]] = []  # name, noise, content
    open_names: Counter = Counter()
    noise, content, at, parts = 0, 0, 0, []

    def flush() -> None:
        if parts:
            line = " ".join(entities.unescape("".join(parts)).split())
            if line:
                lines.append(line)
                inside.append(content > 0)
            parts.clear()

    def leave() -> str:
        nonlocal noise, content
        was, bad, own = stack.pop()
        open_names[was] -= 1
        noise -= bad
        content -= own
        return was

    size, last, quotes = len(page), page.rfind(">"), True
    while at < size:
        found = page.find("<", at)
        if found < 0 or found > last:
            if not noise:
                parts.append(page[at:])
            break
        if found > at and not noise:
            parts.append(page[at:found])
        if page.startswith("<!--", found):
            end = page.find("-->", found + 4)
            at = end + 3 if end >= 0 else size
            continue
        named = NAME.match(page, found + 1)
        if not named:
            if page[found + 1 : found + 2] in ("!", "?", "/"):
                at = page.find(">", found) + 1
            else:
                at = found + 1
                if not noise:
                    parts.append("<")
            continue
        tail = REST.match(page, named.end()) if quotes else None
        if tail:
            rest, at = tail[1], tail.end()
        else:  # every > that follows is within quotes: from here on quotes are plain characters
            quotes = False
            at = page.find(">", named.end()) + 1
            rest = page[named.end() : at - 1]
        closing, name = named[1], named[2].lower()
        if not closing:
            if name in RAW:
                if rest.endswith("/"):
                    continue
                close = RAW_END[name].search(page, at)
                at = close.end() if close else size
                if name not in INLINE and not noise:
                    parts.append(" ")
                continue
            if name not in INLINE:
                flush()
            if name in VOID or rest.endswith("/"):
                continue
            if name == "p" and stack and stack[-1][0] == "p":
                leave()
            own = name in ("article", "main")
            bad = name in NOISE or (name == "header" and not content) or (name == "article" and open_names["article"] > 0)
            if rest and not bad and name not in ("body", "html"):
                bad = _is_noise(rest, own)
            own = own and not noise and not bad
            stack.append((name, bad, own))
            open_names[name] += 1
            noise += bad
            content += own
        else:
            if name not in INLINE:
                flush()
            if open_names[name]:
                while leave() != name:
                    pass
    flush()
    return lines, inside


def read_lines(page: str | None) -> tuple[list[str], list[str], bool]:
    """Lines inside the article (or main) element, the other lines, and whether there is such an element."""
    lines, inside = read_page(page)
    return [x for x, own in zip(lines, inside, strict=True) if own], [x for x, own in zip(lines, inside, strict=True) if not own], any(inside)


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of both lists of lines.

    Equal ends are taken off; what is between is aligned with bit vectors, a bit for each line of ``b``. Of
    those only each isqrt(lines)-th is kept; the others are made again when the alignment is read back.
    """
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    common = {*range(start), *range(len(a) - end, len(a))}
    there = set(a[start : len(a) - end])
    places: dict[str, int] = {}
    width = 0
    for line in b[start : len(b) - end]:
        if line in there:
            places[line] = places.get(line, 0) | 1 << width
            width += 1
    rows = [i for i in range(start, len(a) - end) if a[i] in places]
    full = (1 << width) - 1
    every = isqrt(len(rows)) + 1

    def after(v: int, i: int) -> int:
        met = v & places[a[i]]
        return (v + met | v - met) & full

    kept, v = [], full
    for n, i in enumerate(rows):
        if n % every == 0:
            kept.append(v)
        v = after(v, i)
    column = width
    for block in range(len(kept) - 1, -1, -1):
        own = rows[block * every : (block + 1) * every]
        steps = [kept[block]]
        for i in own:
            steps.append(after(steps[-1], i))
        for n in range(len(own), 0, -1):
            column = (~steps[n] & ((1 << column) - 1)).bit_length()  # the last line of b that adds to the length here
            if not column:
                return common
            if steps[n - 1] >> (column - 1) & 1:  # it doesn't without this line of a
                common.add(own[n - 1])
                column -= 1
    return common


def site_lines(lines: list[str], neighbours: list[list[str]]) -> set[int]:
    """Places of the lines that are shared with a neighbour that is no copy of the page."""
    total = sum(map(len, lines))
    gone: set[int] = set()
    for other in neighbours:
        shared = shared_lines(lines, other)
        if sum(len(lines[i]) for i in shared) <= COPY_SHARE * total:
            gone |= shared
    return gone


def main_text(lines: list[str], inside: list[bool], gone: set[int]) -> str:
    """The lines that are left, after the check against the page's marks."""
    marked = any(inside)
    return " ".join(x for i, x in enumerate(lines) if (inside[i] if marked else i not in gone))


def _order(value) -> tuple:
    """Sorts nulls first, as Spark does."""
    return (False,) if value is None else (True, value)


KEY = ("host", "path", "url", "page_id", "digest")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = 512) -> DataFrame:
    """Per page ``page_id, url, text, n_chars, n_lines, n_shared``; n_shared counts the lines found to be the site's.

    Pages are sorted into contiguous ranges of (host, path, url, page_id, digest), about ``group`` pages each and
    at most as many as shuffles have partitions, so that a large host spreads over tasks. The first and last
    key of each range come to the driver; the page beyond each cut is sent to both of its sides. A range
    streams through its task, three pages at a time. Neighbours are so the same however many ranges there are.
    """
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType
    kind = id_type.simpleString()
    read = pages.select(host_of(url_col).alias("host"), path_of(url_col).alias("path"), F.col(url_col).alias("url"), F.col(id_col).alias("page_id"), F.xxhash64(F.col(html_col)).alias("digest"), text_or_empty(html_col).alias("html"))
    keys = read.where("host <> ''").select(*KEY)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // group)))
    ends = keys.repartitionByRange(parts, *KEY).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last"))
    ranges = sorted((tuple(map(_order, r["first"])), tuple(map(_order, r["last"]))) for r in ends.collect())  # a row a range
    firsts = [first for first, _ in ranges]
    after = {first: at - 1 for at, first in enumerate(firsts) if at}  # the first page of a range also goes to the one before
    before = {last: at + 1 for at, (_, last) in enumerate(ranges) if at + 1 < len(ranges)}
    width = max(1, len(ranges))
    fields = {"part": pa.int32(), "host": pa.string(), "path": pa.string(), "url": pa.string(), "page_id": to_arrow_type(id_type), "digest": pa.int64(), "guest": pa.bool_(), "lines": pa.list_(pa.string()), "inside": pa.list_(pa.bool_())}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = 0
        for batch in in_groups(batches, 5, 8_000_000):
            out = []
            for key, page in zip(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True), batch.column(5), strict=True):
                lines, inside = read_page(page.as_py())
                if key[0]:
                    own = tuple(map(_order, key))
                    out.append((bisect_right(firsts, own) - 1, *key, False, lines, inside))
                    out += [(to[own], *key, True, lines, inside) for to in (after, before) if own in to]
                else:
                    alone += 1
                    out.append((alone % width, *key, False, lines, inside))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), fields.values(), strict=True)], names=list(fields))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(batch.num_rows):
                    yield tuple(batch.column(i)[at].as_py() for i in range(len(fields)))
            yield None

        names = ["page_id", "url", "text", "n_lines", "n_shared"]
        kinds = [fields["page_id"], pa.string(), pa.string(), pa.int64(), pa.int64()]
        earlier = now = None
        out: list[tuple] = []
        for later in rows():
            if now is not None and not now[6]:
                near = [x[7] for x in (earlier, later) if x is not None and now[1] and x[:2] == now[:2]]
                gone = site_lines(now[7], near)
                out.append((now[4], now[3], main_text(now[7], now[8], gone), len(now[7]), len(gone)))
            earlier, now = now, later
            if len(out) >= 500 or now is None and out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []

    shape = f"part int, host string, path string, url string, page_id {kind}, digest long, guest boolean, lines array<string>, inside array<boolean>"
    dealt = read.mapInArrow(parse, shape).repartitionById(width, "part").sortWithinPartitions("part", *KEY)
    found = dealt.mapInArrow(pair, f"page_id {kind}, url string, text string, n_lines long, n_shared long")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
