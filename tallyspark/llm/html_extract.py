"""Main text of web pages by nearest-URL page differencing.

1. Each page is cut into blocks of text.  Blocks inside scripts, styles, menus,
   headers, footers, sidebars, notices, adverts, forms and comments -- told by
   element name, role, class or id -- go.  Blocks inside an ``article`` or
   ``main`` are sure; where a page has a sure block, only sure blocks stay.
2. Each page is paired with the page nearest by URL: a page of the same host
   that shares the longest path prefix and has another text.  Per prefix only
   the first and last page by a hash are offered as partners (two aggregates),
   so a host with a third of all pages is not gathered anywhere.  If the
   partner is a copy, the next shorter prefix's is asked.
3. The lines of the two pages are aligned by longest common subsequence, and
   the shared lines are deleted: they are the template.  How many of the
   host's different texts have a line is counted: lines of nearly all of them
   (``COMMON``) are template lines whatever their share of the page, and a
   partner that shares most of the rest is a copy and shows no others.  The same
   text on two pages is a copy, not a template, so a sure line goes only if it
   is shared with the partner and of nearly all texts, and only if such lines
   are no more than half of the page.

Differencing alone cannot give right results on pages whose menus and notices
differ from page to page, nor on copies of one article; hence step 1.  Lines
are compared by 64-bit hashes, within a host.

Defined results: null and empty pages have an empty text; a page without a
partner (unknown or single host) keeps its unsure lines; unclosed and wrongly
nested elements end with the element around them; a boilerplate element that
is never closed ends where an article begins; character references are decoded
once, broken ones stay; white space, no-break spaces included, becomes one
space; whole pages, nothing capped; repeated rows give equal texts; an empty
table gives an empty table; extra columns pass through, and one called like an
output column is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Callable, Container, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyspark.operators.relational import salted_join

from .batches import column_slices
from .filters import bit_filter, hits
from .tables import fixed, numbered, renamed

#: HTML element names by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed"}
DROP = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "canvas", "object",
              "menu", "dialog", "audio", "video", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt",
         "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li",
         "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
         "tr", "ul", "caption"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}
#: Classes and ids that mark what is not the article.  Outside an article, a
#: part of a compound one marks it too; inside, where the text stands, only a
#: whole one does (an ``entry-header`` is the article's own).
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored",
         "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header",
         "masthead", "footer", "sidebar", "aside", "widget", "cookie", "cookies", "consent", "gdpr", "notice",
         "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search",
         "form", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus",
         "replies", "pagination", "pager", "toolbar", "skip", "copyright"}
#: An opening tag of the second kind ends an open element of the first.
ENDED_BY = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
            "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
ENDING = set().union(*ENDED_BY.values())

#: A comment, declaration or tag.  No part gives back what it took, and quotes
#: that do not close are ordinary characters, so a page is read in one go.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)"
                  r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>", re.S)
_COMMENT = re.compile(r"<!--()()().*", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Bits of alignment rows held at once, and the parts that more rows are cut in.
_MOST_CELLS = 400_000_000
_PARTS = 16
#: Bits of the filter of pages that lose lines.
FILTER_BITS = 1 << 23
#: A line that this share of a host's different texts has (of so many texts at
#: least) is its template, whatever its share of a page.
COMMON, LEAST_TEXTS = 0.9, 3
#: Hosts, lines, prefixes and partners with so many rows are dealt over
#: ``SALTS`` tasks each; at most ``HOT_KEYS`` of a kind are, the largest.
HOT_ROWS, HOT_KEYS, SALTS = 20_000, 10_000, 64


def _boilerplate(name: str, attributes: str, sure: bool) -> bool:
    if name in DROP or (name == "header" and not sure):
        return True
    if not attributes.strip():
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            if not MARKS.isdisjoint(value.split() if sure else re.split(r"[^a-z]+", value)):
                return True
    return name == "article" and "comment" in attributes.lower()


def blocks_of(page: str | None) -> list[tuple[str, bool]]:
    """The text blocks of a page and whether each is sure."""
    page = page or ""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, sure
    opened: dict[str, int] = defaultdict(int)

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((text, bool(stack) and stack[-1][2]))
        held.clear()

    def leave(depth: int) -> None:
        for name, dropped, _ in reversed(stack[depth:]):
            if name in BLOCK and not dropped:
                flush()
            opened[name] -= 1
            stack.pop()

    pos, last = 0, page.rfind(">")
    while pos <= len(page):
        # After the last ">" only an unclosed comment can follow.
        tag = _TAG.search(page, pos) if pos <= last else _COMMENT.search(page, pos)
        text = page[pos:tag.start() if tag else len(page)]
        dropped = bool(stack) and stack[-1][1]
        if text and not dropped:
            held.append(entities.unescape(text))
        if not tag:
            break
        pos = tag.end()
        closing, name, attributes = tag[1], (tag[2] or "").lower(), tag[3] or ""
        if not name:
            continue
        if closing:
            if opened[name]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in ("article", "main") and dropped and not any(s[2] for s in stack) and "comment" not in \
                attributes.lower():
            # An unclosed menu or notice does not swallow the article.
            leave(next(k for k, s in enumerate(stack) if s[1]))
            dropped = False
        if name in VOID:
            if not dropped:
                if name in BLOCK:
                    flush()
                else:
                    held.append(" " if name == "br" else "")
            continue
        for k in range(len(stack) - 1, -1, -1) if name in ENDING else ():
            if stack[k][0] in ENDED_BY and name in ENDED_BY[stack[k][0]]:
                leave(k)
                break
            if stack[k][0] in BLOCK or stack[k][0] in DROP:
                break
        sure = bool(stack) and stack[-1][2]
        gone = bool(stack) and stack[-1][1] or _boilerplate(name, attributes, sure)
        if not gone and name in BLOCK or gone and not dropped and name not in RAW:
            flush()
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        opened[name] += 1
        stack.append((name, gone, not gone and (sure or name in ("article", "main"))))
    leave(0)
    flush()
    return out


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Places in ``mine`` that a longest common subsequence with ``other`` uses."""
    start = 0
    while start < min(len(mine), len(other)) and mine[start] == other[start]:
        start += 1
    a, b = len(mine), len(other)
    while a > start and b > start and mine[a - 1] == other[b - 1]:
        a, b = a - 1, b - 1
    used = set(range(start)) | set(range(a, len(mine)))
    x, y = mine[start:a], other[start:b]
    if not x or not y:
        return used
    # Lines of one page only are in no common subsequence.
    both = set(x) & set(y)
    at = [start + i for i, line in enumerate(x) if line in both]
    x, y = [line for line in x if line in both], [line for line in y if line in both]
    if not both:
        return used
    # Bit-parallel: bit j of a row is 0 where the LCS grows at y[j].
    where: dict[str, list[int]] = defaultdict(list)
    for j, line in enumerate(y):
        where[line].append(j)

    @lru_cache(max(1, _MOST_CELLS // len(y)))
    def places(line: str) -> int:
        if len(where[line]) == 1:
            return 1 << where[line][0]
        bits = bytearray(len(y) // 8 + 1)
        for j in where[line]:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    def after(row: int, line: str, full: int) -> int:
        match = row & places(line)
        return (row + match | row - match) & full

    def back(first: int, top: int, i: int, j: int) -> int:
        """Goes back from row ``i`` to row ``first``, whose value is ``top``,
        and returns the column reached.  If all rows between are too many to
        hold, one in each of ``_PARTS`` parts is held and the others
        are computed again."""
        if not j or i == first:
            return j
        full = (1 << j) - 1
        top &= full
        step = 1 if (i - first) * j <= _MOST_CELLS else -(-(i - first) // _PARTS)
        rows, row = [top], top
        for k in range(first, i):
            row = after(row, x[k], full)
            if (k + 1 - first) % step == 0 or k + 1 == i:
                rows.append(row)
        if step > 1:
            for k in range(len(rows) - 2, -1, -1):
                begin = first + k * step
                j = back(begin, rows[k], min(begin + step, i), j)
            return j
        while i > first and j:
            bit = 1 << (j - 1)
            if rows[i - first] & bit:  # y[j - 1] adds nothing here
                j -= 1
            elif rows[i - first - 1] & bit:
                used.add(at[i - 1])
                i, j = i - 1, j - 1
            else:
                i -= 1
        return j

    back(0, (1 << len(y)) - 1, len(x), len(y))
    return used


def main_text(blocks: list[str], sure: list[bool], gone: Container[int] | None) -> str:
    """The blocks that stay, joined by newlines: the sure ones if there are
    any, without those at the places ``gone``."""
    if any(sure):
        blocks = [b for b, s in zip(blocks, sure) if s]
    return "\n".join(b for i, b in enumerate(blocks) if not gone or i not in gone)


def template_lines(lines: list[int], sizes: list[int], sure: bool, common: set[int], other: list[int]
                   ) -> tuple[bool, list[int]]:
    """Whether the page ``other`` is a copy, and the places of ``lines`` that
    go; ``common`` are lines of nearly all texts of the host."""
    def size(places: set[int]) -> int:
        return sum(sizes[i] for i in places)

    shared = shared_lines(lines, other)
    top = {i for i, line in enumerate(lines) if line in common}
    copy = 2 * size(shared - top) > sum(sizes) - size(top)
    if not sure:
        return copy, sorted(top if copy else top | shared)
    gone = shared & top
    return copy, sorted(gone) if 2 * size(gone) <= sum(sizes) else []


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def _prefixes(url: Column) -> Column:
    """Host, then host with each further path segment, then with each further
    character of the last segment."""
    host = _host(url)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*/*([^?#]*?)/*(?:[?#].*)?$", 1)
    parts = F.split(path, "/+")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat_ws(
        "/", host, F.array_join(F.slice(parts, 1, k), "/")))
    last = F.element_at(parts, -1)
    chars = F.when(F.length(last) > 0, F.transform(F.sequence(F.lit(1), F.length(last)), lambda k: F.concat_ws(
        "/", host, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"), last.substr(F.lit(1), k))))
    both = F.concat(levels, F.coalesce(chars, F.array().cast("array<string>")))
    return F.when(host != "", both)


def _spread(many: DataFrame, one: DataFrame, on: list[str], by: str, counts: DataFrame) -> DataFrame:
    """``many`` joined with ``one``, a row per key.  ``counts`` has the ``rows``
    of the first of ``on``: rows of keys with very many are dealt by a hash of
    ``by``, and their row of ``one`` is copied.  A key left out by the limit has
    fewer rows than each of ``HOT_KEYS`` others."""
    hot = counts.where(F.col("rows") >= HOT_ROWS).orderBy(F.desc("rows")).limit(HOT_KEYS).select(
        F.lit(on[0]).alias("kind"), F.col(on[0]).alias("key"))
    return salted_join(many, one.drop("rows"), on, salts=SALTS, spread=[by], hot=hot)


def _offers(pages: DataFrame, asking: DataFrame) -> DataFrame:
    """``pk``, ``depth``, ``partner``: for each prefix of the url of an asking
    page a page below it that has another text."""

    def levels(some: DataFrame) -> DataFrame:
        return (some.select("pk", "url", "content").distinct()
                .select("pk", "content", F.posexplode(_prefixes(F.col("url"))))
                .select("pk", "content", F.col("pos").alias("depth"), F.xxhash64("col").alias("prefix")))

    one = F.struct("content", "pk")
    ends = fixed(levels(pages).groupBy("prefix").agg(
        F.min(one).alias("low"), F.max(one).alias("high"), F.count(F.lit(1)).alias("rows"))
                 .where("low.content <> high.content"))
    return _spread(levels(asking), ends, ["prefix"], "pk", ends).select("pk", "depth", F.when(
        F.col("high.content") != F.col("content"), F.col("high.pk")).otherwise(F.col("low.pk")).alias("partner"))


def nearest(pages: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """``pk``, ``partner`` from ``pk``, ``url`` and ``content``, a hash of the
    page's text: a page with the same text is no partner.  ``asking`` are the
    pages (rows of ``pages``) that want one, by default all."""
    return _offers(pages, pages if asking is None else asking).groupBy("pk").agg(
        F.max_by("partner", "depth").alias("partner"))


def _asking(known: DataFrame) -> DataFrame:
    """The pages of ``known`` that can lose a line -- one that another text of
    the host has, or that nearly all have if the lines are sure -- and
    ``common``, their lines that nearly all texts of the host have."""
    hosted = known.where(F.size("lines") > 0).withColumn("host", F.xxhash64(_host(F.col("url")))).where(
        _host(F.col("url")) != "")
    texts = fixed(hosted.groupBy("host").agg(
        F.count_distinct("content").alias("texts"), F.sum(F.size("lines")).alias("rows")))
    lines = (hosted.select("host", "content", F.explode("lines").alias("line")).groupBy("host", "line")
             .agg(F.count_distinct("content").alias("n"), F.count(F.lit(1)).alias("times")).where("n > 1"))
    shared = fixed(_spread(lines, texts, ["host"], "line", texts).select("line", "host", (
        (F.col("texts") >= LEAST_TEXTS) & (F.col("n") >= COMMON * F.col("texts"))).alias("common"),
        F.col("times").alias("rows")))
    mine = hosted.select("pk", "host", "sure", F.explode(F.array_distinct("mine")).alias("line"))
    found = _spread(mine, shared, ["line", "host"], "pk", shared).where("common or not sure").groupBy("pk").agg(
        F.collect_set(F.when(F.col("common"), F.col("line"))).alias("common"))
    return known.join(found, "pk")


def _deletions(known: DataFrame) -> DataFrame:
    """``_pk`` and ``_gone``, the places of the lines that go, for the pages
    that lose any."""
    asking = fixed(_asking(known))
    offers = fixed(_offers(known.where(F.size("lines") > 0), asking).groupBy("pk", "partner").agg(
        F.max("depth").alias("depth")))
    other = known.select(F.col("pk").alias("partner"), F.col("lines").alias("other"))
    pairs = _spread(offers.join(asking.select("pk", "sure", "mine", "sizes", "common"), "pk"), other, ["partner"], "pk",
                    offers.groupBy("partner").agg(F.count(F.lit(1)).alias("rows")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                found = [template_lines(mine, sizes, sure, set(common), other) for mine, sizes, sure, common, other in
                         zip(*(batch.column(c).to_pylist() for c in ("mine", "sizes", "sure", "common", "other")))]
                depths = batch.column("depth").to_pylist()
                # A copy counts after all others: the next shorter prefix decides.
                yield pa.RecordBatch.from_arrays(
                    [batch.column("pk"), pa.array([d - (1 << 30) if f[0] else d for f, d in zip(found, depths)], pa.int32()),
                     pa.array([f[1] for f in found], pa.list_(pa.int32()))], names=["pk", "depth", "gone"])

    return (pairs.mapInArrow(run, "pk long, depth int, gone array<int>").groupBy(F.col("pk").alias("_pk"))
            .agg(F.max_by("gone", "depth").alias("_gone")).where(F.size("_gone") > 0))


def _parsed(pages: DataFrame, html_col: str, keep: list[str], new: list[T.StructField],
            row: Callable[[list[tuple[str, bool]]], tuple],
            wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``keep`` and the ``new`` columns that ``row`` makes of a page's blocks;
    pages whose ``_pk`` is not ``wanted`` are left out."""
    schema = T.StructType([pages.schema[c] for c in keep] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(T.StructType(new)).types
        for whole in batches:
            if wanted:
                whole = whole.filter(pa.array(wanted(np.asarray(whole.column("_pk")))))
            for batch in column_slices(whole, html_col, 4 << 20):
                made = [row(blocks_of(page)) for page in batch.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in keep] + [pa.array([m[k] for m in made], t) for k, t in enumerate(types)],
                    names=schema.fieldNames())

    return pages.mapInArrow(run, schema)


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``pages`` without its html, with ``text``.

    Of each page only hashes of its lines are kept and compared; pages that
    lose a line by the comparison (told by a bit filter, then exactly) are
    shuffled to meet it.  The pages are read again rather than stored.
    """
    columns = [c for c in pages.columns if c not in (html_col, "text")]
    pages, new = numbered(pages)
    html_col, url_col, keep = new(html_col), new(url_col), [new(c) for c in columns]
    # Equal pages share a key: they get the same partner and text.
    rows = pages.withColumn("_pk", F.xxhash64(url_col, html_col))
    strings, text = T.ArrayType(T.StringType()), T.StructField("text", T.StringType())
    hashes, numbers = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())

    def digest(line: str) -> int:
        return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)

    def candidates(blocks):
        return [b for b, s in blocks if s] or [b for b, _ in blocks]

    def facts(blocks):
        mine = candidates(blocks)
        return (digest("\n".join(mine)), any(s for _, s in blocks), [digest(b) for b, _ in blocks],
                [digest(b) for b in mine], [len(b) for b in mine])

    known = fixed(_parsed(
        rows.select("_pk", F.col(url_col).alias("url"), html_col), html_col, ["_pk", "url"],
        [T.StructField("content", T.LongType()), T.StructField("sure", T.BooleanType()),
         T.StructField("lines", hashes), T.StructField("mine", hashes), T.StructField("sizes", numbers)],
        facts).withColumnRenamed("_pk", "pk").dropDuplicates(["pk"]))
    answers = fixed(_deletions(known))
    shared = pages.sparkSession.sparkContext.broadcast(bit_filter(answers.select(F.col("_pk").alias("h")), FILTER_BITS))

    def changed(keys: np.ndarray) -> np.ndarray:
        return hits(keys.view(np.uint64), shared.value, FILTER_BITS)

    whole = _parsed(rows, html_col, keep, [text], lambda blocks: ("\n".join(candidates(blocks)),),
                    lambda keys: ~changed(keys))
    cut = _parsed(rows, html_col, [*keep, "_pk"], [T.StructField("_blocks", strings)],
                  lambda blocks: (candidates(blocks),), changed).join(answers, "_pk", "left")
    out = T.StructType([pages.schema[c] for c in keep] + [text])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = [main_text(blocks, [], gone and set(gone)) for blocks, gone in zip(
                    batch.column("_blocks").to_pylist(), batch.column("_gone").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep]
                                                 + [pa.array(texts, pa.string())], names=out.fieldNames())

    done = whole.unionByName(cut.mapInArrow(finish, out))
    return done.select(*renamed(done, columns, new), "text")
