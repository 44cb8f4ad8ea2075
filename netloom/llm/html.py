"""Main text of web pages: structure first, and differencing against the page with the nearest URL.

A page is read as blocks: runs of text between block elements. Menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles, hidden parts and reader comments are known by element, role
or class (whole class tokens; never for the page, an ``article`` or ``main`` or what contains one, and
inside these for groups only, not for paragraphs, sections and text). With what is left, every page is
compared with the page of its host whose path comes next to its own in path order and shares the longer
prefix: their blocks are aligned by a longest common subsequence, and blocks in it (the site's frame) are
deleted. The page's own structure checks this: shared blocks inside an ``article`` or ``main`` element (passages
that two articles quote) are put back. Blocks around it that the neighbour does not have are the page's own and stay.

Only keys (host, path, row key) are sorted to find neighbours, by range, so one host may hold any share
of the pages: neighbours across the border of two ranges come from a table with one row per range.
Pages are compared by 64-bit digests of their blocks; their blocks move once, packed, to meet the places that are shared.

Edge cases: a NULL or empty page has the empty text; without a URL, or alone on its host, a page is
compared with nothing, and structure alone decides (the text of ``article`` or ``main`` if there is any); equal pages at one URL are one page for the pairing and get the same text; a page is
not compared with a copy of itself at the next URL, since everything would be shared; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

from pyspark.sql import DataFrame, Window, functions as F

from netloom.llm.common import map_rows, written
from netloom.session import cut_lineage

_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!{_ATTRS}>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})>", re.S)
ATTR = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")

# Elements by what they mean.
RAW = frozenset("script style textarea title noscript template iframe svg select option object xmp".split())
DROPPED = RAW | frozenset("head nav footer aside form button dialog input label fieldset menu annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small "
                   "span strike strong sub sup time tt u var wbr "
                   "math semantics mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msub msup msubsup munder mover "
                   "munderover mmultiscripts mpadded menclose mfenced mtable mtr mtd".split())
#: Inside the main element only these are dropped by class: other elements there hold the text itself.
GROUPS = frozenset("div ul ol".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                  "toolbar".split())
# Whole class tokens and ids: "has-sidebar" or "comments-open" say something about a page, not what an element is.
FRAME_CLASS = re.compile(
    r"(?<!\S)(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebars?|footers?|cookies?"
    r"|consent|gdpr|notices?|popups?|modals?|newsletters?|subscribe|shar(?:e|ing)|social|related|recommended"
    r"|comments?|respond|replies|widgets?|login|signup|search)(?!\S)", re.I)
HEADER_CLASS = re.compile(r"(?<!\S)(?:header|masthead|topbar)(?!\S)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _dropped(tag: str, attrs: str, in_main: bool, by_class: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_main:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    values = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attrs)}
    if by_class and tag not in MAIN and tag not in ("html", "body") and (not in_main or tag in GROUPS):
        names = f"{values.get('class', '')} {values.get('id', '')}"
        if FRAME_CLASS.search(names) or not in_main and HEADER_CLASS.search(names):
            return True
    return bool(values.get("role", "").lower() in ROLES or "hidden" in values
                or values.get("aria-hidden", "").lower() == "true" or HIDDEN.search(values.get("style", "")))


def blocks(page: str) -> Iterator[tuple[bool, str]]:
    """(inside the main element, text) of each block that is not part of a known frame."""
    holders: set[int] = set()
    for _ in _blocks(page, holders, True):
        pass
    yield from _blocks(page, holders, False)


def _blocks(page: str, holders: set[int], first: bool) -> Iterator[tuple[bool, str]]:
    """`blocks`; ``holders``: where elements with a main element inside begin, which the first pass notes."""
    opened: list[tuple[str, bool, bool, int]] = []  # (tag, dropped, main, place) of the elements that are open
    dropped = main = False
    parts: list[str] = []
    at = 0

    def flush():
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        return text

    while at < len(page):
        found = TOKEN.search(page, at)
        if not first and not dropped and (end := found.start() if found else len(page)) > at:
            parts.append(page[at:end])
        if not found:
            break
        at = found.end()
        close, tag, attrs = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            continue
        was_main = main
        if close:
            if not any(x[0] == tag for x in opened):
                continue
            while opened.pop()[0] != tag:
                pass
        elif tag in VOID:
            if tag != "img" and tag != "wbr" and not dropped and (text := flush()):
                yield main, text
            continue
        else:
            if tag not in INLINE:                  # a block ends an open paragraph
                for i in range(len(opened) - 1, -1, -1):
                    if opened[i][0] == "p":
                        del opened[i:]
                        break
                    if opened[i][0] not in INLINE:
                        break
            _, out, inside, _ = opened[-1] if opened else ("", False, False, 0)
            out = out or _dropped(tag, attrs, inside, not first and at not in holders)
            if first and tag in MAIN and not out:
                holders.update(x[3] for x in opened)
            opened.append((tag, out, inside or tag in MAIN and not out, at))
            if tag in RAW and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.start() if end else len(page)
        _, dropped, main, _ = opened[-1] if opened else ("", False, False, 0)
        if tag not in INLINE and (text := flush()):
            yield was_main, text
    if text := flush():
        yield main, text


def checked(found: list[tuple[bool, str]], shared: set[int] | None) -> tuple[str, int]:
    """Text without the shared blocks, and how many of these the main element put back; None: compared with nothing."""
    if shared is None:
        main = [text for inside, text in found if inside]
        return " ".join(main or [text for _, text in found]), 0
    return " ".join(text for i, (inside, text) in enumerate(found) if inside or i not in shared), sum(found[i][0] for i in shared)


def main_text(page: str, other: str | None = None) -> str:
    """The text of a page beside another one of its host."""
    found, shared = list(blocks(page)), None
    if other is not None and other != page:
        shared = common_lines([text for _, text in found], [text for _, text in blocks(other)])
    return checked(found, shared)[0]


def digests(page: str) -> list[int]:
    """64 bits for each block's text."""
    return [int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True) for _, text in blocks(page)]


def common_lines(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence, by rows of bits."""
    places: dict = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    wanted = [i for i, line in enumerate(a) if line in places]
    full, row = (1 << len(b)) - 1, (1 << len(b)) - 1   # a 0 bit is a place where the length grows
    rows = [row]
    for i in wanted:
        match = row & places[a[i]]
        row = (row + match | row - match) & full
        rows.append(row)
    taken, j = set(), len(b) - 1
    for k in range(len(wanted) - 1, -1, -1):
        # longest at (k + 1, j) beyond that at (k, j): line k is in the subsequence
        low = (1 << j + 1) - 1
        if ((~rows[k + 1] & low).bit_count()) > ((~rows[k] & low).bit_count()):
            hits = places[a[wanted[k]]] & low
            taken.add(wanted[k])
            j = hits.bit_length() - 1
            while j >= 0 and (~rows[k] & (1 << j) - 1 & full).bit_count() + 1 < (~rows[k + 1] & low).bit_count():
                hits &= (1 << j) - 1
                j = hits.bit_length() - 1
            j -= 1
            if j < 0:
                break
    return taken


HOST, PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def neighbours(keys: DataFrame) -> DataFrame:
    """key, before and after: the rows next to each (host, path, key) of the same host, in that order."""
    order = ["host", "path", "key"]
    ranges = cut_lineage(keys.select(*order).distinct().repartitionByRange(*order)
                         .withColumn("range", F.spark_partition_id()))
    here = Window.partitionBy("range").orderBy(*order)
    row = F.struct(*order)
    ends = ranges.groupBy("range").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    next_to = Window.orderBy("range")                   # one row per range
    borders = ends.select("range", F.lag("last").over(next_to).alias("earlier"), F.lead("first").over(next_to).alias("later"))
    joined = (ranges.withColumns({"lag": F.lag(row).over(here), "lead": F.lead(row).over(here)})
              .join(borders, "range")
              .withColumns({"lag": F.coalesce("lag", "earlier"), "lead": F.coalesce("lead", "later")}))
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(c))
    return joined.select("key", "path", same("lag").alias("before"), same("lead").alias("after"))


def _common(a: str | None, b: str | None) -> int:
    n = 0
    for x, y in zip(a or "", b or ""):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; n_shared: blocks in common with the neighbour, n_restored: those put back."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({
        # the digest of the page leads its key, so that copies are told by their keys
        "key": F.struct(F.xxhash64("html").alias("page"), F.xxhash64("url").alias("url")),
        "host": F.lower(F.regexp_extract("url", HOST, 1)), "path": F.regexp_extract("url", PATH, 1)})

    def listed():
        return lambda host, path, page_key, url_key, page: [(host, path, {"page": page_key, "url": url_key}, digests(page))]
    known = written(map_rows(
        keyed.where(F.coalesce(F.col("host"), F.lit("")) != "").select("host", "path", "key.page", F.col("key.url").alias("u"), "html"),
        "host string, path string, key struct<page: bigint, url: bigint>, lines array<bigint>", listed).dropDuplicates(["key"]))
    pairs = neighbours(known).select(
        "key", "path", F.col("before.path").alias("path_before"), F.col("after.path").alias("path_after"),
        F.col("before.key").alias("before"), F.col("after.key").alias("after"))
    common = F.udf(_common, "int", useArrow=False)
    pairs = pairs.withColumns({c: F.when(F.col(c)["page"] != F.col("key")["page"], F.col(c)) for c in ("before", "after")})
    closer = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).otherwise(
        F.when(common("path", "path_after") > common("path", "path_before"), F.col("after")).otherwise(F.col("before")))
    given = (pairs.select("key", closer.alias("near")).join(known.select("key", "lines"), "key")
             .join(known.select(F.col("key").alias("near"), F.col("lines").alias("other")), "near"))

    def aligned():
        return lambda page, url, own, other: [({"page": page, "url": url}, sorted(common_lines(own, other)))]
    shared = written(map_rows(given.select("key.page", "key.url", "lines", "other"),
                              "key struct<page: bigint, url: bigint>, shared array<int>", aligned))

    def packed():
        return lambda page_id, url, page_key, url_key, page: [
            (page_id, url, {"page": page_key, "url": url_key}, zlib.compress(json.dumps(list(blocks(page))).encode("ascii")))]
    parsed = map_rows(keyed.select("page_id", "url", "key.page", F.col("key.url").alias("u"), "html"),
                      "page_id bigint, url string, key struct<page: bigint, url: bigint>, blocks binary", packed)

    def compared():
        def row(page_id, url, found, places):
            text, restored = checked(json.loads(zlib.decompress(found)), None if places is None else set(places))
            return [(page_id, url, text, len(text), len(places or ()), restored)]
        return row
    # both sides grow with the pages, so neither is ever broadcast
    return map_rows(parsed.join(shared.hint("merge"), "key", "left").select("page_id", "url", "blocks", "shared"),
                    "page_id bigint, url string, text string, n_chars bigint, n_shared bigint, n_restored bigint", compared)
