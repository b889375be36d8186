"""Main text of web pages by template deduction over the pages of a host.

Tokens of a page are its block elements, told apart by their path, and its text blocks. Tokens
that occur equally often in each page of the host, so with equal
occurrence vectors, form an equivalence class. Classes with enough support whose
tokens keep their order and nest are the host's template; its elements that a page has once bound
the slots. The template's element that holds nearly all of the host's own text, deepest in
the page, is the main one, and the text in its slots is a page's main text.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import defaultdict
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, saved

#: Share of a host's distinct pages that a template token is in, and the least number of these.
SUPPORT, LEAST_PAGES = 0.5, 4
#: Bytes of templates that are sent to every task; beyond, pages and templates are joined by shuffle.
BROADCAST_BYTES = 32_000_000
#: Share of a host's text that the main element holds; share of links beyond which a slot is a menu; and rows of one batch of tokens.
HOLDS, MENU, ROWS = 0.8, 0.8, 200_000
#: What a character counts for by the names of the elements around it: they rank slots, and decide nothing alone.
HINTED, PLAIN, IN_REGION = 0.1, 1.0, 2.0

# Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template svg math canvas select object video audio".split())
NOT_TEXT = frozenset("head nav footer aside form button menu dialog fieldset dir label legend datalist option".split())
REGION = frozenset(("article", "main"))
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HINTS = frozenset(
    "ad ads advert advertisement advertisements adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu sidebar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "share sharing social related recommended breadcrumb breadcrumbs comment comments reply replies respond disqus widget masthead topbar toolbar pagination pager login signup".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_NAME = re.compile(r"[A-Za-z0-9]+")
#: Elements that are parts of a text: a main element is one around them. Fixed values.
_PART = re.compile(r"/(?:p|h[1-6]|li|dt|dd|pre|blockquote|td|th|tr|tbody|figure|figcaption|address)(?:\.[^/]*)?$")
#: An element and the innermost article or main element at or around it.
_REGION = re.compile(r"^(.*/(?:article|main)(?:\.[^/]*)?)(?:/|$)")
_HEADING = re.compile(r"/h[1-6](?:\.[^/]*)?$")
_RAW_END = {name: re.compile("</" + name, re.I | re.A) for name in RAW}


def last(path: str) -> str:
    """The innermost element of a path, with the slash before it."""
    return path[path.rfind("/") :] if path else ""


class Element:
    """An open element: its name and path, the path of the outermost hinted element around it ('' without), and whether it is in an article."""

    __slots__ = ("name", "path", "hinted", "region")

    def __init__(self, name: str, path: str, hinted: str, region: bool):
        self.name, self.path, self.hinted, self.region = name, path, hinted, region


class Block(NamedTuple):
    """A text block: its element's path, the outermost hinted element around it ('' without), whether it is in an article, and its characters in links."""

    text: str
    path: str
    hinted: str
    region: bool
    linked: int

    def weight(self) -> float:
        return HINTED if self.hinted else IN_REGION if self.region else PLAIN

    def is_menu(self) -> bool:
        return self.linked > MENU * len(self.text) and not _HEADING.search(last(self.path))


def hidden_by(attributes: str, region: bool) -> tuple[bool, str]:
    """Whether class, id, role or style mark the element as something beside the text; and its first class."""
    out, first = False, ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            names = set(_NAME.findall(value))
            out |= not HINTS.isdisjoint(names) or "header" in names and not region
            if key == "class":
                first = value.split()[0] if value.split() else ""
        elif key == "role":
            out |= value in ROLES
        elif key == "style":
            out |= "display:none" in value.replace(" ", "")
    return out, first


def parsed(page: str) -> tuple[list[str], list[Block]]:
    """Paths of the block elements in order, and text blocks, of any markup; open elements end with the page."""
    at, in_link, linked = 0, False, 0
    root = Element("", "", "", False)
    stack, frame, out, text = [root], [], [], []
    opened: defaultdict[str, int] = defaultdict(int)

    def close_block() -> None:
        nonlocal linked
        if text:
            words = entities.unescape("".join(text)).split()
            text.clear()
            if words:
                out.append(Block(" ".join(words), stack[-1].path, stack[-1].hinted, stack[-1].region, linked))
        linked = 0

    def close_from(i: int) -> None:
        for e in stack[i:]:
            opened[e.name] -= 1
        del stack[i:]

    def pop_to(names, stop=frozenset(("table", "ul", "ol", "dl", "article", "section", "div", "main", "nav", "footer", "aside"))) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                close_from(i)
                return
            if stack[i].name in stop:
                return

    while m := _TAG.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += (m.start() - at) * in_link
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            in_link = not m[1] if name == "a" else in_link
            continue
        if name == "br":
            text.append(" ")
            continue
        if m[1]:
            if name == "p" or opened[name]:
                close_block()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        close_from(i)
                        break
            continue
        close_block()
        if name in RAW:
            if not m[3].endswith("/>"):
                close = _RAW_END[name].search(page, at)
                at = close.start() if close else len(page)
                end = page.find(">", at)
                at = len(page) if end < 0 else end + 1
            continue
        if name in VOID:
            continue
        if name in ENDS_P and opened["p"]:
            pop_to({"p"})
        if name in ENDS_LIKE:
            pop_to(ENDS_LIKE[name])
        if name == "body":
            pop_to({"head"})
        around = stack[-1]
        hint, first = hidden_by(m[3], around.region) if len(m[3]) > 1 else (False, "")
        path = f"{around.path}/{name}.{first}" if first else f"{around.path}/{name}"
        hinted = around.hinted or (path if name in NOT_TEXT or hint or name == "header" and not around.region else "")
        stack.append(Element(name, path, hinted, around.region or name in REGION and not hinted))
        opened[name] += 1
        frame.append(path)
    if at < len(page):
        text.append(page[at:])
    close_block()
    return frame, out


def number(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def counted_tokens(frame: list[str], blocks) -> dict[int, list[int]]:
    """Token: how often it occurs, and its first place among the page's tokens."""
    seen: dict[int, list[int]] = {}
    for place, path in enumerate(frame):
        seen.setdefault(number("tag", path), [0, place])[0] += 1
    for place, b in enumerate(blocks):
        seen.setdefault(number("text", b.path, b.text), [0, len(frame) + place])[0] += 1
    return seen


def valid_tokens(seen: dict[int, list[int]], classes: list[list[int]]) -> set[int]:
    """Tokens of the classes that hold on this page: a class's tokens are in order, and it nests with the larger ones, so that each lies within one gap of the other."""
    taken: list[list[int]] = []
    tokens: set[int] = set()
    for own in sorted(classes, key=lambda c: (-len(c), c)):
        places = [seen[t][1] for t in own if t in seen]
        if not places or any(x >= y for x, y in pairwise(places)):
            continue
        if all(bisect(other, places[0]) == bisect(other, places[-1]) or bisect(places, other[0]) == bisect(places, other[-1]) for other in taken):
            taken.append(places)
            tokens.update(own)
    return tokens


def template_of(frame: list[str], blocks: list[Block], classes: list[list[int]] | None) -> tuple[set[str], set[int]]:
    """Paths of the template's elements that this page has once, the page itself ('') among them, and the tokens of the template. A page without a template is its own, of elements alone."""
    seen = counted_tokens(frame, blocks)
    once = {path for path in frame if seen[number("tag", path)][0] == 1}
    if not classes:
        return once | {""}, set()
    valid = valid_tokens(seen, classes)
    return {path for path in once if number("tag", path) in valid} | {""}, valid


def within(path: str, element: str) -> bool:
    return not element or path == element or path.startswith(element + "/")


def up(path: str) -> str:
    """The path of the element around an element."""
    return path.rpartition("/")[0]


def slot_of(path: str, elements: set[str], known: dict[str, str]) -> str:
    """The innermost of the elements at or around a path; '' is one. known: what was found before for this page, so that each path is climbed once."""
    climbed, at = [], path
    while at not in known:
        if at in elements:
            known[at] = at
        else:
            climbed.append(at)
            at = up(at)
    for x in climbed:
        known[x] = known[at]
    return known[path]


def slot_sums(frame: list[str], blocks: list[Block], classes: list[list[int]] | None) -> dict[str, list[float]]:
    """For each of the template's elements: the worth of the page's own text in it, and the characters, and those in links, of its own slot."""
    elements, template = template_of(frame, blocks, classes)
    sums: dict[str, list[float]] = {x: [0.0, 0.0, 0.0] for x in elements}
    known: dict[str, str] = {}
    for b in blocks:
        if number("text", b.path, b.text) in template:
            continue
        own = sums[slot_of(b.path, elements, known)]
        own[0] += 0.0 if b.is_menu() else len(b.text) * b.weight()
        own[1] += len(b.text)
        own[2] += min(b.linked, len(b.text))
    # An element's worth counts in all around it: from the longest path to the shortest, each adds to the next one up.
    for x in sorted(elements, key=len, reverse=True):
        if x:
            sums[slot_of(up(x), elements, known)][0] += sums[x][0]
    return sums


def main_element(sums: dict[str, list[float]]) -> str:
    """The deepest element that holds the share HOLDS of the text, parts of a text aside; where it lies in an article, that."""
    least = HOLDS * sums[""][0]
    found = max((x for x in sums if sums[x][0] >= least and not _PART.search(last(x))), key=lambda x: (x.count("/"), sums[x][0], x))
    region = _REGION.match(found)
    return region[1] if region and region[1] in sums else found


def main_text(page: str, classes: list[list[int]] | None = None, main: str | None = None, menus=()) -> str:
    """The page's own text in the slots of the main element, and of headings beside it; without what is hinted, or a menu, inside it. Text of the template is no slot's.

    Without a main element of the host the page's own sums find it, as where the page lacks the host's.
    """
    frame, blocks = parsed(page)
    elements, template = template_of(frame, blocks, classes)
    if main is None or main and main not in frame:
        main, menus = main_element(slot_sums(frame, blocks, classes)), ()
    beside, known = up(main), {}
    out = []
    for b in blocks:
        heading = main and not b.hinted and _HEADING.search(last(b.path)) and up(b.path) == beside
        if not (heading or within(b.path, main)) or number("text", b.path, b.text) in template:
            continue
        if b.hinted and not within(main, b.hinted) or menus and slot_of(b.path, elements, known) in menus:
            continue
        out.append(b.text)
    return "\n".join(out)


def pages_of(batch: pa.RecordBatch, *columns: str):
    """The rows of a batch, one at a time."""
    for row in zip(*(batch.column(c) for c in columns), strict=True):
        yield [x.as_py() for x in row]


def templates(pages: DataFrame) -> DataFrame:
    """host and its template: classes of tokens in the order of their mean first places, from pages (host, html).

    A token's occurrence vector over the host's distinct pages is summed up as the sum
    of a hash of (page, count), so that classes come from one grouping by token and one
    by sum. A host's template has at most 1 / SUPPORT times the tokens of an average page.
    Whether classes keep their order and nest is checked on each page.
    """
    names = ("host", "token", "mark", "page", "place")

    def run(batches):
        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), *[pa.int64()] * 4), strict=True)], names)

        for batch in batches:
            out = [[] for _ in names]
            for host, page in pages_of(batch, "host", "html"):
                key = xxhash.xxh3_64_intdigest(page)
                for token, (count, place) in counted_tokens(*parsed(page)).items():
                    mixed = (key ^ (count * 0x9E3779B97F4A7C15)) & (1 << 64) - 1
                    for column, value in zip(out, (host, token, xxhash.xxh3_64_intdigest(mixed.to_bytes(8, "little")) >> 12, key - (1 << 63), place), strict=True):
                        column.append(value)
                if len(out[0]) >= ROWS:
                    yield rows(out)
                    out = [[] for _ in names]
            yield rows(out)

    rows = pages.mapInArrow(run, "host string, token long, mark long, page long, place long")
    # Copies of a page are one page; they are told by the page's hash.
    once = rows.groupBy("host", "token", "page").agg(F.min("mark").alias("mark"), F.min("place").alias("place"))
    tokens = saved(once.groupBy("host", "token").agg(F.count("*").alias("n"), F.sum(F.col("mark").cast("decimal(38,0)")).alias("vector"), F.avg("place").alias("place")).filter(f"n >= {LEAST_PAGES}"), "tokens")
    hosts = tokens.groupBy("host").agg(F.max("n").alias("pages"))
    often = tokens.join(hosts, "host").filter(F.col("n") >= SUPPORT * F.col("pages"))
    return often.groupBy("host", "vector", "n").agg(F.collect_list(F.struct("place", "token")).alias("class")).groupBy("host").agg(F.collect_list(F.transform(F.array_sort("class"), lambda x: x["token"])).alias("template"))


def with_template(pages: DataFrame, known: DataFrame, size: Column) -> DataFrame:
    """Pages with what is known of their host; `size` is a row's bytes."""
    small = (known.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return pages.join(F.broadcast(known) if small else known, "host", "left")


def main_elements(pages: DataFrame) -> DataFrame:
    """host, its main element and its menus, from pages (host, html, template). Sums of (host, element) are combined before the shuffle."""

    def run(batches):
        for batch in batches:
            sums: dict[tuple[str, str], list[float]] = {}
            for host, page, classes in pages_of(batch, "host", "html", "template"):
                for element, values in slot_sums(*parsed(page), classes).items():
                    have = sums.setdefault((host, element), [0.0, 0.0, 0.0])
                    for i, v in enumerate(values):
                        have[i] += v
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in sums], pa.string()) for i in (0, 1)] + [pa.array([v[i] for v in sums.values()], pa.float64()) for i in range(3)], ["host", "element", "worth", "chars", "linked"])

    sums = saved(pages.filter("template is not null").mapInArrow(run, "host string, element string, worth double, chars double, linked double").groupBy("host", "element").agg(*(F.sum(c).alias(c) for c in ("worth", "chars", "linked"))), "slots")
    whole = sums.filter("element = ''").select("host", F.col("worth").alias("whole"))
    deep = F.length("element") - F.length(F.translate("element", "/", ""))
    held = sums.join(whole, "host").filter((F.col("worth") >= HOLDS * F.col("whole")) & ~F.col("element").rlike(_PART.pattern))
    found = held.groupBy("host").agg(F.max(F.struct(deep, "worth", "element"))["element"].alias("found"))
    region = sums.select("host", F.col("element").alias("region"))
    main = found.withColumn("region", F.regexp_extract("found", _REGION.pattern, 1)).join(region.withColumn("known", F.lit(True)), ["host", "region"], "left")
    main = main.select("host", F.when((F.col("region") != "") & F.col("known"), F.col("region")).otherwise(F.col("found")).alias("main"))
    is_menu = (F.col("linked") > MENU * F.col("chars")) & ~F.col("element").rlike(_HEADING.pattern)
    return main.join(sums.filter(is_menu).groupBy("host").agg(F.collect_list("element").alias("menus")), "host", "left")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page.

    Returns one row per row of pages: id_col, url_col, text (empty if there is none or the page is
    null or empty), n_chars in code points. A page without a URL has a host of its own name ''; a page of a host
    with fewer than LEAST_PAGES distinct pages is its own template; rows that repeat an id
    are separate; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    arrow_rows(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    size = 8 * F.aggregate("template", F.lit(0), lambda n, c: n + F.size(c)) + 100
    known = saved(templates(source.select("host", "html")), "templates")
    mains = saved(main_elements(with_template(source.select("host", "html"), known, size)), "mains")
    known = saved(known.join(mains, "host"), "known")
    joined = with_template(source, known, size).select("id", "url", "html", "template", "main", "menus")
    schema = T.StructType([source.schema["id"], source.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(page, t, main, menus or ()) for page, t, main, menus in pages_of(batch, "html", "template", "main", "menus")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], ["id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
