"""Main-text extraction with site template removal (operator 5).

1. Each page is parsed into elements. Every element subtree that could be template (menus, headers, boxes, lists,
   forms and the like; paragraphs of an article and what holds most of the main text never are) is hashed with its
   markup.
2. Spark counts in how many distinct pages of its host each hash occurs: pages equal in <article>, else <main>, else
   <body> are copies and count as one. Both the copies and the counts are combined before the shuffle, so a host with a third of all pages
   is no hot key.
3. Subtrees on at least `min_pages` pages and `min_share` of the pages of the host are deleted, with those that HTML
   itself marks as no main text (nav, header, footer, aside, form, script, style, ...; class or role of a menu,
   advert, notice, sidebar, comment). Main text is what is left of <article>, else <main>, else <body>.

The templates of a host are joined to its pages: broadcast while their measured size is below `broadcast_bytes`, by a
shuffle on the host beyond (adaptive execution splits a hot host's pages there)."""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Tables

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>", re.S)
SHOWN = re.compile(r">\s*[^<\s]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
JUNK = frozenset("head nav header footer aside form menu dialog svg canvas object button select script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html"}
#: Subtrees that may be template. Headings, paragraphs and quotations of an article may recur without being template.
BOXES = frozenset("nav header footer aside form menu dialog div section ul ol dl table figure address details".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Words that, as a class, id or role or as its last part ("site-header"), mark what is no main text.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar masthead header footer comment comments respond notice cookie cookies consent gdpr popup modal newsletter subscribe social share sharing related toolbar pagination complementary contentinfo".split())
#: What may follow such a word ("comment-list"), and what before it says that the element isn't one itself ("has-sidebar").
BOX_WORDS = frozenset("area bar block body box buttons container content form footer header icons inner item items left link links list main menu nav overlay panel primary right row secondary section slot thread top unit widget wrap wrapper".split())
NOT_ITSELF = frozenset("has hide hides no not show shows with without".split())
ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: An element that isn't shown; quoted values are blanked before, but for style.
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
UNSHOWN = re.compile(r"(?:^|\s)style\s*=\s*(?:\"[^\"]*|'[^']*)\bdisplay\s*:\s*none", re.I)
QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def is_mark(value: str) -> bool:
    """Whether one of an attribute's names, taken whole, marks what is no main text."""
    for name in value.lower().split():
        parts = [x for x in re.split("[-_]+", name) if x]
        if parts and parts[0] not in NOT_ITSELF and (parts[-1] in MARKS or parts[0] in MARKS and parts[-1] in BOX_WORDS):
            return True
        if len(parts) == 1 and any(parts[0][:k] in MARKS and parts[0][k:] in BOX_WORDS for k in range(2, len(parts[0]) - 2)):
            return True  # "commentlist"
    return False


class Element:
    __slots__ = ("tag", "start", "end", "junk", "in_main")

    def __init__(self, tag: str, start: int, junk: bool, in_main: bool):
        self.tag, self.start, self.end, self.junk, self.in_main = tag, start, -1, junk, in_main


def parse(page: str) -> tuple[list[Element], list[tuple[int, int, str]]]:
    """(elements with their spans, tags as (start, end, name)). Forgiving: a closing tag closes what is open inside
    it, a block closes an open paragraph, what is never closed ends with the page."""
    elements: list[Element] = []
    tags: list[tuple[int, int, str]] = []
    stack: list[Element] = []
    at, size, main = 0, len(page), 0

    def close(depth: int, end: int) -> None:
        nonlocal main
        while len(stack) > depth:
            e = stack.pop()
            e.end = end
            main -= e.tag in ("article", "main")

    def innermost(names: tuple[str, ...], fences: tuple[str, ...]) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in names:
                return k
            if stack[k].tag in fences:
                return -1
        return -1

    while m := TOKEN.search(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        tags.append((m.start(), at, name))
        if not name:
            continue
        if m[1]:
            k = innermost((name,), ())
            if k >= 0:
                close(k, at)
            continue
        if name in CLOSES_P and (k := innermost(("p",), ("td", "th", "div", "section", "article", "main", "body", "button", "aside"))) >= 0:
            close(k, m.start())
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            own = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            if (k := innermost(own, ("ul", "ol", "dl", "table") if name != "td" and name != "th" else ("tr", "table"))) >= 0:
                close(k, m.start())
        if name in VOID or m[3].endswith("/") and name in ("path", "circle", "rect", "use"):
            continue
        marked = name not in ("html", "body", "article", "main") and any(is_mark(x[0] or x[1] or x[2]) for x in ATTR.findall(m[3]))
        if name == "article" and main and any(is_mark(x[0] or x[1] or x[2]) for x in ATTR.findall(m[3])):
            marked = True
        if "hidden" in m[3].lower() and HIDDEN.search(QUOTED.sub('=""', m[3])) or "display" in m[3].lower() and UNSHOWN.search(m[3]):
            marked = name not in ("html", "body")
        e = Element(name, m.start(), name in JUNK or marked, main > 0)
        elements.append(e)
        stack.append(e)
        main += name in ("article", "main")
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            close(len(stack) - 1, at)
            if end:
                tags.append((end.start(), end.end(), name))
    close(0, size)
    lift(page, elements)
    lift_forms(page, elements, tags)
    return elements, tags


def lift(page: str, elements: list[Element]) -> None:
    """A form or a marked element that holds the whole main text is none to be cut: the page would be left without text."""
    holders: list[Element] = []
    for s, e in main_roots(page, elements):
        around = [x for x in elements if x.junk and x.start < s and x.end >= e]
        if not around or any(x.tag in JUNK and x.tag != "form" for x in around):
            if not around:
                return
            continue
        holders += around
    for x in holders:
        x.junk = False


def lift_forms(page: str, elements: list[Element], tags: list[tuple[int, int, str]]) -> None:
    """On a page without <article> and <main>, a form that holds most of the text, most of it in paragraphs, headings
    and the like, is a frame around the page and none to be filled in."""
    forms = [e for e in elements if e.tag == "form" and e.junk]
    if not forms or any(e.tag in ("article", "main") for e in elements):
        return
    for x in forms:
        x.junk = False
    starts, sums = main_chars(page, elements, tags)

    def chars(e: Element) -> int:
        return sums[bisect_left(starts, e.end)] - sums[bisect_left(starts, e.start)]

    for x in forms:
        prose, at = 0, x.start
        for e in elements:
            if e.tag in TEXT and at <= e.start < x.end:
                prose, at = prose + chars(e), e.end
        x.junk = not (2 * chars(x) > sums[-1] and 2 * prose > chars(x))


class Shape:
    """The page with tags reduced to their names: what a subtree's hash is made of, so an entry marked as the current
    one, or links that differ, don't make two templates of one."""

    def __init__(self, page: str, tags: list[tuple[int, int, str]]):
        parts, self.at, self.to, last, size = [], [0], [0], 0, 0
        for s, e, name in tags:
            closing = "/" if page.startswith("</", s) else ""
            for text, end in ((page[last:s], s), (f"<{closing}{name}>" if name else "", e)):
                parts.append(text)
                size += len(text)
                self.at.append(end)
                self.to.append(size)
            last = e
        parts.append(page[last:])
        self.at.append(len(page))
        self.to.append(size + len(parts[-1]))
        self.text = "".join(parts)

    def key(self, e: Element) -> int:
        a, z = (self.to[bisect_left(self.at, x)] for x in (e.start, e.end))
        return xxhash.xxh3_64_intdigest(self.text[a:z].encode("utf-8", "surrogatepass")) - (1 << 63)


def may_be_template(e: Element) -> bool:
    return e.tag in BOXES or e.tag in TEXT and not e.in_main


def main_roots(page: str, elements: list[Element]) -> list[tuple[int, int]]:
    """Spans of what holds the main text: <main> if it has text, else <article>, else <body>, else the whole page."""
    mains = [e for e in elements if e.tag == "main" and not e.in_main and SHOWN.search(page, e.start, e.end)]
    roots = mains or [e for e in elements if e.tag == "article" and not e.in_main] or [e for e in elements if e.tag == "body"]
    return [(e.start, e.end) for e in roots] or [(0, len(page))]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def main_chars(page: str, elements: list[Element], tags: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """(starts of the texts between tags that belong to the main text, their lengths without spaces, summed up from
    the left, with a 0 before)."""
    roots, junk = merged(main_roots(page, elements)), merged([(e.start, e.end) for e in elements if e.junk])
    starts, sums = [], [0]
    at, r, j = 0, 0, 0
    for s, e, _ in [*tags, (len(page), len(page), "")]:
        if s > at:
            while r < len(roots) and roots[r][1] <= at:
                r += 1
            while j < len(junk) and junk[j][1] <= at:
                j += 1
            if r < len(roots) and roots[r][0] <= at and not (j < len(junk) and junk[j][0] <= at):
                starts.append(at)
                sums.append(sums[-1] + sum(map(len, page[at:s].split())))
        at = max(at, e)
    return starts, sums


def subtree_hashes(page: str) -> tuple[bytes, list[int]]:
    """(hash of the main roots, hashes of the subtrees that may be template). A subtree with more than half of the
    main text is the page's own text, not its template."""
    elements, tags = parse(page)
    starts, sums = main_chars(page, elements, tags)
    shape = Shape(page, tags)

    def own(e: Element) -> bool:
        return 2 * (sums[bisect_left(starts, e.end)] - sums[bisect_left(starts, e.start)]) > sums[-1]

    roots = "".join(page[s:e] for s, e in main_roots(page, elements))
    return xxhash.xxh3_128_digest(roots.encode("utf-8", "surrogatepass")), list({shape.key(e) for e in elements if may_be_template(e) and not own(e)})


def main_text(page: str, template: frozenset | set = frozenset()) -> str:
    elements, tags = parse(page)
    shape = Shape(page, tags) if template else None
    gone = [(e.start, e.end) for e in elements if e.junk or shape and may_be_template(e) and shape.key(e) in template]
    spans, cuts = main_roots(page, elements), merged(gone)
    blocks: list[str] = []
    for lo, hi in spans:
        part: list[str] = []
        at, c = lo, 0

        def text(a: int, b: int) -> None:
            """The text between two tags, without what is cut."""
            nonlocal c
            while a < b:
                while c < len(cuts) and cuts[c][1] <= a:
                    c += 1
                if c < len(cuts) and cuts[c][0] <= a:
                    a = cuts[c][1]
                    continue
                z = min(b, cuts[c][0]) if c < len(cuts) else b
                part.append(page[a:z])
                a = z

        for s, e, name in tags:
            if s < lo:
                continue
            if s >= hi:
                break
            if s > at:
                text(at, s)
            at = max(at, e)
            if name in BLOCK and part:
                blocks.append("".join(part))
                part = []
        if at < hi:
            text(at, hi)
        blocks.append("".join(part))
    return " ".join(x for x in (" ".join(html_lib.unescape(b).split()) for b in blocks) if x)


def templates(pages: DataFrame, min_pages: int, min_share: float, tables: Tables) -> DataFrame:
    """(host, template): the hashes of a host's recurring subtrees; at most elements-per-page / min_share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [subtree_hashes(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.binary()), pa.array([h for _, h in found], pa.list_(pa.int64()))], names=["host", "page", "hashes"])

    hashed = pages.select("host", "html").mapInArrow(run, "host string, page binary, hashes array<long>")
    # Copies may differ outside their main roots, which their texts don't show; the least list stands for them all.
    distinct = tables.write(hashed.groupBy("host", "page").agg(F.min("hashes").alias("hashes")), "distinct")
    seen = distinct.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    total = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    return seen.join(total, "host").filter(F.col("n") >= min_share * F.col("pages")).groupBy("host").agg(F.collect_list("h").alias("template"))


def extract(pages: DataFrame, min_pages: int = 5, min_share: float = 0.02, broadcast_bytes: int = 16 << 20, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages.

    Defined results: null or empty html, or a page without main text, gives ''; a page whose url is null or has no
    host belongs to the host '' ; repeated rows each get a row, and count as one page of their host; an empty table
    gives no rows; other columns are ignored."""
    tables = Tables(pages.sparkSession, "html")
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.lower(F.regexp_extract(url_col, HOST, 1)), F.lit("")).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = tables.write(templates(given, min_pages, min_share, tables), "templates")
    tables.release("distinct")
    size = found.agg(F.sum(F.size("template") * 8 + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        found = F.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, frozenset())
        for b in batches:
            out = []
            for host, page, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if last[0] != host:
                    last = (host, frozenset(t.as_py() or ()))
                out.append(main_text(page, last[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = given.schema["page_id"].dataType.simpleString()
    return given.join(found, "host", "left").select("page_id", "url", "host", "html", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
