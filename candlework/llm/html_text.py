"""Main text of web pages: site templates are found by counting element subtrees per host.

A page is read into a small element tree.  Subtrees with text are hashed (tag, class, id, text,
children); Spark counts on how many pages of its host each hash stands.  A subtree on ``MIN_PAGES`` pages of its host is
template and deleted, in an article where it stands at its edge, like elements whose kind says what they are (menus, headers, footers, sidebars, forms, scripts,
notices, adverts, comments).  A kind is a whole name of class, id or role (or one all of whose parts are kinds).
What is left of all top-level articles (or main elements, or the body) is the text; those inside an element of such
a kind count where the page has no others.  Prose
(paragraphs, headings, quotes) inside an article, and what stands inside a block of it, is never taken for template,
however often it is reprinted.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.bpe import slices
from candlework.llm.common import in_small_batches, stage

#: A subtree is template on at least so many pages of its host.
MIN_PAGES = 8
#: A table of templates up to this many rows travels to every task; a larger one is joined by host.
BROADCAST_ROWS = 500_000

# Element names and class words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
DROPPED = frozenset("head title nav footer aside form script style noscript template iframe object svg math canvas button select textarea dialog menu audio video map".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article main section div td th table body html aside nav footer header form ul ol dl blockquote".split())
NOISE = frozenset("ad ads adv advert adverts advertisement adbox banner sidebar cookie cookies consent gdpr comment comments disqus replies nav navbar navigation menu breadcrumb breadcrumbs footer share sharing social related recommended promo newsletter subscribe signup popup modal overlay notice alert sponsor sponsored toolbar pagination pager masthead".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?
    |<(?:svg|math)(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*/>
    |<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)
    |(?P<text>[^<]+|<)""",
    re.X | re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


class Element:
    __slots__ = ("children", "hash", "name", "names", "tag")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.children, self.hash = tag, [], 0
        found = [(a or b or c).lower() for _, a, b, c in ATTRIBUTE.findall(attrs)] if attrs else []
        self.name = " ".join(found)
        self.names = [frozenset(re.findall(r"[a-z0-9]+", x)) for x in self.name.split()]


def parse(page: str) -> Element:
    """Element tree of a page; unclosed and stray tags are mended the way browsers do in simple cases."""
    root = Element("html", "")
    stack = [root]
    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            stack[-1].children.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "body"):
            continue
        enders = CLOSES.get(tag, ())
        if tag in BLOCK:
            enders += ("p", *(("h1", "h2", "h3", "h4", "h5", "h6") if tag in PROSE and tag[0] == "h" else ()))
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in enders:
                del stack[k:]
                break
            if stack[k].tag in SCOPE:
                break
        element = Element(tag, m["attrs"])
        stack[-1].children.append(element)
        if tag not in VOID and not m["attrs"].endswith("/") or tag in BLOCK and tag not in VOID:
            stack.append(element)
    return root


def walk(root: Element):
    """Elements below ``root``, children before parents."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        order.append(element)
        stack += [c for c in element.children if isinstance(c, Element)]
    return reversed(order)


def dropped(element: Element, in_article: bool) -> bool:
    if element.tag in DROPPED or element.tag == "header" and not in_article:
        return True
    kinds = NOISE if in_article else NOISE | {"header"}
    return any(x and x <= kinds for x in element.names)


def kind_of(element: Element) -> str | None:
    """"article" or "main", also for a div or section with such a name."""
    if element.tag in ("article", "main"):
        return element.tag
    return "main" if element.tag in ("div", "section") and any("main" in x and not x & NOISE for x in element.names) else None


def top_elements(root: Element) -> list[Element]:
    """Top-level articles in page order, or main elements, or the root; those in dropped elements if there are no others."""
    found: dict[tuple[bool, str], list[Element]] = {}
    stack = [(root, False, False)]
    while stack:
        element, noise, in_main = stack.pop()
        kind = kind_of(element)
        if kind is None:
            noise = noise or element is not root and dropped(element, False)
        elif kind == "article" or not in_main:
            found.setdefault((noise, kind), []).append(element)
        if kind != "article":
            stack += [(c, noise, in_main or kind == "main") for c in reversed(element.children) if isinstance(c, Element)]
    return next((found[k] for k in ((False, "article"), (False, "main"), (True, "article"), (True, "main")) if k in found), [root])


def hash_subtrees(root: Element) -> None:
    import hashlib

    for element in walk(root):
        body = [element.tag, element.name]
        some = False
        for c in element.children:
            if isinstance(c, str):
                c = " ".join(c.split())
                body.append(c)
                some = some or bool(c)
            else:
                body.append(str(c.hash))
                some = some or c.hash != 0
        element.hash = int.from_bytes(hashlib.blake2b("\x1f".join(body).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if some else 0


def counted(root: Element) -> set[int]:
    """Hashes of the subtrees that count as evidence of a template: all but prose in an article, what it stands in, and what stands in it."""
    out, stack = set(), [(root, False)]
    while stack:
        element, inside = stack.pop()
        inside = inside or element.tag in ("article", "main")
        if inside and element.tag in PROSE:
            continue
        if element.hash and element is not root and not (inside and has_prose(element)):
            out.add(element.hash)
        stack += [(c, inside) for c in elements(element)]
    return out


def candidates(root: Element) -> set[int]:
    """Hashes of the subtrees whose recurrence decides about text: those beside the prose of an article, or any of a page without one."""
    tops = top_elements(root)
    if tops[0] is not root:
        return {e.hash for top in tops for e in elements(top) if e.hash and not has_prose(e)}
    return {e.hash for e in walk(root) if e.hash and e is not root}


def elements(parent: Element) -> list[Element]:
    return [c for c in parent.children if isinstance(c, Element)]


def has_prose(element: Element) -> bool:
    return any(e.tag in PROSE or e.tag in ("article", "main") for e in walk(element))


def template_edges(top: Element, templates: frozenset[int]) -> set[int]:
    """Ids of the leading and trailing children of an article that are template; between other children nothing is.

    A list item or a cell that recurs is content like its list, and so is prose, however often it is reprinted.
    """
    out: set[int] = set()
    for children in (top.children, top.children[::-1]):
        for c in children:
            if isinstance(c, str):
                if c.strip():
                    break
            elif c.hash in templates and not has_prose(c):
                out.add(id(c))
            elif c.hash:
                break
    return out


def main_text(page: str, templates: frozenset[int] = frozenset()) -> str:
    """Blocks of the main text in page order, one to a line."""
    root = parse(page)
    hash_subtrees(root)
    tops = top_elements(root)
    in_article = tops[0] is not root
    blocks, line = [], []

    def end() -> None:
        joined = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if joined:
            blocks.append(joined)

    todo: list = tops[::-1]
    own = {id(x) for x in tops}
    edges = {x for top in tops for x in template_edges(top, templates)} if in_article else set()
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            line.append(node)
        elif node is None:
            end()
        elif id(node) not in own and (dropped(node, in_article) or (id(node) in edges if in_article else node.hash in templates)):
            if node.tag in BLOCK:
                end()
        elif node.tag == "br":
            line.append(" ")
        else:
            if node.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(node.children)
    end()
    return "\n".join(blocks)


def host_of(url: str | None):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def subtree_rows(pages: DataFrame) -> DataFrame:
    """(host, name, subtree, decides): the counted subtrees of each page; ``name`` tells pages of different html."""

    def hashes(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices([batch], "html"):
                rows = []
                for page in part.column("html").to_pylist():
                    root = parse(page)
                    hash_subtrees(root)
                    own = candidates(root)
                    rows.append([(h, h in own) for h in counted(root) | own])
                take = pa.array(np.repeat(np.arange(len(rows)), np.array([len(r) for r in rows], np.int64)))
                columns = [pa.array([x[k] for r in rows for x in r], t) for k, t in enumerate((pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column("host").take(take), part.column("name").take(take), *columns], names=["host", "name", "subtree", "decides"])

    return pages.select("host", "name", "html").mapInArrow(hashes, "host string, name string, subtree long, decides boolean")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree): the subtrees that stand on at least ``min_pages`` pages of a host, whatever its size."""
    per = subtree_rows(pages).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"), F.max("decides").alias("decides"))
    return per.where((F.col("n") >= min_pages) & F.col("decides")).select("host", "subtree")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null html counts as empty and gives empty text; pages without a host (null or odd url) share one; repeated rows
    give repeated results (and count as pages of their own); an empty table gives none; other columns are left out.

    Up to ``broadcast_rows`` templates travel to the tasks by host; more are joined with the subtrees of the pages by
    (host, subtree), so that a page gets its own ones only.
    """
    rows = in_small_batches(pages).select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host_of("url").alias("host"))
    rows = rows.withColumn("name", F.md5(F.col("html").cast("binary")))
    templates = stage(site_templates(rows, min_pages))
    if templates.count() <= broadcast_rows:
        lists = F.broadcast(templates.groupBy("host").agg(F.collect_list("subtree").alias("templates")))
        joined = rows.join(lists, "host", "left")
    else:
        own = subtree_rows(rows).where("decides").drop("decides").distinct().join(templates, ["host", "subtree"]).groupBy("host", "name").agg(F.collect_list("subtree").alias("templates"))
        joined = rows.join(own, ["host", "name"], "left")
    joined = joined.select("page_id", "url", "html", "templates")

    def texts(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices([batch], "html"):
                known: dict[tuple, frozenset] = {}
                out = []
                for page, own in zip(part.column("html").to_pylist(), part.column("templates").to_pylist()):
                    key = tuple(own or ())
                    out.append(main_text(page, known.setdefault(key, frozenset(key))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
