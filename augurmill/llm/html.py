"""Visible text of HTML pages with their layout.

A tree builder closes what HTML closes by itself (paragraphs before blocks, list
items, table rows and cells, options, heads), opens rows that cells imply, moves what
stands in a table outside its cells before it, skips what is never shown (scripts, styles,
heads, hidden elements) and renders the tree: blocks stand apart, lists get markers
and indents, table cells are padded to their columns, preformatted text keeps its
white space.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, llm_query, table

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed".split())
HIDDEN = frozenset("script style head template noscript iframe datalist annotation annotation-xml".split())
HEAD_CONTENT = frozenset("head title base basefont bgsound link meta noscript noframes script style template".split())
#: Elements that a table takes directly or by rows; other content there stands before the table.
SECTIONS = frozenset("tbody thead tfoot".split())
TABLE_PARTS = SECTIONS | frozenset("tr td th caption colgroup col".split())
IN_TABLE = SECTIONS | {"table", "tr"}
#: Elements of an SVG picture that are drawn only by reference or never, and those whose text is drawn.
SVG_HIDDEN, SVG_TEXT = frozenset("defs symbol clippath mask pattern marker title desc metadata".split()), frozenset({"text", "foreignobject"})
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center dd details dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav section summary tr caption".split())
#: An opening tag closes open ones of the first group, unless one of the second lies between.
IMPLIED = {
    **dict.fromkeys(BLOCKS - {"body", "html", "li", "dd", "dt", "tr", "legend", "summary", "figcaption", "caption"}, (frozenset({"p"}), frozenset({"button", "td", "th", "caption"}))),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table"}))),
    "option": (frozenset({"option"}), frozenset({"select"})), "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset()),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'/=][^\s/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']\S*)))?")
_MAYBE_HIDDEN = re.compile(r"(?i)hidden|style")
_UNSHOWN = {"display": {"none"}, "visibility": {"hidden", "collapse"}}
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    """Values by lower-cased name; of equal names the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def enclosing(stack: list[Node], tags: frozenset[str]) -> int:
    """Place of the innermost open element of these in the innermost open table; 0 if there is none."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            return k
        if stack[k].tag == "table":
            break
    return 0


def add(stack: list[Node], child: Node | str) -> None:
    """Append to the innermost open element; what a table does not take is put before it."""
    top = stack[-1]
    if top.tag == "head" and isinstance(child, str) and child.strip():
        stack.pop()
        top = stack[-1]
    stray = child.strip() if isinstance(child, str) else child.tag not in TABLE_PARTS and child.tag not in ("script", "style", "template")
    if not stray or top.tag not in IN_TABLE or not (k := enclosing(stack, frozenset({"table"}))):
        top.children.append(child)
        return
    before = stack[k - 1].children
    at = len(before) - 1
    while before[at] is not stack[k]:
        at -= 1
    before.insert(at, child)


def parse(page: str) -> Node:
    """Tree of nodes and strings. Unknown or unmatched end tags are ignored; what stays open ends with the page."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(stack, html.unescape(page[at:]))
            break
        if m.start() > at:
            add(stack, html.unescape(page[at:m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                # an end tag does not reach out of its cell, a row's or cell's not out of its table
                if stack[k].tag == "table" and tag not in ("body", "html") or stack[k].tag in ("td", "th", "caption") and tag not in TABLE_PARTS and tag not in ("table", "body", "html"):
                    break
            continue
        if stack[-1].tag == "head" and tag not in HEAD_CONTENT:
            stack.pop()
        table = enclosing(stack, frozenset({"table"})) if tag in TABLE_PARTS or tag in ("table", "form") else 0
        if table and tag in TABLE_PARTS:
            del stack[1 + enclosing(stack, IN_TABLE if tag in ("td", "th") else SECTIONS | {"table"} if tag == "tr" else frozenset({"table"})):]
            if tag in ("td", "th") and stack[-1].tag != "tr":
                row = Node("tr")
                stack[-1].children.append(row)
                stack.append(row)
        elif table and tag == "table" and stack[-1].tag in IN_TABLE:
            del stack[table:]
        elif table and tag == "form" and stack[-1].tag in IN_TABLE:
            continue
        elif tag in IMPLIED:
            closes, limits = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in limits or stack[k].tag == "table":
                    break
        node = Node(tag, m[3])
        add(stack, node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and (tag not in RAW or any(x.tag in ("svg", "math") for x in stack)):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.children.append(page[at:close.start() if close else end])
            at = close.end() if close else end
            continue
        stack.append(node)
    return root


class Page:
    """Collects lines; spaces collapse, blocks break lines, paragraphs leave one empty line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.indent = "", 0, ""

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if not self.line or self.line[-1] in " \n":
            s = s.lstrip(" ")
        if s:
            if not self.line:
                if self.gap > 1 and self.lines and self.lines[-1]:
                    self.lines.append("")
                self.line = self.indent
            self.gap = 0
            self.line += s

    def brk(self, gap: int = 1) -> None:
        if self.line.strip():
            self.lines.append(self.line.rstrip())
        self.line = ""
        self.gap = max(self.gap, gap)


def hidden(node: Node) -> bool:
    if node.tag in HIDDEN or node.tag in ("title", "input"):
        return True
    if node.tag == "dialog" and "open" not in attributes(node.attrs) or node.tag == "object" and "data" in attributes(node.attrs):
        return True
    if not node.attrs or not _MAYBE_HIDDEN.search(node.attrs):
        return False
    own = attributes(node.attrs)
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true":
        return True
    rules = (x.partition(":") for x in own.get("style", "").lower().split(";"))
    return any(value.replace("!important", "").strip() in _UNSHOWN.get(name.strip(), ()) for name, _, value in rules)


def drawn(node: Node) -> list[Node]:
    """The elements of an SVG picture that show text."""
    out, todo = [], [node]
    while todo:
        for x in reversed(todo.pop().children):
            if isinstance(x, Node) and not hidden(x) and x.tag not in SVG_HIDDEN:
                todo.append(x)
        while todo and todo[-1].tag in SVG_TEXT:
            out.append(todo.pop())
    return out


def rows_of(node: Node) -> list[Node]:
    """Rows of a table, those of tables inside its cells left out."""
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not hidden(x):
            if x.tag == "tr":
                out.append(x)
            elif x.tag in ("tbody", "thead", "tfoot"):
                todo.extend(reversed(x.children))
    return out


def table_text(node: Node, page: Page) -> None:
    for x in node.children:
        if isinstance(x, Node) and x.tag not in ("tr", "tbody", "thead", "tfoot", "colgroup", "col") or isinstance(x, str) and x.strip():
            render([x], page)
            page.brk()
    cells = [[" ".join(rendered(c.children).split("\n")) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c)] for r in rows_of(node)]
    cells = [[_SPACES.sub(" ", c).strip() for c in r] for r in cells]
    widths = [max((len(r[k]) for r in cells if len(r) > k + 1), default=0) for k in range(max(map(len, cells), default=0))]
    for r in cells:
        line = "  ".join(c.ljust(widths[k]) if k + 1 < len(r) else c for k, c in enumerate(r)).rstrip()
        if line:
            page.brk()
            page.text("x")  # opens a line with its gap and indent
            page.line = page.line[:-1] + line
            page.brk()


def render(children: list, page: Page) -> None:
    """Depth first with an own stack, so deep nesting is no matter."""
    todo: list = [iter([("node", c) for c in children])]
    while todo:
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
            continue
        kind, x = step
        if kind == "do":
            x()
            continue
        if isinstance(x, str):
            page.text(x)
            continue
        if hidden(x):
            continue
        tag = x.tag
        if tag == "br":
            had = bool(page.line.strip())
            page.brk(0 if had else 1)
        elif tag == "hr":
            page.brk(2)
        elif tag == "table":
            page.brk(2)
            table_text(x, page)
            page.brk(2)
        elif tag == "pre":
            page.brk(2)
            if page.lines and page.lines[-1]:
                page.lines.append("")
            for line in plain(x).strip("\n").split("\n"):
                page.lines.append(page.indent + line.rstrip())
            page.gap = 2
        elif tag in ("ul", "ol", "menu"):
            todo.append(iter(listed(x, page)))
        elif tag == "img":
            page.text(attributes(x.attrs).get("alt", ""))
        elif tag == "svg":
            todo.append(iter([y for c in drawn(x) for y in (("do", lambda: page.text(" ")), ("node", c), ("do", lambda: page.text(" ")))]))
        else:
            gap = 2 if tag in PARAGRAPHS else 1 if tag in BLOCKS or tag in ("tr", "option") else 0
            after = [("do", lambda gap=gap: page.brk(gap))] if gap else [("do", lambda: page.text(" "))] if tag in ("td", "th") else []
            if gap:
                page.brk(gap)
            todo.append(iter([*(("node", c) for c in x.children), *after]))


def listed(node: Node, page: Page) -> list:
    """Steps that render a list: a marker for each item, its further lines indented under it."""
    outer, number, steps = page.indent, 0, []
    # a list inside an item opens on the next line, others stand apart
    steps.append(("do", lambda: page.brk(1 if outer else 2)))

    def begin(marker: str):
        def run():
            page.brk()
            page.indent = outer
            page.text("x")
            page.line = page.line[:-1] + marker
            page.indent = outer + " " * len(marker)
        return run

    for c in node.children:
        if isinstance(c, Node) and c.tag == "li" and not hidden(c):
            number += 1
            steps += [("do", begin(f"{number}. " if node.tag == "ol" else "- ")), *(("node", k) for k in c.children), ("do", page.brk)]
        elif isinstance(c, Node) or c.strip():
            steps.append(("node", c))
    steps.append(("do", lambda: (page.brk(1 if outer else 2), setattr(page, "indent", outer))))
    return steps


def plain(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif not hidden(x):
            todo.extend(reversed(x.children))
    return "".join(out)


def rendered(children: list) -> str:
    page = Page()
    render(children, page)
    page.brk()
    return "\n".join(page.lines).strip("\n")


def visible_text(page: str) -> str:
    return rendered(parse(page).children)


def page_texts(pages: DataFrame) -> DataFrame:
    """Visible text of every page.

    One row per row of `pages` (page_id, html; other columns are not read): page_id, text, n_chars. Null or empty HTML,
    and pages that show nothing, give the empty text. A null page_id stays null. An empty table gives an empty table.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def step(batches):
        for b in batches:
            own = [visible_text(x) if x else "" for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(own, pa.string()), pa.array([len(x) for x in own], pa.int64())], ["page_id", "text", "n_chars"])

    return arrow_map(pages.select("page_id", F.col("html")), step, f"page_id {kind}, text string, n_chars long")


@llm_query
def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of every page."""
    return page_texts(table(spark, sf, "pages"))
