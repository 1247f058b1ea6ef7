"""HTML extraction by layout-aware rendering.

A tree builder closes implied tags and resolves visibility; a renderer walks the tree and emits every visible
text: blocks on lines of their own (paragraph-like ones with a blank line around), nested lists with markers
and indentation, tables as rows of aligned cells, preformatted text as it stands. Formulas give their text, figures
in SVG that of their text elements. An element that is not displayed goes with all it holds; visibility is inherited,
and what is set visible again inside a hidden element is emitted.

Edge cases: null HTML gives null text and empty HTML empty text; broken or unclosed markup is repaired, never
refused; nesting of any depth is walked without recursion; a null page_id keeps its row; repeated rows each
get a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("audio canvas datalist annotation annotation-xml head iframe noframes noscript object script style template title video".split())
BLOCKS = frozenset("address article aside body caption dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol optgroup option section select summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("blockquote h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
#: A start tag closes the open elements named first, looking no further out than one of those named second.
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption", "table"), "td": ("td th", "table"), "th": ("td th", "table"), "tbody": ("tbody thead tfoot tr td th caption", "table"), "thead": ("tbody thead tfoot tr td th caption", "table"), "tfoot": ("tbody thead tfoot tr td th caption", "table"),
    "body": ("head", "html"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
_CLOSES_P = (BLOCKS | SPACED) - frozenset("option optgroup select body html td th tr tbody thead tfoot caption legend".split())
#: An end tag reaches no further out than these.
_SCOPE = frozenset("table td th html".split())
#: Within svg these are never drawn where they stand, and only those show characters.
_SVG_HIDDEN = frozenset("clippath defs desc lineargradient marker mask metadata pattern radialgradient symbol".split())
_SVG_TEXT = frozenset("text foreignobject".split())
_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)\s*(!important)?\s*(?=;|$)", re.I)
MAX_ALIGNED = 60


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def hidden(self) -> bool:
        a = self.attrs
        return self.tag in HIDDEN or "hidden" in a or (self.tag == "input" and (a.get("type") or "").lower() == "hidden") or bool(_STYLE.search(a.get("style") or ""))

    def visible(self, before: bool, svg: bool) -> bool:
        """Visibility as the style sets it (the last important declaration, or else the last), or else as inherited."""
        found = _VISIBILITY.findall(self.attrs.get("style") or "")
        value = ([v for v, important in found if important] or [v for v, _ in found] or [""])[-1].lower()
        if not value and svg:
            value = (self.attrs.get("visibility") or "").strip().lower()
        return value in ("visible", "initial") if value in ("visible", "initial", "hidden", "collapse") else before


class TreeBuilder(HTMLParser):
    """Open elements are a stack; where each tag stands in it is known, so that no step depends on its depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}
        self.endless = False  # no comment ends any more

    def read(self, html: str) -> None:
        """Behind the last > no tag ends, so what stands there is text as a whole; the parser would look for an end again at every <."""
        last = html.rfind(">") + 1
        self.feed(html[:last])
        self.close()
        if tail := html[last:]:
            self.handle_data(tail if self.cdata_elem else unescape(tail))

    def parse_comment(self, i: int, report: bool = True) -> int:
        found = -1 if self.endless else super().parse_comment(i, report)
        self.endless = found < 0
        return found

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, k: int) -> None:
        """Close what is open from place k on."""
        while len(self.open) > k:
            self.places[self.open.pop().tag].pop()

    def _last(self, tags) -> int:
        """The place of the innermost open element of these; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def _close(self, tags: frozenset, scope: frozenset) -> None:
        k = self._last(tags)
        if k and k >= self._last(scope):
            self._cut(k)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_P:
            self._close(frozenset(("p",)), _SCOPE | frozenset(("button",)))
        if tag in IMPLIED:
            names, scope = IMPLIED[tag]
            before = -1
            while before != len(self.open):
                before = len(self.open)
                self._close(names, scope)
        if tag not in ("head", "title", "meta", "link", "style", "script", "base", "html", "noscript", "template") and self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        foreign = max(("svg", "math", "foreignobject"), key=lambda t: self._last((t,)))
        foreign = foreign if self._last((foreign,)) else ""
        self.handle_starttag(tag, attrs)
        if (tag in ("svg", "math") or foreign in ("svg", "math")) and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)  # only in svg and math does the slash close an element

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.places.get("p"):
            self.handle_starttag("p", [])
        scope = frozenset() if tag in ("table", "body", "html") else _SCOPE - {tag}
        self._close(frozenset((tag,)), scope)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


class Writer:
    """Collects lines; white space runs fold into one blank, which is dropped at line edges."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = self.gap = False
        self.lead = self.indent = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.split("\n")
            self._put(first)
            for x in more:
                self.line(True)
                self._put(x)
            return
        parts = s.split()
        if not parts:
            self.blank = self.blank or bool(s)
            return
        if (s[0].isspace() or self.blank) and self.now:
            self.now.append(" ")
        self._put(" ".join(parts))
        self.blank = s[-1].isspace()

    def _put(self, s: str) -> None:
        if s:
            if not self.now:
                if self.gap and self.lines:
                    self.lines.append("")
                self.gap = False
                self.now.append(self.lead or self.indent)
                self.lead = ""
            self.now.append(s)
            self.blank = False

    def line(self, force: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
        elif force and self.lines and not self.gap:
            self.lines.append("")
        self.now, self.blank = [], False

    def space(self) -> None:
        self.line()
        self.gap = True

    def done(self) -> list[str]:
        self.line()
        return self.lines


def _aligned(rows: list[list[str]]) -> list[str]:
    """Cells padded to their column's width; a cell of more than MAX_ALIGNED characters does not widen its column."""
    width: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            if k == len(width):
                width.append(0)
            if len(cell) <= MAX_ALIGNED:
                width[k] = max(width[k], len(cell))
    return [" | ".join(c.ljust(width[k]) for k, c in enumerate(row)).rstrip() for row in rows]


def render(root: Node) -> str:
    """Depth-first walk with an explicit stack of nodes to enter and of steps to do when they end."""
    writers, tables, lists = [Writer()], [], []
    # Beside each node: whether it inherits visibility, whether it is drawn by svg, and whether characters show there.
    stack: list = [(root, True, False, True)]
    pre = 0
    while stack:
        node = stack.pop()
        out = writers[-1]
        if callable(node):
            node()
            continue
        node, visible, svg, shown = node
        if isinstance(node, str):
            if visible and shown:
                out.text(node, pre > 0)
            continue
        tag = node.tag
        if node.hidden() or (svg and (tag in _SVG_HIDDEN or (node.attrs.get("display") or "").strip().lower() == "none")):
            continue
        if tag == "svg":
            svg, shown = True, False
        visible = node.visible(visible, svg)
        if svg and tag in _SVG_TEXT:
            svg, shown = tag == "text", True
            out.text(" ", False)
            stack.append(lambda out=out: out.text(" ", False))
        if tag == "br":
            if visible:
                out.line(True)
            continue
        if tag == "img" and node.attrs.get("alt") and visible:
            out.text(node.attrs["alt"], False)
        if tag in ("input", "button") and node.attrs.get("value") and tag == "input" and visible:
            out.text(f" {node.attrs['value']} ", False)

        def end(tag=tag, out=out) -> None:
            nonlocal pre
            if tag in ("ul", "ol", "menu"):
                lists.pop()
                out.indent = "  " * len(lists)
            if tag == "pre":
                pre -= 1
            if tag == "li":
                out.lead = ""
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                out.space()
            elif tag in SPACED or tag in BLOCKS:
                out.line()

        if tag in ("td", "th") and tables:
            writers.append(Writer())
            kept_lists, lists = lists, []

            def end_cell(kept=kept_lists) -> None:
                nonlocal lists
                lists = kept
                cell = writers.pop().done()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append(cell)

            stack.append(end_cell)
        elif tag == "tr" and tables:
            row: list = []
            tables[-1].append(row)
            if not visible:  # a row of which nothing shows is none
                stack.append(lambda row=row: None if any(map(any, row)) else row.clear())
        elif tag == "table":
            out.space()
            tables.append([])

            def end_table(out=out, visible=visible) -> None:
                rows = [r for r in tables.pop() if r and (visible or any(map(any, r)))]
                if all(len(r) == 1 for r in rows):  # a table of one column is layout: its blocks stay blocks
                    lines = [x for r in rows for x in r[0]]
                else:
                    lines = _aligned([[" ".join(x for x in c if x) for c in r] for r in rows])
                out.line()
                for x in lines:
                    if x:
                        out._put(x)
                    out.line(True)
                out.space()

            stack.append(end_table)
        elif tag in BLOCKS or tag in SPACED:
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                out.space()
            else:
                out.line()
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start") or "1"
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            if tag == "li":
                depth = max(0, len(lists) - 1)
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                out.lead, out.indent = "  " * depth + mark, "  " * (depth + 1)
            if tag == "pre":
                pre += 1
            stack.append(end)
        stack.extend((x, visible, svg, shown) for x in reversed(node.children))
    return "\n".join(writers[0].done())


def extract(html: str | None) -> str | None:
    if html is None:
        return None
    builder = TreeBuilder()
    builder.read(html)
    return render(builder.root)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text and its length in code points; one narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(x) for x in b.html]
            yield pd.DataFrame({"page_id": b.page_id.astype("Int64"), "text": text, "n_chars": pd.array([None if t is None else len(t) for t in text], dtype="Int64")})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, text string, n_chars long")
