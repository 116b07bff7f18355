"""HTML to text as a reader sees it: a tolerant tree, visibility rules and block layout."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Generator
from html import unescape as named_unescape
from itertools import accumulate
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from vellumic.llm._arrow import extended, map_slices, named

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist object audio video canvas".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCK = PARAGRAPH | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main menu nav option optgroup search section summary caption tbody thead tfoot tr td th".split())
#: An opening tag ends these open elements, no further out than the elements in the second set.
_CELL, _ROW, _GROUP = frozenset(("td", "th")), frozenset(("tr", "td", "th")), frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"))
IMPLIED_END = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (_CELL, frozenset(("tr", "table"))),
    "th": (_CELL, frozenset(("tr", "table"))),
    "tr": (_ROW, frozenset(("table",))),
    "tbody": (_GROUP, frozenset(("table",))),
    "thead": (_GROUP, frozenset(("table",))),
    "tfoot": (_GROUP, frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
#: Opening one of these ends an open paragraph.
ENDS_P = PARAGRAPH | frozenset("address article aside center details dialog dd div dt figcaption footer form header hgroup li main menu nav search section summary".split())
#: Elements out of which a closing tag of another element does not reach.
SCOPE = frozenset("table td th caption html template".split())
#: Cells are padded to this width at most, and cells over several columns or gaps below cells of
#: several rows to the second; that bounds the blanks of a page and leaves out no text.
CELL_WIDTH, SPAN_WIDTH = 60, 240
#: Most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_SPACES = re.compile(r"[ \t\n\r\f]+")
_LINES = re.compile(r"\r\n?")
#: What stands between the cells of a row.
_BETWEEN = " | "
_LONG_REFERENCE = re.compile(r"&#([0-9]{8,})(;?)")
_NUMBER = re.compile(r"[ \t\n\r\f]*\+?0*([0-9]+)")


def unescape(text: str) -> str:
    """Character references resolved; numbers of any length, those too large as U+FFFD."""
    if "&" not in text:
        return text
    short = lambda m: f"&#{m[1].lstrip('0') or '0'}{m[2]}" if len(m[1].lstrip("0")) < 8 else "\ufffd"
    return named_unescape(_LONG_REFERENCE.sub(short, text))


def columns_of(text: str) -> int:
    """Columns that a line of text takes: two for each wide character, none for combining marks."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        """Value of an attribute, empty where it has none, None where it is missing."""
        for key, *values in _ATTR.findall(self.attrs):
            if key.lower() == name:
                return unescape("".join(values))
        return None


def tokens(html: str):
    """('text', s) | ('open', tag, attributes) | ('close', tag), in order; comments are left out."""
    at, size, last = 0, len(html), {'"': html.rfind('"'), "'": html.rfind("'")}
    lower = ""
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4 if not html.startswith("<!-->", lt) else lt + 2)
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(html, lt)
        if not m:
            if html.startswith(("<!", "<?", "</"), lt):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        here = m.end()
        while (stop := _STOP.search(html, here)) and stop[0] != ">":
            # A quote opens a value only behind "=" and if another follows.
            quoted = stop.start() < last[stop[0]] and html[stop.start() - 1] in "= \t\n"
            here = html.find(stop[0], stop.end()) + 1 if quoted else stop.end()
        tag = m[2].lower()
        if not stop:
            return  # the file ends inside a tag
        at = stop.end()
        if m[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, html[m.end() : stop.start()]
        if tag in RAW:
            lower = lower or html.translate(_LOWER)
            end = lower.find(f"</{tag}", at)
            end = size if end < 0 else end
            if end > at:
                yield "raw", html[at:end], ""
            at = end


def tree(html: str) -> Node:
    """The document's elements, with implied ends and without unmatched closing tags."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are
    scopes: list[int] = []

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_to(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]
        while scopes and scopes[-1] >= k:
            scopes.pop()

    for what, value, attrs in tokens(html):
        if what in ("text", "raw"):
            stack[-1].children.append(value)
        elif what == "close":
            at, scope = last(value), scopes[-1] if scopes else 0
            if value in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                scope = 0
            if at and at >= scope:
                close_to(at)
            elif value == "br" and not scope:
                stack[-1].children.append(Node("br"))
        else:
            if value in ENDS_P and places.get("p"):
                at = last("p")
                if at > (scopes[-1] if scopes else 0) and at > last("button"):
                    close_to(at)
            if value in IMPLIED_END:
                ends, bound = IMPLIED_END[value]
                at, limit = last(*ends), last(*bound)
                if at > limit:
                    if value in ("tr", "tbody", "thead", "tfoot"):
                        at = min(places[t][bisect_right(places[t], limit)] for t in ends if places.get(t) and places[t][-1] > limit)
                    close_to(at)
            if value == "html":
                continue
            node = Node(value, attrs)
            stack[-1].children.append(node)
            if value not in VOID:
                places.setdefault(value, []).append(len(stack))
                if value in SCOPE:
                    scopes.append(len(stack))
                stack.append(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or node.tag == "input":
        return False
    if not node.attrs:
        return True
    lower = node.attrs.lower()
    if "hidden" in lower and node.get("hidden") is not None:
        return False
    return not ("style" in lower and _UNSEEN.search(node.get("style") or ""))


class _Lines:
    """Text under construction: lines, and how many line ends must stand before more text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = 0
        self.space = False
        self.prefix = ""

    def text(self, value: str) -> None:
        value = _SPACES.sub(" ", value)
        if not value:
            return
        if value == " ":
            self.space = bool(self.line)
            return
        if self.line:
            if self.space or value[0] == " ":
                self.line.append(" ")
        else:
            self._open()
        self.line.append(value.strip(" "))
        self.space = value[-1] == " "

    def _open(self) -> None:
        if self.lines:
            self.lines += [""] * (self.blank - 1)
        self.blank = 0
        if self.prefix:
            self.line.append(self.prefix)
            self.prefix = ""

    def end(self, blank: int) -> None:
        """End the line; ``blank`` line ends (1, or 2 for an empty line) stand before what follows."""
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False
        self.blank = max(self.blank, blank)

    def whole(self, rows: list[str]) -> None:
        """Add finished lines."""
        self.end(1)
        for row in rows:
            self._open()
            self.line.append(row)
            self.end(1)


def _run(step: Generator):
    """The result of a step that yields the steps it needs; a list holds the open ones, so depth has no limit."""
    steps, value = [step], None
    while steps:
        try:
            step = steps[-1].send(value)
        except StopIteration as done:
            steps.pop()
            value = done.value
        else:
            steps.append(step)
            value = None
    return value


def _render(node: Node, out: _Lines, pre: bool) -> Generator:
    number = 0
    for child in node.children:
        if isinstance(child, str):
            value = unescape(child)
            if pre:
                first, *more = _LINES.sub("\n", value).split("\n")
                if first:
                    if not out.line:
                        out._open()
                    out.line.append(first)
                for row in more:
                    if not out.line:
                        out._open()
                    out.end(1)
                    if row:
                        out._open()
                        out.line.append(row)
            else:
                out.text(value)
            continue
        tag = child.tag
        if not visible(child):
            continue
        if tag == "br":
            if not out.line and out.lines:
                out.blank = max(out.blank, 1) + 1
            out.end(1)
        elif tag == "table":
            out.end(2)
            out.whole((yield _table(child)))
            out.end(2)
        elif tag == "li":
            out.end(1)
            number += 1
            inner = _Lines()
            yield _render(child, inner, pre)
            inner.end(1)
            mark = f"{number}. " if node.tag == "ol" else "- "
            if inner.lines:
                rows = [mark + inner.lines[0], *(" " * len(mark) + x if x else "" for x in inner.lines[1:])]
                out.whole(rows)
        elif tag in BLOCK:
            gap = 2 if tag in PARAGRAPH and not (tag in ("ul", "ol") and node.tag == "li") else 1
            out.end(gap)
            yield _render(child, out, pre or tag == "pre")
            out.end(gap)
        else:
            yield _render(child, out, pre or tag in ("textarea", "xmp"))
            if tag in ("td", "th"):
                out.space = True


class _Cell:
    """A table cell: its text, the first column it takes and the one behind it, and its rows."""

    __slots__ = ("text", "start", "end", "rows")

    def __init__(self, text: str, columns: int = 1, rows: int = 1):
        self.text, self.start, self.end, self.rows = text, 0, columns, rows


def span(node: Node, name: str, most: int) -> int | None:
    """The number in a span attribute, as far as it is one."""
    found = _NUMBER.match(node.get(name) or "") if node.attrs else None
    return None if not found else most if len(found[1]) > 6 else min(int(found[1]), most)


def _cells(node: Node, groups: list[list[list[_Cell]]], captions: list[str]) -> Generator:
    """Rows of cells by row group, and the lines of whatever else stands in a table."""
    loose: list = []

    def flush() -> Generator:
        if any(not isinstance(x, str) or x.strip() for x in loose):
            holder = Node("div")
            holder.children = list(loose)
            captions.extend((yield _text_lines(holder)))
        loose.clear()

    groups.append([])
    for child in node.children:
        tag = "" if isinstance(child, str) else child.tag
        if tag in ("thead", "tbody", "tfoot") and visible(child):
            yield flush()
            yield _cells(child, groups, captions)
            groups.append([])
        elif tag == "tr" and visible(child):
            yield flush()
            row: list[_Cell] = []
            for cell in child.children:
                if isinstance(cell, str):
                    if cell.strip():
                        row.append(_Cell(" ".join(unescape(cell).split())))
                elif visible(cell):
                    holder = cell
                    if cell.tag not in _CELL:
                        holder = Node("div")
                        holder.children = [cell]
                    text = " ".join(x.strip() for x in (yield _text_lines(holder)) if x)
                    height = span(cell, "rowspan", MOST_ROWS)
                    row.append(_Cell(text, span(cell, "colspan", MOST_COLUMNS) or 1, MOST_ROWS if height == 0 else height or 1))
            groups[-1].append(row)
        elif tag not in ("col", "colgroup"):
            loose.append(child)
    yield flush()


def _place(rows: list[list[_Cell]]) -> None:
    """Give the cells of a row group their columns: each takes the next that no cell from above fills."""
    above: list[tuple[int, int, int]] = []  # first column, the one behind, the row behind, by column
    for k, row in enumerate(rows):
        above = [x for x in above if x[2] > k]
        at, i, new = 0, 0, []
        for cell in row:
            while i < len(above) and above[i][0] <= at:
                at = max(at, above[i][1])
                i += 1
            cell.start, cell.end = at, at + cell.end
            at = cell.end
            if cell.rows > 1:
                new.append((cell.start, cell.end, k + cell.rows))
        above = sorted(above + new) if new else above


def _table(node: Node) -> Generator:
    """Captions and loose text first, then one line a row, cells padded to their columns' width."""
    groups: list[list[list[_Cell]]] = []
    captions: list[str] = []
    yield _cells(node, groups, captions)
    for rows in groups:
        _place(rows)
    rows = [row for rows in groups for row in rows if any(cell.text for cell in row)]
    # Only columns in which a cell starts count; a cell runs up to the first that starts behind it.
    starts = sorted({cell.start for row in rows for cell in row})
    widths = [0] * len(starts)
    places = [[(bisect_left(starts, c.start), max(bisect_left(starts, c.end), bisect_left(starts, c.start) + 1), c.text, columns_of(c.text)) for c in row] for row in rows]
    for a, b, _, size in (x for row in places for x in row):
        if b == a + 1:
            widths[a] = max(widths[a], min(size, CELL_WIDTH))
    ends = list(accumulate((w + len(_BETWEEN) for w in widths), initial=0))
    across = lambda a, b: min(ends[b] - ends[a] - len(_BETWEEN), SPAN_WIDTH) if b > a + 1 else widths[a]
    lines = []
    for row in places:
        line, at = [], 0
        for a, b, text, size in row:
            if a > at:
                line.append(" " * across(at, a))
            line.append(text + " " * max(0, across(a, b) - size))
            at = b
        lines.append(_BETWEEN.join(line).rstrip())
    return captions + lines


def _text_lines(node: Node) -> Generator:
    out = _Lines()
    yield _render(node, out, False)
    out.end(1)
    return out.lines


def render(html: str) -> str:
    """All visible text of a page: blocks on lines of their own, paragraphs apart."""
    return "\n".join(x.rstrip() for x in _run(_text_lines(tree(html.replace("\0", ""))))).strip("\n")


def html_text(df: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The visible text of every whole page.

    Returns ``id_col``, ``text`` and ``n_chars``. A null or empty page has the empty text,
    broken markup and numbers of any size are read as far as they go, elements nest to any depth (each list within a list
    indents its lines, so many levels of lists make long lines), a null id stays null, repeated rows each give a
    row, other columns are not read, an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [render(x) if x else "" for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "text", "n_chars"])

    rows = df.select(named(id_col, "id"), named(html_col, "html"))
    return map_slices(rows, "html", extended(rows.schema[:1], "text string, n_chars long"), run).withColumnRenamed("id", id_col)
