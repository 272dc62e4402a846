"""HTML to text by layout: a small tree builder with implied tags, visibility rules and aligned tables."""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import spread

# Fixed values of the HTML standard: elements by how they are parsed and laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object svg canvas audio video datalist title noembed noframes".split())
#: What an open head can hold; any other tag, or text, closes it.
HEAD_CONTENT = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
CLOSES_P = BLOCKS - {"body", "html", "optgroup", "option", "legend", "li", "dd", "dt"} | {"li", "dd", "dt"}
#: An opening tag closes an open element of these kinds, unless one of the barriers stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("td", "th", "tr", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("caption", "colgroup"), ("table",)), "tfoot": (("td", "th", "tr", "thead", "tbody", "caption"), ("table",)),
}
ROWS = frozenset("caption tr td th".split())
SCOPES = frozenset("table td th caption button object template html body".split())

#: Tables nested deeper than this are laid out as plain blocks.
TABLE_DEPTH = 50
#: Widest cell and line that count for alignment; the standard's most columns of a cell, also the last that rows share.
CELL_WIDTH, LINE_WIDTH, MOST_COLUMNS = 120, 1000, 1000

# An attribute: a quote opens a value only right after "=" (and white space), elsewhere it is a part of a name or value.
_ATTRIBUTE_TEXT = r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*+))?+)?+"
_ATTRIBUTE = re.compile(_ATTRIBUTE_TEXT)
_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[ \t\n\f\r/]++|" + re.sub(r"\((?=\[)", "(?:", _ATTRIBUTE_TEXT) + r")*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.DOTALL)
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)
_BLANK = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "hidden")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.hidden = tag in HIDDEN or "hidden" in attributes or attributes.get("aria-hidden") == "true" or tag == "input" or bool("style" in attributes and _GONE.search(attributes["style"]))


class Stack:
    """The open elements, and where on the stack each kind of tag is open, so a look for a tag takes no walk."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, low: int) -> None:
        for node in self.nodes[low:]:
            self.places[node.tag].pop()
        del self.nodes[low:]

    def last(self, kinds: Iterable[str]) -> int:
        """The place of the innermost open tag of these kinds, 0 if there is none above the root."""
        return max((self.places[k][-1] for k in kinds if self.places.get(k)), default=0)

    def close(self, kinds: tuple[str, ...], barriers: Iterable[str]) -> None:
        """Close the innermost element of these kinds, and those of them right around it, unless a barrier is inside."""
        low = self.last(kinds)
        if low > self.last(barriers):
            while low > 1 and self.nodes[low - 1].tag in kinds:
                low -= 1
            self.cut(low)


def parse(page: str) -> Node:
    """The tree of a page. Tags that are not closed are closed where the next tag implies it; stray ones are ignored."""
    root = Node("html", {})
    stack, at, last = Stack(root), 0, len(page)

    def leave_head() -> None:
        if stack.nodes[-1].tag == "head":
            stack.cut(len(stack.nodes) - 1)

    while at < last:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else last]
        if text:
            if not text.isspace():
                leave_head()
            stack.nodes[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                leave_head()
                stack.nodes[-1].children.append(Node("br", {}))
            else:
                barriers = ("table",) if tag in ("tr", "tbody", "thead", "tfoot") else SCOPES - {tag} if tag != "table" else ()
                if (low := stack.last((tag,))) > stack.last(barriers):
                    stack.cut(low)
            continue
        attributes = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3].strip(" /\n\t") else {}
        if tag in ("html", "body"):
            stack.close(("head",), ())
            if tag == "body" and Node(tag, attributes).hidden:
                root.hidden = True
            continue
        if tag not in HEAD_CONTENT:
            leave_head()
        if tag in IMPLIED:
            stack.close(*IMPLIED[tag])
        if tag in CLOSES_P:
            stack.close(("p",), SCOPES)
        node = Node(tag, attributes)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            inner = page[at : end.start() if end else last]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else last
        elif tag not in VOID:
            stack.push(node)
    return root


class Lines:
    """Lines of text under layout: blocks begin new lines, and spaced ones leave a blank line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.space, self.prefix = 0, False, ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *rest = s.split("\n")
            self.put(first)
            for r in rest:
                self.end(True)
                self.put(r)
            return
        if not (words := _BLANK.sub(" ", s)).strip(" "):
            self.space |= bool(words)
            return
        if (self.space or words[0] == " ") and self.now:
            self.put(" ")
        self.space = words[-1] == " "
        self.put(words.strip(" "))

    def put(self, s: str) -> None:
        if s:
            self.now.append(s)

    def end(self, always: bool = False) -> None:
        self.space = False
        if self.now or always:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append(self.prefix + "".join(self.now))
            self.now = []
            self.prefix = " " * len(self.prefix)

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)


def _span(node: Node, name: str, most: int) -> int:
    said = node.attributes.get(name, "1").strip()
    return min(int(said), most) if re.fullmatch(r"[0-9]{1,9}", said) else 1


def aligned(rows: list[list[tuple[int, int, str]]]) -> list[str]:
    """Rows of cells (column, columns spanned, text) as lines. Columns in which no cell begins take no room; a text
    that is wider than the columns it spans widens the last of them.

    Texts beyond CELL_WIDTH don't widen a column, and columns beyond LINE_WIDTH aren't aligned: there cells follow
    after two spaces, so lines stay in proportion to their text.
    """
    begins = sorted({c for row in rows for c, _, _ in row})
    place = {c: i for i, c in enumerate(begins)}
    cells = [[(place[c], bisect.bisect_left(begins, c + n) - place[c], text) for c, n, text in sorted(row)] for row in rows]
    width = [0] * len(begins)
    for at, n, text in sorted((x for row in cells for x in row if len(x[2]) <= CELL_WIDTH), key=lambda x: x[1]):
        width[at + n - 1] += max(0, len(text) - sum(width[at : at + n]) - 2 * (n - 1))
    start = list(itertools.accumulate((w + 2 for w in width), initial=0))
    lines = []
    for row in cells:
        line: list[str] = []
        long = 0
        for at, _, text in row:
            if text:
                gap = start[at] - long if long + 2 <= start[at] <= LINE_WIDTH or not long and start[at] <= LINE_WIDTH else 2 * bool(long)
                line += [" " * gap, text]
                long += gap + len(text)
        lines.append("".join(line))
    return lines


def _table(node: Node, depth: int) -> list[str]:
    """Rows of a table as lines, each cell beginning at its column; a cell's lines are joined by a space. Cells that
    span rows keep their columns free in the rows below."""
    rows: list[list[tuple[int, int, str]]] = []
    notes: list[str] = []
    taken: dict[int, int] = {}  # column: last row that a cell from above covers

    def add(nodes: list[Node]) -> None:
        row, column = [], 0
        for x in nodes:
            while taken.get(column, -1) >= len(rows):
                column += 1
            wide, high = max(1, _span(x, "colspan", MOST_COLUMNS)), _span(x, "rowspan", 65534)
            row.append((column, wide, " ".join(line.strip() for line in lay_out(x, depth) if line.strip())))
            if high != 1 and column < MOST_COLUMNS:
                taken.update(dict.fromkeys(range(column, column + wide), len(rows) + (high or 65534) - 1))
            column += wide
        rows.append(row)

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    notes.append(_BLANK.sub(" ", c).strip())
            elif c.hidden:
                continue
            elif c.tag == "tr":
                notes.extend(_BLANK.sub(" ", x).strip() for x in c.children if isinstance(x, str) and x.strip())
                add([x for x in c.children if not isinstance(x, str) and not x.hidden])
            elif c.tag in ("tbody", "thead", "tfoot"):
                walk(c)
                taken.clear()
            elif c.tag in ("td", "th"):
                add([c])
            else:
                notes.extend(line for line in lay_out(c, depth) if line)

    walk(node)
    return notes + aligned([r for r in rows if any(text for *_, text in r)])


def lay_out(root: Node, depth: int = 0) -> list[str]:
    """The visible text of a tree as lines. The walk keeps its own stack, so depth is not limited; ``depth`` counts the
    tables around ``root``."""
    out = Lines()
    todo: list[tuple] = [("open", root, False, [])]
    while todo:
        step, node, keep, lists = todo.pop()
        if step == "text":
            out.text(node, keep)
            continue
        if step == "close":
            if node.tag in ("li", "dd", "blockquote"):
                out.end()
                out.prefix = keep
            if node.tag in BLOCKS or node.tag in ROWS:
                out.block(int(node.tag in SPACED and not (lists and node.tag in ("ul", "ol"))))
            continue
        if node.hidden:
            continue
        tag = node.tag
        if tag == "br":
            out.end(True)
        elif tag == "hr":
            out.block(0)
            out.put("---")
            out.end()
        elif tag == "img":
            if node.attributes.get("alt"):
                out.text(f" {node.attributes['alt']} ", False)
        elif tag == "table" and node is not root and depth < TABLE_DEPTH:
            out.block(1)
            for line in _table(node, depth + 1):
                out.put(line)
                out.end()
            out.block(1)
        else:
            if tag in BLOCKS or tag in ROWS:
                out.block(int(tag in SPACED and not (lists and tag in ("ul", "ol"))))
            before = out.prefix
            if tag == "li":
                mark = "* "
                if lists and lists[-1][0] == "ol":
                    mark, lists[-1][1] = f"{lists[-1][1]}. ", lists[-1][1] + 1
                out.prefix = before + mark
            elif tag in ("dd", "blockquote"):
                out.prefix = before + "  "
            inner = lists
            if tag in ("ol", "ul", "menu"):
                start = node.attributes.get("start", "1")
                inner = [*lists, [tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1]]
            todo.append(("close", node, before, lists))
            todo += [("text", c, keep or tag in ("pre", "textarea"), inner) if isinstance(c, str) else ("open", c, keep or tag == "pre", inner) for c in reversed(node.children)]
    out.end()
    return [line.rstrip() for line in out.lines]


def render(page: str | None) -> str:
    """The visible text of a page; null or empty: empty."""
    return "\n".join(lay_out(parse(page or ""))).strip("\n")


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, text, n_lines) for every row of ``pages``; null and empty pages give an empty text and no line, repeated
    rows and null keys are passed through, pages of any length are read whole, other columns (also those named like the
    result's) are left out, and an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [render(p) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=[key, "text", "n_lines"])

    return spread(pages.select(key, page)).mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, text string, n_lines bigint")
