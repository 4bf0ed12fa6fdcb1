"""Visible text of HTML pages, laid out roughly as a browser would.

A tolerant tokeniser feeds a tree builder that supplies the tags which HTML lets authors leave out; a renderer then walks
the tree with visibility rules, also those of the page's own style sheets, and writes blocks with their spacing, lists
with their markers, preformatted text as it is, and tables with aligned cells. Neither is recursive, so deep nesting is
harmless, and no tag makes either walk through all that is open, so both take time in proportion to the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm._common import bounded_batches

SCHEMA = "page_id long, text string, n_lines long"

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is characters up to their own end tag; entities count in the second kind.
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_ESCAPED = frozenset("textarea title".split())
#: Elements before which an open paragraph ends.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li main menu nav ol p pre section summary table ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What ends before an element begins, if it is open within the innermost element of the second set.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "option": ({"option"}, {"select", "datalist", "td", "th", "table"}),
    "optgroup": ({"optgroup", "option"}, {"select", "td", "th", "table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, set()),
}
#: Inside these, text and other elements stand before the table.
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
IN_TABLE = frozenset("caption colgroup col tbody thead tfoot tr td th script style template".split())
CELL_WALLS = frozenset("td th caption".split())
HIDDEN = frozenset("head title script style template noembed noframes iframe datalist rp param object audio video canvas".split())
#: What browsers don't draw inside svg and math.
HIDDEN_FOREIGN = {
    "svg": frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
#: Blank lines around blocks; elements not named are inline.
MARGIN = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre xmp figure table fieldset hr".split(), 1) | dict.fromkeys(
    "html body address article aside center details dialog div dd dt figcaption footer form header hgroup legend li main nav optgroup option"
    " section select summary textarea text caption".split(), 0
)
LISTS = frozenset("ul ol menu dir".split())
#: Lines of a cell that another one stands beside are wrapped at this many characters.
WRAP = 80
#: The most characters that a cell is moved to the right at a time, and that a line is indented.
GAP, INDENT = 1000, 200
#: Tables inside one another; the rows of those still deeper are lines.
TABLES = 32
#: The most columns and rows of a cell (fixed values of the standard).
SPANS = {"colspan": 1000, "rowspan": 65534}

NAME = re.compile(r"[^\s/>]+")
#: The rest of a tag: attributes with quoted values that may hold ">".
REST = re.compile(r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=\s*+[^\s>]*+|["'])*+>""")
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"[ \t\n\f\r]+")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: An element name, a class, an id, or an element's name with one of these.
SELECTOR = re.compile(r"(\*|[a-z][\w-]*)?(?:([.#])([\w-]+))?\Z", re.I)
DIGITS = re.compile(r"\s*\+?([0-9]{1,9})")


class Node:
    __slots__ = ("attrs", "children", "drawn", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.drawn = tag, attrs, [], True

    def attributes(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, value in ATTR.findall(self.attrs):
            if value[:1] in ("'", '"'):
                value = value[1:-1]
            found.setdefault(name.lower(), unescape(value))
        return found


def ends_itself(attrs: str) -> bool:
    """Whether a tag inside svg or math is its own end tag: not, if the slash ends an attribute without quotes."""
    if not attrs.endswith("/"):
        return False
    last = re.split(r"[\s>]", attrs[-4096:])[-1]
    before = attrs[: len(attrs) - len(last)].rstrip()
    return not (re.search(r"""=[^"'].""", last, re.S) or before.endswith("=") and len(last) > 1 and last[0] not in "\"'")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", characters), ("start", name, attributes) and ("end", name, "") in order; comments and declarations go."""
    at, n, foreign = 0, len(html), 0
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", "", html[at:]
            return
        follows = html[lt + 1 : lt + 2]
        if follows.isascii() and follows.isalpha() or follows == "/" and html[lt + 2 : lt + 3].isalpha():
            if lt > at:
                yield "text", "", html[at:lt]
            end = follows == "/"
            name_at = NAME.match(html, lt + 1 + end)
            name = name_at.group().lower()
            rest = REST.match(html, name_at.end())
            close = rest.end() if rest else html.find(">", name_at.end()) + 1 or n
            attrs = "" if end else html[name_at.end() : close - 1]
            yield ("end" if end else "start"), name, attrs
            at = close
            if name in HIDDEN_FOREIGN:
                foreign = max(foreign + (-1 if end else not ends_itself(attrs)), 0)
            if not end and (name in RAW or name in RAW_ESCAPED) and not (foreign and ends_itself(attrs)):
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                to = stop.start() if stop else n
                yield "raw", name, html[at:to]
                at = to
        elif follows in ("!", "?", "/"):
            if lt > at:
                yield "text", "", html[at:lt]
            if html.startswith("<!--", lt):
                # "<!-->" and "<!--->" are comments too.
                to = html.find("-->", lt + 2)
                at = to + 3 if to >= 0 else n
            else:
                at = html.find(">", lt) + 1 or n
        else:
            yield "text", "", html[at : lt + 1]
            at = lt + 1


def parsed(html: str) -> Node:
    """The tree of a page below one root; the root's attributes are the texts of its style sheets."""
    root = Node("#root")
    stack: list[Node] = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of each name are
    sheets: list[str] = []

    def innermost(names) -> int:
        return max((places[t][-1] for t in names if places[t]), default=0)

    def pop_to(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def close(tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        """End the outermost of ``tags`` that is open within the innermost of ``walls``."""
        wall, found = innermost(walls), 0
        for at in filter(None, (places[t] for t in tags)):
            if at[-1] > wall:
                first = at[bisect_right(at, wall)]
                found = min(found or first, first)
        if found:
            pop_to(found)

    def add(child: Node | str, foster: bool) -> None:
        here = stack[-1]
        if foster and here.tag in TABLE_PARTS and places["table"]:
            stack[places["table"][-1] - 1].children.insert(-1, child)
        else:
            here.children.append(child)

    def push(node: Node, foster: bool = False) -> None:
        add(node, foster)
        places[node.tag].append(len(stack))
        stack.append(node)

    for kind, name, data in tokens(html):
        if kind == "text":
            if stack[-1].tag in TABLE_PARTS and not data.strip():
                continue
            add(unescape(data) if "&" in data else data, foster=True)
        elif kind == "raw":
            if data:
                stack[-1].children.append(unescape(data) if name in RAW_ESCAPED else data)
            if name == "style" and stack[-1].tag == "style" and for_screens(stack[-1].attributes().get("media", "")):
                sheets.append(data)
        elif kind == "start":
            if name in ("html", "body") and places[name]:
                continue
            if places["head"] and name not in ("meta", "link", "base", "title", "style", "script", "noscript", "template", "head"):
                close({"head"}, set())
            if name in ENDS_P and places["p"]:
                close({"p"}, {"td", "th", "caption", "button", "table", "object"})
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                pop_to(len(stack) - 1)
            if name in IMPLIED_ENDS:
                close(*IMPLIED_ENDS[name])
            if name in ("td", "th") and places["table"] and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(Node("tr"))
            elif name == "a" and places["a"]:
                close({"a"}, {"td", "th", "caption", "table"})
            node = Node(name, data)
            inside = [f for f in HIDDEN_FOREIGN if places[f]]
            node.drawn = not any(name in HIDDEN_FOREIGN[f] for f in inside)
            if name in VOID or (inside or name in HIDDEN_FOREIGN) and ends_itself(data):
                add(node, name not in IN_TABLE)
            else:
                push(node, name not in IN_TABLE)
        elif name == "br":
            add(Node("br"), True)
        elif places[name]:
            walls = () if name in TABLE_PARTS or name in CELL_WALLS else CELL_WALLS
            if name not in TABLE_PARTS:
                walls = (*walls, "table")
            at = places[name][-1]
            if at >= innermost(walls):
                pop_to(at)
    root.attrs = "\n".join(sheets)
    return root


def for_screens(media: str) -> bool:
    """Whether a list of media names those of a screen."""
    kinds = [re.findall(r"[a-z-]+", m.lower())[:2] for m in media.split(",")]
    return any(not k or (k[0] in ("all", "screen", "only", "and") or k[0].startswith("m")) and "print" not in k for k in kinds)


class Styles:
    """What style sheets say about display and visibility, by element name, class, id, or a name with one of these.

    Other selectors are passed over. Of several rules that fit, important ones win, then ids, then classes, then the last.
    """

    def __init__(self, css: str) -> None:
        self.rules: dict[str, dict[tuple[str, str, str], tuple[tuple, str]]] = {"display": {}, "visibility": {}}
        css, at, opened = COMMENT.sub(" ", css), 0, [True]
        for i, brace in enumerate(re.finditer(r"[{}]", css)):
            text, at = css[at : brace.start()], brace.end()
            if brace.group() == "{":
                prelude = text.rpartition(";")[2].strip()
                if prelude.startswith("@"):
                    name, _, rest = prelude[1:].partition(" ")
                    opened.append(opened[-1] and (name.lower() == "media" and for_screens(rest) or name.lower() in ("supports", "layer")))
                    selectors = []
                else:
                    opened.append(opened[-1])
                    selectors = prelude.split(",")
            else:
                if opened[-1] and selectors:
                    self._add(selectors, text, i)
                selectors = []
                if len(opened) > 1:
                    opened.pop()

    def _add(self, selectors: list[str], text: str, order: int) -> None:
        for name, value, important in DECLARED.findall(text):
            for s in selectors:
                m = SELECTOR.match(s.strip())
                if m and m.group():
                    tag, mark, of = (m.group(1) or "*").lower(), m.group(2) or "", m.group(3) or ""
                    rank = (bool(important), False, mark == "#", mark == ".", tag != "*", order)
                    rules, key = self.rules[name.lower()], (tag, mark, of)
                    if key not in rules or rank >= rules[key][0]:
                        rules[key] = (rank, value.lower())

    def of(self, node: Node, attrs: dict[str, str]) -> dict[str, str]:
        keys = [(t, *x) for t in ("*", node.tag) for x in (("", ""), ("#", attrs.get("id", "")), *((".", c) for c in attrs.get("class", "").split()))]
        found = {}
        for name, rules in self.rules.items():
            fits = [rules[k] for k in keys if k in rules] if rules else []
            if fits:
                found[name] = max(fits)
        for name, value, important in DECLARED.findall(attrs.get("style", "")):
            rank = (bool(important), True, False, False, False, 0)
            if name.lower() not in found or rank >= found[name.lower()][0]:
                found[name.lower()] = (rank, value.lower())
        return {k: v for k, (_, v) in found.items()}


class Page:
    """Lines under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent, self.marker, self.blank, self.spaced = 0, "", 0, True

    def text(self, data: str) -> None:
        data = SPACE.sub(" ", data)
        if self.spaced:
            data = data.lstrip(" ")
        if data:
            self.now.append(data)
            self.spaced = data.endswith(" ")

    def whole(self, data: str) -> None:
        """Preformatted characters."""
        first, *others = data.replace("\r\n", "\n").split("\n")
        self.now.append(first)
        for x in others:
            self.newline()
            self.now.append(x)
        self.spaced = False

    def newline(self) -> None:
        """End a line, also an empty one."""
        self.put("".join(self.now))
        self.now, self.spaced = [], True

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.extend([""] * self.blank)
        self.blank = 0
        lead = " " * (min(self.indent, INDENT) - len(self.marker)) + self.marker
        self.marker = ""
        self.lines.append((lead + line).rstrip())

    def item(self, mark: str) -> None:
        if len(self.marker) > INDENT:
            self.put("")
        self.indent, self.marker = self.indent + len(mark), self.marker + mark

    def block(self, margin: int) -> None:
        """The border of a block: what is begun ends, and ``margin`` blank lines at least come before what follows."""
        if any(map(str.strip, self.now)):
            self.newline()
        self.now, self.spaced = [], True
        if self.lines and not self.marker:
            self.blank = max(self.blank, margin)

    def done(self) -> list[str]:
        self.block(0)
        return self.lines


def _span(node: Node, name: str) -> int:
    """The columns or rows of a cell; a rowspan of 0 reaches to the end of the table."""
    found = DIGITS.match(node.attributes().get(name, "")) if name in node.attrs.lower() else None
    n = int(found.group(1)) if found else 1
    return min(n, SPANS[name]) if n else SPANS[name] if name == "rowspan" else 1


def wrapped(line: str) -> list[str]:
    """``line`` in pieces of up to WRAP characters, or of one word, cut at spaces."""
    out, at = [], 0
    while len(line) - at > WRAP:
        cut = line.rfind(" ", at + 1, at + WRAP + 1)
        if cut < 0 or not line[at:cut].strip():
            cut = line.find(" ", at + WRAP)
        if cut < 0:
            break
        out.append(line[at:cut])
        at = cut + 1
    return [*out, line[at:]]


class Covered:
    """The columns of a row that cells from above cover, as stretches that don't touch."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # (first row that is free again, start, end) of each cell

    def free(self, col: int) -> int:
        """The first free column from ``col`` on."""
        i = bisect_right(self.starts, col) - 1
        return max(col, self.ends[i]) if i >= 0 else col

    def add(self, start: int, end: int, until: int) -> None:
        heappush(self.until, (until, start, end))
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def at_row(self, row: int) -> None:
        while self.until and self.until[0][0] <= row:
            _, start, end = heappop(self.until)
            i = bisect_right(self.starts, start) - 1
            if i >= 0 and self.ends[i] > start:  # not so, where cells lie over one another
                left = [(a, b) for a, b in ((self.starts[i], start), (end, self.ends[i])) if a < b]
                self.starts[i : i + 1], self.ends[i : i + 1] = [a for a, _ in left], [b for _, b in left]


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """The lines of a table whose rows hold (lines, colspan, rowspan) of each cell.

    The cells of a column begin at one place in all lines. As in a browser, text that another cell stands to the right
    of is wrapped. A cell that would have to be moved by more than GAP characters of padding is moved by so many.
    """
    covered = Covered()
    grid: list[list[tuple[int, list[str]]]] = []
    width: dict[int, int] = {}
    for n, row in enumerate(rows):
        covered.at_row(n)
        placed, col, new = [], 0, []
        last = max((i for i, (lines, _, _) in enumerate(row) if any(lines)), default=-1)
        for i, (lines, across, down) in enumerate(row):
            col = covered.free(col)
            if i < last and any(len(x) > WRAP for x in lines):
                lines = [y for x in lines for y in wrapped(x)]
            placed.append((col, lines))
            if down > 1:
                new.append((col, col + across, n + down))
            if across == 1:
                longest = max(map(len, lines), default=0)
                width[col] = max(width.get(col, 0), longest if i < last else min(longest, WRAP))
            col += across
        grid.append(placed)
        for x in new:
            covered.add(*x)
    columns = sorted(width)
    sums = [0, *accumulate(width[c] for c in columns)]
    out = []
    for placed in grid:
        lines = [["", 0, 0] for _ in range(max((len(lines) for _, lines in placed), default=0))]
        parts: list[list[str]] = [[] for _ in lines]
        for col, cell in placed:
            place = 2 * col + sums[bisect_left(columns, col)]
            for i, x in enumerate(cell):
                if x:
                    # Where a line really is, and where it would be without bounds to its gaps.
                    _, real, due = lines[i]
                    gap = min(max(place - due, 2 if real else 0), GAP)
                    parts[i].append(" " * gap + x)
                    lines[i] = ["", real + gap + len(x), max(place, due) + len(x)]
        out.extend("".join(p).rstrip() for p in parts)
    return out


def rendered(root: Node) -> str:
    """The visible text below ``root``."""
    pages, styles = [Page()], Styles(root.attrs)
    ruled = any(styles.rules.values())
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    lists: list[list] = []  # [ordered, next number]
    pre, deep, marks, saved = 0, 0, [], []
    # What is left to do: (node, visible, entering or leaving).
    todo: list[tuple[Node | str, bool, bool]] = [(root, True, True)]
    while todo:
        node, visible, entering = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if visible:
                page.whole(node) if pre else page.text(node)
            continue
        tag = node.tag
        if not entering:
            if tag in ("td", "th"):
                cell = pages.pop().done()
                pre, lists = saved.pop()
                if tables[-1]:
                    tables[-1][-1].append((cell, _span(node, "colspan"), _span(node, "rowspan")))
                continue
            if tag == "table":
                deep -= 1
                if deep < TABLES:
                    for line in aligned(tables.pop()):
                        page.put(line)
            elif tag == "li":
                page.block(0)
                if page.marker:  # an item without text keeps its marker
                    page.put("")
                page.indent -= marks.pop()
            elif tag in ("dd", "blockquote"):
                page.block(0)
                page.indent -= 2
            elif tag in ("pre", "textarea", "xmp"):
                pre -= 1
                page.spaced = not page.now
            elif tag in LISTS:
                lists.pop()
            page.block(MARGIN[tag] if tag not in LISTS or not lists else 0)
            continue
        if tag in HIDDEN or not node.drawn:
            continue
        if node is not root and (ruled or node.attrs and ("hidden" in node.attrs.lower() or "style" in node.attrs.lower())):
            attrs = node.attributes() if node.attrs else {}
            css = styles.of(node, attrs)
            hidden = "hidden" in attrs and attrs["hidden"].lower() != "until-found"
            if css.get("display", "none" if hidden else "") == "none":
                continue
            if "visibility" in css:
                visible = css["visibility"] not in ("hidden", "collapse")
        if tag == "br":
            if visible:
                page.newline()
            continue
        if tag == "input":
            attrs = node.attributes()
            if visible and attrs.get("type", "").lower() in ("submit", "reset", "button"):
                page.text(attrs.get("value", ""))
            continue
        if tag in ("td", "th"):
            if not tables or deep > TABLES:  # a cell outside a table is a block
                node.tag = tag = "div"
            else:
                pages.append(Page())
                saved.append((pre, lists))  # layout inside a cell starts anew
                pre, lists = 0, []
                todo.append((node, visible, False))
        if tag == "tr":
            if tables and deep <= TABLES:
                tables[-1].append([])
            else:
                node.tag = tag = "div"
        margin = MARGIN.get(tag)
        if margin is not None:
            page.block(margin if tag not in LISTS or not lists else 0)
            todo.append((node, visible, False))
            if tag == "table":
                if deep < TABLES:
                    tables.append([])
                deep += 1
            elif tag in LISTS:
                start = node.attributes().get("start", "1") if tag == "ol" else "1"
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                marks.append(len(mark))
                page.item(mark)
            elif tag in ("dd", "blockquote"):
                page.indent += 2
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = node.children[0].removeprefix("\n")
        children = node.children
        if tag == "details" and "open" not in node.attributes():
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        todo.extend((c, visible, True) for c in reversed(children))
    return "\n".join(pages[0].done()).strip("\n").replace("\u00a0", " ")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text and n_lines of each row of ``pages`` (page_id, html).

    Text that no rule hides is kept, also labels in svg and formulas in MathML: not in head, scripts, styles, templates,
    closed details or under the attribute hidden, display:none and visibility:hidden (unless made visible again), be it
    by attribute or by a rule of the page's style sheets for screens on a name, a class or an id; nor titles, definitions
    and annotations in svg and MathML. Cells of a table begin at one place in all its rows; where another cell follows
    in the row, their text is wrapped at 80 characters. Lines are indented by 200 characters at most, and padded by 1000
    at most from one cell to the next; tables inside more than 32 others are written as lines.

    A null or empty html, or one without visible text, gives an empty text of no lines. A page of any length is read
    whole, in time in proportion to it, by one task that holds its tree. Malformed markup is read as far as it goes. A
    null page_id stays null; repeated rows are rendered once each; no row gives no rows. Other columns are ignored.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [rendered(parsed(h)) if h else "" for h in b.column(1).to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_lines"])

    return pages.select("page_id", "html").mapInArrow(run, SCHEMA)
