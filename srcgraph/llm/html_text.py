"""HTML extraction: a tree builder with implied tags, then a rendering that keeps the layout.

All visible text comes out: blocks on lines of their own, paragraphs and headings apart by an empty
line, lists with bullets or numbers and their depth, table cells in aligned columns, preformatted
text as it is. Scripts, styles, the head, hidden elements and comments are not visible; nor is what the page's own
style rules hide, as far as their selectors are single elements (a tag, classes, an id), or what a closed
<details> holds. Cells with lists, line breaks or tables within keep their lines.

Passes use explicit stacks; only tables within tables recurse, and DEEPEST bounds those. Each page is a row of
its own: no shuffle.

Defined cases: null or empty markup renders to the empty text; unclosed and misnested tags are
closed where the rules imply it; markup that ends inside a tag or comment ends there; equal pages
give equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re

from pyspark.sql import DataFrame

from .base import map_texts

# Element classes (fixed values of the markup language).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript datalist iframe noembed noframes object audio video canvas svg math param meta link base rp".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hgroup menu".split())
BLOCK = APART | frozenset("html body div section article aside header footer nav main address form fieldset legend details summary li dt dd dir center figcaption hr tr caption search option optgroup thead tbody tfoot".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
# A start tag closes these open elements first, not looking further out than the listed borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
CLOSES["thead"] = CLOSES["tfoot"] = CLOSES["tbody"]
NEEDS_PARAGRAPH_END = (BLOCK | {"hr"}) - frozenset("html body tr td th thead tbody tfoot caption option optgroup legend summary figcaption".split())
BORDERS = frozenset("table td th caption button object html".split())
#: Deeper elements become siblings, as in browsers.
DEEPEST = 300

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "hidden", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children, self.hidden = tag, attributes, [], False


def tree(markup: str) -> Node:
    """The element tree; children are nodes and strings."""
    root = Node("html")
    stack = [root]

    def close(tags: frozenset | set, borders: frozenset | set) -> None:
        """Close the outermost open element of `tags` inside the innermost of `borders`."""
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in borders:
                break
            if stack[i].tag in tags:
                found = i
        if found:
            del stack[found:]

    def text(value: str) -> None:
        if value:
            if stack[-1].tag == "head" and value.strip():
                del stack[-1]
            stack[-1].children.append(html.unescape(value))

    at, end = 0, len(markup)
    while at < end:
        m = TOKEN.search(markup, at)
        if m is None:
            text(markup[at:])
            break
        text(markup[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                border = frozenset() if tag in BORDERS or tag in ("tr", "tbody", "thead", "tfoot", "body") else frozenset(("table", "td", "th"))
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in border:
                        break
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            del stack[-1]
        if tag in NEEDS_PARAGRAPH_END:
            close({"p"}, BORDERS)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(markup, at)
            inner = markup[at : stop.start() if stop else end]
            if tag == "style":
                node.children.append(inner)
            elif tag not in HIDDEN:
                node.children.append(html.unescape(inner))
            at = stop.start() if stop else end
            stack.append(node)
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "math")) and len(stack) < DEEPEST:
            stack.append(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attributes)}


#: One rule of a style sheet without nested blocks; a selector of one element.
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
SHOWS = re.compile(r"(?:^|;)display:([a-z-]+)(!important)?")


def rules(sheet: str) -> list[tuple[tuple, str, frozenset, frozenset, bool]]:
    """(weight, tag, classes, ids, hides) of the rules that set display, in order. Blocks of @-rules are passed over."""
    flat = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
    flat = re.sub(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*(?:\}|\Z))", "", flat)
    found = []
    for n, m in enumerate(RULE.finditer(flat)):
        shown_as = SHOWS.findall(SPACE.sub("", m[2].lower()))
        for one in m[1].split(",") if shown_as else ():
            part = SELECTOR.fullmatch(one.strip())
            if part and part[0]:
                names = re.findall(r"([.#])([\w-]+)", part[2])
                classes, ids = (frozenset(x for sign, x in names if sign == s) for s in ".#")
                tag = (part[1] or "*").lower()
                found.append(((bool(shown_as[-1][1]), len(ids), len(classes), tag != "*", n), tag, classes, ids, shown_as[-1][0] == "none"))
    return sorted(found, key=lambda r: r[0])


def marked(root: Node) -> Node:
    """The tree with what style rules hide marked, and closed <details> without what they hold."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        if node.tag == "details" and "open" not in attributes(node):
            node.children = [c for c in node.children if not isinstance(c, str) and c.tag == "summary"][:1]
        todo.extend(c for c in node.children if not isinstance(c, str))
    listed = rules("\n".join(c for n in nodes if n.tag == "style" for c in n.children if isinstance(c, str)))
    for node in nodes if listed else ():
        found = attributes(node) if node.attributes else {}
        classes, own = set(found.get("class", "").split()), found.get("id")
        for weight, tag, wanted, ids, hides in listed:
            if tag in ("*", node.tag) and wanted <= classes and ids <= {own} and (weight[0] or not SHOWS.search(style_of(found))):
                node.hidden = hides
    return root


def visible(node: Node) -> bool:
    if node.hidden or node.tag in HIDDEN:
        return False
    if not node.attributes or not node.attributes.strip():
        return True
    found = attributes(node)
    if "hidden" in found or node.tag == "dialog" and "open" not in found or node.tag == "input" and found.get("type", "").lower() == "hidden":
        return False
    return not re.search(r"(?:^|;)display:none", style_of(found))


def style_of(found: dict[str, str]) -> str:
    return SPACE.sub("", found.get("style", "").lower())


def shown(node: Node, inherited: bool) -> bool:
    """Whether text right inside node shows: visibility passes down until an element sets it anew."""
    if not node.attributes or "visibility" not in node.attributes.lower():
        return inherited
    found = re.findall(r"(?:^|;)visibility:(visible|hidden|collapse)", style_of(attributes(node)))
    return found[-1] == "visible" if found else inherited


class Page:
    """Lines as they are laid out."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.mark = ""
        self.indent = 0

    def end_line(self) -> None:
        content = "".join(self.line).rstrip(" ")
        self.line = []
        if content.strip(" "):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead = " " * self.indent
            if self.mark:
                lead, self.mark = " " * max(0, self.indent - len(self.mark)) + self.mark, ""
            self.lines.append(lead + content)

    def words(self, value: str) -> None:
        value = SPACE.sub(" ", value)
        if value.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            value = value[1:]
        if value:
            self.line.append(value)

    def preformatted(self, value: str) -> None:
        first, *rest = value.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for part in rest:
            content = "".join(self.line)
            self.line = []
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((" " * self.indent + content).rstrip(" "))
            self.line.append(part)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


#: Elements that make a cell keep its lines.
LINED = frozenset("ul ol menu dl pre br table".split())


def cell_text(node: Node, inherited: bool) -> str:
    """One line, or several where the cell holds what is made of lines."""
    made, todo = render(node, shown(node, inherited)), [node]
    while todo:
        if todo[-1].tag in LINED and todo[-1] is not node:
            return "\n".join(line for line in made.split("\n") if line.strip())
        todo.extend(c for c in todo.pop().children if not isinstance(c, str))
    return SPACE.sub(" ", " ".join(made.split("\n"))).strip(" ")


def span(node: Node, name: str = "colspan") -> int:
    value = attributes(node).get(name, "") if name in node.attributes.lower() else ""
    return min(1000, max(1, int(value))) if value.isdecimal() and value.isascii() and len(value) < 6 else 1


def table_lines(table: Node, inherited: bool) -> list[str]:
    """Captions and stray text first, then rows with padded columns. A cell that spans columns is not
    counted for their widths; one that spans rows keeps its columns blank in the rows below."""
    lead: list[str] = []
    rows: list[list[tuple[int, str, int]]] = []  # (column, text, columns)
    taken: dict[int, int] = {}  # rows for which a column is still taken from above
    todo: list[tuple[Node | str, bool]] = [(child, inherited) for child in reversed(table.children)]
    while todo:
        node, seen = todo.pop()
        if isinstance(node, str):
            if seen and node.strip():
                lead.append(SPACE.sub(" ", node).strip(" "))
        elif not visible(node):
            continue
        elif node.tag in ("tbody", "thead", "tfoot"):
            todo.extend((child, shown(node, seen)) for child in reversed(node.children))
        elif node.tag == "tr":
            seen, row, at, below = shown(node, seen), [], 0, {c: n - 1 for c, n in taken.items() if n > 1}
            for cell in node.children:
                if isinstance(cell, str) and not (seen and cell.strip()) or not isinstance(cell, str) and not visible(cell):
                    continue
                while at in taken:
                    at += 1
                value, wide = (SPACE.sub(" ", cell).strip(" "), 1) if isinstance(cell, str) else (cell_text(cell, seen), span(cell))
                row.append((at, value, wide))
                deep = 1 if isinstance(cell, str) else span(cell, "rowspan")
                if deep > 1:
                    below.update((c, deep - 1) for c in range(at, at + wide))
                at += wide
            rows.append(row)
            taken = below
        elif node.tag not in ("col", "colgroup") and (value := cell_text(node, seen)):
            lead.append(value)
    widths: dict[int, int] = {}
    for row in rows:
        for at, value, n in row:
            if n == 1:
                widths[at] = max(widths.get(at, 0), *map(len, value.split("\n")))
    lines = [line for value in lead for line in value.split("\n")]
    for row in rows:
        split = [(at, value.split("\n"), n) for at, value, n in row]
        for k in range(max((len(v) for _, v, _ in split), default=0)):
            parts, column = [], 0
            for at, values, n in split:
                parts += ["".ljust(widths.get(c, 0)) for c in range(column, at)]
                parts.append((values[k] if k < len(values) else "").ljust(sum(widths.get(at + i, 0) for i in range(n)) + 3 * (n - 1)))
                column = at + n
            if line := " | ".join(parts).rstrip(" |"):
                lines.append(line)
    return lines


def render(root: Node, seen: bool = True) -> str:
    page = Page()
    # (node, entering?, preformatted?, shown?)
    todo: list[tuple] = [(child, True, False, seen) for child in reversed(root.children)]
    lists: list[list] = []
    while todo:
        node, entering, pre, seen = todo.pop()
        if isinstance(node, str):
            if seen:
                (page.preformatted if pre else page.words)(node)
            continue
        tag = node.tag
        if entering:
            if not visible(node):
                continue
            seen = shown(node, seen)
            if tag == "br":
                page.end_line()
                continue
            if tag in BLOCK:
                page.end_line()
                if tag in APART and not (tag in ("ul", "ol", "menu") and lists):
                    page.gap = True
            if tag == "table":
                for line in table_lines(node, seen):
                    page.line.append(line)
                    page.end_line()
                page.gap = True
                continue
            if tag in ("ul", "ol", "menu"):
                found = attributes(node) if tag == "ol" and node.attributes else {}
                down, start = "reversed" in found, found.get("start", "")
                first = sum(not isinstance(c, str) and c.tag == "li" and visible(c) for c in node.children) if down else 1
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else first, -1 if down else 1])
                page.indent += 2 if tag != "ol" else 3
            elif tag == "li":
                ordered = lists and lists[-1][0]
                own = attributes(node).get("value", "") if ordered and node.attributes else ""
                if re.fullmatch(r"-?[0-9]{1,9}", own):
                    lists[-1][1] = int(own)
                page.mark = f"{lists[-1][1]}. " if ordered else "- "
                if ordered:
                    lists[-1][1] += lists[-1][2]
            elif tag in ("blockquote", "dd"):
                page.indent += 2
            elif tag in ("td", "th"):
                page.words(" ")
            todo.append((node, False, pre, seen))
            inside = pre or tag in ("pre", "textarea", "xmp")
            todo.extend((child, True, inside, seen) for child in reversed(node.children))
            continue
        if tag in BLOCK:
            page.end_line()
            if tag in APART and not (tag in ("ul", "ol", "menu") and len(lists) > 1):
                page.gap = True
        if tag in ("ul", "ol", "menu"):
            lists.pop()
            page.indent -= 2 if tag != "ol" else 3
        elif tag == "li":
            page.mark = ""
        elif tag in ("blockquote", "dd"):
            page.indent -= 2
    return page.text()


def extract(markup: str) -> str:
    """The visible text of a page."""
    return render(marked(tree(markup)))


def extract_pages(df: DataFrame, keys: list[str], column: str = "html") -> DataFrame:
    """keys, text, its length, lines and digest."""

    def one(markup: str) -> tuple:
        text = extract(markup)
        return text, len(text), text.count("\n") + 1 if text else 0, hashlib.sha256(text.encode()).hexdigest()

    return map_texts(df, keys, column, one, "text string, n_chars long, n_lines long, text_sha256 string")
