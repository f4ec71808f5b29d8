"""Visible text of HTML pages, laid out.

A tokenizer, a tree builder with implied tags, visibility rules and a renderer.
The builder closes paragraphs, list items, table parts and options where the
language implies it, opens the table body and row that a cell implies, and
ignores end tags without a start.  Hidden are: metadata, scripts, styles and
templates, closed dialogs, all but the summary of closed details, the fallback
of embedded media, what svg and math hold but do not draw in place (definitions,
descriptions, annotations), and what `display` and `visibility` hide.  Those two
cascade as in a browser: style sheets (tags, classes, ids, attributes, compounds
of them, and all four combinators; importance, specificity and order), inline
styles above them, the `hidden` attribute below; `visibility` is inherited, so a
visible child of a hidden element shows.  Rules with pseudo-classes, and rules that hold only in print, on
some screens or under other conditions, hide nothing.

Texts of svg and rows of math tables stand on lines of their own.  The renderer
collapses white space as a browser does, keeps it in preformatted text, sets
blocks on lines of their own with a blank line around paragraphs, headings,
lists and tables, marks and indents list items, and aligns the cells of a table
in columns.

All of it takes time and memory in proportion to the page, whatever its markup:
indentation and alignment add at most ROOM times the page's length.  Beyond that
an indentation is written as its width in braces, a column is as wide as the
widest of its cells that fit in, and tables inside of more than ROOM others are
written cell by cell.  No text is left out, and no element is moved.

Edge cases: a null page gives null, an empty one the empty text; plain text is
its own rendering; broken markup never fails: what cannot be a tag is text;
pages, cells and nesting of any size are read whole; repeated rows are rendered
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stream, table

#: Characters that layout may add, and times that a text may be copied, for each character of a page; and characters any page may add.
ROOM, LEAST_ROOM = 32, 100_000

#: Fixed value sets of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
NEVER = frozenset("head meta link base script style template title noembed noframes iframe object audio video canvas datalist param source track".split())
#: Start tags that leave the head open.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: Inside of svg and math: what is never drawn in place, and what begins a line.
FOREIGN = frozenset(["svg", "math"])
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
OWN_LINE = frozenset(["text", "mtr"])
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table ul caption thead tbody tfoot tr td th".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul dir fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: An opening tag closes these, up to the named limits.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "thead": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select datalist".split())),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: End tags do not reach out of these.
SCOPE = frozenset("table td th caption html template".split())

CLOSES_P_WITHIN = SCOPE | {"button"}
P = frozenset(["p"])

# Quotation marks count only after an equals sign; in pages with one left open, quoted values end before the next tag.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_CLOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"<]*+\"|'[^'<]*+'|(?![\"'])))*+)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLED = re.compile(r"display|visibility", re.I)
_NOTE = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_STRING = re.compile(r"\"((?:\\.|[^\"\\])*+)\"|'((?:\\.|[^'\\])*+)'", re.S)
_TAME = re.compile(r"[\w ./:#%-]*")
_BRACE = re.compile(r"[{};]")
_COMPOUND = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+|\[[^\]]*\])*)\Z")
_PART = re.compile(r"[.#][\w-]+|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*([^\]]*?)\s*)?\]")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
#: Media that a page on a screen always has.
SCREEN = frozenset(["", "all", "screen", "only all", "only screen", "not print"])
#: Values of display that make an element a block of its own, or run it in with the text.
AS_BLOCK = frozenset("block flex grid flow-root list-item table".split())
AS_INLINE = frozenset("inline inline-block inline-flex inline-grid inline-table contents ruby".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "shown", "seen", "layout", "above", "own", "last", "past")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent
        #: Whether it is displayed, whether it is visible, and how display lays it out.
        self.shown, self.seen, self.layout = True, True, None
        #: Matched selector parts: of its ancestors, its own, of its last child so far and of all children so far.
        self.above = self.own = self.last = self.past = 0


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        value = a or b or c
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on any screen, whatever its size."""
    return any(" ".join(q.lower().split()) in SCREEN for q in media.split(","))


def _unquoted(css: str) -> str:
    """Without comments and quotation marks; strings that hold marks of the language are emptied."""
    return _STRING.sub(lambda m: s if _TAME.fullmatch(s := m[1] or m[2] or "") else "", _NOTE.sub("", css))


def declared(declarations: str) -> dict[str, tuple[bool, str]]:
    """(important, value) of display and visibility; of two for a property the last counts, or the important one."""
    found: dict[str, tuple[bool, str]] = {}
    if _STYLED.search(declarations):
        for d in declarations.split(";"):
            name, _, value = d.partition(":")
            name = name.strip().lower()
            if name in ("display", "visibility"):
                value, mark, _ = value.lower().partition("!")
                if mark or not found.get(name, (False,))[0]:
                    found[name] = (bool(mark), value.strip())
    return found


def selector(text: str) -> tuple[list[tuple[str, list[str]]], tuple[int, int, int]] | None:
    """(combinator, simple selectors) of each compound from left to right, and the specificity; None if it can't be told on a still page."""
    pieces = _COMBINATOR.split(text.strip().replace(":root", "html"))
    parts, rank = [], [0, 0, 0]
    for i in range(0, len(pieces), 2):
        m = _COMPOUND.match(pieces[i])
        if m is None or not pieces[i]:
            return None
        simple = [m[1].lower()] if m[1] and (m[1] != "*" or not m[2]) else []
        rank[2] += bool(simple) and simple[0] != "*"
        for p in _PART.finditer(m[2]):
            rank[0 if p[0][0] == "#" else 1] += 1
            simple.append(p[0] if p[1] is None else f"[{p[1].lower()}{p[2] or ''}{p[3] or ''}]")
        parts.append((pieces[i - 1] or " " if i else "", list(dict.fromkeys(simple))))
    return parts, tuple(rank)


def _holds(test: str, value: str, of: str) -> bool:
    """An attribute selector's comparison."""
    if test == "~=":
        return of in value.split()
    if test == "|=":
        return value == of or value.startswith(of + "-")
    return value == of if test == "=" else bool(of) and {"^=": value.startswith, "$=": value.endswith, "*=": value.__contains__}[test](of)


class Cascade:
    """All rules of a page as one bit-parallel machine over the tree.

    Every compound of every selector is a bit, the compounds of a selector side
    by side; a compound matches if its simple selectors do and the one before it
    has matched where its combinator looks.  Selectors lie in the order of the
    cascade, so the highest matched one of a property wins.
    """

    def __init__(self, rules: list[tuple]):
        """rules: (important, specificity, order, property, value, parts)."""
        rules = sorted(rules, key=lambda r: r[:3])
        self.simple: list[dict[str, int]] = []
        self.bits = {"": 0, " ": 0, ">": 0, "+": 0, "~": 0}
        self.ends = {"display": 0, "visibility": 0}
        self.value: dict[int, tuple[bool, str]] = {}
        widths: list[int] = []
        for important, _, _, name, value, parts in rules:
            for combinator, simple in parts:
                bit = 1 << len(widths)
                self.bits[combinator] |= bit
                for j, key in enumerate(simple):
                    if j == len(self.simple):
                        self.simple.append({})
                    self.simple[j][key] = self.simple[j].get(key, 0) | bit
                widths.append(len(simple))
            self.ends[name] |= 1 << (len(widths) - 1)
            self.value[len(widths)] = (important, value)
        self.free = [sum(1 << i for i, w in enumerate(widths) if w <= j) for j in range(len(self.simple))]
        self.tests: dict[str, list[tuple[str, str, str]]] = {}
        for key in {k for d in self.simple for k in d if k[0] == "["}:
            name, test, of = re.fullmatch(r"\[([\w-]+)([~^$*|]?=)?(.*)\]", key, re.S).groups()
            self.tests.setdefault(name, []).append((key, test or "", of))

    def match(self, node: Node) -> None:
        """Sets the node's matched parts; its parent and its earlier siblings have theirs."""
        up, attrs = node.parent, node.attrs
        keys = ["*", node.tag]
        if attrs:
            keys += ["." + c for c in attrs.get("class", "").split()]
            if "id" in attrs:
                keys.append("#" + attrs["id"])
            for name in self.tests.keys() & attrs.keys():
                keys += [key for key, test, of in self.tests[name] if not test or _holds(test, attrs[name], of)]
        fit = -1
        for free, simple in zip(self.free, self.simple):
            here = free
            for k in keys:
                here |= simple.get(k, 0)
            fit &= here
        node.above = up.above | up.own
        bits = self.bits
        node.own = fit & (bits[""] | (bits[" "] & (node.above << 1)) | (bits[">"] & (up.own << 1)) | (bits["+"] & (up.last << 1)) | (bits["~"] & (up.past << 1)))
        up.last = node.own
        up.past |= node.own

    def winner(self, node: Node, name: str) -> tuple[bool, str] | None:
        top = (node.own & self.ends[name]).bit_length()
        return self.value[top] if top else None


class Builder:
    """Builds the tree of one page."""

    def __init__(self):
        self.root = Node("#root", {}, None)
        self.open = [self.root]
        #: Places of each tag among the open elements, and all elements in document order.
        self.places: dict[str, list[int]] = {}
        self.nodes: list[Node] = []
        self.rules: list[tuple] = []

    def text(self, s: str) -> None:
        if s.strip(" \t\n\r\f"):
            self.leave_head()
        top = self.open[-1]
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr") and not s.strip():
            return
        top.kids.append(s)

    def leave_head(self) -> None:
        while self.open[-1].tag == "head":
            self.cut(len(self.open) - 1)

    def foreign(self) -> bool:
        return any(self.places.get(t) for t in FOREIGN)

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        top = self.open[-1]
        node = Node(tag, attrs, top)
        top.kids.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def cut(self, at: int) -> None:
        """Closes the open elements from a place on."""
        for node in self.open[at:]:
            self.places[node.tag].pop()
        del self.open[at:]

    def innermost(self, tags) -> int:
        """The place of the innermost open element of some tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_implied(self, names: frozenset, limits: frozenset) -> None:
        at = self.innermost(names)
        if at and at >= self.innermost(limits):
            self.cut(at)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open[:3]):
            return
        if tag in CLOSES_P:
            self.close_implied(P, CLOSES_P_WITHIN)
        if tag in CLOSES:
            self.close_implied(*CLOSES[tag])
        if tag not in IN_HEAD:
            self.leave_head()
        if (tag in UNDRAWN or tag in OWN_LINE or tag == "mtd") and self.foreign():
            # Names with a space are none that a page can hold.
            attrs = attrs | ({"hidden": ""} if tag in UNDRAWN else {" cell": ""} if tag == "mtd" else {" line": ""})
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            if self.open[-1].tag == "table":
                self.push("tbody", {})
            self.push("tr", {})
        elif tag == "tr" and self.open[-1].tag == "table":
            self.push("tbody", {})
        self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.push("br", {})
            return
        if tag == "p" and not self.places.get("p"):
            self.push("p", {})
        limits = SCOPE if tag not in SCOPE and tag not in ("tr", "tbody", "thead", "tfoot", "body") else frozenset(["table"]) if tag not in ("table", "html", "body") else frozenset()
        at = self.innermost((tag,))
        if at and at >= self.innermost(limits - {tag}):
            self.cut(at)

    def rule(self, head: str, body: str) -> None:
        for name, (important, value) in declared(body).items():
            for text in head.split(","):
                if (found := selector(text)) is not None:
                    self.rules.append((important, found[1], len(self.rules), name, value, found[0]))

    def sheet(self, css: str) -> None:
        """Rules of a style sheet; rules inside of other rules and of conditional at-rules are passed over."""
        if not _STYLED.search(css):
            return
        css = _unquoted(css)
        within: list[str] = []
        at, head, body = 0, "", []

        def close(end: int) -> None:
            if within and within.pop() == "rule":
                self.rule(head, "".join([*body, css[at:end]]))

        for m in _BRACE.finditer(css):
            outside = not within or within[-1] == "always"
            if m[0] == "{":
                if outside:
                    head, body = css[at : m.start()].strip(), []
                    name = re.match(r"@?[\w-]*", head)[0].lower()
                    always = name == "@layer" or (name == "@media" and on_screen(head[6:]))
                    within.append("always" if always else "other" if name.startswith("@") else "rule")
                else:
                    if within[-1] == "rule":
                        body.append(css[at : m.start()].rpartition(";")[0] + ";")
                    within.append("other")
            elif m[0] == "}":
                close(m.start())
            elif not outside:
                continue
            at = m.end()
        close(len(css))

    def style(self) -> None:
        """Sets what is displayed and what is visible, once all sheets are known: parents and earlier siblings first."""
        cascade = Cascade(self.rules) if self.rules else None
        for node in self.nodes:
            tag, attrs = node.tag, node.attrs
            node.seen = node.parent.seen
            if cascade is not None:
                cascade.match(node)
            elif not attrs:
                if tag in NEVER or tag == "dialog":
                    node.shown = False
                continue
            inline = declared(_unquoted(attrs["style"])) if "style" in attrs else {}
            value = {}
            for name in ("display", "visibility"):
                rule = cascade.winner(node, name) if cascade is not None else None
                own = inline.get(name)
                value[name] = (own if rule is None or (own is not None and own[0] >= rule[0]) else rule or (False, ""))
                value[name] = value[name][1] if value[name] else ""
            display = value["display"]
            if tag in NEVER or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
                node.shown = False
            elif display:
                node.shown = display != "none"
                node.layout = "block" if display in AS_BLOCK else "inline" if display in AS_INLINE else None
            else:
                node.shown = "hidden" not in attrs and (tag != "dialog" or "open" in attrs)
            if value["visibility"] in ("visible", "hidden", "collapse", "initial"):
                node.seen = value["visibility"] in ("visible", "initial")

    def parse(self, page: str) -> "Builder":
        at, size = 0, len(page)
        last = page.rfind(">")
        pending: list[str] = []
        pattern = _TAG

        def flush() -> None:
            if pending:
                s = "".join(pending)
                pending.clear()
                self.text(unescape(s) if "&" in s else s)

        while at < size:
            lt = page.find("<", at)
            if lt < 0 or lt > last:
                pending.append(page[at:])
                break
            if lt > at:
                pending.append(page[at:lt])
            m = pattern.match(page, lt)
            if m is None and pattern is _TAG and re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                # A quotation mark is left open up to the end, and a later tag would search for it again.
                pattern = _CLOSE_TAG
                m = pattern.match(page, lt)
            if m is None:
                if page.startswith("<!--", lt):
                    stop = page.find("-->", lt + 4)
                    at = size if stop < 0 else stop + 3
                elif page.startswith(("<!", "<?", "</"), lt):
                    at = page.find(">", lt) + 1
                elif lt + 1 < size and page[lt + 1].isascii() and page[lt + 1].isalpha():
                    # A tag with a quotation mark left open ends at the next bracket.
                    stop = page.find(">", lt)
                    name = re.match(r"[a-zA-Z][^\s/>]*", page[lt + 1 : stop + 1])[0].lower()
                    flush()
                    self.start(name, {})
                    at = stop + 1
                else:
                    pending.append("<")
                    at = lt + 1
                continue
            flush()
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            attrs = attributes(m[3]) if m[3] else {}
            self.start(tag, attrs)
            if m[3].endswith("/") and tag not in VOID and self.foreign():
                # Inside of svg and math a tag can close itself.
                self.cut(len(self.open) - 1)
            elif tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                body = page[at : stop.start() if stop else size]
                if tag == "style":
                    if on_screen(attrs.get("media", "")):
                        self.sheet(body)
                elif tag in ("textarea", "xmp"):
                    self.open[-1].kids.append(unescape(body) if tag == "textarea" else body)
                self.end(tag)
                at = page.find(">", stop.start()) + 1 if stop and page.find(">", stop.start()) >= 0 else size
        flush()
        self.style()
        return self


class Room:
    """What a page's layout may still add."""

    def __init__(self, size: int):
        self.left = LEAST_ROOM + ROOM * size


class Lines:
    """Collects laid-out lines: words of inline runs, breaks, blank lines that merge, and nested margins.

    A scope is a block with a margin of its own: blank lines at its ends fall
    away, and its mark stands before its first line.
    """

    def __init__(self, room: Room, depth: int = 0):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.space = self.gap = False
        self.room, self.depth = room, depth
        #: Margin of the next line but one; of the next line without the marks that wait for it; those marks.
        self.margin, self.base, self.marks = 0, 0, []
        #: Lines before the scope, and whether a blank line is due before its first one.
        self.start, self.lead = 0, False
        self.scopes: list[tuple] = []

    def enter(self, mark: str = "") -> None:
        self.scopes.append((self.start, self.gap, self.lead, len(mark)))
        self.lead = self.gap if len(self.lines) > self.start else self.lead
        self.start, self.gap = len(self.lines), False
        self.margin += len(mark)
        self.marks.append(mark)

    def silent(self) -> bool:
        return len(self.lines) == self.start

    def leave(self) -> None:
        silent = self.silent()
        self.start, gap, self.lead, width = self.scopes.pop()
        self.margin -= width
        if silent:
            self.gap = gap
            self.marks.pop()
        else:
            self.gap, self.base, self.marks = False, self.margin, []

    def inline(self, s: str) -> None:
        words = _SPACE.split(s)
        if len(words) == 1:
            if words[0]:
                self.run.append(" " * (self.space and bool(self.run)) + words[0])
                self.space = False
            return
        if words[0]:
            self.run.append(" " * (self.space and bool(self.run)) + words[0])
        middle = " ".join(w for w in words[1:-1] if w)
        if middle:
            self.run.append(" " * bool(self.run) + middle)
        self.space = True
        if words[-1]:
            self.run.append(" " * bool(self.run) + words[-1])
            self.space = False

    def end_line(self, force: bool = False) -> None:
        if self.run or force:
            self.put("".join(self.run))
            self.run = []
        self.space = False

    def put(self, line: str) -> None:
        if self.lead if self.silent() else self.gap:
            self.lines.append("")
        self.gap = False
        if self.base or self.marks:
            self.room.left -= self.base
            before = " " * self.base if self.room.left >= 0 else f"{{{self.base}}} " * bool(self.base)
            line = (before + "".join(self.marks) + line).rstrip()
        self.base, self.marks = self.margin, []
        self.lines.append(line)

    def blank(self) -> None:
        self.end_line()
        self.gap = True


def _run(walk) -> None:
    """Runs a generator and the generators that it yields, innermost first: nesting of any depth needs no call stack."""
    stack = [walk]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _walk(node: Node, out: Lines, pre: bool):
    number = None
    if node.tag == "ol":
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    closed = node.tag == "details" and "open" not in node.attrs
    for kid in node.kids:
        if isinstance(kid, str):
            if closed or not node.seen:
                continue
            if pre:
                for i, line in enumerate(kid.split("\n")):
                    if i:
                        out.end_line(True)
                    if line:
                        out.run.append(line)
            else:
                out.inline(kid)
            continue
        if not kid.shown or (closed and kid.tag != "summary"):
            continue
        tag = kid.tag
        if tag == "br":
            out.end_line(kid.seen)
        elif tag == "wbr":
            continue
        elif " line" in kid.attrs:
            out.end_line()
            yield _walk(kid, out, pre)
            out.end_line()
        elif " cell" in kid.attrs:
            out.space = True
            yield _walk(kid, out, pre)
        elif tag == "table":
            out.blank()
            yield _table(kid, out)
            out.blank()
        elif tag == "li" and kid.layout != "inline":
            out.end_line()
            mark = "- " if number is None else f"{number}. "
            number = None if number is None else number + 1
            out.enter(mark if kid.seen else " " * len(mark))
            yield _walk(kid, out, pre)
            out.end_line()
            if out.silent() and kid.seen:
                out.put("")
            out.leave()
        elif tag in ("blockquote", "dd") and kid.layout != "inline":
            out.blank() if tag == "blockquote" else out.end_line()
            out.enter("  ")
            yield _walk(kid, out, pre)
            out.end_line()
            out.leave()
            if tag == "blockquote":
                out.blank()
        elif (tag in BLOCK and kid.layout != "inline") or kid.layout == "block":
            spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and node.tag == "li")
            out.blank() if spaced else out.end_line()
            yield _walk(kid, out, pre or tag == "pre")
            out.blank() if spaced else out.end_line()
        else:
            yield _walk(kid, out, pre or tag in ("textarea", "xmp", "listing"))


def _rows(table: Node) -> tuple[list[list[Node]], list]:
    """Rows of displayed cells, and whatever else a table holds."""
    rows, rest = [], []
    todo = [(table, iter(table.kids))]
    while todo:
        node, kids = todo[-1]
        kid = next(kids, None)
        if kid is None:
            todo.pop()
        elif isinstance(kid, str):
            if kid.strip() and node.seen:
                rest.append(kid)
        elif kid.shown:
            if kid.tag == "tr":
                rows.append([c for c in kid.kids if isinstance(c, Node) and c.tag in ("td", "th") and c.shown])
                rest += [c for c in kid.kids if (isinstance(c, str) and c.strip() and kid.seen) or (isinstance(c, Node) and c.tag not in ("td", "th"))]
            elif kid.tag in ("thead", "tbody", "tfoot"):
                todo.append((kid, iter(kid.kids)))
            elif kid.tag not in ("col", "colgroup"):
                rest.append(kid)
    return rows, rest


def _span(node: Node, name: str, most: int) -> int:
    v = node.attrs.get(name, "1")
    return min(most, max(1, int(v))) if re.fullmatch(r"[0-9]{1,5}", v) else 1


def _widths(cells: list[tuple[int, int]], height: int, room: int) -> dict[int, int]:
    """The width of each column from (column, width of a cell): all cells count, or those up to the greatest width that fits in the room."""
    cells.sort(key=lambda c: c[1])
    width: dict[int, int] = {}
    total = 0
    for i, (column, w) in enumerate(cells):
        total += w - width.get(column, 0)
        if total * height > room:
            # Cells of this width are too wide, also those before this one.
            return _widths([c for c in cells[:i] if c[1] < w], height, room)
        width[column] = w
    return width


def _table(node: Node, out: Lines):
    rows, rest = _rows(node)
    if rest:
        holder = Node("div", {}, node)
        holder.kids, holder.seen = rest, True
        out.enter()
        yield _walk(holder, out, False)
        out.end_line()
        out.leave()
    most = max(map(len, rows), default=0)
    if most < 2 or out.depth >= ROOM:
        # Nothing to align, or too deep to copy once more: the cells stand one below the other.
        for cells in rows:
            for c in cells:
                out.enter()
                yield _walk(c, out, False)
                out.end_line()
                out.leave()
        return
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}
    sizes: list[tuple[int, int]] = []
    for y, cells in enumerate(rows):
        row: dict[int, tuple[list[str], int]] = {}
        at = 0
        for c in cells:
            while held.get(at, -1) >= y:
                at += 1
            inner = Lines(out.room, out.depth + 1)
            yield _walk(c, inner, False)
            inner.end_line()
            w, down = _span(c, "colspan", most), _span(c, "rowspan", len(rows))
            row[at] = (inner.lines, w)
            if w == 1:
                sizes.append((at, max(map(len, inner.lines), default=0)))
            if down > 1:
                held.update((at + i, y + down - 1) for i in range(w))
            at += w
        grid.append(row)
    heights = [max((len(lines) for lines, _ in row.values()), default=0) for row in grid]
    width = _widths(sizes, sum(heights), max(0, out.room.left))
    out.room.left -= sum(width.values()) * sum(heights)
    ends = list(accumulate((width.get(k, 0) for k in range(max(width, default=0) + 1)), initial=0))
    for row, height in zip(grid, heights):
        end = max(row, default=0)
        for i in range(height):
            line, at = [], 0
            for k, (lines, w) in row.items():
                # Columns that no cell of this row fills keep their width.
                line += [" " * (width[e] + 2) for e in range(at, k) if width.get(e)]
                piece = lines[i] if i < len(lines) else ""
                last = min(k + w, len(ends) - 1)
                line.append(piece if k == end else piece.ljust(ends[last] - ends[min(k, last)] + 2 * (w - 1)) + "  ")
                at = k + w
            out.put("".join(line).rstrip())


def render(page: str | None) -> str | None:
    """The visible text of a page, laid out; null for null."""
    if page is None:
        return None
    b = Builder().parse(page)
    out = Lines(Room(len(page)))
    _run(_walk(b.root, out, False))
    out.end_line()
    return "\n".join(x.rstrip() for x in out.lines).strip("\n")


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text: the visible text of every page."""

    def run(batches):
        for rows in batches:
            yield {key: rows[key], "text": [render(p) for p in rows[html]]}

    return stream(pages.select(key, html), run, f"{key} {dict(pages.dtypes)[key]}, text string", 256)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html"))
