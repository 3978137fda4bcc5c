"""Markdown to blocks and inlines with source spans, from the public CommonMark and GFM specifications.

``parse`` reads a text once. Blocks are built line by line with a stack of open containers; text leaves are
then scanned for inlines with a delimiter stack. Spans are offsets of code points here; ``Parsed.byte``
turns them into UTF-8 bytes. Tables, task items, strikethrough, bare autolinks and ``[[wikilinks]]`` are on,
footnotes are off, and a ``---`` block at the very start is frontmatter.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property, lru_cache

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
_ATX = re.compile(r"#{1,6}(?=[ \t]|$)")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_FENCE = re.compile(r"`{3,}(?!.*`)|~{3,}")
_BULLET = re.compile(r"[*+-]")
_ORDERED = re.compile(r"(\d{1,9})([.)])")
_TASK = re.compile(r"\[([ xX])\](?=[ \t])")
_DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
_ATTR = r"(?:\s+[a-zA-Z_:][a-zA-Z0-9:._-]*(?:\s*=\s*(?:[^\"'=<>`\x00-\x20]+|'[^']*'|\"[^\"]*\"))?)"
_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTR}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
_HTML = [
    (re.compile(r"<(?:script|pre|textarea|style)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|textarea|style)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{_TAGS})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:{_TAG})\s*$"), None),
]
_INLINE_HTML = re.compile(rf"{_TAG}|<!---->|<!--(?:-?[^>-])(?:-?[^-])*-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_URI = re.compile(r"<([A-Za-z][A-Za-z0-9.+-]{1,31}:[^<>\x00-\x20]*)>")
_MAIL = re.compile(r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>")
_BARE = re.compile(r"(?:https?://|ftp://|www\.)[^\s<]+", re.I)
_BARE_MAIL = re.compile(r"[a-zA-Z0-9._+-]+@[a-zA-Z0-9_-]+(?:\.[a-zA-Z0-9_-]+)*\.[a-zA-Z0-9_-]*[a-zA-Z0-9]")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.){1,1000})\]", re.S)
_WIKI = re.compile(r"\[\[([^\[\]\r\n|]+?)(?:(\\?\|)([^\[\]\r\n|]*))?\]\]")
_EMBED = re.compile(r"!\[\[([^\[\]\r\n|]+?)(?:\\?\|([^\[\]\r\n]*))?\]\]")
_HOLDERS = frozenset(("document", "blockQuote", "listItem"))
_BEGINS = frozenset(">#`~<=-*+_|:0123456789\x0b\x0c")
_INTERRUPTS = frozenset("><#`~-*+_0123456789")
_INTERRUPTING_MARKER = re.compile(r"[*+-](?:[ \t]|$)|\d{1,9}[.)](?:[ \t]|$)")
#: No flag and no lookbehind, so that the search skips to the first characters; the place of a URL is checked where it is read.
_SPECIAL = re.compile(r"[\\`*_~<\[\]!@]|[hH][tT][tT][pP][sS\u017f]?://|[fF][tT][pP]://|[wW][wW][wW]\.")
_TICKS = re.compile("`+")
#: A link, and a strong run, with nothing else in them: what the delimiter stack would find.
_PLAIN_LINK = re.compile(r"\[([^\[\]\\`*_~<!@]*)\]\(([^\s()<>\\&\x00-\x1f]*)\)")
_PLAIN_STRONG = re.compile(r"(?<![^ \n])\*\*(?=[A-Za-z0-9])[A-Za-z0-9 ,.-]*(?<=[A-Za-z0-9])\*\*(?![^ \n])")
_BLANKS = re.compile(r"[ \t]*\n?[ \t]*")
_ANGLE = re.compile(r"<((?:[^<>\n\\]|\\.)*)>")
_PLAIN_DESTINATION = re.compile(r"[^\s()<\\\x00-\x1f]+(?=[ \t\n)])")
_TITLED = re.compile(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'|\(((?:[^()\\]|\\.)*)\)', re.S)
_SAME = {c: re.compile(re.escape(c) + "+") for c in "*_~"}
_PUNCT = re.compile(r"[!-/:-@\[-`{-~\u00A1-\u00BF\u2010-\u2027\u2030-\u205E\u3000-\u3003\u3008-\u3011]")


class Node:
    __slots__ = ("kind", "start", "end", "parent", "children", "open", "data", "lines", "blank")

    def __init__(self, kind: str, start: int, end: int = -1, parent: Node | None = None, open: bool = True, data: dict | None = None, lines: list[tuple[str, int]] | None = None) -> None:
        self.kind, self.start, self.end, self.parent, self.open, self.blank = kind, start, end, parent, open, False
        self.children: list[Node] = []
        self.data = {} if data is None else data
        self.lines = [] if lines is None else lines


class Inline:
    __slots__ = ("kind", "start", "end", "data")

    def __init__(self, kind: str, start: int, end: int, data: dict) -> None:
        self.kind, self.start, self.end, self.data = kind, start, end, data


@dataclass
class Parsed:
    source: str
    root: Node
    frontmatter: tuple[int, int, int] | None
    inlines: list[Inline]
    line_starts: list[int]

    @cached_property
    def blocks(self) -> list[Node]:
        """``walk`` from the root. For those who don't change the tree."""
        return walk(self.root)

    def line_of(self, at: int) -> int:
        return bisect_right(self.line_starts, at)

    def byte_map(self) -> list[int] | None:
        """Byte offset of each code point, with the end; None if they are the same."""
        if self.source.isascii():
            return None
        out, at = [0], 0
        for c in self.source:
            n = ord(c)
            at += 1 if n < 0x80 else 2 if n < 0x800 else 3 if n < 0x10000 else 4
            out.append(at)
        return out


def normal_label(label: str) -> str:
    return re.sub(r"\s+", " ", label.strip()).casefold()


def unescape(text: str) -> str:
    return html.unescape(_ESCAPE.sub(r"\1", text))


def _rows(source: str) -> list[tuple[int, str, int]]:
    """Start, text and end with the ending of each line."""
    if "\r" in source:
        return [(m.start(), m[0].rstrip("\r\n"), m.end()) for m in _LINE.finditer(source)]
    rows, at = [], 0
    for text in source.split("\n"):
        end = at + len(text) + 1
        rows.append((at, text, end))
        at = end
    if rows[-1][1]:
        rows[-1] = (rows[-1][0], rows[-1][1], len(source))
    else:
        rows.pop()
    return rows


def line_texts(source: str) -> list[str]:
    """The lines without their endings."""
    return [text for _, text, _ in _rows(source)]


@lru_cache(maxsize=256)
def _closing_ticks(n: int) -> re.Pattern:
    return re.compile(rf"(?<!`)`{{{n}}}(?!`)")


@lru_cache(maxsize=256)
def _closing(char: str, length: int) -> re.Pattern:
    return re.compile(rf"{re.escape(char)}{{{length},}}[ \t]*$")


class _Blocks:
    def __init__(self, source: str) -> None:
        self.source = source
        self.root = Node("document", 0)
        self.tip = self.root
        self.references: dict[str, tuple[str, str | None]] = {}
        self.starts: list[int] = []

    def run(self) -> tuple[int, int, int] | None:
        rows = _rows(self.source)
        self.starts = [r[0] for r in rows] or [0]
        front, first = None, 0
        bom = 1 if self.source.startswith("\ufeff") else 0
        if rows and rows[0][1][bom:].rstrip(" \t") == "---":
            for i in range(1, len(rows)):
                if rows[i][1].rstrip(" \t") == "---":
                    front, first = (bom, rows[i][0] + len(rows[i][1]), i + 1), i + 1
                    break
        self.last_end = rows[first - 1][2] if first else 0
        if rows and not first and bom:
            s, text, _ = rows[0]
            self.line(s + 1, text[1:])
            self.last_end, first = s + len(text), 1
        self.lines(rows, first)
        while self.tip is not self.root:
            self.close(self.tip)
        self.root.end = len(self.source)
        return front

    def lines(self, rows: list[tuple[int, str, int]], i: int) -> None:
        """Reads lines from the i-th on. Unindented lines whose effect is plain at the top level are taken here; ``line`` takes all others, with the same outcome."""
        root, count = self.root, len(rows)
        children = root.children
        while i < count:
            s, text, _ = rows[i]
            i += 1
            c = text[:1]
            tip = self.tip
            kind = tip.kind
            if c == "#":
                if (m := _ATX.match(text)) and not self.in_leaf():
                    while self.tip is not root:
                        self.close(self.tip)
                    children.append(self.atx(root, text, m.end(), s, 1))
                    self.last_end = s + len(text)
                    continue
            elif c == "`" or c == "~":
                if (m := _FENCE.match(text)) and not self.in_leaf():
                    while self.tip is not root:
                        self.close(self.tip)
                    i = self.fence(rows, i, s, text, m.end())
                    continue
            elif not c:
                if kind == "paragraph" or kind == "table" or tip is root:
                    up = tip.parent
                    if tip is root or up is root:
                        if tip is not root:
                            self.close(tip)
                        if children:
                            children[-1].blank = True
                        self.last_end = s
                        continue
                    if kind == "paragraph" and up.kind == "listItem" and up.parent.parent is root:
                        self.close(tip)
                        if up.children:
                            up.children[-1].blank = True
                        up.blank, up.parent.blank = True, False
                        self.last_end = s
                        continue
            elif kind == "table":
                if c == "|" and tip.parent is root:
                    self.cells(tip, text, s, False)
                    self.last_end = s + len(text)
                    continue
            elif kind == "paragraph":
                if c not in _BEGINS and c not in " \t" and tip.parent is root:
                    tip.lines.append((text, s))
                    self.last_end = s + len(text)
                    continue
            elif tip is root and (c not in _BEGINS and c not in " \t" or c == "|"):
                self.tip = Node("paragraph", s, -1, root, lines=[(text, s)])
                children.append(self.tip)
                self.last_end = s + len(text)
                continue
            if (c == "*" or c == "-" or c == "+") and text[1:2] == " " and (x := text[2:3]) and x not in _BEGINS and x not in " \t[" and (tip is root or children[-1].open and children[-1].kind == "list" and children[-1].data["marker"] == c):
                if tip is root:
                    children.append(Node("list", s, -1, root, data={"ordered": False, "marker": c, "number": None}))
                held = children[-1]
                while self.tip is not held and self.tip is not root:
                    self.close(self.tip)
                item = Node("listItem", s, -1, held, data={"width": 2, "line": s, "task": None})
                held.children.append(item)
                held.blank = False
                self.tip = Node("paragraph", s + 2, -1, item, lines=[(text[2:], s + 2)])
                item.children.append(self.tip)
                self.last_end = s + len(text)
                continue
            self.line(s, text)
            self.last_end = s + len(text)

    def in_leaf(self) -> bool:
        """Is a top-level block open that takes any line?"""
        children = self.root.children
        return bool(children) and children[-1].open and children[-1].kind in ("codeBlock", "htmlBlock")

    @staticmethod
    def atx(parent: Node, text: str, marks: int, at: int, col: int) -> Node:
        """A heading from ``text``, which begins with its marks."""
        h = Node("heading", at, at + len(text.rstrip(" \t")), parent, False)
        body = text[marks:]
        lead = len(body) - len(body.lstrip(" \t"))
        body = body.strip(" \t")
        h.data = {"level": len(text[:marks]), "setext": False, "col": col}
        if body.endswith("#"):
            body = re.sub(r"(?:(?<=[ \t])|^)#+$", "", body).rstrip(" \t")
        if body:
            h.lines.append((body, at + marks + lead))
        return h

    def fence(self, rows: list[tuple[int, str, int]], i: int, s: int, text: str, marks: int) -> int:
        """A fenced block that begins unindented at the top level, with its lines from the i-th on; the place after it."""
        char, info = text[0], text[marks:]
        node = Node("codeBlock", s, -1, self.root, data={"fenced": True, "char": char, "length": marks, "indent": 0, "info": info.strip(" \t"), "info_at": s + marks + len(info) - len(info.lstrip(" \t"))})
        self.root.children.append(node)
        self.tip = node
        self.last_end = s + len(text)
        closing = _closing(char, marks)
        for k in range(i, len(rows)):
            s, text, _ = rows[k]
            self.last_end, t = s + len(text), text.lstrip(" ")
            if t[:1] == char and len(text) - len(t) <= 3 and closing.match(t):
                node.end = s + len(text.rstrip(" \t"))
                node.data["close"] = s
                node.open = False
                self.tip = self.root
                return k + 1
            node.lines.append((text, s))
        return len(rows)

    # position within the line: at (index), column, and spaces left of a split tab
    def advance(self, n: int, columns: bool = False) -> None:
        while n > 0 and self.at < len(self.text):
            if self.text[self.at] == "\t":
                width = 4 - self.column % 4
                if columns:
                    self.split = width > n
                    step = min(n, width)
                    self.column += step
                    self.at += not self.split
                    n -= step
                    continue
                self.split = False
                self.column += width
            else:
                self.split = False
                self.column += 1
            self.at += 1
            n -= 1

    def find(self) -> None:
        text, i = self.text, self.at
        if i < len(text) and text[i] not in " \t":
            self.next, self.indent, self.blank = i, 0, False
            return
        c = self.column
        while i < len(text) and text[i] in " \t":
            c += 4 - c % 4 if text[i] == "\t" else 1
            i += 1
        self.next, self.indent = i, c - self.column
        self.blank = i == len(text)

    def rest(self) -> str:
        if self.split:
            return " " * (4 - self.column % 4) + self.text[self.at + 1 :]
        return self.text[self.at :]

    def add(self, kind: str, start: int, **data) -> Node:
        while (up := self.tip.kind) not in _HOLDERS and (up != "list" or kind != "listItem"):
            self.close(self.tip)
        node = Node(kind, start, parent=self.tip, data=data)
        self.tip.children.append(node)
        self.tip = node
        return node

    def close(self, node: Node) -> None:
        node.open = False
        self.tip = node.parent
        if node.end < 0:
            node.end = self.last_end
        if node.kind == "paragraph":
            self.definitions(node)
        elif node.kind == "codeBlock" and not node.data["fenced"]:
            while node.lines and not node.lines[-1][0].strip(" \t"):
                node.lines.pop()
            if node.lines:
                node.end = node.lines[-1][1] + len(node.data["tails"][len(node.lines) - 1])
        elif node.kind == "list":
            node.data["tight"] = self.tight(node)
        if node.kind in ("blockQuote", "list", "listItem", "table", "tableRow") and node.children:
            node.end = max(c.end for c in node.children)
            if node.kind == "blockQuote":
                node.end = max(node.end, node.data.get("reach", 0))

    def tight(self, node: Node) -> bool:
        for k, item in enumerate(node.children):
            last = k == len(node.children) - 1
            if item.blank and not last:
                return False
            for j, child in enumerate(item.children):
                if self.ends_blank(child) and not (last and j == len(item.children) - 1):
                    return False
        return True

    def ends_blank(self, node: Node) -> bool:
        while True:
            if node.blank:
                return True
            if node.kind not in ("list", "listItem") or not node.children:
                return False
            node = node.children[-1]

    def definitions(self, node: Node) -> None:
        """Takes leading link reference definitions off a paragraph."""
        while node.lines and node.lines[0][0].startswith("["):
            text = "\n".join(t for t, _ in node.lines)
            m = _LABEL.match(text)
            if not m or text[m.end() : m.end() + 1] != ":" or not m[1].strip():
                break
            got = _destination(text, _skip(text, m.end() + 1))
            if not got:
                break
            url, at = got
            space = _skip(text, at)
            title, end = None, at
            if space > at and (t := _title(text, space)) and re.match(r"[ \t]*(?:\n|\Z)", text[t[1] :]):
                title, end = t
            line_end = re.match(r"[ \t]*(\n|\Z)", text[end:])
            if not line_end:
                if title is None:
                    break
                title, end = None, at
                if not (line_end := re.match(r"[ \t]*(\n|\Z)", text[end:])):
                    break
            self.references.setdefault(normal_label(m[1]), (unescape(url), title))
            used = text[: end + line_end.end()].count("\n") + (end + line_end.end() >= len(text) and not text.endswith("\n"))
            start, (t, o) = node.lines[0][1], node.lines[used - 1]
            del node.lines[:used]
            made = Node("linkReferenceDefinition", start, o + len(t), node.parent, open=False)
            node.parent.children.insert(node.parent.children.index(node), made)
        if not node.lines:
            node.parent.children.remove(node)
        else:
            node.start = node.lines[0][1]
            node.end = node.lines[-1][1] + len(node.lines[-1][0])

    def line(self, start: int, text: str) -> None:
        self.text, self.base = text, start
        self.at = self.column = 0
        self.split = False
        node, matched = self.root, True
        while node.children and node.children[-1].open:
            child = node.children[-1]
            self.find()
            if not self.continues(child):
                matched = False
                break
            node = child
            if self.done:
                return
        unmatched = self.tip if not matched else None
        container = node
        leaf = container.kind in ("codeBlock", "htmlBlock")
        while not leaf:
            self.find()
            if self.indent >= 4 and not (self.tip.kind == "paragraph" and unmatched is None or self.tip.kind == "paragraph"):
                if self.blank:
                    break
                self.drop(container)
                self.advance(4, True)
                self.add("codeBlock", self.base, fenced=False, tails=[])
                container, leaf = self.tip, True
                break
            if self.indent >= 4 or self.blank:
                break
            made = self.begin(container)
            if not made:
                break
            container, leaf = made, made.kind not in ("blockQuote", "list", "listItem")
            if self.done:
                return
        self.find()
        if unmatched is not None and container is node and not self.blank and self.tip.kind == "paragraph":
            self.text_line(self.tip)  # lazy
            return
        self.drop(container)
        if self.blank and container.children:
            container.children[-1].blank = True
        mark = self.blank and not (container.kind in ("blockQuote", "heading", "thematicBreak") or container.kind == "codeBlock" and container.data["fenced"] or container.kind == "listItem" and not container.children and container.data["line"] == self.base)
        up = container
        while up.parent:
            up.blank = mark if up is container else False
            up = up.parent
        if container.kind == "codeBlock":
            self.code_line(container)
        elif container.kind == "htmlBlock":
            container.lines.append((self.text[self.at :], self.base + self.at))
            if (end := _HTML[container.data["type"]][1]) and end.search(self.text[self.at :]):
                container.end = self.base + len(self.text)
                self.close(container)
        elif container.kind in ("paragraph",):
            self.text_line(container)
        elif container.kind == "table":
            self.row(container, False)
        elif container.kind not in ("heading", "thematicBreak") and not self.blank:
            self.advance(self.next - self.at)
            self.text_line(self.add("paragraph", self.base + self.at))

    def drop(self, keep: Node) -> None:
        """Closes open blocks below ``keep``."""
        while (n := self.tip) is not keep:
            up = keep
            while up is not None and up is not n:
                up = up.parent
            if up is n:
                break
            self.close(n)

    def text_line(self, node: Node) -> None:
        self.find()
        t = self.text[self.next :]
        if node.lines:
            node.lines.append((t, self.base + self.next))
        else:
            node.lines.append((t, self.base + self.next))
            node.start = self.base + self.next

    def code_line(self, node: Node) -> None:
        t = self.rest()
        node.lines.append((t, self.base + self.at))
        if not node.data["fenced"]:
            node.data["tails"].append(self.text[self.at :])

    def continues(self, node: Node) -> bool:
        self.done = False
        k = node.kind
        if k == "blockQuote":
            if self.indent <= 3 and not self.blank and self.text[self.next] == ">":
                node.data["reach"] = self.base + len(self.text.rstrip())
                self.advance(self.next - self.at + 1)
                if self.at < len(self.text) and self.text[self.at] in " \t":
                    self.advance(1, True)
                return True
            return False
        if k == "list":
            return True
        if k == "listItem":
            if self.blank:
                if not node.children:
                    return False
                self.advance(self.next - self.at)
                return True
            if self.indent >= node.data["width"]:
                self.advance(node.data["width"], True)
                return True
            return False
        if k == "codeBlock":
            if node.data["fenced"]:
                if self.indent <= 3 and not self.blank and self.text[self.next] == node.data["char"]:
                    if _closing(node.data["char"], node.data["length"]).match(self.text, self.next):
                        node.end = self.base + len(self.text.rstrip(" \t"))
                        node.data["close"] = self.base
                        self.drop(node)
                        self.close(node)
                        self.done = True
                        return True
                i = node.data["indent"]
                while i > 0 and self.at < len(self.text) and self.text[self.at] in " \t":
                    self.advance(1, True)
                    i -= 1
                return True
            if self.indent >= 4:
                self.advance(4, True)
            elif self.blank:
                self.advance(self.next - self.at)
            else:
                return False
            return True
        if k == "htmlBlock":
            return not (self.blank and node.data["type"] >= 5)
        if k == "paragraph":
            return not self.blank
        if k == "table":
            return not self.blank and self.indent < 4 and not self.interrupts()
        return False

    def interrupts(self) -> bool:
        if self.text[self.next] not in _INTERRUPTS:
            return False
        t = self.text[self.next :]
        return bool(t[:1] == ">" or _ATX.match(t) or _BREAK.match(t) or _FENCE.match(t) or any(o.match(t) for o, _ in _HTML[:6]) or _INTERRUPTING_MARKER.match(t))

    def begin(self, container: Node) -> Node | None:
        self.done = False
        if self.text[self.next] not in _BEGINS:
            return None
        t, at = self.text[self.next :], self.base + self.next
        if t[0] == ">":
            self.drop(container)
            self.advance(self.next - self.at + 1)
            if self.at < len(self.text) and self.text[self.at] in " \t":
                self.advance(1, True)
            return self.add("blockQuote", at, reach=self.base + len(self.text.rstrip()))
        if m := _ATX.match(t):
            self.drop(container)
            while self.tip.kind not in _HOLDERS:
                self.close(self.tip)
            h = self.atx(self.tip, t, m.end(), at, self.next + 1)
            self.tip.children.append(h)
            self.done = True
            return h
        if m := _FENCE.match(t):
            self.drop(container)
            info = t[m.end() :]
            lead = len(info) - len(info.lstrip(" \t"))
            c = self.add("codeBlock", at, fenced=True, char=m[0][0], length=len(m[0]), indent=self.indent, info=info.strip(" \t"), info_at=at + m.end() + lead)
            self.done = True
            return c
        if t[0] == "<":
            for k, (opens, ends) in enumerate(_HTML):
                if opens.match(t) and (k < 6 or container.kind != "paragraph" and not (self.tip.kind == "paragraph")):
                    self.drop(container)
                    return self.add("htmlBlock", at, type=k)
        if container.kind == "paragraph" and (m := _SETEXT.match(t)):
            lines = list(container.lines)
            parent = container.parent
            self.last_end, keep = lines[-1][1] + len(lines[-1][0]), self.last_end
            self.definitions(container)
            if container.lines:
                parent.children.remove(container)
                self.tip = parent
                h = Node("heading", container.start, self.base + len(self.text.rstrip(" \t")), parent, data={"level": 1 if t[0] == "=" else 2, "setext": True, "col": container.start - self.starts[bisect_right(self.starts, container.start) - 1] + 1}, lines=container.lines, open=False)
                h.lines[-1] = (h.lines[-1][0].rstrip(" \t"), h.lines[-1][1])
                parent.children.append(h)
                self.done = True
                return h
            self.last_end = keep
            self.tip = parent
            p = self.add("paragraph", at)
            self.text_line(p)
            self.done = True
            return p
        if _BREAK.match(t):
            self.drop(container)
            b = self.add("thematicBreak", at)
            b.end = self.base + len(self.text.rstrip(" \t"))
            self.close(b)
            self.done = True
            return b
        if item := self.marker(container, t, at):
            return item
        if container.kind == "paragraph" and "-" in t and _DELIMITER.match(t) and ("|" in t or "|" in container.lines[-1][0] or ":" in t):
            head, off = container.lines[-1]
            if len(split_row(head, off)) == len(split_row(t, at)):
                container.lines.pop()
                parent = container.parent
                if container.lines:
                    container.end = container.lines[-1][1] + len(container.lines[-1][0])
                    container.open = False
                else:
                    parent.children.remove(container)
                self.tip = parent
                table = self.add("table", off, columns=len(split_row(head, off)), delimiter=(t, at))
                self.cells(table, head, off, True)
                table.end = self.base + len(self.text.rstrip())
                self.done = True
                return table
        return None

    def marker(self, container: Node, t: str, at: int) -> Node | None:
        m, ordered = _BULLET.match(t), False
        if not m:
            m, ordered = _ORDERED.match(t), True
            if not m or container.kind == "paragraph" and m[1].lstrip("0") not in ("1",) and not (m[1] == "1"):
                return None
        after = t[m.end() :]
        if after and after[0] not in " \t" or container.kind == "paragraph" and not after.strip(" \t"):
            return None
        indent = self.indent
        self.drop(container) if container.kind != "paragraph" else self.close(container)
        self.advance(self.next - self.at + len(m[0]))
        column, saved = self.column, (self.at, self.column, self.split)
        while self.column - column < 5 and self.at < len(self.text) and self.text[self.at] in " \t":
            self.advance(1, True)
        blank, spaces = self.at >= len(self.text), self.column - column
        if spaces >= 5 or spaces < 1 or blank:
            self.at, self.column, self.split = saved
            width = len(m[0]) + 1
            if self.at < len(self.text) and self.text[self.at] in " \t":
                self.advance(1, True)
        else:
            width = len(m[0]) + spaces
        kind = m[2] if ordered else m[0]
        holder = self.tip
        if not (holder.kind == "list" and holder.data["marker"] == kind):
            if holder.kind == "list":
                self.close(holder)
            self.add("list", at, ordered=ordered, marker=kind, number=int(m[1]) if ordered else None)
        item = self.add("listItem", at, width=indent + width, line=self.base, task=None)
        item.end = at + len(m[0])
        if (k := _TASK.match(self.text[self.at :])) and self.text[self.at + k.end() :].strip():
            item.data["task"] = k[1] != " "
            self.advance(k.end())
        item.end = -1
        return item

    def row(self, table: Node, header: bool) -> None:
        self.find()
        self.cells(table, self.text[self.next :], self.base + self.next, header)

    def cells(self, table: Node, text: str, at: int, header: bool) -> None:
        text = text.rstrip()
        found = split_row(text, at)
        row = Node("tableRow", at, at + len(text), table, data={"header": header, "cells": len(found)}, open=False)
        table.children.append(row)
        for t, o in found[: table.data["columns"]]:
            row.children.append(Node("tableCell", o, o + len(t), row, open=False, lines=[(t, o)]))
        table.end = row.end


def split_row(text: str, at: int) -> list[tuple[str, int]]:
    """Cells of a row, trimmed, with their offsets; a pipe after an odd run of backslashes is content."""
    if len(text) > 1 and text[0] == "|" == text[-1] and "\\" not in text:
        out, at = [], at + 1
        for raw in text[1:-1].split("|"):
            t = raw.lstrip(" \t")
            out.append((x, at + len(raw) - len(t)) if (x := t.rstrip(" \t")) else ("", at))
            at += len(raw) + 1
        return out
    cells, begin, i, n = [], 0, 0, len(text)
    if "\\" not in text:
        while (i := text.find("|", begin)) >= 0:
            cells.append((begin, i))
            begin = i + 1
        i = n
    while i < n:
        if text[i] == "\\":
            i += 2
            continue
        if text[i] == "|":
            cells.append((begin, i))
            begin = i + 1
        i += 1
    cells.append((begin, n))
    if cells and not text[slice(*cells[0])].strip() and len(cells) > 1:
        cells = cells[1:]
    if cells and not text[slice(*cells[-1])].strip() and len(cells) > 1:
        cells = cells[:-1]
    out = []
    for s, e in cells:
        raw = text[s:e]
        t = raw.lstrip(" \t")
        out.append((x, at + e - len(t)) if (x := t.rstrip(" \t")) else ("", at + s))
    return out


def _skip(text: str, at: int) -> int:
    return _BLANKS.match(text, at).end()


def _destination(text: str, at: int) -> tuple[str, int] | None:
    if text[at : at + 1] == "<":
        m = _ANGLE.match(text, at)
        return (m[1], m.end()) if m else None
    if m := _PLAIN_DESTINATION.match(text, at):
        return m[0], m.end()
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and _PUNCT.match(text[i + 1]):
            i += 2
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            if not depth:
                break
            depth -= 1
        elif c in " \t\n" or ord(c) < 32:
            break
        i += 1
    return (text[at:i], i) if i > at and not depth else None


def _title(text: str, at: int) -> tuple[str, int] | None:
    m = _TITLED.match(text, at)
    return (unescape(next(g for g in m.groups() if g is not None)), m.end()) if m else None


class _Inlines:
    """Inlines of one leaf's text."""

    def __init__(self, lines: list[tuple[str, int]], references: dict, wikilinks: bool, in_table: bool) -> None:
        if len(lines) == 1:
            self.text, self.places, self.offsets = lines[0][0], [0], [lines[0][1]]
        else:
            self.text = "\n".join([t for t, _ in lines])
            self.places, self.offsets, n = [], [], 0
            for t, o in lines:
                self.places.append(n)
                self.offsets.append(o)
                n += len(t) + 1
        self.references, self.wikilinks, self.in_table = references, wikilinks, in_table
        self.out: list[Inline] = []

    def src(self, i: int) -> int:
        if len(self.places) == 1:
            return self.offsets[0] + i
        k = bisect_right(self.places, i) - 1
        return self.offsets[k] + i - self.places[k]

    def emit(self, kind: str, s: int, e: int, **data) -> None:
        self.out.append(Inline(kind, self.src(s), self.src(e - 1) + 1, data))

    def run(self) -> list[Inline]:
        t, i = self.text, 0
        if not (first := _SPECIAL.search(t)):
            return self.out
        i = first.start()
        delims: list[list] = []  # [char, count, at, opens, closes, original]
        brackets: list[list] = []  # [at, image, active, delims below]
        missing: set[int] = set()
        while m := _SPECIAL.search(t, i):
            i = m.start()
            c = t[i]
            if c == "\\":
                i += 2 if i + 1 < len(t) else 1
            elif c == "`":
                n = len(_TICKS.match(t, i)[0])
                close = None if n in missing else _closing_ticks(n).search(t, i + n)
                if close:
                    self.emit("codeSpan", i, close.end())
                    i = close.end()
                else:
                    missing.add(n)
                    i += n
            elif c == "*" and (m := _PLAIN_STRONG.match(t, i)):
                self.emit("strong", i, m.end())
                i = m.end()
            elif c in "*_~":
                n = len(_SAME[c].match(t, i)[0])
                before, after = t[i - 1] if i else "\n", t[i + n] if i + n < len(t) else "\n"
                left = not after.isspace() and (not _PUNCT.match(after) or before.isspace() or bool(_PUNCT.match(before)))
                right = not before.isspace() and (not _PUNCT.match(before) or after.isspace() or bool(_PUNCT.match(after)))
                if c == "_":
                    left, right = left and (not right or bool(_PUNCT.match(before))), right and (not left or bool(_PUNCT.match(after)))
                if c != "~" or n <= 2:
                    delims.append([c, n, i, left, right, n])
                i += n
            elif c == "<":
                if m := _URI.match(t, i) or _MAIL.match(t, i):
                    self.emit("autolink", i, m.end(), url=("mailto:" if m.re is _MAIL else "") + m[1])
                    i = m.end()
                elif m := _INLINE_HTML.match(t, i):
                    i = m.end()
                else:
                    i += 1
            elif c == "[" and self.wikilinks and t.startswith("[[", i) and (m := _WIKI.match(t, i)):
                if i and t[i - 1] == "!" and (i - 1 - len(t[: i - 1].rstrip("\\"))) % 2 == 0:
                    i = m.end()
                    continue
                self.emit("wikilink", i, m.end(), target=m[1], alias=None if m[2] is None else unescape(m[3]), alias_span=None if m[2] is None else (self.src(m.start(3)), self.src(m.start(3)) + len(m[3])), embed=False)
                i = m.end()
            elif c == "!" and t.startswith("![", i) and not t.startswith("![[", i):
                brackets.append([i, True, True, len(delims)])
                i += 2
            elif c == "[" and (m := _PLAIN_LINK.match(t, i)):
                inner, close = m.span(1)
                self.emit("link", i, m.end(), url=m[2], title=None, text_span=(self.src(inner), self.src(close - 1) + 1) if close > inner else (self.src(close), self.src(close)), label=m[1])
                for b in brackets:
                    if not b[1]:
                        b[2] = False
                i = m.end()
            elif c == "[":
                brackets.append([i, False, True, len(delims)])
                i += 1
            elif c == "]":
                i = self.bracket(i, brackets, delims)
            elif c in "hHwWfF" and (i == 0 or t[i - 1] in " \t\n*_~(") and (m := _BARE.match(t, i)):
                url = self.trim(m[0])
                host = re.sub(r"^(?:https?://|ftp://)", "", url, flags=re.I)
                if "." in host and not any(b[2] and not b[1] for b in brackets):
                    self.emit("autolink", i, i + len(url), url=("http://" if url.lower().startswith("www.") else "") + url)
                    i += len(url)
                else:
                    i += 1
            elif c == "@" and (m := self.mail(i)):
                s, e = m
                if not any(b[2] and not b[1] for b in brackets):
                    self.emit("autolink", s, e, url="mailto:" + t[s:e])
                i = e
            else:
                i += 1
        self.emphasis(delims, 0)
        return self.out

    def mail(self, i: int) -> tuple[int, int] | None:
        s = i
        while s and (self.text[s - 1].isalnum() and self.text[s - 1].isascii() or self.text[s - 1] in "._+-"):
            s -= 1
        m = _BARE_MAIL.match(self.text, s)
        return (s, m.end()) if m and s < i < m.end() else None

    @staticmethod
    def trim(url: str) -> str:
        while url:
            if url[-1] in "?!.,:*_~'\"":
                url = url[:-1]
            elif url[-1] == ")" and url.count(")") > url.count("("):
                url = url[:-1]
            elif m := re.search(r"&[a-zA-Z0-9]+;$", url):
                url = url[: m.start()]
            else:
                break
        return url

    def bracket(self, i: int, brackets: list, delims: list) -> int:
        t = self.text
        if not brackets:
            return i + 1
        at, image, active, below = brackets.pop()
        if not active:
            return i + 1
        found = None
        inner = at + (2 if image else 1)
        if t[i + 1 : i + 2] == "(":
            k = _skip(t, i + 2)
            url, title = "", None
            got = _destination(t, k)
            if got:
                url, k = got
                if t[k : k + 1] in (" ", "\t", "\n") and (x := _title(t, _skip(t, k))):
                    title, k = x
            k = _skip(t, k)
            if t[k : k + 1] == ")":
                found = (unescape(url), title, k + 1)
        if found is None:
            m = _LABEL.match(t, i + 1)
            label = m[1] if m else t[inner:i]
            end = m.end() if m else i + 3 if t.startswith("[]", i + 1) else i + 1
            if (ref := self.references.get(normal_label(label))) and (m or "[" not in re.sub(r"\\.", "", label)):
                found = (*ref, end)
        if found is None:
            return i + 1
        url, title, end = found
        self.emphasis(delims, below)
        span = (self.src(inner), self.src(i - 1) + 1) if i > inner else (self.src(i), self.src(i))
        self.emit("image" if image else "link", at, end, url=url, title=title, text_span=span, label=t[inner:i])
        if not image:
            for b in brackets:
                if not b[1]:
                    b[2] = False
        return end

    def emphasis(self, delims: list, below: int) -> None:
        k = below
        while k < len(delims):
            c, n, at, _, closes, original = delims[k]
            if not closes or not n:
                k += 1
                continue
            j = k - 1
            while j >= below:
                o = delims[j]
                if o[0] == c and o[1] and o[3] and not (c != "~" and (o[4] or delims[k][3]) and (o[5] + original) % 3 == 0 and (o[5] % 3 or original % 3)) and not (c == "~" and o[1] != n):
                    break
                j -= 1
            if j < below:
                k += 1
                continue
            o = delims[j]
            use = n if c == "~" else 2 if o[1] >= 2 and n >= 2 else 1
            s, e = o[2] + o[1] - use, at + use
            if c != "~":
                self.emit("strong" if use == 2 else "emph", s, e)
            o[1] -= use
            delims[k][1] -= use
            delims[k][2] += use
            for d in delims[j + 1 : k]:
                d[1] = 0
            if not delims[k][1]:
                k += 1
        del delims[below:]


_LEAVES = ("paragraph", "heading", "tableCell")


def walk(node: Node) -> list[Node]:
    """Blocks in document order, the root left out."""
    out, todo = [], node.children[::-1]
    while todo:
        n = todo.pop()
        out.append(n)
        if n.children:
            todo += n.children[::-1]
    return out


def leaf_inlines(lines: list[tuple[str, int]]) -> list[Inline]:
    """The inlines of one paragraph or heading in a text without references."""
    return _Inlines(lines, {}, True, False).run()


def parse(source: str, wikilinks: bool = True, inlines: bool = True) -> Parsed:
    """``inlines``: False leaves them out, and what only they need."""
    b = _Blocks(source)
    front = b.run()
    if not inlines:
        return Parsed(source, b.root, front, [], b.starts)
    inlines: list[Inline] = []
    made = Parsed(source, b.root, front, inlines, b.starts)
    for n in made.blocks:
        if n.kind in _LEAVES and (lines := n.lines) and (_SPECIAL.search(lines[0][0]) if len(lines) == 1 else any(_SPECIAL.search(t) for t, _ in lines)):
            table = n.kind == "tableCell"
            got = _Inlines(lines, b.references, wikilinks, table).run()
            inlines += [x for x in got if not table or x.kind in ("wikilink", "emph", "strong")] if table else got
    if wikilinks:
        inlines += embeds(source, b.root, inlines, front)
    inlines.sort(key=lambda x: x.start)
    return made


def embeds(source: str, root: Node, inlines: list[Inline], front: tuple[int, int, int] | None) -> list[Inline]:
    """``![[target|alias]]`` on a line, but not in code, HTML blocks or frontmatter, nor after an odd run of backslashes."""
    if "![[" not in source:
        return []
    mask = sorted([(n.start, n.end) for n in walk(root) if n.kind in ("codeBlock", "htmlBlock")] + [(x.start, x.end) for x in inlines if x.kind == "codeSpan"] + ([(front[0], front[1])] if front else []))
    starts = [m[0] for m in mask]
    out = []
    for m in _EMBED.finditer(source):
        k = bisect_right(starts, m.start()) - 1
        if k >= 0 and m.start() < mask[k][1]:
            continue
        slashes = len(source[: m.start()]) - len(source[: m.start()].rstrip("\\"))
        if slashes % 2:
            continue
        out.append(Inline("wikilink", m.start(), m.end(), {"target": m[1], "alias": m[2], "alias_span": None, "embed": True}))
    return out
