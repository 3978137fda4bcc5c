"""Reading documents by address: an overview, a section, the frontmatter or a value of it, the links.

``read`` answers one address for every document; a document is parsed once and its row stays where it is.
The reserved addresses come first: ``0`` and ``text``, ``links``, ``fm`` and ``frontmatter``, ``fm.<path>``. All
others are numbers (``1.2``) or a heading's slug.

Defined results: null content has no reading and no error. An address that leads nowhere is an error in the
row, not of the job. A heading that answers to a reserved word is named in ``note``, or in the error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import yaml
from pyspark.sql import DataFrame

from quirelake.functions import yaml_values as Y
from quirelake.functions.markdown import Parsed, line_texts, parse, walk
from quirelake.functions.scan import heading_lists, scan
from quirelake.operators.structure import ARRAYS, HEADING, SCAN_BYTES, _headings, _inlines

THRESHOLD = 2000
SCHEMA = "doc_id long, reading string, text string, json string, note string, error string"
_AT = {name: k for k, name in enumerate(ARRAYS["headings"])}
_IN = {name: k for k, name in enumerate(ARRAYS["inlines"])}


class Unreadable(Exception):
    """The address leads nowhere; the text says why."""


@dataclass
class Section:
    address: str
    heading: str
    level: int
    line: int
    end: int
    children: list[Section] = field(default_factory=list)

    @cached_property
    def slug(self) -> str:
        return slug(self.heading)

    @property
    def lines(self) -> int:
        return max(0, self.end - self.line + 1)

    def flat(self) -> Iterator[Section]:
        yield self
        for c in self.children:
            yield from c.flat()


def slug(text: str) -> str:
    text = re.sub(r"\[\[([^\]|]+)\|([^\]]*)\]\]", r"\2", text)
    text = re.sub(r"\[\[([^\]|]+)\]\]", r"\1", text).translate({ord(c): None for c in "`*_"}).lower()
    return regex.sub(r"[^\p{Alphabetic}\p{N}]+", "-", text).strip("-")


def reserved(address: str) -> tuple[str, str | None] | None:
    """The reading of a reserved address, and the path of a value."""
    low = address.lower()
    if low in ("0", "text"):
        return "text", None
    if low == "links":
        return "links", None
    if low in ("fm", "frontmatter"):
        return "frontmatter", None
    for prefix in ("frontmatter.", "fm."):
        if low.startswith(prefix) and len(low) > len(prefix):
            return "value", address[len(prefix) :]
    return None


def nested(rows: Iterable[tuple]) -> list[Section]:
    """The tree of sections in document order."""
    tree: list[Section] = []
    stack: list[Section] = []
    for row in rows:
        s = Section(*row)
        while stack and stack[-1].level >= s.level:
            stack.pop()
        (stack[-1].children if stack else tree).append(s)
        stack.append(s)
    return tree


def scanned(contents: pa.Array) -> list[tuple[int, list[tuple]] | None]:
    """For each plain text of a batch its body's first line and the rows of ``nested``; None for the others. ``strict`` makes no difference to these."""
    out: list[tuple[int, list[tuple]] | None] = []
    step = max(1, len(contents) * SCAN_BYTES // max(contents.nbytes, 1))
    for at in range(0, len(contents), step):
        part = contents.slice(at, step)
        s = scan(part.fill_null(""))
        docs = np.flatnonzero(s.plain)
        found = heading_lists(s, docs, HEADING)
        rows = list(zip(*(found.values.field(k).to_pylist() for k in ("address", "text", "level", "start_line", "last"))))
        ends = found.offsets.to_pylist()
        got: list = [None] * len(part)
        for k, (d, line) in enumerate(zip(docs.tolist(), s.body_line[docs].tolist())):
            got[d] = line, rows[ends[k] : ends[k + 1]]
        out += got
    return out


class Document:
    """A text with its tree of sections. It is parsed when a reading first needs that, and for inlines only if one needs them."""

    def __init__(self, content: str, strict: bool = False, wikilinks_only: bool = False, scanned: tuple[int, list[tuple]] | None = None) -> None:
        self.content, self.strict, self.wikilinks_only = content, strict, wikilinks_only
        self.scanned = scanned

    @cached_property
    def lines(self) -> list[str]:
        return line_texts(self.content)

    @cached_property
    def parsed(self) -> Parsed:
        return parse(self.content)

    @cached_property
    def blocks(self) -> Parsed:
        """The parse, perhaps without inlines."""
        return self.__dict__.get("parsed") or parse(self.content, inlines=False)

    @cached_property
    def body(self) -> int:
        if self.scanned:
            return self.scanned[0]
        front = self.blocks.frontmatter
        return front[2] + 1 if front else 1

    @cached_property
    def tree(self) -> list[Section]:
        if self.scanned:
            return nested(self.scanned[1])
        kind = "strict_" if self.strict else ""
        rows = []
        for h in _headings(self.blocks, lambda i: i, walk(self.blocks.root), self.body):
            if (address := h[_AT[kind + "address"]]) is None:
                continue
            rows.append((address, h[_AT["text"]], h[_AT["level"]], h[_AT["start_line"]], h[_AT[kind + "last"]]))
        return nested(rows)

    @cached_property
    def lede(self) -> Section | None:
        first, last = self.body, self.tree[0].line - 1 if self.tree else len(self.lines)
        while first <= last and not self.lines[first - 1].strip():
            first += 1
        return Section("0", "(text)", 0, first, last) if first <= last else None

    def slice(self, start: int, end: int) -> str:
        return "\n".join(self.lines[start - 1 : end])

    def tokens(self, s: Section) -> int:
        return len(self.slice(s.line, s.end)) // 4

    def sections(self) -> Iterator[Section]:
        for s in self.tree:
            yield from s.flat()

    def shadows(self) -> list[tuple[str, Section]]:
        found = [(r[0], s) for s in self.sections() if (r := reserved(s.slug))]
        return sorted(found, key=lambda x: ("text", "frontmatter", "value", "links").index(x[0]))

    def also(self, reading: str) -> str | None:
        """Clauses on the headings that answer to the same word, in document order."""
        return "; ".join(f"heading '{s.heading}' ({s.address}) also answers to '{s.slug}'" for r, s in self.shadows() if r == reading) or None

    def resolve(self, address: str) -> Section:
        if (r := reserved(address)) and r[0] == "text":
            if self.lede:
                return self.lede
            also = self.also("text")
            raise Unreadable(f"No text region in this file (address '{address}')" + (f"; {also}" if also else ""))
        if re.fullmatch(r"[0-9]+(\.[0-9]+)*", address):
            level, found = self.tree, None
            for part in address.split("."):
                if not 1 <= int(part) <= len(level):
                    raise Unreadable(f"Address '{address}' out of range")
                found = level[int(part) - 1]
                level = found.children
            return found
        wanted = slug(address)
        found = [s for s in self.sections() if s.slug == wanted]
        if not found:
            raise Unreadable(f"No heading matches slug '{wanted}'")
        if len(found) > 1:
            raise Unreadable(f"Ambiguous slug '{wanted}'; candidates:" + "".join(f"\n  {s.address}  {s.heading}" for s in found))
        return found[0]

    def tree_line(self, s: Section) -> str:
        name = s.heading if len(s.heading) <= 30 else s.heading[:29] + "…"
        return f"{'+' if s.children else ' '} {'  ' * s.address.count('.')}{s.address:<6} {name:<14} L{s.line}   {s.lines} lines · ~{self.tokens(s)} tok"

    def prose(self, s: Section) -> str:
        return self.slice(s.line, s.children[0].line - 1 if s.children else s.end)

    def unfold(self, s: Section, below: int, depth: int | None, threshold: int, full: bool) -> str:
        """The section's own text and its subsections', ``below`` levels under the one asked for; folded ones as their line of the tree."""
        out = self.prose(s)
        out += "\n" if out and not out.endswith("\n") else ""
        for c in s.children:
            out += self.unfold(c, below + 1, depth, threshold, full) if self.shown(c, below, depth, threshold, full) else self.tree_line(c) + "\n"
        return out

    def shown(self, s: Section, below: int, depth: int | None, threshold: int, full: bool) -> bool:
        return full or (depth is None or below < depth) and self.tokens(s) <= threshold

    def links(self) -> list[dict]:
        out = []
        for x in _inlines(self.parsed, lambda i: i):
            kind = x[_IN["type"]]
            if kind not in ("wikilink", "link", "autolink") or self.wikilinks_only and kind != "wikilink":
                continue
            target = x[_IN["url"]]
            shown = x[_IN["alias"]] if kind == "wikilink" else x[_IN["label"]] if kind == "link" else None
            link = {"kind": kind, "target": target, "alias": shown, "line": x[_IN["start_line"]]}
            if not shown or kind != "wikilink" and shown == target:
                del link["alias"]
            out.append(link)
        return out

    def fields(self) -> list[dict]:
        """Top-level keys of the frontmatter, also of an unclosed block: key, value, line."""
        lines = [t.removesuffix("\r") for t in self.content.removeprefix("﻿").split("\n")]
        out: list[dict] = []
        more: list[str] = []

        def close() -> None:
            if out and not out[-1]["value"]:
                least = min((len(t) - len(t.lstrip()) for t in more), default=0)
                out[-1]["value"] = "\n".join(t[least:] for t in more)
            more.clear()

        if lines[0].strip() != "---":
            return out
        for number, text in enumerate(lines[1:], 2):
            if text.strip() == "---":
                break
            text = text.rstrip()
            if not text or text[0].isspace():
                more += [text] if text else []
            elif not text.startswith("#") and ":" in text[1:] and text[0] != ":":
                close()
                key, _, value = text.partition(":")
                out.append({"key": key, "value": value.strip(), "line": number})
        close()
        return out


@dataclass
class Reading:
    kind: str
    text: str
    data: dict
    note: str | None = None


def read_document(path: str, content: str, address: str | None = None, depth: int | None = None, full: bool = False, threshold: int = THRESHOLD, strict: bool = False, wikilinks_only: bool = False, scanned: tuple[int, list[tuple]] | None = None) -> Reading:
    """``depth`` counts the levels below the section that are shown. In the text its children are level 0, in the JSON's list of children level 1, so a depth of 1 shows them in one and folds them in the other."""
    d = Document(content, strict, wikilinks_only, scanned)
    if address is None:
        return _overview(path, d)
    kind, inner = reserved(address) or ("section", None)
    if kind == "links":
        found = d.links()
        rows = "".join(f"  L{x['line']:<5} {x['kind']:<9}  {x['target']}{' -> ' + x['alias'] if 'alias' in x else ''}\n" for x in found)
        return Reading("links", f"{address}  (outgoing)   {len(found)} links\n\n{rows}", {"path": path, "address": address, "links": found}, d.also("links"))
    if kind in ("frontmatter", "value"):
        return _frontmatter(path, d, address, inner)
    s = d.resolve(address)
    size = {"line": s.line, "lines": s.lines, "tokens": d.tokens(s)}
    children = []
    for c in s.children:
        shown = d.shown(c, 1, depth, threshold, full)
        child = {"address": c.address, "heading": c.heading, "level": c.level, "line": c.line, "lines": c.lines, "tokens": d.tokens(c), "folded": not shown}
        children.append(child | ({"content": d.unfold(c, 1, depth, threshold, full)} if shown else {}))
    data = {"path": path, "address": s.address, "heading": s.heading, "slug": "text" if s is d.lede else s.slug, "level": s.level, **size, "content": d.prose(s), "children": children}
    text = f"{s.address}  {s.heading}   L{s.line}   {s.lines} lines · ~{size['tokens']} tok\n\n{d.unfold(s, 0, depth, threshold, full)}"
    return Reading("section", text, data, d.also("text") if kind == "text" else None)


def _overview(path: str, d: Document) -> Reading:
    def node(s: Section) -> dict:
        return {"address": s.address, "heading": s.heading, "level": s.level, "line": s.line, "lines": s.lines, "tokens": d.tokens(s), "slug": s.slug, "children": [node(c) for c in s.children]}

    fields, links, lede = [f["key"] for f in d.fields()], len(d.links()), d.lede
    top = {"address": "0", "label": "(text)", "line": lede.line, "lines": lede.lines, "tokens": d.tokens(lede)} if lede else None
    out = [path] + ([f"fields: {', '.join(fields)}"] if fields else []) + [f"links: {links}", ""]
    if top:
        out.append(f"  [0]  (text)        L{top['line']}   {top['lines']} lines · ~{top['tokens']} tok")
    out += [d.tree_line(s) for s in d.sections()]
    out += ["", "next: <addr> a section · fm frontmatter (fm.<path> one value) · links outgoing links"]
    notes = [f"note: '{s.heading}' ({s.address}) also answers to a reserved address; reach it by number" for _, s in d.shadows()]
    return Reading("overview", "\n".join(out + notes) + "\n", {"path": path, "fields": fields, "links": links, "text": top, "tree": [node(s) for s in d.tree]})


def _frontmatter(path: str, d: Document, address: str, inner: str | None) -> Reading:
    block = Y.block_text(d.content)
    if block is None:
        also = None if inner else d.also("frontmatter")
        raise Unreadable(f"No frontmatter block in this file (address '{address}')" + (f"; {also}" if also else ""))
    if inner:
        try:
            value = Y.value_at(Y.load(block), inner)
        except yaml.YAMLError as e:
            raise Unreadable(f"frontmatter is not valid YAML: {' '.join(str(e).split())}") from None
        except KeyError as e:
            raise Unreadable(f"{e.args[0]}; top-level fields: {', '.join(f['key'] for f in d.fields())}") from None
        return Reading("value", Y.to_text(value) + "\n", {"path": path, "address": address, "value": json.loads(Y.to_json(value))})
    count = len(block.split("\n")) if block else 0
    if not count and len(d.content.removeprefix("﻿").split("\n")) > 1 and d.content.removeprefix("﻿").split("\n")[1].strip() != "---":
        count = 1  # a block of one empty line
    line = 2 if count else 1
    return Reading("frontmatter", f"{address}  (frontmatter)   L{line}   {count} lines\n\n{block}\n", {"path": path, "address": address, "line": line, "lines": count, "fields": d.fields()}, d.also("frontmatter"))


def pretty(data: object) -> str:
    return json.dumps(data, indent=2, ensure_ascii=False)


def read(docs: DataFrame, address: str | None = None, depth: int | None = None, full: bool = False, threshold: int = THRESHOLD, strict: bool = False, wikilinks_only: bool = False) -> DataFrame:
    """doc_id, reading, text, json, note, error for each row of (doc_id, content) and, as the shown name, path if there is one."""
    named = "path" in docs.columns
    needed = address is None or (reserved(address) or ("section",))[0] != "value"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            plain = scanned(batch.column(2)) if needed else [None] * batch.num_rows
            for i, path, content, known in zip(*(c.to_pylist() for c in batch.columns), plain):
                if content is None:
                    rows.append((i, None, None, None, None, None))
                    continue
                try:
                    r = read_document(path or "", content, address, depth, full, threshold, strict, wikilinks_only, known)
                    rows.append((i, r.kind, r.text, json.dumps(r.data, ensure_ascii=False), r.note, None))
                except Unreadable as e:
                    rows.append((i, None, None, None, None, str(e)))
            types = [pa.int64(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    source = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(path as string) as path" if named else "cast(doc_id as string) as path", "content")
    return source.mapInArrow(go, SCHEMA)


def unfold(docs: DataFrame, address: str, depth: int | None = None, full: bool = False, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, content: what ``structure.unfold`` gives, row by row; documents without the section have no row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, content, known in zip(*(c.to_pylist() for c in batch.columns), scanned(batch.column(1))):
                if content is None:
                    continue
                d = Document(content, scanned=known)
                try:
                    s = d.resolve(address)
                except Unreadable:
                    continue
                rows.append((i, d.unfold(s, 0, depth, threshold, full)))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["doc_id", "content"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "content").mapInArrow(go, "doc_id long, content string")
