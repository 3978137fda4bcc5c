"""Parsed Markdown as tables, and the reader's operators on them.

``parsed`` runs the grammar once for each row of (doc_id, content) and keeps all arrays in one row, so
persisting it gives a columnar table whose arrays are pruned apart. All else is DataFrame algebra:
region pairing and checks are windows partitioned by doc_id, which share one exchange. The heading tree
with its addresses, sections and sizes is made with the parse. Offsets are bytes, lines count from 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelake.functions import text as T
from quirelake.functions.markdown import Parsed, leaf_inlines, parse, walk
from quirelake.functions.scan import Scan, anchored, code_lists, documents, heading_lists, leaves, scan
from quirelake.operators import lines as L

_L, _S, _B = pa.int64(), pa.string(), pa.bool_()
HEADING = {"ord": _L, "level": _L, "setext": _B, "start_col": _L, "s_start": _L, "s_end": _L, "t_start": _L, "t_end": _L, "text": _S, "start_line": _L, "end_line": _L, "parent_ord": _L, "sec_end": _L, "section_end_line": _L, "address": _S, "last": _L, "tokens": _L, "strict_address": _S, "strict_last": _L, "strict_tokens": _L}
NODE = {"node_id": _L, "parent_id": _L, "depth": _L, "type": _S, "s_start": _L, "s_end": _L, "start_line": _L, "end_line": _L, "fenced": _B, "fence_char": _S, "fence_length": _L, "info": _S, "body_start": _L, "body_end": _L, "ordered": _B, "tight": _B, "marker": _S, "list_start": _L, "task": _B, "header": _B, "info_start": _L, "info_end": _L, "kind": _S}
INLINE = {"ord": _L, "type": _S, "s_start": _L, "s_end": _L, "start_line": _L, "url": _S, "title": _S, "alias": _S, "embed": _B, "label": _S, "sub_start": _L, "sub_end": _L}
ANCHOR = {"ord": _L, "label": _S, "info": _S, "is_open": _B, "whole_line": _B, "a_start": _L, "a_end": _L, "line_start": _L, "line_end": _L, "line": _L}
REGION = {"label": _S, "info": _S, "s_start": _L, "s_end": _L, "body_start": _L, "body_end": _L, "start_line": _L, "end_line": _L}
DANGLING = {"kind": _S, "label": _S, "s_start": _L, "s_end": _L, "line": _L}
#: Code blocks alone, for those who want no other node.
CODE = {"info": _S, "fence_length": _L, "start_line": _L, "end_line": _L, "body_start": _L, "body_end": _L}
_DOCUMENT = {"doc_id": _L, "bytes": _L, "line_count": _L, "body_start_line": _L, "body_start_byte": _L}
ARRAYS = {"headings": HEADING, "nodes": NODE, "inlines": INLINE, "anchors": ANCHOR, "regions": REGION, "dangling": DANGLING, "code": CODE}
_WALKED = frozenset(("headings", "nodes", "code"))
#: Bytes of text scanned at once; the arrays take some 40 times as much.
SCAN_BYTES = 2 << 20
#: Arrays that ``scan`` gives for plain texts.
_SCANNED = frozenset(("headings", "code", "inlines", "regions", "dangling"))
_ANCHORED = frozenset(("anchors", "regions", "dangling"))
_ANCHOR = re.compile(r"<!--[ \t]*(/)?([A-Za-z][\w.-]*)(?:[ \t]*:[ \t]*([^\r\n]*?))?[ \t]*-->")


def document_row(doc_id: int, content: str, want: Iterable[str] = ("headings", "nodes", "inlines", "anchors")) -> tuple:
    """doc_id and sizes of a document, and of each wanted array the list of its rows as tuples."""
    want = tuple(want)
    p = parse(content, inlines="inlines" in want or not _ANCHORED.isdisjoint(want) and "<!--" in content and "`" in content)
    m = p.byte_map()
    b = (lambda i: i) if m is None else m.__getitem__
    blocks = walk(p.root) if not _WALKED.isdisjoint(want) else []
    front, size = p.frontmatter, b(len(content))
    body_line = front[2] + 1 if front else 1
    anchors = [] if _ANCHORED.isdisjoint(want) else _anchors(p, b)
    found = {"headings": _headings, "nodes": _nodes, "inlines": _inlines, "anchors": lambda *_: anchors, "regions": lambda *_: _pair(anchors)[0], "dangling": lambda *_: _pair(anchors)[1], "code": _code}
    body_byte = (b(p.line_starts[front[2]]) if front[2] < len(p.line_starts) else size) if front else 0
    return (doc_id, size, len(p.line_starts) if content else 0, body_line, body_byte, *(found[a](p, b, blocks, body_line) for a in want))


def _headings(p: Parsed, b, blocks: list, body_line: int) -> list[tuple]:
    own = [n for n in blocks if n.kind == "heading" and n.parent is p.root]
    if not own:
        return []
    end, count = b(len(p.source)), len(p.line_starts)
    first = [p.line_of(n.start) for n in own]
    texts = [re.sub(r"[*_`]", "", "\n".join(t for t, _ in n.lines)) for n in own]
    chars = None
    trees = []
    for strict in (False, True):
        at = [k for k, n in enumerate(own) if texts[k] and first[k] >= body_line and not (strict and (n.data["setext"] or n.data["col"] != 1))]
        if strict and len(at) == len(trees[0][0]):
            trees.append(trees[0])
            continue
        if at and chars is None:
            chars = _upto(p)
        trees.append(_tree([own[k].data["level"] for k in at], [first[k] for k in at], count, at, chars))
    parents, nexts = _nesting([n.data["level"] for n in own])
    out = []
    for k, n in enumerate(own):
        t0, t1 = (n.lines[0][1], n.lines[-1][1] + len(n.lines[-1][0])) if n.lines else (n.end, n.end)
        after = nexts[k]
        up = parents[k]
        out.append((k + 1, n.data["level"], n.data["setext"], n.data["col"], b(n.start), b(n.end), b(t0), b(t1), texts[k], first[k], p.line_of(max(n.start, n.end - 1)), None if up is None else up + 1, end if after is None else b(own[after].start), count if after is None else first[after] - 1, *trees[0][1].get(k, _NONE), *trees[1][1].get(k, _NONE)))
    return out


_NONE = (None, None, None)


def _nesting(levels: list[int]) -> tuple[list, list]:
    """For each heading the nearest earlier one of a higher level, and the next one of the same or a higher level."""
    parents, nexts, stack = [None] * len(levels), [None] * len(levels), []
    for k, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            nexts[stack.pop()] = k
        parents[k] = stack[-1] if stack else None
        stack.append(k)
    return parents, nexts


def _tree(levels: list[int], first: list[int], count: int, places: list[int], chars: list[int] | None) -> tuple[list[int], dict[int, tuple]]:
    """Address, last line and tokens of each heading, by its place."""
    parents, nexts = _nesting(levels)
    children: dict[int | None, int] = {}
    addresses, out = [], {}
    for k, up in enumerate(parents):
        children[up] = children.get(up, 0) + 1
        addresses.append(str(children[up]) if up is None else f"{addresses[up]}.{children[up]}")
        last = count if nexts[k] is None else first[nexts[k]] - 1
        out[places[k]] = addresses[k], last, (chars[last] - chars[first[k] - 1] - 1) // 4
    return places, out


def _upto(p: Parsed) -> list[int]:
    """Characters of the first n lines, without their endings, and one more for each."""
    starts, source = p.line_starts, p.source
    if "\r" not in source:
        return [*starts, len(source) + (not source.endswith("\n"))]
    out = [0]
    for s, e in zip(starts, [*starts[1:], len(source)]):
        out.append(out[-1] + len(source[s:e].rstrip("\r\n")) + 1)
    return out


def _nodes(p: Parsed, b, blocks: list, _: int) -> list[tuple]:
    out = []
    ids: dict[int, int] = {}
    depths = {id(p.root): 0}
    line_of = p.line_of
    for n in blocks:
        depth = depths[id(n)] = depths[id(n.parent)] + 1
        kind, d = n.kind, n.data
        if kind == "heading":
            continue
        ids[id(n)] = len(out) + 1
        fenced = char = length = info = body_start = body_end = ordered = tight = marker = number = task = header = info_start = info_end = None
        if kind == "codeBlock":
            fenced, char, length, info = d["fenced"], d.get("char"), d.get("length"), d.get("info") or None
            if info:
                info_start, info_end = b(d["info_at"]), b(d["info_at"] + len(d["info"]))
            if n.lines:
                body_start, body_end = b(n.lines[0][1]), b(n.lines[-1][1] + len(n.lines[-1][0]))
        elif kind == "list":
            ordered, tight, marker, number = d["ordered"], d["tight"], d["marker"], d["number"]
        elif kind == "listItem":
            task = d["task"]
        elif kind == "tableRow":
            header = d["header"]
        out.append((len(out) + 1, ids.get(id(n.parent)), depth, kind, b(n.start), b(n.end), line_of(n.start), line_of(max(n.start, n.end - 1)), fenced, char, length, info, body_start, body_end, ordered, tight, marker, number, task, header, info_start, info_end, None))
    return out


def _code(p: Parsed, b, blocks: list, _: int) -> list[tuple]:
    out = []
    for n in blocks:
        if n.kind == "codeBlock":
            body = (b(n.lines[0][1]), b(n.lines[-1][1] + len(n.lines[-1][0]))) if n.lines else (None, None)
            out.append((n.data.get("info") or None, n.data.get("length"), p.line_of(n.start), p.line_of(max(n.start, n.end - 1)), *body))
    return out


def _inlines(p: Parsed, b, *_) -> list[tuple]:
    out = []
    for k, x in enumerate(p.inlines, 1):
        d = x.data
        sub = d.get("text_span") or d.get("alias_span")
        out.append((k, x.kind, b(x.start), b(x.end), p.line_of(x.start), d.get("url", d.get("target")), d.get("title"), d.get("alias"), d.get("embed"), d.get("label"), b(sub[0]) if sub else None, b(sub[1]) if sub else None))
    return out


def _anchors(p: Parsed, b) -> list[tuple]:
    """Region anchors outside code and multi-line comments."""
    if "<!--" not in p.source:
        return []
    masked = [(n.start, n.end) for n in walk(p.root) if n.kind == "codeBlock" or n.kind == "htmlBlock" and p.source.startswith("<!--", n.start) and re.search(r"[\r\n]", p.source[n.start : n.end])]
    masked = sorted(masked + [(x.start, x.end) for x in p.inlines if x.kind == "codeSpan"])
    out, k = [], 0
    for m in _ANCHOR.finditer(p.source):
        while k < len(masked) and masked[k][1] <= m.start():
            k += 1
        if k < len(masked) and masked[k][0] <= m.start():
            continue
        line = p.line_of(m.start())
        s = p.line_starts[line - 1]
        e = p.line_starts[line] if line < len(p.line_starts) else len(p.source)
        out.append((len(out) + 1, m[2], m[3] or None, m[1] is None, p.source[s:e].strip() == m[0], b(m.start()), b(m.end()), b(s), b(e), line))
    return out


def _pair(anchors: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Regions and unpaired anchors: within a label a close takes the last open; labels may interleave."""
    opens: dict[str, list[tuple]] = {}
    found, left = [], []
    for a in anchors:
        _, label, info, is_open, whole, start, end, line_start, line_end, line = a
        if is_open:
            opens.setdefault(label, []).append(a)
        elif own := opens.get(label):
            o = own.pop()
            found.append((label, o[2], o[7] if o[4] else o[5], line_end if whole else end, o[8] if o[4] else o[6], line_start if whole else start, o[9], line))
        else:
            left.append(("unpaired-close", label, start, end, line))
    left += [("unpaired-open", label, a[5], a[6], a[9]) for label, own in opens.items() for a in own]
    return sorted(found, key=lambda r: r[2:]), sorted(left, key=lambda d: d[2])


def parsed(docs: DataFrame, *want: str) -> DataFrame:
    """A row for each document with the wanted arrays (by default headings, nodes, inlines and anchors), and, if wanted, ``content``. Null content has no row."""
    text = "content" in want
    want = tuple(w for w in want if w != "content") or ("headings", "nodes", "inlines", "anchors")
    sizes = list(_DOCUMENT.items())
    names = [*_DOCUMENT, *want, *["content"] * text]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(1).null_count:
                batch = batch.filter(batch.column(1).is_valid())
            if _SCANNED.issuperset(want):
                others = []
                step = max(1, batch.num_rows * SCAN_BYTES // max(batch.column(1).nbytes, 1))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    plain, made = _scanned(part, want)
                    yield pa.RecordBatch.from_arrays([*made, *[part.column(1).filter(plain)] * text], names=names)
                    others.append(part.filter(pc.invert(plain)))
                batch = pa.Table.from_batches(others, batch.schema).combine_chunks().to_batches()[0] if any(o.num_rows for o in others) else batch.slice(0, 0)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = list(zip(*(document_row(i, c, want) for i, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist()))))
                flat = [pa.array(c, t) for c, (_, t) in zip(rows, sizes)]
                arrays = [_list_array(c, ARRAYS[a]) for c, a in zip(rows[len(sizes) :], want)]
                yield pa.RecordBatch.from_arrays([*flat, *arrays, *[part.column(1)] * text], names=names)

    sql = {_L: "bigint", _S: "string", _B: "boolean"}
    schema = [f"{n} {sql[t]}" for n, t in sizes] + [f"{a} array<struct<{', '.join(f'{n}: {sql[t]}' for n, t in ARRAYS[a].items())}>>" for a in want] + ["content string"] * text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(go, ", ".join(schema))


def _scanned(batch: pa.RecordBatch, want: tuple[str, ...]) -> tuple[pa.Array, list[pa.Array]]:
    """Which texts are plain, and the columns of these."""
    s = scan(batch.column(1))
    plain = s.plain_code if "code" in want else s.plain
    text = s.text() if not _PLACED.isdisjoint(want) else ""
    if "inlines" in want:
        ok, spans, owners = leaves(s, text)
        plain = plain & ok
    if not _ANCHORED.isdisjoint(want):
        plain = plain & anchored(s)
    docs = np.flatnonzero(plain)
    made = {}
    if "headings" in want:
        made["headings"] = heading_lists(s, docs, HEADING)
    if "code" in want:
        made["code"] = code_lists(s, docs, CODE)
    if "inlines" in want:
        made["inlines"] = _list_array(_leaf_inlines(s, text, docs, spans, owners), INLINE)
    if not _ANCHORED.isdisjoint(want):
        pairs = [_pair(rows) for rows in _plain_anchors(s, text, docs)]
        made["regions"], made["dangling"] = (_list_array(list(x), ARRAYS[a]) for a, x in zip(("regions", "dangling"), zip(*pairs) if pairs else ((), ())))
    keep = pa.array(plain)
    return keep, [batch.column(0).filter(keep), *documents(s, docs), *(made[a] for a in want)]


_PLACED = frozenset(("inlines", "regions", "dangling"))


def _leaf_inlines(s: Scan, text: str, docs: np.ndarray, spans: list[list[int]], owners: list[int]) -> list[list[tuple]]:
    """For each text the rows of its inlines."""
    found: dict[int, list] = {d: [] for d in docs.tolist()}
    for span, d in zip(spans, owners):
        if d in found:
            found[d] += leaf_inlines([(text[a:e], a) for a, e in zip(span[::2], span[1::2])])
    out = []
    for own in found.values():
        own.sort(key=lambda x: x.start)
    numbers = iter(s.number[s.line_at(np.array([x.start for own in found.values() for x in own], np.int64))].tolist())
    for own, base in zip(found.values(), s.offsets[docs].tolist()):
        rows = []
        for k, x in enumerate(own, 1):
            d = x.data
            sub = d.get("text_span") or d.get("alias_span")
            rows.append((k, x.kind, x.start - base, x.end - base, next(numbers), d.get("url", d.get("target")), d.get("title"), d.get("alias"), d.get("embed"), d.get("label"), sub[0] - base if sub else None, sub[1] - base if sub else None))
        out.append(rows)
    return out


def _plain_anchors(s: Scan, text: str, docs: np.ndarray) -> list[list[tuple]]:
    """For each text its anchors outside fences; none of them has a line of its own."""
    out: list[list[tuple]] = []
    places: list[int] = []
    for a, e in zip(s.offsets[docs].tolist(), s.offsets[docs + 1].tolist()):
        rows = []
        for m in _ANCHOR.finditer(text, a, e):
            places.append(m.start())
            rows.append((m[2], m[3] or None, m[1] is None, False, m.start() - a, m.end() - a))
        out.append(rows)
    lines = s.line_at(np.array(places, np.int64))
    numbers, hidden = iter(s.number[lines].tolist()), iter(s.fenced[lines].tolist())
    return [[(0, *r, 0, 0, n) for r, n, h in [(r, next(numbers), next(hidden)) for r in rows] if not h] for rows in out]


def _list_array(lists: tuple, kind: dict[str, pa.DataType]) -> pa.ListArray:
    columns = list(zip(*(row for own in lists for row in own))) or [()] * len(kind)
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.values())], names=list(kind))
    ends = [0]
    for own in lists:
        ends.append(ends[-1] + len(own))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _explode(p: DataFrame, array: str, *keep: str) -> DataFrame:
    return p.select("doc_id", *keep, F.explode(array).alias("x")).select("doc_id", *keep, "x.*")


def nodes(p: DataFrame) -> DataFrame:
    return _explode(p, "nodes")


def code_blocks(p: DataFrame) -> DataFrame:
    return _explode(p, "code")


def inlines(p: DataFrame) -> DataFrame:
    return _explode(p, "inlines")


_OUTLINE = ("address", "last", "tokens")


def headings(p: DataFrame) -> DataFrame:
    """Headings with parent_ord, sec_start, sec_end and section_end_line: to the next heading of the same or a higher level, or the end."""
    h = _explode(p, "headings", "bytes", "line_count")
    return h.drop(*_OUTLINE, *(f"strict_{c}" for c in _OUTLINE)).withColumn("sec_start", F.col("s_start"))


def outline(p: DataFrame, strict: bool = False) -> DataFrame:
    """address, heading, slug, level, line, start_line, end_line, lines, tokens. Headings without text, or within the frontmatter's lines, are left out; ``strict`` takes only ATX headings at column 1.

    The parse has made the tree, so rows stay where they are."""
    address, last, tokens = (F.col(f"strict_{c}" if strict else c) for c in _OUTLINE)
    h = _explode(p, "headings").where(address.isNotNull())
    return h.select("doc_id", address.alias("address"), F.col("text").alias("heading"), T.slug(F.col("text")).alias("slug"), "level", F.col("start_line").alias("line"), "start_line", last.alias("end_line"), (last - F.col("start_line") + 1).alias("lines"), tokens.alias("tokens"))


def resolve(outline_: DataFrame, address: str) -> DataFrame:
    """The sections at a dotted address or slug. For a slug, ``candidates`` counts the document's matches: more than one is ambiguous."""
    if re.fullmatch(r"[0-9]+(\.[0-9]+)*", address):
        wanted = ".".join(str(int(x)) for x in address.split("."))
        return outline_.where(F.col("address") == wanted).withColumn("candidates", F.lit(1).cast("long"))
    found = outline_.where(F.col("slug") == T.slug(F.lit(address)))
    return found.withColumn("candidates", F.count("*").over(Window.partitionBy("doc_id")))


def shadows(outline_: DataFrame) -> DataFrame:
    """Headings whose slug is a reserved reading: doc_id, ord, reading, address, heading. ``ord`` counts a document's in reading order (text, frontmatter, links), and within one in document order."""
    reading = F.when(F.col("slug") == "text", "text").when(F.col("slug").isin("fm", "frontmatter"), "frontmatter").when(F.col("slug") == "links", "links")
    found = outline_.withColumn("reading", reading).where("reading is not null")
    rank = F.when(F.col("reading") == "text", 0).when(F.col("reading") == "frontmatter", 1).otherwise(2)
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "start_line")).cast("long").alias("ord"), "reading", "address", "heading")


def links(p: DataFrame, wikilinks_only: bool = False) -> DataFrame:
    """doc_id, ord, kind, target, alias, line. An alias that is empty or the target itself is null."""
    kinds = ["wikilink"] if wikilinks_only else ["wikilink", "link", "autolink"]
    got = inlines(p).where(F.col("type").isin(kinds))
    shown = F.when(F.col("type") == "wikilink", F.col("alias")).when(F.col("type") == "link", F.col("label"))
    return got.select("doc_id", "ord", F.col("type").alias("kind"), F.col("url").alias("target"), F.when((shown != "") & ((F.col("type") == "wikilink") | (shown != F.col("url"))), shown).alias("alias"), F.col("start_line").alias("line"))


def regions(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions, and dangling anchors: within a document and label a close takes the last open; labels may interleave.

    Arrays of them in ``p`` are taken as they are; a table of anchors alone is paired by windows."""
    if "regions" in p.columns and "dangling" in p.columns:
        return _explode(p, "regions"), _explode(p, "dangling")
    a = _explode(p, "anchors").withColumn("k", F.when(F.col("is_open"), 1).otherwise(-1))
    w = Window.partitionBy("doc_id", "label").orderBy("a_start")
    a = a.withColumn("s", F.sum("k").over(w))
    a = a.withColumn("m", F.least(F.lit(0), F.min("s").over(w)))
    a = a.withColumn("mp", F.coalesce(F.lag("m").over(w), F.lit(0)))
    a = a.withColumn("unpaired", (F.col("k") == -1) & (F.col("s") < F.col("mp")))
    a = a.withColumn("deep", F.when(F.col("is_open"), F.col("s") - F.col("m")).otherwise(F.col("s") + 1 - F.col("mp")))
    d = Window.partitionBy("doc_id", "label", "deep", "unpaired").orderBy("a_start")
    nxt = F.lead(F.struct("is_open", "whole_line", "a_start", "a_end", "line_start", "line_end", "line")).over(d)
    a = a.withColumn("nxt", nxt)
    paired = F.col("is_open") & F.coalesce(~F.col("nxt.is_open"), F.lit(False))
    closes = F.coalesce(F.lag("is_open").over(d), F.lit(False))
    a = a.withColumns({"paired": paired, "closes": ~F.col("is_open") & ~F.col("unpaired") & closes})
    found = a.where("paired").select("doc_id", "label", "info", F.when(F.col("whole_line"), F.col("line_start")).otherwise(F.col("a_start")).alias("s_start"), F.when(F.col("nxt.whole_line"), F.col("nxt.line_end")).otherwise(F.col("nxt.a_end")).alias("s_end"), F.when(F.col("whole_line"), F.col("line_end")).otherwise(F.col("a_end")).alias("body_start"), F.when(F.col("nxt.whole_line"), F.col("nxt.line_start")).otherwise(F.col("nxt.a_start")).alias("body_end"), F.col("line").alias("start_line"), F.col("nxt.line").alias("end_line"))
    dangling = a.where("(is_open and not paired) or (not is_open and not closes)").select("doc_id", F.when(F.col("is_open"), "unpaired-open").otherwise("unpaired-close").alias("kind"), "label", F.col("a_start").alias("s_start"), F.col("a_end").alias("s_end"), "line")
    return found, dangling


def stats(p: DataFrame) -> DataFrame:
    """group (node or inline), label and n over the corpus; headings count as ``heading{level}``."""
    found = p.select(F.explode(F.concat(F.transform("nodes", lambda x: F.struct(F.lit("node").alias("group"), x["type"].alias("label"))), F.transform("headings", lambda x: F.struct(F.lit("node").alias("group"), F.concat(F.lit("heading"), x["level"].cast("string")).alias("label"))), F.transform("inlines", lambda x: F.struct(F.lit("inline").alias("group"), x["type"].alias("label"))))).alias("x"))
    return found.groupBy("x.group", "x.label").agg(F.count("*").alias("n"))


def _partial(docs: DataFrame, count, schema: str) -> DataFrame:
    """Rows that ``count`` makes of each batch's contents, nulls left out: narrow partial sums instead of arrays."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = count([c for c in batch.column(0).to_pylist() if c is not None])
            types = [_S if kind == "string" else _L for _, kind in (x.split() for x in schema.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(types), types)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("content").mapInArrow(go, schema)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """``stats`` of (doc_id, content), counted with the parse: no array leaves it."""

    def count(contents: list[str]) -> list[tuple]:
        found: Counter[tuple[str, str]] = Counter()
        for c in contents:
            p = parse(c)
            for n in walk(p.root):
                if n.kind != "heading":
                    found["node", n.kind] += 1
                elif n.parent is p.root:
                    found["node", f"heading{n.data['level']}"] += 1
            for x in p.inlines:
                found["inline", x.kind] += 1
        return [(*k, n) for k, n in found.items()]

    return _partial(docs, count, "group string, label string, n bigint").groupBy("group", "label").agg(F.sum("n").alias("n"))


def corpus_tiling(docs: DataFrame) -> DataFrame:
    """A row of docs, overlaps and gaps: the numbers of documents and of rows of ``overlaps`` and ``gaps``, counted with the parse."""

    def count(contents: list[str]) -> list[tuple]:
        over = outside = 0
        for c in contents:
            p = parse(c, inlines=False)
            front = p.frontmatter
            edge = reach = (p.line_starts[front[2]] if front[2] < len(p.line_starts) else len(c)) if front else 0
            first = True
            for a, b in [*sorted((n.start, n.end) for n in p.root.children), (len(c), None)]:
                over += b is not None and not first and a < reach
                outside += a > edge and not _SPACE.fullmatch(c, edge, a)
                if b is not None:
                    reach, edge, first = b if first else max(reach, b), b, False
        return [(len(contents), over, outside)]

    return _partial(docs, count, "docs bigint, overlaps bigint, gaps bigint").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "overlaps", "gaps")))


_SPACE = re.compile("\ufeff?[ \t\r\n]*")


def overlaps(p: DataFrame) -> DataFrame:
    """Top-level spans that begin before an earlier one ends: the tiling check's violations."""
    spans = p.select("doc_id", F.explode(F.concat(F.transform(F.filter("nodes", lambda x: x["parent_id"].isNull()), lambda x: F.struct(x["s_start"].alias("a"), x["s_end"].alias("b"))), F.transform("headings", lambda x: F.struct(x["s_start"].alias("a"), x["s_end"].alias("b"))))).alias("x")).select("doc_id", "x.*")
    reach = F.max("b").over(Window.partitionBy("doc_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("reach", reach).where("a < reach")


def gaps(docs: DataFrame, p: DataFrame) -> DataFrame:
    """Stretches outside every top-level span that hold more than white space: doc_id, g_start, g_end, text."""
    spans = p.select("doc_id", "bytes", "body_start_byte", F.array_sort(F.concat(F.transform(F.filter("nodes", lambda x: x["parent_id"].isNull()), lambda x: F.struct(x["s_start"].alias("a"), x["s_end"].alias("b"))), F.transform("headings", lambda x: F.struct(x["s_start"].alias("a"), x["s_end"].alias("b"))))).alias("spans"))
    spans = spans.select("doc_id", F.explode(F.zip_with(F.concat(F.array(F.col("body_start_byte")), F.transform("spans", lambda x: x["b"])), F.concat(F.transform("spans", lambda x: x["a"]), F.array(F.col("bytes"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("g")).where("g.b > g.a").select("doc_id", "g.a", "g.b")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("content", "UTF-8").alias("raw"))
    text = F.decode(F.expr("substring(raw, cast(a + 1 as int), cast(b - a as int))"), "UTF-8")
    found = spans.join(raw, "doc_id").select("doc_id", F.col("a").alias("g_start"), F.col("b").alias("g_end"), text.alias("text"))
    return found.where(~F.col("text").rlike(r"\A\x{FEFF}?[ \t\r\n]*\z"))


def _text_lines(docs: DataFrame) -> DataFrame:
    """doc_id and all, the array of lines without their endings."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(L.line_array(F.col("content")), lambda x: F.regexp_replace(x, r"(\r\n|\r|\n)\z", "")).alias("all"))


def lede(docs: DataFrame, p: DataFrame) -> DataFrame:
    """The text before the first heading, as the outline's row of address 0: doc_id, line, end_line, lines, tokens. Only where it holds more than white space. Where ``p`` has the content, ``docs`` isn't read and no row moves."""
    first = F.array_min(F.transform(F.filter("headings", lambda x: (x["text"] != "") & (x["start_line"] >= F.col("body_start_line"))), lambda x: x["start_line"]))
    own = p.select("doc_id", "body_start_line", F.coalesce(first - 1, F.col("line_count")).alias("end_line"), *["content"] * ("content" in p.columns))
    if "content" in p.columns:
        rows = own.select("doc_id", "body_start_line", "end_line", F.split(F.call_function("substring_index", T.to_lf(F.col("content")), F.lit("\n"), F.col("end_line").cast("int")), "\n").alias("all"))
    else:
        rows = own.join(_text_lines(docs), "doc_id")
    rows = rows.where("end_line >= body_start_line")
    part = F.slice("all", F.col("body_start_line").cast("int"), (F.col("end_line") - F.col("body_start_line") + 1).cast("int"))
    skipped = F.array_position(F.transform(part, lambda x: F.trim(F.translate(x, "\t", " ")) != ""), True)
    rows = rows.withColumn("skipped", skipped).where("skipped > 0").withColumn("line", F.col("body_start_line") + F.col("skipped") - 1)
    text = F.array_join(F.slice("all", F.col("line").cast("int"), (F.col("end_line") - F.col("line") + 1).cast("int")), "\n")
    return rows.select("doc_id", F.lit("0").alias("address"), F.lit("(text)").alias("heading"), F.lit("text").alias("slug"), F.lit(0).cast("long").alias("level"), "line", "end_line", (F.col("end_line") - F.col("line") + 1).alias("lines"), T.estimate_tokens(text).alias("tokens"))


def unfold(docs: DataFrame, outline_: DataFrame, address: str, depth: int | None = None, full: bool = False, threshold: int = 2000) -> DataFrame:
    """doc_id, content: the section at a dotted address with each subsection's text, or its line of the tree if it is deeper than ``depth`` or larger than ``threshold`` tokens. ``outline_`` needs tokens.

    A section is hidden if a folded one before it reaches over its start: a running maximum, no recursion.
    """
    address = ".".join(str(int(x)) for x in address.split("."))
    inside = outline_.where((F.col("address") == address) | F.col("address").startswith(address + "."))
    level = F.length("address") - F.length(F.replace("address", F.lit("."), F.lit(""))) - address.count(".")
    open_ = F.lit(True) if full else (F.col("tokens") <= threshold) & (F.lit(True) if depth is None else level - 1 < depth)
    rows = inside.withColumn("folded", (level > 0) & ~open_)
    w = Window.partitionBy("doc_id").orderBy("start_line")
    rows = rows.withColumns({"reach": F.max(F.when(F.col("folded"), F.col("end_line"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), "next": F.lead("start_line").over(w)})
    shown = rows.where("reach is null or reach < start_line")
    own_end = F.when(F.col("next") <= F.col("end_line"), F.col("next") - 1).otherwise(F.col("end_line"))
    prose = F.array_join(F.slice("all", F.col("start_line").cast("int"), (own_end - F.col("start_line") + 1).cast("int")), "\n")
    ended = F.when((prose == "") | prose.endswith("\n"), prose).otherwise(F.concat(prose, F.lit("\n")))
    line = F.concat(T.tree_line(F.coalesce(F.col("next") <= F.col("end_line"), F.lit(False)), F.col("address"), F.col("heading"), F.col("line"), F.col("lines"), F.col("tokens")), F.lit("\n"))
    parts = shown.join(_text_lines(docs), "doc_id").select("doc_id", "start_line", F.when(F.col("folded"), line).otherwise(ended).alias("part"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "part"))), lambda x: x["part"]), "").alias("content"))
