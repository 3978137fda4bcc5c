"""Plain Markdown by the batch: lines, headings, fences and anchors of many texts as arrays, without an object for each.

``scan`` reads a batch of texts at once. It takes only texts whose blocks it is sure of: unindented headings, fences of three backticks,
bullets, tables and paragraphs under a closed frontmatter block. ``plain`` says which these are; ``markdown.parse`` reads the others.
Offsets are bytes from the beginning of the batch, lines count from 1.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BAD = np.zeros(256, bool)
_BAD[[0, 9, 11, 12, 13]] = True
#: First bytes outside fences that begin blocks, or end them, in ways that aren't followed here.
_ODD = np.zeros(256, bool)
_ODD[list(b" <>=")] = True
_RULE = np.zeros(256, bool)
_RULE[list(b"-*_")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"*_`")] = True
_BULLET = np.zeros(256, bool)
_BULLET[list(b"*+-")] = True
#: What may begin another block within an item.
_INNER = np.zeros(256, bool)
_INNER[list(b"\n >#`~<=-*+_|:0123456789[")] = True
_LEVELS = range(1, 7)
#: Without one of these, or www., a text has no inlines.
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b"\\`*_~<[]!@:")] = True
_NO_LEAVES = re.compile(r"\]:|!\[\[|[wW]{3}\.")


@dataclass
class Scan:
    data: np.ndarray
    #: Where each text begins, and the end of the last.
    offsets: np.ndarray
    plain: np.ndarray
    #: Of these, texts without code within items.
    plain_code: np.ndarray
    body_line: np.ndarray
    #: Of each line: its text, start, end without the line feed, number.
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    number: np.ndarray
    #: Index of each text's first line, and the number of all.
    first: np.ndarray
    fenced: np.ndarray
    opens: np.ndarray
    closes: np.ndarray
    headings: np.ndarray
    levels: np.ndarray
    #: First byte of each line, a line feed for an empty one, and the lines outside fences and frontmatter.
    lead: np.ndarray
    outside: np.ndarray

    def text(self) -> str:
        """A character for each byte."""
        return self.data.tobytes().decode("latin-1")

    def line_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, places, "right") - 1


def scan(texts: pa.Array) -> Scan:
    """``texts`` has no nulls."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    total = int(offsets[-1])
    plain = np.ones(n, bool)

    def odd(docs: np.ndarray) -> None:
        plain[docs] = False

    def of(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(offsets, places, "right") - 1

    # a few bytes more, so that a look past the end is a line feed
    at = np.concatenate([data, np.full(8, 10, np.uint8)])
    odd(of(np.flatnonzero(_BAD[data])))
    filled = offsets[:-1][np.diff(offsets) > 0]
    start = np.unique(np.concatenate([filled, np.flatnonzero(data == 10) + 1]))
    start = start[start < total]
    doc = of(start)
    whole = np.concatenate([start[1:], [total]])[: len(start)]
    end = whole - (data[whole - 1] == 10) if len(start) else whole
    first = np.searchsorted(doc, np.arange(n + 1))
    number = np.arange(len(start)) - first[doc] + 1
    size = end - start
    b0, b1, b2, b3 = (np.where(size > k, at[start + k], 10) for k in range(4))
    odd(doc[(b0 == 0xEF) & (number == 1)])

    # frontmatter: from --- on the first line to the next such line
    dashes = (size == 3) & (b0 == 45) & (b1 == 45) & (b2 == 45)
    known = np.zeros(len(start), bool)
    body_line = np.ones(n, np.int64)
    lines = np.flatnonzero(dashes)
    opening = np.flatnonzero(number[lines] == 1)
    after = np.minimum(opening + 1, max(len(lines) - 1, 0))
    closed = (opening + 1 < len(lines)) & (doc[lines[after]] == doc[lines[opening]])
    odd(doc[lines[opening[~closed]]])
    body_line[doc[lines[opening[closed]]]] = number[lines[after[closed]]] + 1
    known[lines[opening[closed]]] = known[lines[after[closed]]] = True
    front = number < body_line[doc]

    # fences: of a text's candidates each second one closes the one before
    ticks = ((b0 == 96) | (b0 == 126)) & (b1 == b0) & (b2 == b0) & ~front
    odd(doc[ticks & ((b0 == 126) | (b3 == 96))])
    lines = np.flatnonzero(ticks)
    left = np.bincount(doc[lines], minlength=n) % 2 == 1
    odd(left)
    lines = lines[~left[doc[lines]]]
    turn = np.arange(len(lines)) - np.searchsorted(doc[lines], doc[lines])
    opens, closes = lines[turn % 2 == 0], lines[turn % 2 == 1]
    odd(doc[closes[size[closes] != 3]])
    backticks = np.flatnonzero(data == 96)
    odd(doc[opens[np.searchsorted(backticks, end[opens]) > np.searchsorted(backticks, start[opens] + 3)]])
    mark = np.zeros(len(start) + 1, np.int64)
    np.add.at(mark, opens, 1)
    np.add.at(mark, closes, -1)
    fenced = np.cumsum(mark)[:-1] > 0
    odd(doc[fenced & (b0 == 32) & ((b1 == 96) | (b2 == 96) | (b3 == 96))])
    outside = ~fenced & ~front
    outside[closes] = False

    rule = _RULE[b0] & ((b1 == b0) | (b1 == 32) | (b1 == 10)) & ((b2 == b0) | (b2 == 32) | (b2 == 10)) & ~known
    odd(doc[(outside & (_ODD[b0] | rule)) | (front & rule)])

    # headings: marks, one space, text that neither ends in a mark or space nor begins with markup
    marks = (outside & (b0 == 35)).astype(np.int64)
    for k in range(1, 7):
        marks += (marks == k) & (at[start + k] == 35) & (size > k)
    follows = np.where(size > marks, at[start + marks], 32)
    is_heading = (marks > 0) & (marks < 7) & (follows == 32)
    h = np.flatnonzero(is_heading)
    text = start[h] + marks[h] + 1
    odd(doc[h[(text >= end[h]) | (at[text] == 32) | _MARK[at[text]] | (at[end[h] - 1] == 32) | (at[end[h] - 1] == 35)]])

    digits = (b0 >= 48) & (b0 <= 57)
    plain_code = plain.copy()
    plain_code[doc[outside & (digits | (_BULLET[b0] & (b1 == 32) & _INNER[b2]))]] = False
    return Scan(data, offsets, plain, plain_code, body_line, doc, start, end, number, first, fenced, opens, closes, h, marks[h], b0, outside)


def _strings(s: Scan, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices of the batch."""
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(s.data[where].tobytes()))


def lists(docs: np.ndarray, own: np.ndarray, columns: dict[str, pa.Array], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """A list for each of ``docs`` of the rows whose texts are ``own``, in order."""
    ends = np.concatenate([[0], np.searchsorted(own, docs, "right")]).astype(np.int32)
    values = pa.StructArray.from_arrays([columns[name].cast(kind) if columns[name].type != kind else columns[name] for name, kind in kinds.items()], names=list(kinds))
    return pa.ListArray.from_arrays(pa.array(ends), values)


def documents(s: Scan, docs: np.ndarray) -> list[pa.Array]:
    """Bytes, lines, and the body's first line and byte."""
    size, count, line = np.diff(s.offsets)[docs], np.diff(s.first)[docs], s.body_line[docs]
    past = line > count
    at = np.append(s.start, 0)[np.where(past, 0, s.first[docs] + line - 1)] - s.offsets[docs]
    return [pa.array(x) for x in (size, count, line, np.where(line == 1, 0, np.where(past, size, at)))]


def _number(group: np.ndarray) -> np.ndarray:
    """Of each element its number among the equal ones, from 1."""
    order = np.argsort(group, kind="stable")
    own = group[order]
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.searchsorted(own, own) + 1
    return out


def heading_lists(s: Scan, docs: np.ndarray, kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """The rows of ``structure.HEADING`` of these plain texts."""
    wanted = np.zeros(len(s.plain), bool)
    wanted[docs] = True
    keep = wanted[s.doc[s.headings]]
    line, level = s.headings[keep], s.levels[keep]
    doc, count = s.doc[line], len(line)
    here = np.arange(count)
    begin, stop = np.searchsorted(doc, doc), np.searchsorted(doc, doc, "right")
    parent, after = np.full(count, -1), np.full(count, count)
    for k in _LEVELS:
        last = np.maximum.accumulate(np.where(level == k, here, -1))
        parent = np.where(level > k, np.maximum(parent, last), parent)
        coming = np.append(np.minimum.accumulate(np.where(level == k, here, count)[::-1])[::-1], count)[1:]
        after = np.where(level >= k, np.minimum(after, coming), after)
    has_parent, has_next = parent >= begin, after < stop
    nth = _number(np.where(has_parent, parent, count + doc))
    addresses: list[str] = []
    for up, k in zip(np.where(has_parent, parent, -1).tolist(), nth.tolist()):
        addresses.append(str(k) if up < 0 else f"{addresses[up]}.{k}")
    base, size = s.offsets[doc], np.diff(s.offsets)[doc]
    start, end = s.start[line], s.end[line]
    following = np.append(line, 0)[np.where(has_next, after, count)]
    doc_end = s.offsets[doc + 1]
    sec_end = np.where(has_next, s.start[following] if len(s.start) else 0, doc_end)
    last_line = np.where(has_next, s.number[following] - 1, np.diff(s.first)[doc]) if count else here
    upto = np.arange(len(s.data) + 1) if not len(s.data) or s.data.max() < 128 else np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
    unended = ~has_next & (s.data[doc_end - 1] != 10) if count else here.astype(bool)
    tokens = (upto[sec_end] + unended - upto[start] - 1) // 4
    text = _strings(s, start + level + 1, end)
    if np.any(_MARK[np.frombuffer(text.buffers()[2], np.uint8)]) if count else False:
        text = pc.replace_substring_regex(text, "[*_`]", "")
    address, number = pa.array(addresses, pa.string()), pa.array(s.number[line])
    last, tokens = pa.array(last_line), pa.array(tokens)
    columns = {
        "ord": pa.array(here - begin + 1), "level": pa.array(level), "setext": pa.array(np.zeros(count, bool)), "start_col": pa.array(np.ones(count, np.int64)),
        "s_start": pa.array(start - base), "s_end": pa.array(end - base), "t_start": pa.array(start + level + 1 - base), "t_end": pa.array(end - base), "text": text,
        "start_line": number, "end_line": number, "parent_ord": pa.array(parent - begin + 1, mask=~has_parent), "sec_end": pa.array(sec_end - base), "section_end_line": last,
        "address": address, "last": last, "tokens": tokens, "strict_address": address, "strict_last": last, "strict_tokens": tokens,
    }
    return lists(docs, doc, columns, kinds)


def code_lists(s: Scan, docs: np.ndarray, kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """The rows of ``structure.CODE`` of these texts, which are plain in their items too."""
    wanted = np.zeros(len(s.plain), bool)
    wanted[docs] = True
    opens, closes = s.opens[wanted[s.doc[s.opens]]], s.closes[wanted[s.doc[s.closes]]]
    base = s.offsets[s.doc[opens]]
    info = pc.utf8_trim(_strings(s, s.start[opens] + 3, s.end[opens]), " ")
    info = pc.if_else(pc.equal(info, ""), pa.scalar(None, pa.string()), info)
    empty = closes == opens + 1
    columns = {
        "info": info, "fence_length": pa.array(np.full(len(opens), 3)), "start_line": pa.array(s.number[opens]), "end_line": pa.array(s.number[closes]),
        "body_start": pa.array(s.start[np.minimum(opens + 1, closes)] - base, mask=empty), "body_end": pa.array(s.end[closes - 1] - base, mask=empty),
    }
    return lists(docs, s.doc[opens], columns, kinds)


def _ascii(s: Scan) -> np.ndarray:
    out = s.plain_code.copy()
    out[np.searchsorted(s.offsets, np.flatnonzero(s.data > 127), "right") - 1] = False
    return out


def anchored(s: Scan) -> np.ndarray:
    """Plain texts in ASCII whose anchors can only be masked by fences, and share their lines with text."""
    out = _ascii(s)
    ticks = s.line_at(np.flatnonzero(s.data == 96))
    loose = ~s.fenced[ticks]
    loose &= ~np.isin(ticks, s.closes)
    out[s.doc[ticks[loose]]] = False
    front = s.number < s.body_line[s.doc]
    out[s.doc[front & ((s.lead == 60) | (s.lead == 32))]] = False
    return out


def leaves(s: Scan, text: str) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """Texts whose inlines lie in leaves of whole lines, and these leaves in order, so far as they may hold inlines: the lines' starts and ends in turn, and the text's number."""
    out = _ascii(s)
    out[[np.searchsorted(s.offsets, m.start(), "right") - 1 for m in _NO_LEAVES.finditer(text)]] = False
    count = len(s.start)
    special = np.concatenate([[0], np.cumsum(_SPECIAL[s.data], dtype=np.int64)])
    begin = s.start.copy()
    is_heading = np.zeros(count, bool)
    is_heading[s.headings] = True
    begin[s.headings] += s.levels + 1
    bullet = s.outside & _BULLET[s.lead] & (s.data[np.minimum(s.start + 1, len(s.data) - 1)] == 32) & (s.end - s.start > 1) if count else is_heading
    begin[bullet] += 2
    holds = special[s.end] > special[np.minimum(begin, s.end)]
    row = s.outside & (s.lead == 124)
    prose = s.outside & (s.lead != 10) & ~is_heading & ~bullet & ~row
    # which of these follow each other directly
    same = np.append(s.doc[1:] == s.doc[:-1], False) if count else is_heading
    following = lambda kind: np.append(kind[1:], False) & same
    out[s.doc[(row & (holds | following(prose))) | (prose & following(row)) | (bullet & (following(prose) | following(row)))]] = False
    joined = prose & np.append(False, (prose & same)[:-1]) if count else prose
    own = np.flatnonzero((prose | (is_heading | bullet) & holds) & out[s.doc])
    leaf = np.cumsum(~joined[own]) - 1
    some = np.bincount(leaf, holds[own]) > 0 if len(own) else np.zeros(0, bool)
    own, leaf = own[some[leaf]], leaf[some[leaf]]
    spans: list[list[int]] = []
    docs: list[int] = []
    last = -1
    for k, a, e, d in zip(leaf.tolist(), begin[own].tolist(), s.end[own].tolist(), s.doc[own].tolist()):
        if k == last:
            spans[-1] += (a, e)
        else:
            spans.append([a, e])
            docs.append(d)
            last = k
    return out, spans, docs
