"""Token counts of sections by offset-mapped attribution.

Each whole document is encoded once with a byte-level BPE, so no token differs from what a model
sees. A token's span comes from the byte lengths of the tokens before it. Sections are the lines of the
text, each with its line end. Spans of tokens and sections are joined as intervals, and a
token that crosses a boundary is allocated by ``rule``:

- ``majority``: to the section with most of its bytes, the earlier of equals;
- ``first``: to the section of its first byte;
- ``split``: to each section in proportion to its bytes.

Under each rule a document's sections add up to its tokens. Spans are given in characters; a
character that two tokens share counts for the one with its first byte.

Defined results: a null text has no rows; an empty text has one section with 0 tokens. A null doc_id
and repeated rows give rows like any other. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from quirelake.llm import textscan

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("majority", "first", "split")
SCHEMA = "doc_id long, section int, char_start long, char_end long, tokens double, crossing long"


class Encoder:
    """The encoding of a rank file's content, and the byte length of each token."""

    _made: dict[int, Encoder] = {}

    def __init__(self, content: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    @classmethod
    def of(cls, content: bytes) -> Encoder:
        key = hash(content)
        if key not in cls._made:
            cls._made[key] = cls(content)
        return cls._made[key]

    def lengths(self, text: str) -> np.ndarray:
        return self.size[self.encoding.encode_to_numpy(text, disallowed_special=())]


def attribute(token: np.ndarray, section: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of them cross. Both are borders from 0 to the same end; borders of tokens rise strictly, of sections they may repeat."""
    n_tokens, n_sections = len(token) - 1, len(section) - 1
    cut = np.union1d(token, section)
    if len(cut) < 2:
        return np.zeros(n_sections), np.zeros(n_sections, np.int64)
    of_token = np.searchsorted(token, cut[:-1], side="right") - 1
    of_section = np.searchsorted(section, cut[:-1], side="right") - 1
    size = np.diff(cut)
    pieces = np.bincount(of_token, minlength=n_tokens)
    if rule == "split":
        share = size / np.diff(token)[of_token]
        return np.bincount(of_section, share, n_sections), np.bincount(of_section[pieces[of_token] > 1], minlength=n_sections)
    order = np.lexsort((-size, of_token)) if rule == "majority" else np.arange(len(size))
    chosen = order[np.unique(of_token[order], return_index=True)[1]]
    to = of_section[chosen]
    return np.bincount(to, minlength=n_sections).astype(float), np.bincount(to[pieces > 1], minlength=n_sections)


def count_batch(doc_id: pa.Array, texts: list[str | None], encoder: Encoder, rule: str) -> Iterator[pa.RecordBatch]:
    for a, b in textscan.groups(texts, 1 << 21):
        own = [i for i in range(a, b) if texts[i] is not None]
        if not own:
            continue
        raw = [texts[i].encode("utf-8", "replace") for i in own]
        lengths = [encoder.lengths(texts[i]) if texts[i] else np.zeros(0, np.int64) for i in own]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.cumsum(size) - size
        token = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        lines = np.flatnonzero(data == 10) + 1
        doc_ends = begin + size
        lines = lines[~np.isin(lines, doc_ends)]
        section = np.sort(np.concatenate([begin, lines, [len(data)]]), kind="stable")
        tokens, crossing = attribute(token, section, rule)
        start = np.concatenate([begin, lines])
        doc = np.concatenate([np.arange(len(own)), np.searchsorted(begin, lines, side="right") - 1])
        order = np.lexsort((doc, start))
        doc = doc[order]
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first = np.searchsorted(doc, np.arange(len(own)))
        base = chars[begin][doc]
        yield pa.RecordBatch.from_arrays(
            [doc_id.take(pa.array(np.array(own)[doc])).cast(pa.int64()), pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)), pa.array(chars[section[:-1]] - base), pa.array(chars[section[1:]] - base), pa.array(tokens), pa.array(crossing.astype(np.int64))],
            names=["doc_id", "section", "char_start", "char_end", "tokens", "crossing"],
        )


def section_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, rule: str = "majority") -> DataFrame:
    """doc_id, section, char_start, char_end, tokens, crossing (how many of them reach over a border). The rank file is read once, on the driver, and broadcast: its size doesn't depend on the data."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(tokenizer, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(content.value)
        for batch in batches:
            yield from count_batch(batch.column(0), batch.column(1).to_pylist(), encoder, rule)

    return docs.select("doc_id", "text").mapInArrow(go, SCHEMA)
