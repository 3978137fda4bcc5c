"""Vectorised word scan: many texts to word positions and 64-bit word hashes in numpy.

A word is a maximal run of letters, digits and underscores after lower-casing. Every
non-ASCII character counts as a letter, but for the Latin-1 signs (U+0080-00BF), general
punctuation (U+2000-207F) and CJK punctuation (U+3000-303F). Hashes depend on a word's
UTF-8 bytes alone. Null texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_U = np.uint64
_M = 0x9E3779B97F4A7C15 | 1
_ISWORD = np.zeros(256, bool)
_ISWORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_VAL = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, BLOCK + 4096)
        _pow[:] = []
        for m in (_M, pow(_M, -1, 1 << 64)):
            a = np.full(size, m, np.uint64)
            a[0] = 1
            _pow.append(np.cumprod(a, dtype=np.uint64))
    return _pow[0], _pow[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _block(b: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, ends and hashes of the words of ``b``, whose first and last bytes are separators; hashes of their first characters."""
    w = _ISWORD[b]
    if len(hi := np.flatnonzero(b >= 0xC2)):
        lead, second = b[hi], b[np.minimum(hi + 1, len(b) - 1)]
        two = hi[lead == 0xC2]
        w[two] = w[np.minimum(two + 1, len(b) - 1)] = False
        three = hi[((lead == 0xE2) & (second <= 0x81)) | ((lead == 0xE3) & (second == 0x80))]
        for k in range(3):
            w[np.minimum(three + k, len(b) - 1)] = False
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(b))
    total = np.cumsum(_VAL[b] * power[: len(b)], dtype=np.uint64)
    before, shift = total[starts - 1], inverse[starts]
    heads = []
    if prefixes:
        lead = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
        number = np.searchsorted(lead, starts)
        heads = [mix((total[np.minimum(lead[np.minimum(number + k, len(lead) - 1)], ends) - 1] - before) * shift, k) for k in prefixes]
    return starts, ends, mix((total[ends - 1] - before) * shift), heads


@dataclass
class Words:
    """Words of some texts; ``bounds[i]:bounds[i+1]`` are those of text i, ``start`` counts bytes of its lower-cased text."""

    hash: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    heads: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def scan(texts: list[str | None], prefixes: tuple[int, ...] = ()) -> Words:
    """Words of the texts; ``heads`` has hashes of each word's first k characters (of the whole word if it is shorter) for the k in ``prefixes``."""
    raw = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=offsets[1:])
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    starts, ends, hashes, heads, at = [], [], [], [], 0
    while at < len(data) - 1:
        to = min(at + BLOCK, len(data) - 1)
        while to < len(data) - 1 and (_ISWORD[data[to]] or data[to] >= 0x80):
            to += 1
        s, e, h, first = _block(np.append(data[at : to + 1], np.uint8(10)) if _ISWORD[data[to]] else data[at : to + 1], prefixes)
        heads.append(first)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = to
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) - 1 if starts else empty
    end = np.concatenate(ends) - 1 if ends else empty
    bounds = np.searchsorted(start, offsets)
    base = np.repeat(offsets[:-1], np.diff(bounds))
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), bounds, start - base, end - base, {k: np.concatenate([x[i] for x in heads]) if heads else np.zeros(0, np.uint64) for i, k in enumerate(prefixes)})


def word_hashes(text: str) -> np.ndarray:
    return scan([text]).hash


def groups(texts: list[str | None], limit: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters, at least one text each: bounds memory, drops nothing. After the last, what they took goes back to the system."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
    give_back()


def give_back() -> None:
    """Memory that was freed but kept for reuse, to the system: a worker that waits for its next task shares a machine with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass
