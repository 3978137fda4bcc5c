"""Benchmark decontamination by latent semantic retrieval.

1. Vocabulary: the words of the benchmark. Every document is scanned once, whole, into the sequence of
   its words' numbers (0 for words outside), written to the shared folder; the same scan counts the
   passages, windows of ``WINDOW`` words every ``STRIDE``, that hold each word.
2. TF-IDF of passages: (1 + ln tf) x ln(1 + passages / df), rows of length 1. Every word
   that occurs has a positive weight, however frequent: the leaks themselves count in df, so a limit would hide an item copied often.
3. Randomised SVD: a Gaussian matrix W is sketched to A'(A W) in one distributed pass, and the
   Nystrom form of A'A gives the leading right singular vectors. The matrix is vocabulary x
   (``RANK`` + oversampling), so its size is bounded by the benchmark.
4. Search: every passage is compared with every item by cosine; from ``COSINE`` on the pair is a
   candidate. Nothing limits the number of candidates. Pairs that step 5 can't accept, since the words around the
   passage, taken as a set, don't reach ``PARAPHRASE``, are dropped first, so that only passages that may hold an item are projected; this changes no result.
   An item that stands in a document word for word is found without the latent space, whatever its length.
5. Checks: the longest common subsequence of the item and the words around the passage, weighted by
   idf, must cover ``COVERAGE`` of the item; from ``PARAPHRASE`` on it is enough that the item's
   answer (the rare words of its last sentence, or of its second half if it has one sentence) is
   covered by ``ANSWER`` too.

Defined results: null and wordless texts and items match nothing. A null doc_id is carried like others; repeated
rows give repeated pairs, made distinct. An empty corpus or benchmark gives an empty result. Other columns
are neither read nor changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import textscan
from quirelake.llm.neardup import without
from quirelake.session import materialize

WINDOW, STRIDE = 48, 24
RANK, EXTRA = 256, 16
COSINE = 0.3
COVERAGE, PARAPHRASE, ANSWER = 0.6, 0.4, 0.8
SEED = 5
BLOCK_CELLS = 1 << 24  # words x items of a block of items that is searched at once
COLUMNS, OWN = 512, 256  # of the words of a block of items; the most frequent have a column of their own, the others share the rest
HEAD = 4  # words by which verbatim places are looked up
HEAD_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
MAX_ITEM_WORDS = 20_000_000
SCHEMA = "doc_id long, item_id long, cosine double, coverage double, answer double, word_start long"


@dataclass
class Items:
    """The benchmark's vocabulary (sorted hashes, number k + 1 is word k) and its items as word numbers."""

    vocabulary: np.ndarray
    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    seen: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Items:
        rows = sorted({(i, t) for i, t in rows if i is not None and t})
        hashes = [textscan.word_hashes(t) for _, t in rows]
        vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        words = [np.searchsorted(vocabulary, h) + 1 for h in hashes]
        answers = []
        for (_, t), w in zip(rows, words):
            sentences = [s for s in re.split(r"[.!?]+\s+", t) if len(textscan.word_hashes(s))]
            n = len(textscan.word_hashes(sentences[-1])) if len(sentences) > 1 else (len(w) + 1) // 2
            answers.append(np.arange(len(w) - n, len(w)))
        seen = np.zeros(1 << 20, bool)
        seen[vocabulary >> np.uint64(44)] = True
        return cls(vocabulary, [i for i, _ in rows], words, answers, seen)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint32)
        if not len(self.vocabulary):
            return out
        at = np.flatnonzero(self.seen[h >> np.uint64(44)])
        k = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[k] == h[at]
        out[at[hit]] = k[hit] + 1
        return out


def passages(size: np.ndarray) -> np.ndarray:
    """Number of passages of documents of so many words."""
    return np.maximum(1, -(-size // STRIDE) - 1)


def incidence(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse passages of documents: passage, word (from 0), tf, sorted; and each document's first passage, with the end."""
    size = np.diff(bounds)
    n = passages(size)
    base = np.concatenate([[0], np.cumsum(n)])
    at = np.flatnonzero(words)
    doc = np.searchsorted(bounds, at, side="right") - 1
    j = (at - bounds[doc]) // STRIDE
    w = words[at].astype(np.int64) - 1
    key = np.concatenate([((base[doc] + j - back) << 32 | w)[(j - back >= 0) & (j - back < n[doc])] for back in (0, 1)])
    key, tf = np.unique(key, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf, base


def _encode(items_shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_shared.value
        kind = np.uint16 if len(items.vocabulary) < 65_535 else np.uint32
        df, total = np.zeros(len(items.vocabulary), np.int64), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in textscan.groups(texts):
                words = textscan.scan(texts[a:b])
                numbers = items.numbers(words.hash)
                _, word, _, base = incidence(numbers, words.bounds)
                df += np.bincount(word, minlength=len(df))
                total += int(base[-1])
                data = numbers.astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([data[s:e].tobytes() for s, e in zip(words.bounds[:-1], words.bounds[1:])], pa.binary()), pa.array(np.full(b - a, -1)), pa.array(np.zeros(b - a, bool))], names=["doc_id", "words", "passages", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([df.tobytes()], pa.binary()), pa.array([total]), pa.array([True])], names=["doc_id", "words", "passages", "counts"])

    return go


def _documents(batches: Iterator[pa.RecordBatch], kind: type, most: int = 1 << 19) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """ids, word numbers and bounds of some documents at a time."""
    for batch in batches:
        ids, data = batch.column(0).to_pylist(), [np.frombuffer(x.as_py(), kind) for x in batch.column(1)]
        a = n = 0
        for i in range(len(data) + 1):
            if i == len(data) or (n and n + len(data[i]) > most):
                if i > a:
                    yield ids[a:i], np.concatenate(data[a:i]), np.concatenate([[0], np.cumsum([len(x) for x in data[a:i]])])
                a, n = i, 0
            if i < len(data):
                n += len(data[i])
        textscan.give_back()


def _matrix(words: np.ndarray, bounds: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index and passage number), words and values of the passages that have a weight."""
    passage, word, tf, base = incidence(words, bounds)
    keep = idf[word] > 0
    passage, word = passage[keep], word[keep]
    value = ((1 + np.log(tf[keep])) * idf[word]).astype(np.float32)
    first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
    if len(first):
        norm = np.sqrt(np.add.reduceat(value * value, first))
        value /= np.repeat(norm, np.diff(np.r_[first, len(value)]))
    return first, passage, word, value


def _split(first: np.ndarray, word: np.ndarray, value: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' values of the ``common`` words as a dense matrix, and first, word and value of the others; ``common`` gives a word's column or -1."""
    column = common[word]
    row = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(word)]))
    dense = np.zeros((len(first), int(common.max(initial=-1)) + 1), np.float32)
    often = column >= 0
    dense[row[often], column[often]] = value[often]
    rest = np.r_[0, np.cumsum(np.bincount(row[~often], minlength=len(first)))]
    return dense, rest, word[~often], value[~often]


def _project(first: np.ndarray, word: np.ndarray, value: np.ndarray, basis: np.ndarray, common: np.ndarray, most: int = 1 << 10) -> np.ndarray:
    """The rows' products with the basis: common words, which make most entries, by a dense product, the t-th of the other entries of all rows at once, rows with more entries first. ``most`` rows at a time, so few that what they add up stays in the processor's cache."""
    out = np.zeros((len(first), basis.shape[1]), np.float32)
    ends = np.r_[first, len(word)]
    often = basis[np.argsort(common, kind="stable")[len(common) - int(common.max(initial=-1)) - 1 :]]
    for a in range(0, len(first), most):
        s, e = ends[a], ends[min(a + most, len(first))]
        dense, rest, w, v = _split(first[a : a + most] - s, word[s:e], value[s:e], common)
        count = np.diff(rest)
        order = np.argsort(-count, kind="stable")
        begin, falling = rest[:-1][order], -count[order]
        part = np.zeros((len(count), basis.shape[1]), np.float32)
        for t in range(int(count.max(initial=0))):
            m = int(np.searchsorted(falling, -t))
            at = begin[:m] + t
            part[:m] += basis[w[at]] * v[at, None]
        out[a + order] = part
        if dense.shape[1]:
            out[a : a + len(count)] += dense @ often
    return out


def common_words(df: np.ndarray, most: int = 512) -> np.ndarray:
    """The column of each of the most frequent words, -1 for the others: which of two ways adds up a word's entries."""
    out = np.full(len(df), -1)
    top = np.sort(np.argsort(-df, kind="stable")[:most])
    out[top] = np.arange(len(top))
    return out


def _sketch(shared, kind: type):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, omega, common = shared.value
        total = np.zeros(omega.shape)
        columns = np.flatnonzero(common >= 0)
        for _, words, bounds in _documents(batches, kind):
            first, _, word, value = _matrix(words, bounds, idf)
            if not len(first):
                continue
            y = _project(first, word, value, omega, common)
            step = 1 << 14
            ends = np.r_[first, len(word)]
            for a in range(0, len(first), step):
                s, e = ends[a], ends[min(a + step, len(first))]
                dense, rest, w, v = _split(first[a : a + step] - s, word[s:e], value[s:e], common)
                near = y[a : a + step]
                total[columns] += dense.T @ near
                row = np.repeat(np.arange(len(near)), np.diff(rest))
                order = np.argsort(w, kind="stable")
                own = w[order]
                start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
                row, weight = row[order], v[order]
                for x, i, j in zip(own[start].tolist(), start.tolist(), [*start[1:].tolist(), len(own)]):
                    total[x] += weight[i:j] @ near[row[i:j]]
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in total[at].astype(np.float32)], pa.binary())], names=["word", "row"])

    return go


def _sum_rows(t: pa.Table) -> pa.Table:
    word = t.column("word").to_numpy()
    rows = np.stack([np.frombuffer(x.as_py(), np.float32) for x in t.column("row")]).astype(np.float64)
    # summed in an order that doesn't depend on which task came first
    order = np.lexsort((*rows.T[:4], word))
    word, rows = word[order], rows[order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    return pa.table({"word": pa.array(word[first]), "row": pa.array([r.tobytes() for r in np.add.reduceat(rows, first, axis=0)], pa.binary())})


def right_singular_vectors(sketch: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of the positive matrix C from C omega, by the stabilised Nystrom method."""
    shift = np.finfo(float).eps * np.linalg.norm(sketch) * 10 + 1e-12
    y = sketch + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-12
    b = y @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    keep = s[:rank] > s[0] * 1e-9
    return u[:, :rank][:, keep]


def _head(words: list[np.ndarray]) -> np.ndarray:
    """A hash of the words at each place; ``words`` holds the first of all places, then the second."""
    return np.add.reduce([w.astype(np.uint64) * f for w, f in zip(words, HEAD_FACTORS)])


@dataclass
class Index:
    items: Items
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    usable: np.ndarray
    common: np.ndarray
    weights: list[np.ndarray] | None = None
    shares: np.ndarray | None = None
    since: int = -1

    def match(self, ids: list, words: np.ndarray, bounds: np.ndarray, cosine: float, coverage: float, paraphrase: float, answer: float) -> Iterator[tuple]:
        if self.weights is None:
            self.prepare()
        n = passages(np.diff(bounds))
        base = np.concatenate([[0], np.cumsum(n)])
        best: dict[tuple[int, int], tuple] = {}
        wide = max(1, BLOCK_CELLS // max(1, len(self.idf)))
        for since in range(0, len(self.items.words), wide):
            self.block(since, wide)
            for number, item in self.possible(words, bounds, base, paraphrase - 1e-5):
                near = self.cosines(words, bounds, base, number, item)
                able = np.flatnonzero(near >= cosine)
                number, item, near = number[able], item[able], near[able]
                d = np.searchsorted(base, number, side="right") - 1
                start = (number - base[d]) * STRIDE
                more = self.sizes[item]
                begin, end = bounds[d] + np.maximum(0, start - more), np.minimum(bounds[d] + start + WINDOW + more, bounds[d + 1])
                fit = np.flatnonzero(self.covers(item, words, begin, end, paraphrase) >= paraphrase - 1e-9)
                for k, c, d, a, b, start in zip(item[fit].tolist(), near[fit].tolist(), d[fit].tolist(), begin[fit].tolist(), end[fit].tolist(), start[fit].tolist()):
                    cover, hit = self.coverage(k, words[a:b])
                    if cover < paraphrase or cover < coverage and hit < answer:
                        continue
                    found = (cover, hit, c, -start)
                    if found > best.get((d, k), (-1.0,)):
                        best[d, k] = found
        whole: dict[tuple[int, int], int] = {}
        for d, k, place in self.verbatim(words, bounds):
            if best.get((d, k), (0.0,))[0] < 1 - 1e-9:
                whole.setdefault((d, k), min(place // STRIDE, int(n[d]) - 1))
        if whole:
            d, k = np.array(list(whole)).T
            near = self.cosines(words, bounds, base, base[d] + np.array(list(whole.values())), k)
            for (at, j), c in zip(whole.items(), np.where(np.isfinite(near), near, 0.0).tolist()):
                best[at] = (1.0, 1.0, c, -j * STRIDE)
        for (d, k), (cover, hit, c, start) in sorted(best.items()):
            yield ids[d], self.items.ids[k], c, cover, hit, -start

    def block(self, since: int, wide: int) -> None:
        """Of the items from ``since`` on: the share of weight that each word has, and each column of words, by how far around a passage the item's words are looked for."""
        if self.since == since:
            return
        words = self.items.words[since : since + wide]
        self.shares = np.zeros((len(self.idf), len(words)), np.float32)
        for k, item in enumerate(words):
            np.add.at(self.shares[:, k], item - 1, self.weights[since + k] / self.whole[since + k])
        self.since = since
        own = np.flatnonzero(self.shares.any(axis=1))
        own = own[np.argsort(np.where(self.idf[own] > 0, self.idf[own], np.inf), kind="stable")]
        at = np.arange(len(own))
        self.column = np.full(len(self.idf) + 1, -1, np.int16)
        self.column[own + 1] = np.where(at < OWN, at, OWN + at % (COLUMNS - OWN))
        loads = np.zeros((COLUMNS, len(words)), np.float32)
        np.add.at(loads, self.column[own + 1], self.shares[own])
        mine = self.usable[slice(*np.searchsorted(self.usable, [since, since + wide]))]
        steps = np.maximum(1, -(-self.sizes[mine] // STRIDE))
        # far reaches are rounded up, so that there are few
        steps = np.where(steps > 4, 1 << np.ceil(np.log2(steps)).astype(np.int64), steps)
        self.reaches = [(int(r), mine[steps == r], np.ascontiguousarray(loads[:, mine[steps == r] - since])) for r in np.unique(steps)]

    def possible(self, words: np.ndarray, bounds: np.ndarray, base: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Passages and items of the block, some at a time, but for pairs whose coverage is below ``least`` since the columns of the words around hold less of the item."""
        size = np.diff(bounds)
        count = np.diff(base)
        # cells of STRIDE words; a passage is its own cell and the next
        since = base + np.arange(len(base))
        first, last = np.repeat(since[:-1], count + 1), np.repeat(since[1:] - 1, count + 1)
        cell = np.repeat(np.arange(len(first)), np.clip(np.repeat(size, count + 1) - (np.arange(len(first)) - first) * STRIDE, 0, STRIDE))
        column = self.column[words]
        at = np.flatnonzero(column >= 0)
        cell, column = cell[at], column[at]
        bits = np.zeros((len(first), COLUMNS // 64), np.uint64)
        step = 1 << 14
        for x in range(0, len(first), step):
            part = slice(*np.searchsorted(cell, [x, x + step]))
            held = np.zeros((min(step, len(first) - x), COLUMNS), np.uint8)
            held[cell[part] - x, column[part]] = 1
            bits[x : x + step] = np.packbits(held, axis=1).view(np.uint64)
        # levels[k] holds the columns of 2^k cells from each on, up to the document's end
        levels = [bits]
        own = np.arange(int(base[-1])) + np.repeat(np.arange(len(count)), count)
        for reach, items, loads in self.reaches:
            k = int(np.ceil(np.log2(2 * reach + 2))) - 1
            while len(levels) <= k:
                levels.append(levels[-1] | levels[-1][np.minimum(np.arange(len(first)) + (1 << len(levels) - 1), last)])
            low, high = np.maximum(own - reach, first[own]), np.minimum(own + reach + 1, last[own])
            around = levels[k][low] | levels[k][np.maximum(high - (1 << k) + 1, first[own])]
            step = max(64, min(1 << 11, (1 << 21) // len(items)))
            for x in range(0, len(own), step):
                share = np.unpackbits(around[x : x + step].view(np.uint8), axis=1).astype(np.float32) @ loads
                found = np.flatnonzero(share >= least)
                if len(found):
                    row, which = np.divmod(found, len(items))
                    yield row + x, items[which]

    def cosines(self, words: np.ndarray, bounds: np.ndarray, base: np.ndarray, number: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Cosine of each passage and item in the latent space; minus infinity for a passage without weight, 0 for an item without."""
        if not len(self.usable):
            return np.zeros(len(item))
        own, pair = np.unique(number, return_inverse=True)
        d = np.searchsorted(base, own, side="right") - 1
        begin = bounds[d] + (own - base[d]) * STRIDE
        size = np.minimum(WINDOW, bounds[d + 1] - begin)
        ends = np.r_[0, np.cumsum(size)]
        first, passage, word, value = _matrix(words[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)], ends, self.idf)
        z = np.zeros((len(own), self.basis.shape[1]), np.float32)
        z[passage[first]] = _project(first, word, value, self.basis, self.common)
        z /= np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
        has = np.zeros(len(own), bool)
        has[passage[first]] = True
        at = np.minimum(np.searchsorted(self.usable, item), len(self.usable) - 1)
        near = np.einsum("ij,ij->i", z[pair], self.vectors[at]) * (self.usable[at] == item)
        return np.where(has[pair], near, -np.inf)

    def verbatim(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Document, item and the item's first word in the document, for each place where an item stands word for word."""
        padded = np.concatenate([words, np.zeros(HEAD, words.dtype)])
        places = np.flatnonzero(self.begins[words])
        for size, (heads, items) in self.heads.items():
            key = _head([padded[places + j] for j in range(size)])
            low, high = np.searchsorted(heads, key), np.searchsorted(heads, key, side="right")
            for i in np.flatnonzero(high > low).tolist():
                place = int(places[i])
                d = int(np.searchsorted(bounds, place, side="right")) - 1
                for k in items[low[i] : high[i]].tolist():
                    item = self.items.words[k]
                    if place + len(item) <= bounds[d + 1] and np.array_equal(words[place : place + len(item)], item):
                        yield d, k, place - int(bounds[d])

    def prepare(self) -> None:
        """Of each item: number of words and their weights; and the tables of verbatim places."""
        size = len(self.idf)
        self.sizes = np.array([len(w) for w in self.items.words], np.int64)
        self.wide = -(-self.sizes // WINDOW) * 2
        self.weights = [self.weight(w) for w in self.items.words]
        self.whole = np.array([w.sum() or 1.0 for w in self.weights])
        self.never = np.array([w[self.idf[item - 1] <= 0].sum() for w, item in zip(self.weights, self.items.words)]) / self.whole
        self.begins = np.zeros(size + 1, bool)
        by_size: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items.words):
            if len(item):
                self.begins[item[0]] = True
                head = min(HEAD, len(item))
                by_size.setdefault(head, []).append((int(_head(list(item[:head, None]))[0]), k))
        self.heads = {n: (np.array([h for h, _ in sorted(found)], np.uint64), np.array([k for _, k in sorted(found)])) for n, found in by_size.items()}

    def bound(self, row: np.ndarray, item: np.ndarray, number: np.ndarray, of: np.ndarray, base: np.ndarray, row_of: np.ndarray, held: np.ndarray, low: int) -> np.ndarray:
        """At least the coverage of each pair: words of the passages around, whatever their order and number; looser than ``possible``, which the search uses. ``held`` has the share of each item whose words a passage holds, from row ``low`` on."""
        total = self.never[item].copy()
        reach = int(self.wide[item].max(initial=0))
        wide, own, begin, end = self.wide[item], number[row], base[of[row]], base[of[row] + 1]
        for offset in range(-reach, reach + 1, 2):
            # the first and last passages of a document may begin within the reach without lying a whole step off
            at = np.clip(own + offset, begin, end - 1)
            pair = np.flatnonzero((abs(offset) <= wide) & ((offset == 0) | (at != own)))
            r = row_of[at[pair]]
            pair, r = pair[r >= 0], r[r >= 0]
            total[pair] += held[r - low, item[pair] - self.since]
        return total

    def covers(self, item: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray, least: float, most: int = 1 << 21) -> np.ndarray:
        """The coverage of each item in words[begin:end], all pairs of a step at once; 0 where the words' numbers alone keep it below ``least``."""
        out = np.zeros(len(item))
        runs = np.cumsum(end - begin) // most
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(runs)) + 1) if len(item) else []:
            size = (end - begin)[part]
            pair = np.repeat(np.arange(len(part)), size)
            text = words[np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[part], size)].astype(np.int64)
            # only the item's own words can match
            own = np.flatnonzero(text)
            own = own[self.shares[text[own] - 1, item[part][pair[own]] - self.since] > 0]
            pair, text = pair[own], text[own]
            key, first, count = np.unique(pair * (len(self.idf) + 1) + text, return_index=True, return_counts=True)
            which, number = pair[first], text[first]
            share, one = self.shares[number - 1, item[part][which] - self.since], self.weight(number) / self.whole[item[part][which]]
            fit = np.flatnonzero(np.bincount(which, np.minimum(share, count * one), len(part)) >= least - 1e-5)
            count = np.bincount(pair, minlength=len(part))
            start = np.cumsum(count) - count
            fit = fit[np.argsort(self.sizes[item[part][fit]] * 4096 + count[fit], kind="stable")]
            most_pairs = max(1, (1 << 17) // max(1, int((self.sizes[item[part][fit]] + count[fit]).max(initial=1))))
            for x in range(0, len(fit), most_pairs):
                some = fit[x : x + most_pairs]
                out[part[some]] = self._common(item[part][some], text, start[some], count[some])
        return out

    def _common(self, item: np.ndarray, text: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Weighted share of each item in a heaviest common subsequence with text[start : start + count]."""
        place = np.arange(int(count.max(initial=0)))
        held = place < count[:, None]
        texts = np.where(held, text[np.minimum(start[:, None] + place, len(text) - 1)], 0)
        best = np.zeros((len(item), len(place) + 1))
        rows = int(self.sizes[item].max(initial=0))
        wanted, weight = np.full((len(item), rows), -1), np.zeros((len(item), rows))
        for k in np.unique(item).tolist():
            mine = item == k
            wanted[mine, : self.sizes[k]], weight[mine, : self.sizes[k]] = self.items.words[k], self.weights[k]
        for i in range(rows):
            take = np.where(texts == wanted[:, i, None], best[:, :-1] + weight[:, i, None], 0)
            np.maximum(take, best[:, 1:], out=take)
            np.maximum.accumulate(take, axis=1, out=best[:, 1:])
        return best[:, -1] / self.whole[item]

    def coverage(self, k: int, text: np.ndarray) -> tuple[float, float]:
        """Weighted share of the item, and of its answer, in a heaviest common subsequence."""
        item = self.items.words[k]
        text = text[text > 0]
        weight = self.weight(item)
        m, n = len(item), len(text)
        best = np.zeros((m + 1, n + 1))
        for i in range(m):
            take = np.where(text == item[i], best[i, :-1] + weight[i], best[i, 1:])
            np.maximum.accumulate(np.maximum(take, best[i, 1:]), out=best[i + 1, 1:])
        i, j, matched = m, n, np.zeros(m, bool)
        while i and j:
            if best[i, j] == best[i, j - 1]:
                j -= 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                matched[i] = True
        answer = self.items.answers[k]
        total = weight[answer].sum()
        return float(best[m, n] / weight.sum()), float((weight * matched)[answer].sum() / total) if total else 0.0

    def weight(self, item: np.ndarray) -> np.ndarray:
        """Stop words count a little, so that order matters for them too."""
        return np.where(self.idf[item - 1] > 0, self.idf[item - 1], 0.25)


def build(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> tuple[Index, DataFrame]:
    """The index of the benchmark in the corpus's latent space, and the encoded documents."""
    spark = docs.sparkSession
    words = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    if words > MAX_ITEM_WORDS * 6:
        raise ValueError("the benchmark is too large to be broadcast; split it and join the results")
    items = Items.of([tuple(r) for r in benchmark.select("item_id", "text").collect()])
    shared = spark.sparkContext.broadcast(items)
    size = len(items.vocabulary)
    kind = np.uint16 if size < 65_535 else np.uint32
    encoded = materialize(docs.select("doc_id", "text").where("text is not null").mapInArrow(_encode(shared), "doc_id long, words binary, passages long, counts boolean"), "encoded")
    df, total = np.zeros(size, np.int64), 0
    for r in encoded.where("counts").select("words", "passages").toLocalIterator():  # a row for each task
        df += np.frombuffer(r["words"], np.int64)
        total += r["passages"]
    encoded = encoded.where("not counts").select("doc_id", "words")
    idf = np.where(df > 0, np.log1p(max(1, total) / np.maximum(df, 1)), 0.0)
    omega = np.random.default_rng(SEED).standard_normal((size, min(size, rank + EXTRA)))
    common = common_words(df)
    pair = spark.sparkContext.broadcast((idf, omega.astype(np.float32), common))
    sketch = np.zeros(omega.shape)
    if size and idf.any():
        rows = encoded.select("doc_id", "words").mapInArrow(_sketch(pair, kind), "word int, row binary")
        summed = rows.groupBy(F.pmod("word", F.lit(16)).alias("part")).applyInArrow(lambda t: _sum_rows(t), "word int, row binary").toArrow()
        for w, r in zip(summed.column("word").to_pylist(), summed.column("row")):
            sketch[w] = np.frombuffer(r.as_py(), np.float64)
    basis = right_singular_vectors(sketch, omega, rank) if sketch.any() else np.zeros((size, 1))
    basis = basis.astype(np.float32)
    vectors, usable = [], []
    for k, w in enumerate(items.words):
        word, tf = np.unique(w - 1, return_counts=True)
        v = ((1 + np.log(tf)) * idf[word]) @ basis[word]
        if (norm := np.linalg.norm(v)) > 1e-9:
            vectors.append(v / norm)
            usable.append(k)
    return Index(items, idf, basis, np.array(vectors, np.float32).reshape(len(usable), basis.shape[1]), np.array(usable, np.int64), common), encoded


def contamination(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, coverage: float = COVERAGE, paraphrase: float = PARAPHRASE, answer: float = ANSWER, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, cosine, coverage, answer, word_start: the best passage of each document for each item it holds."""
    index, encoded = build(docs, benchmark, rank)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = np.uint16 if len(index.items.vocabulary) < 65_535 else np.uint32

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, bounds in _documents(batches, kind):
            rows = list(shared.value.match(ids, words, bounds, cosine, coverage, paraphrase, answer))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], names=["doc_id", "item_id", "cosine", "coverage", "answer", "word_start"])

    return encoded.mapInArrow(go, SCHEMA).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """``docs`` without the documents that hold an item; the columns stay as they are. Rows with a null doc_id stay."""
    found = contamination(docs, benchmark, **options).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(without(found), "doc_id", "left_anti").select(docs.columns)
