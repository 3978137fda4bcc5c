"""Near-duplicate groups by SimHash fingerprints and vantage-point trees.

Fingerprint: 128 bits; each distinct word of a document votes on every bit with its hash.
Two documents are near copies if their fingerprints differ in at most ``radius`` bits and the
shorter has at least RATIO times the words of the longer.

Search: the fingerprint is cut into 8 blocks of 16 bits. By the pigeonhole principle two
fingerprints within ``radius`` lie within ``radius // 8`` in at least one block, so the pairs
are searched in the metric space of each block, where that small radius lets a vantage-point
tree prune. The trees are built from exact block histograms of all fingerprints. Every
fingerprint goes to the leaf shard holding it and visits each shard across whose boundary the
triangle inequality can't exclude a partner. Shards are also cut by number of words, into bands
so wide that partners within RATIO lie in one band or in neighbours. Within a shard each block value
is looked up with all values within ``radius // 8`` and the sizes near its own; a pair at home in one shard is
compared once there. Pairs found are checked on all 128 bits: the search is exact.
Shards return spanning forests, and star contraction joins them to groups, so groups of thousands
of copies cost no quadratic output.

Defined results: a null doc_id or null text is in no group. A text without words has a
fingerprint of its own characters, so only its exact copies match. Rows repeating a doc_id are one
document, with the smallest of their fingerprints. An empty table gives an empty result.
Columns other than doc_id and text are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import textscan
from quirelake.session import materialize

BLOCKS = 8
RADIUS = 23
RATIO = 0.8
SHARD_ROWS = 32_768
BAND_ROWS = 65_536
MIN_DEPTH = 3
HOME, UPPER = 1, 2
ROW = np.dtype([("doc_id", "<i8"), ("hi", "<u8"), ("lo", "<u8"), ("size", "<i4"), ("role", "u1")])
_U = np.uint64
_LANES = [(word, 16 * k) for word in (0, 1) for k in range(4)]


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two arrays of 64 bits and the number of words of each text; texts without words get a hash of the raw text."""
    hi, lo, size = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int32)
    for a, b in textscan.groups(texts):
        words = textscan.scan(texts[a:b])
        size[a:b] = np.diff(words.bounds)
        key = np.unique((words.doc.astype(np.uint64) << _U(42)) | (words.hash >> _U(22)))
        doc, h = (key >> _U(42)).astype(np.int64), key & _U((1 << 42) - 1)
        edges = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            s, e = edges[i], edges[i + 1]
            if s == e:
                d = xxhash.xxh3_128_intdigest((texts[a + i] or "").encode("utf-8", "replace"), seed=7)
                hi[a + i], lo[a + i] = d >> 64, d & 0xFFFFFFFFFFFFFFFF
                continue
            votes = np.zeros(128, np.int64)
            for x in range(s, e, 65_536):
                part = h[x : min(e, x + 65_536)]
                two = np.stack([textscan.mix(part, 1), textscan.mix(part, 2)], axis=1).astype(">u8")
                votes += np.unpackbits(two.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
            bits = np.packbits(2 * votes > e - s).view(">u8")
            hi[a + i], lo[a + i] = bits[0], bits[1]
    return hi, lo, size


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hi, lo, size = fingerprints(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(size)], names=["doc_id", "hi", "lo", "size"])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, hi, lo, size: one row for each doc_id."""
    got = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(_fingerprint_batches, "doc_id long, hi long, lo long, size int")
    return got.groupBy("doc_id").agg(F.min(F.struct("hi", "lo", "size")).alias("fp")).select("doc_id", "fp.hi", "fp.lo", "fp.size")


def _block_values(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    return [(((hi, lo)[w] >> _U(s)) & _U(0xFFFF)).astype(np.uint16) for w, s in _LANES]


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BLOCKS << 16, np.int64)
    for batch in batches:
        hi, lo = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        for k, v in enumerate(_block_values(hi, lo)):
            counts[k << 16 : (k + 1) << 16] += np.bincount(v, minlength=1 << 16)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["at", "n"])


def _distance(v: int, values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint16(v)).astype(np.int16)


def _split(values: np.ndarray, weights: np.ndarray) -> tuple[int, int]:
    """A vantage point, the most frequent value, and the distance that halves the weights best."""
    v = int(values[np.argmax(weights)])
    by = np.cumsum(np.bincount(_distance(v, values), weights=weights, minlength=17))
    return v, int(np.argmin(np.abs(by[:16] - by[-1] / 2)))


class Tree:
    """The top of a vantage-point tree over the 65,536 values of a block: for each value its leaf and the leaves it visits."""

    def __init__(self, counts: np.ndarray, depth: int, radius: int) -> None:
        domain = np.arange(1 << 16, dtype=np.uint16)
        self.leaves = 0
        rows: list[tuple[np.ndarray, int, bool]] = []

        def grow(home: np.ndarray, visit: np.ndarray, level: int) -> None:
            weights = counts[home] + 1e-6
            if level == depth or len(home) < 2:
                rows.append((home, self.leaves, True))
                rows.append((visit, self.leaves, False))
                self.leaves += 1
                return
            v, m = _split(home, weights)
            dh, dv = _distance(v, home), _distance(v, visit)
            cross = home[(dh <= m) & (dh > m - radius)]
            grow(home[dh <= m], visit[dv <= m + radius], level + 1)
            grow(home[dh > m], np.concatenate([visit[dv > m - radius], cross]), level + 1)

        grow(domain, domain[:0], 0)
        value = np.concatenate([r[0] for r in rows])
        leaf = np.concatenate([np.full(len(r[0]), r[1], np.int32) for r in rows])
        home = np.concatenate([np.full(len(r[0]), r[2]) for r in rows])
        order = np.argsort(value, kind="stable")
        self.leaf, self.home = leaf[order], home[order]
        self.offsets = np.searchsorted(value[order], np.arange((1 << 16) + 1))


def _expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges start..start+count: the range's number and the element, for all elements."""
    which = np.repeat(np.arange(len(start)), count)
    first = np.cumsum(count) - count
    return which, np.arange(len(which)) - first[which] + start[which]


def size_bands(levels: list[tuple[int, int]], band_rows: int) -> np.ndarray:
    """The smallest size of each band but the first, from the smallest size and the number of fingerprints of each level. A band has about ``band_rows`` or more, and is so wide that only neighbouring bands hold sizes within RATIO."""
    edges: list[int] = []
    held = 0
    for size, n in sorted(levels):
        if held >= band_rows and (not edges or size * RATIO >= edges[-1]):
            edges.append(size)
            held = 0
        held += n
    return np.array(edges, np.int64)


def _shards(trees: list[Tree], edges: np.ndarray):
    """The shards of fingerprints: of each block the home leaf and those visited, once as the lower of two neighbouring bands, once as the upper."""
    base = np.cumsum([0] + [t.leaves for t in trees])

    def route(doc: np.ndarray, hi: np.ndarray, lo: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        band = np.searchsorted(edges, size, side="right")
        for k, v in enumerate(_block_values(hi, lo)):
            t = trees[k]
            which, at = _expand(t.offsets[v], t.offsets[v.astype(np.int64) + 1] - t.offsets[v])
            below = np.flatnonzero(band[which] > 0)
            shard = np.concatenate([band[which], band[which[below]] - 1]) * int(base[-1]) + np.concatenate([t.leaf[at], t.leaf[at[below]]]) + int(base[k])
            role = np.concatenate([t.home[at] * HOME, t.home[at[below]] * HOME + UPPER]).astype(np.uint8)
            order = np.argsort(shard, kind="stable")
            shard, which = shard[order], np.concatenate([which, which[below]])[order]
            rows = np.empty(len(order), ROW)
            for name, column in (("doc_id", doc), ("hi", hi), ("lo", lo), ("size", size)):
                rows[name] = column[which]
            rows["role"] = role[order]
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
                yield int(shard[i]), k, rows[i:j].tobytes()

    return route


def _route(trees: list[Tree], edges: np.ndarray, at_once: int = 1 << 15):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = _shards(trees, edges)

        def sent(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4)]
            out: list[tuple[int, int, bytes]] = []
            bytes_held = 0
            for row in route(columns[0], columns[1].view(np.uint64), columns[2].view(np.uint64), columns[3]):
                out.append(row)
                bytes_held += len(row[2])
                if bytes_held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["shard", "block", "rows"])
                    out, bytes_held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["shard", "block", "rows"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= at_once:
                yield from sent(held)
                held = []
        if any(b.num_rows for b in held):
            yield from sent(held)

    return go


def _cuts(work: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges whose work adds up to about ``most``, or one element."""
    if not len(work):
        return []
    total = np.cumsum(work)
    edges = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(most, total[-1], most)), [len(work)]]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _components(n: int, edges: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each node's component."""
    label = np.arange(n)
    for i, j in edges:
        while True:
            a, b = label[i], label[j]
            if not len(bad := np.flatnonzero(a != b)):
                break
            i, j, a, b = i[bad], j[bad], a[bad], b[bad]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _close(block: int, own: np.ndarray, others: np.ndarray, hi: np.ndarray, lo: np.ndarray, size: np.ndarray, radius: int, higher: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, one of ``own`` and one of ``others``, whose values of the block are within radius // BLOCKS: each value with the ball of values around it, and of those the classes of sizes near its own. With ``higher``, others of lower values are left out."""
    if not len(own) or not len(others):
        return
    w, s = _LANES[block]
    here, there = (hi, lo)[w], (hi, lo)[1 - w]
    value = ((here >> _U(s)) & _U(0xFFFF)).astype(np.int32)
    # classes of sizes, about as many others in each; those of a value lie in a row
    bits = min(4, (len(others) // 4096).bit_length())
    limits = np.quantile(size[others], np.arange(1, 1 << bits) / (1 << bits), method="lower")
    key = value[others] << bits | np.searchsorted(limits, size[others], side="right").astype(np.int32)
    others = others[np.argsort(key, kind="stable")]
    begin = np.zeros((1 << 16 + bits) + 1, np.int32)
    np.cumsum(np.bincount(key, minlength=1 << 16 + bits), out=begin[1:])
    end = begin[1:]
    own = own[np.argsort(value[own], kind="stable")]
    v, left, right = value[own] << bits, there[own], there[others]
    least = v | np.searchsorted(limits, np.floor(size[own] * RATIO), side="right").astype(np.int32)
    most = v | np.searchsorted(limits, np.ceil(size[own] / RATIO) + 1, side="right").astype(np.int32)
    every = np.arange(1 << 16, dtype=np.int32)
    ball = every[np.bitwise_count(every) <= radius // BLOCKS]
    ramp = np.zeros(0, np.int64)
    for top in range(17):
        # masks by their highest bit: they lead upward from the values that don't have it
        masks = (ball[(ball >> top == 0) & (ball << 1 >> top > 0)] if top else ball[:1]) << bits
        starts = np.flatnonzero(v >> bits << 1 >> top & 1 == 0) if top and higher else np.arange(len(own))
        for x in range(0, len(starts), 1 << 13):
            some = starts[x : x + (1 << 13)]
            wide = max(1, (1 << 16) // len(some))
            for m in range(0, len(masks), wide):
                first = begin[least[some] ^ masks[m : m + wide, None]].ravel()
                count = end[most[some] ^ masks[m : m + wide, None]].ravel() - first
                at = np.flatnonzero(count)
                first, count, home = first[at].astype(np.int64), count[at].astype(np.int64), some[at % len(some)]
                half = left[home]
                for p, q in _cuts(count, 1 << 15):
                    n = count[p:q]
                    ends = np.cumsum(n)
                    if ends[-1] > len(ramp):
                        ramp = np.arange(int(ends[-1]))
                    place = np.repeat(first[p:q] - ends + n, n)
                    place += ramp[: len(place)]
                    # half of the bits decides about nearly all
                    far = np.repeat(half[p:q], n)
                    far ^= right[place]
                    near = np.flatnonzero(np.bitwise_count(far) <= radius)
                    i, j = own[home[p:q][np.searchsorted(ends, near, side="right")]], others[place[near]]
                    fit = np.bitwise_count(hi[i] ^ hi[j]).astype(np.int16) + np.bitwise_count(lo[i] ^ lo[j]) <= radius
                    fit &= np.minimum(size[i], size[j]) >= RATIO * np.maximum(size[i], size[j])
                    fit &= i != j
                    if fit.any():
                        yield i[fit], j[fit]


def shard_pairs(block: int, home: np.ndarray, hi: np.ndarray, lo: np.ndarray, size: np.ndarray, radius: int, upper: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius of a shard, each at least once. Two of ``upper``, the upper of two bands, are left to the shard where they are the lower."""
    upper = np.zeros(len(home), bool) if upper is None else upper
    lower_home = home & ~upper
    yield from _close(block, np.flatnonzero(lower_home), np.flatnonzero(lower_home), hi, lo, size, radius, higher=True)
    yield from _close(block, np.flatnonzero(lower_home), np.flatnonzero(~lower_home), hi, lo, size, radius)
    yield from _close(block, np.flatnonzero(home & upper), np.flatnonzero(~home & ~upper), hi, lo, size, radius)


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, about ``most`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pair in pairs:
        held.append(pair)
        if sum(len(i) for i, _ in held) >= most:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _shard(radius: int):
    def go(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(x.as_py() for x in t.column("rows")), ROW)
        rows = rows[np.argsort(rows["doc_id"], kind="stable")]
        doc, hi, lo, size = (np.ascontiguousarray(rows[c]) for c in ("doc_id", "hi", "lo", "size"))
        pairs = shard_pairs(t.column("block")[0].as_py(), rows["role"] & HOME > 0, hi, lo, size, radius, rows["role"] & UPPER > 0)
        label = _components(len(doc), _gathered(pairs))
        at = np.flatnonzero(label != np.arange(len(doc)))
        return pa.table({"u": pa.array(doc[at]), "v": pa.array(doc[label[at]])})

    return go


def connected(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to (node, root), root the smallest node of the component, by alternating large and small stars."""
    edges = materialize(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v u", "m v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("explode(array(struct(v a, m b), struct(u a, m b))) e").selectExpr("e.a u", "e.b v").where("u <> v").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.selectExpr("u node", "v root")
        state = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, group_id (the group's smallest doc_id), group_size: documents in groups of two or more."""
    prints = materialize(fingerprint_table(docs), "prints")
    reps = materialize(prints.groupBy("hi", "lo", "size").agg(F.min("doc_id").alias("doc_id")), "reps").select("doc_id", "hi", "lo", "size")
    counts = np.zeros(BLOCKS << 16, np.int64)
    for at, n in reps.select("hi", "lo").mapInArrow(_histogram, "at int, n long").groupBy("at").agg(F.sum("n")).toPandas().itertuples(index=False):
        counts[at] = n
    levels = [tuple(r) for r in reps.groupBy(F.floor(F.log2(F.col("size") + 1) * 16).alias("level")).agg(F.min("size"), F.count("*")).select("min(size)", "count(1)").collect()]
    edges = size_bands(levels, band_rows)
    band = np.bincount([int(np.searchsorted(edges, s, side="right")) for s, _ in levels], [n for _, n in levels], 1)
    depth = max(MIN_DEPTH, int(np.ceil(np.log2(max(1, band.max()) / shard_rows))))
    trees = [Tree(counts[k << 16 : (k + 1) << 16], depth, radius // BLOCKS) for k in range(BLOCKS)]
    routed = reps.mapInArrow(_route(trees, edges), "shard int, block int, rows binary")
    edges = routed.groupBy("shard").applyInArrow(_shard(radius), "u long, v long")
    roots = connected(edges)
    heads = reps.join(roots, reps.doc_id == roots.node, "left").select("hi", "lo", "size", F.coalesce("root", "doc_id").alias("group_id"))
    member = prints.join(heads, ["hi", "lo", "size"]).select("doc_id", "group_id")
    sizes = member.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return member.join(sizes, "group_id").select("doc_id", "group_id", "group_size")


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each near-duplicate group.

    Columns stay as they are. Rows with a null doc_id or null text stay. Of rows repeating a
    doc_id, one stays.
    """
    gone = near_duplicates(docs, radius).where("doc_id <> group_id").select("doc_id")
    kept = docs.join(without(gone), "doc_id", "left_anti").select(docs.columns)
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not repeated.head(1):
        return kept
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def without(ids: DataFrame, most: int = 4_000_000) -> DataFrame:
    """``ids`` written, and marked for broadcast if there are at most ``most`` (32 MB); a larger set is shuffled."""
    ids = materialize(ids, "ids")
    return F.broadcast(ids) if ids.count() <= most else ids
