"""Language-model scoring with a probabilistic suffix tree over bytes.

Symbols are the UTF-8 bytes of the texts as they are; no letters, cases, scripts or digits are folded. A context
is the up to ``ORDER`` bytes before a symbol; before each document stand bytes 0xFF, which UTF-8 doesn't have.

Tree: a context of up to two bytes is always a state. A longer one is a state if it occurs ``min_count`` times and
its next symbols diverge from those of its suffix (count x Kullback-Leibler divergence of ``divergence`` nats),
or if it is the suffix of a state. A state's distribution is smoothed with its suffix's,
(n(x) + g p_suffix(x)) / (n + g), the root's with 1 / 256 each. A symbol's probability is that of the
longest state that ends before it; a document's score is the mean negative log2 probability of its characters
(``symbols`` counts characters, so scripts compare).

How it runs. Documents are cut into chunks of about ``CHUNK`` bytes (whole documents; one at least), each kept as one
compressed row. A chunk's (context, symbol) grams fit one integer, nearest byte first, so its distinct grams are a
sorted array that compresses to little more than a byte each; it is cut by a hash of the three nearest bytes into as many
buckets as the corpus needs for small tasks, up to ``MOST_BUCKETS`` (a large corpus has more chunks, not many more
distinct grams). A bucket thus holds whole subtrees from depth 3 on. Arrays are merged
``FAN`` at a time, level by level, so a bucket that a third of all texts hit is never gathered in one task but
as distinct grams. Then each bucket's tree answers the grams of ``FAN`` chunks a task, and the answers go back
to the chunks. Nothing that grows with the corpus is broadcast or sent to the driver: only statistics of contexts of two bytes
are, at most 2 ** 24 numbers. The number of grams, states and answers grows with the corpus.

Defined results: a null or empty text has 0 symbols and a null score. A null doc_id and repeated rows are counted and
scored like others. Texts scored against another corpus may hold grams that it hasn't: they get what the
smoothing leaves. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import textscan
from quirelake.session import materialize

ORDER, START, LOW = 6, 0xFF, 2
CHUNK, FAN, BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 64, 4 << 20, 4096
MIN_COUNT, DIVERGENCE, SMOOTHING = 50, 8.0, 4.0
UNIT = 1024  # answers are rounded to 1 / UNIT bit
CHUNKS = "chunk long, ids array<long>, sizes array<int>, chars array<int>, text binary, bucket int, grams binary, counts binary, n long"


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def grams(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each byte of the texts laid end to end: the bytes before it in its text, the nearest highest, and lowest the byte itself."""
    size = np.maximum(sizes, 0)
    key = np.zeros(len(data), np.int64)
    near = np.arange(ORDER)
    inside = near < size[:, None]
    edge = ((np.cumsum(size) - size)[:, None] + near)[inside]
    since = np.broadcast_to(near, inside.shape)[inside]
    before = np.empty(len(data), np.uint8)
    for k in range(1, ORDER + 1):
        key <<= 8
        before[k:], before[:k] = data[: max(0, len(data) - k)], START
        before[edge[since < k]] = START
        key |= before
    key <<= 8
    key |= data
    return key


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (textscan.mix((key >> 8 * (ORDER - 2)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal values, and their lengths."""
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(sorted_)])


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first, _ = _runs(key)
    return key[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def _cut(buckets: int):
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in textscan.groups(texts, CHUNK):
                raw = [None if t is None else t.encode("utf-8", "replace") for t in texts[a:b]]
                sizes = np.array([-1 if r is None else len(r) for r in raw], np.int64)
                joined = b"".join(r or b"" for r in raw)
                rows = [(chunk, ids[a:b], sizes.tolist(), [len(t or "") for t in texts[a:b]], pa.compress(joined, "zstd", asbytes=True), None, None, None, len(joined))]
                key = grams(np.frombuffer(joined, np.uint8), sizes)
                key.sort()
                first, count = _runs(key)
                key = key[first]
                own = bucket_of(key, buckets)
                order = np.argsort(own, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    if len(part):
                        rows.append((chunk, None, None, None, None, int(own[part[0]]), _pack(key[part]), _pack(count[part].astype(np.int64)), len(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                chunk += 1

    return go


def _merge(t: pa.Table) -> pa.Table:
    """One row of a group's (bucket, part, grams, counts, n): equal grams are added up, FAN arrays' worth at most at once."""
    sizes = t.column("n").to_pylist()
    key = np.concatenate([_unpack(x.as_py(), n, np.int64) for x, n in zip(t.column("grams"), sizes)])
    count = np.concatenate([_unpack(x.as_py(), n, np.int64) for x, n in zip(t.column("counts"), sizes)])
    key, count = _added(key, count)
    return pa.table({"bucket": t.column("bucket")[:1], "part": t.column("part")[:1], "grams": [_pack(key)], "counts": [_pack(count)], "n": [len(key)]}, schema=pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())]))


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(the two nearest bytes and the symbol, n) of buckets."""
    for batch in batches:
        for row in batch.to_pylist():
            key, n = _unpack(row["grams"], row["n"], np.int64), _unpack(row["counts"], row["n"], np.int64)
            key, n = _added(key >> 8 * (ORDER - 1) << 8 | key & 0xFF, n)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["gram", "n"])


class Low:
    """Probabilities after contexts of two bytes from counts of (context, symbol)."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, smoothing: float) -> None:
        order = np.argsort(gram)
        self.gram, self.n, self.smoothing = gram[order], n[order], smoothing
        near, symbol = self.gram >> 16, self.gram & 0xFF
        self.root = np.bincount(symbol, self.n, 256)
        self.one = np.bincount(near << 8 | symbol, self.n, 1 << 16)
        self.own = np.bincount(self.gram >> 8, self.n, 1 << 16)

    def probability(self, gram: np.ndarray) -> np.ndarray:
        g, symbol, near = self.smoothing, gram & 0xFF, gram >> 16
        p = (self.root[symbol] + g / 256) / (self.root.sum() + g)
        p = (self.one[near << 8 | symbol] + g * p) / (self.one.reshape(256, 256).sum(axis=1)[near] + g)
        return (_find(self.gram, self.n, gram) + g * p) / (self.own[gram >> 8] + g)


def _find(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The value of each wanted key among sorted ones; 0 where it isn't there."""
    if not len(keys):
        return np.zeros(len(want), values.dtype)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], 0)


class Subtree:
    """The states of three and more bytes of some buckets. A level's contexts are sorted keys with their counts; its cells, (context, symbol) with theirs."""

    def __init__(self, key: np.ndarray, n: np.ndarray, min_count: int, divergence: float, smoothing: float, low: Low) -> None:
        self.smoothing, self.low = smoothing, low
        symbol = key & 0xFF
        self.cells, self.contexts = {}, {}
        for d in range(LOW, ORDER + 1):
            context = key >> 8 * (ORDER - d + 1)
            first, _ = _runs(context)
            self.contexts[d] = context[first], np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
            self.cells[d] = (key, n) if d == ORDER else _added(context << 8 | symbol, n)
        # contexts of two bytes may lie in several buckets: their counts are the driver's
        self.cells[LOW] = self.cells[LOW][0], _find(low.gram, low.n, self.cells[LOW][0])
        self.contexts[LOW] = self.contexts[LOW][0], low.own[self.contexts[LOW][0]].astype(np.int64)
        self.states = {}
        longer = np.zeros(0, np.int64)
        for d in range(ORDER, LOW, -1):
            (cell, m), (context, own) = self.cells[d], self.contexts[d]
            of = np.searchsorted(context, cell >> 8)
            above = (cell >> 16) << 8 | cell & 0xFF
            ratio = np.log((m / own[of]) / (_find(*self.cells[d - 1], above) / _find(*self.contexts[d - 1], cell >> 16)))
            gain = np.bincount(of, m * ratio, len(context))
            keep = (own >= min_count) & (gain >= divergence)
            keep |= np.isin(context, longer >> 8)
            self.states[d] = context[keep], own[keep]
            longer = context[keep]

    def bits(self, key: np.ndarray) -> np.ndarray:
        """-log2 p of sorted grams."""
        symbol = key & 0xFF
        pair, of = np.unique(key >> 8 * (ORDER - 1) << 8 | symbol, return_inverse=True)
        p = self.low.probability(pair)[of]
        live = np.arange(len(key))
        for d in range(LOW + 1, ORDER + 1):
            context = key[live] >> 8 * (ORDER - d + 1)
            own = _find(*self.states[d], context)
            live, context, own = live[own > 0], context[own > 0], own[own > 0]
            p[live] = (_find(*self.cells[d], context << 8 | symbol[live]) + self.smoothing * p[live]) / (own + self.smoothing)
        return -np.log2(p)


def chunks(docs: DataFrame, buckets: int, name: str) -> DataFrame:
    return materialize(docs.select("doc_id", "text").mapInArrow(_cut(buckets), CHUNKS), name)


def buckets_for(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))


def merged(cut: DataFrame) -> DataFrame:
    """bucket, grams, counts, n: each bucket's grams in one row, merged ``FAN`` arrays at a time."""
    most = cut.where("bucket is null").count()
    parts = cut.where("bucket is not null").select("bucket", F.col("chunk").alias("part"), "grams", "counts", "n")
    while True:
        groups = max(1, -(-most // FAN))
        parts = parts.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("long"))
        parts = materialize(parts.groupBy("bucket", "part").applyInArrow(_merge, "bucket int, part long, grams binary, counts binary, n long"), "merged")
        most = groups
        if groups == 1:
            return parts.drop("part")


def score(docs: DataFrame, corpus: DataFrame | None = None, min_count: int = MIN_COUNT, divergence: float = DIVERGENCE, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, symbols, bits, bits_per_symbol for each row of ``docs`` by the tree of ``corpus`` (by default ``docs`` itself)."""
    spark = docs.sparkSession
    buckets = buckets_for(docs if corpus is None else corpus)
    cut = chunks(docs, buckets, "chunks")
    tree = merged(cut if corpus is None else chunks(corpus, buckets, "corpus"))
    counted = tree.mapInArrow(_low, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** 24 rows
    low = spark.sparkContext.broadcast(Low(counted.column("gram").to_numpy(), counted.column("n").to_numpy(), smoothing))
    groups = max(1, -(-cut.where("bucket is null").count() // FAN))
    asked = cut.where("bucket is not null").select("bucket", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("long").alias("part"), "chunk", "grams", "n")
    model = tree.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("part", F.col("part").cast("long"))

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.to_pylist()[0] if right.num_rows else {"grams": _pack(np.zeros(0, np.int64)), "counts": _pack(np.zeros(0, np.int64)), "n": 0}
        own = Subtree(_unpack(known["grams"], known["n"], np.int64), _unpack(known["counts"], known["n"], np.int64), min_count, divergence, smoothing, low.value)
        out = []
        for x, n in zip(left.column("grams"), left.column("n").to_pylist()):
            out.append(_pack(np.minimum(np.rint(own.bits(_unpack(x.as_py(), n, np.int64)) * UNIT), 0xFFFF).astype(np.uint16)))
        return pa.table({"chunk": left.column("chunk"), "bucket": left.column("bucket"), "bits": pa.array(out, pa.binary()), "n": left.column("n")})

    answers = asked.groupBy("bucket", "part").cogroup(model.groupBy("bucket", "part")).applyInArrow(answer, "chunk long, bucket int, bits binary, n long")

    def back(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        answered = {b: (x.as_py(), n) for b, x, n in zip(right.column("bucket").to_pylist(), right.column("bits"), right.column("n").to_pylist())}
        for row in left.to_pylist():  # one row
            sizes = np.array(row["sizes"], np.int64)
            size = np.maximum(sizes, 0)
            gram = grams(np.frombuffer(pa.decompress(row["text"], row["n"], "zstd", asbytes=True), np.uint8), sizes)
            order = np.argsort(gram)
            gram = gram[order]
            first, count = _runs(gram)
            gram = gram[first]
            own = bucket_of(gram, buckets)
            at, units = np.argsort(own, kind="stable"), np.zeros(len(first), np.uint16)
            if len(at):
                units[at] = np.concatenate([_unpack(*answered[b], np.uint16) for b in np.unique(own).tolist()])
            placed = np.empty(len(order), np.uint16)
            placed[order] = np.repeat(units, count)
            bits = np.zeros(len(size))
            if len(full := np.flatnonzero(size)):
                bits[full] = np.add.reduceat(placed, (np.cumsum(size) - size)[full], dtype=np.int64) / UNIT
            some = size > 0
            symbols = np.array(row["chars"], np.int64)
            parts.append(pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "symbols": pa.array(symbols), "bits": pa.array(bits), "bits_per_symbol": pa.array(np.where(some, bits / np.maximum(symbols, 1), 0), mask=~some)}))
        empty = pa.table({"doc_id": pa.array([], pa.int64()), "symbols": pa.array([], pa.int64()), "bits": pa.array([], pa.float64()), "bits_per_symbol": pa.array([], pa.float64())})
        return pa.concat_tables(parts) if parts else empty

    texts = cut.where("bucket is null").select("chunk", "ids", "sizes", "chars", "text", "n")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(back, "doc_id long, symbols long, bits double, bits_per_symbol double")
