"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of other than letters is one kind of gap. N-grams of 2 and 3
code points that don't reach across a gap are hashed to 2**16 buckets. The counts come from all
rows with a text and a language; the matrix of log probabilities, buckets x languages, has a
fixed number of rows and is broadcast. A document's score is the sum of its n-grams' rows,
gathered and reduced in numpy.

A document is rejected (language ``und``) if it has no n-gram, if every language explains its
n-grams worse than uniform buckets would, or if the best language's posterior is below
``min_posterior``. Null and empty texts are ``und``; a null lang isn't learnt from. With no labelled
rows every document is ``und``. Repeated rows each get a row. Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import textscan

BUCKETS = 1 << 16
ALPHA = 0.5
MIN_POSTERIOR = 0.5
UND = "und"
_LETTER = np.ones(0x3100, bool)
_LETTER[:128] = False
_LETTER[97:123] = True
_LETTER[0x80:0xC0] = _LETTER[0x2000:0x2070] = _LETTER[0x3000:0x3040] = False


def ngram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, BUCKETS for a place without one, and the first place of each text's for n=2, then n=3."""
    joined = "\0" + "\0".join((t or "").lower() for t in texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter((len((t or "").lower()) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    c = np.where(_LETTER[np.minimum(c, len(_LETTER) - 1)], c, np.uint32(0))
    a, b = c[:-1], c[1:]
    two = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)
    two[(a == 0) & (b == 0)] = 0
    three = two[:-1] ^ c[2:] * np.uint32(0xC2B2AE3D) ^ np.uint32(0x5BD1E995)
    drop2, drop3 = (a == 0) & (b == 0), b[:-1] == 0
    out = np.empty((2, len(a)), np.int32)
    for k, (h, drop) in enumerate(((two, drop2), (three, drop3))):
        h = h ^ (h >> np.uint32(15))
        h = h * np.uint32(0x2C1B3C6D)
        h = ((h ^ (h >> np.uint32(12))) >> np.uint32(16)).astype(np.int32)
        h[drop] = BUCKETS
        out[k, : len(h)] = h
        out[k, len(h) :] = BUCKETS
    return out, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, lang = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        order = sorted(range(len(lang)), key=lang.__getitem__)
        texts, lang = [texts[i] for i in order], [lang[i] for i in order]
        for x, y in textscan.groups(texts, textscan.BLOCK):
            h, first = ngram_buckets(texts[x:y])
            edges = [i for i in range(x, y) if i == x or lang[i] != lang[i - 1]] + [y]
            ends = [*first.tolist(), h.shape[1]]
            for i, j in zip(edges[:-1], edges[1:]):
                counts = langs.setdefault(lang[i], np.zeros(BUCKETS + 1, np.int64))
                for part in h:
                    counts += np.bincount(part[ends[i - x] : ends[j - x]], minlength=BUCKETS + 1)
    for name, counts in langs.items():
        at = np.flatnonzero(counts[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])


class Model:
    """langs in order, and log probabilities of shape (BUCKETS + 1, langs); the last row is 0."""

    def __init__(self, langs: list[str], counts: np.ndarray, alpha: float = ALPHA) -> None:
        self.langs = langs
        self.matrix = np.zeros((BUCKETS + 1, len(langs)), np.float32)
        if langs:
            self.matrix[:BUCKETS] = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * BUCKETS))

    def score(self, texts: list[str | None], min_posterior: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior and n-grams of each text."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for x, y in textscan.groups(texts, textscan.BLOCK):
            h, first = ngram_buckets(texts[x:y])
            for part in h:
                n[x:y] += np.add.reduceat((part < BUCKETS).astype(np.int64), first)
                for k in range(len(self.langs)):
                    total[x:y, k] += np.add.reduceat(self.matrix[:, k][part], first, dtype=np.float64)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), n
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        posterior = 1 / np.exp(total - top[:, None]).sum(axis=1)
        known = (n > 0) & (top > n * -np.log(BUCKETS)) & (posterior >= min_posterior)
        return [self.langs[b] if ok else UND for b, ok in zip(best.tolist(), known.tolist())], np.where(n > 0, posterior, 0.0), n


def train(docs: DataFrame) -> Model:
    """The model of all labelled rows; what comes to the driver is bounded by buckets x languages."""
    got = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    rows = got.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = rows.column("lang").to_pylist(), rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    langs = sorted(set(lang))
    place = {name: k for k, name in enumerate(langs)}
    counts = np.zeros((BUCKETS, len(langs)))
    counts[bucket, np.fromiter((place[x] for x in lang), np.int64, len(lang))] = n
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model | None = None, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """doc_id, language, posterior, ngrams: one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, posterior, n = shared.value.score(batch.column(1).to_pylist(), min_posterior)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(language, pa.string()), pa.array(posterior), pa.array(n)], names=["doc_id", "language", "posterior", "ngrams"])

    return docs.select("doc_id", "text").mapInArrow(go, "doc_id long, language string, posterior double, ngrams long")


def keep_known(docs: DataFrame, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The rows of ``docs`` that aren't rejected; the columns stay as they are, and the decision is made in the scan, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        return pa.array([x != UND for x in model.value.score(text.to_pylist(), min_posterior)[0]], pa.bool_())

    return docs.where(known(docs["text"]))
