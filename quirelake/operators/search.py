"""Ranked search: BM25 over weighted fields, without an index or a shuffle of terms.

A query's terms are few, so the text is scanned once for their frequencies and the field lengths.
That narrow table is written to the shared folder; document frequencies and average lengths are one small
aggregate of it, and scores are computed from it row by row. Only the top hits are joined to text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quirelake.functions import text as T
from quirelake.functions.stem import stem
from quirelake.session import materialize

K1, B = 1.2, 0.75
WEIGHTS = {"title": 1.0, "description": 1.5, "body": 1.0}
SNIPPET_CHARS = 150
_WORD = re.compile(r"[^\W_]+")


def analyze(text: str, stemmed: bool = True) -> list[str]:
    """A query's terms in order, repeated ones kept; no character has a meaning of its own."""
    words = [w.lower() for w in _WORD.findall(text) if len(w.encode()) < T.MAX_TOKEN_BYTES]
    return [stem(w) for w in words] if stemmed else words


@F.arrow_udf(ArrayType(StringType()))
def stem_tokens(column: pa.Array) -> pa.Array:
    # each distinct token is an object once, not each occurrence
    coded = column.flatten().dictionary_encode()
    stems = pa.array([stem(t) for t in coded.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(_offsets(column), stems.take(coded.indices))


def _offsets(column: pa.ListArray) -> pa.Array:
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array([0, *n.cumsum().tolist()], pa.int32())


def terms(text: Column, stemmed: bool) -> Column:
    found = T.tokens(text)
    return stem_tokens(found) if stemmed else found


def postings(docs: DataFrame, fields: Sequence[str] = ("title", "description", "body"), stemmed: bool = False) -> DataFrame:
    """doc_id, field, term, tf: the inverted index as a table."""
    parts = [docs.select("doc_id", F.lit(f).alias("field"), F.explode(terms(F.col(f), stemmed)).alias("term")) for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"))


def frequencies(docs: DataFrame, query: Sequence[str], fields: Sequence[str], stemmed: bool) -> DataFrame:
    """doc_id, and for each field its length and the frequencies of the distinct terms of the query; one narrow pass."""
    out = docs.select("doc_id", *(terms(F.col(f), stemmed).alias(f) for f in fields))
    tf = [F.array(*(F.size(f) - F.size(F.array_remove(F.col(f), t)) for t in query)).alias(f"tf_{f}") for f in fields]
    return out.select("doc_id", *(F.size(f).alias(f"len_{f}") for f in fields), *tf)


def bm25(docs: DataFrame, query: str, weights: dict[str, float] | None = None, stemmed: bool = True) -> DataFrame:
    """doc_id and score of the documents that hold a term. A term given twice counts twice; a field of weight 0 still matches."""
    weights = WEIGHTS if weights is None else weights
    asked = analyze(query, stemmed)
    if not asked:
        raise ValueError(f"query has no searchable terms: {query!r}")
    distinct = list(dict.fromkeys(asked))
    times = [asked.count(t) for t in distinct]
    fields = list(weights)
    table = materialize(frequencies(docs, distinct, fields, stemmed), "tf")
    stats = table.agg(F.count("*").alias("n"), *(F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields), *(F.count_if(F.col(f"tf_{f}")[i] > 0).alias(f"df_{f}_{i}") for f in fields for i in range(len(distinct)))).first()
    score, match = F.lit(0.0), F.lit(False)
    for f in fields:
        average = stats[f"avg_{f}"] or 1.0
        for i, k in enumerate(times):
            df = stats[f"df_{f}_{i}"]
            if not df:
                continue
            idf = math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5))
            tf = F.col(f"tf_{f}")[i].cast("double")
            score = score + F.lit(weights[f] * k * idf * (K1 + 1)) * tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B / average) * F.col(f"len_{f}")))
            match = match | (tf > 0)
    return table.where(match).select("doc_id", score.alias("score"))


def search(docs: DataFrame, query: str, limit: int = 10, weights: dict[str, float] | None = None, stemmed: bool = True) -> DataFrame:
    """The best documents: doc_id, score, tokens (of the body), snippet and highlights. Ties go to the smaller doc_id. Text is read again for the hits only."""
    asked = analyze(query, stemmed)
    top = bm25(docs, query, weights, stemmed).orderBy(F.desc("score"), "doc_id").limit(limit)
    found = docs.join(F.broadcast(top), "doc_id")  # at most ``limit`` rows
    made = found.select("doc_id", "score", T.estimate_tokens(F.col("body")).alias("tokens"), snippet_udf(asked, stemmed)(F.coalesce("body", F.lit(""))).alias("s"))
    return made.select("doc_id", "score", "tokens", F.col("s.text").alias("snippet"), F.col("s.highlights").alias("highlights")).orderBy(F.desc("score"), "doc_id")


def snippet(body: str, asked: Sequence[str], stemmed: bool = True, width: int = SNIPPET_CHARS) -> tuple[str, list[tuple[int, int]]]:
    """The window of the body with most query terms and their places in it, in bytes; empty if there is none."""
    wanted = set(asked)
    words = [(m.start(), m.end(), (stem if stemmed else str)(m[0].lower())) for m in _WORD.finditer(body)]
    best: tuple[int, int, int, int] | None = None
    last = 0
    hits = [w for w in words if w[2] in wanted]
    for i, (s, _, _) in enumerate(hits):
        last = max(last, i)
        while last + 1 < len(hits) and hits[last + 1][1] - s <= width:
            last += 1
        score = len({h[2] for h in hits[i : last + 1]}) * 1000 + (last - i)
        if best is None or score > best[0]:
            best = (score, s, i, last)
    if best is None:
        return "", []
    _, begin, i, j = best
    end = max([e for s, e, _ in words if s >= begin and e - begin <= width] or [hits[i][1]])
    text = body[begin:end]
    size = [0]
    for c in text:
        size.append(size[-1] + len(c.encode("utf-8", "replace")))
    return text, [(size[s - begin], size[min(e, end) - begin]) for s, e, _ in hits[i : j + 1] if e <= end]


def snippet_udf(asked: Sequence[str], stemmed: bool):
    @F.arrow_udf("struct<text: string, highlights: array<struct<start: long, end: long>>>")
    def go(body: pa.Array) -> pa.Array:
        made = [snippet(b or "", asked, stemmed) for b in body.to_pylist()]
        return pa.array([{"text": t, "highlights": [{"start": a, "end": b} for a, b in h]} for t, h in made], pa.struct([("text", pa.string()), ("highlights", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return go


def mark(text: str, highlights: Sequence[tuple[int, int]]) -> str:
    """Highlights between asterisks; those that touch are one."""
    merged: list[list[int]] = []
    for s, e in sorted(highlights):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    raw, out, at = text.encode(), [], 0
    for s, e in merged:
        out += [raw[at:s], b"*", raw[s:e], b"*"]
        at = e
    return b"".join([*out, raw[at:]]).decode()
