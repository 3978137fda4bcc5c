"""Scanned texts have the rows that the parser gives them."""

import random

import pyarrow as pa
import pytest

from quirelake.operators import structure as M

PARTS = ["# a", "## b [l](u) c", "### d **x**", "####### seven", "```", "```sql", "text [[W|al]] *em*", "more [l](http://x.e/1) **b** x", "* item <!-- i -->", "- it **s**", "+ z http://a.b", "* ```", "1. x", "| a | b |", "| --- | --- |", "", "", "", "para **open", "close** it [li", "nk](d) z", "Part <!-- part: 1 --> body <!-- /part -->", "x <!-- /q --> <!-- q --> y", "<!-- w -->", "é ü", "===", "--", "> q", "  in", "[r]: u", "www.e.com", "`c` x"]


def _texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    out = ["", "\n", "# one", "# é 日本\nx\n## `c` d_e\n", "```\nopen\n", "---\nk: v\n", "﻿# x\n", "# a\r\nb"]
    for _ in range(400):
        t = "\n".join(rng.choice(PARTS[: rng.choice([16, 24, len(PARTS)])]) for _ in range(rng.randint(0, 9))) + rng.choice(["", "\n"])
        out.append(rng.choice(["", "", "---\nk: v\n---\n", "---\n# c\n- x\n---\n"]) + t)
    return out


@pytest.mark.parametrize("want", [("headings",), ("code",), ("inlines",), ("regions", "dangling"), ("code", "headings")])
def test_scan_gives_what_the_parser_gives(want):
    texts = _texts(len(want) + len(want[0]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 1)), pa.array(["before", *texts])], names=["doc_id", "content"]).slice(1)
    keep, made = M._scanned(batch, want)
    plain = [i for i, x in enumerate(keep.to_pylist()) if x]
    assert len(plain) > 60
    for i, row in zip(plain, zip(*(c.to_pylist() for c in made)), strict=True):
        own = M.document_row(i + 1, texts[i], want)
        assert list(row) == [*own[:5], *([dict(zip(M.ARRAYS[a], x)) for x in rows] for a, rows in zip(want, own[5:]))], texts[i]


def test_parsed_takes_plain_and_other_texts_in_any_slices(spark, monkeypatch):
    texts = [None, *_texts(3)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    for want in (("headings",), ("inlines",), ("regions", "dangling"), ("code",)):
        got = {r.doc_id: r for r in M.parsed(d.repartition(2), *want, "content").collect()}
        assert sorted(got) == list(range(1, len(texts)))
        for i, r in got.items():
            assert r.content == texts[i] and [len(r[a]) for a in want] == [len(x) for x in M.document_row(i, texts[i], want)[5:]]
