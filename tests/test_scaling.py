"""What keeps the Markdown queries in proportion to their input."""

import re

from pyspark.sql import functions as F

from quirelake.operators import lines as L
from quirelake.operators import reader as R
from quirelake.operators import search as S
from quirelake.operators import structure as M
from quirelake.operators import validate as V
from quirelake.plans import markdown_queries as Q

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_corpus_exchanges_narrow_rows_in_a_number_of_tasks_that_grows(spark, monkeypatch):
    small = Q.corpus(spark, SF)
    assert "RoundRobin" not in _plan(small)
    monkeypatch.setattr(Q, "TASK_BYTES", 1000)
    more = Q.corpus(spark, SF)
    assert more.rdd.getNumPartitions() > 3 * small.rdd.getNumPartitions()
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, small.collect()))


def test_body_start_reads_the_text_once_and_stays_in_place(spark):
    texts = ["---\na: 1\n---\nx\n---\n", "--- \r\na: 1\r\n\t--- \r\n", "---\n---", "---\na", "---", "", None, "﻿---\nb: é\n---\n", " ---\nx: 1\n\n---\n", "x\n---\ny\n---\n"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    got = L.body_start_line(d)
    assert {r.doc_id: r.body_start_line for r in got.collect()} == {0: 4, 1: 4, 2: 3, 3: 1, 4: 1, 5: 1, 6: 1, 7: 4, 8: 5, 9: 1}
    assert not re.search("Exchange|Join|Aggregate", _plan(got))
    lines = {}
    for r in L.frontmatter_lines(d).collect():
        lines.setdefault(r.doc_id, []).append((r.line, r.text, r.closed_at))
    assert lines == {0: [(2, "a: 1", 3)], 1: [(2, "a: 1", 3)], 2: [(None, None, 2)], 3: [(2, "a", None)], 4: [(None, None, None)], 7: [(2, "b: é", 3)], 8: [(2, "x: 1", 4), (3, "", 4)]}


ODD = ["# a\n\n- x\n  # in\n\n> q [l](u)\n\n| a | b |\n| - | - |\n| *1* | 2 |\n", "", None, "plain **b** `c`\n===\n\n```\nopen\n", "---\nk: v\n---\n[r]: u\n\n<div>\né\n", "\ufeff# x\r\ny\r\n", "    code\n\n1. one\n\n   two\n"]


def test_counts_made_with_the_parse_are_those_of_the_arrays(spark):
    d = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, content string")
    p = M.parsed(d, "nodes", "headings", "inlines")
    got = M.corpus_stats(d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.stats(p).collect()))
    assert "Generate" not in _plan(got)
    assert tuple(M.corpus_tiling(d).first()) == (p.count(), M.overlaps(p).count(), M.gaps(d, p).count())
    assert tuple(M.corpus_tiling(d.limit(0)).first()) == (0, 0, 0)


PAGES = ["---\nt: 1\n---\nlede é\n\n# One\na\n## Two\nb\n### Deep\nc\n## Three\nd\n# Last\n", "x\r\n# One\r\n## A\r\nb", "# One\n\n> q\n\nSub\n---\nz\n", "no heading\n", " \n\t\n# One\n", None, ""]


def test_unfold_and_lede_leave_rows_in_place(spark):
    d = spark.createDataFrame(list(enumerate(PAGES)), "doc_id long, content string")
    p = M.parsed(d, "headings", "content")
    for how in ({"depth": 1}, {"depth": 2}, {"full": True}, {"threshold": 1}):
        got, old = R.unfold(d, "1", **how), M.unfold(d, M.outline(p), "1", **how)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, old.collect()))
        assert "Exchange" not in _plan(got)
    got, old = M.lede(p, p), M.lede(d, M.parsed(d, "headings"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, old.collect())) and got.count() == 3
    assert not re.search("Exchange|Join", _plan(got))


def test_readings_use_the_scan_of_plain_texts(monkeypatch):
    import pyarrow as pa

    texts = [t or "" for t in PAGES]
    known = R.scanned(pa.array(texts))
    assert known[0] and not known[1] and not known[2]
    for address in ("1", "One", "fm", "0", "1.2"):
        for text, k in zip(texts, known):
            made = []
            for given in (None, k):
                try:
                    r = R.read_document("p", text, address, scanned=given)
                    made.append((r.text, r.data, r.note))
                except R.Unreadable as e:
                    made.append(str(e))
            assert made[0] == made[1]
    monkeypatch.setattr(R, "parse", None)
    assert R.read_document("p", texts[0], "1.2", scanned=known[0]).data["heading"] == "Three"


def test_checks_of_ascii_texts_skip_the_borders(spark):
    d = spark.createDataFrame([(1, "# a\n\n[l](u) **b**\n"), (2, "# é\n\n[é](u) **b**\n")], "doc_id long, content string")
    p = M.parsed(d, *V.WANT).withColumn("inlines", F.transform("inlines", lambda x: x.withField("s_end", x["s_end"] + F.when(x["type"] == "link", -1).otherwise(100))))
    got = sorted((r.doc_id, r.rule, r.subject) for r in V.violations(p).collect())
    assert got == [(1, "grammar", "link"), (1, "slice", "strong"), (2, "grammar", "link"), (2, "slice", "strong")]
    checked = V._checked(p)
    assert {r.doc_id: r.ascii_ for r in checked.select("doc_id", "ascii_").collect()} == {1: True, 2: False}


def test_a_token_is_stemmed_once_a_batch(monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(S, "stem", lambda t: seen.append(t) or t[:2])
    got = S.stem_tokens.func(pa.array([["clowns", "at"], None, [], ["clowns", "clowns"], ["x"]]).slice(0, 4))
    assert got.to_pylist() == [["cl", "at"], [], [], ["cl", "cl"]] and seen == ["clowns", "at"]
