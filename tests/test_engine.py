import math

import pytest

from quirelake.functions import text as T
from quirelake.functions.stem import english, russian, stem
from quirelake.operators import lines as L
from quirelake.operators import search as S
from quirelake.operators import structure as M
from pyspark.sql import functions as F


@pytest.mark.parametrize("word,root", [("running", "run"), ("runs", "run"), ("importer", "import"), ("title", "titl"), ("value", "valu"), ("retry", "retri"), ("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("relational", "relat"), ("tomatoes", "tomato"), ("skies", "sky"), ("news", "news"), ("knightly", "knight"), ("consisting", "consist")])
def test_english(word, root):
    assert english(word) == root


def test_russian_forms_share_a_stem():
    assert russian("документы") == russian("документа") == "документ"
    assert len({russian(w) for w in ("книга", "книги", "книгу", "книгой")}) == 1
    assert stem("running") == "run" and stem("документы") == "документ"


def test_query_terms():
    assert S.analyze("importer's work") == ["import", "s", "work"]
    assert S.analyze("title:value") == ["titl", "valu"]
    assert S.analyze("retry - backoff") == ["retri", "backoff"]
    assert S.analyze("a" * 40 + " b") == ["b"]


def docs(spark):
    rows = [(1, "Retrieval", "ranking documents by term frequency", "An index of running words. " * 3), (2, "Gardening", "", "Tomatoes need sun. The tomato plant."), (3, "Other", "tomato", "nothing"), (4, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, title string, description string, body string")


def test_search(spark):
    hits = S.search(docs(spark), "tomatoes").collect()
    assert [r.doc_id for r in hits] == [3, 2] or [r.doc_id for r in hits] == [2, 3]
    assert "Tomatoes" in next(r for r in hits if r.doc_id == 2).snippet
    assert next(r for r in hits if r.doc_id == 3).snippet == ""
    assert S.search(docs(spark), "running").first().doc_id == 1
    assert S.search(docs(spark), "tomato", limit=0).count() == 0
    with pytest.raises(ValueError, match="no searchable terms"):
        S.search(docs(spark), "***", limit=0)
    once, twice = (S.bm25(docs(spark), q).where("doc_id = 2").first().score for q in ("tomato", "tomato tomato"))
    assert twice == pytest.approx(2 * once)
    zero = S.bm25(docs(spark), "tomato", {"title": 1.0, "description": 0.0, "body": 1.0}).collect()
    assert {r.doc_id: r.score for r in zero}[3] == 0


def test_bm25_equals_brute_force(spark):
    rows = [(i, " ".join(["red"] * (i % 4) + ["blue"] * (i % 3) + ["pad"] * (i % 7))) for i in range(30)]
    got = {r.doc_id: r.score for r in S.bm25(spark.createDataFrame(rows, "doc_id long, body string"), "red blue", {"body": 1.0}, stemmed=False).collect()}
    words = {i: t.split() for i, t in rows}
    n, average = len(rows), sum(map(len, words.values())) / len(rows)
    for i, w in words.items():
        want = 0.0
        for t in ("red", "blue"):
            df = sum(t in x for x in words.values())
            tf = w.count(t)
            want += math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
        assert got.get(i, 0.0) == pytest.approx(want)


def test_marks():
    assert S.mark("ab cd é", [(0, 2), (3, 5), (2, 3)]) == "*ab cd* é"
    text, places = S.snippet("x " * 200 + "the tomato, tomatoes!", S.analyze("tomato"))
    assert [text.encode()[a:b].decode() for a, b in places] == ["tomato", "tomatoes"]


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def test_scalars(spark):
    r = one(spark, a=T.slug(F.lit("Log & Notes")), b=T.slug(F.lit("The `x` [[N|y z]] *É*")), c=T.reserved_reading(F.lit("FM.References[0].Target")), d=T.reserved_path(F.lit("FM.References[0].Target")), e=T.reserved_reading(F.lit("fm.")), f=T.truncate_heading(F.lit("x" * 31)), g=T.first_difference_column(F.lit("abc"), F.lit("abd")), h=T.first_difference_column(F.lit("a"), F.lit("a")), i=T.resolve_name(F.lit("a/b.md#c")), j=T.opens_link_reference_definition(F.lit("  [x]: y")), k=T.search_body(F.lit("---\na: 1\n---\nbody")))
    assert tuple(r) == ("log-notes", "the-x-y-z-é", "field", "References[0].Target", None, "x" * 29 + "…", 3, None, "b", True, "body")
    assert one(spark, t=T.tree_line(F.lit(True), F.lit("1.2"), F.lit("Head"), F.lit(7), F.lit(3), F.lit(9))).t == "+   1.2    Head           L7   3 lines · ~9 tok"


def test_lines_and_endings(spark):
    d = spark.createDataFrame([(1, "a\r\nbé\rc\n\nd"), (2, ""), (3, None)], "doc_id long, content string")
    got = [tuple(r) for r in L.lines(d).orderBy("doc_id", "line").collect()]
    assert got == [(1, 1, "a", 0, 1, "\r\n"), (1, 2, "bé", 3, 6, "\r"), (1, 3, "c", 7, 8, "\n"), (1, 4, "", 9, 9, "\n"), (1, 5, "d", 10, 11, "")]
    assert [tuple(r) for r in L.ending_changes(d).orderBy("line").collect()] == [(1, 1, 2, 1, "\r\n"), (1, 2, 4, 6, "\r")]


def test_frontmatter_fields(spark):
    text = "---\ntitle: A b\ntags:\n  - x\n  - y\nkey: |\n  dropped\n# note\nlast:\n---\nbody: no\n"
    d = spark.createDataFrame([(1, text), (2, "no: block\n"), (3, "---\nopen: 1\n")], "doc_id long, content string")
    got = [(r.doc_id, r.key, r.value, r.line) for r in L.fields(d).orderBy("doc_id", "ord").collect()]
    assert got == [(1, "title", "A b", 2), (1, "tags", "- x\n- y", 3), (1, "key", "|", 6), (1, "last", "", 9), (3, "open", "1", 2)]
    assert {r.doc_id: r.body_start_line for r in L.body_start_line(d).collect()} == {1: 11, 2: 1, 3: 1}


MD = "---\nt: 1\n---\nlede\n\n# One\n\n### Deep\ntext [[A|b]]\n\n## Two\n[x](y)\n\n# Links\nSetext\n===\n"


def test_outline_and_links(spark):
    d = spark.createDataFrame([(1, MD), (2, "plain\n"), (3, None)], "doc_id long, content string")
    p = M.parsed(d)
    got = [(r.address, r.heading, r.level, r.line, r.end_line) for r in M.outline(p).orderBy("line").collect()]
    assert got == [("1", "One", 1, 6, 13), ("1.1", "Deep", 3, 8, 10), ("1.2", "Two", 2, 11, 13), ("2", "Links", 1, 14, 14), ("3", "Setext", 1, 15, 16)]
    assert [r.heading for r in M.outline(p, strict=True).orderBy("line").collect()] == ["One", "Deep", "Two", "Links"]
    sized = {r.heading: r.tokens for r in M.outline(p).collect()}
    assert sized["Two"] == len("## Two\n[x](y)\n") // 4
    assert [(r.kind, r.target, r.alias, r.line) for r in M.links(p).orderBy("ord").collect()] == [("wikilink", "A", "b", 9), ("link", "y", "x", 12)]
    assert [(r.reading, r.address) for r in M.shadows(M.outline(p)).collect()] == [("links", "2")]
    assert M.resolve(M.outline(p), "1.02").first().heading == "Two" and M.resolve(M.outline(p), "0.1").count() == 0
    assert M.gaps(d, p).count() == 0 and M.overlaps(p).count() == 0


def test_regions_interleave_and_dangle(spark):
    text = "<!-- a -->\n<!-- b: i -->\nx\n<!-- /a -->\n<!-- /b -->\n\n<!-- /c -->\n\n<!-- a -->\n\n`<!-- d -->` y <!-- e -->z<!-- /e -->\n"
    p = M.parsed(spark.createDataFrame([(1, text)], "doc_id long, content string"))
    found, dangling = M.regions(p)
    got = {r.label: (r.info, text.encode()[r.body_start : r.body_end].decode()) for r in found.collect()}
    assert got == {"a": (None, "<!-- b: i -->\nx\n"), "b": ("i", "x\n<!-- /a -->\n"), "e": (None, "z")}
    assert sorted((r.kind, r.label) for r in dangling.collect()) == [("unpaired-close", "c"), ("unpaired-open", "a")]
