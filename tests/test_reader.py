import json
import random

import pytest

from quirelake.operators import reader as R
from quirelake.operators import structure as M
from quirelake.operators import validate as V

TEXT = """---
name: Harbour log
tides: [3, 4.5]
crew:
  - who: Ann
    since: 2019-02-03
---

Before any heading, a [chart](c.md) and [[Pilot book|the book]].

# Arrival

Short.

## Links

See <http://port.example>.

### Berth

Line.

## Text

# Departure
Again [[Pilot book]].
"""


def test_overview():
    r = R.read_document("log.md", TEXT)
    lines = r.text.split("\n")
    assert lines[:3] == ["log.md", "fields: name, tides, crew", "links: 4"]
    assert lines[4] == "  [0]  (text)        L9   2 lines · ~16 tok"
    assert lines[5].startswith("+ 1      Arrival        L11   14 lines · ~")
    assert lines[6].startswith("+   1.1    Links          L15   8 lines · ~") and lines[7].startswith("      1.1.1  Berth ")
    assert lines[-3:] == ["note: 'Text' (1.2) also answers to a reserved address; reach it by number", "note: 'Links' (1.1) also answers to a reserved address; reach it by number", ""]
    assert [n["heading"] for n in r.data["tree"]] == ["Arrival", "Departure"] and r.data["text"]["lines"] == 2


def test_sections_by_number_and_name():
    by_number, by_name = R.read_document("p", TEXT, "1.01.1"), R.read_document("p", TEXT, "berth")
    assert by_number.text == by_name.text and by_number.data["content"] == "### Berth\n\nLine.\n"
    assert R.read_document("p", TEXT, "1.1").note is None
    assert R.read_document("p", TEXT, "text").note == "heading 'Text' (1.2) also answers to 'text'"
    assert R.read_document("p", TEXT, "0").data["line"] == 9


def test_depth_counts_apart_in_text_and_json():
    r = R.read_document("p", TEXT, "1", depth=1)
    assert "See <http://port.example>." in r.text and "\n      1.1.1  Berth" in r.text
    assert [c["folded"] for c in r.data["children"]] == [True, True] and "content" not in r.data["children"][0]
    shown = R.read_document("p", TEXT, "1", depth=2).data["children"]
    assert [c["folded"] for c in shown] == [False, False] and shown[0]["content"].endswith("### Berth\n\nLine.\n")
    small = R.read_document("p", TEXT, "1", threshold=5)
    assert "+   1.1    Links" in small.text and "## Text" in small.text
    assert R.read_document("p", TEXT, "1", threshold=0, full=True).text == R.read_document("p", TEXT, "1").text


@pytest.mark.parametrize("address, error", [
    ("3", "Address '3' out of range"),
    ("1.0", "Address '1.0' out of range"),
    ("1.1.1.1", "Address '1.1.1.1' out of range"),
    ("99999999999999999999999", "Address '99999999999999999999999' out of range"),
    ("No Such", "No heading matches slug 'no-such'"),
    ("fm.crew[2].who", "'crew[2].who': index 2 out of range for 'crew' (len 1); top-level fields: name, tides, crew"),
    ("fm.name.x", "'name.x': cannot read key 'x' on a non-mapping value; top-level fields: name, tides, crew"),
])
def test_errors(address, error):
    with pytest.raises(R.Unreadable) as e:
        R.read_document("p", TEXT, address)
    assert str(e.value) == error


def test_errors_name_the_heading_meant():
    with pytest.raises(R.Unreadable, match=r"^No frontmatter block in this file \(address 'FM'\); heading 'FM' \(1\) also answers to 'fm'$"):
        R.read_document("p", "# FM\n", "FM")
    with pytest.raises(R.Unreadable, match=r"^No text region in this file \(address '0'\); heading 'Text' \(1\) also answers to 'text'$"):
        R.read_document("p", "# Text\n", "0")
    with pytest.raises(R.Unreadable, match=r"^Ambiguous slug 'a-b'; candidates:\n  1  A b\n  2.1  A, b$"):
        R.read_document("p", "# A b\n# C\n## A, b\n", "A B")


def test_values():
    assert R.read_document("p", TEXT, "fm.tides").text == "- 3\n- 4.5\n"
    assert R.read_document("p", TEXT, "frontmatter.crew").text == "- who: Ann\n  since: 2019-02-03\n"
    assert R.read_document("p", TEXT, "fm.crew[0].since").data["value"] == "2019-02-03"
    block = R.read_document("p", TEXT, "Frontmatter")
    assert (block.data["line"], block.data["lines"]) == (2, 5) and block.data["fields"][2] == {"key": "crew", "value": "- who: Ann\n  since: 2019-02-03", "line": 4}
    assert R.read_document("p", "---\n---\nx\n", "fm").data["lines"] == 0


def test_strict_headings_and_wikilinks():
    text = "Under\n=====\n\n  # In\n\n# Flush\n[[a]] [b](c)\n"
    assert [n["heading"] for n in R.read_document("p", text).data["tree"]] == ["Under", "In", "Flush"]
    strict = R.read_document("p", text, strict=True)
    assert [n["heading"] for n in strict.data["tree"]] == ["Flush"] and strict.data["text"]["lines"] == 5
    assert R.read_document("p", text, wikilinks_only=True).data["links"] == 1


def test_rows(spark):
    docs = spark.createDataFrame([(1, TEXT, "log.md", "x"), (2, "plain", None, "y"), (3, None, "n", None)], "doc_id long, content string, path string, text string")
    got = {r.doc_id: r for r in R.read(docs, "1").collect()}
    assert json.loads(got[1].json)["path"] == "log.md" and got[1].error is None
    assert got[2].error == "Address '1' out of range" and got[2].text is None
    assert got[3].reading is None and got[3].error is None
    assert R.read(docs.limit(0)).count() == 0


def test_texts_are_the_joined_sections(spark):
    """Unfolded whole, the reader's text is that of the operator on rows."""
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, content string")
    p = M.parsed(docs, "headings")
    for depth in (None, 1, 2):
        one = M.unfold(docs, M.outline(p), "1", depth=depth).first().content
        assert R.read_document("", TEXT, "1", depth=depth).text.partition("\n\n")[2] == one


SPECIMEN = "﻿---\nt: 1\n---\n# Ä [x](y) ![i](u)\n\ntext **b** *e* `c` [[W|al]] ![[E]] <http://u> www.a.b\n\n```py\nx\n```\n\n| a | b |\n|---|---|\n| [[x\\|y]] | *k* |\n\n<!-- r: i -->\nq\n<!-- /r -->\n\n[ref]: http://x\n"


def test_sound_parses_have_no_violation(spark):
    texts = [SPECIMEN, SPECIMEN.replace("\n", "\r\n"), "﻿", "", " \n", TEXT, "Ж [л](u) ***both***\n\n- a\n  > q\n"]
    p = M.parsed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string"), *V.WANT)
    assert V.violations(p).count() == 0
    assert V.summary(V.verify(p)).first().asDict() == {"files_ok": len(texts), "files_checked": len(texts), "code": 0}


def brute(content, row):
    """Violations of a collected row, by plain Python."""
    raw, out = content.encode(), []

    def ok(a, b):
        if not 0 <= a <= b <= len(raw):
            return False
        try:
            raw[:a].decode(), raw[:b].decode()
            return True
        except UnicodeDecodeError:
            return False

    spans = sorted([(n.s_start, n.s_end) for n in row.nodes if n.parent_id is None] + [(h.s_start, h.s_end) for h in row.headings])
    cursor = row.body_start_byte
    for a, b in [*spans, (len(raw), len(raw))]:
        if a < cursor:
            out.append(("tiling", "overlap"))
        elif not ok(cursor, a):
            out.append(("tiling", "slice"))
        elif (raw[cursor:a].decode().removeprefix("﻿") if cursor == 0 else raw[cursor:a].decode()).strip(" \t\r\n"):
            out.append(("tiling", "gap"))
        elif not ok(a, b):
            out.append(("tiling", "slice"))
        cursor = b
    for x in row.inlines:
        if not ok(x.s_start, x.s_end):
            out.append(("inline", "slice"))
            continue
        s = raw[x.s_start : x.s_end].decode()
        if x.type in ("wikilink", "emph", "strong") and any(n.type == "tableCell" and n.s_start <= x.s_start and x.s_end <= n.s_end for n in row.nodes):
            continue
        w = s.removeprefix("!") if x.embed else s
        good = {"link": s[:1] == "[" and s[-1:] in tuple(")]"), "image": s[:2] == "![" and s[-1:] in tuple(")]"), "wikilink": w[:2] == "[[" and w[-2:] == "]]", "codeSpan": s[:1] == s[-1:] == "`", "emph": s[:1] in tuple("*_") and s[-1:] in tuple("*_"), "strong": s[:2] in ("**", "__") and s[-2:] == s[:2], "autolink": s[:1] == "<" and s[-1:] == ">" or "://" in s or "@" in s or s[:4] == "www."}[x.type]
        if not good:
            out.append(("inline", "grammar"))
        elif x.sub_start is not None and not ok(x.sub_start, x.sub_end):
            out.append(("inline", "slice"))
        elif x.sub_start is not None and not (x.s_start <= x.sub_start and x.sub_end <= x.s_end):
            out.append(("inline", "nesting"))
    for n in row.nodes:
        for a, b in ((n.info_start, n.info_end), (n.body_start, n.body_end)):
            if n.type == "codeBlock" and a is not None:
                if not ok(a, b):
                    out.append(("node", "slice"))
                elif not (n.s_start <= a and b <= n.s_end):
                    out.append(("node", "nesting"))
        if n.type == "unknown":
            out.append(("unknown", "untyped"))
    for r in row.regions:
        if not ok(r.s_start, r.s_end) or not ok(r.body_start, r.body_end):
            out.append(("region", "slice"))
        elif not (r.s_start <= r.body_start and r.body_end <= r.s_end):
            out.append(("region", "nesting"))
        else:
            s = raw[r.s_start : r.s_end].decode().strip()
            if not (s.startswith("<!--") and s.endswith("-->")):
                out.append(("region", "anchors"))
    return sorted(out)


def test_spoiled_parses_against_brute_force(spark):
    rng = random.Random(3)
    base = M.parsed(spark.createDataFrame([(0, SPECIMEN)], "doc_id long, content string"), *V.WANT)
    row = base.first()
    rows = []
    for i in range(120):
        d = json.loads(json.dumps(row.asDict(True)))
        d["doc_id"] = i
        for _ in range(rng.randint(1, 2)):
            array = rng.choice(["headings", "nodes", "inlines", "regions"])
            x = rng.choice(d[array])
            names = [k for k in x if k.endswith(("_start", "_end")) and x[k] is not None and not k.startswith(("t_", "sec_"))]
            x[rng.choice(names)] += rng.choice([-400, -3, -1, 1, 2, 5, 900])
            if array == "nodes" and rng.random() < 0.2:
                x["type"] = "unknown"
        rows.append(d)
    p = spark.createDataFrame(rows, base.schema)
    got = {}
    for r in V.violations(p).collect():
        got.setdefault(r.doc_id, []).append((r.stage, r.rule))
    want = {r.doc_id: v for r in p.collect() if (v := brute(SPECIMEN, r))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 80
    verdicts = {r.doc_id: r for r in V.verify(p).collect()}
    for i, v in want.items():
        assert not verdicts[i].ok and verdicts[i].code == 4
        assert verdicts[i].message.split(":")[0] == min((s for s, _ in v), key=V.STAGES.index)


def test_dangling_by_label(spark):
    p = M.parsed(spark.createDataFrame([(1, "<!-- a -->\n<!-- /b -->\n<!-- a -->x<!-- /a -->\n")], "doc_id long, content string"), "regions", "dangling")
    assert V.dangling(p, []).count() == 0
    assert [r.value for r in V.dangling_records(V.dangling(p, ["a", "zz"])).collect()] == ['{"type":"unpaired-open","label":"a","span":{"start":0,"end":10},"line":1}']
    anchors = M.parsed(spark.createDataFrame([(1, "<!-- a -->\n<!-- /b -->\n<!-- a -->x<!-- /a -->\n")], "doc_id long, content string"), "anchors")
    for one, other in zip(M.regions(p), M.regions(anchors)):
        assert sorted(one.select(*sorted(one.columns)).collect()) == sorted(other.select(*sorted(one.columns)).collect())


def test_a_reading_parses_only_what_it_needs(monkeypatch):
    text = "---\ntitle: A\nn: 1\n---\n# H\n[a](b)\n"
    calls = []
    real = R.parse
    monkeypatch.setattr(R, "parse", lambda content, **how: calls.append(how) or real(content, **how))
    assert R.read_document("p", text, "fm.title").text == "A\n" and R.read_document("p", text, "fm.n").data["value"] == 1 and not calls
    R.read_document("p", text, "1")
    assert calls == [{"inlines": False}]
