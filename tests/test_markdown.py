import pytest

from quirelake.functions.markdown import parse, walk


def kinds(text):
    return [(n.kind, text[n.start : n.end]) for n in parse(text).root.children]


def inline(text, kind=None):
    return [text[x.start : x.end] for x in parse(text).inlines if kind in (None, x.kind)]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("# A\n\ntext\n", [("heading", "# A"), ("paragraph", "text")]),
        ("Foo\n---\nbar", [("heading", "Foo\n---"), ("paragraph", "bar")]),
        ("- - -\n", [("thematicBreak", "- - -")]),
        ("* a\n* b\n\ntext", [("list", "* a\n* b"), ("paragraph", "text")]),
        ("- a\n+ b", [("list", "- a"), ("list", "+ b")]),
        ("> a\nlazy\n\nb", [("blockQuote", "> a\nlazy"), ("paragraph", "b")]),
        ("```x\n# no\n```\n", [("codeBlock", "```x\n# no\n```")]),
        ("<!--\na\n-->\nb", [("htmlBlock", "<!--\na\n-->"), ("paragraph", "b")]),
        ("| a |\n| - |\n| b |\n", [("table", "| a |\n| - |\n| b |")]),
        ("[x]: /url 'T'\n\n[x]", [("linkReferenceDefinition", "[x]: /url 'T'"), ("paragraph", "[x]")]),
        ("para\n    not code", [("paragraph", "para\n    not code")]),
        ("1) a\n2) b\n3. c", [("list", "1) a\n2) b"), ("list", "3. c")]),
        ("text\n2. not a list", [("paragraph", "text\n2. not a list")]),
        ("~~~\nopen", [("codeBlock", "~~~\nopen")]),
        ("a\r\rb\r\n\r\nc", [("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c")]),
        ("#hash\n####### seven", [("paragraph", "#hash\n####### seven")]),
        ("", []),
    ],
)
def test_blocks(text, expected):
    assert kinds(text) == expected


def test_frontmatter_only_at_the_start_and_closed():
    p = parse("---\na: 1\n\nb: 2\n---\n# H\n")
    assert p.frontmatter == (0, len("---\na: 1\n\nb: 2\n---"), 5) and p.root.children[0].kind == "heading"
    assert parse("---\na: 1\n").frontmatter is None
    assert parse("\n---\na\n---\n").frontmatter is None


def test_lists():
    p = parse("- [ ] open\n- [x] done\n\n  more\n")
    top = p.root.children[0]
    assert not top.data["tight"] and [i.data["task"] for i in top.children] == [False, True]
    assert parse("- a\n- b\n").root.children[0].data["tight"]
    nested = parse("+ + +\n").root
    assert [n.kind for n in walk(nested)].count("list") == 3
    assert parse("3. a\n4. b").root.children[0].data["number"] == 3


def test_cells_and_escaped_pipes():
    p = parse("| a | b |\n| --- | :-: |\n| x \\| y | `q` |\n| long | row | cut |\n")
    rows = [[c.lines[0][0] for c in r.children] for r in p.root.children[0].children]
    assert rows == [["a", "b"], ["x \\| y", "`q`"], ["long", "row"]]
    assert p.inlines == []


@pytest.mark.parametrize(
    "text,kind,expected",
    [
        ("*a* **b** ***c*** _d_ snake_case_x", "emph", ["*a*", "***c***", "_d_"]),
        ("*a* **b** ***c***", "strong", ["**b**", "**c**"]),
        ("`` a`b `` and `c`", "codeSpan", ["`` a`b ``", "`c`"]),
        ("[t](u 'x') ![i](j) [no] \\[e](f)", "link", ["[t](u 'x')"]),
        ("<http://a.b> <me@x.org> www.x.com http://y.com/a_(b). z@q.net", "autolink", ["<http://a.b>", "<me@x.org>", "www.x.com", "http://y.com/a_(b)", "z@q.net"]),
        ("[[A]] [[B|c]] [[D|]] [[E#h|x]] [[bad|a|b]]", "wikilink", ["[[A]]", "[[B|c]]", "[[D|]]", "[[E#h|x]]"]),
        ("![[P]] \\![[N]] `![[Q]]`", "wikilink", ["![[P]]", "[[N]]"]),
        ("**not closed *here", "strong", []),
        ("[a [b](c) d](e)", "link", ["[b](c)"]),
        ("<span title='*x*'>*y*</span>", "emph", ["*y*"]),
    ],
)
def test_inlines(text, kind, expected):
    assert sorted(inline(text, kind)) == sorted(expected)


def test_references_and_aliases():
    p = parse("[go][Ref] [ref][] [ref] [none]\n\n[ref]: <http://x y> \"T\"\n")
    assert [(x.data["url"], x.data["title"]) for x in p.inlines if x.kind == "link"] == [("http://x y", "T")] * 3
    got = {x.data["target"]: (x.data["alias"], x.data["embed"]) for x in parse("[[X|]] [[Y]]\n\n| a |\n| - |\n| [[G\\|d]] ![[B]] |\n").inlines}
    assert got == {"X": ("", False), "Y": (None, False), "G": ("d", False), "B": (None, True)}


def test_spans_stay_inside_parents():
    text = "> - a\n>   - b\n>\n> ```\n> c\n> ```\n\n1. x\n\n   y\n2. | p |\n   | - |\n   | q |\n"
    for n in walk(parse(text).root):
        assert 0 <= n.start <= n.end <= len(text)
        if n.parent.kind != "document":
            assert n.parent.start <= n.start and n.end <= n.parent.end


def test_plain_lines_skip_the_general_machine(monkeypatch):
    from quirelake.functions import markdown

    text = "# A\nsome text\nmore\n\n```sql\n# no\n```\n\n* item\n* two\n\n## B\nlast **b** [l](u)\n\n- x\n"
    seen = []
    real = markdown._Blocks.line
    monkeypatch.setattr(markdown._Blocks, "line", lambda self, at, line: seen.append(line) or real(self, at, line))
    p = markdown.parse(text)
    assert not seen
    assert [(n.kind, text[n.start : n.end]) for n in p.root.children] == [("heading", "# A"), ("paragraph", "some text\nmore"), ("codeBlock", "```sql\n# no\n```"), ("list", "* item\n* two"), ("heading", "## B"), ("paragraph", "last **b** [l](u)"), ("list", "- x")]
    whole = [(n.kind, n.start, n.end, n.lines) for n in markdown.walk(p.root)], [(x.kind, x.start, x.end, x.data) for x in p.inlines]
    # the same lines one level down, where the general machine reads them
    lines = text.split("\n")
    quoted = "\n".join("> " + t for t in lines[:-1])
    assert [n.kind for n in markdown.walk(markdown.parse(quoted).root)][1:] == [k for k, *_ in whole[0]] and len(seen) == len(lines) - 1
