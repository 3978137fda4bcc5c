from quirelake.plans import markdown_queries as Q

SF = "/root/testdata/sf0.001"


def test_every_document_has_its_table_findings(spark):
    docs = {r.doc_id: r.content for r in Q.corpus(spark, SF).collect()}
    got = Q.QUERIES["format_check"](spark, SF).where("rule = 'tables' and kind = 'departure'").collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        lines = docs[r.doc_id].split("\n")
        assert all(lines[i - 1].startswith("|") for i in (r.first_line, r.last_line))


def test_tokens_of_every_section(spark):
    docs = {r.doc_id: r.content.split("\n") for r in Q.corpus(spark, SF).collect()}
    sizes = {(r.doc_id, r.address): (r.lines, r.tokens) for r in Q.QUERIES["md_outline_tokens"](spark, SF).collect()}
    places = Q.QUERIES["md_outline"](spark, SF).collect()
    assert len(sizes) == len(places) and any("." in r.address for r in places)
    for r in places:
        part = docs[r.doc_id][r.line - 1 : r.end_line]
        lines, tokens = sizes[r.doc_id, r.address]
        assert lines == len(part)
        assert tokens == len("\n".join(part)) // 4
