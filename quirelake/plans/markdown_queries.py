"""Queries over Markdown that is made from the tables.

Each order becomes a document: frontmatter, an introduction, a heading, a section for each line item (every
second one level deeper) with links, a region, a fence with a decoy heading and a bullet, and a table. Spark makes
the text and parses it; the SQL twins get the same answers from the tables alone, without any Markdown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelake.operators import formatting as FO
from quirelake.operators import lines as L
from quirelake.operators import reader as R
from quirelake.operators import structure as M
from quirelake.operators import validate as V
from quirelake.session import input_bytes, table


#: Bytes of line items on disk for each task that makes and parses documents: some 25 MB of text.
TASK_BYTES = 1 << 20


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: a document for each order that has line items."""
    items = table(spark, sf_dir, "lineitem")
    # One exchange of narrow rows, made into text where they arrive. The number grows with the input, so that a task stays small; adaptive execution leaves a given number alone.
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(items) // TASK_BYTES)
    items = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").repartition(spread, "l_orderkey")
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    items = items.withColumn("r", r)
    k, p = F.col("r").cast("string"), F.col("l_partkey").cast("string")
    section = F.concat(
        F.when(F.col("r") % 2 == 0, F.lit("### Line ")).otherwise(F.lit("## Line ")), k, F.lit("\nPart [p"), p, F.lit("](http://x.example/"), p, F.lit(") and [[Part "), p, F.lit("|alias "), k, F.lit("]] **bold** <!-- part: "), k, F.lit(" --> body"), F.when(F.col("r") % 4 == 0, F.lit("")).otherwise(F.lit(" <!-- /part -->")),
        F.lit("\n\n```sql\n# not a heading "), k, F.lit("\n```\n\n* item "), k, F.lit("\n\n"),
    )
    row = F.concat(F.lit("| "), p, F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" |\n"))
    made = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("r", section.alias("section"), row.alias("row")))).alias("parts"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    d = made.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("o_orderkey").cast("string")
    return d.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("---\ntitle: Order "), n, F.lit("\nstatus: "), "o_orderstatus", F.lit("\npriority: "), "o_orderpriority", F.lit("\n---\nIntro for order "), n, F.lit(".\n\n# Order "), n, F.lit("\n\n"), F.array_join(F.transform("parts", lambda x: x["section"]), ""), F.when(F.col("o_orderkey") % 3 == 0, F.lit("## Links\n")).otherwise(F.lit("## Table\n")), F.lit("| part | qty |\n| --- | --- |\n"), F.array_join(F.transform("parts", lambda x: x["row"]), "")).alias("content"),
    )


def _parsed(spark: SparkSession, sf_dir: str, *want: str) -> DataFrame:
    return M.parsed(corpus(spark, sf_dir), *want)


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.outline(_parsed(spark, sf_dir, "headings"))


def md_outline(spark, sf_dir):
    return _outline(spark, sf_dir).select("doc_id", "address", "heading", "slug", "level", "line", "end_line", "lines")


def md_outline_tokens(spark, sf_dir):
    """Every section's size, the nested ones' too."""
    return _outline(spark, sf_dir).select("doc_id", "address", "lines", "tokens")


def md_heading_sections(spark, sf_dir):
    h = M.headings(_parsed(spark, sf_dir, "headings"))
    return h.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("parent_ord").alias("with_parent"), F.max(F.col("section_end_line")).alias("last_line"), F.count_if(F.col("sec_end") == F.col("bytes")).alias("to_the_end"))


def section_lookup_numeric(spark, sf_dir):
    return M.resolve(_outline(spark, sf_dir), "1.01.1").select("doc_id", "heading", "line", "end_line")


def section_lookup_slug(spark, sf_dir):
    return M.resolve(_outline(spark, sf_dir), "Line 3").select("doc_id", "address", "line", "candidates")


def shadow_headings(spark, sf_dir):
    return M.shadows(_outline(spark, sf_dir))


def links_all(spark, sf_dir):
    return M.links(_parsed(spark, sf_dir, "inlines")).select("doc_id", "kind", "target", "alias", "line")


def links_wikilinks(spark, sf_dir):
    return M.links(_parsed(spark, sf_dir, "inlines"), wikilinks_only=True).groupBy("doc_id").agg(F.count("*").alias("n"))


def fm_fields(spark, sf_dir):
    got = L.fields(corpus(spark, sf_dir))
    return got.select("doc_id", "key", "value", F.col("line").cast("long").alias("line"))


def fm_body_start(spark, sf_dir):
    return L.body_start_line(corpus(spark, sf_dir)).select("doc_id", F.col("body_start_line").cast("long").alias("body_start_line"))


def coverage_stats(spark, sf_dir):
    return M.corpus_stats(corpus(spark, sf_dir))


def code_blocks(spark, sf_dir):
    got = M.code_blocks(_parsed(spark, sf_dir, "code"))
    return got.select("doc_id", "info", "fence_length", "start_line", "end_line", (F.col("body_end") - F.col("body_start")).alias("body_bytes"))


def regions_pairs(spark, sf_dir):
    return M.regions(_parsed(spark, sf_dir, "regions", "dangling"))[0].select("doc_id", "label", "info", "start_line", "end_line", (F.col("body_end") - F.col("body_start")).alias("body_bytes"))


def regions_dangling(spark, sf_dir):
    return M.regions(_parsed(spark, sf_dir, "regions", "dangling"))[1].select("doc_id", "kind", "label", "line")


def verify_tiling(spark, sf_dir):
    """Counts of violations over the corpus: both are 0."""
    return M.corpus_tiling(corpus(spark, sf_dir))


def format_all(spark, sf_dir):
    got = FO.normal_form(corpus(spark, sf_dir))
    return got.select("doc_id", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"), "changed", F.size("declined").cast("long").alias("declined"))


def format_check(spark, sf_dir):
    """Findings of all rules."""
    found = FO.check(corpus(spark, sf_dir))
    return found.groupBy("doc_id", "rule", "kind").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def partition_report(spark, sf_dir):
    return FO.partition(corpus(spark, sf_dir)).agg(F.count("*").alias("docs"), F.count_if("ok").alias("ok"), F.sum("blocks").alias("blocks"), F.sum(F.col("content_bytes") - F.col("covered_bytes")).alias("uncovered"))


def lede(spark, sf_dir):
    p = M.parsed(corpus(spark, sf_dir), "headings", "content")
    return M.lede(p, p).select("doc_id", "line", "end_line", "lines", "tokens")


def unfold_depth(spark, sf_dir):
    got = R.unfold(corpus(spark, sf_dir), "1", depth=1)
    return got.select("doc_id", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"))


def read_overview(spark, sf_dir):
    """The overview of every document, as the reader prints it."""
    got = R.read(corpus(spark, sf_dir))
    return got.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


def read_section(spark, sf_dir):
    """Section 1.2, or why a document has none."""
    got = R.read(corpus(spark, sf_dir), "1.02")
    return got.select("doc_id", F.get_json_object("json", "$.heading").alias("heading"), F.get_json_object("json", "$.lines").cast("long").alias("lines"), F.get_json_object("json", "$.tokens").cast("long").alias("tokens"), F.get_json_object("json", "$.children[0].heading").alias("child"), "error")


def read_slug(spark, sf_dir):
    got = R.read(corpus(spark, sf_dir), "Line 6")
    return got.select("doc_id", F.get_json_object("json", "$.address").alias("address"), "error")


def read_links(spark, sf_dir):
    """The links as text, with a note where a heading answers to the same word."""
    got = R.read(corpus(spark, sf_dir), "links")
    return got.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), "note")


def read_frontmatter(spark, sf_dir):
    got = R.read(corpus(spark, sf_dir), "fm")
    return got.select("doc_id", "text", F.get_json_object("json", "$.fields[1].value").alias("second"))


def read_value(spark, sf_dir):
    got = R.read(corpus(spark, sf_dir), "frontmatter.priority")
    return got.select("doc_id", "text", "error")


def read_value_missing(spark, sf_dir):
    return R.read(corpus(spark, sf_dir), "fm.title[0]").select("doc_id", "reading", "error")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed documents with some spans spoiled, by doc_id."""
    p = M.parsed(corpus(spark, sf_dir), *V.WANT)

    def spoil(p: DataFrame, kind: int, array: str, test, name: str, value) -> DataFrame:
        spoiled = F.transform(array, lambda x: F.when(test(x), x.withField(name, value(x))).otherwise(x))
        return p.withColumn(array, F.when(F.col("doc_id") % 6 == kind, spoiled).otherwise(F.col(array)))

    p = spoil(p, 1, "inlines", lambda x: x["type"] == "link", "s_end", lambda x: x["s_end"] - 1)
    p = spoil(p, 2, "nodes", lambda x: x["type"] == "codeBlock", "body_end", lambda x: x["s_end"] + 1)
    p = spoil(p, 3, "nodes", lambda x: (x["type"] == "paragraph") & (x["start_line"] == 6), "type", lambda x: F.lit("unknown"))
    p = spoil(p, 4, "headings", lambda x: x["level"] == 1, "s_end", lambda x: x["s_end"] + 3)
    return spoil(p, 5, "inlines", lambda x: x["type"] == "strong", "s_end", lambda x: x["s_end"] + 100_000)


def verify_damaged(spark, sf_dir):
    """Violations found in spoiled parses, by check."""
    return V.violations(_damaged(spark, sf_dir)).groupBy("stage", "rule", "subject").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def check_summary(spark, sf_dir):
    """The verdict over the corpus when some parses are spoiled."""
    return V.summary(V.verify(_damaged(spark, sf_dir)))


def check_region(spark, sf_dir):
    """Unpaired anchors with a label."""
    p = M.parsed(corpus(spark, sf_dir), "regions", "dangling")
    return V.dangling(p, ["part", "other"]).groupBy("kind", "label").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


_C = """
    i as (select l_orderkey as doc_id, l_partkey as pk, l_quantity as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as r from lineitem where l_orderkey in (select o_orderkey from orders)),
    d as (select doc_id, max(r) as c from i group by doc_id)
"""
_OUTLINE = f"""{_C},
    o as (
        select doc_id, '1' as address, 'Order ' || doc_id as heading, 1 as level, 8 as line, 12 + 10 * c as end_line from d
        union all select i.doc_id, case when r % 2 = 1 then '1.' || ((r + 1) // 2) else '1.' || (r // 2) || '.1' end, 'Line ' || r, case when r % 2 = 1 then 2 else 3 end, 1 + 9 * r, case when r % 2 = 1 then 9 + 9 * least(r + 1, c) else 9 + 9 * r end from i join d using (doc_id)
        union all select doc_id, '1.' || ((c + 1) // 2 + 1), case when doc_id % 3 = 0 then 'Links' else 'Table' end, 2, 10 + 9 * c, 12 + 10 * c from d
    )
"""

#: Characters of each item's section, a line feed for each line counted.
_SIZED = f"""{_OUTLINE},
    e as (select doc_id, r, pk, q, 8 + length(r::varchar) + (1 - r % 2) + 1
        + length('Part [p' || pk || '](http://x.example/' || pk || ') and [[Part ' || pk || '|alias ' || r || ']] **bold** <!-- part: ' || r || ' --> body' || case when r % 4 = 0 then '' else ' <!-- /part -->' end) + 1
        + 1 + 7 + length('# not a heading ' || r) + 1 + 4 + 1 + length('* item ' || r) + 1 + 1 as n, length('| ' || pk || ' | ' || q::int || ' |') + 1 as t from i),
    z as (select doc_id, sum(n) as n, sum(t) as t from e group by doc_id),
    s as (
        select doc_id, '1' as address, ((length('# Order ' || doc_id) + 2 + n + t + 38 - 1) // 4)::bigint as tokens, true as more from z
        union all select a.doc_id, case when a.r % 2 = 1 then '1.' || ((a.r + 1) // 2) else '1.' || (a.r // 2) || '.1' end, ((a.n + case when a.r % 2 = 1 then coalesce(b.n, 0) else 0 end - 1) // 4)::bigint, a.r % 2 = 1 and b.n is not null from e a left join e b on a.doc_id = b.doc_id and b.r = a.r + 1
        union all select d.doc_id, '1.' || ((c + 1) // 2 + 1), ((t + 38 - 1) // 4)::bigint, false from d join z using (doc_id)
    ),
    os as (select o.*, s.tokens, s.more, end_line - line + 1 as lines from o join s using (doc_id, address))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (md_outline, md_outline_tokens, md_heading_sections, section_lookup_numeric, section_lookup_slug, shadow_headings, links_all, links_wikilinks, fm_fields, fm_body_start, coverage_stats, code_blocks, regions_pairs, regions_dangling, verify_tiling, format_all, format_check, partition_report, lede, unfold_depth, read_overview, read_section, read_slug, read_links, read_frontmatter, read_value, read_value_missing, verify_damaged, check_summary, check_region)
}

ORACLE_SQL: dict[str, str] = {
    "md_outline": f"with {_OUTLINE} select doc_id, address, heading, lower(replace(heading, ' ', '-')) as slug, level::bigint as level, line::bigint as line, end_line::bigint as end_line, (end_line - line + 1)::bigint as lines from o",
    "md_outline_tokens": f"with {_SIZED} select doc_id, address, lines::bigint as lines, tokens from os",
    "md_heading_sections": f"with {_C} select doc_id, (c + 2)::bigint as n, (c + 1)::bigint as with_parent, (12 + 10 * c)::bigint as last_line, 2::bigint as to_the_end from d",
    "section_lookup_numeric": f"with {_OUTLINE} select doc_id, heading, line::bigint as line, end_line::bigint as end_line from o where address = '1.1.1'",
    "section_lookup_slug": f"with {_OUTLINE} select doc_id, address, line::bigint as line, 1::bigint as candidates from o where heading = 'Line 3'",
    "shadow_headings": f"with {_OUTLINE} select doc_id, 1::bigint as ord, 'links' as reading, address, heading from o where heading = 'Links'",
    "links_all": f"with {_C} select doc_id, 'link' as kind, 'http://x.example/' || pk as target, 'p' || pk as alias, (2 + 9 * r)::bigint as line from i union all select doc_id, 'wikilink', 'Part ' || pk, 'alias ' || r, (2 + 9 * r)::bigint from i",
    "links_wikilinks": f"with {_C} select doc_id, c::bigint as n from d",
    "fm_fields": f"with {_C} select doc_id, k as key, case k when 'title' then 'Order ' || doc_id when 'status' then o_orderstatus else o_orderpriority end as value, line::bigint as line from d join orders on o_orderkey = doc_id cross join (values ('title', 2), ('status', 3), ('priority', 4)) as f(k, line)",
    "fm_body_start": f"with {_C} select doc_id, 6::bigint as body_start_line from d",
    "coverage_stats": f"""with {_C}, t as (select count(*) as docs, sum(c) as c, sum((c + 1) // 2) as odd, sum(c // 2) as even from d)
        select "group", label, n::bigint as n from t, lateral (values ('node', 'paragraph', docs + 2 * c), ('node', 'codeBlock', c), ('node', 'list', c), ('node', 'listItem', c), ('node', 'table', docs), ('node', 'tableRow', docs + c), ('node', 'tableCell', 2 * (docs + c)), ('node', 'heading1', docs), ('node', 'heading2', odd + docs), ('node', 'heading3', even), ('inline', 'link', c), ('inline', 'wikilink', c), ('inline', 'strong', c)) as v("group", label, n) where n > 0""",
    "code_blocks": f"with {_C} select doc_id, 'sql' as info, 3::bigint as fence_length, (4 + 9 * r)::bigint as start_line, (6 + 9 * r)::bigint as end_line, (16 + length(r::varchar))::bigint as body_bytes from i",
    "regions_pairs": f"with {_C} select doc_id, 'part' as label, r::varchar as info, (2 + 9 * r)::bigint as start_line, (2 + 9 * r)::bigint as end_line, 6::bigint as body_bytes from i where r % 4 <> 0",
    "regions_dangling": f"with {_C} select doc_id, 'unpaired-open' as kind, 'part' as label, (2 + 9 * r)::bigint as line from i where r % 4 = 0",
    "verify_tiling": f"with {_C} select count(*) as docs, 0::bigint as overlaps, 0::bigint as gaps from d",
    "format_all": f"""with {_C},
        w as (select doc_id, greatest(4, max(length(pk::varchar))) as w from i group by doc_id),
        t as (select doc_id,
            string_agg(case when r % 2 = 0 then '### Line ' else '## Line ' end || r || chr(10) || chr(10) || 'Part [p' || pk || '](http://x.example/' || pk || ') and [[Part ' || pk || '|alias ' || r || ']] **bold** <!-- part: ' || r || ' --> body' || case when r % 4 = 0 then '' else ' <!-- /part -->' end || chr(10) || chr(10) || '```sql' || chr(10) || '# not a heading ' || r || chr(10) || '```' || chr(10) || chr(10) || '- item ' || r || chr(10) || chr(10), '' order by r) as sections,
            string_agg('| ' || rpad(pk::varchar, w.w::int, ' ') || ' | ' || q::int || ' |' || chr(10), '' order by r) as body, any_value(w.w) as w
            from i join w using (doc_id) group by doc_id)
        select doc_id, sha256('---' || chr(10) || 'title: Order ' || doc_id || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'priority: ' || o_orderpriority || chr(10) || '---' || chr(10) || chr(10) || 'Intro for order ' || doc_id || '.' || chr(10) || chr(10) || '# Order ' || doc_id || chr(10) || chr(10) || sections || case when doc_id % 3 = 0 then '## Links' else '## Table' end || chr(10) || chr(10) || '| ' || rpad('part', w::int, ' ') || ' | qty |' || chr(10) || '| ' || repeat('-', w::int) || ' | --- |' || chr(10) || body) as sha256,
        true as changed, 0::bigint as declined from t join orders on o_orderkey = doc_id""",
    "format_check": f"""with {_C},
        w as (select doc_id, greatest(4, max(length(pk::varchar))) as w from i group by doc_id),
        t as (
            select doc_id, 11 + 9 * c as line from w join d using (doc_id) where w > 4
            union all select doc_id, 12 + 9 * c from d
            union all select i.doc_id, 12 + 9 * c + r from i join w using (doc_id) join d using (doc_id) where length(pk::varchar) < w
        )
        select doc_id, 'gaps' as rule, 'departure' as kind, (c + 2)::bigint as n, 5::bigint as first_line, (10 + 9 * c)::bigint as last_line from d
        union all select doc_id, 'markers', 'departure', c::bigint, 17::bigint, (8 + 9 * c)::bigint from d
        union all select doc_id, 'tables', 'departure', count(*), min(line)::bigint, max(line)::bigint from t group by doc_id""",
    "partition_report": f"with {_C} select count(*) as docs, count(*) as ok, sum(5 + 4 * c)::bigint as blocks, 0::bigint as uncovered from d",
    "lede": f"with {_C} select doc_id, 6::bigint as line, 7::bigint as end_line, 2::bigint as lines, ((length('Intro for order ' || doc_id || '.') + 1) // 4)::bigint as tokens from d",
    "unfold_depth": f"""with {_C},
        p as (select doc_id, r, 'Part [p' || pk || '](http://x.example/' || pk || ') and [[Part ' || pk || '|alias ' || r || ']] **bold** <!-- part: ' || r || ' --> body' || case when r % 4 = 0 then '' else ' <!-- /part -->' end || chr(10) || chr(10) || '```sql' || chr(10) || '# not a heading ' || r || chr(10) || '```' || chr(10) || chr(10) || '* item ' || r || chr(10) as tail, '| ' || pk || ' | ' || q::int || ' |' || chr(10) as line from i),
        t as (select doc_id, string_agg(case when r % 2 = 1 then '## Line ' || r || chr(10) || tail else '      ' || rpad('1.' || (r // 2) || '.1', 6, ' ') || ' ' || rpad('Line ' || r, 14, ' ') || ' L' || (1 + 9 * r) || '   9 lines · ~' || ((length('### Line ' || r) + 1 + length(tail)) // 4) || ' tok' || chr(10) end, '' order by r) as sections, string_agg(line, '' order by r) as body from p group by doc_id)
        select doc_id, sha256('# Order ' || doc_id || chr(10) || sections || case when doc_id % 3 = 0 then '## Links' else '## Table' end || chr(10) || '| part | qty |' || chr(10) || '| --- | --- |' || chr(10) || body) as sha256 from t""",
    "read_overview": f"""with {_SIZED},
        t as (select doc_id, string_agg(case when more then '+ ' else '  ' end || repeat('  ', (length(address) - length(replace(address, '.', '')))::int) || rpad(address, greatest(6, length(address))::int, ' ') || ' ' || rpad(heading, greatest(14, length(heading))::int, ' ') || ' L' || line || '   ' || lines || ' lines · ~' || tokens || ' tok' || chr(10), '' order by line) as tree from os group by doc_id),
        v as (select doc_id, doc_id || chr(10) || 'fields: title, status, priority' || chr(10) || 'links: ' || 2 * c || chr(10) || chr(10) || '  [0]  (text)        L6   2 lines · ~' || ((length('Intro for order ' || doc_id || '.') + 1) // 4) || ' tok' || chr(10) || tree || chr(10)
            || 'next: <addr> a section · fm frontmatter (fm.<path> one value) · links outgoing links' || chr(10) || case when doc_id % 3 = 0 then 'note: ''Links'' (1.' || ((c + 1) // 2 + 1) || ') also answers to a reserved address; reach it by number' || chr(10) else '' end as text from t join d using (doc_id))
        select doc_id, sha256(text) as sha256, length(text)::bigint as chars from v""",
    "read_section": f"with {_SIZED} select d.doc_id, a.heading, a.lines::bigint as lines, a.tokens, b.heading as child, case when a.doc_id is null then 'Address ''1.02'' out of range' end as error from d left join os a on a.doc_id = d.doc_id and a.address = '1.2' left join os b on b.doc_id = d.doc_id and b.address = '1.2.1'",
    "read_slug": f"with {_OUTLINE} select d.doc_id, o.address, case when o.doc_id is null then 'No heading matches slug ''line-6''' end as error from d left join o on o.doc_id = d.doc_id and o.heading = 'Line 6'",
    "read_links": f"""with {_C},
        t as (select doc_id, string_agg('  L' || rpad((2 + 9 * r)::varchar, greatest(5, length((2 + 9 * r)::varchar))::int, ' ') || ' link       http://x.example/' || pk || ' -> p' || pk || chr(10) || '  L' || rpad((2 + 9 * r)::varchar, greatest(5, length((2 + 9 * r)::varchar))::int, ' ') || ' wikilink   Part ' || pk || ' -> alias ' || r || chr(10), '' order by r) as shown from i group by doc_id)
        select doc_id, sha256('links  (outgoing)   ' || 2 * c || ' links' || chr(10) || chr(10) || shown) as sha256, case when doc_id % 3 = 0 then 'heading ''Links'' (1.' || ((c + 1) // 2 + 1) || ') also answers to ''links''' end as note from t join d using (doc_id)""",
    "read_frontmatter": f"with {_C} select doc_id, 'fm  (frontmatter)   L2   3 lines' || chr(10) || chr(10) || 'title: Order ' || doc_id || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'priority: ' || o_orderpriority || chr(10) as text, o_orderstatus as second from d join orders on o_orderkey = doc_id",
    "read_value": f"with {_C} select doc_id, o_orderpriority || chr(10) as text, null::varchar as error from d join orders on o_orderkey = doc_id",
    "read_value_missing": f"with {_C} select doc_id, null::varchar as reading, '''title[0]'': cannot index ''title[0]'' into a non-sequence value; top-level fields: title, status, priority' as error from d",
    "verify_damaged": f"""with {_C}
        select 'inline' as stage, 'grammar' as rule, 'link' as subject, sum(c)::bigint as n, count(*) as docs from d where doc_id % 6 = 1
        union all select 'node', 'nesting', 'body', sum(c)::bigint, count(*) from d where doc_id % 6 = 2
        union all select 'unknown', 'untyped', 'unknown', count(*), count(*) from d where doc_id % 6 = 3
        union all select 'tiling', 'overlap', 'block', count(*), count(*) from d where doc_id % 6 = 4
        union all select 'inline', 'slice', 'strong', sum(c)::bigint, count(*) from d where doc_id % 6 = 5""",
    "check_summary": f"with {_C} select count(*) filter (doc_id % 6 = 0) as files_ok, count(*) as files_checked, 4::bigint as code from d",
    "check_region": f"with {_C} select 'unpaired-open' as kind, 'part' as label, count(*) as n, sum(2 + 9 * r)::bigint as lines from i where r % 4 = 0",
}
