"""Registered queries of the Markdown engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import lines as L
from quirelake.operators import search as S
from quirelake.plans import markdown_queries
from quirelake.session import table

FLAGSHIP = "bm25_topk"
QUERY_TEXT = "the worthless tion, und moron"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("title"), F.substring_index("text", "\n", 1).alias("description"), F.col("text").alias("body"))


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def _mixed_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a third of them in each style of line ending."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat("role", F.lit("\n"), "text")
    old = F.when(F.col("turn") % 3 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).when(F.col("turn") % 3 == 1, F.replace(text, F.lit("\n"), F.lit("\r"))).otherwise(text)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), old.alias("content"))


def _ranked(spark, sf_dir, query, weights):
    got = S.bm25(_docs(spark, sf_dir), query, weights, stemmed=False)
    return got.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


def bm25_topk(spark, sf_dir):
    return _ranked(spark, sf_dir, QUERY_TEXT, {"body": 1.0})


def bm25_multi_field(spark, sf_dir):
    return _ranked(spark, sf_dir, "src3 the moron", S.WEIGHTS)


def bm25_repeated_term(spark, sf_dir):
    return _ranked(spark, sf_dir, "idiot idiot the", {"body": 1.0})


def bm25_zero_weight(spark, sf_dir):
    got = S.bm25(_docs(spark, sf_dir), "src3 clown", {"title": 1.0, "description": 0.0, "body": 1.0}, stemmed=False)
    return got.select("doc_id", F.round("score", 6).alias("score"))


def postings_tf(spark, sf_dir):
    return S.postings(_docs(spark, sf_dir))


def term_document_frequency(spark, sf_dir):
    return S.postings(_docs(spark, sf_dir)).groupBy("field", "term").agg(F.count("*").alias("df"))


def field_length_stats(spark, sf_dir):
    d = _docs(spark, sf_dir)
    sizes = d.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(T.tokens(f)).alias("len")) for f in S.WEIGHTS))).alias("x"))
    return sizes.groupBy("x.field").agg(F.count("*").alias("docs"), F.sum("x.len").alias("terms"), F.round(F.avg("x.len"), 6).alias("avg_len"), F.max("x.len").cast("long").alias("max_len"))


def stemmed_search(spark, sf_dir):
    """The whole ranking with stemming and snippets; only the top is joined to text."""
    return S.search(_docs(spark, sf_dir), "clowns worthlessly", 10)


def token_estimate(spark, sf_dir):
    return _content(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("content")).alias("tokens"))


def corpus_bytes_sha256(spark, sf_dir):
    return _content(spark, sf_dir).select("doc_id", F.octet_length("content").cast("long").alias("bytes"), F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"))


def line_table(spark, sf_dir):
    return L.lines(_content(spark, sf_dir)).select("doc_id", F.col("line").cast("long").alias("line"), "b_start", "b_end", F.length("text").cast("long").alias("chars"))


def line_offsets(spark, sf_dir):
    got = L.lines(_mixed_endings(spark, sf_dir))
    return got.select("doc_id", F.col("line").cast("long").alias("line"), "b_start", "b_end", F.octet_length("eol").cast("long").alias("eol_bytes"))


def endings_lf(spark, sf_dir):
    return _mixed_endings(spark, sf_dir).select("doc_id", F.sha2(F.encode(T.to_lf(F.col("content")), "UTF-8"), 256).alias("sha256"))


def endings_departures(spark, sf_dir):
    got = L.ending_changes(_mixed_endings(spark, sf_dir))
    return got.select("doc_id", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "offset", T.escape_whitespace(F.col("old")).alias("old"))


def _names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    decorated = F.concat(F.lit("The `"), "p_name", F.lit("`: [[Dir/Note "), F.col("p_partkey").cast("string"), F.lit("#Sec "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("|"), "p_brand")).otherwise(""), F.lit("]] & *"), "p_type", F.lit("*"))
    return p.select("p_partkey", decorated.alias("name"), F.col("p_name"), F.col("p_size"), F.col("p_brand"))


def slugify(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", T.slug(F.col("name")).alias("slug"))


def wikilink_strip(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", T.strip_wikilinks(F.col("name")).alias("plain"))


def _targets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    return p.select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("a/b/"), k, F.lit(".md"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("N"), k, F.lit("#^blk"), k)).when(F.col("p_size") % 4 == 2, F.concat(F.lit("N"), k, F.lit("#Head#Sub"))).otherwise(F.concat(F.lit("N"), k, F.lit("#"))).alias("url"))


def wikilink_decompose(spark, sf_dir):
    parts = T.decompose(F.col("url"))
    return _targets(spark, sf_dir).select("p_partkey", *(v.alias(k) for k, v in parts.items()), T.resolve_name(F.col("url")).alias("name"))


def _addresses(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_size").cast("string")
    cases = [k, F.concat(k, F.lit("."), k), F.concat(k, F.lit(".")), F.lit("LINKS"), F.concat(F.lit("FM.Key"), k, F.lit("[0].X")), F.lit("fm."), F.lit("Text"), F.lit("0"), F.lit("frontMatter"), F.concat(F.lit("slug-"), k)]
    return p.select("p_partkey", F.element_at(F.array(*cases), (F.col("p_partkey") % len(cases) + 1).cast("int")).alias("address"))


def address_grammar(spark, sf_dir):
    a = F.col("address")
    return _addresses(spark, sf_dir).select("p_partkey", "address", T.is_numeric_address(a).alias("numeric"), T.reserved_reading(a).alias("reading"), T.reserved_path(a).alias("path"))


def truncate_heading(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", T.truncate_heading(F.concat("name", F.lit(" é"))).alias("short"))


_FIELD_CTE = """
    d as (select doc_id, source as title, split_part(text, chr(10), 1) as description, text as body from documents),
    f as (select doc_id, 'title' as field, title as v from d union all select doc_id, 'description', description from d union all select doc_id, 'body', body from d),
    t as (select doc_id, field, unnest(list_transform(list_filter(regexp_split_to_array(coalesce(v, ''), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' and strlen(x) < 40), lambda x: lower(x))) as term from f),
    l as (select doc_id, field, len(list_filter(regexp_split_to_array(coalesce(v, ''), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' and strlen(x) < 40)) as dl from f)
"""


def _bm25_sql(terms: list[str], weights: dict[str, float], top: bool) -> str:
    asked = ", ".join(f"('{t}')" for t in terms)
    weight = ", ".join(f"('{f}', {w}::double)" for f, w in weights.items())
    return f"""
    with {_FIELD_CTE},
    q as (select * from (values {asked}) as q(term)),
    w as (select * from (values {weight}) as w(field, weight)),
    p as (select doc_id, field, term, count(*) as tf from t where term in (select term from q) group by all),
    s as (select field, term, count(*) as df from p group by all),
    n as (select field, count(*) as n, avg(dl) as avgdl from l group by field)
    select p.doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
    from q join p using (term) join w using (field) join s using (field, term) join n using (field) join l on l.doc_id = p.doc_id and l.field = p.field
    group by p.doc_id {"order by sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) desc, p.doc_id limit 10" if top else ""}
    """


_LINES_SQL = r"""
    rows as (select doc_id, unnest(regexp_extract_all(content, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$')) as whole, generate_subscripts(regexp_extract_all(content, '[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$'), 1) as line from c),
    parts as (select doc_id, line, whole, regexp_extract(whole, '(\r\n|\r|\n)$', 1) as eol from rows),
    sums as (select doc_id, line, whole, eol, coalesce(sum(strlen(whole)) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0)::bigint as b_start from parts)
"""
_ENDINGS_CTE = "c as (select conv_id * 1000 + turn as doc_id, case turn % 3 when 0 then replace(role || chr(10) || text, chr(10), chr(13) || chr(10)) when 1 then replace(role || chr(10) || text, chr(10), chr(13)) else role || chr(10) || text end as content from conversations)"
_NAMES_CTE = "names as (select p_partkey, 'The `' || p_name || '`: [[Dir/Note ' || p_partkey || '#Sec ' || p_size || case when p_size % 2 = 0 then '|' || p_brand else '' end || ']] & *' || p_type || '*' as name from part)"
_STRIP = r"regexp_replace(regexp_replace(name, '\[\[([^\]|]+)\|([^\]]*)\]\]', '\2', 'g'), '\[\[([^\]|]+)\]\]', '\1', 'g')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (bm25_topk, bm25_multi_field, bm25_repeated_term, bm25_zero_weight, postings_tf, term_document_frequency, field_length_stats, stemmed_search, token_estimate, corpus_bytes_sha256, line_table, line_offsets, endings_lf, endings_departures, slugify, wikilink_strip, wikilink_decompose, address_grammar, truncate_heading)
} | markdown_queries.QUERIES

ORACLE_SQL: dict[str, str] = {
    "bm25_topk": _bm25_sql(["the", "worthless", "tion", "und", "moron"], {"body": 1.0}, True),
    "bm25_multi_field": _bm25_sql(["src3", "the", "moron"], S.WEIGHTS, True),
    "bm25_repeated_term": _bm25_sql(["idiot", "idiot", "the"], {"body": 1.0}, True),
    "bm25_zero_weight": _bm25_sql(["src3", "clown"], {"title": 1.0, "description": 0.0, "body": 1.0}, False),
    "postings_tf": f"with {_FIELD_CTE} select doc_id, field, term, count(*) as tf from t group by all",
    "term_document_frequency": f"with {_FIELD_CTE} select field, term, count(distinct doc_id) as df from t group by all",
    "field_length_stats": f"with {_FIELD_CTE} select field, count(*) as docs, sum(dl)::bigint as terms, round(avg(dl), 6) as avg_len, max(dl) as max_len from l group by field",
    "token_estimate": "select doc_id, length(text) // 4 as tokens from documents",
    "corpus_bytes_sha256": "select doc_id, strlen(text)::bigint as bytes, sha256(text) as sha256 from documents",
    "line_table": f"with c as (select doc_id, text as content from documents), {_LINES_SQL} select doc_id, line, b_start, b_start + strlen(whole) - strlen(eol) as b_end, length(whole) - length(eol) as chars from sums",
    "line_offsets": f"with {_ENDINGS_CTE}, {_LINES_SQL} select doc_id, line, b_start, b_start + strlen(whole) - strlen(eol) as b_end, strlen(eol)::bigint as eol_bytes from sums",
    "endings_lf": "select conv_id * 1000 + turn as doc_id, sha256(role || chr(10) || text) as sha256 from conversations",
    "endings_departures": f"with {_ENDINGS_CTE}, {_LINES_SQL} select doc_id, line, strlen(whole) - strlen(eol) + 1 as \"column\", b_start + strlen(whole) - strlen(eol) as \"offset\", case eol when chr(13) then '\"\\r\"' else '\"\\r\\n\"' end as old from sums where eol in (chr(13), chr(13) || chr(10))",
    "slugify": f"with {_NAMES_CTE} select p_partkey, trim(regexp_replace(lower(translate({_STRIP}, '`*_', '')), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-') as slug from names",
    "wikilink_strip": f"with {_NAMES_CTE} select p_partkey, {_STRIP} as plain from names",
    "wikilink_decompose": """select p_partkey, case p_size % 4 when 0 then 'a/b/' || p_partkey || '.md' else 'N' || p_partkey end as page, case p_size % 4 when 2 then 'Head#Sub' end as heading, case p_size % 4 when 1 then 'blk' || p_partkey end as block, case p_size % 4 when 0 then p_partkey::varchar else 'N' || p_partkey end as name from part""",
    "address_grammar": """with a as (select p_partkey, p_size::varchar as k, (p_partkey % 10)::int as c from part)
        select p_partkey, case c when 0 then k when 1 then k || '.' || k when 2 then k || '.' when 3 then 'LINKS' when 4 then 'FM.Key' || k || '[0].X' when 5 then 'fm.' when 6 then 'Text' when 7 then '0' when 8 then 'frontMatter' else 'slug-' || k end as address,
        c in (0, 1, 7) as "numeric", case when c = 3 then 'links' when c = 4 then 'field' when c in (6, 7) then 'text' when c = 8 then 'frontmatter' when c = 0 and k = '0' then 'text' end as reading, case c when 4 then 'Key' || k || '[0].X' end as path from a""",
    "truncate_heading": f"with {_NAMES_CTE} select p_partkey, case when length(name || ' é') > 30 then left(name || ' é', 29) || '…' else name || ' é' end as short from names",
} | markdown_queries.ORACLE_SQL
