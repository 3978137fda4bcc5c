"""Queries of the subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import langid, license_scan, lsi, mixing, neardup, ogg, suffix_tree, tokens, toxicity, warc
from quirelake.session import table


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsi.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ogg.streams(ogg.encode_texts(table(spark, sf_dir, "documents"), damaged=True))
    return got.select("doc_id", "serial", "codec", "packets", "payload_bytes", "bad_pages", "lost_runs", "end_granule", "seconds", F.array_join("page_granules", ",").alias("page_granules"), F.round(F.array_max("page_seconds"), 6).alias("last_page_seconds"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_neardup, op2_token_counts, op3_decontamination, op4_warc, op5_mixing, op6_lm_scoring, op7_ogg, op8_language_id, op9_license_scan, op10_toxicity)
}

ORACLE_SQL: dict[str, str] = {
    "op7_ogg": """
        with recursive lines as (
            select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i
            from documents where text is not null
        ), packets as (
            -- lacing values and bytes of each packet after the head, and the stream's granule position at its end
            select doc_id, (i % 2)::bigint as serial, i // 2 + 1 as number, strlen(line) as size, strlen(line) // 255 + 1 as lacing,
                sum(length(line)) over (partition by doc_id, i % 2 order by i) * 960 as granule
            from lines
        ), laid as (
            -- what each page holds after a packet: lacing values, bytes, last granule; the granules of the pages that were closed
            select doc_id, serial, 0::bigint as number, 0::bigint as lacing, 0::bigint as size, null::bigint as granule, '0' as closed
            from documents cross join (select unnest([0, 1])::bigint as serial) where text is not null
            union all
            select doc_id, serial, number, case when full_now then 0 else lacing end, case when full_now then 0 else size end,
                case when full_now then null else granule end, case when full_now then closed || ',' || granule else closed end
            from (
                select p.doc_id, p.serial, p.number, p.granule::bigint as granule,
                    l.lacing + p.lacing - 255 * pages as lacing,
                    case when pages = 0 then l.size + p.size else p.size - 255 * (p.lacing - (l.lacing + p.lacing - 255 * pages)) end as size,
                    case when pages > 0 and l.granule is not null then l.closed || ',' || l.granule else l.closed end as closed,
                    (case when pages = 0 then l.size + p.size else p.size - 255 * (p.lacing - (l.lacing + p.lacing - 255 * pages)) end) >= 4096 as full_now
                from laid l join packets p on p.doc_id = l.doc_id and p.serial = l.serial and p.number = l.number + 1,
                    lateral (select (l.lacing + p.lacing - 1) // 255 as pages)
            )
        ), pages as (
            select doc_id, serial, arg_max(case when granule is null then closed else closed || ',' || granule end, number) as page_granules
            from laid group by all
        ), sums as (
            select doc_id, serial, count(*) as n, sum(size) as bytes, max(granule) as granule from packets group by all
        )
        select s.doc_id, s.serial, case when s.serial = 1 then 'vorbis' when not cut then 'opus' end as codec,
            (coalesce(n, 0) + 1 - cut::int)::bigint as packets,
            (coalesce(bytes, 0) + case when s.serial = 1 then 30 when cut then 0 else 19 end)::bigint as payload_bytes,
            (doc_id % 5 in (2, 3))::bigint as bad_pages, cut::bigint as lost_runs, coalesce(granule, 0)::bigint as end_granule,
            case when s.serial = 1 then coalesce(granule, 0)::double / 16000 when not cut then greatest(0, coalesce(granule, 0) - 312)::double / 48000 end as seconds,
            case when cut then substr(page_granules, 3) else page_granules end as page_granules,
            round(case when s.serial = 1 then coalesce(granule, 0)::double / 16000 when not cut then greatest(0, coalesce(granule, 0) - 312)::double / 48000 end, 6) as last_page_seconds
        from (select *, serial = 0 and doc_id % 5 = 2 as cut from pages) s left join sums using (doc_id, serial)
    """,
}
