"""The corpus pipeline: documents through five stages to a training mixture.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again as the next one's docs.

Defined results. The first four stages keep all columns, whatever their names; the last adds pool, epoch and
tokens, which take the place of columns so named. A null, empty or wordless text has no language and goes at the first stage; texts
are read whole. Rows with a null doc_id are judged by language and toxicity like others; near-dedup and decontamination, which
decide by doc_id, keep them. Repeated rows get one verdict; near-dedup keeps one of a doc_id, and of a
group the smallest doc_id. Empty tables give empty results with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm import langid, lsi, mixing, neardup, toxicity
from quirelake.session import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; undetermined ones go."""
    return langid.keep_known(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; voters are mined from ``labels``."""
    return toxicity.keep_clean(docs, labels=table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return lsi.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns and pool, epoch, tokens: a row for each selected pass."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
]

#: Trained models, tree search and flows are beyond SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
