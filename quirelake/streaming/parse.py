"""The parse over a stream of (doc_id, content): an extension, stateless, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quirelake.operators import structure


def read(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def parse_to(docs: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the parsed documents to ``folder``; ``once`` takes what is there and ends."""
    out = structure.parsed(docs).writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
