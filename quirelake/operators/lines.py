"""Lines, byte offsets, line endings and frontmatter fields as relational operators on (doc_id, content).

A line ends at ``\\n``, ``\\r\\n`` or a lone ``\\r``; there's no line after the last ending. Offsets
are bytes from 0, line numbers count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LINE = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\z"


def line_array(content: Column) -> Column:
    """Lines with their endings."""
    return F.regexp_extract_all(content, F.lit(_LINE), F.lit(0))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, text, b_start, b_end (of the text), eol. One exchange on doc_id serves the running sum."""
    found = docs.select("doc_id", line_array(F.col("content")).alias("raw"))
    rows = found.select("doc_id", F.posexplode("raw").alias("i", "whole"))
    eol = F.regexp_extract("whole", r"(\r\n|\r|\n)\z", 1)
    text = F.regexp_replace("whole", r"(\r\n|\r|\n)\z", "")
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("doc_id", "i", text.alias("text"), eol.alias("eol"), F.octet_length("whole").cast("long").alias("size"))
    start = F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")
    return rows.select("doc_id", (F.col("i") + 1).alias("line"), "text", start.alias("b_start"), (start + F.octet_length("text")).alias("b_end"), "eol")


def ending_changes(docs: DataFrame) -> DataFrame:
    """doc_id, line, column (bytes, from 1), offset, old: each ending that isn't ``\\n``."""
    found = lines(docs.where(F.col("content").contains("\r")))
    return found.where("eol in ('\\r\\n', '\\r')").select("doc_id", "line", (F.col("b_end") - F.col("b_start") + 1).alias("column"), F.col("b_end").alias("offset"), F.col("eol").alias("old"))


#: A text that opens with a frontmatter block, and one up to the block's closing line. The text after that isn't looked at.
_OPENS = r"\A[ \t]*---[ \t\r]*(\n|\z)"
_CLOSED = r"(?s)\A[ \t]*---[ \t\r]*(?=\n).*?\n[ \t\r]*---[ \t\r]*(?=\n|\z)"


def _plain() -> Column:
    """The content without a BOM."""
    return F.regexp_replace("content", "\\A\\x{FEFF}", "")


def _closed_at(block: Column) -> Column:
    """Number of the last line of a closed block; null for an empty text."""
    return F.when(block != "", F.length(block) - F.length(F.replace(block, F.lit("\n"), F.lit(""))) + 1)


def frontmatter_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, text of the lines that could be a frontmatter block: from an opening ``---`` on the first line to the closing one, or to the end; and closed_at, the closing line's number or null."""
    head = docs.select("doc_id", _plain().alias("plain"))
    head = head.select("doc_id", F.when(F.col("plain").rlike(_OPENS), F.col("plain")).alias("plain"), F.regexp_extract("plain", _CLOSED, 0).alias("block"))
    head = head.select("doc_id", F.split(F.when(F.col("block") != "", F.col("block")).otherwise(F.col("plain")), "\n").alias("all"), _closed_at(F.col("block")).alias("closed_at"))
    inner = F.slice("all", 2, F.greatest(F.size("all") - F.when(F.col("closed_at").isNotNull(), 2).otherwise(1), F.lit(0)))
    # no filter on the text: it would be pushed below the step that makes the text, and make it twice
    rows = head.select("doc_id", "closed_at", F.posexplode(F.when(F.size(inner) == 0, F.array(F.lit(None).cast("string"))).otherwise(inner)).alias("i", "text"))
    return rows.select("doc_id", "closed_at", F.when(F.col("text").isNotNull(), F.col("i") + 2).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def body_start_line(docs: DataFrame) -> DataFrame:
    """doc_id, body_start_line: after a closed frontmatter block, else 1. Rows stay where they are."""
    closed = docs.select("doc_id", _closed_at(F.regexp_extract(_plain(), _CLOSED, 0)).alias("closed_at"))
    return closed.select("doc_id", F.coalesce(F.col("closed_at") + 1, F.lit(1)).cast("int").alias("body_start_line"))


def fields(docs: DataFrame) -> DataFrame:
    """doc_id, ord, key, value, line of the frontmatter's top-level keys, also of an unclosed block. A value on the key's line wins over lines below it; those are dedented and joined."""
    rows = frontmatter_lines(docs).where("text is not null")
    key = F.regexp_extract("text", r"^([^\s#:][^:]*):", 1)
    rows = rows.withColumn("key", F.when(key != "", F.trim(key)))
    rows = rows.withColumn("n", F.count("key").over(Window.partitionBy("doc_id").orderBy("line")))
    rows = rows.where("n > 0 and text not rlike '^#'")
    inline = F.trim(F.regexp_replace("text", r"^[^:]*:", ""))
    indent = F.length(F.regexp_extract("text", r"^([ \t]*)", 1))
    more = F.when(F.col("key").isNull() & (F.trim("text") != ""), F.struct("line", indent.alias("indent"), "text"))
    got = rows.groupBy("doc_id", "n").agg(F.max("key").alias("key"), F.max(F.when(F.col("key").isNotNull(), inline)).alias("inline"), F.min(F.when(F.col("key").isNotNull(), F.col("line"))).alias("line"), F.sort_array(F.collect_list(more)).alias("more"))
    least = F.array_min(F.transform("more", lambda m: m["indent"]))
    block = F.array_join(F.transform("more", lambda m: m["text"].substr(least + 1, F.length(m["text"]))), "\n")
    return got.select("doc_id", F.col("n").cast("int").alias("ord"), "key", F.when(F.col("inline") != "", F.col("inline")).otherwise(block).alias("value"), F.col("line").cast("int").alias("line"))
