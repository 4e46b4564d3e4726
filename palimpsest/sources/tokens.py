"""The recognizer's wire format: JSON tokens, alone or in the output of a process that also logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.schema import PAGE, one_line

TOKEN = "array<struct<text:string,bbox:array<double>,confidence:double,block_type:string,latex:string>>"


def payload(out: Column) -> Column:
    """The whole output if it begins like JSON, else its last line that does; null if none does."""
    strip = lambda c: F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")
    lines = F.filter(F.transform(F.split(out, "\\r?\\n"), strip), lambda x: x.rlike("^[\\[{]"))
    return F.when(strip(out).rlike("^[\\[{]"), strip(out)).otherwise(F.try_element_at(lines, F.lit(-1)))


def read_tokens(outputs: DataFrame, column: str = "output") -> DataFrame:
    """Page rows with a process's output -> one row a token, with defaults for what is missing."""
    t = F.from_json(payload(F.col(column)), TOKEN)
    rows = outputs.select(*PAGE, F.posexplode(t).alias("seq", "t"))
    at = lambda i: F.get("t.bbox", F.lit(i))
    return rows.select(
        *PAGE, "seq", F.coalesce("t.text", F.lit("")).alias("text"), at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"),
        F.coalesce("t.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("t.block_type", F.lit("text")).alias("block_type"), F.col("t.latex").alias("latex"),
    )


def to_blocks(tokens: DataFrame) -> DataFrame:
    """The optical track: a token is a table, figure or math block by its kind and a text block otherwise."""
    kind = F.when(F.col("block_type").isin("table", "figure", "math"), F.col("block_type")).otherwise("text")
    is_text = kind == "text"
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return tokens.select(
        *PAGE, F.lit("ocr").alias("track"), F.col("seq").cast("int").alias("seq"), kind.alias("type"), *box, F.when(is_text, F.col("text")).alias("text"),
        F.when(is_text, one_line(F.col("text"), F.lit("ocr"), *box)).alias("lines"), F.greatest(F.least("confidence", F.lit(1.0)), F.lit(0.0)).alias("confidence"),
        F.lit("ocr").alias("source"), F.when(kind == "math", F.nullif(F.col("latex"), F.lit(""))).alias("latex"),
    )
