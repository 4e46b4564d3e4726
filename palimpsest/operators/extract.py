"""From a page's extracted texts to one run: best of three modes, cleaned, or none where its Korean is broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.hangul import compose
from palimpsest.plans.schema import PAGE, PAGE_HEIGHT, PAGE_WIDTH, one_line


def best_mode(cands: DataFrame, composed: bool = False) -> DataFrame:
    """(mode_ord, text) by page -> the text of the highest quality, the last mode of equal ones. The order makes ties
    certain; the maximum is combined before the shuffle."""
    c = cands.where("text IS NOT NULL AND text <> ''")
    c = c if composed else c.withColumn("text", compose(F.col("text")))
    best = F.max(F.struct(T.quality(F.col("text"), T.EXTRACT_WEIGHTS).alias("score"), "mode_ord", "text")).alias("b")
    return c.groupBy(*PAGE).agg(best).select(*PAGE, "b.mode_ord", "b.score", "b.text")


def readable(df: DataFrame) -> DataFrame:
    """Cleaned text; pages whose Korean is still broken go, so the optical track decides there."""
    t = df.withColumn("text", T.clean_decomposed_lines(F.col("text"))).where("text <> ''")
    bad = T.has_korean(F.col("text")) & ((T.quality(F.col("text"), T.EXTRACT_WEIGHTS) < -10) | T.degraded(F.col("text")))
    return t.where(~bad)


def parser_blocks(cands: DataFrame, composed: bool = False) -> DataFrame:
    """The parser track of extracted pages: one full-page text block each (the box of a page's only run)."""
    t = readable(best_mode(cands, composed))
    lit = lambda v: F.lit(float(v))
    box = (lit(0), lit(0), lit(PAGE_WIDTH), lit(PAGE_HEIGHT))
    return t.select(
        *PAGE, F.lit("parser").alias("track"), F.lit(0).alias("seq"), F.lit("text").alias("type"),
        *[v.alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)], "text",
        one_line(F.col("text"), F.lit("parser"), *box).alias("lines"), F.lit(0.6).alias("confidence"), F.lit("parser").alias("source"), F.lit(None).cast("string").alias("latex"),
    )
