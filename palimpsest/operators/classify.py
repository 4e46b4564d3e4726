"""Page signals and page class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.geometry import Box
from palimpsest.plans.schema import PAGE, PAGE_AREA


def signals(blocks: DataFrame) -> DataFrame:
    """Per page: UTF-8 bytes of text by track, largest optical block over the page, text density. One partial aggregate."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    glyphs = lambda t: F.coalesce(F.sum(F.when((F.col("track") == t) & (F.col("type") == "text"), size)), F.lit(0)).cast("long")
    cover = F.coalesce(F.max(F.when(F.col("track") == "ocr", Box.of().area)), F.lit(0.0)) / F.lit(PAGE_AREA)
    out = blocks.groupBy(*PAGE).agg(glyphs("parser").alias("parser_glyphs"), glyphs("ocr").alias("ocr_glyphs"), F.greatest(F.least(cover, F.lit(1.0)), F.lit(0.0)).alias("image_coverage"))
    return out.withColumn("ocr_text_density", F.least(F.col("ocr_glyphs") / F.lit(1000.0), F.lit(1.0)))


def page_class(p: Column | str = "parser_glyphs", o: Column | str = "ocr_glyphs", coverage: Column | str = "image_coverage", density: Column | str = "ocr_text_density") -> Column:
    """The rules in order: the first that holds decides."""
    p, o, c, d = (F.col(x) if isinstance(x, str) else x for x in (p, o, coverage, density))
    return (
        F.when((p >= 120) & (p >= o * 2), "digital")
        .when((o >= p * 2) & ((d > 0.35) | (c > 0.3)), "scanned")
        .when((p > 220) & (d < 0.25) & (c < 0.25), "digital")
        .otherwise("hybrid")
    )


def classify(blocks: DataFrame) -> DataFrame:
    return signals(blocks).withColumn("class", page_class())
