"""The whole fusion: class, alignment, resolution, filters, order. One shuffle, on the page key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.align import align
from palimpsest.operators.classify import page_class, signals
from palimpsest.operators.order import reading_order
from palimpsest.operators.resolve import apply_filters, merge
from palimpsest.plans.schema import PAGE, PAGE_AREA, PAGE_HEIGHT, PAGE_WIDTH
from palimpsest.runtime import stack


def aligned(blocks: DataFrame) -> DataFrame:
    """Aligned rows with the page's class, taken in the same aggregation as the alignment's arrays."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    glyphs = lambda t: F.coalesce(F.sum(F.when((F.col("track") == t) & (F.col("type") == "text"), size)), F.lit(0))
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    cover = F.coalesce(F.max(F.when(F.col("track") == "ocr", w * h)), F.lit(0.0)) / F.lit(PAGE_AREA)
    rows = align(blocks, glyphs("parser").alias("_p"), glyphs("ocr").alias("_o"), F.greatest(F.least(cover, F.lit(1.0)), F.lit(0.0)).alias("_c"))
    density = F.least(F.col("_o") / F.lit(1000.0), F.lit(1.0))
    return rows.withColumn("class", page_class("_p", "_o", "_c", density)).drop("_p", "_o", "_c")


def fuse(blocks: DataFrame) -> DataFrame:
    """Both tracks' blocks -> fused blocks with class, place on the page (pos), provenance, confidence and debug texts."""
    return reading_order(apply_filters(merge(aligned(blocks))))


def page_list(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Page key, class, width and height of every page there is: those that have blocks and those that `pages` names
    (page key, width, height; one row a track and page). A page is as large as its larger track says, and of the usual size
    where none says anything. A page without blocks is hybrid, as the class rules make it."""
    none = F.lit(None).cast("int")
    sized = signals(blocks).select(*PAGE, page_class().alias("class"), none.alias("width"), none.alias("height"))
    if pages is not None:
        zero = F.lit(0.0)
        empty = page_class(zero, zero, zero, zero)
        named = pages.select(*PAGE, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
        both = stack(sized, named, PAGE)
        sized = both.groupBy(*PAGE).agg(F.coalesce(F.max("class"), F.any_value(empty)).alias("class"), F.max("width").alias("width"), F.max("height").alias("height"))
    return sized.select(*PAGE, "class", F.coalesce("width", F.lit(PAGE_WIDTH)).alias("width"), F.coalesce("height", F.lit(PAGE_HEIGHT)).alias("height"))
