"""Two-column detection and reading order, by windows over the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.geometry import Box
from palimpsest.plans.schema import PAGE

def page_window():
    return Window.partitionBy(*PAGE)


def over(x: Column) -> Column:
    return x.over(page_window())


def two_column_divider(blocks: DataFrame, to: str = "divider") -> DataFrame:
    """The x that parts two columns, or null. Takes six blocks, 300 in width, two blocks on each side, five on both, and
    at most 45 % that cross the middle widely."""
    b = Box.of()
    # Measures that are taken together go over the page's rows once.
    out = blocks.withColumns({"_n": over(F.count("*")), "_left": over(F.min("x0")), "_right": F.greatest(over(F.max("x1")), F.lit(0.0))})
    out = out.withColumn("_width", F.greatest(F.col("_right") - F.col("_left"), F.lit(1.0))).withColumn("_mid", F.col("_left") + F.col("_width") * F.lit(0.5))
    wide = (b.x0 < F.col("_mid")) & (b.x1 > F.col("_mid")) & (b.width / F.col("_width") > 0.58)
    on_left = ~wide & (b.center_x < F.col("_mid"))
    n = lambda c: over(F.count(F.when(c, 1)))
    out = out.withColumns({"_l": n(on_left), "_r": n(~wide & ~on_left), "_s": n(wide)})
    ok = (F.col("_n") >= 6) & (F.col("_width") >= 300) & (F.col("_l") >= 2) & (F.col("_r") >= 2) & (F.col("_l") + F.col("_r") >= 5) & (F.col("_s") / F.col("_n") <= 0.45)
    return out.withColumn(to, F.when(ok, F.col("_mid"))).drop("_n", "_left", "_right", "_width", "_mid", "_l", "_r", "_s")


def with_bucket(blocks: DataFrame) -> DataFrame:
    """bucket: 0 spanning above the columns, 1 left, 2 right, 3 spanning amid them, 4 spanning below; 0 in one column.
    Pages of one or two blocks keep their order (bucket null)."""
    b, out = Box.of(), two_column_divider(blocks, "_divider")
    d = F.col("_divider")
    spans = (b.x0 < d) & (b.x1 > d)
    inside = d.isNotNull() & ~spans
    out = out.withColumns({"_top": over(F.min(F.when(inside, b.y0))), "_low": F.greatest(over(F.max(F.when(inside, b.y1))), F.lit(0.0)), "_all": over(F.count("*"))})
    top = F.coalesce(b.y1 <= F.col("_top") + 50.0, F.lit(True))
    bucket = (
        F.when(F.col("_all") <= 2, F.lit(None).cast("int"))
        .when(d.isNull(), 0)
        .when(spans & top, 0)
        .when(spans & (b.y0 >= F.coalesce("_low", F.lit(0.0)) - 30.0), 4)
        .when(spans, 3)
        .when(b.center_x < d, 1)
        .otherwise(2)
    )
    return out.withColumn("bucket", bucket).drop("_divider", "_top", "_low", "_all")


def order_key() -> list[Column]:
    free = F.col("bucket").isNotNull()
    return [F.coalesce("bucket", F.lit(0)), F.when(free, F.col("y0")), F.when(free, F.col("x0")), F.col("seq")]


def reading_order(blocks: DataFrame, to: str = "pos") -> DataFrame:
    """blocks and their place on the page, from 0."""
    keyed = with_bucket(blocks)
    return keyed.withColumn(to, F.row_number().over(page_window().orderBy(*order_key())) - 1)


def detector_order(rects: DataFrame, page: list[str], to: str = "pos") -> DataFrame:
    """The detector's own order of rectangles (x, y, w, h): left column, then right one, if a gap parts two columns."""
    w = Window.partitionBy(*page)
    right_edge, center = F.col("x") + F.col("w"), F.col("x") + F.col("w") / F.lit(2.0)
    out = rects.withColumn("_n", F.count("*").over(w)).withColumn("_width", F.max(right_edge).over(w).cast("double")).withColumn("_mid", F.col("_width") / F.lit(2.0))
    left = (center < F.col("_mid")) & (right_edge < F.col("_width") * F.lit(0.45) + 50)
    right = (center >= F.col("_mid")) & (F.col("x") > F.col("_width") * F.lit(0.55) - 50)
    n = lambda c: F.count(F.when(c, 1)).over(w)
    gap = F.min(F.when(right, F.col("x"))).over(w) - F.max(F.when(left, right_edge)).over(w)
    two = (F.col("_n") >= 4) & (F.col("_width") >= 100) & (n(left) >= 2) & (n(right) >= 2) & F.coalesce(gap > -20, F.lit(False))
    out = out.withColumn("_two", two)
    side = F.when(F.col("_two") & (center >= F.col("_mid")), 1).otherwise(0)
    return out.withColumn(to, F.row_number().over(w.orderBy(side, "y", "x", "seq")) - 1).withColumn("two_column", F.col("_two")).drop("_n", "_width", "_mid", "_two")
