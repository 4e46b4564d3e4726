"""Greedy one-to-one alignment of the two tracks of a page, as one fold in the JVM.

Parser blocks choose in their order: the unused optical block of the highest score (overlap, a bonus for the same kind,
less distance), which must be above 0; the first of equal ones. The choice holds if they overlap by more than 0.1 or their
centres are within 150; otherwise the block stays alone and takes no second choice.

A page's blocks meet in one row by the only shuffle of the whole fusion, on the page key. A row's size is a page's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.geometry import Box, center_distance, intersection, iou
from palimpsest.plans.schema import PAGE, block

KIND_BONUS, DISTANCE_SCALE, LEAST_IOU, MOST_DISTANCE = 0.1, 10000.0, 0.1, 150.0


def pages(blocks: DataFrame, *extra: Column) -> DataFrame:
    """One row a page with both tracks' blocks in order (empty where a track has none)."""
    side = lambda t: F.array_sort(F.collect_list(F.when(F.col("track") == t, block())))
    return blocks.groupBy(*PAGE).agg(side("parser").alias("ps"), side("ocr").alias("os"), *extra)


def score(p: Column, o: Column) -> Column:
    return iou(Box.of(p), Box.of(o)) + F.when(p["type"] == o["type"], F.lit(KIND_BONUS)).otherwise(F.lit(0.0)) - center_distance(Box.of(p), Box.of(o)) / F.lit(DISTANCE_SCALE)


def _shape(b: Column, i: Column) -> Column:
    """What the fold needs of a block, each measure made once."""
    box = Box.of(b)
    return F.struct(i.alias("i"), b["type"].alias("type"), *(v.alias(n) for n, v in zip(Box._fields, box, strict=True)), box.area.alias("area"), box.center_x.alias("cx"), box.center_y.alias("cy"))


def _pairs(ps: Column, os: Column) -> Column:
    """The fold carries the optical blocks that are still free. Lambdas are interpreted, so each measure of a pair is bound
    once, by a transformation of its own: overlap and distance, then their ratio, then the score (as in score())."""
    start = F.struct(F.transform(os, _shape).alias("free"), F.array().cast("array<struct<pi:int,oi:int,iou:double,dist:double>>").alias("pairs"))

    def step(acc: Column, p: Column) -> Column:
        def meet(o: Column) -> Column:
            dx, dy = p["cx"] - o["cx"], p["cy"] - o["cy"]
            return F.struct(o["i"].alias("oi"), intersection(Box.of(p), Box.of(o)).alias("both"), (p["area"] + o["area"]).alias("sum"), F.sqrt(dx * dx + dy * dy).alias("dist"), F.when(p["type"] == o["type"], F.lit(KIND_BONUS)).otherwise(F.lit(0.0)).alias("bonus"))

        def rate(m: Column) -> Column:
            joint = F.when(m["both"] == 0, F.lit(0.0)).otherwise(m["both"] / (m["sum"] - m["both"]))
            return F.struct(m["oi"].alias("oi"), m["bonus"].alias("bonus"), joint.alias("iou"), m["dist"].alias("dist"))

        measured = F.transform(F.transform(acc["free"], meet), rate)
        rated = F.transform(measured, lambda m: F.struct((m["iou"] + m["bonus"] - m["dist"] / F.lit(DISTANCE_SCALE)).alias("score"), (-m["oi"]).alias("neg"), m["oi"].alias("oi"), m["iou"].alias("iou"), m["dist"].alias("dist")))

        # A one-element array binds the best choice once for the gate and the result.
        def settle(best: Column) -> Column:
            ok = best.isNotNull() & ((best["iou"] > LEAST_IOU) | (best["dist"] < MOST_DISTANCE))
            pair = F.struct(p["i"].alias("pi"), best["oi"].alias("oi"), best["iou"].alias("iou"), best["dist"].alias("dist"))
            taken = F.struct(F.filter(acc["free"], lambda o: o["i"] != best["oi"]).alias("free"), F.array_append(acc["pairs"], pair).alias("pairs"))
            return F.when(ok, taken).otherwise(F.struct(acc["free"].alias("free"), acc["pairs"].alias("pairs")))

        return F.element_at(F.transform(F.array(F.array_max(F.filter(rated, lambda r: r["score"] > 0))), settle), 1)

    return F.aggregate(F.transform(ps, _shape), start, step, lambda acc: acc["pairs"])


def align(blocks: DataFrame, *extra: Column) -> DataFrame:
    """Page key, match (matched, parser_only, ocr_only), ord (their order on the page), p and o (blocks), iou, dist and
    ocr_left (how many optical blocks found no partner)."""
    paired = pages(blocks, *extra).withColumn("pairs", _pairs(F.col("ps"), F.col("os")))
    kept = [c for c in paired.columns if c not in ("ps", "os", "pairs")]
    row = lambda kind, p, o, i, d: F.struct(F.lit(kind).alias("match"), p.alias("p"), o.alias("o"), i.alias("iou"), d.alias("dist"))
    none_o, none_p, nothing = F.get("os", F.lit(-1)), F.get("ps", F.lit(-1)), F.lit(None).cast("double")
    with_index = lambda side: F.transform(F.col(side), lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    used = lambda f: F.transform("pairs", lambda x: x[f])
    matched = F.transform("pairs", lambda x: row("matched", F.get("ps", x["pi"]), F.get("os", x["oi"]), x["iou"], x["dist"]))
    only_p = F.transform(F.filter(with_index("ps"), lambda x: ~F.array_contains(used("pi"), x["i"])), lambda x: row("parser_only", x["b"], none_o, nothing, nothing))
    only_o = F.transform(F.filter(with_index("os"), lambda x: ~F.array_contains(used("oi"), x["i"])), lambda x: row("ocr_only", none_p, x["b"], nothing, nothing))
    rows = paired.withColumn("ocr_left", F.size("os") - F.size("pairs")).select(*kept, "ocr_left", F.posexplode(F.concat(matched, only_p, only_o)).alias("ord", "r"))
    return rows.select(*kept, "ocr_left", "ord", "r.match", "r.p", "r.o", "r.iou", "r.dist")


def candidate_pairs(blocks: DataFrame) -> DataFrame:
    """All pairs of a page with their measures, for inspection."""
    one = pages(blocks).select(*PAGE, F.explode("ps").alias("p"), "os").select(*PAGE, "p", F.explode("os").alias("o"))
    return one.select(*PAGE, "p", "o", iou(Box.of(F.col("p")), Box.of(F.col("o"))).alias("iou"), center_distance(Box.of(F.col("p")), Box.of(F.col("o"))).alias("dist"), score(F.col("p"), F.col("o")).alias("score"))
