"""From aligned rows to one block list a page: pairs are resolved, single blocks promoted, then filters run in order.

Every filter looks at what the one before has left, so each takes its page measures anew, by windows over the page key;
the rows come partitioned by that key from the alignment, so none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.geometry import Box, iou, union
from palimpsest.operators.order import two_column_divider
from palimpsest.plans.schema import LINES, PAGE, PAGE_AREA, PAGE_HEIGHT, PAGE_WIDTH

SAME_TEXT, OVERSIZED, VERY_OVERSIZED = 0.72, 0.58, 0.7


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def confidence(has_parser: Column, has_ocr: Column, similarity: Column, geometry_good: Column) -> Column:
    """From the presence of tracks, their agreement (null: not compared) and their geometry."""
    base = F.when(has_parser, F.lit(0.4)).otherwise(F.lit(0.0)) + F.when(has_ocr, F.lit(0.3)).otherwise(F.lit(0.0))
    agreed = F.when(similarity.isNull(), F.lit(0.0)).when(similarity >= 0.9, F.lit(0.3)).when(similarity >= 0.7, F.lit(0.15)).otherwise(F.lit(-0.2))
    return clamp(base + agreed + F.when(geometry_good, F.lit(0.1)).otherwise(F.lit(-0.1)))


def _debug(parser: Column, ocr: Column, final: Column, similarity: Column) -> Column:
    return F.struct(parser.alias("parser_text"), ocr.alias("ocr_text"), final.alias("final_text"), similarity.cast("double").alias("similarity"))


NO_DEBUG = "struct<parser_text:string,ocr_text:string,final_text:string,similarity:double>"
OUT = ("type", "x0", "y0", "x1", "y1", "text", "lines", "confidence", "source", "latex", "debug")


Fields = dict[str, Column]


def _block(type_: Column, box: Box, text: Column, lines: Column, conf: Column, source: Column, latex: Column, debug: Column) -> Fields:
    """A block's fields one by one, so that one that nobody reads isn't made."""
    return dict(zip(OUT, (type_, *box, text, lines, conf, source, latex, debug), strict=True))


def _choose(*cases: tuple[Column, Fields], other: Fields) -> Fields:
    def field(c: str) -> Column:
        out = F
        for cond, block in cases:
            out = out.when(cond, block[c])
        return out.otherwise(other[c])

    return {c: field(c) for c in OUT}


def _struct(block: Fields) -> Column:
    return F.struct(*(v.alias(n) for n, v in block.items()))


def promote(b: Column, source: str, page_class: Column) -> Column:
    return _struct(_promoted(b, source, page_class))


def _promoted(b: Column, source: str, page_class: Column) -> Fields:
    """A block that stands alone: its confidence is set anew from its track and the page's class."""
    is_text = b["type"] == "text"
    yes, no = F.lit(True), F.lit(False)
    base = confidence(yes if source == "parser" else no, yes if source == "ocr" else no, F.lit(None).cast("double"), yes)
    final = F.nullif(b["text"], F.lit(""))
    conf = base
    if source == "parser":
        conf = F.when(is_text & F.coalesce(T.parser_degraded(final), no), clamp(conf - F.lit(0.2))).otherwise(conf)
        conf = F.when(is_text & (page_class == "scanned"), clamp(conf - F.lit(0.1))).otherwise(conf)
        debug = _debug(final, F.lit(None).cast("string"), final, F.lit(None))
    else:
        conf = F.when(is_text & (page_class == "scanned"), clamp(conf + F.lit(0.08))).otherwise(conf)
        debug = _debug(F.lit(None).cast("string"), final, final, F.lit(None))
    return _block(b["type"], Box.of(b), b["text"], b["lines"], conf, F.lit(source), b["latex"], F.when(is_text, debug).otherwise(F.lit(None).cast(NO_DEBUG)))


def resolve_pairs(matched: DataFrame, page_class: str = "class") -> DataFrame:
    """Rows with p, o, iou and dist -> a column `out` with the resolved block and `sim`."""
    m, block = _resolved(matched, page_class)
    return m.withColumn("out", _struct(block)).drop(*MEASURES)


MEASURES = ("tokens", "loss", "exact", "close", "qp", "qo", "kor", "big", "np", "no", "layout", "noisy", "blank", "yields")


def _resolved(matched: DataFrame, page_class: str = "class") -> tuple[DataFrame, Fields]:
    """Rows with the measures of each pair, and the resolved block's fields over them.

    `sim` is exact and made only where it is read. The choice reads `close`, which is the same where the similarity can
    reach SAME_TEXT or a rule looks below that, and else 0: most pairs are settled by lengths and tokens without an edit
    distance."""
    cls, p, o = F.col(page_class), F.col("p"), F.col("o")
    both = (p["type"] == "text") & (o["type"] == "text")
    at, ot = F.when(both, p["text"]), F.when(both, o["text"])
    m = matched.withColumn("qp", T.quality(F.coalesce(p["text"], F.lit("")))).withColumn("qo", T.quality(F.coalesce(ot, F.lit(""))))
    m = m.withColumn("kor", F.coalesce(T.has_korean(p["text"]), F.lit(False)) | F.coalesce(T.has_korean(o["text"]), F.lit(False)))
    m = m.withColumn("big", Box.of(p).area / F.lit(PAGE_AREA) > OVERSIZED).withColumn("np", F.length(F.coalesce(at, F.lit("")))).withColumn("no", F.length(F.coalesce(ot, F.lit(""))))
    m = m
    # Below SAME_TEXT, rules look at the similarity of large parser blocks, of Korean and of much longer optical texts.
    below = F.col("big") | F.col("kor") | (F.col("no") > F.col("np") + 80)
    ratio = T.length_ratio(at, ot)
    reach = lambda tokens, loss: T.joint_similarity(at, ot, ratio, tokens, loss) >= SAME_TEXT
    tokens, loss = F.col("tokens"), F.col("loss")
    m = m.withColumn("tokens", F.when(both & (below | reach(F.lit(1.0), F.lit(0.0))), T.token_overlap(at, ot)))
    m = m.withColumn("loss", F.when(tokens.isNotNull() & (below | reach(tokens, F.lit(0.0))), T.digits_loss(at, ot)))
    m = m.withColumn("exact", F.when(loss.isNotNull() & (below | reach(tokens, loss)), T.joint_similarity(at, ot, T.edit_similarity(at, ot), tokens, loss)))
    m = m.withColumn("sim", F.when(both, F.coalesce("exact", T.similarity(at, ot))))
    m = m.withColumn("close", F.when(both, F.coalesce("exact", F.lit(0.0))))
    m = m.withColumn("layout", F.col("big") & (F.col("no") + 40 >= F.col("np")) & ~(F.col("kor") & (F.col("qp") >= 4)))
    # What the optical text is worth is asked below SAME_TEXT only, and of scanned pages, layouts and longer texts.
    asked = (F.col("close") < SAME_TEXT) & (F.col("layout") | (cls == "scanned") | (F.col("no") > F.col("np") + 80))
    m = m.withColumn("noisy", F.when(asked, F.coalesce(T.noisy_ocr(ot), F.lit(True))).otherwise(F.lit(True)))
    m = m.withColumn("blank", F.when(F.col("layout") | (cls == "scanned"), T.normalized(F.coalesce(ot, F.lit(""))) == "").otherwise(F.lit(True)))
    sim, close, kor, big, qp, qo, n_p, n_o = (F.col(c) for c in ("sim", "close", "kor", "big", "qp", "qo", "np", "no"))
    # A parser block without text has the lowest quality there is.
    strong = kor & (qp >= 4) & (p["type"] == "text")
    # Lengths at which the optical text isn't much shorter.
    layout = F.col("layout")
    loose = layout & (close < 0.55) & ~F.col("noisy")
    swap = lambda gain, longer: kor & (close < 0.30) & (qo > qp + gain) & (n_o > n_p + longer)
    choice = (
        F.when((close >= SAME_TEXT) & (cls == "scanned"), "ocr+fused")
        .when((close >= SAME_TEXT) & (cls == "hybrid") & layout & ~F.col("blank"), "ocr")
        .when(close >= SAME_TEXT, "parser+fused")
        .when((cls == "digital") & (swap(5, 40) | loose), "ocr")
        .when((cls == "hybrid") & (swap(4, 50) | loose | ((close < 0.35) & (n_o > n_p + 80) & ~F.col("noisy"))), "ocr")
        .when((cls == "scanned") & ~F.col("blank") & ~F.col("noisy"), "ocr")
        .otherwise("parser")
    )
    m = m.withColumn("choice", choice)
    picked = F.col("choice")
    from_ocr = picked.isin("ocr", "ocr+fused")
    source = F.when(picked.endswith("fused"), "fused").otherwise(picked)
    base = confidence(F.lit(True), F.lit(True), sim, (F.col("iou") > 0.3) | (F.col("dist") < 50.0))
    conf = F.when(kor & (source == "parser") & (qp < -2), clamp(base - F.lit(0.2))).otherwise(base)
    conf = F.when(kor & (source == "ocr") & (qo > 0), clamp(conf + F.lit(0.05))).otherwise(conf)
    conf = F.when((cls == "scanned") & (source == "ocr"), clamp(conf + F.lit(0.08))).otherwise(conf)
    text = F.when(from_ocr, o["text"]).otherwise(p["text"])
    fused = _block(F.lit("text"), Box.of(p), text, F.when(from_ocr, o["lines"]).otherwise(p["lines"]), conf, source, F.lit(None).cast("string"), _debug(at, ot, F.nullif(text, F.lit("")), sim))
    figure = _block(
        F.lit("figure"), union(Box.of(p), Box.of(o)), F.lit(None).cast("string"), F.lit(None).cast(LINES), base, F.lit("fused"), F.lit(None).cast("string"), F.lit(None).cast(NO_DEBUG),
    )
    # A parser block as large as the page that says something else gives way to the optical block as it stands.
    m = m.withColumn("yields", big & (F.coalesce(close, F.lit(0.0)) < 0.15) & ~strong)
    return m, _choose((F.col("yields"), _promoted(o, "ocr", cls)), (both, fused), other=figure)


def skips_oversized(b: Column, ocr_left: Column) -> Column:
    """A lone parser block that fills the page gives way to ten or more lone optical blocks, unless its Korean is good."""
    text = F.coalesce(b["text"], F.lit(""))
    good = T.has_korean(text) & (T.quality(text) >= 4)
    near = lambda x, at: F.abs(x - F.lit(float(at))) < 10
    full = near(b["x0"], 0) & near(b["y0"], 0) & near(b["x1"], PAGE_WIDTH) & near(b["y1"], PAGE_HEIGHT)
    return (ocr_left >= 10) & ~good & (full | (Box.of(b).area / F.lit(PAGE_AREA) > VERY_OVERSIZED))


def merge(aligned: DataFrame) -> DataFrame:
    """Aligned rows with `class` -> block rows in page order (seq), before the filters."""
    kept = aligned.where(~((F.col("match") == "parser_only") & skips_oversized(F.col("p"), F.col("ocr_left"))))
    pairs, resolved = _resolved(kept)
    is_ = lambda match: F.col("match") == match
    out = _choose((is_("matched"), resolved), (is_("parser_only"), _promoted(F.col("p"), "parser", F.col("class"))), other=_promoted(F.col("o"), "ocr", F.col("class")))
    return pairs.select(*PAGE, "class", F.col("ord").alias("seq"), *(v.alias(c) for c, v in out.items()))


def _text(source: str) -> Column:
    is_text = F.col("type") == "text"
    return is_text & (F.col("source") == "ocr") if source == "ocr" else is_text & F.col("source").isin("parser", "fused")


def over_page(x: Column) -> Column:
    return x.over(Window.partitionBy(*PAGE))


def drop_degraded_parser(blocks: DataFrame) -> DataFrame:
    """Parser text of broken Korean goes where some optical text is better."""
    t = F.coalesce("text", F.lit(""))
    best = over_page(F.max(F.when(_text("ocr"), T.quality(t))))
    bad = (F.col("type") == "text") & (F.col("source") == "parser") & T.has_korean(t) & (T.quality(t) < -10)
    return blocks.withColumn("_best", best).where(~F.coalesce(bad & (F.col("_best") > T.quality(t)), F.lit(False))).drop("_best")


def parser_dominant() -> Column:
    """Parser text leads the page: long enough, readable and in a wide block."""
    own, t = _text("parser"), F.coalesce("text", F.lit(""))
    chars, best, area = over_page(F.sum(F.when(own, F.length(t)))), over_page(F.max(F.when(own, T.quality(t)))), over_page(F.max(F.when(own, Box.of().area)))
    return F.coalesce((chars >= 120) & (best >= -2) & (area >= 300000.0), F.lit(False))


def _said(norm: Column) -> tuple[Column, ...]:
    """A normalized text with what its comparisons need, made once a text and not once a pair."""
    return norm.alias("norm"), F.length(norm).alias("n"), T.words(norm).alias("tokens"), T.digits(norm).alias("digits")


def is_duplicate(ocr: Column, ocr_box: Box, parser: Column, parser_box: Box) -> Column:
    """Whether a parser text says what an optical one says (both as of _said): it holds it, or they are similar enough.

    Cheap tests first, each a bound on the similarity: edit similarity is at most the ratio of lengths, so with full token
    overlap, then with the overlap and the digits there are; only texts that can still get there take an edit distance."""
    a, b = ocr["n"], parser["n"]
    ratio = F.lit(1.0) - F.abs(a - b) / F.greatest(a, b, F.lit(1))
    need = F.when(iou(ocr_box, parser_box) >= 0.55, F.lit(0.55)).otherwise(F.lit(0.82))
    # One-element arrays bind a value once.
    seen = F.array(F.struct(need.alias("need"), ratio.alias("ratio")))

    def by_tokens(x: Column) -> Column:
        less = F.when(T.differ(parser["digits"], ocr["digits"]), F.lit(0.1)).otherwise(F.lit(0.0))
        tokens = F.array(F.struct(T.overlap(parser["tokens"], ocr["tokens"]).alias("tokens"), less.alias("less")))
        reach = lambda edit, y: (edit + y["tokens"]) / F.lit(2.0) - y["less"] >= x["need"]
        edit = T.edit_similarity(parser["norm"], ocr["norm"])
        return F.exists(tokens, lambda y: F.when(reach(x["ratio"], y), reach(edit, y)).otherwise(F.lit(False)))

    similar = F.exists(seen, lambda x: F.when((x["ratio"] + F.lit(1.0)) / F.lit(2.0) < x["need"], F.lit(False)).otherwise(by_tokens(x)))
    held = (F.octet_length(ocr["norm"]) >= 8) & F.contains(parser["norm"], ocr["norm"])
    return F.when(parser["norm"] == "", F.lit(False)).when(held, F.lit(True)).when(ocr["norm"] == "", F.lit(False)).otherwise(similar)


def drop_redundant_ocr(blocks: DataFrame) -> DataFrame:
    """On pages where parser text leads, optical text that some parser text already says goes. The page's parser texts
    come to each row by a window, so no join and no shuffle."""
    said = F.struct(*_said(T.normalized(F.coalesce("text", F.lit("")))))
    b = blocks.withColumn("_lead", parser_dominant()).withColumn("_said", F.when(F.col("_lead") & (_text("parser") | _text("ocr")), said))
    mine = F.struct("_said.*", "x0", "y0", "x1", "y1")
    b = b.withColumn("_theirs", F.when(F.col("_lead"), over_page(F.collect_list(F.when(_text("parser"), mine)))))
    dup = (F.octet_length("_said.norm") < 4) | F.exists("_theirs", lambda q: is_duplicate(F.col("_said"), Box.of(), q, Box.of(q)))
    gone = F.when(F.col("_lead") & _text("ocr"), dup).otherwise(F.lit(False))
    return b.where(~gone).drop("_lead", "_said", "_theirs")


def low_quality(aggressive: Column) -> Column:
    t = F.coalesce("text", F.lit(""))
    n = T.normalized(t)
    return _text("ocr") & ((n == "") | T.noisy_ocr(t) | (aggressive & (F.length(n) <= 3)))


def drop_low_quality_ocr(blocks: DataFrame) -> DataFrame:
    """Blank and noisy optical text goes; very short text too, but not on scanned pages."""
    return blocks.where(~low_quality(F.col("class") != "scanned"))


def drop_korean_ocr(blocks: DataFrame) -> DataFrame:
    """Where parser Korean can be relied on, optical Korean goes."""
    own, t = _text("parser"), F.coalesce("text", F.lit(""))
    reliable = F.coalesce((over_page(F.sum(F.when(own, T.syllables(t)))) >= 18) & (over_page(F.max(F.when(own, T.quality(t)))) >= -1), F.lit(False))
    return blocks.withColumn("_ok", reliable).where(~(F.col("_ok") & _text("ocr") & T.has_korean(t))).drop("_ok")


def with_reliability(blocks: DataFrame, to: str = "reliable") -> DataFrame:
    """Whether a page's parser text can stand for the page: long, not far shorter than the optical text and readable; but
    not one block against many in two columns."""
    own, ocr, t = _text("parser"), _text("ocr"), F.coalesce("text", F.lit(""))
    b = two_column_divider(blocks, "_divider")
    total = lambda cond: F.coalesce(over_page(F.sum(F.when(cond, F.length(t)))), F.lit(0))
    chars, ocr_chars = total(own), total(ocr)
    n, n_ocr = over_page(F.count(F.when(own, 1))), over_page(F.count(F.when(ocr, 1)))
    best = over_page(F.max(F.when(own, T.quality(t))))
    one_against_many = (n == 1) & (n_ocr >= 6) & F.col("_divider").isNotNull() & (best < 4)
    ok = (n >= 1) & ~one_against_many & (chars >= 220) & ((ocr_chars == 0) | (chars * 10 >= ocr_chars * 7)) & (best >= -2)
    return b.withColumn(to, F.coalesce(ok, F.lit(False))).drop("_divider")


def drop_ocr_when_reliable(blocks: DataFrame) -> DataFrame:
    return with_reliability(blocks, "_ok").where(~(F.col("_ok") & _text("ocr"))).drop("_ok")


def apply_filters(blocks: DataFrame) -> DataFrame:
    """The chain in its order. Scanned pages skip the three filters that trust the parser."""
    first = drop_degraded_parser(blocks)
    scanned = F.col("class") == "scanned"
    trusted = lambda f, d: _unless(d, scanned, f)
    out = trusted(drop_redundant_ocr, first)
    out = drop_low_quality_ocr(out)
    out = trusted(drop_korean_ocr, out)
    return trusted(drop_ocr_when_reliable, out)


def _unless(df: DataFrame, cond: Column, step) -> DataFrame:
    """Applies step to the pages where cond doesn't hold, in the same plan: rows of the others are made unfilterable."""
    marked = df.withColumn("_type", F.col("type")).withColumn("type", F.when(cond, F.concat(F.lit("-"), F.col("type"))).otherwise(F.col("type")))
    return step(marked).withColumn("type", F.col("_type")).drop("_type")
