"""What the exports and the reliability test don't do twice, or at all where nothing reads it."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import order
from palimpsest.plans import catalog, tracks
from palimpsest.runtime import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["text_export", "md_export"])
def test_blocks_are_made_once(spark, name):
    assert plan(catalog.QUERIES[name](spark, SF)).count("Generate explode(array(") == 1


def test_divider_takes_two_passes(spark):
    assert plan(order.two_column_divider(tracks.blocks(table(spark, SF, "documents")))).count("- Window [") == 2


def test_unread_fields_are_not_made(spark):
    """The reliability test reads neither debug texts nor the similarity that goes with them."""
    assert "parser_text" not in plan(catalog.QUERIES["reliable_parser"](spark, SF))


def test_measures_as_their_patterns_say(spark):
    texts = ["", " ", "a  b", "a\t b \n", "\u0084\u0085 x　", "!~\x7f", "가ᄀ漢 Z9", "😀é 1-2", "     a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = "[ \\t-\\r\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
    t = F.col("t")
    rows = df.select(
        (F.regexp_replace(t, f"{plain}+", "#") == F.regexp_replace(t, T.SPACE, "#")).alias("space"),
        (F.lower(F.trim(F.regexp_replace(t, f"{plain}+", " "))) == T.normalized(t)).alias("normalized"),
        (F.regexp_count(t, F.lit(T.ALNUM)) == T.alnum(t)).alias("alnum"),
        (F.regexp_count(t, F.lit(T.JAMO)) == T.jamos(t)).alias("jamos"),
        (t.rlike(T.KOREAN) == T.has_korean(t)).alias("korean"),
    ).collect()
    assert all(all(r) for r in rows)
