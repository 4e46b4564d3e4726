"""Measures of converted text: size, and likeness to expected text where there is some."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a, b):
    """Ratio of matching blocks, 0 to 1, to four digits; null where either text is missing."""
    return F.pandas_udf(_ratio, "double")(a, b)


def text_measures(texts: DataFrame, text: str = "content", word: str = "(?U)[^\\s]+", end: str = "\\r?\\n") -> DataFrame:
    """chars, words and lines of each text; null counts as empty. word, end: patterns of a word and of a line's end."""
    t = F.coalesce(F.col(text), F.lit(""))
    # \\z, as $ also holds before a last line end: of two at the end only one goes.
    lines = F.when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, f"{end}\\z", ""), end)))
    return texts.withColumn("chars", F.length(t)).withColumn("words", F.regexp_count(t, F.lit(word))).withColumn("lines", lines)


def base_name(directory):
    """The fixture's name within an output folder's name."""
    return F.regexp_replace(F.regexp_extract(directory, "([^/]+)/?$", 1), "test_output_|_cli", "")


def evaluate(outputs: DataFrame, expected: DataFrame, blocks: DataFrame) -> DataFrame:
    """outputs: name, content; expected: name, content; blocks: name, blocks. A missing side leaves nulls."""
    e = expected.select("name", F.col("content").alias("expected"))
    joined = text_measures(outputs).join(e, "name", "left").join(blocks.select("name", "blocks"), "name", "left")
    return joined.select("name", "chars", "words", "lines", "blocks", sequence_ratio("expected", "content").alias("similarity"))
