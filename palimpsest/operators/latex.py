"""The slot for a model that reads formulas: loaded once in a worker, called for math blocks only, never fatal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_latex(tokens: DataFrame, load: Callable[[], Callable[[bytes], str]] | None, image: str = "image") -> DataFrame:
    """tokens with `latex` of math tokens from their image. Without a model, or where it fails, the column stays as it is
    (empty text counts as none)."""
    old = F.nullif(F.coalesce(F.col("latex"), F.lit("")), F.lit(""))
    if load is None:
        return tokens.withColumn("latex", old)

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for s in batches:
            out = []
            for data in s:
                if data is None:
                    out.append(None)
                    continue
                try:
                    model = model or load()
                    out.append(model(bytes(data)) or None)
                except Exception:  # a formula that can't be read must not end the page
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return tokens.withColumn("latex", F.coalesce(read(F.when(F.col("block_type") == "math", F.col(image))), old))
