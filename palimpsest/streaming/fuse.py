"""Fusion over blocks that arrive as files. Fusion needs whole pages, which a file must hold: each micro-batch is fused as
a table of its own and written under its number, so a batch that runs again replaces its own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.fuse import fuse
from palimpsest.plans.schema import BLOCKS


def fuse_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        fuse(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    out = spark.readStream.schema(BLOCKS).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
