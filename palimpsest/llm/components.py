"""Connected components of a large edge list: smallest labels spread along edges, with pointer jumping.

Edges and labels stay in tables. Each round joins edges with the labels of their far ends, keeps the smallest by node
(combined before the shuffle, so a node with very many edges is no hot key) and then lets every label follow its own
label. Labels only fall, so an unchanged sum ends the loop; the number of rounds is about the logarithm of the longest
chain. Both sides of each join are tables that Spark can split where one key has many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import discard, save


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, label): each node that an edge names, with the smallest node of its component."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = save(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = save(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "cc-labels")
    total = _total(labels)
    for _ in range(max_rounds):
        far = e.join(labels.select(F.col("node").alias("v"), "label"), "v").select(F.col("u").alias("node"), "label")
        lower = save(labels.unionByName(far).groupBy("node").agg(F.min("label").alias("label")), "cc-lower")
        jump = lower.select(F.col("node").alias("p"), F.col("label").alias("up"))
        nxt = save(lower.join(jump, lower.label == jump.p).select("node", F.least("label", "up").alias("label")), "cc-labels")
        discard(lower)
        discard(labels)
        labels, before, total = nxt, total, _total(nxt)
        if total == before:
            return labels
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
