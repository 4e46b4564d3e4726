"""What every operator needs from the session: shipped code, bounded batches, shared scratch tables."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers get at most so many rows and bytes at once, so a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and bound the Arrow batches where the session hasn't set
    a bound of its own: a setting that the caller made stays, whatever it says."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", None) != sc.applicationId:
        root = os.path.dirname(os.path.abspath(__file__))
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        path = os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest_code.zip")
        with open(path, "wb") as f:
            f.write(buf.getvalue())
        sc.addPyFile(path)
        atexit.register(shutil.rmtree, os.path.dirname(path), ignore_errors=True)
        sc._palimpsest_shipped = sc.applicationId
    # A frame's batches are cut when it runs, which is after this call, so the bound has to stay set.
    for key, value in _BATCHES.items():
        if not spark._jsparkSession.conf().contains(key):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, but only if
    driver and executors are one machine; on a cluster each executor would write to a disk of its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(sc, "_palimpsest_scratch", None)
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="palimpsest-scratch-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = sc._palimpsest_scratch = "file://" + folder
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. All of an application's paths lie in one folder, which goes when it ends."""
    sc = spark.sparkContext
    base = f"{shared_dir(spark)}/palimpsest/{sc.applicationId}"
    if getattr(sc, "_palimpsest_base", None) != base:
        # Hadoop forgets a path that isn't there when it is registered.
        p, fs = _hadoop(spark, base)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._palimpsest_base = base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and return the frame that reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._palimpsest_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove tables that save() wrote, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_palimpsest_path", None)
        if path:
            p, fs = _hadoop(df.sparkSession, path)
            fs.delete(p, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names for use inside an operator: each of `names`, with underscores added until no column of the user's
    frame has it, in any case of letters."""
    have = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stack(top: DataFrame, bottom: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows of both, columns by name, missing ones null, for a grouping by `keys`.

    Spark 4.1 takes a union whose branches are partitioned alike for partitioned so itself, and plans a grouping over it
    without a shuffle; in larger plans the branches' partitions may then be run one after another all the same, and a
    group comes out in several rows. The lower branch's keys pass through an expression that keeps their values and hides
    what they were partitioned by, so the grouping shuffles."""
    return top.unionByName(bottom.withColumns({k: F.greatest(k, k) for k in keys}), allowMissingColumns=True)
