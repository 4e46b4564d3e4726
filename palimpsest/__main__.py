"""python -m palimpsest convert SOURCE TARGET | info SOURCE"""

from __future__ import annotations

import argparse
import dataclasses
import shlex
import sys
import time

from pyspark.sql import SparkSession


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="convert files to JSON, Markdown, text and debug HTML")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--ocr", help="Parquet table of a recognizer's outputs: path (or doc_id), page_idx, output")
    c.add_argument("--recognizer", help="command that reads a page image and prints tokens as JSON")
    c.add_argument("--dpi", type=int)
    c.add_argument("--lang")
    c.add_argument("--workers", type=int)
    c.add_argument("--quiet", action="store_true")
    i = sub.add_parser("info", help="page counts")
    i.add_argument("source")
    return p


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    from pyspark.sql import functions as F

    from palimpsest.plans import convert
    from palimpsest.sources import render

    if a.command == "info":
        track = convert.parser_track(spark, a.source)
        convert.page_counts(track.pages).show(truncate=False)
        return int(track.errors.limit(1).count() > 0)
    began = time.time()
    given = {k: getattr(a, k) for k in ("dpi", "lang", "workers") if getattr(a, k) is not None}
    settings = dataclasses.replace(render.Settings.from_env(), **given).check()
    outputs = spark.read.parquet(a.ocr) if a.ocr else None
    if outputs is not None and "doc_id" not in outputs.columns:
        outputs = outputs.join(convert.listing(spark, a.source).select("path", "doc_id"), "path")
    if outputs is not None:
        outputs = outputs.select("doc_id", F.col("page_idx").cast("int").alias("page_idx"), "output")
    status = convert.convert(spark, a.source, a.target, outputs, shlex.split(a.recognizer) if a.recognizer else None, settings)
    if not a.quiet:
        status.select("path", "success", "output_dir", "error").show(truncate=False)
    total = convert.summary(status, began).first()
    print(f"{total['success_count']} converted, {total['failure_count']} failed, {total['elapsed_ms']} ms")
    return int(total["failure_count"] > 0)


if __name__ == "__main__":
    sys.exit(main())
