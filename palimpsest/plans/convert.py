"""From files to exported documents, with a status for each input.

A track reads files of its kinds into blocks, the pages there are and errors (`Track`); `register` adds or replaces one.
The optical track comes from a recognizer: a command that is called with a page's image and prints tokens as JSON
(`recognize`), or a table of such outputs that was made elsewhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import extract, latex
from palimpsest.operators.fuse import fuse, page_list
from palimpsest.plans.schema import BLOCKS, PAGE, PAGE_HEIGHT, PAGE_WIDTH
from palimpsest.runtime import save
from palimpsest.sinks import export
from palimpsest.sources import files, render, tokens


class Track(NamedTuple):
    """blocks (schema.BLOCKS), pages (page key) and errors (doc_id, error) of some files."""

    blocks: DataFrame
    pages: DataFrame
    errors: DataFrame


def _office(reader: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], Track]:
    def read(found: DataFrame) -> Track:
        runs = save(reader(found), "convert-runs")
        return Track(files.run_blocks(runs), _page_keys(runs), _errors(runs))

    return read


def _pdf(found: DataFrame) -> Track:
    texts = save(files.pdf(found), "convert-pdf")
    return Track(extract.parser_blocks(texts.where("error IS NULL")), _page_keys(texts), _errors(texts))


def _page_keys(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NULL").select(*PAGE).distinct()


def _errors(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NOT NULL").select("doc_id", "error")


#: By kind: files (doc_id, content) -> Track. An older slide file goes through the office suite first.
TRACKS: dict[str, Callable[[DataFrame], Track]] = {"pdf": _pdf, "docx": _office(files.docx), "pptx": _office(files.pptx), "ppt": _office(files.ppt)}


def register(kind: str, read: Callable[[DataFrame], Track]) -> None:
    """Read files that end in .<kind> by `read`."""
    TRACKS[kind.lower()] = read


def parser_track(spark: SparkSession, source: str) -> Track:
    """All files under source, kind by kind: Spark lists the files of a kind only, so no file is read for another's sake."""
    out: list[Track] = [read(files.read_files(spark, source, files.any_case(kind))) for kind, read in TRACKS.items()]
    blocks, pages, errors = out[0]
    for t in out[1:]:
        blocks, pages, errors = blocks.unionByName(t.blocks), pages.unionByName(t.pages), errors.unionByName(t.errors)
    return Track(blocks, pages, errors)


def listing(spark: SparkSession, source: str) -> DataFrame:
    """path, doc_id, kind, error and folder (its name among the outputs) of each file; contents aren't read. Files whose
    names differ only by folder or ending get their id added."""
    found = files.route(files.read_files(spark, source).drop("content", "kind", "error"), kinds=tuple(TRACKS))
    name = files.stem(F.col("path"))
    same = F.count("*").over(Window.partitionBy(name))
    return found.withColumn("folder", F.when(same > 1, F.concat(name, F.lit("-"), F.hex("doc_id"))).otherwise(name))


def optical_blocks(spark: SparkSession, outputs: DataFrame | None, model: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, pages) of a recognizer's outputs: doc_id, page_idx, output and, for the formula model, image."""
    if outputs is None:
        return spark.createDataFrame([], BLOCKS), spark.createDataFrame([], "doc_id long, page_idx int")
    found = tokens.read_tokens(outputs)
    if model is not None and "image" in outputs.columns:
        images = outputs.select(*[F.col(c).alias(f"i_{c}") for c in PAGE], "image")
        on = [F.col(c) == F.col(f"i_{c}") for c in PAGE]
        maths = latex.with_latex(found.where("block_type = 'math'").join(images, on, "left").drop("i_doc_id", "i_page_idx"), model).drop("image")
        found = found.where("block_type <> 'math'").unionByName(maths.select(*found.columns))
    return tokens.to_blocks(found), outputs.select(*PAGE).distinct()


def recognize(spark: SparkSession, source: str, command: Sequence[str], settings: render.Settings) -> DataFrame:
    """doc_id, page_idx, output and image: every page is rendered and read by `command --image FILE --lang LANGUAGE`. Pages
    that can't be rendered or read have a null output, so the parser track stands alone there."""
    found = files.read_files(spark, source).where(F.col("kind").isNotNull())
    return save(render.outputs(found.repartition(max(settings.workers, spark.sparkContext.defaultParallelism), "doc_id"), tuple(command), settings), "convert-optical")


def convert(
    spark: SparkSession, source: str, target: str, ocr_outputs: DataFrame | None = None, recognizer: Sequence[str] | None = None, settings: render.Settings | None = None, model: Callable | None = None
) -> DataFrame:
    """Read documents under source, fuse them with the recognizer's outputs (doc_id, page_idx, output), given or made by
    the command `recognizer`, and write <target>/<name>/document.json, .md, .txt, page files and debug/*.html. Returns a
    status a file: path, doc_id, success, output_dir, error. One file's failure leaves the others alone. An empty source
    is an error."""
    settings = (settings or render.Settings.from_env()).check()
    listed = save(listing(spark, source), "convert-files")
    if not listed.limit(1).count():
        raise ValueError(f"no files under {source}")
    parsed = parser_track(spark, source)
    errors = save(parsed.errors.unionByName(listed.where("kind IS NULL").select("doc_id", "error")), "convert-errors")
    if recognizer and ocr_outputs is None:
        ocr_outputs = recognize(spark, source, recognizer, settings)
    ocr, ocr_pages = optical_blocks(spark, ocr_outputs, model)
    both = save(parsed.blocks.unionByName(ocr), "convert-blocks")
    sized = parsed.pages.unionByName(ocr_pages).select(*PAGE, F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"))
    pages = save(page_list(both, sized), "convert-pages")
    fused = save(fuse(both), "convert-fused")
    out, has_image = None, None
    if ocr_outputs is not None and "image" in ocr_outputs.columns:
        shown = ocr_outputs.where("image IS NOT NULL")
        out = shown.select("doc_id", F.concat(F.lit("debug/"), render.image_name(F.col("page_idx"))).alias("path"), F.col("image").alias("content"))
        marked = fused.join(shown.select(*PAGE, F.lit(True).alias("_shown")), PAGE, "left")
        fused, has_image = marked, F.coalesce("_shown", F.lit(False))
    documents = export.all_documents(both, fused, pages, has_image).withColumn("content", F.col("content").cast("binary"))
    documents = documents if out is None else documents.unionByName(out)
    written = export.write_files(documents.join(listed.select("doc_id", "folder"), "doc_id"), target)
    failed = errors.groupBy("doc_id").agg(F.first("error").alias("error"))
    made = written.groupBy("folder").agg(F.count("*").alias("n_files"))
    status = listed.select("path", "doc_id", "folder").join(failed, "doc_id", "left").join(made, "folder", "left")
    ok = F.col("error").isNull()
    return status.select("path", "doc_id", ok.alias("success"), F.concat(F.lit(target.rstrip("/") + "/"), "folder").alias("output_dir"), F.coalesce("n_files", F.lit(0)).alias("n_files"), "error")


def summary(status: DataFrame, began: float | None = None) -> DataFrame:
    took = int(1000 * (time.time() - began)) if began else 0
    return status.agg(F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count"), F.lit(took).alias("elapsed_ms"))


def page_counts(pages: DataFrame) -> DataFrame:
    """Pages of each document, blank ones too."""
    return pages.select(*PAGE).distinct().groupBy("doc_id").agg(F.count("*").alias("pages"))
