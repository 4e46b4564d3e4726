"""Blocks as rows. Order is never implied: `seq` carries it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_idx"]
PAGE_WIDTH, PAGE_HEIGHT = 1000, 1400
PAGE_AREA = float(PAGE_WIDTH * PAGE_HEIGHT)

SPAN = "struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,source:string,style:struct<font:string,size:double>>"
LINES = f"array<struct<spans:array<{SPAN}>>>"
FIELDS = ("seq", "type", "x0", "y0", "x1", "y1", "text", "lines", "confidence", "source", "latex")
#: One track's blocks: track is parser or ocr, type is text, table, figure or math.
BLOCKS = f"doc_id long, page_idx int, track string, seq int, type string, x0 double, y0 double, x1 double, y1 double, text string, lines {LINES}, confidence double, source string, latex string"


def one_line(text: Column, source: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Lines of a block that is a single run of text."""
    box = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    style = F.lit(None).cast("struct<font:string,size:double>")
    span = F.struct(text.alias("text"), box.alias("bbox"), source.alias("source"), style.alias("style"))
    return F.array(F.struct(F.array(span).alias("spans")))


def block(alias: str = "b") -> Column:
    return F.struct(*FIELDS).alias(alias)
