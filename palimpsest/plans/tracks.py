"""Two deterministic tracks derived from `documents` by integer arithmetic: blocks with boxes, kinds and text.

A document's lines (without control characters; a longer one goes on in further visual lines of at most 200 characters,
broken after a blank where there is one, so that no character is lost) fall on pages of 20; each track keeps its own part
of them, with its own faults, so that every rule of the fusion meets cases: digital, scanned and hybrid pages, full-page
parser blocks, noise, near duplicates, kinds that differ, pages on which only noise is seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.schema import one_line

LINES_A_PAGE, LINE_WIDTH = 20, 200
#: Consecutive matches make up the whole line: its rest if that fits, else up to the last blank that fits, else a full width.
WRAP = f".{{1,{LINE_WIDTH}}}$|.{{0,{LINE_WIDTH - 1}}} |.{{{LINE_WIDTH}}}"
#: Not part of a line. Fixed ranges, the same in both engines.
CONTROL = r"[\x00-\x1F\x7F]"


#: Parts for each part that the table is read in: a part's lines and words, many times its texts, are sorted in one task.
PARTS = 8


def spread(docs: DataFrame) -> DataFrame:
    """Documents dealt by key, as texts. All that is grouped by document, page or line afterwards stays in its task, so
    neither lines nor words nor blocks shuffle, which are many times as large."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(max(cores, PARTS * docs.rdd.getNumPartitions()), "doc_id")


def lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, line_no (visual lines, from 0), line (not empty), page_idx, k (place on the page).

    whole: also a page's lines as one text, with the page's first line and on every fifth document only (else null)."""
    clean = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, CONTROL, ""))
    # Only a line end ends a line, here as in the second engine; no other line separator may lose its text.
    visual = F.flatten(F.transform(clean, lambda x: F.when(F.length(x) <= LINE_WIDTH, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(f"(?d){WRAP}"), F.lit(0)))))

    def pieces(v: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            k = i % LINES_A_PAGE
            said = lambda n: F.filter(F.slice(v, i - k + 1, n), lambda y: y != "")
            first = F.expr("doc_id % 5 = 0") & (x != "") & (F.size(said(k)) == 0)
            return F.struct(x.alias("line"), F.when(first, F.array_join(said(F.lit(LINES_A_PAGE)), " ")).alias("whole"))

        return F.transform(v, piece)

    of = spread(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"))
    if whole:
        # A one-element array binds the lines once.
        out = of.select("doc_id", F.posexplode(F.flatten(F.transform(F.array(visual), pieces))).alias("line_no", "r")).select("doc_id", "line_no", "r.line", "r.whole").where("line <> ''")
    else:
        out = of.select("doc_id", F.posexplode(visual).alias("line_no", "line")).where("line <> ''")
    return out.withColumn("page_idx", F.expr(f"line_no div {LINES_A_PAGE}").cast("int")).withColumn("k", F.col("line_no") % LINES_A_PAGE)


def _kind(*cases: tuple[str, str]):
    out = None
    for cond, kind in cases:
        out = F.when(F.expr(cond), kind) if out is None else out.when(F.expr(cond), kind)
    return out.otherwise("text")


def blocks(docs: DataFrame) -> DataFrame:
    """Both tracks as block rows (see schema.BLOCKS)."""
    at = lines(docs, whole=True).withColumn("x", F.expr("60.0D + 480 * (k % 2)")).withColumn("y", F.expr("40.0D + 60 * (k div 2)"))
    kind = _kind(("(doc_id * 7 + line_no * 3) % 23 = 0", "table"), ("(doc_id * 7 + line_no * 3) % 23 = 1", "figure"), ("(doc_id * 7 + line_no * 3) % 23 = 2", "math"))
    ocr_kind = F.when(F.expr("(doc_id + line_no) % 37 = 0"), "figure").otherwise(kind)
    num = lambda e: F.expr(f"cast({e} AS double)")

    def row(track: str, seq: str, type_, x, y, w: float, h: float, text):
        return F.struct(
            F.lit(track).alias("track"), F.expr(f"cast({seq} AS int)").alias("seq"), type_.alias("type"), x.alias("x0"), y.alias("y0"), (x + F.lit(w)).alias("x1"), (y + F.lit(h)).alias("y1"), text.alias("raw"),
        )

    x, y = F.col("x"), F.col("y")
    d = num("(doc_id * 13 + line_no * 5) % 21 - 10")
    said = F.expr(
        "CASE (doc_id + line_no) % 4 WHEN 0 THEN line WHEN 1 THEN replace(line, 'l', '1') WHEN 2 THEN substring(line, 1, cast(length(line) div 2 AS int)) ELSE translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END"
    )
    # A line's blocks are made in one pass: what each track sees of it, noise beside it, the line once more, and with a
    # page's first line the page as one block.
    seen = (
        ("doc_id % 3 <> 1 OR line_no % 4 = 0", row("parser", "k", kind, x, y, 400.0, 40.0, F.col("line"))),
        ("(doc_id % 3 <> 0 OR line_no % 4 = 0) AND (doc_id * 31 + line_no * 7) % 10 <> 0", row("ocr", "k", ocr_kind, x + d, y + d, 400.0, 40.0, said)),
        ("(doc_id + line_no) % 29 = 0", row("ocr", "k + 100", F.lit("text"), x + F.lit(410.0), y, 30.0, 20.0, F.lit("## .."))),
        ("(doc_id * 3 + line_no) % 17 = 0", row("ocr", "k + 200", F.lit("text"), x + F.lit(3.0), y + F.lit(3.0), 400.0, 40.0, F.col("line"))),
        ("whole IS NOT NULL", row("parser", "1000", F.lit("text"), F.lit(0.0), F.lit(0.0), 1000.0, 1400.0, F.col("whole"))),
    )
    both = at.select("doc_id", "page_idx", F.explode(F.array(*(F.when(F.expr(cond), r) for cond, r in seen))).alias("r")).where("r IS NOT NULL").select("doc_id", "page_idx", "r.*")
    is_text = F.col("type") == "text"
    text = F.when(is_text, F.col("raw"))
    return both.select(
        "doc_id", "page_idx", "track", "seq", "type", "x0", "y0", "x1", "y1", text.alias("text"),
        F.when(is_text, one_line(F.col("raw"), F.col("track"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("lines"),
        F.when(F.col("track") == "parser", F.lit(0.6)).otherwise(F.lit(0.5)).alias("confidence"),
        F.col("track").alias("source"),
        F.when((F.col("type") == "math") & (F.col("seq") % 2 == 0), F.concat(F.lit("x_"), F.col("seq").cast("string"))).alias("latex"),
    )


def pages(docs: DataFrame) -> DataFrame:
    """The pages that the tracks know of, with their sizes: those with lines, and a blank one at the end of some documents."""
    last = lines(docs).groupBy("doc_id").agg((F.max("page_idx") + F.expr("cast(any_value(doc_id) % 7 = 0 AS int)")).alias("last"))
    rows = last.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("page_idx"))
    return rows.select("doc_id", "page_idx", F.expr("cast(1000 + 10 * ((doc_id + page_idx) % 3) AS int)").alias("width"), F.lit(1400).alias("height"))


#: The same tracks for DuckDB, as common table expressions: `blk` has the blocks, `pgs` the pages.
SQL = f"""
lin AS (
  SELECT doc_id, line_no, line, CAST(line_no // 20 AS INTEGER) AS page_idx, line_no % 20 AS k,
         CAST(60 + 480 * ((line_no % 20) % 2) AS DOUBLE) AS x, CAST(40 + 60 * ((line_no % 20) // 2) AS DOUBLE) AS y,
         (doc_id * 7 + line_no * 3) % 23 AS c
  FROM (SELECT doc_id, i - 1 AS line_no, visual[i] AS line
        FROM (SELECT doc_id, visual, unnest(range(1, len(visual) + 1)) AS i
              FROM (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_replace(x, '{CONTROL}', '', 'g') = '' THEN [''] ELSE regexp_extract_all(regexp_replace(x, '{CONTROL}', '', 'g'), '{WRAP}') END)) AS visual
                    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)))
  WHERE line <> ''
),
raw_blk AS (
  SELECT doc_id, page_idx, 'parser' AS track, k AS seq, CASE c WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'math' ELSE 'text' END AS type,
         x AS x0, y AS y0, x + 400 AS x1, y + 40 AS y1, line AS raw
  FROM lin WHERE doc_id % 3 <> 1 OR line_no % 4 = 0
  UNION ALL
  SELECT doc_id, page_idx, 'ocr', k, CASE WHEN (doc_id + line_no) % 37 = 0 THEN 'figure' ELSE CASE c WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'math' ELSE 'text' END END,
         x + d, y + d, x + d + 400, y + d + 40,
         CASE (doc_id + line_no) % 4 WHEN 0 THEN line WHEN 1 THEN replace(line, 'l', '1') WHEN 2 THEN left(line, CAST(length(line) // 2 AS INTEGER)) ELSE translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END
  FROM (SELECT *, CAST((doc_id * 13 + line_no * 5) % 21 - 10 AS DOUBLE) AS d FROM lin)
  WHERE (doc_id % 3 <> 0 OR line_no % 4 = 0) AND (doc_id * 31 + line_no * 7) % 10 <> 0
  UNION ALL
  SELECT doc_id, page_idx, 'ocr', k + 100, 'text', x + 410, y, x + 410 + 30, y + 20, '## ..' FROM lin WHERE (doc_id + line_no) % 29 = 0
  UNION ALL
  SELECT doc_id, page_idx, 'ocr', k + 200, 'text', x + 3, y + 3, x + 3 + 400, y + 3 + 40, line FROM lin WHERE (doc_id * 3 + line_no) % 17 = 0
  UNION ALL
  SELECT doc_id, page_idx, 'parser', 1000, 'text', 0.0, 0.0, 1000.0, 1400.0, string_agg(line, ' ' ORDER BY line_no)
  FROM lin WHERE doc_id % 5 = 0 GROUP BY doc_id, page_idx
),
blk AS (
  SELECT doc_id, page_idx, track, CAST(seq AS INTEGER) AS seq, type, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
         CASE WHEN type = 'text' THEN raw END AS text, CASE WHEN type = 'math' AND seq % 2 = 0 THEN 'x_' || CAST(seq AS VARCHAR) END AS latex
  FROM raw_blk
),
pgs AS (
  SELECT doc_id, page_idx, CAST(1000 + 10 * ((doc_id + page_idx) % 3) AS INTEGER) AS width, 1400 AS height
  FROM (SELECT doc_id, CAST(unnest(range(0, max(page_idx) + 1 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END)) AS INTEGER) AS page_idx FROM lin GROUP BY doc_id)
)
"""
