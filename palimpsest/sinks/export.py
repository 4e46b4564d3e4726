"""Fused pages as JSON, Markdown, plain text and debug HTML: frames of (doc_id, path, content), one row a file.

A block's number counts all blocks of the page, also those left out, so it is taken before any filter. Numbers are
written without decimals, halves to even.

Every exporter takes the list of pages (operators/fuse.py: page_list) besides the fused blocks, so that a page on which
nothing is left still has its header, its JSON entry and its files. The list joins the aggregation as one row a page,
which costs no join. Without a list, the pages are those that have fused blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.geometry import Box
from palimpsest.plans.schema import PAGE, PAGE_HEIGHT, PAGE_WIDTH
from palimpsest.runtime import save, ship, stack


def body() -> Column:
    """A text block's body, or nothing where it is broken parser text or optical noise."""
    skip = lambda b: T.skip_degraded_parser(F.col("source"), b) | T.skip_noisy_ocr(F.col("source"), b)
    return T.bound(F.coalesce(T.block_body(F.col("lines")), F.lit("")), lambda b: F.when(skip(b), F.lit("")).otherwise(b))


def text_block(latex: bool = False) -> Column:
    """latex: math with LaTeX is written as such, as the application's own view does."""
    b, r = Box.of(), T.rounded
    place = F.concat(F.lit("["), F.upper("type"), F.lit(" at x:"), r(b.x0), F.lit(" y:"), r(b.y0), F.lit(" w:"), r(b.width), F.lit(" h:"), r(b.height), F.lit("]"))
    out = F.when(F.col("type") == "text", body())
    if latex:
        out = out.when((F.col("type") == "math") & (F.trim(F.coalesce("latex", F.lit(""))) != ""), F.concat(F.lit("[MATH] "), F.col("latex")))
    return out.otherwise(place)


def markdown_block(with_place: bool, has_image: Column | None = None) -> Column:
    """Without page images a box's size stands for it, in the document with its place; with them a link to its cut-out."""
    b, r = Box.of(), T.rounded
    size = F.concat(r(b.width), F.lit("x"), r(b.height))
    place = F.concat(F.lit(" at ("), r(b.x0), F.lit(", "), r(b.y0), F.lit(")")) if with_place else F.lit("")
    box = F.concat(F.lit("\n["), F.upper("type"), F.lit(": "), size, place, F.lit("]\n"))
    latex = F.coalesce("latex", F.lit(""))
    math = (F.col("type") == "math") & (latex != "")
    plain = F.when(F.col("type") == "text", body()).when(math, F.concat(F.lit("\n$$\n"), latex, F.lit("\n$$\n"))).otherwise(box)
    if has_image is None:
        return plain
    label = F.when(F.col("type") == "math", "Math Equation").otherwise(F.initcap("type"))
    head = F.concat(F.lit("\n**"), label, F.lit(" "), (F.col("pos") + 1).cast("string"), F.lit(":**\n\n"))
    link = F.concat(F.lit("!["), F.initcap("type"), F.lit("]("), figure_path(), F.lit(")\n"))
    rich = F.when(F.col("type") == "text", body()).when(math, F.concat(head, F.lit("$$\n"), latex, F.lit("\n$$\n"))).when(crop_box()["w"] > 0, F.concat(head, link)).otherwise(F.lit(""))
    return F.when(has_image, rich).otherwise(plain)


def figure_path() -> Column:
    return F.format_string("figures/page_%03d_%s__%02d.png", F.col("page_idx") + 1, F.col("type"), F.col("pos"))


def crop_box(width: int = 1000, height: int = 1400) -> Column:
    """The part of a page image that a block covers: x, y, w, h; w is 0 if nothing is left."""
    b = Box.of()
    x, y = (F.greatest(F.floor(v), F.lit(0)) for v in (b.x0, b.y0))
    w = F.least(F.floor(b.width), F.lit(width) - x)
    h = F.least(F.floor(b.height), F.lit(height) - y)
    ok = (w > 0) & (h > 0)
    return F.struct(x.alias("x"), y.alias("y"), F.when(ok, w).otherwise(0).alias("w"), F.when(ok, h).otherwise(0).alias("h"))


def _with_list(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    """rows and one row for each page of the list, all else null."""
    return rows if pages is None else stack(rows, pages.select(*PAGE).distinct(), PAGE)


def _in_order(number: str, value: str) -> Column:
    """Values of a group in order; nulls and empty ones left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col(value) != "", F.struct(number, value)))), lambda x: x[value])


def _page_text(block: str) -> Column:
    """A page's non-empty blocks in order, each with an empty line after it."""
    return F.array_join(F.transform(_in_order("pos", block), lambda x: F.concat(x, F.lit("\n\n"))), "")


def _pages(fused: DataFrame, block: Column, pages: DataFrame | None = None) -> DataFrame:
    """Page key and the page's text."""
    rows = _with_list(fused.select(*PAGE, "pos", block.alias("block")), pages)
    return rows.groupBy(*PAGE).agg(_page_text("block").alias("page"))


def _documents(pages: DataFrame, head: str, page: Column, name: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_idx", page.alias("content")))), lambda x: x["content"])
    return pages.groupBy("doc_id").agg(F.concat(F.lit(head), F.array_join(parts, "")).alias("content")).select("doc_id", F.lit(name).alias("path"), "content")


def _number() -> Column:
    return (F.col("page_idx") + 1).cast("string")


def _page_path(ending: str) -> Column:
    return F.format_string(f"page_%03d.{ending}", F.col("page_idx") + 1)


def _text_page(page: str = "page") -> Column:
    return F.concat(F.lit("=== Page "), _number(), F.lit(" ===\n\n"), F.col(page), F.lit("\n"))


def _markdown_part(page: str = "page") -> Column:
    return F.concat(F.lit("---\n\n## Page "), _number(), F.lit("\n\n"), F.col(page))


def _markdown_page(page: str = "page") -> Column:
    return F.concat(F.lit("# Page "), _number(), F.lit("\n\n"), F.col(page))


def text_documents(fused: DataFrame, latex: bool = False, pages: DataFrame | None = None) -> DataFrame:
    return _documents(_pages(fused, text_block(latex), pages), "", _text_page(), "document.txt")


def text_pages(fused: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    return _pages(fused, text_block(), pages).select("doc_id", _page_path("txt").alias("path"), F.col("page").alias("content"))


def combined_text(fused: DataFrame, names: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """What the application shows of several files: each file's text under a header with its path. names: doc_id, path.
    One row a file, so that no row grows with the number of files; read them in the order of `path`."""
    t = text_documents(fused, latex=True, pages=pages).drop("path").join(names.select("doc_id", "path"), "doc_id")
    return t.select("doc_id", "path", F.concat(F.lit("===== "), F.col("path"), F.lit(" =====\n\n"), F.col("content"), F.lit("\n")).alias("content"))


def markdown_documents(fused: DataFrame, has_image: Column | None = None, pages: DataFrame | None = None) -> DataFrame:
    return _documents(_pages(fused, markdown_block(True, has_image), pages), "# Document\n\n", _markdown_part(), "document.md")


def markdown_pages(fused: DataFrame, has_image: Column | None = None, pages: DataFrame | None = None) -> DataFrame:
    return _pages(fused, markdown_block(False, has_image), pages).select("doc_id", _page_path("md").alias("path"), _markdown_page().alias("content"))


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.round(x, 4).cast("string"), "\\.0$", "")


def layers(blocks: DataFrame, fused: DataFrame) -> DataFrame:
    """Blocks of both tracks and of the fusion, one under the other: layer_no 0, 1, 2."""
    none = F.lit(None).cast("struct<parser_text:string,ocr_text:string,final_text:string,similarity:double>")
    cols = [*PAGE, "type", "x0", "y0", "x1", "y1", "text", "confidence", "source"]
    tracks = blocks.select(*cols, F.col("seq").alias("place"), F.col("track").alias("layer"), F.when(F.col("track") == "parser", 0).otherwise(1).alias("layer_no"), none.alias("debug"))
    return stack(tracks, fused.select(*cols, F.col("pos").alias("place"), F.lit("fused").alias("layer"), F.lit(2).alias("layer_no"), "debug"), PAGE)


def html_div() -> Column:
    """A box of the debug view, with what is known of it as data attributes. The element, its classes and the names of its
    attributes are a fixed output format."""
    b, esc = Box.of(), lambda c: T.html_escape(F.coalesce(c, F.lit("")))
    # Three decimals, halves to even; format_string would round them up.
    mille = F.bround(F.col("debug.similarity") * F.lit(1000.0), 0).cast("long")
    sim = F.coalesce(F.concat(F.floor(mille / 1000).cast("string"), F.lit("."), F.lpad((mille % 1000).cast("string"), 3, "0")), F.lit(""))
    parts = [
        "<div class='bbox ", F.col("layer"), " ", F.col("type"), "' style='left:", _plain(b.x0), "px; top:", _plain(b.y0), "px; width:", _plain(b.width), "px; height:", _plain(b.height),
        "px;' data-text='", esc(F.col("text")), "' data-type='", F.col("type"), "' data-provenance='", F.col("source"), "' data-confidence='", _plain(F.col("confidence")),
        "' data-parser-text='", esc(F.col("debug.parser_text")), "' data-ocr-text='", esc(F.col("debug.ocr_text")), "' data-final-text='", esc(F.col("debug.final_text")), "' data-similarity='", sim, "'></div>",
    ]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


STYLE = """
:root { --line: #d0d4da; }
body { margin: 0; padding: 1rem; background: #f4f5f7; font: 14px/1.4 system-ui, sans-serif; display: flex; gap: 1rem; align-items: flex-start; }
main { position: relative; background: #fff; outline: 1px solid var(--line); }
aside { position: sticky; top: 1rem; width: 20rem; }
dl { margin: 0; padding: .75rem; background: #fff; outline: 1px solid var(--line); overflow-wrap: anywhere; }
dt { color: #5b6470; } dd { margin: 0 0 .5rem; white-space: pre-wrap; }
.bbox { position: absolute; box-sizing: border-box; outline-style: solid; outline-width: 1px; opacity: .85; }
.parser { outline-color: #3367d6; } .ocr { outline-color: #c5221f; outline-style: dashed; } .fused { outline-color: #137333; outline-width: 3px; }
.table { background: #fbbc0433; } .figure { background: #a142f433; } .math { background: #24c1e033; }
"""
SCRIPT = """
const facts = document.querySelector('dl');
document.querySelector('main').onclick = event => {
  if (!event.target.matches('.bbox')) return;
  facts.replaceChildren(...Object.keys(event.target.dataset).flatMap(name => {
    const term = document.createElement('dt'), value = document.createElement('dd');
    term.append(name); value.append(event.target.dataset[name]);
    return [term, value];
  }));
};
"""
#: Around the boxes of a page: before its number, between it and its image, between image and boxes, and after them.
FRAME = (
    "<!DOCTYPE html>\n<html lang='en'>\n<meta charset='utf-8'>\n<title>Layers of page ",
    f"</title>\n<style>{STYLE}</style>\n<main>\n<img alt='' src='",
    "'>\n",
    f"\n</main>\n<aside><dl><dt>No box chosen</dt></dl></aside>\n<script>{SCRIPT}</script>\n</html>\n",
)


def _html_page(divs: str) -> Column:
    a, b, c, d = (F.lit(x) for x in FRAME)
    return F.concat(a, _number(), b, _page_path("png"), c, F.col(divs), d)


def html_pages(blocks: DataFrame, fused: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """A page's debug view: all three layers over the page image."""
    rows = _with_list(layers(blocks, fused).select(*PAGE, F.struct("layer_no", "place").alias("at"), html_div().alias("div")), pages)
    divs = rows.groupBy(*PAGE).agg(F.array_join(_in_order("at", "div"), "").alias("divs"))
    return divs.select("doc_id", F.concat(F.lit("debug/"), _page_path("html")).alias("path"), _html_page("divs").alias("content"))


NO_DEBUG = "struct<parser_text:string,ocr_text:string,final_text:string,similarity:double>"


def json_block(debug: Column) -> Column:
    """A block with the fields of its kind only: lines for text, latex for math that has some."""
    box = F.struct("x0", "y0", "x1", "y1")
    tag = F.concat(F.initcap("type"), F.lit("Block"))
    opts = {"ignoreNullFields": "false"}
    base = [tag.alias("type"), box.alias("bbox")]
    rest = [F.col("confidence"), F.col("source")]
    text = F.to_json(F.struct(*base, F.col("lines"), *rest, debug.alias("debug")), opts)
    math = F.to_json(F.struct(*base, *rest, F.col("latex"), debug.alias("debug")), opts)
    bare = F.to_json(F.struct(*base, *rest, debug.alias("debug")), opts)
    return F.when(F.col("type") == "text", text).when((F.col("type") == "math") & F.col("latex").isNotNull(), math).otherwise(bare)


def _json_array(number: str, value: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(number).alias("n"), value.alias("j"))))), lambda x: x["j"]), ","), F.lit("]"))


def _json_rows(fused: DataFrame, blocks: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """Fused blocks, the tracks' blocks and the list's pages, one under the other, in JSON."""
    rows = fused.select(*PAGE, "class", F.lit("fused").alias("layer"), F.col("pos").alias("n"), json_block(F.col("debug")).alias("j"))
    if blocks is not None:
        rows = stack(rows, blocks.select(*PAGE, F.col("track").alias("layer"), F.col("seq").alias("n"), json_block(F.lit(None).cast(NO_DEBUG)).alias("j")), PAGE)
    if pages is not None:
        rows = stack(rows, pages.select(*PAGE, "class", "width", "height"), PAGE)
    else:
        rows = rows.withColumn("width", F.lit(None).cast("int")).withColumn("height", F.lit(None).cast("int"))
    return rows


def _json_page(with_debug: bool) -> Column:
    """A page's JSON from the rows of its group."""
    side = lambda t: _json_array("n", F.when(F.col("layer") == t, F.col("j")))
    debug = F.concat(F.lit(',"debug":{"parser_blocks":'), side("parser"), F.lit(',"ocr_blocks":'), side("ocr"), F.lit("}")) if with_debug else F.lit("")
    size = lambda c, d: F.coalesce(F.max(c), F.lit(d)).cast("string")
    return F.concat(
        F.lit('{"page_idx":'), F.col("page_idx").cast("string"), F.lit(',"class":"'), F.coalesce(F.max("class"), F.lit("hybrid")), F.lit('","blocks":'), side("fused"),
        F.lit(',"width":'), size("width", PAGE_WIDTH), F.lit(',"height":'), size("height", PAGE_HEIGHT), debug, F.lit("}"),
    )


def json_documents(fused: DataFrame, blocks: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """document.json: pages with class, blocks and size (the larger of the tracks'); with blocks, also each page's two
    tracks under debug."""
    found = _json_rows(fused, blocks, pages).groupBy(*PAGE).agg(_json_page(blocks is not None).alias("json"))
    return _json_document(found)


def _json_document(pages: DataFrame, column: str = "json") -> DataFrame:
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", F.col(column).alias("p")))), lambda x: x["p"]), ",")
    return pages.groupBy("doc_id").agg(F.concat(F.lit('{"pages":['), parts, F.lit("]}")).alias("content")).select("doc_id", F.lit("document.json").alias("path"), "content")


def page_contents(blocks: DataFrame, fused: DataFrame, pages: DataFrame, has_image: Column | None = None) -> DataFrame:
    """By page, in one aggregation: json, text, markdown (of the document and of the page) and html."""
    json = _json_rows(fused, blocks, pages)
    body_ = fused.select(*PAGE, "pos", text_block().alias("t"), markdown_block(True, has_image).alias("md"), markdown_block(False, has_image).alias("mp"))
    boxes = layers(blocks, fused).select(*PAGE, F.struct("layer_no", "place").alias("at"), html_div().alias("div"))
    rows = stack(stack(json, body_, PAGE), boxes, PAGE)
    return rows.groupBy(*PAGE).agg(_json_page(True).alias("json"), _page_text("t").alias("text"), _page_text("md").alias("md"), _page_text("mp").alias("mp"), F.array_join(_in_order("at", "div"), "").alias("divs"))


def all_documents(blocks: DataFrame, fused: DataFrame, pages: DataFrame, has_image: Column | None = None) -> DataFrame:
    """Every file of every format. The pages' contents are written down once; documents and page files read them."""
    c = save(page_contents(blocks, fused, pages, has_image), "export-pages")
    file = lambda path, content: F.struct(path.alias("path"), content.alias("content"))
    each = F.array(file(F.concat(F.lit("debug/"), _page_path("html")), _html_page("divs")), file(_page_path("txt"), F.col("text")), file(_page_path("md"), _markdown_page("mp")))
    by_page = c.select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.path", "f.content")
    return _json_document(c).unionByName(_documents(c, "", _text_page("text"), "document.txt")).unionByName(_documents(c, "# Document\n\n", _markdown_part("md"), "document.md")).unionByName(by_page)


def write_files(files: DataFrame, base: str) -> DataFrame:
    """Write each row's content (string or binary) as the file <base>/<folder>/<path> and return folder, path and bytes.

    base: a path or URI that all executors share. A file appears under its name when it is whole: it is written beside it
    and then moved, so a task that runs again replaces its own file."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath
        import uuid

        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(base)
        for b in batches:
            sizes = []
            for folder, path, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                target = posixpath.join(root, folder, path)
                fs.create_dir(posixpath.dirname(target), recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as f:
                    f.write(content or b"")
                fs.move(part, target)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["folder", "path", "bytes"])

    rows = files.select("folder", "path", F.col("content").cast("binary").alias("content"))
    return save(rows.mapInArrow(run, "folder string, path string, bytes long"), "export-written")
