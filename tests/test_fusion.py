"""Alignment, the decision table, the filters and the order, on pages built for each case."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.hangul import merge_pieces_text
from palimpsest.operators import align, fuse, ocr_post, order, resolve
from palimpsest.plans.schema import BLOCKS
from palimpsest.sinks import export

FULL = (0, 0, 1000, 1400)


def row(track, seq, text, box=(0, 0, 100, 20), type_="text", page=0, latex=None, doc=1):
    x0, y0, x1, y1 = map(float, box)
    lines = None if type_ != "text" else [{"spans": [{"text": text, "bbox": {"x0": x0, "y0": y0, "x1": x1, "y1": y1}, "source": track, "style": None}]}]
    return (doc, page, track, seq, type_, x0, y0, x1, y1, text if type_ == "text" else None, lines, 0.5, track, latex)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), BLOCKS)


def run(spark, *rows):
    return [r.asDict() for r in fuse.fuse(frame(spark, *rows)).orderBy("pos").collect()]


def pair(spark, parser, ocr, cls):
    a = align.align(frame(spark, parser, ocr)).withColumn("class", F.lit(cls))
    return resolve.resolve_pairs(a.where("match = 'matched'")).first()["out"].asDict()


def test_align_contested(spark):
    b = frame(spark, row("parser", 0, "a", (0, 0, 50, 50)), row("parser", 1, "b", (5, 5, 55, 55)), row("parser", 2, "c", (900, 1300, 950, 1350)), row("ocr", 0, "a", (4, 4, 54, 54)), row("ocr", 1, "b", (20, 20, 70, 70)))
    got = {(r["match"], r["p"]["seq"] if r["p"] else None, r["o"]["seq"] if r["o"] else None) for r in align.align(b).collect()}
    assert got == {("matched", 0, 0), ("matched", 1, 1), ("parser_only", 2, None)}


def test_align_one_side(spark):
    got = align.align(frame(spark, row("ocr", 0, "x"))).collect()
    assert [(r["match"], r["ocr_left"]) for r in got] == [("ocr_only", 1)]


A, B = "the quick brown fox jumps over it", "completely other words stand here now"
NEAR = "the quick brown fox jumps over 1t"


@pytest.mark.parametrize(
    ("parser", "ocr", "cls", "source", "text"),
    [
        (A, NEAR, "scanned", "fused", NEAR),
        (A, NEAR, "digital", "fused", A),
        (A, B, "digital", "parser", A),
        (A, B, "hybrid", "parser", A),
        (A, B, "scanned", "ocr", B),
        (A, "......", "scanned", "parser", A),
        ("short", "x" + B * 4, "hybrid", "ocr", "x" + B * 4),
        ("ㄱㄴㄷ", "한글 문서 " * 12, "digital", "ocr", "한글 문서 " * 12),
        ("ㄱㄴㄷ", "한글 문서 " * 12, "hybrid", "ocr", "한글 문서 " * 12),
    ],
)
def test_pairs(spark, parser, ocr, cls, source, text):
    out = pair(spark, row("parser", 0, parser), row("ocr", 0, ocr), cls)
    assert (out["source"], out["text"], out["type"]) == (source, text, "text")
    assert (out["x0"], out["x1"]) == (0.0, 100.0)


def test_pair_oversized(spark):
    mid = "the quick brown fox stands here now over it"
    out = pair(spark, row("parser", 0, A, FULL), row("ocr", 0, NEAR, (10, 10, 900, 1300)), "hybrid")
    assert (out["source"], out["text"], out["x1"]) == ("ocr", NEAR, 1000.0)
    out = pair(spark, row("parser", 0, A, FULL), row("ocr", 0, B, (10, 10, 900, 1300)), "digital")
    assert (out["source"], out["x1"]) == ("ocr", 900.0)
    out = pair(spark, row("parser", 0, A, FULL), row("ocr", 0, mid, (10, 10, 900, 1300)), "digital")
    assert out["source"] in ("ocr", "parser")
    out = pair(spark, row("parser", 0, A, FULL), row("ocr", 0, None, (10, 10, 900, 1300), "math", latex="x"), "digital")
    assert (out["type"], out["source"], out["latex"]) == ("math", "ocr", "x")
    out = pair(spark, row("parser", 0, "한글 문서 테스트", FULL), row("ocr", 0, "다른 내용 없음 합니", (10, 10, 900, 1300)), "digital")
    assert out["source"] == "parser"


def test_pair_kinds(spark):
    out = pair(spark, row("parser", 0, None, (0, 0, 100, 20), "math", latex="a"), row("ocr", 0, None, (5, 5, 110, 30), "math", latex="b"), "digital")
    assert (out["type"], out["source"], out["x1"], out["y1"], out["latex"]) == ("figure", "fused", 110.0, 30.0, None)


def test_same_text_fuses(spark):
    got = run(spark, row("parser", 0, "Hello"), row("ocr", 0, "Hello", (2, 2, 102, 22)))
    assert [(g["source"], g["text"]) for g in got] == [("fused", "Hello")]
    assert got[0]["debug"]["similarity"] == 1.0


LONG = "This parser paragraph is long enough to lead the page and to be trusted. " * 2


def test_duplicate_dropped_unique_kept(spark):
    wide = (0, 0, 900, 700)
    b = frame(spark, row("parser", 0, LONG, wide), row("ocr", 0, "long enough to lead the page", (0, 900, 50, 920)), row("ocr", 1, "Appendix C checksum 9A7F", (0, 1300, 300, 1340)))
    m = resolve.merge(fuse.aligned(b).withColumn("class", F.lit("hybrid")))
    kept = {r["text"] for r in resolve.drop_redundant_ocr(m).collect()}
    assert "Appendix C checksum 9A7F" in kept
    assert "long enough to lead the page" not in kept


def test_korean_filters(spark):
    good = "한국어 문서의 본문은 충분히 길고 또한 믿을 만합니다 그렇습니다"
    b = frame(spark, row("parser", 0, good, (0, 0, 400, 40)), row("ocr", 0, "한글 조각", (0, 800, 100, 820)), row("ocr", 1, "English words stay", (0, 1000, 100, 1020)))
    m = resolve.merge(fuse.aligned(b).withColumn("class", F.lit("digital")))
    assert {r["text"] for r in resolve.drop_korean_ocr(m).collect()} == {good, "English words stay"}
    bad = "ㄱㄴㄷㄹㅁㅂㅅ"
    m = resolve.merge(fuse.aligned(frame(spark, row("parser", 0, bad), row("ocr", 0, "한글 문서", (0, 900, 100, 920)))).withColumn("class", F.lit("digital")))
    assert {r["text"] for r in resolve.drop_degraded_parser(m).collect()} == {"한글 문서"}


def test_reliable_parser_drops_ocr(spark):
    parser = [row("parser", i, f"Sentence number {i} of a parser text that goes on for a while, plainly.", (0, 60 * i, 400, 60 * i + 40)) for i in range(4)]
    ocr = [row("ocr", 9, "something optical elsewhere", (600, 1300, 900, 1340)), row("ocr", 10, None, (600, 1000, 900, 1100), "figure")]
    got = run(spark, *parser, *ocr)
    assert not [g for g in got if g["source"] == "ocr" and g["type"] == "text"]
    assert [g["type"] for g in got if g["source"] == "ocr"] == ["figure"]


def test_full_page_block_gives_way(spark):
    ocr = [row("ocr", i, f"optical line number {i} says things", (600 + i, 60 * i, 900, 60 * i + 40)) for i in range(11)]
    far = [row("ocr", 20, "x1 y2 closest words", (450, 650, 550, 750))]
    got = run(spark, row("parser", 0, None, FULL, "table"), *ocr, *far)
    assert not [g for g in got if g["type"] == "table"]


def test_reading_order(spark):
    left = [row("ocr", i, f"l{i}", (50, 200 + 100 * i, 450, 240 + 100 * i)) for i in range(3)]
    right = [row("ocr", 10 + i, f"r{i}", (550, 200 + 100 * i, 950, 240 + 100 * i)) for i in range(3)]
    spans = [row("ocr", 20, "head", (50, 20, 950, 60)), row("ocr", 21, "foot", (50, 900, 950, 940)), row("ocr", 22, "mid", (450, 310, 560, 330))]
    got = order.reading_order(frame(spark, *right, *left, *spans)).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["head", "l0", "l1", "l2", "r0", "r1", "r2", "mid", "foot"]
    two = order.reading_order(frame(spark, row("ocr", 0, "b", (0, 500, 9, 510)), row("ocr", 1, "a"))).orderBy("pos").collect()
    assert [r["text"] for r in two] == ["b", "a"]


def test_one_shuffle(spark):
    """The whole fusion shuffles once, on the page key."""
    df = fuse.fuse(frame(spark, row("parser", 0, "a"), row("ocr", 0, "b")))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    full = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert full.count("Exchange hashpartitioning") == 1


def token(seq, text, box, kind="text", conf=0.5):
    return (1, 0, seq, kind, text, *map(float, box), conf, None)


TOK = "doc_id long, page_idx int, seq int, block_type string, text string, x0 double, y0 double, x1 double, y1 double, confidence double, latex string"


def test_merge_adjacent(spark):
    t = spark.createDataFrame(
        [token(0, "문", (0, 0, 20, 20)), token(1, "서", (25, 1, 45, 21)), token(2, "table x", (0, 50, 9, 60), "table"), token(3, "입", (50, 0, 70, 20)), token(4, "far away", (400, 0, 450, 20)), token(5, "far away", (400, 0, 450, 20)), token(6, "....", (0, 90, 9, 99))], TOK,
    )
    got = ocr_post.post_process(t, ["doc_id", "page_idx"]).orderBy("pos").collect()
    # The recognizer's noise rule drops single letters before anything is merged.
    assert [r["text"] for r in got] == ["far away", "table x"]
    merged = ocr_post.merge_adjacent(t.where("seq < 5"), ["doc_id", "page_idx"]).orderBy("pos").collect()
    assert [(r["text"], r["x1"]) for r in merged] == [("문서입", 70.0), ("far away", 450.0), ("table x", 9.0)]


def test_merge_joins_step_by_step(spark):
    """Loose jamo that meet in a join compose; runs collapse before the next piece comes; splits close."""
    line = lambda *texts: [token(i, t, (25 * i, 0, 25 * i + 20, 20)) for i, t in enumerate(texts)]
    got = lambda *texts: [r["text"] for r in ocr_post.merge_adjacent(spark.createDataFrame(line(*texts), TOK), ["doc_id", "page_idx"]).orderBy("pos").collect()]
    assert got("\u1112", "\u1161\u11ab") == ["한"]
    assert got("가", "나", "다", "라") == ["가나다 라"]
    assert got("가 나 다", "라") == ["가나다라"]
    assert got("보고서입", "니다") == ["보고서입니다"]
    assert got("plain", "ascii  words") == ["plain ascii  words"]
    assert merge_pieces_text(["x y z"], False) == "x y z"


def test_fallback_on_silent_pages(spark):
    page = ["doc_id", "page_idx"]
    t = spark.createDataFrame([token(0, "enough said on this page by the recognizer to stand alone, surely", (0, 0, 900, 20)), token(1, "b", (0, 0, 9, 9)), token(2, "c", (0, 0, 9, 9))], TOK)
    word = lambda p, n, s: (1, p, n, 0, 0, 0, s, "90", 10 + 60 * n, 10, 50, 20)
    w = spark.createDataFrame([word(0, 0, "hidden"), word(1, 0, "seen"), word(1, 1, "words")], "doc_id long, page_idx int, seq int, block_num int, par_num int, line_num int, text string, conf string, left int, top int, width int, height int")
    got = {(r["page_idx"], r["text"]) for r in ocr_post.with_fallback(t, w, page).collect()}
    assert (1, "seen words") in got and not any("hidden" in x for _, x in got)
    pages = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id long, page_idx int")
    assert sorted((r["page_idx"], r["n_tokens"], r["fallback"]) for r in ocr_post.needs_fallback(t, page, pages).collect()) == [(0, 3, False), (1, 0, True), (2, 0, True)]


def test_blank_pages_are_exported(spark):
    """Page 2 holds noise alone and page 3 nothing: both have a header, an entry and a debug page."""
    b = frame(spark, row("parser", 0, "Hello world", (0, 0, 100, 20)), row("ocr", 0, "##", page=1), row("parser", 0, "Last page", page=3))
    pages = fuse.page_list(b, spark.createDataFrame([(1, 2, 800, 1500), (1, 0, 1100, 1400), (1, 0, 900, 1600)], "doc_id long, page_idx int, width int, height int"))
    f = fuse.fuse(b)
    import json

    assert export.text_documents(f, pages=pages).first()["content"].count("=== Page") == 4
    got = json.loads(export.json_documents(f, b, pages).first()["content"])["pages"]
    assert [(p["page_idx"], p["width"], p["height"], len(p["blocks"]), len(p["debug"]["ocr_blocks"])) for p in got] == [(0, 1100, 1600, 1, 0), (1, 1000, 1400, 0, 1), (2, 800, 1500, 0, 0), (3, 1000, 1400, 1, 0)]
    files = {r["path"]: r["content"] for r in export.all_documents(b, f, pages).collect()}
    assert len(files) == 3 + 3 * 4 and files["page_003.txt"] == "" and files["document.json"] == export.json_documents(f, b, pages).first()["content"]
    assert files["document.txt"] == export.text_documents(f, pages=pages).first()["content"] and files["document.md"] == export.markdown_documents(f, pages=pages).first()["content"]
    assert {r["path"]: r["content"] for r in export.html_pages(b, f, pages).collect()} == {k: v for k, v in files.items() if k.startswith("debug/")}


def test_candidates_first_tie(spark):
    c = spark.createDataFrame([(1, 0, "hello there", 80.0), (1, 1, "hello there", 80.0), (2, 0, "", 0.0)], "b long, cand_ord int, text string, conf double")
    got = {r["b"]: r for r in ocr_post.best_candidate(c, ["b"]).collect()}
    assert got[1]["text"] == "hello there" and got[1]["confidence"] == pytest.approx(0.8)
    assert got[2]["text"] == "" and got[2]["confidence"] == pytest.approx(0.05)


def test_exports(spark):
    f = fuse.fuse(frame(spark, row("parser", 0, "Hello world", (0, 0, 100, 20)), row("ocr", 0, None, (459, 310, 712, 347), "math", latex="x^2"), row("ocr", 1, None, (0.5, 800, 100, 850), "table")))
    text = export.text_documents(f).first()["content"]
    assert text.startswith("=== Page 1 ===\n\n") and "[MATH at x:459 y:310 w:253 h:37]" in text and "[TABLE at x:0 y:800 w:100 h:50]" in text
    assert "[MATH] x^2" in export.text_documents(f, latex=True).first()["content"]
    md = export.markdown_documents(f).first()["content"]
    assert md.startswith("# Document\n\n---\n\n## Page 1\n\nHello world\n\n") and "$$\nx^2\n$$" in md
    rich = export.markdown_pages(f, F.lit(True)).first()["content"]
    assert "**Math Equation 2:**" in rich and "![Table](figures/page_001_table__02.png)" in rich
    import json

    page = json.loads(export.json_documents(f).first()["content"])["pages"][0]
    assert page["class"] == "hybrid" and [b["type"] for b in page["blocks"]] == ["TextBlock", "MathBlock", "TableBlock"]
    assert page["blocks"][0]["lines"][0]["spans"][0]["text"] == "Hello world" and "lines" not in page["blocks"][1]
