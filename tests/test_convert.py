"""Conversion end to end, evaluation, the formula slot and settings."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest import __main__ as cli
from palimpsest import runtime
from palimpsest.operators import evaluate, latex
from palimpsest.plans import convert
from palimpsest.sources import files, render

from .conftest import ROOT
from .test_io import P, W, zipped


def read(*parts):
    return "/".join(map(str, parts)), open("/".join(map(str, parts)), encoding="utf-8").read()


def office_files(folder):
    folder.mkdir()
    (folder / "a.docx").write_bytes(zipped(**{"word/document.xml": f"<w:document {W}><w:p><w:t>Hello paper</w:t></w:p></w:document>"}))
    (folder / "b.PPTX").write_bytes(deck("Slide one", "", "Slide three"))
    (folder / "broken.pptx").write_bytes(b"zip? no")
    (folder / "c.txt").write_bytes(b"plain")


def deck(*texts):
    slides = {f"ppt/slides/slide{i + 1}.xml": f"<p:sld {P}>{f'<p:sp><a:t>{t}</a:t></p:sp>' if t else ''}</p:sld>" for i, t in enumerate(texts)}
    return zipped(**{"ppt/presentation.xml": f"<p:presentation {P}/>", **slides})


def status_of(status):
    return {r["path"].rsplit("/", 1)[1]: r for r in status.collect()}


def test_convert(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    office_files(src)
    (src / "sub").mkdir()
    (src / "sub" / "old.ppt").write_bytes(b"older format\n" + deck("From the old one"))
    (src / "bad.ppt").write_bytes(b"broken")
    ids = {r["path"].rsplit("/", 1)[1]: r["doc_id"] for r in convert.listing(spark, str(src)).collect()}
    ocr = spark.createDataFrame([(ids["a.docx"], 0, 'log\n[{"text":"Hello paper","bbox":[0,0,1000,1400]}]')], "doc_id long, page_idx int, output string")
    status = convert.convert(spark, str(src), str(out), ocr)
    got = status_of(status)
    assert {k: r["success"] for k, r in got.items()} == {"a.docx": True, "b.PPTX": True, "broken.pptx": False, "c.txt": False, "old.ppt": True, "bad.ppt": False}
    assert convert.summary(status).first()[:2] == (3, 3) and "soffice" in got["bad.ppt"]["error"] and got["c.txt"]["error"] == "unsupported extension: txt"
    assert got["a.docx"]["output_dir"] == f"{out}/a" and got["broken.pptx"]["n_files"] == 0
    assert read(out, "a", "document.txt")[1] == "=== Page 1 ===\n\nHello paper\n\n\n"
    assert "From the old one" in read(out, "old", "document.md")[1]
    # The blank slide has its header, its entry and its files.
    assert read(out, "b", "document.txt")[1] == "=== Page 1 ===\n\nSlide one\n\n\n=== Page 2 ===\n\n\n=== Page 3 ===\n\nSlide three\n\n\n"
    pages = json.loads(read(out, "b", "document.json")[1])["pages"]
    assert [(p["page_idx"], len(p["blocks"]), p["class"], p["width"]) for p in pages] == [(0, 1, "hybrid", 1000), (1, 0, "hybrid", 1000), (2, 1, "hybrid", 1000)]
    names = sorted(p.relative_to(out / "b").as_posix() for p in (out / "b").rglob("*") if p.is_file())
    assert names == sorted(["document.json", "document.md", "document.txt", *[f"{x}{n:03d}.{e}" for n in (1, 2, 3) for x, e in (("page_", "txt"), ("page_", "md"), ("debug/page_", "html"))]])
    assert "data-type='text'" in read(out, "b", "debug", "page_001.html")[1] and "data-type" not in read(out, "b", "debug", "page_002.html")[1]
    page = json.loads(read(out, "a", "document.json")[1])["pages"][0]
    # A full-page parser block keeps its box but yields its text to the optical one.
    assert page["blocks"][0]["source"] == "ocr" and page["blocks"][0]["bbox"]["x1"] == 1000.0 and len(page["debug"]["ocr_blocks"]) == 1


def test_pdf_and_recognizer(spark, tmp_path):
    """Text, blank and failing pages of a PDF; images that are read by a command, and one that isn't there."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    pdf = json.dumps({"pages": ["First page. " * 30, "", "FAIL", "NO IMAGE"]})
    (src / "p.pdf").write_text(pdf)
    (src / "none.pdf").write_text("not a pdf")
    (src / "d.docx").write_bytes(zipped(**{"word/document.xml": f"<w:document {W}><w:p><w:t>Word file</w:t></w:p></w:document>"}))
    track = convert.parser_track(spark, str(src))
    assert sorted(r["pages"] for r in convert.page_counts(track.pages).collect()) == [1, 4]
    status = status_of(convert.convert(spark, str(src), str(out), recognizer=[f"{ROOT}/tests/stubs/recognizer"], settings=render.Settings(dpi=150, lang="eng")))
    assert {k: r["success"] for k, r in status.items()} == {"p.pdf": True, "none.pdf": False, "d.docx": True}
    pages = json.loads(read(out, "p", "document.json")[1])["pages"]
    said = [[b["lines"][0]["spans"][0]["text"] for b in p["blocks"] if b["type"] == "TextBlock"] for p in pages]
    assert said[0][0].startswith("First page.") and said[1] == ["picture of  at 150"] and said[2] == ["picture of FAIL at 150"] and said[3] == ["NO IMAGE"]
    assert [b["latex"] for b in pages[1]["blocks"] if b["type"] == "MathBlock"] == ["E=m"]
    md = read(out, "p", "page_002.md")[1]
    # A page with an image shows formulas and links; one without shows boxes.
    assert "**Math Equation 2:**" in md and (out / "p" / "debug" / "page_002-2.png").exists() and not (out / "p" / "debug" / "page_004-4.png").exists()
    assert "picture of office page at 150" in read(out, "d", "document.txt")[1]


def test_command_line(spark, tmp_path, capsys):
    src, out = tmp_path / "in", tmp_path / "out"
    office_files(src)
    spark.createDataFrame([(f"file:{src}/a.docx", 0, '[{"text":"Hello paper","bbox":[0,0,1000,1400]}]')], "path string, page_idx int, output string").write.parquet(f"{tmp_path}/ocr")
    assert cli.main(["convert", str(src), str(out), "--ocr", f"{tmp_path}/ocr", "--dpi", "100", "--quiet"]) == 1
    assert "2 converted, 2 failed" in capsys.readouterr().out
    assert json.loads(read(out, "a", "document.json")[1])["pages"][0]["blocks"][0]["source"] == "ocr"
    with pytest.raises(ValueError):
        cli.main(["convert", str(src), str(out), "--dpi", "20"])
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        cli.main(["convert", str(tmp_path / "empty"), str(out)])
    assert cli.main(["info", str(src)]) == 1


def test_same_names(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "a.pptx").write_bytes(deck(f"in {d}"))
    status = convert.convert(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert {read(r["output_dir"], "document.txt")[1].split("\n")[2] for r in status} == {"in x", "in y"}


def test_own_track(spark, tmp_path):
    """A kind of one's own beside the built-in ones."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "note.md").write_text("Noted")

    def notes(found):
        runs = found.selectExpr("doc_id", "cast(null as string) error", "0 page_idx", "0 seq", "cast(content as string) text", "0D x0", "0D y0", "1000D x1", "1400D y1")
        return convert.Track(files.run_blocks(runs), runs.select("doc_id", "page_idx"), runs.where("error IS NOT NULL").select("doc_id", "error"))

    convert.register("md", notes)
    try:
        assert status_of(convert.convert(spark, str(src), str(tmp_path / "out")))["note.md"]["success"]
    finally:
        del convert.TRACKS["md"]
    assert "Noted" in read(tmp_path, "out", "note", "document.txt")[1]


def test_scratch_folder(spark, tmp_path):
    """Tables lie in one folder of the application and go when they are discarded; a cluster must name its folder."""
    import os

    t = runtime.save(spark.range(3), "x")
    path = t._palimpsest_path.replace("file://", "")
    assert spark.sparkContext.applicationId in path and os.path.exists(path)
    runtime.discard(t)
    assert not os.path.exists(path)
    assert runtime.fresh(["A", "b_"], "a", "b", "b_") == ["a_", "b", "b__"]

    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_evaluate(spark):
    o = spark.createDataFrame([("a", "one two\nthree\n"), ("b", None)], "name string, content string")
    e = spark.createDataFrame([("a", "one two\nthree\n")], "name string, content string")
    n = spark.createDataFrame([("a", 3)], "name string, blocks int")
    got = {r["name"]: tuple(r)[1:] for r in evaluate.evaluate(o, e, n).collect()}
    assert got == {"a": (14, 3, 2, 3, 1.0), "b": (0, 0, 0, None, None)}
    assert spark.range(1).select(evaluate.base_name(F.lit("x/test_output_paper_cli"))).first()[0] == "paper"


def test_latex_slot(spark):
    t = spark.createDataFrame([("math", bytearray(b"x"), None), ("math", bytearray(b"!"), "old"), ("text", bytearray(b"x"), ""), ("math", None, None)], "block_type string, image binary, latex string")

    def load():
        def read(data):
            if data == b"!":
                raise ValueError
            return "\\frac12"

        return read

    assert [r["latex"] for r in latex.with_latex(t, load).collect()] == ["\\frac12", "old", None, None]
    assert [r["latex"] for r in latex.with_latex(t, None).collect()] == [None, "old", None, None]


def test_settings(monkeypatch, tmp_path):
    monkeypatch.setenv("PALIMPSEST_DPI", "300")
    assert render.Settings.from_env().dpi == 300
    with pytest.raises(ValueError):
        render.Settings(dpi=20).check()
    (tmp_path / "page_002-02.png").write_bytes(b"")
    assert render.find_image(str(tmp_path), 1).endswith("page_002-02.png") and render.find_image(str(tmp_path), 0) is None
