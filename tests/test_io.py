"""Files, the token wire format, streaming, and every query against its SQL."""

import io
import math
import zipfile

import pytest

import __spark_entry__ as entry
from palimpsest.plans import catalog, tracks
from palimpsest.runtime import table
from palimpsest.sources import files, tokens

from .conftest import SF

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def zipped(**parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return buf.getvalue()


def test_docx(spark, tmp_path):
    body = f"<w:document {W}><w:p><w:r><w:t> Hello</w:t></w:r><w:r><w:t> there </w:t></w:r></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:document>"
    (tmp_path / "a.docx").write_bytes(zipped(**{"word/document.xml": body}))
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"x")
    f = files.read_files(spark, str(tmp_path))
    assert {(r["kind"], r["error"]) for r in f.select("kind", "error").collect()} == {("docx", None), (None, "unsupported extension: txt")}
    got = files.docx(f.where("kind = 'docx'")).collect()
    assert {r["text"] for r in got if r["error"] is None} == {"Hello there\nTwo"}
    assert [r for r in got if r["error"]]
    assert files.run_blocks(files.docx(f.where("kind = 'docx'"))).count() == 1


def test_pptx(spark):
    shape = lambda t, off="": f"<p:sp>{off}<a:t>{t}</a:t><a:t>!</a:t></p:sp>"
    place = '<a:off x="4572000" y="0"/><a:ext cx="4572000" cy="3429000"/>'
    slide = lambda *s: f"<p:sld {P}>{''.join(s)}</p:sld>"
    data = zipped(**{"ppt/presentation.xml": f"<p:presentation {P}/>", "ppt/slides/slide10.xml": slide(shape("ten")), "ppt/slides/slide2.xml": slide(shape("two", place), shape(""), shape("more")), "ppt/slides/slide11.xml": slide()})
    got = files.pptx_runs(data)
    assert [r[:3] for r in got] == [(0, 0, "two !"), (0, 1, "!"), (0, 2, "more !"), (1, 0, "ten !"), (2, 0, "")]
    assert got[0][3:] == pytest.approx((500.0, 0.0, 1000.0, 700.0))
    assert got[3][3:] == pytest.approx((0.0, 0.0, 1000.0, 1400.0))


def test_tokens(spark):
    good = '[{"text":"a","bbox":[1,2,3,4]},{"text":"m","bbox":[0,0,1,1],"block_type":"math","latex":"","confidence":7}]'
    o = spark.createDataFrame([(1, 0, f"log line\n{good}\nbye"), (2, 0, good), (3, 0, "nothing")], "doc_id long, page_idx int, output string")
    b = tokens.to_blocks(tokens.read_tokens(o)).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["type"], r["confidence"], r["latex"]) for r in b] == [(1, "text", 0.5, None), (1, "math", 1.0, None), (2, "text", 0.5, None), (2, "math", 1.0, None)]


def test_stream(spark, tmp_path):
    from palimpsest.operators.fuse import fuse
    from palimpsest.streaming.fuse import fuse_stream

    b = tracks.blocks(table(spark, SF, "documents").where("doc_id < 20"))
    b.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = fuse_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == fuse(b).count()


def canon(df):
    df = df[sorted(df.columns)]

    def c(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(c(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canon(a) == canon(b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["class", "source", "type", "blocks", "mean_confidence"] and got.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
