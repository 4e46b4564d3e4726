"""Every character of `documents` reaches the queries and their SQL."""

import pytest

from palimpsest.plans import catalog, tracks

from .test_io import canon

WORDS = [f"{'lorem ipsum dolor sit amet l1ne'.split()[i % 6]}{i}" for i in range(400)]
TEXTS = {
    1: " ".join(WORDS) + "\n\nshort line\n" + "x" * 450 + "\nend",
    2: "\n".join(" ".join(WORDS[i : i + 60]) for i in range(0, 360, 12)),
    3: "a é" + "b" * 199 + " c\tß Über à la carte\n" + " ".join(WORDS[:90]),
    4: "\n".join(" ".join(WORDS[i : i + 9]) for i in range(50)),
    5: " ".join(WORDS[:300]),
}


def printable(text):
    return "".join(c for c in text if c >= " " and c != "\x7f")


def wrapped(text):
    out = []
    for line in text.split("\n"):
        line = printable(line)
        while len(line) > 200:
            n = line.rfind(" ", 0, 200) + 1 or 200
            out.append(line[:n])
            line = line[n:]
        out.append(line)
    return "\n".join(out)


def frame(spark, change=lambda t: t, keep=lambda i: True):
    return spark.createDataFrame([(i, change(t)) for i, t in TEXTS.items() if keep(i)], "doc_id long, text string")


def sides(spark, tmp_path, name):
    """Query and SQL over the same long lines."""
    import duckdb

    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return canon(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()), canon(con.sql(catalog.ORACLES[name]).df())


def test_lines_hold_all_text(spark):
    got = {}
    for r in tracks.lines(frame(spark)).orderBy("doc_id", "line_no").collect():
        assert len(r["line"]) <= 200
        got[r["doc_id"]] = got.get(r["doc_id"], "") + r["line"]
    assert got == {i: printable(t) for i, t in TEXTS.items()}


def test_page_block_holds_the_page(spark):
    b = tracks.blocks(frame(spark, keep=lambda i: i == 5))
    assert b.where("seq = 1000 AND page_idx = 0").first()["text"].replace("  ", " ") == " ".join(WORDS[:300])


@pytest.mark.parametrize("name", ["fuse_full", "align_greedy", "text_sim", "resolve_pairs", "dup_ocr_anti", "page_class", "md_export", "html_layers", "mean_word_conf", "line_group", "cand_argmax", "dedupe_first", "covered_line_anti", "token_json"])
def test_long_lines(spark, tmp_path, name):
    got, want = sides(spark, tmp_path, name)
    assert got == want and got


def test_merge_takes_all_words(spark, tmp_path):
    frame(spark, keep=lambda i: i in (2, 4)).write.parquet(f"{tmp_path}/documents.parquet")
    said = {w for r in catalog.QUERIES["adjacent_merge"](spark, str(tmp_path)).collect() for w in r["text"].split()}
    assert said >= set(WORDS[:360])


def test_token_json_holds_whole_documents(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["page_idx"], r["seq"], r["text"], r["latex"]) for r in catalog.QUERIES["token_json"](spark, str(tmp_path)).collect())
    want = []
    for i, t in TEXTS.items():
        seq = {}
        for n, line in enumerate(wrapped(t).split("\n")):
            if line:
                seq[n // 20] = seq.get(n // 20, -1) + 1
                want.append((i, n // 20, seq[n // 20], None if n == 1 else line, "x_1" if n == 1 else None))
    assert got == sorted(want)


def test_documents_partitioned_by_key(spark, monkeypatch):
    """Spark may take a union of branches that are partitioned alike for partitioned itself and leave out a shuffle."""
    run = lambda: catalog.QUERIES["json_export"](spark, "/root/testdata/sf0.01").toPandas()
    want = canon(run())
    monkeypatch.setattr(tracks, "spread", lambda docs: docs.repartition(8, "doc_id"))
    assert canon(run()) == want


def test_odd_ends_and_blanks(spark, tmp_path):
    """Other white space than blanks, two line ends at the end, line separators and empty texts, as the SQL counts them."""
    import duckdb

    rows = [(1, "a\tb c\n\n"), (2, ""), (3, "one two　three\r\nfour\r\n"), (4, "\n"), (5, "a b\n\n\nc\n"), (6, "x y\u0085z w \nend"), (7, None), (10, "q" * 199 + "\u0085" + "r" * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("eval_metrics", "token_json"):
        assert canon(catalog.QUERIES[name](spark, str(tmp_path)).toPandas().fillna(0)) == canon(con.sql(catalog.ORACLES[name]).df().fillna(0)), name


@pytest.mark.parametrize("name", ["mean_word_conf", "cand_argmax", "dedupe_first", "line_group", "align_greedy", "fuse_full", "parser_dominant", "token_json"])
def test_only_documents_shuffle(spark, name):
    """Words, lines and blocks are many times as large as the texts that they come from; only these are dealt."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
