"""Passages that must not be missed."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, pii, spandedup

from .cases import docs


@pytest.mark.parametrize("slice_words", [1_000_000, 5])
def test_clean_drops_a_single_item(spark, slice_words):
    leak = "one whole benchmark item of exactly twelve words stands here in full"
    bench = spark.createDataFrame([(1, leak), (2, "the end"), (3, "another item that nobody has ever put into any text at all")], "item_id long, text string")
    rows = [(1, f"Before it. {leak.upper()}! After it.", "en", "a"), (2, "This is the end, " * 9, "en", "a"), (3, "Nothing of it here.", "en", "a"), (4, f"{leak} the end", "en", "a"), (5, None, "en", "a")]
    d = docs(spark, rows)
    assert sorted(r["doc_id"] for r in decontaminate.clean(d, bench, slice_words=slice_words).collect()) == [2, 3, 5]
    hits = decontaminate.with_hits(d, bench, slice_words=slice_words)
    assert [r["doc_id"] for r in hits.where(F.col("_hits.contaminated")).collect()] == [4]


def numbered(country, bban):
    rest = "".join(str(int(c, 36)) for c in bban + country + "00")
    return f"{country}{98 - int(rest) % 97:02d}{bban}"


@pytest.mark.parametrize("after", ["", " please", " Please", " Bitte", " BITTE ZAHLEN SIE", " A", " 12 days", ".", ", Please"])
def test_iban_whatever_follows(after):
    numbers = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "TR330006100519786457841326", "SA0380000000608010167519", "AE070331234567890123456", "IL620108000000099999999", "BR1800360305000010009795493C1", "NO9386011117947"]
    for n in [*numbers, numbered("RU", "0" * 20 + "1" * 9), numbered("LC", "HEMM" + "7" * 24)]:
        t = f"IBAN {n}{after}"
        assert [(k, t[a:b]) for k, a, b, _ in pii.find(t) if k == "iban"] == [("iban", n)], t


def test_iban_refuted():
    for t in ("IBAN DE88370400440532013000 Please", "IBAN DE893704004405320130001 Please", "IBAN ZZ89370400440532013000", "IBAN xDE89370400440532013000", "IBAN DE89370400440532013000x"):
        assert not [x for x in pii.find(t) if x[0] == "iban"], t


@pytest.mark.parametrize("flush", [1_000_000, 20])
def test_spans_of_short_sentences(spark, flush):
    said = [f"Word{i}{'.!?'[i % 3]}" for i in range(50)]
    few = "One. Two. Three. Four. Five."
    rows = [(1, f"Unique start one. {' '.join(said)} Unique end one.", "en", "a"), (2, f"Other start two.\n{' '.join(said).upper()}\nOther end two.", "en", "a"), (3, f"Here it opens. {few}", "en", "a"), (4, f"There it begins. {few}", "en", "a"), (5, "Again. " * 60, "en", "a")]
    got = {r["doc_id"]: r["_cut"] for r in spandedup.with_cuts(docs(spark, rows), flush=flush).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4, 5)] == [0, 50, 0, 0, 59]
    assert got[2]["clean_text"].split() == ["Other", "start", "two.", "Other", "end", "two."]


@pytest.mark.parametrize("flush", [1_000_000, 3])
def test_spans_rows_that_share_an_id(spark, flush):
    """Marks belong to a text, not to all rows with its id or without one."""
    a, d, e = ("{0} one says a first thing here. {0} two says a second thing. {0} three says a third one.".format(x) for x in ("Alpha", "Delta", "Echo"))
    rows = [(1, a), (9, d), (9, a), (9, a), (None, e), (None, d + " Tail of it."), (7, e), (None, None)]
    frame = docs(spark, [(i, t, "en", "a") for i, t in rows])
    got = [(r["doc_id"], r["text"], r["_cut"]["n_removed"]) for r in spandedup.with_cuts(frame, flush=flush).collect()]
    assert sorted(got, key=repr) == sorted([(1, a, 0), (9, d, 3), (9, a, 3), (9, a, 3), (None, e, 0), (None, d + " Tail of it.", 0), (7, e, 3), (None, None, 0)], key=repr)


def test_spans_need_both_hashes():
    h = np.array([5, 5, 5, 9], np.uint64)
    held = (h, np.array([1, 2, 1, 1], np.uint64), *(np.array(x, np.int64) for x in ([3, 1, 2, 2], [0, 0, 0, 0], [0, 0, 0, 1], [3, 3, 3, 3])))
    lost, kept = spandedup._settle(held)
    assert lost.tolist() == [0] and kept.tolist() == [1, 2, 3]


def test_spans_brute_with_longer_runs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    first, of = {}, {}
    for i, t in sorted(rows):
        found = [tuple(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), q))) for q in re.split(r"(?<=\n)|(?<=[.!?])(?=[ \t\n\r]|\Z)", t or "")]
        s = of[i] = [w for w in found if w]
        for a in range(len(s)):
            for key in runs(s, a):
                first.setdefault(key, (i, a))
    want = {i: len({x for a in range(len(s)) for key in runs(s, a) if first[key] != (i, a) for x in range(a, a + len(key))}) for i, s in of.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["_cut"]["n_removed"] for r in spandedup.with_cuts(df).collect()} == want


def runs(s, a):
    for k in (1, 2, 3):
        if a + k <= len(s) and sum(map(len, s[a : a + k])) >= (8 if k == 3 else 24):
            yield tuple(s[a : a + k])
    for k in range(4, 9):
        if a + k <= len(s) and sum(map(len, s[a : a + k - 1])) < 8 <= sum(map(len, s[a : a + k])):
            yield tuple(s[a : a + k])
