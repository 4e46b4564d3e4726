"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters in `buckets` hash buckets per language, map-side by task and then summed
by (language, bucket), so the model's size is languages x buckets whatever the corpus. It is fitted on a bounded sample
of labelled rows: at most about `rows_per_language` rows of each language, those whose hashed id is smallest in effect.
Scoring reads whole texts: the log-probability matrix (128 KiB a language, the number of buckets is fixed) is broadcast in
parts of at most PART_BYTES; a batch's n-grams pick their matrix rows, which are summed by document.

Text is lower-cased; every run of characters that are not letters counts as one space, so digits and marks carry nothing.

Defined cases: a text that is null, empty or has no letter is `und` with score 0. Rows whose language is null are never
learned from. With no rows to learn from, every text is `und` with score 0; empty tables give no rows. Equal scores go to
the language that is first in order. Very long texts are read whole, one at a time. Rows that repeat a doc_id are learned
from and predicted each by itself. The score is the winner's posterior after length normalisation (below), between 0 and
1. Other columns pass by under any name; one named `to` is replaced.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textkernel import chunks
from palimpsest.runtime import fresh, ship

ORDERS = (1, 2, 3)
#: Characters whose n-grams are held at once; a longer text stands alone.
CHARS = 1 << 17
BUCKETS = 1 << 15
ROWS_PER_LANGUAGE = 20_000
#: A broadcast part of the matrix takes at most so many bytes.
PART_BYTES = 64 << 20
UND = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: the code point itself if it is a letter, else a space."""
    t = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            t[c] = c
    return t


def features(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, its text's index, letters by text). n-grams never cross a text's bounds."""
    # Two bounding spaces: a text starts and ends at a word bound.
    codes = [_letters()[np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)] if t else np.zeros(0, np.uint32) for t in texts]
    n = np.fromiter(map(len, codes), np.int64, len(codes))
    c = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(codes), dtype=np.int32), n)
    if len(c):
        keep = (c != 32) | np.concatenate(([True], (c[:-1] != 32) | (owner[1:] != owner[:-1])))
        c, owner = c[keep], owner[keep]
    letters = np.bincount(owner[c != 32], minlength=len(codes))
    hashes, owners = [], []
    h = np.zeros(len(c), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        m = len(c) - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + c[k - 1 :]
        if k in ORDERS:
            whole = (owner[:m] == owner[k - 1 :]) & ((c[:m] != 32) if k == 1 else True)
            x = h[whole] * np.uint32(0x9E3779B1) + np.uint32(k)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
            hashes.append((x >> np.uint32(12)) % np.uint32(buckets))
            owners.append(owner[:m][whole])
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    return np.concatenate(hashes), np.concatenate(owners), letters


def _counter(languages: list[str], buckets: int):
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        table = np.zeros((len(languages), buckets), np.int64)
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = part["text"].tolist()
                for lo, hi in chunks(texts, CHARS):
                    table[index[lang]] += np.bincount(features(texts[lo:hi], buckets)[0], minlength=buckets)
        i, b = np.nonzero(table)
        yield pd.DataFrame({"i": i.astype("int32"), "b": b.astype("int32"), "n": table[i, b]})

    return count


class Model:
    """languages in order; parts: matrices [buckets, some languages] float32, side by side, priors left out (a corpus's mix
    says little of a text)."""

    def __init__(self, languages: list[str], parts: list[np.ndarray]):
        self.languages, self.parts = languages, parts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for lo, hi in chunks(texts, CHARS):
            h, owner, letters = features(texts[lo:hi], self.parts[0].shape[0])
            # One sparse row of n-gram counts a text, times the matrix: a weighted sum by text, language after language.
            total = np.stack([np.bincount(owner, weights=part[:, j][h], minlength=hi - lo) for part in self.parts for j in range(part.shape[1])], 1).astype(np.float64)
            grams = np.maximum(np.bincount(owner, minlength=hi - lo), 1)
            # n-grams overlap, so their sum overstates the evidence: count one n-gram of each order and place as one.
            total /= np.minimum(len(ORDERS), grams)[:, None]
            best = total.argmax(1)
            post = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
            for i in np.flatnonzero(letters):
                names[lo + i], scores[lo + i] = self.languages[best[i]], post[i]
        return names, scores


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, buckets: int = BUCKETS, part_bytes: int = PART_BYTES) -> Model:
    """labelled: doc_id, text, lang. Reads lang alone to size the sample, then the texts of the sample."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where("lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], [])
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(scale, scale * rows_per_language // counts[lang]))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.element_at(share, F.col("lang"))).select("lang", "text")
    got = sample.mapInPandas(_counter(languages, buckets), "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), buckets))
    table[got["i"], got["b"]] = got["n"]
    table += 0.5
    logp = np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)
    wide = max(1, part_bytes // (4 * buckets))
    return Model(languages, [logp[:, i : i + wide].copy() for i in range(0, len(languages), wide)])


def with_language(docs: DataFrame, model: Model, text: str = "text", to: str = "_lang") -> DataFrame:
    """docs and a struct column `to` with lang_pred and score. No shuffle; other columns pass by."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    names_of, parts = sc.broadcast(model.languages), [sc.broadcast(p) for p in model.parts]

    @F.pandas_udf("lang_pred string, score double")
    def predict(s: pd.Series) -> pd.DataFrame:
        names, scores = Model(names_of.value, [p.value for p in parts]).predict(s.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn(to, predict(F.col(text)))


#: The documents that are learned from: those whose crc32(doc_id as text) mod 4 is not 2 (a null id is learned from).
HELD_OUT = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, false)"


def filter_language(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """docs without those that have no letters or no language that is likelier than all others together."""
    model = fit(docs.where(f"NOT {HELD_OUT}"))
    (found,) = fresh(docs.columns, "langid")
    kept = with_language(docs, model, to=found)
    return kept.where((F.col(found)["lang_pred"] != UND) & (F.col(found)["score"] >= min_score)).drop(found)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", F.expr(HELD_OUT))
    model = fit(docs.where("NOT held_out"))
    return with_language(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "_lang.lang_pred", "_lang.score")
