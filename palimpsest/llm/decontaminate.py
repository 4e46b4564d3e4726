"""Benchmark decontamination by winnowing.

A fingerprint is the hash of k consecutive words; of every `window` consecutive ones the smallest is kept (the last of
equal ones). Two texts that share k + window - 1 words in a row share a kept fingerprint: with k 5 and window 4 that is
8 words, the length of an item's windows, so none is missed. A document's kept fingerprints are joined with those of the
items; where they meet, the join is extended: the 8-word windows that kept the fingerprint are looked up among the
items' windows and then compared word by word, so a hash collision can't make a hit.

An item of fewer than 8 words (and not none) is one window; lengths below 8 are looked up as runs of their own length,
as winnowing promises nothing for them.

The items' index is broadcast, up to `slice_words` item words at once (about 200 bytes a word); a larger benchmark is
read in slices of that size and what the slices found is merged by document, so the bound never drops an item. One item
longer than a slice forms a slice alone.

clean() drops by a rule of its own, not by the two items that `contaminated` asks for: a document goes if N words in a row
are hit, so one window of one item of N words or more is enough, or if two items are hit. One item of fewer words, which
may be a common phrase, doesn't decide alone.

Defined cases: a null or empty text has no words, no hits and isn't contaminated; null or empty items have no windows;
items that repeat an item_id count once; a null item_id stands for no item. Repeated documents each get their row. Very
long texts are read whole; empty tables give no rows, an empty benchmark no hits. Other columns pass by under any name; one
named `to` is replaced.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.keyfilter import may_match
from palimpsest.llm.textkernel import Words, chunks, run_hashes
from palimpsest.runtime import fresh, save, ship, stack

N, K = 8, 5
SLICE_WORDS = 1_000_000
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_EMPTY = hashlib.sha256(b"").hexdigest()


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """For each run of `window` grams the index of its smallest, the last of equal ones."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        here = grams[j : j + n]
        lower = here <= best
        best[lower], at[lower] = here[lower], j
    return at + np.arange(n)


class Index:
    """Windows of items: by length, sorted hashes with their words and items; for length N also the kept fingerprints."""

    def __init__(self, items: list[tuple[str, str]]):
        self.items = sorted({i for i, _ in items})
        place = {x: k for k, x in enumerate(self.items)}
        found: dict[int, dict[int, list[tuple[tuple[bytes, ...], set[int]]]]] = {}
        prints: list[np.ndarray] = []
        for item, text in items:
            w = Words([text])
            words = [w.word(i) for i in range(len(w.hashes))]
            if not words:
                continue
            n = min(N, len(words))
            h = run_hashes(w.hashes, n)
            for i, x in enumerate(h.tolist()):
                same = found.setdefault(n, {}).setdefault(x, [])
                key = tuple(words[i : i + n])
                for have, owners in same:
                    if have == key:
                        owners.add(place[item])
                        break
                else:
                    same.append((key, {place[item]}))
            if n == N:
                grams = run_hashes(w.hashes, K)
                prints.append(grams[np.unique(winnow(grams, N - K + 1))])
        self.windows = found
        self.sorted = {n: np.sort(np.fromiter(d, np.uint64, len(d))) for n, d in found.items()}
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """By text: words, merged [from, to) ranges of hit words, places of items."""
        out: list[tuple[int, list[tuple[int, int]], set[int]]] = []
        for lo, hi in chunks(texts):
            w = Words(texts[lo:hi])
            counts, first = w.counts(), w.first
            hits: dict[int, list[tuple[int, int]]] = {}
            owners: dict[int, set[int]] = {}
            for n, known in self.sorted.items():
                h = run_hashes(w.hashes, n)
                if n == N:
                    grams = run_hashes(w.hashes, K)
                    marked = _among(grams, self.prints)
                    start = np.flatnonzero(marked[winnow(grams, N - K + 1)]) if marked.any() else np.zeros(0, np.int64)
                else:
                    start = np.arange(len(h))
                start = start[_among(h[start], known)] if len(start) else start
                text_of = np.searchsorted(first, start, side="right") - 1
                inside = start + n <= first[text_of + 1]
                for i, t in zip(start[inside].tolist(), text_of[inside].tolist(), strict=True):
                    key = tuple(w.word(j) for j in range(i, i + n))
                    for have, who in self.windows[n][int(h[i])]:
                        if have == key:
                            hits.setdefault(t, []).append((i - int(first[t]), i - int(first[t]) + n))
                            owners.setdefault(t, set()).update(who)
            out += [(int(counts[t]), merge(hits.get(t, [])), owners.get(t, set())) for t in range(hi - lo)]
        return out


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known; a table of 16 hash bits turns most away first."""
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    gate = np.zeros(1 << 20, bool)
    gate[(known >> np.uint64(44)).astype(np.int64)] = True
    out = gate[(x >> np.uint64(44)).astype(np.int64)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(known, x[some]), len(known) - 1)
    out[some] = known[at] == x[some]
    return out


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def verdict(n_words: int, ranges: list[tuple[int, int]], items: list[str], min_items: int, min_run: int | None = None) -> tuple:
    names = sorted(set(items))
    digest = hashlib.sha256(",".join(names).encode()).hexdigest() if names else _EMPTY
    run = min_run is not None and any(b - a >= min_run for a, b in ranges)
    return n_words, sum(b - a for a, b in ranges), len(names), digest, run or len(names) >= min_items


def slices(benchmark: DataFrame, slice_words: int):
    """The items in bounded lists, one slice on the driver at a time. Split by a running sum of item lengths."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-int(words) // (2 * slice_words)))
    if parts == 1:
        return [items]
    kept = save(items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts))), "bench-items")
    return [kept.where(F.col("part") == p).drop("part") for p in range(parts)]


def _load(part: DataFrame) -> Index:
    return Index([(r["item"], r["text"]) for r in part.toLocalIterator()])


def scan_udf(spark, index: Index, min_items: int, min_run: int | None):
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(RESULT)
    def scan(s: pd.Series) -> pd.DataFrame:
        index = shared.value
        rows = [verdict(n, r, [index.items[i] for i in who], min_items, min_run) for n, r, who in index.scan(s.tolist())]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return scan


def finds(docs: DataFrame, part: DataFrame, text: str) -> DataFrame:
    """doc_id and text hash of the documents that this slice hits, with ranges and items: few rows, written down so that
    only one slice is in memory at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(_load(part))

    @F.pandas_udf("ranges array<struct<a:long,b:long>>, items array<string>")
    def scan(s: pd.Series) -> pd.DataFrame:
        index = shared.value
        rows = [([{"a": a, "b": b} for a, b in r], [index.items[i] for i in who]) for _, r, who in index.scan(s.tolist())]
        return pd.DataFrame(rows, columns=["ranges", "items"])

    keyed = docs.select(F.col("doc_id").alias("_d"), F.xxhash64(text).alias("_t"), scan(F.col(text)).alias("f"))
    out = save(keyed.where(F.size("f.items") > 0).select("_d", "_t", "f.ranges", "f.items"), "decon-finds")
    shared.unpersist()
    return out


def merge_udf(min_items: int, min_run: int | None):
    @F.pandas_udf(RESULT)
    def together(text: pd.Series, ranges: pd.Series, items: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        n = [int(k) for lo, hi in chunks(texts) for k in Words(texts[lo:hi]).counts()]
        some = lambda x: [] if x is None else list(x)
        rows = [verdict(k, merge([(x["a"], x["b"]) for x in some(rs)]), some(its), min_items, min_run) for k, rs, its in zip(n, ranges, items, strict=True)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return together


def with_hits(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, min_run: int | None = None, slice_words: int = SLICE_WORDS, text: str = "text", to: str = "_hits") -> DataFrame:
    """docs and a struct column `to` with what RESULT names. No shuffle while the benchmark fits into one slice; beyond
    that one pass a slice, and a join of the rows that were hit with what hit them. contaminated: min_items items are hit, or
    min_run words in a row."""
    spark = docs.sparkSession
    ship(spark)
    parts = slices(benchmark, slice_words)
    if len(parts) == 1:
        return docs.withColumn(to, scan_udf(spark, _load(parts[0]), min_items, min_run)(F.col(text)))
    found = reduce(lambda a, b: stack(a, b, ("_d", "_t")), [finds(docs, p, text) for p in parts])
    found = save(found.groupBy("_d", "_t").agg(F.flatten(F.collect_list("ranges")).alias("_ranges"), F.flatten(F.collect_list("items")).alias("_items")), "decon-merged")
    d, t, may, ranges, its = fresh((*docs.columns, to), "d", "t", "may", "ranges", "items")
    found = found.select(*[F.col(x).alias(y) for x, y in (("_d", d), ("_t", t), ("_ranges", ranges), ("_items", its))])
    some = may_match(docs, F.xxhash64("doc_id", F.xxhash64(text)), found, F.xxhash64(d, t), may)
    joined = some.where(F.col(may)).join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left").drop(d, t)
    bare = some.where(~F.col(may)).withColumn(ranges, F.lit(None).cast("array<struct<a:long,b:long>>")).withColumn(its, F.lit(None).cast("array<string>"))
    out = joined.unionByName(bare)
    return out.withColumn(to, merge_udf(min_items, min_run)(F.col(text), F.col(ranges), F.col(its))).drop(ranges, its, may)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones."""
    (found,) = fresh(docs.columns, "decon")
    return with_hits(docs, benchmark, to=found, **{"min_run": N} | options).where(~F.col(found)["contaminated"]).drop(found)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "_hits.*")
