"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at line ends, and after . ! ? where white space follows). Every run of `run` consecutive
sentences is a span; so is every shorter run of `long_words` words or more, so that a passage of long sentences isn't
missed. A run of fewer than `min_words` words takes in as many of the sentences that follow as it needs to have them (none
where the text ends before), so that a passage of short sentences isn't missed either. A span's hash has 128 bits and
covers its words (lower-cased A-Z, runs of letters, digits and non-ASCII), not white space or marks. Of equal spans the
first, by doc_id, text hash and place, stays; a sentence that any other one covers is removed.

1. A task hashes the spans of its documents, up to `flush` spans at a time, and settles equal ones among themselves: all
   but the first are marked at once. So of a passage that a third of all documents hold, one span a flush goes on.
2. What is left is shuffled by hash and sorted there by Spark, which spills; a task reads the sorted rows as a stream and
   marks all but the first of equal ones, so it holds one batch whatever the number of spans.
3. Marks meet by document (a document has no more of them than spans) and are joined with the texts.

Result: doc_id, n_sentences, n_removed, n_chars_removed, removed (code point ranges start:end, comma-joined), clean_text.
Sentences without words belong to the sentence before.

Defined cases: null text stays null, with 0 sentences; empty and wordless texts have no sentences and stay. A document is a
doc_id with a text: rows that repeat both count as one (at the same place neither is removed for the other), rows that
share a doc_id (or have none) but not the text are documents of their own. A null doc_id comes before all others. A span
that overlaps its own first occurrence (a sentence said again and again) is removed from the second sentence on. Very long
texts are hashed whole. Empty tables give no rows. Other columns pass by under any name; one named `to` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.keyfilter import may_match
from palimpsest.llm.textkernel import Words, chunks, fmix, run_hashes
from palimpsest.runtime import discard, fresh, save, ship

RUN, LONG_WORDS, MIN_WORDS, FLUSH = 3, 24, 8, 1_000_000
U = np.uint64
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_ODD, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_NONE = -(1 << 63)


class Sentences:
    """Sentences of some texts, in order. first: index of each text's first sentence; start: byte offset, by sentence,
    from the beginning of all data; words: word count; hash, hash2: of its words."""

    def __init__(self, texts: list[str | None]):
        w = Words(texts)
        d = w.data
        cut = np.zeros(len(d) + 1, bool)
        if len(d):
            after = np.append(_SPACE[d[1:]], True)
            ends = (d == 0x0A) | (_STOP[d] & after)
            cut[1:] = ends
            cut[w.text_end] = True
        bounds = np.flatnonzero(cut)
        place = np.searchsorted(bounds, w.start, side="right")
        new = np.flatnonzero(np.diff(place, prepend=-1))
        self.text_end = w.text_end
        begin = np.concatenate(([0], w.text_end[:-1])) if len(w.text_end) else w.text_end
        stop = np.append(new[1:], len(w.start))
        self.words = stop - new
        text_of = np.searchsorted(w.text_end, w.start[new], side="right")
        # The first sentence of a text begins with the text; others where the sentence before was cut.
        self.start = np.where(np.diff(text_of, prepend=-1) != 0, begin[text_of] if len(begin) else 0, bounds[np.maximum(place[new] - 1, 0)] if len(bounds) else 0)
        self.first = np.searchsorted(text_of, np.arange(len(texts) + 1))
        n = len(w.hashes)
        if n:
            up = np.full(n, U(_ODD))
            up[0] = 1
            up = np.cumprod(up, dtype=U)
            down = np.full(n, U(pow(_ODD, -1, 1 << 64)))
            down[0] = 1
            down = np.cumprod(down, dtype=U)
            self.hash, self.hash2 = (self._sums(x, up, down, new, stop) for x in (w.hashes, fmix(w.hashes ^ U(_SECOND))))
        else:
            self.hash = self.hash2 = np.zeros(0, U)

    def _sums(self, x: np.ndarray, up: np.ndarray, down: np.ndarray, new: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = np.concatenate((np.zeros(1, U), np.cumsum(x * up, dtype=U)))
        return fmix((h[stop] - h[new]) * down[new] + self.words.astype(U))


def spans(s: Sentences, run: int = RUN, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """(hash, second hash, index of the first sentence, number of sentences) of all spans."""
    total = np.concatenate(([0], np.cumsum(s.words)))
    last = np.repeat(s.first[1:], np.diff(s.first))
    out = []

    def add(k: int, at: np.ndarray) -> None:
        out.append((run_hashes(s.hash, k)[at], run_hashes(s.hash2, k)[at], at, np.full(len(at), k)))

    for k in range(1, run + 1):
        at = np.arange(max(0, len(s.words) - k + 1))
        words = total[at + k] - total[at]
        add(k, at[(at + k <= last[: len(at)]) & (words >= (min_words if k == run else max(long_words, min_words)))])
    short = np.flatnonzero(np.arange(len(s.words)) + run <= last)
    short = short[total[short + run] - total[short] < min_words]
    k = run
    while len(short):
        k += 1
        short = short[short + k <= last[short]]
        enough = total[short + k] - total[short] >= min_words
        add(k, short[enough])
        short = short[~enough]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Columns of spans in memory: hash, second hash, doc_id, text hash, place, number of sentences.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _later(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, th: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans that come sorted by (h, h2, doc, th, pos): whether an equal hash stands before at another place, and each
    one's first occurrence."""
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])))
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
    # The same place of the same document (a repeated row) is no other occurrence.
    return again & ((doc != doc[head]) | (th != th[head]) | (pos != pos[head])), head


def _settle(held: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Indices of spans that stand before in `held`, and of all others. Only hashes that occur again are sorted in full."""
    h = held[0]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(h) else order
    twice = twice[np.lexsort(tuple(c[twice] for c in held[4::-1]))]
    lost = twice[_later(*(c[twice] for c in held[:5]))[0]] if len(twice) else twice
    rest = np.ones(len(h), bool)
    rest[lost] = False
    return lost, np.flatnonzero(rest)


def _marks(doc: np.ndarray, th: np.ndarray, pos: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """By document (doc_id, text hash): places with lengths, as packed 32-bit pairs."""
    if not len(doc):
        return doc, th, []
    order = np.lexsort((pos, th, doc))
    doc, th, pair = doc[order], th[order], np.stack([pos[order], k[order]], 1).astype("<i4")
    edge = np.flatnonzero((doc[1:] != doc[:-1]) | (th[1:] != th[:-1])) + 1
    first = np.concatenate(([0], edge))
    return doc[first], th[first], [p.tobytes() for p in np.split(pair, edge)]


_ROW = "h long, h2 long, doc_id long, th long, pos int, k int, marks binary"
_MARK = "doc_id long, th long, marks binary"


def _ids(doc: np.ndarray) -> pa.Array:
    return pa.array(doc, pa.int64(), mask=doc == _NONE)


def _marked(held: Spans, lost: np.ndarray, wide: bool) -> Iterator[pa.RecordBatch]:
    doc, th, packed = _marks(*(held[c][lost] for c in (2, 3, 4, 5)))
    for lo in range(0, len(packed), 5000):
        d, t, m = doc[lo : lo + 5000], th[lo : lo + 5000], packed[lo : lo + 5000]
        none = [pa.nulls(len(m), x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        mine = [_ids(d), pa.array(t), pa.array(m, pa.binary())]
        cols = [*none[:2], *mine[:2], *none[2:], mine[2]] if wide else mine
        yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in (_ROW if wide else _MARK).split(", ")])


def _hasher(run: int, long_words: int, min_words: int, flush: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Spans] = []
        size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            held: Spans = tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[assignment]
            lost, kept = _settle(held)
            yield from _marked(held, lost, True)
            for lo in range(0, len(kept), 100_000):
                h, h2, doc, th, pos, k = (c[kept[lo : lo + 100_000]] for c in held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), _ids(doc), pa.array(th), pa.array(pos.astype(np.int32)), pa.array(k.astype(np.int32)), pa.nulls(len(h), pa.binary())],
                    names=[c.split()[0] for c in _ROW.split(", ")],
                )

        for batch in batches:
            ids = batch.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False)
            ths = batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(2).to_pylist()
            for lo, hi in chunks(texts):
                s = Sentences(texts[lo:hi])
                h, h2, at, k = spans(s, run, long_words, min_words)
                text = np.searchsorted(s.first, at, side="right") - 1
                parts.append((h, h2, ids[lo:hi][text], ths[lo:hi][text], at - s.first[text], k))
                size += len(h)
                if size >= flush:
                    yield from settle()
                    parts.clear()
                    size = 0
        if parts:
            yield from settle()

    return work


def _global(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by (h, h2, doc, th, pos) -> marks of what isn't first. Of the rows before a batch only the first
    occurrence of the last hash is kept."""
    head: Spans | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [(b.column(i).fill_null(_NONE) if i == 2 else b.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]
        held: Spans = tuple(np.concatenate(x) for x in zip(head, cols, strict=True)) if head else tuple(cols)  # type: ignore[assignment]
        later, first = _later(*held[:5])
        yield from _marked(held, np.flatnonzero(later), False)
        head = tuple(c[first[-1] :][:1] for c in held)  # type: ignore[assignment]


def cut_text(text: str | None, marks: list[bytes] | None) -> tuple[int, int, int, str, str | None]:
    """n_sentences, n_removed, n_chars_removed, removed, clean_text."""
    if not text:
        return 0, 0, 0, "", text
    s = Sentences([text])
    n = len(s.start)
    gone = np.zeros(n + 1, np.int64)
    for m in marks if marks is not None else ():
        pairs = np.frombuffer(m, "<i4").reshape(-1, 2).astype(np.int64)
        pairs = pairs[pairs.sum(1) <= n]
        np.add.at(gone, pairs[:, 0], 1)
        np.add.at(gone, pairs[:, 0] + pairs[:, 1], -1)
    drop = np.cumsum(gone)[:n] > 0
    if not drop.any():
        return n, 0, 0, "", text
    raw = text.encode("utf-8", "surrogatepass")
    edge = np.append(s.start, len(raw))
    turn = np.flatnonzero(np.diff(np.concatenate(([0], drop.astype(np.int8), [0]))))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    kept, at, ranges, lost = [], 0, [], 0
    for a, b in zip(edge[turn[0::2]], edge[turn[1::2]], strict=True):
        kept.append(raw[at:a])
        at = b
        ranges.append(f"{chars[a]}:{chars[b]}")
        lost += int(chars[b] - chars[a])
    kept.append(raw[at:])
    return n, int(drop.sum()), lost, ",".join(ranges), b"".join(kept).decode("utf-8", "surrogatepass")


RESULT = "n_sentences long, n_removed long, n_chars_removed long, removed string, clean_text string"


def marks(docs: DataFrame, run: int = RUN, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, flush: int = FLUSH) -> DataFrame:
    """doc_id, th (hash of the text) and the packed marks of its spans, one row per document that has any."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    got = save(src.mapInArrow(_hasher(run, long_words, min_words, flush), _ROW), "span-hashes")
    near = got.where("h IS NULL").select("doc_id", "th", "marks")
    far = got.where("h IS NOT NULL").select("h", "h2", "doc_id", "th", "pos", "k")
    # Nulls sort first, as the smallest id does in memory.
    far = far.repartition(n, "h").sortWithinPartitions("h", "h2", "doc_id", "th", "pos").mapInArrow(_global, _MARK)
    out = save(near.unionByName(far).groupBy("doc_id", "th").agg(F.collect_list("marks").alias("marks")), "span-marks")
    discard(got)
    return out


def with_cuts(docs: DataFrame, to: str = "_cut", **options) -> DataFrame:
    """docs and a struct column `to` with what RESULT names. Texts that may have marks are shuffled, by document."""

    @F.pandas_udf(RESULT)
    def cut(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut_text(t, m) for t, m in zip(text, found, strict=True)], columns=[x.split()[0] for x in RESULT.split(", ")])

    i, h, mine, may, key = fresh((*docs.columns, to), "mark_id", "mark_th", "marks", "may", "key")
    m = marks(docs, **options).select(F.col("doc_id").alias(i), F.col("th").alias(h), F.col("marks").alias(mine))
    # Texts that surely have no mark don't move (see keyfilter.py); the hint holds the plan to one shape at every size.
    keyed = docs.withColumn(key, F.xxhash64("text"))
    some = may_match(keyed, F.xxhash64(F.col("doc_id").cast("long"), key), m, F.xxhash64(i, h), may)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(h))
    joined = some.where(F.col(may)).join(m.hint("merge"), same, "left").drop(i, h)
    bare = some.where(~F.col(may)).withColumn(mine, F.lit(None).cast("array<binary>"))
    return joined.unionByName(bare).withColumn(to, cut(F.col("text"), F.col(mine))).drop(mine, may, key)


def query(spark, sf_dir: str) -> DataFrame:
    return with_cuts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "_cut.*")
