"""Token ids in files of frequency ranks, byte-aligned with separate control bytes.

File format, version 1. A store is a folder with
- `blocks/`: Parquet files of blocks, in ascending doc_id order: shard, block (its number in the shard), doc_ids,
  lengths (ids by document), control (binary), data (binary) and crc32 (of control and data, checked when they are read).
  The table carries the bytes; Spark commits, lists and reads it on any store.
- `ranks/`: Parquet, rank and id: ids by falling count over the whole corpus, ties to the smaller id.

In a block each id is replaced by its rank (0: most frequent). Four ranks share one control byte, 2 bits each, lowest
bits first: the number of data bytes less 1. Data bytes are little-endian. Ranks below 256 take one byte. Decoding looks
the control byte up in a table of four lengths, sums them to offsets and gathers the bytes, all in numpy.

Two passes: documents are tokenized once and their ids written to a scratch table, with each task's counts by id; these
(bounded by the vocabulary) give the ranks; then ids are ranged by doc_id, sorted and coded. A task holds one block at a time.

Encoding follows the tokenizers library exactly. White space never belongs to a token of this tokenizer, so a text's ids
are those of its pieces between blanks, and a bounded cache of pieces spares most calls.

Defined cases: null text is empty, which gives the end id alone; rows that repeat a doc_id are documents of their own,
ordered by their number of ids and then by these; null doc_ids come first; an empty table gives an empty store. Very long
texts are encoded whole. Other columns of docs, whatever their names, aren't read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import discard, save, scratch_path, ship

END_ID = 1
BLOCK_IDS = 1 << 19
#: Ids that a task orders: about 64 MB.
TASK_IDS = 1 << 25
CACHE = 300_000

_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
_BLANK = re.compile(r"[ \n]+")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks (below 2**32) -> control bytes, data bytes."""
    wide = len(ranks) and int(ranks.max()) > 0xFFFF
    r = np.ascontiguousarray(ranks, "<u4" if wide else "<u2")
    more = (r > 0xFF).view(np.uint8)
    if wide:
        more = more + (r > 0xFFFF) + (r > 0xFFFFFF)
    two = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    two[: len(r)] = more
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    octets = r.view(np.uint8).reshape(-1, r.itemsize)
    return control.tobytes(), octets[np.arange(r.itemsize, dtype=np.uint8) <= more[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)))
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class _Pieces(dict):
    """piece -> its ids as bytes; a missing piece is encoded when it is asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        # Ids as 16 bits where the vocabulary allows.
        self.unit = "H" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        # A Latin-1 letter as the tokenizer's own byte-level step writes it, to hand plain words to the model directly.
        seen = {chr(c): tokenizer.pre_tokenizer.pre_tokenize_str(chr(c)) for c in range(256) if chr(c).isalpha()}
        self.letters = str.maketrans({c: x[0][0] for c, x in seen.items()}) if all(len(x) == 1 for x in seen.values()) else None

    def __missing__(self, p: str) -> bytes:
        plain = p.isalpha() and self._latin(p)
        if not plain and self._latin(word := p.rstrip(_MARKS)) and word.isalpha():
            # Letters and the marks after them are split by the tokenizer too.
            ids = self[word] + self[p[len(word) :]]
        else:
            got = [t.id for t in self.model.tokenize(p.translate(self.letters))] if plain else self.tokenizer.encode(p, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(got)}{self.unit}", *got)
        self[p] = ids
        return ids

    def _latin(self, p: str) -> bool:
        return bool(self.letters) and p.islower() and (p.isascii() or max(p) < "\u0100")


_MARKS = "!#$%&*.,:;?()-"
_CONTROL = re.compile("[\x1c-\x1f]")


class Encoder:
    """texts -> ids (uint32 arrays), as the tokenizers library gives them."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = _Pieces(self.tokenizer)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Pieces that are encoded apart with the same ids. Lower-casing is safe in Latin-1 only, where one letter maps
        to one, and the names of special ids keep their case."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [p for p in _BLANK.split(text) if p]
        if "<|" in text or _CONTROL.search(text):
            return [p for p in _BLANK.split(text) if p]
        return text.lower().split()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids by text."""
        return [np.frombuffer(x, f"<u{self.width}") for x in self.encode_bytes(texts)]

    @property
    def width(self) -> int:
        """Bytes of an id in encode_bytes."""
        return 2 if self.cache.unit == "H" else 4

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for t in texts:
            if len(self.cache) > CACHE:
                # Common words are short: drop the long ones first.
                for p in [p for p in self.cache if len(p) > 7]:
                    del self.cache[p]
                if len(self.cache) > CACHE // 2:
                    self.cache.clear()
            out.append(b"".join(map(self.cache.__getitem__, self.pieces(t))) if t else b"")
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


IDS = "doc_id long, ids binary, n long, hist binary"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (a byte with the bytes of an id, then the ids, end id last) and n, their number. Each task ends with a
    row of its id counts: n is -1 and hist holds ids and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = encoder(tokenizer), np.zeros(0, np.int64)
        w = enc.width
        if end_id >= 1 << (8 * w):
            raise ValueError("the end id doesn't fit the vocabulary's width")
        head, end = bytes([w]), end_id.to_bytes(w, "little")
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                ids = [x + end for x in enc.encode_bytes(part.column(1).to_pylist())]
                c = np.bincount(np.frombuffer(b"".join(ids), f"<u{w}"))
                if len(c) > len(total):
                    c[: len(total)] += total
                    total = c
                else:
                    total[: len(c)] += c
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([head + x for x in ids], pa.binary()), pa.array([len(x) // w for x in ids], pa.int64()), pa.nulls(len(ids), pa.binary())], names=["doc_id", "ids", "n", "hist"]
                )
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([-1], pa.int64()), pa.array([np.stack([at, total[at]]).astype("<i8").tobytes()], pa.binary())], names=["doc_id", "ids", "n", "hist"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, IDS)


def _grown(parts: list[bytes]) -> np.ndarray:
    """The ids of some packed documents, one after the other."""
    if all(b[0] == 2 for b in parts):
        return np.frombuffer(b"".join([b[1:] for b in parts]), "<u2")
    return np.concatenate([np.frombuffer(b, f"<u{b[0]}", offset=1) for b in parts])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0).to_pylist():
            at, n = np.frombuffer(x, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["id", "n"])


def _coder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank_of, shard, block = shared.value, TaskContext.get().partitionId(), 0
        docs, lengths, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, lengths, held, size, block
            control, data = pack(rank_of[_grown(held)])
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary()), pa.array([zlib.crc32(data, zlib.crc32(control))], pa.int64())],
                names=[c.split()[0] for c in BLOCKS.split(", ")],
            )
            docs, lengths, held, size, block = [], [], [], 0, block + 1
            return out

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = x.as_py()
                n = (len(raw) - 1) // raw[0]
                docs.append(d)
                lengths.append(n)
                held.append(raw)
                size += n
                if size >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


BLOCKS = "shard int, block int, doc_ids array<long>, lengths array<long>, n_ids long, control binary, data binary, crc32 long"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write a store of docs (doc_id, text) at path."""
    spark = docs.sparkSession
    ship(spark)
    ids = save(tokenize(docs, tokenizer, end_id), "token-ids", "zstd")
    counts = ids.where("hist IS NOT NULL").select("hist").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row per id of the vocabulary.
    ranked = counts.orderBy(F.desc("n"), "id").toPandas()
    by_rank = ranked["id"].to_numpy(np.int64)
    rank_of = np.zeros(by_rank.max() + 1 if len(by_rank) else 1, np.uint32 if len(by_rank) > 1 << 16 else np.uint16)
    rank_of[by_rank] = np.arange(len(by_rank))
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(by_rank)), "id": by_rank}), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    # As many ranges as the ids need, by their number too: many rows may share a doc_id.
    total = ids.where("n >= 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_IDS))
    ordered = ids.where("n >= 0").drop("hist").repartitionByRange(n, "doc_id", "n").sortWithinPartitions("doc_id", "n", "ids")
    ordered.select("doc_id", "ids").mapInArrow(_coder(spark.sparkContext.broadcast(rank_of)), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(ids)


def read(spark, path: str, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit), or ids_crc32 in their place."""
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ranks = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").toPandas().sort_values("rank")
    shared = spark.sparkContext.broadcast(ranks["id"].to_numpy(np.uint32))
    # Ids before each block: a running sum over the blocks of a shard, and over the shards (one row each).
    per_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = per_shard.select(F.col("shard").alias("_s"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    sizes = blocks.select("shard", "block", "n_ids").withColumn("before", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids"))
    starts = sizes.join(base, sizes.shard == base._s).select(F.col("shard").alias("_s"), F.col("block").alias("_b"), (F.col("base") + F.col("before")).alias("start"))
    placed = blocks.join(starts, (blocks.shard == starts._s) & (blocks.block == starts._b)).select("start", "doc_ids", "lengths", "control", "data", "crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        for b in batches:
            for k in range(b.num_rows):
                start, docs, lengths, control, data, crc = (b.column(i)[k].as_py() for i in range(6))
                if zlib.crc32(data, zlib.crc32(control)) != crc:
                    raise ValueError(f"the block of token ids that begins at {start} is damaged")
                cum = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
                raw = id_of[unpack(control, data, int(cum[-1]))].astype("<u4").tobytes()
                parts = [raw[4 * cum[i] : 4 * cum[i + 1]] for i in range(len(docs))]
                last = pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digests else pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + cum[:-1]), pa.array(lengths, pa.int64()), last], names=["doc_id", "start", "n_tokens", "x"])

    out = placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, x {'long' if digests else 'binary'}")
    return out.withColumnRenamed("x", "ids_crc32" if digests else "ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to a store in the shared folder and return what its files hold, as digests."""
    path = scratch_path(docs.sparkSession, "token-store")
    write(docs, path, tokenizer or default_tokenizer())
    return read(docs.sparkSession, path, digests=True)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
