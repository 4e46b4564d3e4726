"""Exact top-k search by integer inner product over a pivot-distance index.

Vectors are floored to integers (256 * x). An inner product becomes a distance by one more coordinate: with M the largest
norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = M^2 + |q|^2 - 2 q.x, so the nearest x' has the
highest score.

1. Index: pivots come from a bounded sample of vectors (`SAMPLE` rows; farthest points first). Every vector is keyed by
   its nearest pivot and its distance from it, in annuli (`RINGS` a pivot, with bounds at the sample's quantiles, the
   last one open). An annulus knows its least and largest distance. The number of annuli is bounded, so their bounds fit
   on the driver. Annuli are packed into blocks of about `BLOCK` vectors by a hash of the id; a very common vector fills
   many blocks of one annulus.
2. Queries are packed into chunks, neighbours together. Each chunk first sees one block of its queries' nearest annuli,
   which gives each query a k-th best score so far, and so a radius.
3. By the triangle inequality an annulus [low, high] around p holds nothing within radius r of q' unless
   low - r <= d(q', p) <= high + r. Annuli are taken in ascending order of that bound until it exceeds the radius; chunks
   meet the blocks of the annuli that are left by a join on block. A task keeps the k best of each query.
4. The k best of all tasks, ties to the smaller vec_id.

Scores are exact: products in float64 where all sums stay below 2**53, else in Python's integers. The bound is widened by
a relative 1e-9 against rounding.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; shorter vectors count as
if filled up with zeros; a null vec_id takes no part. Rows that repeat vec_id and vector are candidates each and one
query. A query's own rows (all with its vec_id) are no candidates. Fewer than k candidates: all of them; ties go to the
smaller vec_id. Scores must fit in 64 bits. Empty tables give no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import save, ship

K, SCALE, SAMPLE, PIVOTS, RINGS, BLOCK, CHUNK = 5, 256, 4096, 32, 16, 4096, 512


def quantize(rows: list, scale: int) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for r in rows:
        if r is None or not len(r) or any(v is None for v in r):
            out.append(None)
            continue
        v = np.asarray(r, np.float64)
        with np.errstate(over="ignore"):
            f = np.floor(v * scale)
        out.append(f if np.isfinite(v).all() and np.isfinite(f).all() else None)
    return out


def parse(vectors: DataFrame, vec_id: str, column: str, scale: int) -> DataFrame:
    """vec_id, dim, norm2, peak (largest component) and the vector as float64 bytes (integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, got = b.column(0).to_pylist(), quantize(b.column(1).to_pylist(), scale)
            keep = [i for i, v in enumerate(got) if v is not None and ids[i] is not None]
            vs = [got[i] for i in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in keep], pa.int64()), pa.array([len(v) for v in vs], pa.int32()), pa.array([float(v @ v) for v in vs], pa.float64()), pa.array([float(np.abs(v).max()) for v in vs], pa.float64()), pa.array([v.tobytes() for v in vs], pa.binary())],
                names=["vec_id", "dim", "norm2", "peak", "vec"],
            )

    return vectors.select(F.col(vec_id).cast("long"), F.col(column)).mapInArrow(run, "vec_id long, dim int, norm2 double, peak double, vec binary")


def matrix(blobs: list[bytes], dim: int, unit: str = "<f8") -> np.ndarray:
    """Vectors as rows of float64, filled up with zeros. unit: how the bytes hold a component."""
    size = np.dtype(unit).itemsize
    if all(len(b) == size * dim for b in blobs):
        return np.frombuffer(b"".join(blobs), unit).reshape(len(blobs), dim).astype(np.float64)
    out = np.zeros((len(blobs), dim))
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, unit)
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray, exact_floats: bool) -> np.ndarray:
    if exact_floats:
        return (a @ b.T).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return big(a).dot(big(b).T).astype(np.int64)


def lift(x: np.ndarray, m2: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))])


class Grid:
    """Pivots and ring bounds: small, whatever the data."""

    def __init__(self, sample: np.ndarray, m2: float, pivots: int, rings: int):
        self.m2 = m2
        z = lift(sample, m2)
        chosen = [0]
        far = ((z - z[0]) ** 2).sum(1)
        while len(chosen) < min(pivots, len(z)):
            i = int(far.argmax())
            if far[i] <= 0:
                break
            chosen.append(i)
            far = np.minimum(far, ((z - z[i]) ** 2).sum(1))
        self.pivots = z[chosen]
        self.rings = rings
        d = self.distances(z)
        home = d.argmin(1)
        own = d[np.arange(len(z)), home]
        self.edges = np.stack([np.quantile(own[home == p] if (home == p).any() else own, np.linspace(0, 1, rings + 1)[1:-1]) for p in range(len(chosen))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        d2 = (lifted * lifted).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance from its pivot) by vector."""
        d = self.distances(lift(x, self.m2))
        home = d.argmin(1)
        own = d[np.arange(len(x)), home]
        return home * self.rings + (own[:, None] > self.edges[home]).sum(1), own


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """By row the indices of the k highest scores, ties to the smaller id."""
    if scores.shape[1] > 4 * k:
        # All that reach the k-th highest score are candidates, so ties are kept for the sort.
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        return [c[np.lexsort((ids[c], -s[c]))[:k]] for s, t in zip(scores, cut, strict=True) for c in (np.flatnonzero(s >= t),)]
    return [np.lexsort((ids, -s))[:k] for s in scores]


def search(vectors: DataFrame, k: int = K, every: int = 50, vec_id: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, for queries whose id is divisible by `every`, against all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    result = "query_id long, rank int, vec_id long, score long"
    t = save(parse(vectors, vec_id, column, scale), "topk-vectors")
    total = t.agg(F.count("*").alias("n"), F.max("norm2").alias("m2"), F.max("peak").alias("peak"), F.max("dim").alias("dim")).first()
    if not total["n"]:
        return spark.createDataFrame([], result)
    m2, dim = total["m2"], total["dim"]
    floats = total["peak"] ** 2 * dim < 2**53
    # Stored and shipped components are as narrow as the largest one allows.
    unit = next((u for u, most in (("<i2", 2**15), ("<i4", 2**31)) if total["peak"] < most), "<f8")
    narrow = lambda x: x.astype(unit)
    rows_of = lambda blob: np.frombuffer(blob, unit).reshape(-1, dim).astype(np.float64)
    sample = t.select("vec").orderBy(F.xxhash64("vec_id", "vec")).limit(SAMPLE).toPandas()
    grid = Grid(matrix(sample["vec"].tolist(), dim), m2, PIVOTS, RINGS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1).to_pylist(), dim)
                cell, d = grid.place(x)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in narrow(x)], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(d)], names=["vec_id", "vec", "cell", "d"])

    keyed = save(t.select("vec_id", "vec").mapInArrow(key, "vec_id long, vec binary, cell int, d double"), "topk-keyed")
    # At most PIVOTS * RINGS rows.
    cells = keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).orderBy("cell").toPandas()
    cells["blocks"] = np.ceil(cells["n"] / BLOCK).astype(int)
    pivot = (cells["cell"] // RINGS).to_numpy()
    low, high = cells["low"].to_numpy(), cells["high"].to_numpy()
    split = F.element_at(F.create_map(*[F.lit(int(x)) for r in cells.itertuples() for x in (r.cell, r.blocks)]), F.col("cell"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        at = None

        def out() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(held), 2 * BLOCK):
                part = held[lo : lo + 2 * BLOCK]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.array([x[0] for x in part], np.int64).tobytes()], pa.binary()), pa.array([b"".join([x[1] for x in part])], pa.binary())],
                    names=["cell", "sub", "ids", "vecs"],
                )

        for b in batches:
            for c, s, i, v in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                if (c, s) != at:
                    yield from out()
                    held, at = [], (c, s)
                held.append((i, v))
        yield from out()

    subs = keyed.select("cell", F.pmod(F.xxhash64("vec_id", "vec", "d", F.monotonically_increasing_id()), split).cast("int").alias("sub"), "vec_id", "vec")
    blocks = save(subs.repartition(n, "cell", "sub").sortWithinPartitions("cell", "sub").mapInArrow(pack, "cell int, sub int, ids binary, vecs binary"), "topk-blocks")

    def bounds(x: np.ndarray) -> np.ndarray:
        """[query, cell]: no vector of the cell is nearer to the query than this."""
        d = grid.distances(np.column_stack([x, np.zeros(len(x))]))[:, pivot]
        return np.maximum(0, np.maximum(low[None, :] - d, d - high[None, :]))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = grid.distances(np.column_stack([matrix(b.column(1).to_pylist(), dim), np.zeros(b.num_rows)]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d.argmin(1).astype(np.int32))], names=["vec_id", "vec", "home"])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, []

        def out(part) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made], pa.int64()), pa.array([np.array([x[0] for x in part], np.int64).tobytes()], pa.binary()), pa.array([narrow(matrix([x[1] for x in part], dim)).tobytes()], pa.binary())], names=["chunk", "qids", "qvecs"]
            )

        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            while len(held) >= CHUNK:
                yield out(held[:CHUNK])
                held, made = held[CHUNK:], made + 1
        if held:
            yield out(held)

    asked = t.where(F.col("vec_id") % every == 0).select("vec_id", "vec").distinct().mapInArrow(home, "vec_id long, vec binary, home int")
    asked = save(asked, "topk-queries")
    # Chunks of whole neighbourhoods: as few partitions as fill them, so that a chunk's matrix product is worth a block.
    parts = max(1, min(n, -(-asked.count() // CHUNK)))
    chunks = save(asked.repartitionByRange(parts, "home", "vec_id").sortWithinPartitions("home", "vec_id").select("vec_id", "vec").mapInArrow(chunk, "chunk long, qids binary, qvecs binary"), "topk-chunks")
    visit = pd.DataFrame({"cell": cells["cell"], "blocks": cells["blocks"]})

    def first_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest annuli of each query: enough that one block of each holds k vectors besides the query's own."""
        rows = np.minimum(cells["n"].to_numpy(), BLOCK)
        for b in batches:
            for i in range(b.num_rows):
                x = rows_of(b.column(2)[i].as_py())
                order = np.argsort(bounds(x), axis=1, kind="stable")
                enough = (np.cumsum(rows[order], axis=1) >= 4 * k).argmax(1)
                want = sorted({int(c) for o, e in zip(order, enough, strict=True) for c in o[: e + 1]})
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(want), pa.int64()), pa.array([int(visit["cell"][c]) for c in want], pa.int32()), pa.array([0] * len(want), pa.int32())], names=["chunk", "cell", "sub"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, qids, qvecs, limits, cell, ids, vecs) -> the k best of each query among this task's blocks."""
        best: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for b in batches:
            for i in range(b.num_rows):
                c, qids, qvecs, limits, cell, ids, vecs = (b.column(j)[i].as_py() for j in range(7))
                q, v = rows_of(qvecs), rows_of(vecs)
                qid, vid = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                rows = np.arange(len(q))
                if limits is not None:
                    at = int(np.searchsorted(cells["cell"].to_numpy(), cell))
                    rows = np.flatnonzero(bounds(q)[:, at] <= np.frombuffer(limits, np.float64))
                    if not len(rows):
                        continue
                s = products(q[rows], v, floats)
                own = qid[rows][:, None] == vid[None, :]
                for r, row, mine, top in zip(rows, s, own, _best(np.where(own, -(1 << 62), s), vid, min(k, s.shape[1])), strict=True):
                    have = best.setdefault((c, int(r), int(qid[r])), [])
                    have += [(-int(row[j]), int(vid[j])) for j in top if not mine[j]]
                    have.sort()
                    del have[k:]
        flat = [(c, r, qi, v, -s) for (c, r, qi), xs in best.items() for s, v in xs]
        for lo in range(0, len(flat), 10_000):
            part = list(zip(*flat[lo : lo + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), *(pa.array(x, pa.int64()) for x in part[2:])], names=["chunk", "row", "query_id", "vec_id", "score"])

    scored = "chunk long, row int, query_id long, vec_id long, score long"
    top = Window.partitionBy("chunk", "row").orderBy(F.desc("score"), "vec_id")

    def met(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
        both = wanted.join(chunks, "chunk").join(blocks, ["cell", "sub"])
        return both.select("chunk", "qids", "qvecs", "limits", "cell", "ids", "vecs").mapInArrow(score, scored)

    bare = chunks.withColumn("limits", F.lit(None).cast("binary"))
    first = met(chunks.mapInArrow(first_cells, "chunk long, cell int, sub int"), bare)
    kth = first.withColumn("at", F.row_number().over(top)).where(F.col("at") == k).groupBy("chunk").agg(F.collect_list(F.struct("row", "score")).alias("kth"))

    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds limits: by query the radius of its k-th best score so far (infinite without one)."""
        for b in batches:
            out = []
            for i in range(b.num_rows):
                q = rows_of(b.column(2)[i].as_py())
                r = np.full(len(q), np.inf)
                for x in b.column(3)[i].as_py() or []:
                    r[x["row"]] = np.sqrt(max(0.0, m2 + float(q[x["row"]] @ q[x["row"]]) - 2.0 * x["score"])) * (1 + 1e-9) + 1e-3
                out.append(r.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["chunk", "qids", "qvecs", "limits"])

    limited = save(chunks.join(kth, "chunk", "left").select("chunk", "qids", "qvecs", "kth").mapInArrow(radius, "chunk long, qids binary, qvecs binary, limits binary"), "topk-limits")

    def all_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Annuli in ascending order of their bound, up to the radius; all blocks of each."""
        for b in batches:
            for i in range(b.num_rows):
                x = rows_of(b.column(2)[i].as_py())
                want = np.flatnonzero((bounds(x) <= np.frombuffer(b.column(3)[i].as_py(), np.float64)[:, None]).any(0))
                pairs = [(int(visit["cell"][c]), s) for c in want for s in range(int(visit["blocks"][c]))]
                for lo in range(0, len(pairs), 10_000):
                    part = pairs[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(part), pa.int64()), pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part], pa.int32())], names=["chunk", "cell", "sub"])

    best = met(limited.mapInArrow(all_cells, "chunk long, cell int, sub int"), limited)
    return best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
