"""N-gram Jaccard join of documents by MinHash banding, with every pair verified on its full shingle sets.

Shingles are runs of five words (a text of fewer words, but not none, is one shingle). A pair links if the Jaccard index
of its shingle sets is `threshold` or more.

1. Each document gets a node: a 64-bit hash of its whole shingle set. Equal sets are one node, whatever their number, so
   exact copies are counted, never paired. Two different sets that shared a node would be taken for copies; a second
   64-bit hash, kept beside it, tells, and the run ends with an error that asks for another seed.
2. MinHash signatures of nodes are cut into bands; band and row counts follow from the threshold, the recall asked for
   at the threshold and a limit on hashes (`choose_bands`). Rows meet by a shuffle on (band, hash).
3. A bucket with several nodes has a hub, its smallest node. Nodes of a bucket share its hub, so (hub -> nodes), each
   node once, covers every candidate pair, and a group of near copies, which meet in nearly all bands, is one
   neighbourhood and not one for each band.
4. Texts of nodes with a neighbourhood are read again and their shingle sets go to their neighbourhoods. A neighbourhood
   of more than `block` nodes (or of very long sets) is dealt into blocks by a hash of the node, and each pair of blocks
   is a task's unit, so memory is two blocks. Inside, intersections are one matrix product. A pair counts in the
   smallest hub that its nodes share, once. No pair leaves the task: it yields each node's number of links and edges of
   a spanning forest of what it linked.
5. Components of the forest's edges (see components.py) give the class of near copies.

Result, by row: doc_id, class_id (smallest doc_id of the class), n_links (documents that it links with, copies counted),
n_text_links (those with another shingle set), node. Links to copies: n_links - n_text_links.

Defined cases: null or wordless texts have no shingles and no links; their class is their own doc_id. Rows that repeat a
doc_id with the same text are copies of each other. A null doc_id takes part; a class of such rows alone has class_id
null. Empty tables give no rows. Very long texts give whole shingle sets. keep_one() keeps, of rows equal in doc_id and
text, any one; other columns pass by it under any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.keyfilter import may_match
from palimpsest.llm.textkernel import Words, chunks, fmix, run_hashes
from palimpsest.runtime import discard, fresh, save, ship

WORDS, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 160
BLOCK, BLOCK_SHINGLES = 128, 1_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest chance candidates, with which a pair at the threshold is a
    candidate with probability `recall` and bands * rows <= max_hashes."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{max_hashes} hashes can't reach a recall of {recall} at {threshold}")
    return best


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Words are lower-cased runs of letters, digits and non-ASCII."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi], unicode_lower=True)
        runs = run_hashes(w.hashes, words)
        for i in range(hi - lo):
            a, b = int(w.first[i]), int(w.first[i + 1])
            h = runs[a : b - words + 1] if b - a >= words else run_hashes(w.hashes[a:b], b - a) if b > a else w.hashes[:0]
            out.append(np.unique(h))
    return out


def set_node(s: np.ndarray, seed: int = 0) -> int:
    x = np.concatenate((s ^ np.uint64(0xA5A5A5A55A5A5A5A ^ seed), np.array([len(s)], np.uint64)))
    return int(fmix(x).sum(dtype=np.uint64).astype(np.int64))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """[set, band] hashes of the band's minima. Sets must not be empty."""
    rng = np.random.default_rng(5)
    mult = rng.integers(1, 1 << 31, bands * rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    flat = np.concatenate(sets)
    x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    out = np.zeros((len(sets), bands), np.uint64)
    for j in range(bands * rows):
        v = x * mult[j]
        v += add[j]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        low = np.minimum.reduceat(v, starts).astype(np.uint64)
        out[:, j // rows] = fmix(out[:, j // rows] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(j + 1))
    return out.view(np.int64)


def sketch(docs: DataFrame, bands: int, rows: int, words: int = WORDS, seed: int = 0) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, node, check (the second hash) and bands (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = shingle_sets(part.column(2).to_pylist(), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                node: list = [None] * len(sets)
                check: list = [None] * len(sets)
                # Signatures in runs of bounded size: a very long set stands alone.
                at = 0
                while at < len(full):
                    end, size = at, 0
                    while end < len(full) and (end == at or size + len(sets[full[end]]) <= 200_000):
                        size += len(sets[full[end]])
                        end += 1
                    got = signatures([sets[i] for i in full[at:end]], bands, rows)
                    for i, s in zip(full[at:end], got, strict=True):
                        sig[i], node[i], check[i] = s, set_node(sets[i], seed), set_node(sets[i], ~seed & 0xFFFFFFFF)
                    at = end
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(sig, pa.list_(pa.int64()))],
                    names=["doc_id", "th", "n_shingles", "node", "check", "bands"],
                )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, th long, n_shingles long, node long, check long, bands array<long>")


def _sets(spark_docs: DataFrame, words: int) -> DataFrame:
    """(node, hubs, copies, text) -> (node, hubs, copies, shingles as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [s.tobytes() for s in shingle_sets(part.column(3).to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sets, pa.binary())], names=["node", "hubs", "copies", "shingles"])

    return spark_docs.mapInArrow(run, "node long, hubs array<long>, copies long, shingles binary")


def link_block(nodes: list[int], sets: list[np.ndarray], hubs: list[set[int]], copies: np.ndarray, sides: np.ndarray, hub: int, whole: bool, threshold: float):
    """Links among the nodes of one unit. whole: all pairs (one block); else only pairs of the two sides.

    Yields node, links weighted by copies, links, and a smaller node of its part of the forest.
    """
    m = len(nodes)
    size = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    keys, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size.astype(np.int64))
    shared = counts[inverse] > 1
    col = np.cumsum(counts > 1)[inverse[shared]] - 1
    owner, n = owner[shared], int((counts > 1).sum())
    common = np.zeros((m, m), np.float32)
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    step = 4096
    for c in range(0, n, step):
        a, b = np.searchsorted(col, (c, c + step))
        x = np.zeros((m, min(step, n - c)), np.float32)
        x[owner[a:b], col[a:b] - c] = 1
        common += x @ x.T
    inter = common.astype(np.float64)
    link = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
    np.fill_diagonal(link, False)
    if not whole:
        link &= sides[:, None] != sides[None, :]
    if not link.any():
        return
    # Each pair counts in the smallest hub that both have.
    lower = sorted({h for hs in hubs for h in hs if h < hub})
    counted = link
    if lower:
        place = {h: i for i, h in enumerate(lower)}
        z = np.zeros((m, len(lower)), np.float32)
        for i, hs in enumerate(hubs):
            for h in hs:
                if h < hub:
                    z[i, place[h]] = 1
        counted = link & ((z @ z.T) < 0.5)
    label = np.arange(m)
    while True:
        low = np.minimum(label, np.where(link, label[None, :], m).min(1))
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    smallest: dict[int, int] = {}
    for i in range(m):
        smallest[label[i]] = min(smallest.get(label[i], nodes[i]), nodes[i])
    weighted, plain = counted @ copies, counted.sum(1)
    for i in np.flatnonzero(link.any(1)):
        yield nodes[i], int(weighted[i]), int(plain[i]), smallest[label[i]]


def _linker(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def flush() -> list[tuple]:
            if len(held) < 2:
                return []
            hub, a, b = key
            sides = np.array([h[4] for h in held])
            return list(
                link_block(
                    [h[0] for h in held], [np.frombuffer(h[3], np.uint64) for h in held], [set(h[1]) for h in held], np.array([h[2] for h in held], np.int64), sides, hub, a == b, threshold,
                )
            )

        for batch in batches:
            found: list[tuple] = []
            hub_c, a_c, b_c, node_c, hubs_c, copies_c, side_c, sh_c = (batch.column(i) for i in range(8))
            for i in range(batch.num_rows):
                k = (hub_c[i].as_py(), a_c[i].as_py(), b_c[i].as_py())
                if k != key:
                    found += flush()
                    held, key = [], k
                held.append((node_c[i].as_py(), hubs_c[i].as_py(), copies_c[i].as_py(), sh_c[i].as_py(), side_c[i].as_py()))
            if found:
                yield _links(found)
        if found := flush():
            yield _links(found)

    return run


def _links(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["node", "n_links", "n_text_links", "low"])


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, max_hashes: int = MAX_HASHES, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_text_links, n_shingles, node, label (the class by its
    smallest node) and th (hash of the text)."""
    spark = docs.sparkSession
    ship(spark)
    bands, rows = choose_bands(threshold, recall, max_hashes)
    sk = save(sketch(docs, bands, rows, words, seed), "jaccard-sketch")
    # Nodes: one row for all documents with the same shingles. The band hashes are the same for all of them.
    by_node = sk.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("one"), (F.min("check") != F.max("check")).alias("mixed"))
    nodes = save(by_node.select("node", "copies", "first_id", F.col("one.doc_id").alias("one_id"), F.col("one.th").alias("one_th"), "mixed"), "jaccard-nodes")
    if nodes.where("mixed").limit(1).count():
        raise RuntimeError("two shingle sets share a 64-bit hash; pass another seed")
    nodes = nodes.drop("mixed")
    # Bands of a node once, however many copies it has: distinct (node, band, hash), combined before the shuffle.
    spread = sk.where("node IS NOT NULL").select("node", F.posexplode("bands").alias("band", "hash")).groupBy("band", "hash", "node").agg(F.lit(1).alias("x")).drop("x")
    spread = save(spread, "jaccard-bands")
    buckets = save(spread.groupBy("band", "hash").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"), "jaccard-buckets")
    members = spread.join(buckets, ["band", "hash"]).select("node", "hub").distinct()
    members = save(members, "jaccard-members")
    discard(spread)
    discard(buckets)
    near = members.groupBy("node").agg(F.collect_set("hub").alias("hubs"))  # at most one hub a band
    sized = sk.select("node", "n_shingles").where("node IS NOT NULL").groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    spans = members.join(sized, "node").groupBy("hub").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("shingles"))
    spans = save(spans.select("hub", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "jaccard-spans")
    # Texts of one document of each node that has a neighbourhood.
    wanted = save(near.join(nodes, "node").select("node", "hubs", "copies", "one_id", "one_th"), "jaccard-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), F.col("text").cast("string").alias("_text"))
    texts = may_match(texts, F.xxhash64("_id", "_th"), wanted, F.xxhash64("one_id", "one_th")).where("_may").drop("_may")
    # The hint holds the plan to one shape at every size.
    found = texts.join(wanted.hint("merge"), F.col("one_id").eqNullSafe(F.col("_id")) & (F.col("one_th") == F.col("_th"))).select("node", "hubs", "copies", "_text")
    sets = save(_sets(found, words).dropDuplicates(["node"]) if _repeats(sk) else _sets(found, words), "jaccard-sets")
    units = sets.select("node", "hubs", "copies", "shingles", F.explode("hubs").alias("hub")).join(spans, "hub")
    units = units.withColumn("side", F.pmod(F.xxhash64("node", "hub"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("hub", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "node", "hubs", "copies", "side", "shingles")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(n, "hub", "a", "b").sortWithinPartitions("hub", "a", "b")
    linked = save(dealt.mapInArrow(_linker(threshold), "node long, n_links long, n_text_links long, low long"), "jaccard-links")
    discard(sets)
    labels = components(linked.select(F.col("node").alias("a"), F.col("low").alias("b")))
    per_node = linked.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.sum("n_text_links").alias("n_text_links"))
    per_node = save(nodes.join(per_node, "node", "left").join(labels, "node", "left").select("node", "copies", "first_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), F.coalesce("label", "node").alias("label")), "jaccard-by-node")
    classes = save(per_node.groupBy("label").agg(F.min("first_id").alias("class_id")), "jaccard-classes")
    facts = save(per_node.join(classes, "label").drop("first_id"), "jaccard-facts")
    linked_rows = sk.drop("bands", "check").where("node IS NOT NULL").join(facts, "node").select(
        "doc_id", "class_id", (F.col("n_links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("n_text_links").cast("long").alias("n_text_links"), "n_shingles", "node", "label", "th"
    )
    # Rows without words are many at times and have no key to be joined by.
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    bare = sk.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_text_links"), "n_shingles", none.alias("node"), none.alias("label"), "th")
    return linked_rows.unionByName(bare)


def _repeats(sk: DataFrame) -> bool:
    """Whether some (doc_id, text) stands in several rows."""
    return bool(sk.groupBy("doc_id", "th").count().where("count > 1").limit(1).count())


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: the one with the smallest doc_id (ties: text hash). Rows without words stay.

    Only rows that may be dropped are joined with the list of those that are (see keyfilter.py); most texts don't move.
    """
    got = join(docs, **options)
    first = save(got.where("node IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("k")).select(F.col("label").alias("_l"), "k.doc_id", "k.th"), "jaccard-first")
    rest = got.where("node IS NOT NULL").select("label", "doc_id", "th").distinct().join(first.withColumnRenamed("doc_id", "_d").withColumnRenamed("th", "_t"), F.col("label") == F.col("_l"))
    drop = save(rest.where(~(F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "jaccard-drop")
    th, may, i, t = fresh(docs.columns, "text_hash", "may", "id", "th")
    gone = drop.select(F.col("_id").alias(i), F.col("_th").alias(t))
    marked = docs.withColumn(th, F.xxhash64("text"))
    marked = may_match(marked, F.xxhash64(F.col("doc_id").cast("long"), th), gone, F.xxhash64(i, t), may)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(th) == F.col(t))
    kept = marked.where(~F.col(may)).unionByName(marked.where(F.col(may)).join(gone.hint("merge"), same, "left_anti"))
    if _repeats(got):
        # A repeated row is a copy of itself, unless it has no words.
        bare = save(got.where("node IS NULL").select(F.col("doc_id").alias(i), F.col("th").alias(t)).distinct(), "jaccard-bare")
        kept = kept.join(bare, same, "left_anti").dropDuplicates(["doc_id", th]).unionByName(kept.join(bare, same, "left_semi"))
    return kept.drop(th, may)


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node", "label", "th")
