"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame and SQL functions only.

How it works, on a table of n documents and S sources:

1. A document's size is its number of words. Sources get targets that sum to all sizes: shares by weight, none above
   `max_repeats` times the source's size, the excess shared again by weight (water filling, solved by one sort).
2. Sainte-Laguë: equal blocks of `block_words` words go to the sources with the highest quotients
   target / (2 * seats + 1). A source's quota lies within its exact share plus or minus half of S blocks' worth, so only
   about 4 * S quotients have to be ranked, whatever the number of blocks. A block is one word by default, so a source's
   quota is within a word of its target however small the source is; longer blocks coarsen that.
3. A source is cut into shards by a seeded hash of the document, about `shard_words` words or `shard_rows` rows each, so no
   window holds a whole hot source; from MOST_SHARDS shards on they grow instead. A source's quota goes to its shards by
   the same apportionment, by shard size.
4. Inside a shard the documents stand in a seeded order; their words form a stream, which is cut into blocks. The shard
   takes every block `quota // n_blocks` times and the first ones once more. A document's `taken` counts its words in
   the blocks taken, repeats counted, so it can't exceed `max_repeats` times its size.

mixed_documents() needs no shuffle of texts: a shard's order and its quota come down to one row, the document at which its
stream is cut; these rows are broadcast (their number is checked) and each document is placed before, at or after its cut.

Defined cases: null text counts 0 words; a null source is a source of its own, last in order; empty tables give no rows;
empty and wordless texts have size 0 and take nothing; very long texts are counted whole. Rows that repeat a doc_id are
documents of their own (ties in the seeded order fall to doc_id, then text hash, then are interchangeable); a null doc_id is
a document like any other. All sizes 0: targets and taken are 0. Other columns pass by mixed_documents() under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import discard, fresh, save, ship

#: White space of the size rule; the text is cut at these only.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, *more) -> DataFrame:
    """doc_id, source, size and a hash of the text, one row per document. Reads those columns only."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"), *more)


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> with weight and target. One row per source, so one task sorts them."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ).withColumn("cap", F.col("source_size") * max_repeats)
    # Sources in the order in which a rising water level meets their caps: a prefix is capped.
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    filled = ranked.withColumn("level", level.cast("double")).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    # The first source that fits fixes the level for all after it; one before it is capped.
    fixed = filled.withColumn("fixed_level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"])
    reached = F.max(F.col("fits")).over(rising.rowsBetween(Window.unboundedPreceding, 0))
    return fixed.withColumn("target", F.when(reached, F.col("fixed_level") * F.col("weight")).otherwise(F.col("cap")).cast("double")).select(
        "source", "source_size", "weight", "target"
    )


def apportion(votes: DataFrame, group: list[str], key: str, vote: str, seats: str, quota: str) -> DataFrame:
    """Sainte-Laguë: `seats` (same for all rows of a group) to the keys of each group by highest vote / (2 * i + 1).

    By the bounds in this module's docstring, seat numbers outside [low, high) are surely won or surely lost, so about
    two quotients a key are ranked.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    v = votes.withColumn("_n", F.count("*").over(w)).withColumn("_all", F.sum(vote).over(w))
    share = lambda extra: F.try_divide(F.col(vote) * (F.col(seats) + extra), F.col("_all"))
    v = v.withColumn("_low", F.greatest(F.floor(F.coalesce(share(-(F.col("_n") / 2)), F.lit(0.0)) - 0.5), F.lit(0)).cast("long"))
    v = v.withColumn("_high", F.ceil(F.coalesce(share(F.col("_n") / 2), F.lit(0.0)) + 1).cast("long"))
    v = v.withColumn("_left", F.col(seats) - F.sum("_low").over(w))
    v = v.withColumn("_seat", F.explode(F.sequence(F.col("_low"), F.col("_high"))))
    v = v.withColumn("_rank", F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy()).orderBy((F.col(vote) / (2 * F.col("_seat") + 1)).desc(), F.col(key).asc_nulls_last(), "_seat")))
    keep = [c for c in votes.columns if c not in (quota,)]
    won = F.sum(F.when((F.col("_rank") <= F.col("_left")) & (F.col(vote) > 0), 1).otherwise(0))
    return v.groupBy(*keep, "_low").agg(won.alias("_won")).select(*keep, (F.col("_low") + F.col("_won")).alias(quota))


#: A table of sources or shards is broadcast up to so many rows (under 128 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Shards, all sources together, stay about as few as this.
MOST_SHARDS = 500_000
BLOCK_WORDS, SHARD_WORDS, SHARD_ROWS, SEED = 1, 2_000_000, 200_000, 17


def _small(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def _with(rows: DataFrame, few: DataFrame, on) -> DataFrame:
    return rows.join(F.broadcast(few) if _small(few) else few, on)


def place(doc_id, text_hash, seed: int):
    """A document's seeded place."""
    return F.xxhash64(F.lit(seed), doc_id, text_hash)


def quotas(sized: DataFrame, weights: tuple[int, ...], max_repeats: int, block_words: int, shard_words: int, shard_rows: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with place and shard; sources with their number of shards; source, shard, shard_size, source_size, target,
    and the shard's laps and rest: whole passes over its stream, then its first `rest` words once more)."""
    by_source = save(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-sources")
    aims = targets(by_source.drop("rows"), weights, max_repeats)
    aims = aims.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    aims = apportion(aims, [], "source", "target", "blocks", "source_quota")
    rows = by_source.select(F.col("source").alias("_s"), "rows", (F.sum("source_size").over(Window.partitionBy()) / MOST_SHARDS).alias("most_words"), (F.sum("rows").over(Window.partitionBy()) / MOST_SHARDS).alias("most_rows"))
    aims = aims.join(rows, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shards = F.greatest(F.ceil((F.col("source_size") + 1) / F.greatest("most_words", F.lit(shard_words))), F.ceil(F.col("rows") / F.greatest("most_rows", F.lit(shard_rows)))).cast("int")
    aims = save(aims.withColumn("shards", shards).drop("rows", "most_words", "most_rows"), "mix-targets")
    placed = _with(sized, aims.select(F.col("source").alias("_s"), "shards"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("place", place("doc_id", "text_hash", seed)).withColumn("shard", F.pmod("place", F.col("shards")).cast("int"))
    found = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    found = found.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    found = apportion(found.withColumn("vote", F.col("shard_size").cast("double")), ["source"], "shard", "vote", "source_quota", "quota")
    words = F.least(F.col("quota") * block_words, F.col("shard_size") * max_repeats)
    laps = F.coalesce(F.floor(F.try_divide(words, F.col("shard_size"))), F.lit(0)).cast("long")
    found = found.select("source", "shard", "shard_size", "source_size", "target", laps.alias("laps"), (words - laps * F.col("shard_size")).cast("long").alias("rest"))
    return placed.drop("shards"), aims.select("source", "shards"), save(found, "mix-quotas")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, seed: int = SEED
) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken: one row per row of docs."""
    ship(docs.sparkSession)
    sized = save(sizes(docs), "mix-sizes")
    placed, _, shards = quotas(sized, weights, max_repeats, block_words, shard_words, shard_rows, seed)
    few = shards.select(F.col("source").alias("_s"), F.col("shard").alias("_k"), "source_size", "target", "laps", "rest")
    # One shard holds about shard_words words, so its window is bounded even if one source has most of the rows.
    stream = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("begin", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    both = _with(at, few, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_k")))
    part = F.greatest(F.least(F.col("rest") - F.col("begin"), F.col("size")), F.lit(0))
    return both.select("doc_id", "text_hash", "source", "size", "source_size", "target", (F.col("laps") * F.col("size") + part).cast("long").alias("taken"))


def cuts(docs: DataFrame, row_hash, max_repeats: int, weights, block_words: int, shard_words: int, shard_rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources with their number of shards; source, shard, laps, and the cut: the group of equal rows at which the shard's
    stream ends, as its key, its size and number of rows and the words that it still gives)."""
    sized = save(sizes(docs, row_hash.alias("row_hash")), "mix-sizes")
    placed, sources, shards = quotas(sized, weights, max_repeats, block_words, shard_words, shard_rows, seed)
    groups = placed.groupBy("source", "shard", "place", "doc_id", "text_hash", "row_hash", "size").agg(F.count("*").alias("rows"))
    stream = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "text_hash", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    at = groups.withColumn("begin", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(stream), F.lit(0)))
    few = shards.select(F.col("source").alias("_s"), F.col("shard").alias("_k"), "laps", "rest")
    both = _with(at, few, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_k")))
    cut = both.where((F.col("begin") <= F.col("rest")) & (F.col("rest") < F.col("begin") + F.col("size") * F.col("rows")))
    out = save(cut.select("source", "shard", "laps", F.struct("place", "doc_id", "text_hash", "row_hash").alias("cut"), "size", "rows", (F.col("rest") - F.col("begin")).alias("words")), "mix-cuts")
    discard(sized)
    return sources, out


def _head(text, words):
    """The first words of a text, with the white space after them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.greatest(words.cast("int"), F.lit(1))), "")


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, seed: int = SEED
) -> DataFrame:
    """The mix itself, with the columns of docs: a document stands taken // size times whole and, where its shard's cut falls
    into it, once more with its first taken % size words; one of which nothing is taken goes. Of rows that are equal in
    all columns the first ones take what is left at a cut; which those are can't be told and doesn't matter."""
    ship(docs.sparkSession)
    row_hash = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")])))
    sources, found = cuts(docs, row_hash, max_repeats, weights, block_words, shard_words, shard_rows, seed)
    th, at, s1, n, s2, k, key, shard, laps, cut, size, rows, words, again = fresh(docs.columns, *"text_hash place source_a shards source_b shard_b key shard laps cut size rows words again".split())
    few = sources.select(F.col("source").alias(s1), F.col("shards").alias(n))
    ends = found.select(F.col("source").alias(s2), F.col("shard").alias(k), F.col("laps").alias(laps), F.col("cut").alias(cut), F.col("size").alias(size), F.col("rows").alias(rows), F.col("words").alias(words))
    x = docs.where(F.col("text").rlike(WORD)).withColumn(th, F.xxhash64("text")).withColumn(at, place("doc_id", F.col(th), seed))
    x = x.withColumn(key, F.struct(F.col(at).alias("place"), F.col("doc_id").alias("doc_id"), F.col(th).alias("text_hash"), row_hash.alias("row_hash")))
    x = _with(x, few, F.col("source").eqNullSafe(F.col(s1))).withColumn(shard, F.pmod(at, F.col(n)).cast("int"))
    x = _with(x, ends, F.col("source").eqNullSafe(F.col(s2)) & (F.col(shard) == F.col(k)))
    copies = lambda whole, part: F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    alone = (F.col(key) != F.col(cut)) | (F.col(rows) == 1)
    whole = F.col(laps) + F.when(F.col(key) < F.col(cut), 1).otherwise(0)
    most = x.where(alone).withColumn(again, F.explode(copies(whole, F.when(F.col(key) == F.col(cut), F.col(words)).otherwise(F.lit(0).cast("long")))))
    # Equal rows at a cut: one row with their number, combined before the shuffle, then numbered and dealt the words.
    cols = [F.col(f"`{c}`") for c in docs.columns]
    same = x.where(~alone).groupBy(*cols, laps, size, words).agg(F.count("*").alias(rows))
    numbered = same.withColumn(k, F.explode(F.sequence(F.lit(0).cast("long"), F.col(rows) - 1)))
    mine = F.greatest(F.least(F.col(words) - F.col(k) * F.col(size), F.col(size)), F.lit(0)).cast("long")
    dealt = numbered.withColumn(again, F.explode(copies(F.col(laps) + F.when(mine == F.col(size), 1).otherwise(0), F.when(mine < F.col(size), mine).otherwise(F.lit(0).cast("long")))))
    out = most.select(*cols, again).unionByName(dealt.select(*cols, again))
    return out.withColumn("text", F.when(F.col(again) > 0, _head(F.col("text"), F.col(again))).otherwise(F.col("text"))).drop(again)


def query(spark, sf_dir: str) -> DataFrame:
    """op10_mix: the mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "size", "source_size", "target", "taken")
