"""Five stages over `documents`, each written as Parquet and read again as the next one's input.

run(spark, sf_dir) applies them; ORACLE_SQL is None, as SQL can't express the learned and fuzzy stages (tests compare
them with brute force).

Defined cases, for every stage but the last: a null or wordless text goes with the first stage (it has no language); null
doc_id, lang and source stay as they are; rows that repeat doc_id and text are copies, of which the second stage keeps
one, as it does of equal and near-equal texts under other ids; of rows that share a doc_id but not the text each stands for
itself; very long texts are read whole; extra columns pass by under any name, in their order; an empty table gives an empty
table. Of documents in a class of near copies the smallest doc_id stays (null comes first), ties by text hash. A benchmark
without items drops nothing. The mix repeats and cuts documents as their source's target says. The last stage returns what
its files hold: doc_id, start, n_tokens, ids_crc32. A stage's table is removed when the next one has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, jaccard, langid, mixing, tokenstore
from palimpsest.runtime import discard, save


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language is a toss-up, go."""
    return langid.filter_language(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link through five-word shingles at 0.8 or more one stays: the smallest doc_id."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go (see decontaminate.py for items of fewer than 8 words)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixing.mixed_documents(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in files; what the files hold, by document."""
    return tokenstore.round_trip(docs)


STAGES = [
    ("language_id", keep_languages),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_ids", to_token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
