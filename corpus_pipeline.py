"""Corpus pipeline over ``documents``: toxicity, line dedup, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes every stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.llm import line_dedup, mixing, near_dedup, packing, toxicity
from trialweave.llm.common import free_name, table
from trialweave.runtime import pin, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; the model learns from the labels of this stage's own documents."""
    ship(spark)
    name = free_name(docs, "_toxicity")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), name=name)
    return scored.where(F.col(name) < 0.5).select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of line runs; those of which nothing is left go. ``n_chars`` follows the text."""
    ship(spark)
    cut = line_dedup.delete_repeats(docs)
    lines, gone = cut.columns[-2:]
    left = cut.where((F.col(gone) == 0) | (F.col(gone) < F.col(lines)))
    return left.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the target weights; one taken in several epochs stands there as often."""
    return mixing.mix_documents(docs).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences with their token ids."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", cut_repeated_lines), ("near-duplicates", drop_near_copies), ("mixing", mix_sources), ("packing", pack_tokens)]
#: The toxicity model is trained and packing reads a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
