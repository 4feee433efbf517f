"""A corpus pipeline of five stages over ``documents``; each works on all that the one before kept.

Every stage judges rows by what they hold: rows whose id is null, or that share an id, are scored, deduplicated,
compared, mixed and packed like others. Null and blank texts pass the filters; an empty table gives an empty
one; of tied rows the first as stored is kept. Only the columns of ``documents`` are read and passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, minhash, mixing, packing, toxicity
from lexmill.session import durable, ensure_importable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents and drop those predicted toxic."""
    ensure_importable(spark)
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs.select(*COLUMNS), weights)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one of the least id, of each group of near duplicates (five words, 0.8)."""
    ensure_importable(spark)
    return minhash.without_near_duplicates(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    ensure_importable(spark)
    return decontaminate.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut or leave out documents until sources have their weights."""
    ensure_importable(spark)
    return mixing.materialise(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    ensure_importable(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are checkpointed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs


#: Training, sketching, tiling and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None
