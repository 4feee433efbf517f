"""Deterministic samples and leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def bucket(question: Column, seed: str, buckets: int) -> Column:
    """First 8 bytes of SHA-256(seed, NUL, question), big-endian, modulo ``buckets``."""
    digest = F.sha2(F.concat(F.lit(seed + "\0"), question), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def assign(question: Column, seed: str, buckets: int, dev: int, holdout: int) -> Column:
    """Buckets under ``dev`` are dev, the next ``holdout`` ones holdout, the rest train."""
    b = bucket(question, seed, buckets)
    return F.when(b < dev, "dev").when(b < dev + holdout, "holdout").otherwise("train")


def hash_sample(rows: DataFrame, *, id_col: str, seed: str, size: int, separator: str = "\0", skip: int = 0) -> DataFrame:
    """The rows ``skip`` to ``skip + size`` in the order of SHA-256(seed, separator, id), with ``position``.

    Only ``skip + size`` narrow rows reach the one task that numbers them (top-k before the sort).
    """
    digest = F.sha2(F.concat(F.lit(seed + separator), F.col(id_col).cast("string")), 256)
    top = rows.withColumn("digest", digest).orderBy("digest", id_col).limit(skip + size)
    at = F.row_number().over(Window.orderBy("digest", id_col)) - 1
    return top.withColumn("position", at).where(F.col("position") >= skip)


def drop_seen(rows: DataFrame, seen: DataFrame, question: str) -> DataFrame:
    """Rows whose normalised question is not among the seen ones."""
    s = seen.select(T.normalize_question(F.col(question)).alias("__q")).distinct()
    return rows.withColumn("__q", T.normalize_question(F.col(question))).join(s, "__q", "left_anti").drop("__q")


def numeric_first(id_: Column) -> list[Column]:
    """Sort keys: ids that are numbers first, by value, then the others as text."""
    number = F.when(id_.rlike("^[0-9]+$"), id_.cast("decimal(38,0)"))
    return [number.asc_nulls_last(), id_.asc()]


def leakage_safe_splits(train: DataFrame, warmup: DataFrame, public: DataFrame, *, seed: str, buckets: int = 100, dev: int = 10, holdout: int = 10, mark_conflicts: bool = False) -> DataFrame:
    """``question_id, question, answer, source, normalized_question_sha256, status, split``.

    Rows whose normalised question is public are ``quarantine``; warm-up rows whose question is a
    training one are ``alias`` if the answer agrees with one of its, and an error if not (with
    ``mark_conflicts``, ``conflict`` and without a split); the rest are ``kept`` and get a split by
    their normalised question, so equal questions share one. An id kept twice is an error. All joins are on a question's hash.
    """
    cols = ["question_id", "question", "answer"]
    rows = train.select(*cols, F.lit("train").alias("source")).unionByName(warmup.select(*cols, F.lit("warmup").alias("source")))
    rows = rows.withColumn("q", T.normalize_question(F.col("question"))).withColumn("normalized_question_sha256", F.sha2("q", 256))
    open_ = public.select(F.sha2(T.normalize_question(F.col("question")), 256).alias("normalized_question_sha256"), F.lit(True).alias("is_public")).distinct()
    known = rows.where("source = 'train'").groupBy("normalized_question_sha256").agg(F.collect_set(T.normalize_question(F.col("answer"))).alias("answers"))
    j = rows.join(open_, "normalized_question_sha256", "left").join(known, "normalized_question_sha256", "left")
    conflict = F.lit("conflict") if mark_conflicts else F.raise_error(F.lit("a warm-up answer conflicts with training")).cast("string")
    agrees = F.array_contains("answers", T.normalize_question(F.col("answer")))
    status = (
        F.when(F.col("is_public"), "quarantine")
        .when((F.col("source") == "warmup") & F.col("answers").isNotNull(), F.when(agrees, "alias").otherwise(conflict))
        .otherwise("kept")
    )
    out = j.withColumn("status", status).withColumn("split", F.when(F.col("status") == "kept", assign(F.col("q"), seed, buckets, dev, holdout)))
    n = F.count_if(F.col("status") == "kept").over(Window.partitionBy("question_id"))
    out = out.withColumn("status", F.when((F.col("status") == "kept") & (n > 1), F.raise_error(F.lit("an id is kept twice")).cast("string")).otherwise(F.col("status")))
    return out.select(*cols, "source", "normalized_question_sha256", "status", "split")
