"""Writing indexes, splits and submissions."""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import audit, retrieval


def write_index(docs: DataFrame, tokens: Column, path: str, *, id_col: str = "doc_id") -> None:
    """Postings (clustered by term), term statistics and corpus statistics as Parquet under ``path``.

    Folded tokens or ``retrieval.trigram_tokens`` give the secondary tables.
    """
    p = retrieval.postings(docs, tokens, id_col)
    p.repartition("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    saved = docs.sparkSession.read.parquet(f"{path}/postings")
    saved.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/term_stats")
    retrieval.corpus_stats(docs, tokens).write.mode("overwrite").parquet(f"{path}/corpus_stats")


def write_splits(rows: DataFrame, path: str) -> None:
    """Rows by split under ``path/rows``, and ``path/manifest``: rows and a digest of the ids of each split and status."""
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    saved = rows.sparkSession.read.parquet(f"{path}/rows")
    # a sum of id digests depends on no order, so no split's ids meet in one task
    part = F.conv(F.substring(F.sha2(F.col("question_id").cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    saved.groupBy("split", "status").agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("ids_digest")).write.mode("overwrite").json(f"{path}/manifest")


def write_vectors(vectors: DataFrame, path: str, *, id_col: str, vector_col: str, dimension: int) -> None:
    """Vectors as Parquet in id order with a manifest; a wrong dimension, a null or a number that is not finite is an error."""
    v = F.col(vector_col)
    ok = (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = vectors.schema[vector_col].dataType.simpleString()
    checked = F.when(F.coalesce(ok, F.lit(False)), v).otherwise(F.raise_error(F.concat(F.lit("bad vector of "), F.col(id_col).cast("string"))).cast(kind))
    vectors.select(id_col, checked.alias(vector_col)).repartitionByRange(id_col).sortWithinPartitions(id_col).write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.read.parquet(f"{path}/vectors").agg(F.count("*").alias("rows"), F.lit(dimension).alias("dimension")).write.mode("overwrite").json(f"{path}/manifest")


def publish(spark: SparkSession, build: Callable[[str], None], path: str, *, force: bool = False) -> None:
    """Build under a temporary name beside ``path`` and rename it there, in whatever store holds it.

    What was there goes only once the new is in place, and comes back if that fails. Without ``force`` an
    existing path is an error, and so is a backup left by a run that died.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = lambda kind: jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{kind}")
    new, old = beside(f"building-{uuid.uuid4().hex}"), beside("previous")
    if fs.exists(at) and not force or fs.exists(old):
        raise FileExistsError(path)
    try:
        build(new.toString())
        if fs.exists(at) and not fs.rename(at, old):
            raise OSError(f"cannot set {path} aside")
        if not fs.rename(new, at):
            raise OSError(f"cannot put {path} in place")
        fs.delete(old, True)
    except Exception:
        fs.delete(new, True)
        if fs.exists(old) and not fs.exists(at):
            fs.rename(old, at)
        raise


def read_index_topk(spark: SparkSession, path: str, queries: DataFrame, query_tokens: Column, *, k: int, query_col: str = "item_id") -> DataFrame:
    """BM25 from a saved index: ``query_id, id, rank, score``, as ``retrieval.bm25`` has it.

    Only postings of terms that are asked for are read by the join; each query and document meet once.
    """
    terms = queries.select(F.col(query_col).alias("query_id"), F.explode(F.array_distinct(query_tokens)).alias("term"))
    stats = spark.read.parquet(f"{path}/corpus_stats")
    idf = spark.read.parquet(f"{path}/term_stats").join(terms.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(stats)).select(  # one row of two numbers
        "term", "avgdl", F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf"))
    tf = F.col("tf").cast("double")
    part = F.col("idf") * tf * (retrieval.K1 + 1) / (tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("dl") / F.col("avgdl")))
    hits = terms.join(idf, "term").join(spark.read.parquet(f"{path}/postings"), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 10).alias("score"))
    return retrieval.top_k(hits, k).select("query_id", "id", "rank", "score")


def write_counted(df: DataFrame, path: str, counters: dict[str, Column], *, bounds: dict[str, tuple[float | None, float | None]] | None = None) -> dict:
    """Write ``df`` as Parquet and return its counters, taken from the rows as they pass to the writer: no second scan.

    ``bounds`` gives a counter's least and greatest allowed value; if one is out of bounds, or null, what was written is taken
    away and it is an error. An existing path is an error. Tasks that run twice are counted once.
    """
    seen = Observation(f"write-{uuid.uuid4().hex}")
    df.observe(seen, *(c.alias(n) for n, c in counters.items())).write.mode("error").parquet(path)
    got = seen.get
    bad = {n: got[n] for n, (lo, hi) in (bounds or {}).items() if got[n] is None or lo is not None and got[n] < lo or hi is not None and got[n] > hi}
    if bad:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        raise ValueError(f"out of bounds: {bad}")
    return got


def save_once(df: DataFrame, path: str) -> None:
    """Write, or require that what is there is the same rows."""
    try:
        old = df.sparkSession.read.parquet(path)
    except Exception as e:  # Spark's own class for a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.parquet(path)
        return
    if not audit.same_rows(old, df):
        raise ValueError(f"{path} holds other rows")


def write_submission(answers: DataFrame, expected: DataFrame, path: str, *, at_most: int = 100_000) -> None:
    """A ZIP of one JSON object of answers in id order, with a fixed time stamp.

    Ids must be those expected and answers not blank. A submission is a driver's file of a known number of
    questions; more than ``at_most`` is an error.
    """
    if not audit.missing_and_extra(answers, expected, "question_id").isEmpty():
        raise ValueError("ids differ from those expected")
    rows = answers.select("question_id", "answer").limit(at_most + 1).collect()
    if len(rows) > at_most or any(not (r.answer or "").strip() for r in rows):
        raise ValueError("too many answers, or a blank one")
    body = json.dumps({r.question_id: {"answer": r.answer} for r in sorted(rows, key=lambda r: r.question_id)}, ensure_ascii=False)
    with zipfile.ZipFile(path + ".part", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("submission.json", (1980, 1, 1, 0, 0, 0)), body)
    os.replace(path + ".part", path)
