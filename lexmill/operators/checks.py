"""Checks of prepared rows: what is not as it must be is an error raised inside the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _require(ok: Column, message: Column, value: Column, kind: str) -> Column:
    """The value where the check holds; null counts as failed."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(message).cast(kind))


def validate_context_rows(rows: DataFrame, *, target: str, selected: int, fused: int) -> DataFrame:
    """The same rows, each checked: its target, no answer, ``selected`` distinct contexts with text, the first of its ``fused`` ones.

    ``rows``: ``question_id, target, answer_included, contexts`` (array of ``chunk_id, text``) and ``fused`` (array of ``chunk_id``).
    An ``answer`` column, or an id that is there twice, is an error.
    """
    if "answer" in rows.columns:
        raise ValueError("context rows hold answers")
    ids = F.transform("contexts", lambda c: c["chunk_id"])
    ok = (
        (F.col("target") == target) & ~F.col("answer_included") & (F.size("contexts") == selected) & (F.size("fused") == fused)
        & (ids == F.slice(F.transform("fused", lambda c: c["chunk_id"]), 1, selected)) & (F.size(F.array_distinct(ids)) == selected)
        & ~F.exists("contexts", lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) == "") & (F.count("*").over(Window.partitionBy("question_id")) == 1))
    kind = rows.schema["question_id"].dataType.simpleString()
    message = F.concat(F.lit("invalid context row: "), F.coalesce(F.col("question_id").cast("string"), F.lit("null")))
    return rows.withColumn("question_id", _require(ok, message, F.col("question_id"), kind))


def lockstep(left: DataFrame, right: DataFrame, *, key: str, order: str, same: list[str]) -> DataFrame:
    """Two tables of the same keys in the same order as one: the left's columns, then the right's others.

    A key on one side only, twice on a side, at another place, or with other values in ``same``, is an error.
    """
    own = [c for c in right.columns if c not in (key, order, *same)]
    a = left.withColumn("__l", F.struct(order, *same)).withColumn("__nl", F.count("*").over(Window.partitionBy(key)))
    b = right.select(key, *own, F.struct(order, *same).alias("__r"), F.count("*").over(Window.partitionBy(key)).alias("__nr"))
    j = a.join(b, key, "full_outer")
    ok = (F.col("__l") == F.col("__r")) & (F.col("__nl") == 1) & (F.col("__nr") == 1)
    message = F.concat(F.lit("tables differ at "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return j.withColumn(key, _require(ok, message, F.col(key), left.schema[key].dataType.simpleString())).select(*left.columns, *own)


def counted(rows: DataFrame, expected: int) -> DataFrame:
    """The same rows; another number of them than ``expected`` is an error when they are read. The count is one aggregate."""
    n = rows.agg(F.count("*").alias("__n"))
    first = rows.columns[0]
    kind = rows.schema[first].dataType.simpleString()
    out = rows.crossJoin(F.broadcast(n))  # one row of one number
    return out.withColumn(first, F.when(F.col("__n") == expected, F.col(first)).otherwise(F.raise_error(F.concat(F.lit("rows: "), F.col("__n").cast("string"))).cast(kind))).drop("__n")


def chunks_of_documents(chunks: DataFrame, wanted: DataFrame, *, key: str = "document_id", order: str = "chunk_index") -> DataFrame:
    """Chunks of the wanted documents with their ``position`` in the document; a document without any is an error."""
    w = wanted.select(key).distinct()
    found = w.join(chunks.withColumn("__found", F.lit(True)), key, "left")
    kind = chunks.schema[key].dataType.simpleString()
    ok = _require(F.col("__found"), F.concat(F.lit("no chunks of "), F.col(key).cast("string")), F.col(key), kind)
    return found.withColumn(key, ok).withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).drop("__found")
