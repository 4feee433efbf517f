"""Model stages with the model passed in: a function over batches, so any library serves, and rows stay in the plan.

``load`` runs once in each Python worker's task and gives the model; nothing of it is pickled but the function itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators import audit
from lexmill.session import durable

Embed = Callable[[list[str]], np.ndarray]
Score = Callable[[list[str], list[str]], np.ndarray]
Generate = Callable[[list[str], dict], list[str]]

#: Decoding variants of one prompt, by name.
GREEDY = {"greedy": {"do_sample": False}}


def _map(rows: DataFrame, columns: dict[str, object], load: Callable[[], object], apply, keep: list[str], schema: str, batch: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch].reset_index(drop=True)
                yield apply(model, part)

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, *[c.alias(n) for n, c in columns.items()]).mapInPandas(run, f"{kept}, {schema}")


def embed(rows: DataFrame, load: Callable[[], Embed], *, id_col: str, text_col: str, dimension: int, prefix: str = "", batch: int = 64) -> DataFrame:
    """``id, embedding``: unit vectors of ``prefix`` and text; a wrong dimension or a number that is not finite is an error. Null texts count as empty."""

    def apply(model: Embed, part: pd.DataFrame) -> pd.DataFrame:
        v = np.asarray(model([prefix + (t or "") for t in part["__t"]]), np.float32)
        if v.shape != (len(part), dimension) or not np.isfinite(v).all():
            raise ValueError(f"embeddings of shape {v.shape}, or not finite")
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({id_col: part[id_col], "embedding": list(v)})

    return _map(rows, {"__t": F.col(text_col)}, load, apply, [id_col], "embedding array<float>", batch)


def score_pairs(rows: DataFrame, load: Callable[[], Score], *, keep: list[str], question: str, context: str, batch: int = 64) -> DataFrame:
    """The ``keep`` columns and a cross-encoder's ``score`` of question and context; scores that are not finite are an error."""

    def apply(model: Score, part: pd.DataFrame) -> pd.DataFrame:
        s = np.asarray(model(part["__q"].fillna("").tolist(), part["__c"].fillna("").tolist()), float)
        if s.shape != (len(part),) or not np.isfinite(s).all():
            raise ValueError("scores are missing or not finite")
        return part[keep].assign(score=s)

    return _map(rows, {"__q": F.col(question), "__c": F.col(context)}, load, apply, keep, "score double", batch)


def decoding_grid(prompts: DataFrame, variants: dict[str, dict]) -> DataFrame:
    """Each prompt under each variant's name: rows for ``generate``; the variants are a handful of settings."""
    names = prompts.sparkSession.createDataFrame([(n,) for n in sorted(variants)], "variant string")
    return prompts.crossJoin(F.broadcast(names))


def generate(prompts: DataFrame, load: Callable[[], Generate], *, keep: list[str], prompt: str, variants: dict[str, dict] = GREEDY, variant: str | None = None, batch: int = 8) -> DataFrame:
    """The ``keep`` columns, ``answer`` and ``answer_sha256``; ``variant`` names the column that picks the settings. A blank answer is an error."""

    def apply(model: Generate, part: pd.DataFrame) -> pd.DataFrame:
        out = pd.Series([None] * len(part), dtype=object)
        for name, own in part.groupby("__v"):
            out.loc[own.index] = model(own["__p"].fillna("").tolist(), variants[name])
        if any(not (a or "").strip() for a in out):
            raise ValueError("a blank answer")
        return part[keep].assign(answer=out, answer_sha256=[hashlib.sha256(a.encode()).hexdigest() for a in out])

    first = F.col(variant) if variant else F.lit(next(iter(variants)))
    return _map(prompts, {"__p": F.col(prompt), "__v": first}, load, apply, keep, "answer string, answer_sha256 string", batch)


def finish_reason(tokens: list[int], eos: set[int], most: int) -> str:
    """``eos`` if an end token came last, ``length`` if there was no room for more, else ``other``."""
    return "eos" if tokens and tokens[-1] in eos else "length" if len(tokens) >= most else "other"


def generate_until_done(
    prompts: DataFrame, load: Callable[[], Callable[[list[str], dict], list[tuple[str, list[int]]]]], *, keys: list[str], prompt: str, passes: list[dict], eos: set[int], path: str, batch: int = 8
) -> DataFrame:
    """``keys, attempt, answer, answer_sha256, finish_reason, tokens``: answers, those cut off by length run again with the next settings.

    The model gives an answer and its new tokens for each prompt; a pass's settings hold ``max_new_tokens``. Each pass is
    stored under ``path`` as it is made, by ``attempt``; a run that goes on after a failure makes only what is not there,
    and passes read the stored rows of the one before. The last attempt of a prompt counts, cut off or not. A blank
    answer is an error; keys must differ.
    """
    spark, types = prompts.sparkSession, prompts.select(*keys).dtypes
    schema = ", ".join([*(f"`{c}` {t}" for c, t in types), "answer string, answer_sha256 string, finish_reason string, tokens int, attempt int"])

    def saved() -> DataFrame:
        return spark.read.schema(schema).parquet(path) if audit.path_exists(spark, path) else spark.createDataFrame([], schema)

    for n, settings in enumerate(passes):
        def apply(model, part: pd.DataFrame, settings=settings) -> pd.DataFrame:
            got = model(part["__p"].fillna("").tolist(), settings)
            if any(not (a or "").strip() for a, _ in got):
                raise ValueError("a blank answer")
            return part[keys].assign(
                answer=[a for a, _ in got], answer_sha256=[hashlib.sha256(a.encode()).hexdigest() for a, _ in got],
                finish_reason=[finish_reason(t, eos, settings["max_new_tokens"]) for _, t in got], tokens=[len(t) for _, t in got])

        done = saved()
        todo = prompts if n == 0 else prompts.join(done.where((F.col("attempt") == n - 1) & (F.col("finish_reason") == "length")).select(*keys), keys, "left_semi")
        todo = todo.join(done.where(F.col("attempt") == n).select(*keys), keys, "left_anti")
        made = _map(todo, {"__p": F.col(prompt)}, load, apply, keys, "answer string, answer_sha256 string, finish_reason string, tokens int", batch)
        made.withColumn("attempt", F.lit(n)).write.mode("append").partitionBy("attempt").parquet(path)
    rest = ["answer", "answer_sha256", "finish_reason", "tokens"]
    last = saved().groupBy(*keys).agg(F.max(F.struct("attempt", *rest)).alias("x"))
    return last.select(*keys, "x.attempt", *(f"x.{c}" for c in rest))


def collate(rows: DataFrame, *, key: str, batch: int, pad_id: int, ignore: int = -100) -> DataFrame:
    """Training batches from ``input_ids, labels``: ``batch, ids, input_ids, attention_mask, labels``, padded to the longest of a batch.

    Rows are dealt by a hash of their key and order within it, so a batch is a group of bounded size in each of many partitions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                width = max(len(x) for x in part["input_ids"])
                pad = lambda xs, v: [list(x) + [v] * (width - len(x)) for x in xs]
                yield pd.DataFrame({
                    "batch": [number], "ids": [part[key].astype(str).tolist()], "input_ids": [pad(part["input_ids"], pad_id)],
                    "attention_mask": [[[1] * len(x) + [0] * (width - len(x)) for x in part["input_ids"]]], "labels": [pad(part["labels"], ignore)]})
                number += 1

    own = rows.select(key, "input_ids", "labels").repartition(key).sortWithinPartitions(key)
    return own.mapInPandas(run, "batch int, ids array<string>, input_ids array<array<int>>, attention_mask array<array<int>>, labels array<array<int>>")


def work_partitions(rows: DataFrame, *, order: str, workers: int, length: str | None = None, most_short: int | None = None) -> DataFrame:
    """The same rows with ``route`` (``long`` over ``most_short``, else ``short``) and ``worker``: the place among a route's rows modulo ``workers``.

    Places are found without one task for all: each range partition counts its rows, and the counts before it are added.
    """
    long_ = F.lit(False) if length is None else F.col(length) > most_short
    routed = rows.withColumn("route", F.when(long_, "long").otherwise("short"))
    ranged = routed.repartitionByRange(F.col("route"), F.col(order)).sortWithinPartitions("route", order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    ranged = durable(ranged)
    sizes = ranged.groupBy("route", "__p").agg(F.count("*").alias("n"), F.min("__i").alias("__first"))
    sizes = sizes.withColumn("__before", F.sum("n").over(Window.partitionBy("route").orderBy("__p")) - F.col("n"))  # one row a partition
    j = ranged.join(F.broadcast(sizes.select("route", "__p", "__first", "__before")), ["route", "__p"])
    return j.withColumn("worker", ((F.col("__before") + F.col("__i") - F.col("__first")) % workers).cast("int")).select(*rows.columns, "route", "worker")
