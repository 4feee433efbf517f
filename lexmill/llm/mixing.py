"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import durable

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame) -> tuple[int, int]:
    """Level ``num / den`` at which ``sum(min(cap, weight * level))`` is the budget.

    ``sources`` has ``cap`` and ``weight`` (long) and ``budget2`` (twice the budget). Sources over
    their cap are clamped and what they cannot take is shared again by weight, until none is over;
    each round is one aggregate over the sources and only its sums reach the driver. Exact integers.
    """
    big = "decimal(38,0)"
    num, den = 0, 1
    while True:
        over = F.col("cap").cast(big) * F.lit(den).cast(big) < F.col("weight").cast(big) * F.lit(num).cast(big)
        r = sources.agg(
            F.max("budget2").alias("b"), F.sum(F.when(over, F.col("cap")).otherwise(0).cast(big)).alias("c"),
            F.sum(F.when(over, 0).otherwise(F.col("weight")).cast(big)).alias("w"),
        ).first()
        if r.b is None or not r.w:
            return (num, den) if num else (0, 1)
        new = (int(r.b) - 2 * int(r.c), 2 * int(r.w))
        if new[0] * den == num * new[1]:
            return new
        num, den = new


def mixture(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1), share_percent: int = 150, max_epochs: int = 2, seed: int = 17, row_col: str | None = None,
) -> DataFrame:
    """One row per input row: ``id, size, source_size, target, taken, whole``, and ``row_col``, a number of each row, if given.

    Sources in code-point order, null last, take the weights in turn; together they share
    ``share_percent`` of all words, none over ``max_epochs`` times its own. Each document is taken
    ``whole`` times in full; what is left of its source's target goes to documents in the order of
    a seeded hash, each once in full, and the one at the border by its first words, so that a
    source's sum is its target rounded down, whatever its documents' lengths. ``taken`` counts words.

    A source's order is cut in 4096 runs by hash prefix; sums of runs say which are in and which
    out, and only the run at the border is put in order row by row, so a hot source meets in no
    task. Texts are counted where they are read and are not shuffled. The table of sources is one
    row per source. Null texts have size 0 and are taken 0 times; null ids are hashed as empty;
    equal rows are interchangeable. Without rows the result is empty. Other columns are not read.
    """
    row = F.col(row_col) if row_col else F.lit(0)
    own = durable(docs.select(
        row.cast("long").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"),
    ))
    runs = durable(own.groupBy("source", F.substring("h", 1, 3).alias("run")).agg(F.sum("size").alias("run_size")))
    total = runs.agg(F.sum("run_size")).first()[0] or 0
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    sources = runs.groupBy("source").agg(F.sum("run_size").alias("source_size")).select(
        "source", "source_size", (F.col("source_size") * max_epochs).alias("cap"), pick.alias("weight"), F.lit(total * share_percent * 2 // 100).alias("budget2"))
    sources = durable(sources)
    num, den = water_level(sources)
    fill = F.col("weight").cast("double") * F.lit(float(num)) / F.lit(float(den))
    target = F.when(F.col("cap").cast("decimal(38,0)") * F.lit(den).cast("decimal(38,0)") < F.col("weight").cast("decimal(38,0)") * F.lit(num).cast("decimal(38,0)"), F.col("cap").cast("double")).otherwise(F.least(fill, F.col("cap").cast("double")))
    plan = sources.select("source", "source_size", target.alias("target")).withColumn("goal", F.floor("target").cast("long"))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("extra", F.col("goal") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("run_size").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = runs.select(F.col("source").alias("s"), F.col("run").alias("r"), "run_size", before.alias("before"))
    at = durable(at.join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("source"))
    run = F.substring("h", 1, 3)
    joined = own.join(at, F.col("source").eqNullSafe(F.col("s")) & (run == F.col("r"))).drop("s")
    joined = joined.withColumn("room", F.col("extra") - F.col("before"))
    border = (F.col("room") > 0) & (F.col("room") < F.col("run_size"))
    so_far = F.sum("size").over(Window.partitionBy("source", "r").orderBy("h", "id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = joined.where(border).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - so_far + F.col("size"))))
    rest = joined.where(~border).withColumn("part", F.when(F.col("room") >= F.col("run_size"), F.col("size")).otherwise(F.lit(0)))
    return edge.unionByName(rest).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"), "whole",
        *([F.col("row").alias(row_col)] if row_col else []))


def materialise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The mix as documents: each taken repetition is a row; a fractional one has its first words.

    Rows are told apart by a number of their own, their place in the stored table, so rows of null or repeated ids are
    mixed like others; give a table that was written or checkpointed. Texts without words stay once. The other
    columns are carried along unchanged.
    """
    own = docs.withColumn("__row", F.monotonically_increasing_id())
    mix = mixture(own, id_col=id_col, text_col=text_col, row_col="__row", **how).select("__row", F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    reps = F.when(F.col("__size") == 0, F.lit(1).cast("long")).otherwise(F.ceil(F.col("__taken") / F.col("__size")).cast("long"))
    rows = own.join(mix, "__row").withColumn("__reps", reps).where("__reps > 0").withColumn("__rep", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__reps"))))
    left = (F.col("__taken") - (F.col("__rep") - 1) * F.col("__size")).cast("int")
    cut = F.expr(f"array_join(slice(regexp_extract_all(`{text_col}`, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast(__taken - (__rep - 1) * __size as int)), '')")
    rows = rows.withColumn(text_col, F.when((left > 0) & (left < F.col("__size")), cut).otherwise(F.col(text_col)))
    return rows.select(*docs.columns)
