"""Order over many tasks: row numbers and running values of groups that no task has to hold whole.

Rows are dealt by ranges of (group, order), so a large group lies in many partitions, its chunks, one after
another. A window runs within each chunk; chunks are summed up to one row each, and what the chunks before
have come to is carried into every chunk of a group that has several: at most one row for each partition.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import durable

_POSITION = (1 << 33) - 1  # monotonically_increasing_id holds the partition above 33 bits and the row's place below


def in_chunks(df: DataFrame, *by: Column | str, chunks: int | None = None) -> DataFrame:
    """Rows in the order of ``by`` over range partitions, checkpointed, with ``chunk``, the number of the partition, and ``place`` in it.

    Rows alike in all of ``by`` stay in one partition, so ``by`` should end in columns that tell rows apart.
    """
    dealt = df.repartitionByRange(*(by if chunks is None else (chunks, *by))).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    return durable(dealt.select("*", F.shiftright(at, 33).cast("int").alias("chunk"), at.bitwiseAND(F.lit(_POSITION)).alias("place")))


def numbered(df: DataFrame, *by: Column | str, name: str = "row", chunks: int | None = None) -> DataFrame:
    """``df`` with the number of each row in the order of ``by``, from 0; no window holds all rows.

    Counts, one a partition, pass the driver as those of any stage do.
    """
    rows = in_chunks(df, *by, chunks=chunks)
    counts = {r.chunk: r.n for r in rows.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    before, table = 0, []
    for chunk in sorted(counts):
        table.append((chunk, before))
        before += counts[chunk]
    start = df.sparkSession.createDataFrame(table, "chunk int, __start long")  # a number for each partition
    return rows.join(F.broadcast(start), "chunk").withColumn(name, F.col("__start") + F.col("place")).drop("chunk", "place", "__start")


#: Rows of a group that a window in one task is given; a larger group is dealt over many.
WINDOW_ROWS = 100_000
#: Rows of small groups that are dealt to one task, about; each of its sorts holds them all.
TASK_ROWS = 500_000


def _dealt(df: DataFrame, rows: int, group: list[str]) -> DataFrame:
    """``df`` of ``rows`` rows by its groups, over as many partitions as ``TASK_ROWS`` asks for; few rows are dealt by the session.

    Left alone, Spark puts partitions together by their compressed bytes, so a task's rows grow with the input.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *group) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def by_group(df: DataFrame, group: list[str], order: list[Column | str], core, *, most: int | None = None) -> DataFrame:
    """``core(rows, running)`` over all groups, whose rows have a ``place`` in the order of ``order``.

    Groups of at most ``most`` rows are ordered by one window each. Of the larger ones, which a count finds and of which
    there are at most as many as ``most`` goes into all rows, each is dealt by ranges over many tasks and ``running`` carries over.
    """
    most = most or WINDOW_ROWS
    large = durable(df.groupBy(*group).count().where(F.col("count") > most).select(*(F.col(g).alias(f"__h{i}") for i, g in enumerate(group))))
    same = F.lit(True)
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__h{i}"))
    none = large.isEmpty()
    small = df if none else df.join(F.broadcast(large), same, "left_anti")
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    out = core(_dealt(small, df.count(), group).withColumn("chunk", F.lit(0)).withColumn("place", nth), partial(running, carry=False))
    return out if none else out.unionByName(core(in_chunks(df.join(F.broadcast(large), same, "left_semi"), *group, *order), running))


def _kind(kind: str, backward: bool):
    """How values of a kind are run over, summed up for a chunk, and joined with what other chunks carry."""
    if kind == "sum":
        return F.sum, F.sum, lambda carried, own: F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))
    if kind in ("max", "min"):
        f, g = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
        return f, f, g
    pick, by = (F.first, F.min_by) if backward else (F.last, F.max_by)  # the nearest that is not null
    there = lambda c: by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col("place")))
    return lambda c: pick(c, ignorenulls=True), there, lambda carried, own: F.coalesce(own, carried)


def running(rows: DataFrame, group: list[str], values: dict[str, tuple[str, Column]], *, own: bool = True, backward: bool = False, carry: bool = True) -> DataFrame:
    """``rows`` of ``in_chunks`` with running values over the rows of their group up to each, in that order.

    ``values`` maps a name to ``sum``, ``max``, ``min`` or ``near`` (the nearest value that is not null) and a column.
    Without ``own`` a row's own value is left out; ``backward`` runs from the group's end. Null groups are a group, and
    ``group`` must be what the chunks were ordered by first. Without ``carry`` each group lies in one chunk.
    """
    ends = (0, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, 0)
    without = (1, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*group, "chunk").orderBy("place").rowsBetween(*(ends if own else without))
    kinds = {name: _kind(kind, backward) for name, (kind, _) in values.items()}
    local = rows.select(*rows.columns, *(kinds[name][0](c).over(inner).alias(name) for name, (_, c) in values.items()))
    if not carry:
        return local if not any(kind == "sum" for kind, _ in values.values()) else local.withColumns({n: F.coalesce(n, F.lit(0)) for n, (kind, _) in values.items() if kind == "sum"})
    totals = rows.groupBy(*group, "chunk").agg(*(kinds[name][1](c).alias(f"__{name}") for name, (_, c) in values.items()))
    # one row for a chunk and group; of those that take something over there is one a partition at most
    outer = Window.partitionBy(*group).orderBy("chunk")
    carried = totals.select(
        *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("chunk").alias("__chunk"),
        F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("chunk") if backward else "chunk")).alias("__nth"),
        *(kinds[name][0](F.col(f"__{name}")).over(outer.rowsBetween(*without)).alias(f"__{name}") for name in values)).where("__nth > 1")
    same = F.col("chunk") == F.col("__chunk")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = local.join(F.broadcast(carried), same, "left")
    return out.select(*rows.columns, *(kinds[name][2](F.col(f"__{name}"), F.col(name)).alias(name) for name in values))
