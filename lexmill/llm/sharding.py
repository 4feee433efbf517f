"""Sharding by extendible hashing: a directory over hash-prefix bits. Native columns only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import durable

#: Bits of the key hash that a directory can grow to.
BITS = 60


def extendible_shards(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 64 << 20, step: int = 8, row_col: str | None = None
) -> DataFrame:
    """One row per input row: ``id, n_bytes, shard, depth, shard_bytes, oversize``.

    A document's key is the first 60 bits of the MD5 of its id; its shard is the shortest prefix
    of the key whose documents together fit ``limit_bytes``: a bucket splits on its next bit only if
    it is too large. Bytes are summed by a prefix a few bits longer than the shards need, rolled up
    to every shorter one, and leaves are read off; only documents under a prefix that is still too
    large go on to the next ``step`` bits. Sums are partial before each shuffle, directories have a
    few rows per shard, and texts are measured where they are read and never shuffled.

    A document over the limit is a shard of its own, flagged ``oversize``. Rows that share a whole
    key (an id repeated) go on to ``key.n`` shards, filled in order of size, none over the limit but
    for a single row that is. Null ids are keyed as empty; null texts have 0 bytes; an empty table
    gives no rows. Other columns are not read. A ``row_col``, which tells rows apart, is passed on as ``row``.
    """
    own = [] if row_col is None else ["row"]
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    bits = F.lpad(F.conv(F.substring(key, 1, BITS // 4), 16, 2), BITS, "0")
    rest = durable(docs.select(
        *(F.col(row_col).alias(c) for c in own), F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), bits.alias("key")))
    total = rest.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + 3)
    done = []
    while True:
        sums = rest.groupBy(F.substring("key", 1, high).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        every = sums.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "p", "b", "n").groupBy(
            "depth", F.expr("substring(p, 1, depth)").alias("shard")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n"))
        fits = every.where((F.col("shard_bytes") <= limit_bytes) | (F.col("n") == 1))
        leaf = sums.select("p", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("shard", F.expr("substring(p, 1, depth)")).join(
            fits, ["depth", "shard"]).groupBy("p").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("s"))
        placed = durable(rest.withColumn("p", F.substring("key", 1, high)).join(leaf, "p", "left").select(
            *own, "id", "n_bytes", "key", F.col("s.shard").alias("shard"), F.col("s.depth").alias("depth"), F.col("s.shard_bytes").alias("shard_bytes")))
        done.append(placed.where("shard is not null"))
        rest = placed.where("shard is null").select(*own, "id", "n_bytes", "key")
        if high == BITS or rest.isEmpty():
            break
        low, high = high + 1, min(BITS, high + step)
    if not rest.isEmpty():
        w = Window.partitionBy("key").orderBy("n_bytes", "id", *own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # half-limit runs: a run holds less than half the limit and at most one row that crosses its end
        run = F.when(F.col("n_bytes") * 2 > limit_bytes, F.concat(F.lit("r"), F.row_number().over(Window.partitionBy("key").orderBy("n_bytes", "id", *own)))).otherwise(
            F.floor(F.sum("n_bytes").over(w) * 2 / F.lit(limit_bytes)).cast("string"))
        tied = rest.withColumn("shard", F.concat("key", F.lit("."), run))
        done.append(tied.withColumn("depth", F.lit(BITS)).withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("shard"))).select(
            *own, "id", "n_bytes", "key", "shard", "depth", "shard_bytes"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*own, F.col("id").alias(id_col), "n_bytes", "shard", "depth", "shard_bytes", (F.col("shard_bytes") > limit_bytes).alias("oversize"))


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", **how) -> None:
    """Write documents as one folder for each shard; a shard is one task's rows, bounded by the limit.

    Every row is written, to its own shard: rows that repeat an id or have none as well. They are told apart by a
    number that is checkpointed with them, since a shard is found from ids and sizes alone.
    """
    rows = durable(docs.withColumn("__row", F.monotonically_increasing_id()))
    to = extendible_shards(rows, id_col=id_col, row_col="__row", **how).select(F.col("row").alias("__row"), F.when(F.col("shard") == "", "all").otherwise(F.col("shard")).alias("shard"))
    rows.drop("shard").join(to, "__row").drop("__row").repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
