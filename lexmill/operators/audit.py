"""Corpus audits: counts, order statistics, duplicate groups, inventories, digests, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.ordered import numbered


def nearest_ranks(values: DataFrame, column: str, ratios: dict[str, float]) -> DataFrame:
    """One row of order statistics at index ``round((n - 1) * ratio)``, halves to even, no interpolation.

    Values are counted first; ranks are running sums over distinct values, whose number bounds what is
    ordered in one task (lengths and counts have few).
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda r: F.bround((F.col("n") - 1) * F.lit(r), 0)
    return ranked.agg(*[F.min(F.when(F.col("upto") > at(r), F.col("v"))).alias(name) for name, r in ratios.items()])


def text_audit(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Counts of null, blank, HTML-like, CR and repeated texts, and the total of characters."""
    t = F.col(text_col)
    return docs.agg(
        F.count("*").alias("rows"), F.count_if(t.isNull()).alias("null_texts"), F.count_if(F.trim(t) == "").alias("blank_texts"),
        F.count_if(t.rlike("<[a-zA-Z/]")).alias("html_texts"), F.count_if(t.contains("\r")).alias("crlf_texts"),
        F.sum(F.length(t)).alias("characters"), (F.count(t) - F.count_distinct(F.sha2(t, 256))).alias("repeats"))


def duplicate_groups(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``digest, copies, first_id`` of texts that occur more than once."""
    return docs.where(F.col(text_col).isNotNull()).groupBy(F.sha2(F.col(text_col), 256).alias("digest")).agg(
        F.count("*").alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")


def longest(docs: DataFrame, *, id_col: str, text_col: str, k: int = 10) -> DataFrame:
    """The k longest texts (ties: id): a report of k rows."""
    return docs.select(F.col(id_col), F.length(text_col).alias("characters")).orderBy(F.desc("characters"), id_col).limit(k)


def ordered_digest(rows: DataFrame, *, order: str, value: Column) -> DataFrame:
    """SHA-256 over the row digests in order: ``digest, rows``; 64 characters a row meet in one group."""
    d = rows.select(F.struct(F.col(order).alias("o"), F.sha2(value, 256).alias("d")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("a"))
    return d.select(F.sha2(F.array_join(F.transform("a", lambda x: x["d"]), "\n"), 256).alias("digest"), F.size("a").cast("long").alias("rows"))


#: Digests that one node of a tree covers.
TREE_WIDTH = 1024


def tree_digest(rows: DataFrame, *, order: str, value: Column) -> DataFrame:
    """``digest, rows``: the root of a tree of SHA-256 over the row digests in order, whatever their number.

    A node is the digest of up to ``TREE_WIDTH`` digests that follow each other, joined by newlines; levels are built until
    one node is left, at least one. The tree is defined by the rows' numbers, so it depends on no partitions, and no
    task holds more than one node's digests at a time. Rows that share an order follow each other by their digest. No rows give none.
    """
    node = numbered(rows.select(F.col(order).alias("o"), F.sha2(value.cast("binary"), 256).alias("d")), "o", "d", name="i").select("i", F.coalesce("d", F.lit("")).alias("d"))
    n = node.count()
    if not n:
        return node.select("d", "i").limit(0).toDF("digest", "rows")
    left = n
    while True:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"])
        node = node.groupBy(F.floor(F.col("i") / TREE_WIDTH).alias("i")).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("d"))
        left = -(-left // TREE_WIDTH)
        if left == 1:
            return node.select(F.col("d").alias("digest"), F.lit(n).cast("long").alias("rows"))


def record_digest(*columns: str) -> Column:
    """Digest of a row's canonical JSON (columns by name)."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def inventory_errors(models: DataFrame, stacks: DataFrame, *, limit: int) -> DataFrame:
    """``kind, key`` for repeated models or stacks, unknown members, wrong totals, and totals not under the limit."""
    repeats = models.groupBy("key").count().where("count > 1").select(F.lit("repeated model").alias("kind"), "key")
    repeats = repeats.unionByName(stacks.groupBy(F.col("stack_id").alias("key")).count().where("count > 1").select(F.lit("repeated stack").alias("kind"), "key"))
    parts = stacks.select("stack_id", "total_parameter_count", F.explode("model_keys").alias("key"))
    known = models.dropDuplicates(["key"]).select("key", "parameter_count")
    j = parts.join(known, "key", "left")
    unknown = j.where("parameter_count is null").select(F.lit("unknown model").alias("kind"), "key")
    sums = j.groupBy("stack_id", "total_parameter_count").agg(F.sum("parameter_count").alias("s"))
    wrong = sums.where("s <> total_parameter_count").select(F.lit("wrong total").alias("kind"), F.col("stack_id").alias("key"))
    over = sums.where(F.col("s") >= limit).select(F.lit("over the limit").alias("kind"), F.col("stack_id").alias("key"))
    return repeats.unionByName(unknown).unionByName(wrong).unionByName(over)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at ``path``, in whatever store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def missing_and_extra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``key, side``."""
    a = left.select(key).join(right.select(key), key, "left_anti").select(key, F.lit("left").alias("side"))
    return a.unionByName(right.select(key).join(left.select(key), key, "left_anti").select(key, F.lit("right").alias("side")))


def select_complete(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys; a key that is missing or there twice is an error, raised inside the plan."""
    w = wanted.select(key).distinct()
    found = rows.join(w, key, "left_semi").withColumn("__n", F.count("*").over(Window.partitionBy(key))).withColumn("__found", F.lit(True))
    out = w.join(found, key, "left")
    ok = F.when(F.col("__found") & (F.col("__n") == 1), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("missing or repeated: "), F.col(key).cast("string"))).cast(rows.schema[key].dataType))
    return out.withColumn(key, ok).drop("__n", "__found").select(*rows.columns)


def overlay(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the new values where a key has them, and the old ones elsewhere."""
    n = new.select(key, F.struct(*columns).alias("__new"))
    return old.join(n, key, "left").select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows with the same repeats: what a saved table is checked by."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def filled_counts(rows: DataFrame, columns: list[str], *, total: str = "rows") -> DataFrame:
    """One row: how many rows there are, how many have each column non-blank, and how many have none of them.

    Null and blank values are not filled; an empty table gives zeros.
    """
    filled = {c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in columns}
    none = ~F.greatest(F.lit(False), F.lit(False), *filled.values())
    return rows.agg(F.count("*").alias(total), *[F.count_if(v).alias(f"with_{c}") for c, v in filled.items()], F.count_if(none).alias("with_none"))


def differing_inputs(rows: DataFrame, *, key: str, variant: str, value: str) -> DataFrame:
    """Keys that two variants gave different inputs, or that a variant lacks or repeats: ``key, inputs, variants, n``.

    Inputs are compared by digest, null being an input of its own; the number of variants is that of all
    rows. Rows with a null key or variant are no one's input and are left out. One aggregation by key.
    """
    own = rows.where(F.col(key).isNotNull() & F.col(variant).isNotNull())
    digest = F.coalesce(F.sha2(F.col(value).cast("string"), 256), F.lit(""))
    per = own.groupBy(key).agg(
        F.count_distinct(digest).alias("inputs"), F.count_distinct(variant).alias("variants"), F.count("*").alias("n"))
    every = own.agg(F.count_distinct(variant)).scalar()
    return per.where((F.col("inputs") > 1) | (F.col("variants") < every) | (F.col("n") > F.col("variants")))


def within_length(rows: DataFrame, length: Column, most: int, key: str) -> DataFrame:
    """The same rows; one whose length is over ``most`` is an error raised inside the plan, never cut. Null lengths pass."""
    over = F.raise_error(F.concat(F.lit(f"over {most}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(rows.schema[key].dataType)
    return rows.withColumn(key, F.when(length > most, over).otherwise(F.col(key)))


def token_length_audit(rows: DataFrame, tokens: Column, *, target: int, shared: int, most: int) -> DataFrame:
    """One row: how many lengths are over each of three limits, their order statistics, and whether none is over ``most``.

    Null lengths are not counted; an empty table gives zeros and null statistics.
    """
    own = rows.select(tokens.cast("long").alias("n")).where("n is not null")
    counts = own.agg(
        F.count("*").alias("rows"), F.count_if(F.col("n") > target).alias("over_target"), F.count_if(F.col("n") > shared).alias("over_shared"), F.count_if(F.col("n") > most).alias("over_most"))
    ranks = nearest_ranks(own, "n", {"least": 0.0, "median": 0.5, "p95": 0.95, "p99": 0.99, "longest": 1.0})
    return counts.crossJoin(ranks).withColumn("passed", F.col("over_most") == 0)  # one row each


def canonical_digest(*columns: str) -> Column:
    """Digest of a row's canonical JSON: keys in order, no spaces, null fields kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
