"""Fusing and re-ordering ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_rrf(rankings: DataFrame, weights: dict[str, float], *, k: int = 60, top_k: int | None = None, best_rank_ties: bool = False) -> DataFrame:
    """``query_id, id, rank, fused_score, best_rank, branch_ranks`` from ``query_id, branch, id, rank``.

    Ties go by id, or by best rank and then id. An item twice in one branch is an error, as is an
    unknown branch; both are raised inside the plan.
    """
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    n = F.count("*").over(Window.partitionBy("query_id", "branch", "id"))
    checked = rankings.withColumn("n", n).select(
        "query_id", "branch", "id", F.when(F.col("n") > 1, F.raise_error(F.lit("an item is twice in one branch")).cast("int")).otherwise(F.col("rank")).alias("rank"))
    part = F.coalesce(F.try_element_at(w, "branch"), F.raise_error(F.lit("unknown branch")).cast("double")) / (k + F.col("rank"))
    fused = checked.groupBy("query_id", "id").agg(
        F.round(F.sum(part), 12).alias("fused_score"), F.min("rank").alias("best_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", "rank")))).alias("branch_ranks"))
    order = [F.desc("fused_score"), *(["best_rank"] if best_rank_ties else []), "id"]
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def rrf_grid(rankings: DataFrame, variants: dict[str, dict[str, float]], *, k: int = 60, top_k: int = 20) -> DataFrame:
    """The same rankings fused under several weightings in one pass: ``variant, query_id, id, rank, fused_score``."""
    v = rankings.sparkSession.createDataFrame([(n, b, float(w)) for n, ws in variants.items() for b, w in ws.items()], "variant string, branch string, weight double")
    fused = rankings.join(F.broadcast(v), "branch").groupBy("variant", "query_id", "id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 12).alias("fused_score"))
    w = Window.partitionBy("variant", "query_id").orderBy(F.desc("fused_score"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def diverse_top_k(ranked: DataFrame, keys: list[str], top_k: int) -> DataFrame:
    """First row of each (query, keys) by rank, then the others by rank; ``new_rank`` up to top_k."""
    first = F.row_number().over(Window.partitionBy("query_id", *keys).orderBy("rank")) == 1
    w = Window.partitionBy("query_id").orderBy(F.desc("is_first"), "rank")
    return ranked.withColumn("is_first", first).withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top_k)


def rerank(ranked: DataFrame, score: str, top_k: int) -> DataFrame:
    """Order by a given score (ties: old rank, id) with the old rank kept beside the new."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "rank", "id")
    return ranked.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top_k)


def article_rrf(rankings: DataFrame, block: str, weights: dict[str, float], *, k: int = 60, per_branch: int = 3, top_k: int = 10) -> DataFrame:
    """Blocks by the sum of their best ``per_branch`` ranks of each branch, with their best item (ties: its best rank, id).

    ``query_id, block, score, representative, representative_score, rank``.
    """
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    scored = rankings.withColumn("part", F.element_at(w, F.col("branch")) / (k + F.col("rank")))
    best = scored.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", block, "branch").orderBy("rank", "id"))).where(F.col("nth") <= per_branch)
    blocks = best.groupBy("query_id", F.col(block).alias("block")).agg(F.round(F.sum("part"), 12).alias("score"))
    items = scored.groupBy("query_id", F.col(block).alias("block"), "id").agg(F.round(F.sum("part"), 12).alias("s"), F.min("rank").alias("b"))
    top = items.groupBy("query_id", "block").agg(F.min(F.struct((-F.col("s")).alias("s"), "b", "id")).alias("r"))
    out = blocks.join(top, ["query_id", "block"]).select("query_id", "block", "score", F.col("r.id").alias("representative"), (-F.col("r.s")).alias("representative_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("representative_score"), "block")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def top_k_jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """Jaccard of each query's two id sets (both empty: 1): ``query_id, jaccard``."""
    sets = lambda d, n: d.groupBy("query_id").agg(F.collect_set("id").alias(n))
    j = sets(left, "a").join(sets(right, "b"), "query_id", "full_outer")
    a, b = (F.coalesce(c, F.array().cast("array<bigint>")) for c in ("a", "b"))
    u = F.size(F.array_union(a, b))
    return j.select("query_id", F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u).alias("jaccard"))


def fetch_in_order(requests: DataFrame, items: DataFrame, *, ids: str, key: str) -> DataFrame:
    """Rows of ``items`` for an array of keys, with the key's position; an unknown key is an error."""
    asked = requests.select("*", F.posexplode(ids).alias("position", "__key")).drop(ids)
    found = items.withColumn("__found", F.lit(True)).withColumnRenamed(key, "__key")
    out = asked.join(found, "__key", "left")
    return out.withColumn(key, F.when(F.col("__found"), F.col("__key")).otherwise(F.raise_error(F.concat(F.lit("unknown id "), F.col("__key").cast("string"))))).drop("__found", "__key")
