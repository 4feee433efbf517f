"""An index of several token spaces that is kept current: batches of new, replaced and deleted documents, statistics as sums of changes.

Each batch is a generation of its own and is written once: its documents and where they lie, their postings in every space as
rows of a term and slab (see ``index``), and by how much they change the number of documents of each term and the corpus's
size and length. What a batch replaces is subtracted by reading the old rows of the slabs that held those documents. A search
counts only each document's last generation, so a merged index is the same as one built at once. A batch that is redone is
written over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import index
from lexmill.operators.audit import path_exists
from lexmill.operators.retrieval import top_k
from lexmill.session import durable, spread

_TABLES = {
    "docs": "id {id}, generation int, deleted boolean, slab long, place int, lengths map<string, int>",
    "postings": "generation int, space string, term string, slab long, df int, places array<smallint>, tfs array<int>, ids array<{id}>, dls array<array<int>>",
    "terms": "generation int, space string, term string, df long", "sizes": "generation int, space string, n long, length long"}
#: Slabs of which the replaced places, a bit a document, are broadcast.
SENT_SLABS = 1 << 16


def _read(spark: SparkSession, path: str, kind: str, id_type: str, before: int | None = None) -> DataFrame:
    """A table of all generations, or of those before one; only their folders are read."""
    schema = _TABLES[kind].format(id=id_type)
    rows = spark.read.schema(schema).parquet(f"{path}/{kind}") if path_exists(spark, f"{path}/{kind}") else spark.createDataFrame([], schema)
    return rows if before is None else rows.where(F.col("generation") < before)


def _last(docs: DataFrame) -> DataFrame:
    """``id, generation, slab, place, lengths`` of documents that are there: their last generation, if that is no deletion."""
    last = docs.groupBy("id").agg(F.max_by(F.struct("generation", "deleted", "slab", "place", "lengths"), "generation").alias("x"))
    return last.where("not x.deleted").select("id", "x.generation", "x.slab", "x.place", "x.lengths")


def _replaced(was: DataFrame, postings: DataFrame) -> DataFrame:
    """``space, term, d``: of each row of ``postings`` how many of its documents are in ``was``, as a negative number."""
    word, within = lambda place: F.shiftright(place, 6), lambda place: place.bitwiseAND(F.lit(63))
    one = F.expr("shiftleft(1L, place & 63)")
    sets = [F.bit_or(F.when(word(F.col("place")) == i, one).otherwise(F.lit(0).cast("long"))) for i in range(1 << index.SLAB_BITS >> 6)]
    gone = durable(was.groupBy("generation", "slab").agg(F.array(*sets).alias("gone")))
    gone = F.broadcast(gone) if gone.count() <= SENT_SLABS else gone
    rows = postings.where("term is not null").select("generation", "slab", "space", "term", "places").join(gone, ["generation", "slab"])
    hit = F.size(F.filter("places", lambda p: F.getbit(F.element_at("gone", word(p) + 1), within(p.cast("int"))) == 1))
    return rows.select("space", "term", (-hit).alias("d")).where("d <> 0")


def apply_batch(batch: DataFrame, spaces: dict[str, Column], path: str, generation: int, *, id_col: str = "doc_id", deleted: Column | None = None) -> None:
    """Write one generation: ``batch`` has each document once, as it is now; rows where ``deleted`` holds take theirs away.

    Token lists that are null are empty. Ids must be there and differ; that is checked before anything is written.
    """
    spark, id_type = batch.sparkSession, batch.schema[id_col].dataType.simpleString()
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    own = batch.select(F.col(id_col).alias("id"), gone.alias("deleted"))
    if own.groupBy("id").count().where("id is null or count > 1").limit(1).count():
        raise ValueError("a batch must hold each id once")
    put = lambda df, kind, *by: df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{kind}/generation={generation}")
    live = spread(batch).where(~gone).select(F.col(id_col).alias("id"), *(F.coalesce(c, F.array().cast("array<string>")).alias(s) for s, c in spaces.items()))
    rows = index.slab_rows(live, list(spaces), [1.0] * len(spaces), slab_bits=index.SLAB_BITS, range_bits=index.RANGE_BITS)  # bounds are not kept, as the mean length changes
    put(rows.select("space", "term", "slab", "df", "places", "tfs", "ids", "dls"), "postings", "space")
    new = _read(spark, path, "postings", id_type).where(F.col("generation") == generation)
    names = F.array(*map(F.lit, spaces))
    docs = new.where("space is null").select("slab", F.posexplode("ids").alias("place", "id"), "dls").select(
        "id", F.lit(False).alias("deleted"), "slab", "place", F.map_from_arrays(names, F.transform("dls", lambda x: F.element_at(x, F.col("place") + 1))).alias("lengths"))
    # what the batch's documents were before: where they lie in their last generation
    was = durable(_last(_read(spark, path, "docs", id_type, generation)).join(own.select("id"), "id", "left_semi"))
    old = _replaced(was, _read(spark, path, "postings", id_type, generation))
    changes = new.where("term is not null").select("space", "term", F.col("df").alias("d")).unionByName(old)
    put(changes.groupBy("space", "term").agg(F.sum("d").alias("df")).where("df <> 0"), "terms")
    # lengths: of new documents from their tokens, of old ones from what is stored with them
    size = lambda df, sign: df.select(F.explode(names).alias("space"), "lengths").select("space", F.lit(sign).alias("n"), (sign * F.coalesce(F.col("lengths")[F.col("space")], F.lit(0))).alias("length"))
    put(size(docs, 1).unionByName(size(was, -1)).groupBy("space").agg(F.sum("n").alias("n"), F.sum("length").alias("length")), "sizes")
    put(docs.unionByName(own.where("deleted"), allowMissingColumns=True), "docs")


def _of_slab(best, n_queries: int):
    """``best`` for a slab's documents (``place, id, dl``) that are there still and its rows; all queries are open."""
    width = 1 << index.SLAB_BITS

    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        place, dl, at = docs["place"].to_numpy(), np.full(width, -1), np.zeros(width, np.int64)
        dl[place], at[place] = docs["dl"].to_numpy(), np.arange(len(place))
        queries = np.arange(n_queries if len(place) else 0)
        return best(rows, docs["id"].combine_chunks().take(pa.array(at[: width if len(place) else 0])), dl, queries, np.full(len(queries), -np.inf))

    return run


def search(spark: SparkSession, path: str, space: str, queries: DataFrame, *, k: int, id_type: str = "bigint") -> DataFrame:
    """``query_id, id, rank, score``: BM25 of ``queries`` (``query_id, terms``) over the documents as they are after the last batch.

    A slab's documents that are there still and its rows of asked terms meet in one task, which keeps the best k of each query.
    """
    size = _read(spark, path, "sizes", id_type).where(F.col("space") == space).agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    n, mean = size.n or 0, (size.length or 0) / max(1, size.n or 0) or 1.0
    docs = _last(_read(spark, path, "docs", id_type)).select("generation", "slab", "place", "id", F.coalesce(F.col("lengths")[space], F.lit(0)).alias("dl"))
    found = None
    for block in index.query_blocks(queries, spark):
        changes = _read(spark, path, "terms", id_type).where(F.col("space") == space).join(block.terms, "term")
        block.weigh(changes.groupBy("t").agg(F.sum("df").alias("df")), n)
        rows = _read(spark, path, "postings", id_type).where(F.col("space") == space).join(block.terms, "term").select("generation", "slab", "t", "places", "tfs")
        best = index.best_of_slab(block, mean, k, range_bits=index.RANGE_BITS)
        got = docs.groupBy("generation", "slab").cogroup(rows.groupBy("generation", "slab")).applyInArrow(_of_slab(best, len(block.asked)), index.BEST.format(id=id_type))
        got = index.ranked(block, got)
        found = got if found is None else found.unionByName(got)
    return top_k(found, k).select("query_id", "id", "rank", "score")


def maintain(docs: DataFrame, spaces: dict[str, Column], path: str, checkpoint: str, *, id_col: str = "doc_id", order: str | None = None, deleted: Column | None = None) -> StreamingQuery:
    """Keep the index current from a stream: each micro-batch is the generation of its number; of rows of one id the last by ``order`` counts."""

    def merge(batch: DataFrame, number: int) -> None:
        last = batch if order is None else batch.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
        apply_batch(last, spaces, path, number, id_col=id_col, deleted=deleted)

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
