"""MinHash near-duplicates: fast similarity sketches, banding, and verification on full sets."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.graph import components
from lexmill.llm.shingles import bands as band_keys
from lexmill.llm.shingles import fast_sketch, linked, shingles
from lexmill.session import durable

#: Buckets up to this size have all pairs verified at once; larger ones go through pivots first.
SMALL_BUCKET = 12
#: Shingles that one residual task holds at most, but for a single pair of documents.
BLOCK_SHINGLES = 1_500_000


def _features(n: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"]):
                s = shingles(text, n)
                if len(s):
                    out.append((i, len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(fast_sketch(s, bands * rows), rows)))
                else:
                    out.append((i, 0, None, None))
            yield pd.DataFrame(out, columns=["id", "n_shingles", "digest", "bands"]).astype({"id": "Int64"})

    return run


def _verify(n: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            last, left, keep = None, None, []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                if left is None or (a, ta) != last:
                    last, left = (a, ta), shingles(ta, n)
                keep.append(linked(left, shingles(tb, n), percent))
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _residual(n: int, percent: int):
    """Links that join components inside one block of a bucket; stops looking once two are one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, n) for t in pdf["text"]]
        ids = pdf["id"].tolist()
        parts: dict[int, list[int]] = defaultdict(list)
        for k, c in enumerate(pdf["component"]):
            parts[c].append(k)
        groups = sorted(parts.values(), key=len)
        links = []
        while groups:
            mine = groups.pop(0)
            for other in groups:
                hit = next(((x, y) for x in mine for y in other if linked(sets[x], sets[y], percent)), None)
                if hit:
                    links.append((ids[hit[0]], ids[hit[1]]))
                    other.extend(mine)
                    groups.sort(key=len)
                    break
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bands: int = 24, rows: int = 5
) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, kept``.

    Documents link when ``100 * |A and B| >= percent * |A or B|`` over sets of n-word shingles
    (A-Z lowered); component_id is the least id reachable by links. Each document gets a fast
    similarity sketch of ``bands * rows`` coordinates. Equal sets are folded into one class before
    anything is joined. Classes that share a band are candidates: small buckets give all their
    pairs, large ones a pair of each member with one pivot; texts are joined and full sets compared.
    Large buckets that still hold more than one component are then compared across components, in
    blocks with a bound on the shingles they hold, so no candidate is dropped and no group's pairs are emitted.

    A link at the threshold itself is missed with probability (1 - t^rows)^bands: 7e-5 for
    (24, 5) at 0.8 and 8e-5 for (20, 6) at 0.85; links above it less. Null and blank texts have no
    shingles and link with nothing; null ids link with nothing and have a null component; rows
    that repeat an id count as one document that links where any of its texts does (a blank one
    of them stays alone). Shingles are
    compared by 64-bit hash. Other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    feats = durable(own.mapInPandas(_features(n, bands, rows), "id long, n_shingles long, digest binary, bands array<long>"))
    classes = (
        feats.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
        .groupBy("digest").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"))
    )
    pieces = classes.select("rep", F.explode("bands").alias("bucket"))
    sizes = pieces.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min(F.struct(F.xxhash64("rep", "bucket").alias("h"), "rep"))["rep"].alias("pivot")
    ).where("size > 1")
    members = durable(pieces.join(sizes, "bucket").select("bucket", "rep", "size", "pivot"))
    small = (
        members.where(F.col("size") <= SMALL_BUCKET).groupBy("bucket").agg(F.array_sort(F.collect_set("rep")).alias("m"))
        .select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b))))")).alias("p"))
        .select("p.a", "p.b")
    )
    stars = members.where((F.col("size") > SMALL_BUCKET) & (F.col("rep") != F.col("pivot"))).select(
        F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")
    )
    pairs = small.unionByName(stars).distinct()
    texts = own.where(F.col("id").isNotNull())
    judged = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
    )
    twice = feats.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(
        F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id")
    twice = feats.join(twice, "id").join(classes.select("digest", "rep"), "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = durable(judged.mapInPandas(_verify(n, percent), "a long, b long").unionByName(twice).distinct())
    comp = durable(components(links))

    open_ = members.where(F.col("size") > SMALL_BUCKET).join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("component")
    )
    mixed = open_.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    open_ = durable(open_.join(mixed, "bucket"))
    if not open_.isEmpty():
        weight = feats.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("rep")).agg(F.max("n_shingles").alias("w"))
        open_ = open_.join(weight, "rep")
        blocks = open_.groupBy("bucket").agg(F.ceil(F.sum("w") * 2 / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
        open_ = open_.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = open_.select(
            "bucket", F.col("rep").alias("id"), "component",
            F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))).alias("block"),
        )
        more = (
            dealt.join(texts, "id").groupBy("bucket", "block").applyInPandas(
                lambda pdf: _residual(n, percent)(pdf), "a long, b long")
        )
        comp = durable(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))

    by_class = classes.select("digest", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("of_class")
    )
    rows_ = feats.select("id", "n_shingles", "digest").join(by_class, "digest", "left").select(
        "id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("of_class", "id")).alias("component_id")
    )
    return rows_.select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of near duplicates, the one of the least id (null ids last), all columns as they are.

    Rows are told apart by a number of their own and not by their ids, so rows of a null or repeated id are judged by
    their texts like others. The numbers are places in the table as it is stored, alike at each reading; give a table
    that was written or checkpointed. Rows without words are no duplicates and stay.
    """
    own = docs.withColumn("__row", F.monotonically_increasing_id())
    groups = near_duplicates(own.select(F.col("__row").alias("row"), F.col(text_col).alias("text")), id_col="row", text_col="text", **how)
    named = groups.select(F.col("row").alias("__row"), "component_id").join(own.select("__row", F.col(id_col).alias("id")), "__row")
    least = F.min_by("__row", F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("__row")))
    keep = named.groupBy("component_id").agg(least.alias("__row")).select("__row")
    return own.join(keep, "__row", "left_semi").select(*docs.columns)
