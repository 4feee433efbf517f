"""The archive source, the resumable vector shards and the saved index, with what they must refuse and how they go on after a failure."""

import io
import json
import math
import os
import random
import zipfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import index, retrieval, upkeep
from lexmill.sources import archives, contexts, shards, sinks

GOOD = '{"id": %d, "link": "https://x.y/z", "passage": "p %s"}'


def archive(path, entries, **how):
    with zipfile.ZipFile(path, "w", **how) as z:
        for name, data in entries:
            z.writestr(name, data)
    return str(path)


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    entries = [(f"d{i % 3}/context_{i}.json", GOOD % (i, "x" * i)) for i in range(200)]
    path = archive(tmp_path / "a.zip", [*entries, ("d0/", "")], compression=zipfile.ZIP_DEFLATED)
    archives.register(spark)
    raw = spark.read.format("context_zip").option("tasks", 4).load(path)
    assert raw.rdd.getNumPartitions() == 4
    assert {r.source_name: bytes(r.content) for r in raw.collect()} == {n.rpartition("/")[2]: t.encode() for n, t in entries}
    per_task = raw.groupBy(F.spark_partition_id()).agg(F.min("source_name").alias("lo"), F.max("source_name").alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
    assert len(per_task) == 4 and all(a.hi < b.lo for a, b in zip(per_task, per_task[1:])) and min(r.n for r in per_task) > 20
    docs = contexts.read_contexts(spark, path, tasks=4)
    assert {(r.document_id, r.raw_text) for r in docs.collect()} == {(str(i), "p " + "x" * i) for i in range(200)}
    assert contexts.archive_identity(path)[1] == 200
    spark.createDataFrame([(1,)], "x int")  # a second archive and plain files beside it
    archive(tmp_path / "b.zip", [("context_900.json", GOOD % (900, ""))])
    (tmp_path / "context_901.json").write_text(GOOD % (901, ""))
    assert contexts.read_contexts(spark, str(tmp_path)).count() == 202
    archive(tmp_path / "c.zip", [("context_901.json", GOOD % (901, ""))])
    with pytest.raises(Exception, match="id twice"):
        contexts.read_contexts(spark, str(tmp_path)).collect()
    assert contexts.read_contexts(spark, archive(tmp_path / "empty.zip", [])).count() == 0


@pytest.mark.parametrize("name, match", [("../context_1.json", "unsafe"), ("/context_1.json", "unsafe"), ("x/note.txt", "foreign"), ("b/context_7.json", "repeated")])
def test_archive_refuses_members(spark, tmp_path, name, match):
    archives.register(spark)
    path = archive(tmp_path / "a.zip", [("a/context_7.json", "{}"), (name, "{}")])
    with pytest.raises(Exception, match=match):
        spark.read.format("context_zip").load(path).collect()


def test_archive_refuses_links_encryption_and_damage(spark, tmp_path):
    archives.register(spark)
    load = lambda p: spark.read.format("context_zip").load(str(p)).collect()
    link = zipfile.ZipInfo("context_1.json")
    link.external_attr = 0o120777 << 16
    with pytest.raises(Exception, match="linked"):
        load(archive(tmp_path / "l.zip", [(link, "x")]))
    path = archive(tmp_path / "e.zip", [("context_1.json", GOOD % (1, "y" * 50))])
    data = bytearray(open(path, "rb").read())
    at = data.rindex(b"PK\x01\x02")
    data[at + 8] |= 1
    (tmp_path / "e2.zip").write_bytes(data)
    with pytest.raises(Exception, match="encrypted"):
        load(tmp_path / "e2.zip")
    data[at + 8] &= 0xFE
    data[data.index(b"yyy")] = 0x7A
    (tmp_path / "e3.zip").write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        load(tmp_path / "e3.zip")
    for bad in ('{"id": 1, "id": 1, "link": "https://x.y", "passage": "p"}', '[1]', '{"id": 2, "link": "https://x.y", "passage": "p"}'):
        with pytest.raises(Exception, match="twice|object|holds id"):
            contexts.read_contexts(spark, archive(tmp_path / "j.zip", [("context_1.json", bad)])).collect()


def encode(calls=None):
    def run(rows):
        def vectors(batches):
            for pdf in batches:
                yield pdf.assign(embedding=[np.full(3, len(t), np.float32) for t in pdf["text"]])[["id", "shard", "place", "embedding"]]

        if calls is not None:
            calls.append(sorted(r.shard for r in rows.select("shard").distinct().collect()))
        return rows.select("id", "shard", "place", "text").mapInPandas(vectors, "id string, shard int, place long, embedding array<float>")

    return run


def test_a_killed_write_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(95)], "doc long, text string").repartition(7)
    path, how = f"{tmp_path}/v", {"id_col": "doc", "dimension": 3, "shard_rows": 10}
    calls = []
    with pytest.raises(Exception, match="fails, as asked"):
        shards.write_vector_shards(rows, encode(calls), path, fail_on=6, **how)
    done = set(shards.records(path))
    assert 6 not in done and not os.path.exists(f"{path}/manifest.json")
    with pytest.raises(Exception, match="not all shards"):
        shards.read_vector_shards(spark, path).collect()
    before = {n: os.stat(f"{path}/vectors-{n:05d}.npy").st_mtime_ns for n in done}
    assert shards.write_vector_shards(rows, encode(calls), path, **how) == 10 - len(done)
    assert calls[1] == sorted(set(range(10)) - done)  # the model sees only what is missing
    assert before == {n: os.stat(f"{path}/vectors-{n:05d}.npy").st_mtime_ns for n in done}
    assert shards.write_vector_shards(rows, encode(), path, **how) == 0
    got = {r.id: list(r.embedding) for r in shards.read_vector_shards(spark, path).collect()}
    assert got == {str(i): [float(i % 7)] * 3 for i in range(95)}
    ids = [json.loads(x) for n in range(10) for x in open(f"{path}/ids-{n:05d}.jsonl")]
    assert ids == sorted(str(i) for i in range(95))
    with pytest.raises(ValueError, match="holds other ids"):
        shards.write_vector_shards(rows.where("doc <> 5"), encode(), path, **how)
    with open(f"{path}/vectors-00003.npy", "r+b") as f:
        f.seek(-1, 2)
        f.write(b"\x00\x01")
    with pytest.raises(Exception, match="checksum"):
        shards.read_vector_shards(spark, path).collect()


def test_shards_refuse_bad_rows(spark, tmp_path):
    how = {"id_col": "doc", "shard_rows": 10}
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "doc long, text string")
    with pytest.raises(ValueError, match="differ"):
        shards.write_vector_shards(rows, encode(), f"{tmp_path}/a", dimension=3, **how)
    with pytest.raises(Exception, match="another dimension"):
        shards.write_vector_shards(rows.limit(1), encode(), f"{tmp_path}/b", dimension=4, **how)
    assert shards.write_vector_shards(rows.limit(0), encode(), f"{tmp_path}/c", dimension=3, **how) == 0
    assert shards.read_vector_shards(spark, f"{tmp_path}/c").count() == 0


@pytest.mark.parametrize("pairs", [False, True])
def test_saved_index_skips_blocks_and_loses_nothing(spark, tmp_path, monkeypatch, pairs):
    monkeypatch.setattr(index, "SEED_RANGES", 2)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=rng.choice([3, 40]))) for _ in range(1500)]
    for i in range(0, 1500, 300):
        texts[i] = "w250 w251 w252 w0"
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "w250 w0"), (7, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(0, "w250 w251 w0"), (1, "w0"), (2, "w299 w1 w298 w1"), (3, "none"), (4, ""), (5, "w251 w252")], "item_id long, text string")
    tokens, query = T.word_list(F.col("text")), T.query_tokens(F.col("text"))
    index.write_blocks(docs, tokens, f"{tmp_path}/i", buckets=8, slab_bits=7, range_bits=4)
    found = index.Index(spark, f"{tmp_path}/i", asked.select(F.col("item_id").alias("query_id"), query.alias("terms")), pairs=pairs)
    best, took = found.search(5)
    want = retrieval.bm25(docs.where("doc_id is not null or text = ''"), asked, doc_tokens=tokens, query_tokens=query, k=5, pairs=pairs)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want.collect()))
    took = {r.query_id: (r.blocks, r.blocks_read) for r in took.collect()}
    assert all(read <= all_ for all_, read in took.values()) and took[0][1] < 0.8 * took[0][0]
    plan = found.read("blocks")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def long_queries(spark):
    """Documents and queries of many common words, and all rows of the two-term search: exact sums, halves away from zero."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    texts = [rng.choices(words, k=rng.choice([80, 120, 200])) for _ in range(300)]
    texts[7], asked = texts[250], {q: rng.sample(words, 1000) for q in range(8)}
    mean, held = sum(map(len, texts)) / 300, [Counter(t) for t in texts]
    df = Counter(w for t in held for w in t)
    idf = {w: max(math.log((300 - n + 0.5) / (n + 0.5)), 1e-6) for w, n in df.items()}
    want = []
    for q, terms in asked.items():
        found = []
        for i, t in enumerate(held):
            parts = [idf[w] * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * len(texts[i]) / mean)) for w in terms if w in t]
            y = math.fsum(parts) * (len(parts) - 1) * 1e10
            found.append((-(math.floor(y) + (y - math.floor(y) >= 0.5)) / 1e10, i))
        want += [(q, i, n, -s) for n, (s, i) in enumerate(sorted(found), 1)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "item_id long, text string"), want


def test_scores_of_long_queries(spark):
    docs, asked, want = long_queries(spark)
    got = retrieval.bm25(docs, asked, doc_tokens=T.word_list(F.col("text")), query_tokens=T.query_tokens(F.col("text")), k=300, pairs=True)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 2400


def test_ten_decimals_are_those_of_sql():
    x = np.random.default_rng(2).uniform(-16384, 16384, 20_000)
    sql = [r[0] for r in duckdb.connect().execute("select round(unnest(?::double[]), 10)", [x.tolist()]).fetchall()]
    assert retrieval.ten_decimals(x).tolist() == sql


def test_saved_index_scores_long_queries(spark, tmp_path):
    docs, asked, want = long_queries(spark)
    index.write_blocks(docs, T.word_list(F.col("text")), f"{tmp_path}/i", slab_bits=6)
    asked = asked.select(F.col("item_id").alias("query_id"), T.query_tokens(F.col("text")).alias("terms"))
    assert sorted(map(tuple, index.Index(spark, f"{tmp_path}/i", asked, pairs=True).search(300)[0].collect())) == sorted(want)


def shuffled(spark):
    """Bytes that all stages so far wrote for shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def words_of_documents(spark, n=2000):
    """Documents of 100 words out of 400, and 20 queries of 30 of these."""
    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=100))) for i in range(n)], "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame([(q, rng.sample(words, 30)) for q in range(20)], "query_id long, terms array<string>")


def test_saved_index_shuffles_short_rows_once(spark, tmp_path):
    docs, asked = words_of_documents(spark)
    docs.write.parquet(f"{tmp_path}/docs")
    docs, before = spark.read.parquet(f"{tmp_path}/docs"), shuffled(spark)
    index.write_blocks(docs, T.word_list(F.col("text")), f"{tmp_path}/i")
    assert index.Index(spark, f"{tmp_path}/i", asked).search(5)[0].count() == 100
    assert shuffled(spark) - before < 3_000_000  # before, 20 bytes a posting, and those asked for again for each join


def test_counters_of_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "x" * i) for i in range(20)], "i int, t string").repartition(3)
    how = {"rows": F.count("*"), "texts": F.count("t"), "longest": F.max(F.length("t"))}
    assert sinks.write_counted(df, f"{tmp_path}/a", how, bounds={"rows": (20, 20), "longest": (None, 19)}) == {"rows": 20, "texts": 15, "longest": 19}
    assert spark.read.parquet(f"{tmp_path}/a").count() == 20
    with pytest.raises(ValueError, match="out of bounds.*texts"):
        sinks.write_counted(df, f"{tmp_path}/b", how, bounds={"texts": (16, None)})
    assert not os.path.exists(f"{tmp_path}/b")
    with pytest.raises(ValueError, match="longest"):
        sinks.write_counted(df.limit(0), f"{tmp_path}/c", how, bounds={"longest": (None, 5)})


def test_batches_equal_one_build(spark, tmp_path):
    spaces = {"word": T.word_list(F.col("text")), "folded": F.regexp_extract_all(T.fold_accents(F.col("text")), F.lit(T.WORDS), F.lit(0))}
    kind = "doc_id long, text string, gone boolean"
    batches = [
        [(1, "Điều một hai", None), (2, "ba ba bốn", None), (3, None, None), (4, "cũ cũ cũ", None), (5, "một", None)],
        [(4, "mới một một", False), (2, None, True), (9, None, True), (6, "dieu ba", None)],
        [(2, "ba lại", None), (5, "", None), (6, "dieu ba bon", None)]]
    path = f"{tmp_path}/i"
    for n, b in enumerate(batches):
        upkeep.apply_batch(spark.createDataFrame(b, kind), spaces, path, n, deleted=F.col("gone"))
    upkeep.apply_batch(spark.createDataFrame(batches[2], kind), spaces, path, 2, deleted=F.col("gone"))  # redone
    now = spark.createDataFrame([(1, "Điều một hai"), (2, "ba lại"), (3, ""), (4, "mới một một"), (5, ""), (6, "dieu ba bon")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "một ba"), (2, "điều"), (3, "dieu cũ"), (4, "bốn")], "item_id long, text string")
    for space, query in (("word", T.query_tokens(F.col("text"))), ("folded", T.folded_tokens(F.col("text")))):
        got = upkeep.search(spark, path, space, asked.select(F.col("item_id").alias("query_id"), query.alias("terms")), k=5)
        want = retrieval.bm25(now, asked, doc_tokens=spaces[space], query_tokens=query, k=5)
        assert sorted((r.query_id, r.id, r.rank, r.score) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    with pytest.raises(ValueError, match="each id once"):
        upkeep.apply_batch(spark.createDataFrame([(1, "a", None), (1, "b", None)], kind), spaces, path, 3)


def test_batches_shuffle_counts_and_asked_rows(spark, tmp_path):
    docs, asked = words_of_documents(spark)
    docs.write.parquet(f"{tmp_path}/docs")
    docs, path, before = spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/i", shuffled(spark)
    spaces = {"word": T.word_list(F.col("text")), "upper": T.word_list(F.upper("text"))}
    third = F.col("doc_id") % 3 == 0
    upkeep.apply_batch(docs.withColumn("text", F.when(third, F.lit("word1 word2 none")).otherwise(F.col("text"))), spaces, path, 0)
    upkeep.apply_batch(docs.where(third), spaces, path, 1, deleted=F.col("doc_id") == 999)
    got = upkeep.search(spark, path, "word", asked, k=5).collect()
    assert shuffled(spark) - before < 2_500_000  # before, a row a posting, shuffled by document and then by term
    want = retrieval.bm25(docs.where("doc_id <> 999"), asked.withColumnRenamed("query_id", "item_id"), doc_tokens=spaces["word"], query_tokens=F.col("terms"), k=5)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_a_stream_keeps_the_index(spark, tmp_path):
    for n, rows in enumerate([[(1, 1, "a b"), (2, 1, "b")], [(1, 2, "c"), (1, 3, "b b")]]):
        spark.createDataFrame(rows, "doc_id long, seq int, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("doc_id long, seq int, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    upkeep.maintain(stream, {"word": T.word_list(F.col("text"))}, f"{tmp_path}/i", f"{tmp_path}/c", order="seq").awaitTermination()
    asked = spark.createDataFrame([(1, ["b"]), (2, ["a"])], "query_id long, terms array<string>")
    got = {(r.query_id, r.id) for r in upkeep.search(spark, f"{tmp_path}/i", "word", asked, k=5).collect()}
    assert got == {(1, 1), (1, 2)}
