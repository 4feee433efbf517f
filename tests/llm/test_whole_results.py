"""Nothing is lost: article text with odd attributes, rows of repeated and null ids in shards, links among rare duplicates."""

import logging
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import embeddings, html, sharding


@pytest.mark.parametrize("opened", [
    '<p title="the hidden truth">', '<p data-hidden="false">', '<p data-id="sidebar">', '<p data-class="x ad y">', "<p onclick=\"toggle('hidden')\">", "<p title='a class=ad b'>",
    '<div class="related">', '<p id="share">', '<p xclass=ad>', '<p aria-hidden="false">'])
def test_article_keeps_parts_with_odd_attributes(opened):
    page = f"<article><h1>A</h1><p>{'word ' * 30}</p>{opened}kept text</article>"
    assert html.main_text(page).endswith("\nkept text")


@pytest.mark.parametrize("opened", ['<div hidden>', "<div HIDDEN=''>", '<div class="ad">', "<div id=comments>", '<div style="color:red; display : none">', '<div role=navigation>', '<div aria-hidden="true">', '<div data-x="1" class=advert>'])
def test_article_drops_what_is_marked(opened):
    assert "gone" not in html.main_text(f"<article><h1>A</h1><p>{'word ' * 30}</p>{opened}gone</div></article>")


def test_write_shards_writes_every_row(spark, docs, tmp_path):
    rng = random.Random(5)
    texts = ["x" * rng.choice([0, 1, 50, 100, 119]) for _ in range(80)] + ["y" * 100] * 3 + [None, "", "z" * 100, "z" * 100, "long" * 100]
    ids = [*range(80), 7, 7, 7, None, None, None, None, 500]
    sharding.write_shards(docs(texts, ids=ids).withColumn("key", F.lit(1)), f"{tmp_path}/s", limit_bytes=120)
    back = spark.read.option("basePath", f"{tmp_path}/s").parquet(f"{tmp_path}/s").withColumn("shard", F.col("shard").cast("string"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(zip(ids, texts))
    for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count("*").alias("n")).collect():
        assert r.b <= 120 or r.n == 1
    sharding.write_shards(docs([]), f"{tmp_path}/e", limit_bytes=120)


def planted(n, pairs, seed):
    """Vectors of 24 numbers far from each other, and pairs just over the threshold among them."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(pairs):
        other = rng.normal(size=24)
        other -= other @ x[i] * x[i]
        c = rng.uniform(0.932, 0.95)
        x[n - 1 - i] = c * x[i] + np.sqrt(1 - c * c) * other / np.linalg.norm(other)
    return x


@pytest.mark.parametrize("kind", ["rare", "dense"])
def test_recall_where_links_exist(spark, kind):
    if kind == "rare":
        x = planted(1500, 30, 1)
    else:  # a tight cluster whose vectors link with many, and loose ones around it
        rng = np.random.default_rng(2)
        x = np.concatenate([1 + 0.25 * rng.normal(size=(150, 24)), rng.normal(size=(400, 24))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.embedding_duplicates(df).collect()}
    assert all(got[i] <= true[i] for i in range(len(x))) and true.sum() >= 60
    assert sum(got.values()) >= 0.9 * true.sum()


def test_audit_says_when_there_was_nothing_to_find(spark, caplog):
    df = spark.createDataFrame([(i, np.eye(8)[i].tolist(), 1) for i in range(8)], "vec_id long, embedding array<double>, label int")
    with caplog.at_level(logging.WARNING, logger="lexmill.llm.embeddings"):
        assert all(r.n_links == 0 for r in embeddings.embedding_duplicates(df).collect())
    assert "recall is unknown" in caplog.text
