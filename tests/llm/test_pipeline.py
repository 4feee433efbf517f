"""The pipeline's stages against what brute force says of their own inputs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import decontaminate, packing, toxicity
from lexmill.session import durable, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = durable(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    before = {r.doc_id: r.text for r in seen["minhash"].collect()}
    after = {r.doc_id for r in seen["decontamination"].collect()}

    def own(t):
        w = t.lower().split() if t.isascii() else t.translate({i: i + 32 for i in range(65, 91)}).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: own(t) for i, t in before.items()}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for _ in range(3):
        for a in ids:
            for b in ids:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert after == {i for i in ids if root[i] == i}
    index = decontaminate.Index([(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()], 5)
    clean = {r.doc_id for r in seen["decontamination"].collect() if not any(m >= 0.6 * n for _, m, n, _ in index.matches(r.text))}
    assert {r.doc_id for r in seen["mixing"].collect()} == clean
    weights = toxicity.train(seen["toxicity"], table(spark, SF, "labels"))
    kept = {r.doc_id for r in seen["toxicity"].collect() if toxicity.score_text(r.text, weights) < 0.5}
    assert set(before) == kept and len(kept) < seen["toxicity"].count()
    p = packing.PackParams()
    tok = packing.Tokenizer(open(p.tokenizer, "rb").read())
    want = sorted((r.doc_id, len(tok.encode(r.text or "")) + 1) for r in seen["packing"].collect())
    rows = docs.collect()
    parts = [(d, b - a, part) for r in rows for d, a, b, part in zip(r.doc_ids, r.cu_seqlens[:-1], r.cu_seqlens[1:], r.parts)]
    assert sum(n for _, n, _ in parts) == sum(n for _, n in want) and sorted(d for d, _, part in parts if part == 0) == [d for d, _ in want]
    for r in rows:  # each segment's ids are its text's, and the last one ends it
        line = np.frombuffer(r.ids, "<u2")
        assert r.n_tokens == r.cu_seqlens[-1] and (line[r.n_tokens :] == p.end_id).all()


def test_stages_judge_rows_without_ids(spark, tmp_path):
    """Toxic, copied and contaminated rows of a null id go as well."""
    own = table(spark, SF, "documents")
    bench = table(spark, SF, "benchmark").first().text
    clean = own.where("length(text) > 300").first().text
    rows = [(None, "you idiot moron loser scum trash pathetic stupid", "en", "s", 1), (None, clean, "en", "s", 1), (None, clean, "en", "s", 1), (None, bench + " " + bench, "en", "s", 1), (None, None, None, None, None)]
    spark.createDataFrame(rows, own.schema).write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    weights = toxicity.train(own, table(spark, SF, "labels"))
    assert toxicity.without_toxic(odd, weights).count() == 4
    assert corpus_pipeline.near_duplicate_stage(spark, odd, SF).count() == 4
    assert corpus_pipeline.decontamination_stage(spark, odd, SF).count() == 4
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    assert sorted(corpus_pipeline.decontamination_stage(spark, odd.withColumns({"id": F.lit(1), "item": F.lit(2)}), SF).columns) == sorted(corpus_pipeline.COLUMNS)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and len(corpus_pipeline.STAGES) == 5
