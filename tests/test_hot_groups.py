"""One group over many tasks: numbers, running values, spans, pairs, products, digests and resamples against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import audit, evaluation, ordered, retrieval, spans


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(rng.choice([1, 1, 1, 1, None, 2, 3]), rng.randrange(60), rng.choice("ab"), rng.choice([None, *range(9)])) for _ in range(900)]


KIND = "g int, o int, k string, v int"


def test_numbered(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    for n in (1, 7):
        got = ordered.numbered(df, "g", "o", "k", "v", chunks=n).orderBy("row").collect()
        assert [r.row for r in got] == list(range(900)) and [tuple(r)[:4] for r in got] == sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
    assert ordered.numbered(df.limit(0), "g").count() == 0


@pytest.mark.parametrize("own, backward", [(True, False), (False, False), (True, True), (False, True)])
def test_running(spark, rows, own, backward):
    chunks = ordered.in_chunks(spark.createDataFrame(rows, KIND), "g", "o", "k", "v", chunks=9)
    assert chunks.where("g = 1").select("chunk").distinct().count() > 3
    got = ordered.running(chunks, ["g"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "lo": ("min", F.col("v")), "near": ("near", F.col("v"))}, own=own, backward=backward)
    got = sorted(got.collect(), key=lambda r: (r.chunk, r.place))
    for i, r in enumerate(got):
        other = [x for x in (got[i + (not own):] if backward else got[: i + own]) if x.g == r.g and x.v is not None]
        values = [x.v for x in other]
        assert (r.s, r.m, r.lo) == (sum(values), max(values, default=None), min(values, default=None))
        assert r.near == (values[0 if backward else -1] if values else None)


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_spans_of_one_group(spark, monkeypatch, most):
    """By one window for each group, and with the large groups dealt over six tasks."""
    monkeypatch.setattr(ordered, "WINDOW_ROWS", most)
    chunks_of = ordered.in_chunks
    monkeypatch.setattr(ordered, "in_chunks", lambda df, *by: chunks_of(df, *by, chunks=6))
    rng = random.Random(9)
    own = [(1, s, s + rng.choice([0, 1, 5, 40])) for s in (rng.randrange(4000) for _ in range(400))] + [(2, 1, 5), (2, 5, 6), (2, 8, 9), (None, 1, 2), (None, 2, 3)]
    got = sorted((r.g or 0, r.start, r.end, r.parts) for r in spans.merge_spans(spark.createDataFrame(own, "g int, start int, end int"), group=["g"]).collect())
    want = []
    for g, s, e in sorted((g or 0, s, e) for g, s, e in own):
        if want and want[-1][0] == g and s <= want[-1][2]:
            want[-1] = (g, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
        else:
            want.append((g, s, e, 1))
    assert got == want

    turns = [(1, i, rng.choice("ab")) for i in range(300) if i % 17] + [(2, 0, "a")]
    got = {(r.g, r.o): r.block for r in spans.islands(spark.createDataFrame(turns, "g int, o int, k string"), group=["g"], order="o", same=["k"]).collect()}
    block, last = 0, None
    for g, o, k in turns:
        block = 1 if last is None or last[0] != g else block + (last[2] != k or last[1] + 1 != o)
        last = (g, o, k)
        assert got[g, o] == block

    left = [(rng.choice([1, 1, 2, None]), rng.choice([None, *range(100)]), i) for i in range(300)]
    right = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(100)]), i) for i in range(200)]
    got = {r.id: r.k for r in spans.as_of(spark.createDataFrame(left, "g int, at int, id int"), spark.createDataFrame(right, "g int, since int, k int"), group="g", at="at", start="since", keep=["k"]).collect()}
    for g, at, i in left:
        found = [(s, k) for h, s, k in right if g is not None and h == g and at is not None and s is not None and s <= at]
        assert got[i] == max(found, default=(None, None))[1]

    chunks = [(1, i, 10 * i, 10 * i + 10) for i in range(50)] + [(2, 0, 0, 5)]
    got = {(r.g, r.i): {x.kind: (x.start, x.end) for x in r.expansions} for r in spans.neighbours(spark.createDataFrame(chunks, "g int, i int, s int, e int"), group=["g"], order="i", start="s", end="e", id_col="i").collect()}
    assert got[1, 20] == {"whole_article": (0, 500), "both_neighbors": (190, 220), "previous": (190, 210), "next": (200, 220)}
    assert got[1, 0] == {"whole_article": (0, 500), "next": (0, 20)} and got[2, 0] == {}


@pytest.mark.parametrize("least", [0.8, 0.51, 0.5, 0.3])
def test_overlaps(spark, least):
    rng = random.Random(10)
    own = [(1, i, s, s + rng.choice([0, 1, 2, 3, 7, 8, 100, 1000])) for i, s in ((i, rng.randrange(-500, 3000)) for i in range(250))] + [(1, 5, 10, 20), (1, 5, 10, 20), (2, 0, 10, 20), (None, 1, 0, 9), (None, 2, 0, 9)]
    got = sorted((r.g, r.a, r.b, round(r.ratio, 9)) for r in spans.overlap_ratio(spark.createDataFrame(own, "g int, id int, start int, end int"), group="g", id_col="id", least=least).collect())
    want = []
    for i, (g, a, s1, e1) in enumerate(own):
        for h, b, s2, e2 in own:
            part = min(e1, e2) - max(s1, s2)
            if g is not None and g == h and a < b and part > 0 and part / min(e1 - s1, e2 - s2) >= least:
                want.append((g, a, b, round(part / min(e1 - s1, e2 - s2), 9)))
    assert got == sorted(want)


def test_overlaps_meet_no_more_than_they_must(spark):
    n = 20_000  # one group of spans that hardly overlap
    df = spark.range(n).select(F.lit(1).alias("g"), "id", (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 11).alias("end"))
    out = spans.overlap_ratio(df, group="g", id_col="id", least=0.05)
    assert out.count() == n - 1
    made = []

    def walk(p):
        if "Join" in p.nodeName():
            made.append(p.metrics().get("numOutputRows").get().value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    plan = out._jdf.queryExecution().executedPlan()
    out.collect()
    walk(plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan)
    assert not made or max(made) < 60 * n  # twenty points a span, a few cells each; all pairs would be 2e8


def test_block_product(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 5)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 3 = 0")
    got = sorted((r.query_id, r.rank, r.id, r.score) for r in retrieval.dense_top_k(df, asked, k=4, query_rows=30, vector_rows=40).collect())
    s = np.round(x @ x.T, 10)
    want = [(q, n + 1, i, s[q, i]) for q in range(0, 300, 3) for n, i in enumerate(sorted(range(300), key=lambda i: (-s[q, i], i))[:4])]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert retrieval.dense_top_k(df, asked.limit(0), k=4).count() == 0 and retrieval.dense_top_k(df, asked, k=500).count() == 100 * 300


def test_tree_digest(spark, monkeypatch):
    monkeypatch.setattr(audit, "TREE_WIDTH", 8)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = [f"t{i}" if i % 9 else None for i in range(200)]
    nodes = [sha(t) if t is not None else "" for t in texts]
    while True:
        nodes = [sha("\n".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        if len(nodes) == 1:
            break
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for parts in (1, 40):
        assert [tuple(r) for r in audit.tree_digest(df.repartition(parts), order="i", value=F.col("t")).collect()] == [(nodes[0], 200)]
    assert audit.tree_digest(df.limit(1), order="i", value=F.col("t")).count() == 1 and audit.tree_digest(df.limit(0), order="i", value=F.col("t")).count() == 0


def test_poisson_bootstrap(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(3, 2, 400), [1.5] * 50])
    df = spark.createDataFrame([(float(x), "a" if i % 2 else None) for i, x in enumerate(v)] + [(None, "a")], "v double, k string")
    one = evaluation.bootstrap_poisson(df.repartition(3), column="v", seed="s", iterations=2000).collect()[0]
    values, counts = np.unique(v, return_counts=True)
    w = np.array([evaluation.poisson_weights("s", x, int(n), 2000) for x, n in zip(values, counts)])
    means = np.sort((w * values[:, None]).sum(0) / w.sum(0))
    assert (one.low, one.high) == pytest.approx((means[int(0.025 * 1999)], means[int(0.975 * 1999)]))  # the seeded draws themselves
    plain = np.sort([rng.choice(v, len(v)).mean() for _ in range(4000)])
    width = plain[3900] - plain[100]
    assert abs(one.low - plain[100]) < 0.15 * width and abs(one.high - plain[3900]) < 0.15 * width  # and the plain bootstrap's interval
    again = evaluation.bootstrap_poisson(df.repartition(11), column="v", seed="s", iterations=2000).collect()[0]
    assert (again.low, again.high) == pytest.approx((one.low, one.high))
    by = {r.k: (r.low, r.high) for r in evaluation.bootstrap_poisson(df, column="v", seed="s", iterations=500, by=["k"]).collect()}
    assert set(by) == {"a", None} and all(lo < x < hi for (lo, hi), x in zip((by["a"], by[None]), (v[1::2].mean(), v[::2].mean())))
    assert evaluation.bootstrap_poisson(df.limit(0), column="v", seed="s").count() == 0


def test_rows_of_small_groups_are_dealt_by_their_number(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id % 500 as g", "id * 3 % 97 as start", "id * 3 % 97 + 2 as end")
    want = sorted(map(tuple, spans.merge_spans(rows, group=["g"]).collect()))
    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    assert ordered._dealt(rows, 4000, ["g"]).rdd.getNumPartitions() == 40
    assert sorted(map(tuple, spans.merge_spans(rows, group=["g"]).collect())) == want and len(want) > 500
