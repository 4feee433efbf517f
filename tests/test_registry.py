"""Registered queries against their SQL on the smallest tables, and the registry without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lexmill.operators import ordered
from lexmill.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v != v:
            return "None"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_odd_lines_merge_as_in_sql(spark, tmp_path, monkeypatch, most):
    """Null dates and quantities, parts of a piece, of a second and days before 1970; by windows, and with large orders dealt over tasks."""
    monkeypatch.setattr(ordered, "WINDOW_ROWS", most)
    con = duckdb.connect()
    con.execute("set threads = 1")  # with more the SQL's two windows may order twins differently
    con.execute(f"""copy (select l_orderkey // 50 as l_orderkey, case when n % 11 = 0 then null else l_shipdate - interval 9700 days + to_microseconds((l_quantity * 3600000000 - n % 2)::bigint) end as l_shipdate,
      case when n % 13 = 0 then null else l_quantity + n % 4 / 4 end as l_quantity from (select *, l_orderkey * 7 + l_linenumber as n from '{SF}/lineitem.parquet')) to '{tmp_path}/lineitem.parquet' (format parquet)""")
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet')")
    got, want = QUERIES["merge_spans"](spark, str(tmp_path)).toPandas(), con.execute(SQL["merge_spans"]).df()
    assert rows(got) == rows(want) and len(want) > 200


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_splits_see_public_and_warmup(spark, tmp_path):
    kind = "conv_id long, turn long, role string, text string"
    talks = {1: ("Open", "a"), 2: ("A  Public one", "b"), 11: ("Twice", "c"), 20: ("twice", "C"), 30: ("new", "d"), 40: ("a public ONE", "e"), 50: ("open", "other")}
    turns = [(i, n, r, t) for i, texts in talks.items() for n, (r, t) in enumerate(zip(("user", "assistant"), texts))]
    spark.createDataFrame(turns, kind).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "a public one"), (2, "other")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.question_id: (r.status, r.split is not None) for r in QUERIES["leakage_safe_splits"](spark, str(tmp_path)).collect()}
    assert got == {
        "1-0": ("kept", True), "2-0": ("quarantine", False), "11-0": ("kept", True), "20-0": ("alias", False), "30-0": ("kept", True), "40-0": ("quarantine", False),
        "50-0": ("conflict", False)}


def test_bootstrap_takes_all_deltas(spark, tmp_path):
    labels = [(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(900)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, "x", "en") for i in range(900)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    d = pd.Series([1 - t - q for _, q, t in labels], dtype=float)
    r = QUERIES["bootstrap_delta"](spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].improved, r[0].worsened, r[0].tied) == ((d > 0).sum(), (d < 0).sum(), (d == 0).sum())
    wide = 1.96 * d.std() / len(d) ** 0.5
    assert r[0].mean_delta == pytest.approx(d.mean()) and not r[0].promoted
    assert (r[0].low, r[0].high) == pytest.approx((d.mean() - wide, d.mean() + wide), abs=0.1 * wide)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_llm(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/lexmill", tmp_path / "lexmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and 'pipeline' not in e.queries() and not set(e.oracle_sql()) - set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
