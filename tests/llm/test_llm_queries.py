"""Queries with SQL against it; the others run and keep their contracts."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexmill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    a, b = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    one = lambda v: "" if v is None or v is pd.NA or v != v else str(round(float(v), 6)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    key = lambda d: sorted(tuple(map(one, r)) for r in d[cols].itertuples(index=False))
    assert key(a) == key(b)


def test_classifiers_on_held_out_rows(spark):
    import pandas as pd

    d = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{d}/labels.parquet")
    for q, c, least in (("op1_toxicity", "toxic", 0.9), ("op2_quality", "quality", 0.9)):
        x = QUERIES[q](spark, d).toPandas()
        assert len(x) == 1000 and x.score.between(0, 1).all() and ((x.score >= 0.5) == (x.predicted == 1)).all()
        x = x[x.held_out].merge(labels, on="doc_id")
        assert (x.predicted == x[c]).mean() >= least
