import pytest
from pyspark.sql import types as P

DOCS = P.StructType([P.StructField(n, t) for n, t in (
    ("doc_id", P.LongType()), ("text", P.StringType()), ("lang", P.StringType()), ("source", P.StringType()), ("n_chars", P.LongType()))])
EXTRA = ("id", "rep", "component", "size", "key", "bucket", "run", "target", "shard", "score", "a", "b", "u", "v")


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts: with clashing extra columns."""
    def make(texts, sources=None, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        from pyspark.sql import functions as F
        return df.withColumns({c: F.lit("x") for c in EXTRA})
    return make
