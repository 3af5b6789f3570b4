import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) as documents; other columns of any name may be added."""

    def make(rows, **more):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        from pyspark.sql import functions as F

        return df.withColumns({k: F.lit(v) for k, v in more.items()})

    return make


@pytest.fixture
def vectors(spark):
    def make(rows, **more):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        return df.withColumns({k: F.lit(v) for k, v in more.items()})

    return make


#: Columns whose names clash with what the operators use inside.
CLASH = {"id": 1, "n": 2, "key": "k", "run": 3, "size": 4, "batch": 5, "part": 6, "cell": 7, "score": 0.5, "rank": 9, "of": 1, "first": 2, "label_": 1}
