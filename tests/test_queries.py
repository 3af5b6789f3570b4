"""Each registered graph query against the same question in SQL."""

import duckdb
import pandas as pd
import pytest

from arcweave.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    found = plans.queries()[name](spark, DATA).toPandas()
    if name in plans.oracle_sql():
        want = duck.execute(plans.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        assert len(found)
