"""Each registered query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandlake import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def _text(v):
    if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return f"{float(v) + 0.0:.4f}"
    return str(v)


def _rows(df):
    return sorted(tuple(_text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, data_dir, name):
    got = queries.QUERIES[name](spark, data_dir).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows_only(spark, data_dir, name):
    assert queries.QUERIES[name](spark, data_dir).count() > 0
