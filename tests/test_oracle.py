"""Every query of the library proper against its SQL, over the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loadflow.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = df.select(*[F.col(f"`{c}`") for c in cols]).collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    assert types == {c: TYPES.get(t, t.upper()) for c, t in df.dtypes}
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()]
    assert sorted([tuple(map(plain, r)) for r in rows], key=str) == sorted(want, key=str)
