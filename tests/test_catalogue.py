"""Every query of the catalogue against its SQL in DuckDB."""
import math
import os

import duckdb
import pytest

from tessella.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([tuple(plain(row[columns.index(c)]) for c in df.columns) for row in got.fetchall()], key=repr)
    assert sorted([tuple(map(plain, row)) for row in df.collect()], key=repr) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
