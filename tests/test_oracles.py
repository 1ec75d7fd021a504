"""Every query with a DuckDB counterpart against it, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from quillstone.plans import registry

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 5) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in place) for r in found.fetchall())
    spark.catalog.clearCache()


#: Queries of fitted models and the table of their rows.
SCORED = {"copula_llr": "embeddings", "gbt_scores": "orders", "mixture_components": "orders", "ranker": "orders"}


@pytest.mark.parametrize("name", sorted(SCORED))
def test_models_score_each_row_once_out_of_fold(spark, name):
    rows = registry.QUERIES[name](spark, DIR).collect()
    assert len({r.id for r in rows}) == len(rows) > 0 and {r.fold for r in rows} == set(range(3))
    values = [v for r in rows for v in r if isinstance(v, float)]
    assert values and all(math.isfinite(v) for v in values)
    assert len(rows) <= spark.read.parquet(f"{DIR}/{SCORED[name]}.parquet").count()


def test_entry_gives_the_flagship(spark):
    assert entry_point.entry(spark).count() == 10


def test_every_oracle_has_its_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_names_can_be_read_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=os.path.dirname(entry_point.__file__))
    assert said.returncode == 0, said.stderr
