"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, rows_of

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, srows) == rows_of(dcols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, small_dir, name):
    assert QUERIES[name](spark, small_dir).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"vec_id", "rank", "label", "prob"}


def test_cleaning_only_strips_the_given_documents(spark, small_dir):
    """The token oracles start from the raw text: X1 must change no given document beyond its ends."""
    from pyspark.sql import functions as F

    from pairloom.functions import text as T
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert docs.where(T.basic_clean(F.col("text")) != T.strip(F.col("text"))).isEmpty()
