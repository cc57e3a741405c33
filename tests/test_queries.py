"""Every registered query with SQL equals what DuckDB gives for that SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from siftwell.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(repr([clean(x.item() if hasattr(x, "item") else x) for x in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).fetchdf())
