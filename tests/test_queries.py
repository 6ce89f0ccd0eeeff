from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    """Rows with columns by name, sorted with numbers rounded; empty values are None."""
    frame = frame[sorted(frame.columns)].astype(object)
    clean = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=lambda r: [f"{v:.4f}" if isinstance(v, float) else str(v) for v in r])


@pytest.mark.parametrize("name", sorted(entry.audit.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for r, s in zip(a, b, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(r, s, strict=True)), (r, s)


@pytest.mark.parametrize("name", sorted(set(entry.audit.QUERIES) - set(entry.audit.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).columns == ["test_subject", "test_trial", "task", "fold", "single_class_share"]
