from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidefold.llm import queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    clean = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v
    return sorted((tuple(map(clean, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for r, s in zip(a, b, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6 * max(1, abs(y))) for x, y in zip(r, s, strict=True)), (r, s)
