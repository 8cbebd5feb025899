"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from drawspark.plans import analysis, lottery  # noqa: F401  (both fill one list)

TABLES = ["orders"]


@pytest.fixture(scope="module")
def db(sf):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return made


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.7g}")
    return v


@pytest.mark.parametrize("q", [q for q in lottery.QUERIES if q.sql], ids=lambda q: q.name)
def test_query(spark, sf, db, q):
    result = db.execute(q.sql)
    cols = [c[0] for c in result.description]
    want = sorted(map(repr, (tuple(map(_plain, r)) for r in result.fetchall())))
    got = q.run(spark, sf)
    assert sorted(got.columns) == sorted(cols)
    rows = sorted(map(repr, (tuple(_plain(r[c]) for c in cols) for r in got.collect())))
    assert rows == want
