"""Each registered query of the engine's own operators against its DuckDB SQL."""

import duckdb
import pytest

from quillmill.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    for t in ("documents", "labels", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def rows(x):
    return sorted(([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x]), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    want = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = ", ".join(f'"{c}"' for c in df.columns)
    assert rows(map(tuple, df.collect())) == rows(want.project(order).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
