"""Every registered query of the catalog against its SQL on DuckDB."""

import math

import duckdb
import pytest
from flowscope.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return "nan" if isinstance(x, float) and math.isnan(x) else str(round(float(x), 5) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, tiny, name):
    got = catalog.queries()[name](spark, tiny)
    rows = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = con.sql(sql)
        assert sorted(want.columns) == sorted(got.columns)
        cols = [want.columns.index(c) for c in sorted(want.columns)]
        assert rows == sorted(tuple(plain(r[i]) for i in cols) for r in want.fetchall())


def test_no_nested_loop_in_joins_on_intervals(spark, tiny):
    for name in ("event_slice_candidates", "asof_click", "nearest_view", "overlapping_boxes"):
        plan = catalog.queries()[name](spark, tiny)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_only_what_is_needed(spark, tiny):
    plan = catalog.queries()["interaction_types"](spark, tiny)._jdf.queryExecution().toString()
    assert "props" not in plan.split("ReadSchema")[-1]
