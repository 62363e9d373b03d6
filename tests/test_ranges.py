"""Joins and rates by ranges against their forms by session, with one session that has most rows."""

import random

import pytest
from flowscope.operators import buffer as bf
from flowscope.operators import joins, ranges
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.randrange(400), rng.choice("lr"), i % 7) for i in range(900)]
    data += [(4, 1000 + i, 5, "l", i) for i in range(20)] + [(5, 2000, 9, "r", 1)] + [(6, 3000 + i, i, "lr"[i == 0], 0) for i in range(60)]
    return spark.createDataFrame(data, "session long, pos long, ts_ms long, side string, x long").cache()


@pytest.mark.parametrize("n", [1, 3, 16])
def test_joins_equal_those_by_session(rows, n):
    left, right = rows.filter("side = 'l'").drop("side"), rows.filter("side = 'r'").drop("side")
    as_set = lambda df: sorted(map(str, df.collect()))
    a = (["session"], "ts_ms", "ts_ms", ["pos", "x"], "pos")
    known = left.filter("session is not null")
    assert as_set(ranges.asof_join(known, right, *a, ranges=n)) == as_set(joins.asof_join(known, right.filter("session is not null"), *a))
    b = (["session"], "ts_ms", "ts_ms", "pos", "pos")
    assert as_set(ranges.nearest_join(known, right, *b, ranges=n)) == as_set(joins.nearest_join(known, right.filter("session is not null"), *b))
    assert ranges.asof_join(left, right, *a, ranges=n).count() == left.count()


@pytest.mark.parametrize("n", [1, 5])
def test_rates_equal_those_by_session(rows, n):
    some = rows.filter("session is not null")
    cols = ["session", "pos", "fps", "peak"]
    assert sorted(map(str, ranges.rates(some, n).select(cols).collect())) == sorted(map(str, bf.rates(some).select(cols).collect()))


def test_one_session_uses_all_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("session"), F.col("id").alias("pos"), (F.col("id") * 3).alias("ts_ms"))
    sizes = [r["count"] for r in ranges.dealt(rows, ["session"], "ts_ms", 8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    left = rows.filter("pos % 3 = 0")
    out = ranges.asof_join(left, rows.filter("pos % 1000 = 1"), ["session"], "ts_ms", "ts_ms", ["pos"], "pos", 8)
    assert out.filter("asof_pos <> (pos - 1) div 1000 * 1000 + 1").count() == 0 and out.filter("asof_pos is null").count() == 1
