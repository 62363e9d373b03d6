"""As-of and nearest joins and running rates for sessions of any length: rows are dealt by ranges of (keys, time), so one long
session is shared by many tasks, and what a range needs from the ones before or behind it is carried over.

A range carries one row a key: the last (or first) right row, the last time, the largest value. A key has as many of them as it
has ranges, so the carrying is small whatever the session's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.operators.graph import with_cut


def dealt(rows: DataFrame, keys: list[str], at: str, ranges: int | None = None) -> DataFrame:
    """The rows with ``_range``, a number that grows with (keys, at); rows of one key and time share a range."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_cut(rows.repartitionByRange(n, *keys, at).withColumn("_range", F.spark_partition_id()))


def _carried(rows: DataFrame, keys: list[str], **values) -> DataFrame:
    """(keys, _range, a column for each value): what the ranges before a key's range leave it.

    values: name -> (aggregate over a range's rows, how those of several ranges are put together, "last", "first" or "max");
    "first" looks at the ranges behind.
    """
    w = Window.partitionBy(*keys).orderBy("_range")
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    over = {
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
        "first": lambda c: F.first(c, ignorenulls=True).over(behind),
        "max": lambda c: F.max(c).over(before),
    }
    ends = rows.groupBy(*keys, "_range").agg(*(agg.alias(name) for name, (agg, _) in values.items()))
    return ends.select(*keys, "_range", *(over[how](name).alias(name) for name, (_, how) in values.items()))


def _both_sides(left: DataFrame, right: DataFrame, keys, left_at, right_at, take, order, ranges):
    """Left and right rows in one table in ranges: _at, _row (left's columns) or _take; of right rows at one time the first by ``order``."""
    right = right.groupBy(*keys, F.col(right_at).alias("_at")).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_take"))
    own = F.struct(*(F.col(c).alias(c) for c in left.columns))
    rows = left.select(*keys, F.col(left_at).alias("_at"), own.alias("_row")).unionByName(right, allowMissingColumns=True)
    return dealt(rows, keys, "_at", ranges)


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], tie: str, ranges: int | None = None
) -> DataFrame:
    """``joins.asof_join`` for long sessions: each left row with ``take`` of the latest right row of its keys that is not after it;
    of equal times the least ``tie``. Null keys match nothing; a left row without one has nulls.
    """
    rows = _both_sides(left, right, keys, left_at, right_at, [F.col(c).alias(c) for c in take], [F.col(tie)], ranges)
    last = F.max_by("_take", F.when(F.col("_take").isNotNull(), F.col("_at")))
    carried = _carried(rows, keys, _before=(last, "last"))
    w = Window.partitionBy("_range", *keys).orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_own", F.last("_take", ignorenulls=True).over(w)).filter("_row is not null").join(carried, [*keys, "_range"], "left")
    best = F.coalesce("_own", "_before")
    return found.select("_row.*", *(best[c].alias(f"asof_{c}") for c in take))


def nearest_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: str, pos: str, ranges: int | None = None
) -> DataFrame:
    """``joins.nearest_join`` for long sessions: each left row with ``take`` of the right row nearest in time; of equally near ones the
    first by ``pos``.
    """
    kept = [F.col(right_at).alias("at"), F.col(pos).alias("pos"), F.col(take).alias("take")]
    rows = _both_sides(left, right, keys, left_at, right_at, kept, [F.col(pos)], ranges)
    when = F.when(F.col("_take").isNotNull(), F.col("_at"))
    carried = _carried(rows, keys, _before=(F.max_by("_take", when), "last"), _after=(F.min_by("_take", when), "first"))
    w = Window.partitionBy("_range", *keys).orderBy("_at", F.col("_row").isNotNull())
    own_before = F.last("_take", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own_after = F.first("_take", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = rows.withColumns({"_b": own_before, "_a": own_after}).filter("_row is not null").join(carried, [*keys, "_range"], "left")
    found = found.withColumns({"_b": F.coalesce("_b", "_before"), "_a": F.coalesce("_a", "_after")})
    away = lambda c: F.struct(F.abs(F.col(f"{c}.at") - F.col("_at")), F.col(f"{c}.pos"), F.col(f"{c}.take").alias("take"))
    each = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), away(c)) for c in ("_b", "_a"))))
    return found.select("_row.*", F.array_min(each)["take"].alias(f"nearest_{take}"))


def rates(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """``buffer.rates`` for long sessions: (session, pos, fps, peak), frames a second from each row to the one before it in time,
    and the largest so far; null for the first and for rows of one time.
    """
    rows = dealt(rows.select("session", "pos", "ts_ms"), ["session"], "ts_ms", ranges)
    w = Window.partitionBy("_range", "session").orderBy("ts_ms", "pos")
    timed = rows.join(_carried(rows, ["session"], _last=(F.max("ts_ms"), "last")), ["session", "_range"])
    gap = F.col("ts_ms") - F.coalesce(F.lag("ts_ms").over(w), F.col("_last"))
    timed = timed.withColumn("fps", 1000.0 / F.nullif(gap, F.lit(0)))
    peaks = _carried(timed, ["session"], _peak=(F.max("fps"), "max"))
    own = F.max("fps").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return timed.withColumn("own", own).join(peaks, ["session", "_range"]).select("session", "pos", "fps", F.greatest("own", "_peak").alias("peak"))
