"""The frame buffer as a table: rows (session, pos, ts_ms, bytes), pos being the order of insertion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Both ends included."""
    return rows.filter(F.col("ts_ms").between(start, end))


def not_older(rows: DataFrame, ts_ms: int) -> DataFrame:
    return rows.filter(F.col("ts_ms") >= ts_ms)


def recent(rows: DataFrame, n: int) -> DataFrame:
    """The last n of each session: what a ring of that capacity holds."""
    k = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pos")))
    return rows.withColumn("k", k).filter(F.col("k") <= n).drop("k")


def exported(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Of each session the rows from place ``start`` to before ``end`` in order of insertion; an end of 0 means all."""
    k = F.row_number().over(Window.partitionBy("session").orderBy("pos")) - 1
    out = rows.withColumn("place", k)
    return out.filter((F.col("place") >= start) & (F.col("place") < end if end else F.lit(True)))


def statistics(rows: DataFrame, capacity: int) -> DataFrame:
    """Of each session: rows held and dropped by a ring of that capacity, oldest and newest time, bytes and their mean."""
    last = recent(rows, capacity).groupBy("session").agg(F.count("*").alias("held"), F.min("ts_ms").alias("oldest"), F.max("ts_ms").alias("newest"), F.sum("bytes").alias("bytes"), F.round(F.avg("bytes"), 4).alias("mean_bytes"))
    all_ = rows.groupBy("session").agg(F.greatest(F.count("*") - capacity, F.lit(0)).alias("dropped"))
    return last.join(all_, "session")


def snapshot(rows: DataFrame) -> DataFrame:
    """Of each session: count, bytes, first and last time by insertion, ids in that order (at most what a ring holds)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda e: e["id"])
    return rows.groupBy("session").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min_by("ts_ms", "pos").alias("first_ms"), F.max_by("ts_ms", "pos").alias("last_ms"), ids.alias("ids"))


def rates(rows: DataFrame) -> DataFrame:
    """(session, pos, fps, peak): 1000 over the time since the row before, and its running maximum."""
    w = Window.partitionBy("session").orderBy("ts_ms", "pos")
    fps = F.try_divide(F.lit(1000.0), F.col("ts_ms") - F.lag("ts_ms").over(w))
    return rows.withColumn("fps", fps).withColumn("peak", F.max("fps").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).select("session", "pos", "fps", "peak")


def capture_metrics(rows: DataFrame, expected_ms: int) -> DataFrame:
    """Of each session: frames, seconds, mean rate, and frames that came more than an interval late (an estimate from gaps)."""
    w = Window.partitionBy("session").orderBy("ts_ms", "pos")
    rows = rows.withColumn("late", F.col("ts_ms") - F.lag("ts_ms").over(w) > 2 * expected_ms)
    span = (F.max("ts_ms") - F.min("ts_ms")) / 1000.0
    return rows.groupBy("session").agg(F.count("*").alias("frames"), span.alias("seconds"), F.round(F.coalesce(F.try_divide(F.count("*").cast("double"), span), F.lit(0.0)), 6).alias("fps"), F.count_if("late").alias("dropped"))


#: Rates a capture can be asked for (fixed values).
RATES_ALLOWED = (60, 120, 240)


def checked_rate(fps: int) -> int:
    """The rate, if a capture can have it; else an error."""
    if fps not in RATES_ALLOWED:
        raise ValueError(f"a rate of {fps} is none of {RATES_ALLOWED}")
    return fps


def progress(rows: DataFrame, every: int = 100) -> DataFrame:
    """(session, frames, elapsed_ms, fps): after each ``every`` rows the time since the first and the mean rate."""
    w = Window.partitionBy("session").orderBy("ts_ms", "pos")
    n = rows.withColumns({"frames": F.row_number().over(w), "elapsed_ms": F.col("ts_ms") - F.min("ts_ms").over(Window.partitionBy("session"))})
    return n.filter(F.col("frames") % every == 0).select("session", "frames", "elapsed_ms", F.coalesce(F.try_divide(F.col("frames") * F.lit(1000.0), F.col("elapsed_ms")), F.lit(0.0)).alias("fps"))


def slow(rows: DataFrame, factor: float = 1.5) -> DataFrame:
    """Operations (name, actual, expected) that took more than ``factor`` times what was expected, with that ratio."""
    return rows.filter(F.col("actual") > factor * F.col("expected")).withColumn("ratio", F.try_divide(F.col("actual").cast("double"), F.col("expected").cast("double")))


def cleared(rows: DataFrame) -> DataFrame:
    """(session, dropped): what emptying each session's buffer drops."""
    return rows.groupBy("session").agg(F.count("*").alias("dropped"))
