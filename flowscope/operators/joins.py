"""Interval, as-of and nearest joins as plans without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with ``start <= at <= end`` of the spans with the same keys.

    Spans are laid on buckets of ``width``, points fall in one bucket; an equal join on keys and bucket, then the exact
    test. Each pair meets in the point's bucket only, so none comes twice. A null bound matches nothing.
    """
    bucket = lambda c: F.floor(c / F.lit(width))
    left = points.withColumn("_bucket", bucket(F.col(at)))
    right = spans.filter(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return left.join(right, [*keys, "_bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bucket")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], tie: str) -> DataFrame:
    """Each left row with ``take`` of the latest right row of its keys that is not after it; of equal times the least ``tie``.

    Both sides are sorted together and the last right row is carried on: one shuffle by the keys, no join.
    """
    right = right.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, right_at).orderBy(tie))).filter("_n = 1")
    r = right.select(*keys, F.col(right_at).alias("_at"), F.struct(*(F.col(c).alias(c) for c in take)).alias("_take"))
    own = F.struct(*(F.col(c).alias(c) for c in left.columns))
    rows = left.select(*keys, F.col(left_at).alias("_at"), own.alias("_row")).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_last", F.last("_take", ignorenulls=True).over(w)).filter("_row is not null")
    return found.select("_row.*", *(F.col(f"_last.{c}").alias(f"asof_{c}") for c in take))


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: str, pos: str) -> DataFrame:
    """Each left row with ``take`` of the right row nearest in time, whichever side; of equally near ones the first by ``pos``."""
    right = right.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, right_at).orderBy(pos))).filter("_n = 1")
    r = right.select(*keys, F.col(right_at).alias("_at"), F.struct(F.col(right_at).alias("at"), F.col(pos).alias("pos"), F.col(take).alias("take")).alias("_take"))
    own = F.struct(*(F.col(c).alias(c) for c in left.columns))
    rows = left.select(*keys, F.col(left_at).alias("_at"), own.alias("_row")).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_row").isNotNull())
    before = F.last("_take", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_take", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = rows.withColumns({"_b": before, "_a": after}).filter("_row is not null")
    away = lambda c: F.struct(F.abs(F.col(f"{c}.at") - F.col("_at")), F.col(f"{c}.pos"), F.col(f"{c}.take").alias("take"))
    best = F.array_min(F.array_compact(F.array(F.when(F.col("_b").isNotNull(), away("_b")), F.when(F.col("_a").isNotNull(), away("_a")))))
    return found.select("_row.*", best["take"].alias(f"nearest_{take}"))
