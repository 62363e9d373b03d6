"""Ordered folds: what the next row gives depends on what came out for the ones before."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame


def fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[tuple, list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """Applies ``step`` to each group's rows in order and returns the tuples it yields, as rows of ``schema``.

    One shuffle by the keys and a sort within the partitions; then a partition streams through a worker in Arrow batches,
    and only one group is in memory at a time. A group must fit in a worker.
    """
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    names = [f.name for f in kinds]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        at, rows = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if rows and key != at:
                    out.extend(step(at, rows))
                    rows = []
                at = key
                rows.append(row)
            yield _batch(out)
        yield _batch(list(step(at, rows)) if rows else [])

    def _batch(out):
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
