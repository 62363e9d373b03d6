"""Readers of recorded files. A file with one JSON array is read as its rows; a malformed one is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.sources import schemas as sch


def _json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(sch.of(ddl)).option("multiLine", True).option("mode", "FAILFAST").json(path)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts_ms, data, dimensions, frame_no, metadata): data decoded from base64."""
    f = _json(spark, path, sch.FRAME)
    return f.select("id", F.col("timestamp").alias("ts_ms"), F.unbase64("data").alias("data"), "dimensions", F.col("frameNumber").alias("frame_no"), "metadata")


def events(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, ts_ms, x, y, element, data)."""
    e = _json(spark, path, sch.EVENT)
    return e.select("id", "type", F.col("timestamp").alias("ts_ms"), "target.x", "target.y", F.col("target.elementId").alias("element"), "data")


def change_map(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, sch.CHANGE)


def discovery(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a saved discovery: result, states, interactions, transitions, nodes, edges."""
    d = _json(spark, path, sch.DISCOVERY)
    part = lambda c: d.select(F.posexplode(c).alias("pos", "r")).select("pos", "r.*")
    return {"result": d.select("url", "timestamp", "coverage"), **{n: part(n) for n in ("states", "interactions", "transitions")}, "nodes": part("stateGraph.nodes"), "edges": part("stateGraph.edges")}


def boxes(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, sch.BOX)


def capture(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, sch.CAPTURE)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw, doc): each file whole, parsed by the document's schema; doc is null where it isn't JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
    return raw.withColumn("doc", F.from_json("raw", sch.of(sch.DOCUMENT)))


def images(spark: SparkSession, path: str, drop_bad: bool = True) -> DataFrame:
    """(path, width, height, channels, pixels): decoded by Spark; BGR or BGRA bytes from the top row on.

    Bad files are left out, or stay without pixels: compared with anything, they are not alike.
    """
    i = spark.read.format("image").option("dropInvalid", drop_bad).load(path)
    return i.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length", "content")


def planes(images_: DataFrame) -> DataFrame:
    """(path, width, height, r, g, b, px, alpha) of decoded images: colours, luma px, and alpha where there is one, row by row; nulls for a bad file."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        whole = pa.list_(pa.int32())
        for b in batches:
            rows = []
            for w, n, data in zip(*(b.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                if not data or n < 1 or w < 1:
                    rows.append([None] * 5)
                    continue
                a = np.frombuffer(data, np.uint8).reshape(-1, n).astype(np.int32)
                blue, green, red = (a[:, 0],) * 3 if n < 3 else a.T[:3]
                luma = np.floor(0.114 * blue + 0.587 * green + 0.299 * red + 0.5).astype(np.int32)
                rows.append([red, green, blue, luma, a[:, 3] if n == 4 else None])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array([r[k] for r in rows], whole) for k in range(5))], ["path", "width", "height", "r", "g", "b", "px", "alpha"])

    ints = ", ".join(f"{p} array<int>" for p in ("r", "g", "b", "px", "alpha"))
    return images_.select("path", "width", "height", "channels", "pixels").mapInArrow(run, f"path string, width int, height int, {ints}")


def frame_pairs(images_: DataFrame, order) -> DataFrame:
    """Planes of images (see ``planes``) with a ``session``, each with those of the one before by ``order`` as prev_ columns, and frame_no from 1 on."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy(order)
    before = {f"prev_{p}": F.lag(p).over(w) for p in ("width", "height", "r", "g", "b", "px", "alpha")}
    return images_.withColumns({"frame_no": F.row_number().over(w) - 1, **before}).filter("frame_no > 0")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").parquet(path)
