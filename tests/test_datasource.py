"""The data source of recorded files: batch and stream give the same rows, bad files are rows with a reason."""

import json
import os

import pytest
from flowscope.operators import document as doc
from flowscope.sources import datasource, readers, sample
from flowscope.sources import schemas as sch
from pyspark.sql import functions as F


@pytest.fixture
def folder(spark, tmp_path):
    datasource.register(spark)
    frames, events = sample.recordings()
    at = tmp_path / "in"
    (at / "more").mkdir(parents=True)
    (at / "a.json").write_text(json.dumps(frames))
    (at / "more" / "b.json").write_text(json.dumps([frames[0] | {"id": "g0"}, {"id": "bad", "timestamp": "soon", "data": ""}, 7, frames[1] | {"data": "*"}]))
    (at / "c.json").write_text("[{")
    (at / "e.json").write_bytes(b"\xff\xfe")
    (at / "_hidden.json").write_text("[]")
    (at / "notes.txt").write_text("no")
    for k, name in enumerate(["a.json", "more/b.json", "c.json", "e.json"]):
        os.utime(at / name, ns=(10**18 + k, 10**18 + k))
    return at


def test_batches_have_good_and_bad_rows(spark, folder):
    df = spark.read.format("recording").option("kind", "frames").load(str(folder))
    got = {(r.path.rsplit("/", 1)[-1], r.pos, r.id): r for r in df.collect()}
    assert {k for k, r in got.items() if r.reason is None} == {("a.json", 0, "f0"), ("a.json", 1, "f1"), ("b.json", 0, "g0")}
    assert bytes(got["a.json", 0, "f0"].data) == b"\x89PNG" and got["a.json", 1, "f1"].frame_no == 1
    assert {(k[0], k[1]) for k, r in got.items() if r.reason} == {("b.json", 1), ("b.json", 2), ("b.json", 3), ("c.json", None), ("e.json", None)}
    assert df.rdd.getNumPartitions() == 4
    good = readers.frames(spark, f"{folder}/a.json").orderBy("ts_ms")
    assert [tuple(r) for r in good.select("id", "ts_ms", "frame_no").collect()] == [tuple(r) for r in df.filter("path like '%a.json'").orderBy("pos").select("id", "ts_ms", "frame_no").collect()]


def test_streams_read_the_same_rows_in_turn(spark, folder, tmp_path):
    read = lambda: spark.readStream.format("recording").option("kind", "frames").load(str(folder))

    def run():
        q = read().writeStream.option("checkpointLocation", f"{tmp_path}/cp").format("parquet").option("path", f"{tmp_path}/out").start()
        q.processAllAvailable()
        q.stop()

    run()
    (folder / "d.json").write_text(json.dumps([{"id": "late", "timestamp": 5, "data": ""}]))
    run()
    batch = spark.read.format("recording").option("kind", "frames").load(str(folder))
    key = lambda df: sorted((tuple(map(str, r)) for r in df.select("path", "pos", "id", "ts_ms", "width", "reason").collect()))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(batch) and batch.filter("id = 'late'").count() == 1


def test_events_and_documents(spark, folder, tmp_path):
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "e.json").write_text(json.dumps(sample.recordings()[1]))
    e = spark.read.format("recording").option("kind", "events").load(str(tmp_path / "ev")).head()
    assert (e.id, e.type, e.ts_ms, e.x, e.y, e.reason) == ("click", "click", 1025, 500.0, 300.0, None)
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "a.json").write_text(json.dumps(sample.document()))
    (tmp_path / "doc" / "b.json").write_text("[1]")
    found = spark.read.format("recording").load(f"file://{tmp_path}/doc")
    assert [(r.path[-6:], r.reason) for r in found.orderBy("path").collect()] == [("a.json", None), ("b.json", "no document")]
    docs = found.filter("reason is null").select("path", "raw").withColumn("doc", F.from_json("raw", sch.of(sch.DOCUMENT)))
    assert doc.loaded(docs).count() == 1
    with pytest.raises(Exception, match="kind is one of"):
        spark.read.format("recording").option("kind", "songs").load(str(folder)).collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("recording").load(f"{tmp_path}/nowhere").collect()
