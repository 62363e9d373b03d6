"""Streams in event time against their batch forms: shuffled arrival, late rows, restarts, forgotten state."""

import datetime
import random

import pytest
from flowscope.operators import joins
from flowscope.operators import timeline as tl
from flowscope.streaming import live
from pyspark.sql import functions as F

T0 = datetime.datetime(2024, 1, 1)
FRAMES = "session long, frame_no long, ts timestamp, changed_pct double"


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    live.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(ms):
    return T0 + datetime.timedelta(milliseconds=ms)


def put(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/in/{name}")


def source(spark, folder, ddl):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def run(stream, folder, mode="append"):
    """All that there is, from the checkpoint on; the progress of each micro-batch."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cp").format("parquet").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    progress = list(q.recentProgress)
    q.stop()
    return progress


def frames(seed):
    rng = random.Random(seed)
    rows = []
    for s in (1, 2):
        ms = 0
        for i in range(40):
            rows.append((s, i, at(ms), 0.0 if i == 0 else rng.choice([0.0, 10.0, 31.0, 80.0])))
            ms += rng.choice([20, 60, 300, 1500])
    return rows


def test_shuffled_frames_across_a_restart_equal_the_batch(spark, tmp_path):
    rows = frames(1)
    want = {(r.session, r.frame_no, r.reason) for r in tl.keyframes(spark.createDataFrame(rows, FRAMES).withColumn("ts_ms", F.unix_millis("ts"))).collect()}
    rng = random.Random(2)
    order = sorted(rows, key=lambda r: r[2] + datetime.timedelta(milliseconds=rng.uniform(0, 4000)))
    parts = [order[i::1][k : k + 20] for i in (0,) for k in range(0, len(order), 20)]
    stream = lambda: live.keyframes(source(spark, tmp_path, FRAMES), "5 seconds", idle_ms=30_000)
    for k, part in enumerate(parts[:2]):
        put(spark, tmp_path, f"a{k}", part, FRAMES)
    run(stream(), tmp_path)
    for k, part in enumerate(parts[2:]):
        put(spark, tmp_path, f"b{k}", part, FRAMES)
    put(spark, tmp_path, "c", [(9, 0, at(10_000_000), 0.0)], FRAMES)  # time goes on
    progress = run(stream(), tmp_path)
    got = [(r.session, r.frame_no, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(x for x in got if x[0] != 9) == sorted(want)
    states = [s for p in progress for s in p["stateOperators"]]
    assert all(s["numRowsDroppedByWatermark"] == 0 for s in states)


def test_late_frames_are_counted_and_left_out(spark, tmp_path):
    put(spark, tmp_path, "a", [(1, 0, at(0), 0.0), (1, 1, at(100_000), 50.0)], FRAMES)
    put(spark, tmp_path, "b", [(2, 0, at(100_000), 0.0)], FRAMES)
    put(spark, tmp_path, "c", [(1, 2, at(500), 50.0), (1, 3, at(100_100), 50.0)], FRAMES)
    put(spark, tmp_path, "d", [(9, 0, at(10_000_000), 0.0)], FRAMES)
    progress = run(live.keyframes(source(spark, tmp_path, FRAMES), "1 second", idle_ms=1_000_000), tmp_path)
    got = {(r.session, r.frame_no, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").filter("session = 1").collect()}
    assert got == {(1, 0, "first"), (1, 1, "change"), (1, 3, "change")}
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1


def test_rings_hold_the_last_rows_by_time(spark, tmp_path):
    ddl = "session long, no long, ts timestamp, bytes long"
    rows = [(s, i, at(100 * i), i) for s, n in ((1, 12), (2, 3)) for i in range(n)]
    random.Random(3).shuffle(rows)
    for k in range(0, 15, 5):
        put(spark, tmp_path, f"a{k}", rows[k : k + 5], ddl)
    put(spark, tmp_path, "z", [(9, 0, at(10_000_000), 0)], ddl)
    put(spark, tmp_path, "zz", [(9, 1, at(20_000_000), 0)], ddl)
    run(live.rings(source(spark, tmp_path, ddl), 5, "10 seconds", 5000), tmp_path)
    ms = lambda t: int(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    got = {r.session: tuple(r)[1:] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[1] == (5, 7, ms(at(700)), ms(at(1100)), 7 + 8 + 9 + 10 + 11) and got[2] == (3, 0, ms(at(0)), ms(at(200)), 3)


def test_candidates_of_two_streams_equal_the_interval_join(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.choice([1, 2]), i, at(i * 97)) for i in range(200)]
    slices = [(s, k, at(k * 900), at(k * 900 + rng.choice([300, 900, 1900]))) for s in (1, 2) for k in range(20)]
    e_ddl, s_ddl = "session long, id long, ts timestamp", "session long, segment long, start timestamp, end timestamp"
    left, right = tmp_path / "e", tmp_path / "s"
    for k in range(0, 200, 50):
        put(spark, left, f"{k}", events[k : k + 50], e_ddl)
    order = sorted(slices, key=lambda r: r[2])
    for k in range(0, 40, 10):
        put(spark, right, f"{k}", order[k : k + 10], s_ddl)
    far = 10_000_000
    put(spark, left, "zz", [(9, 999, at(far))], e_ddl)
    put(spark, right, "zz", [(8, 999, at(far), at(far))], s_ddl)
    stream = live.candidates(source(spark, left, e_ddl), source(spark, right, s_ddl), 1000, 2000, "2 seconds")
    progress = run(stream, tmp_path)
    ms = lambda df, *cols: df.withColumns({c: F.unix_millis(c) for c in cols})
    points = ms(spark.createDataFrame(events, e_ddl), "ts")
    spans = ms(spark.createDataFrame(slices, s_ddl), "start", "end").withColumn("from", F.col("start") - 1000)
    want = {(r.session, r.id, r.segment) for r in joins.interval_join(points, spans, ["session"], "ts", "from", "end", 2000).collect()}
    assert {(r.session, r.id, r.segment) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    held = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert max(held) < 240 and held[-1] <= 4  # what the watermark has passed is forgotten
