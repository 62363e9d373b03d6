import gc
import random
import time

import pyarrow as pa
from flowscope.llm import common
from flowscope.llm.common import Memo, bounded, components, join_counted, pieces, probably_among, white_cut
from pyspark.sql import functions as F


def test_slices_hold_all_rows_and_little_text():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 5, 30, 200]) for _ in range(rng.randrange(20))]
        parts = list(pieces(sizes, 50))
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(len(sizes)))
        assert all(sum(sizes[p]) <= 50 or p.stop - p.start == 1 or sum(sizes[p.start + 1 : p.stop]) == 0 for p in parts)
    batch = pa.RecordBatch.from_pydict({"i": list(range(5)), "t": ["a" * 40, None, "", "b" * 40, "c"]})
    got = list(bounded([batch], 1, 50))
    assert [r["i"] for b in got for r in b.to_pylist()] == list(range(5)) and len(got) == 2


def test_cuts_split_no_word():
    rng = random.Random(2)
    for _ in range(300):
        text = bytes(rng.choice(b"ab \n\t") for _ in range(rng.randrange(60)))
        assert [w for p in white_cut(text, 7) for w in p.split()] == text.split()


def test_memory_of_words_is_bounded():
    class Length(Memo):
        def of_key(self, key):
            return len(key)

    m = Length(most=1000)
    assert all(m["x" * n] == n for n in range(200)) and len(m) <= m.most and max(map(len, m)) <= Memo.LONGEST


def test_filter_loses_no_member(spark):
    rows = spark.range(20000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("t").alias("text"))
    members = spark.range(0, 20000, 37).select(F.when(F.col("id") > 0, F.col("id")).alias("m"))
    want = {r.m for r in members.collect()}
    for count in (0, 541, 10**9):
        got = probably_among(rows, F.col("id"), members, F.col("m"), count)
        assert got.columns == ["id", "text"] and want <= {r.id for r in got.collect()}
    assert probably_among(rows, F.col("id"), members, F.col("m"), 541).count() < 3000
    assert probably_among(rows, F.col("id"), members.filter("false"), F.col("m"), 0).count() == 0


def test_joins_with_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 = 0")
    got = join_counted(rows, keyed, "k", "n", 5000)
    assert got.count() == rows.filter("k % 2 = 0").count() and got.filter("k = 0").count() == 4000


def test_components_against_plain_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    low = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    want = {x: low[x] for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_the_drivers_garbage_goes_between_steps(spark, monkeypatch):
    """Not with every step: after COLLECT_S, and then its heap holds nothing that only finished steps had."""
    jvm, asked = spark.sparkContext._jvm, []
    weak = jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())
    monkeypatch.setattr(common, "COLLECT_S", 1e9)
    monkeypatch.setattr(common.gc, "collect", lambda f=common.gc.collect: asked.append(1) or f())
    common.written(spark.range(3), "some")
    assert not asked
    monkeypatch.setattr(common, "COLLECT_S", 0)
    for _ in range(20):  # Python lets go of the JVM's objects in the background
        assert common.written(spark.range(3), "some").count() == 3
        if weak.refersTo(None):
            break
    assert asked and weak.refersTo(None)


def test_the_drivers_garbage_goes_during_a_job_too(spark, monkeypatch):
    """Without a further step: what is dropped while nothing is written goes, and no longer once the application's thread is told to end."""
    jvm = spark.sparkContext._jvm
    monkeypatch.setattr(common, "COLLECT_S", 0)
    monkeypatch.setattr(common, "TICK_S", 0.2)
    monkeypatch.setattr(common, "_watched", {})
    stop = common.collect_meanwhile(spark)
    assert common.collect_meanwhile(spark) is stop
    try:
        weak, end = jvm.java.lang.ref.WeakReference(jvm.java.lang.Object()), time.monotonic() + 30
        while not weak.refersTo(None) and time.monotonic() < end:
            time.sleep(0.2)
        assert weak.refersTo(None)
    finally:
        stop.set()


def test_executors_collect_their_garbage(spark):
    """On one machine the executor is the driver's process, so an object that is dropped there shows it."""
    jvm = spark.sparkContext._jvm
    weak = jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())
    for _ in range(20):
        gc.collect()
        common.collect_on_executors(spark)
        if weak.refersTo(None):
            break
    assert weak.refersTo(None)
