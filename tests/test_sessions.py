import datetime
import hashlib
import json
import os
import random
import struct
import threading
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from flowscope import session
from flowscope.functions import jsjson
from flowscope.operators import buffer as bf
from flowscope.operators import document as doc
from flowscope.operators import elements as el
from flowscope.operators import explore as ex
from flowscope.operators import frames as fr
from flowscope.operators import graph as g
from flowscope.operators import states as st
from flowscope.operators import timeline as tl
from flowscope.plans import document_queries
from flowscope.plans import views as v
from flowscope.sources import export, readers, sample
from flowscope.streaming import sessions as stream
from pyspark.sql import functions as F


def test_recordings_round_trip(spark, tmp_path):
    frames, events = sample.recordings()
    for name, rows in (("f", frames), ("e", events)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    f = readers.frames(spark, f"{tmp_path}/f.json").orderBy("ts_ms").collect()
    assert [bytes(r.data) for r in f] == [b"\x89PNG"] * 2 and f[0].dimensions.width == 1
    assert readers.events(spark, f"{tmp_path}/e.json").head().x == 500
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        readers.frames(spark, f"{tmp_path}/bad.json").collect()
    export.to_json(readers.frames(spark, f"{tmp_path}/f.json"), f"{tmp_path}/out")
    lines = [json.loads(x) for p in os.listdir(tmp_path / "out") if p.startswith("part") for x in (tmp_path / "out" / p).read_text().splitlines()]
    assert {x["data"] for x in lines} == {"iVBORw=="}


def test_discovery_file(spark, tmp_path):
    d = {"url": "u", "timestamp": 1, "states": [{"id": "s1", "url": "a", "title": "t", "possibleInteractions": 2}, {"id": "s2", "url": "b", "title": "t", "possibleInteractions": 0}], "interactions": [], "transitions": [{"id": "t", "fromState": "s1", "toState": "s2", "interaction": "click", "count": 1}], "stateGraph": {"nodes": [{"id": "s1", "label": "A"}, {"id": "s2", "label": "B"}], "edges": [{"from": "s1", "to": "s2", "label": 'a "b"'}]}, "coverage": 0.75}
    (tmp_path / "d.json").write_text(json.dumps(d))
    t = readers.discovery(spark, f"{tmp_path}/d.json")
    e = t["edges"].select(F.col("from").alias("src"), F.col("to").alias("dst"), "label", "pos")
    assert [r.state for r in g.entry_points(e).collect()] == ["s1"] and [r.state for r in g.dead_ends(e).collect()] == ["s2"]
    assert g.loops(e).count() == 0 and g.hubs(e).count() == 0
    lines = {r.line for r in export.dot_lines(t["nodes"], e).collect()}
    assert '  "s1" -> "s2" [label="a \\"b\\""];' in lines
    page = export.report(t["nodes"].select("id", F.col("label").alias("title")), g.transition_counts(e))
    assert "2 states, 1 transitions" in page


def test_document_queries(spark, tmp_path):
    d = sample.documents(spark)
    assert [doc.state_at(d, t).head().state for t in (1300, 9001, -1)] == ["runs", "rings", None]
    assert doc.path_between(d, "set", "rings").head().states == ["set", "runs", "rings"] and doc.path_between(d, "rings", "set").count() == 0
    assert doc.path_between(d, "set", "set").head().distance == 0
    assert doc.of_type(d, "canvas").count() == 1 and doc.state_molecules(d).count() == 10
    assert [doc.evaluated(d, "dial", "angle", {"total": 60, "left": x}).head().value for x in (45, 60, 90)] == [90.0, 0.0, 0.0]
    assert [doc.evaluated(d, "log", "offset", {"lines": x}).head().value for x in (9, 2)] == [-90.0, 0.0]
    assert [doc.first_metric(d, k).head().value for k in ("memory", "none")] == [21.5, 0.0]
    assert [doc.state_difference(d, "set", x).head().difference for x in ("rings", "set")] == [1, 0]
    assert doc.loaded(d).count() == 1 and doc.errors(d).count() == 0
    (tmp_path / "a.json").write_text(d.head().raw)
    (tmp_path / "b.json").write_text("{")
    files = readers.documents(spark, str(tmp_path))
    assert {(r.path[-6:], r.rule) for r in doc.errors(files).collect()} == {("b.json", "not a document")}
    assert doc.loaded(files.filter("path like '%a.json'")).count() == 1
    broken = sample.document()
    broken["stateGraph"]["nodes"][0]["timestamp"] = 5
    with pytest.raises(ValueError, match="checksum of stateGraph"):
        doc.loaded(sample.documents(spark, broken))
    with pytest.raises(Exception, match="no such state"):
        doc.state_difference(d, "set", "nowhere").collect()


def test_checksums_are_those_of_the_browser_text(spark):
    """A number written 1.0 is 1, small ones have a browser's exponent, the order of keys stays."""
    text = '{"a":1,"b":[1e-7,0.000001,1.5],"c":null,"d":"\u00e9"}'
    assert doc.stringify(json.loads('{"a": 1.0, "b": [1e-7, 1e-6, 1.50], "c": null, "d": "\\u00e9"}')) == text
    made = doc.section_checksums({"visualData": {"b": 1.0, "a": 2}, "molecules": []})
    assert made["visualDataChecksum"] == "sha256:" + hashlib.sha256(b'{"b":1,"a":2}').hexdigest() and set(made) == {"visualDataChecksum", "moleculeTreeChecksum"}
    assert made["moleculeTreeChecksum"] == "sha256:" + hashlib.sha256(b"[]").hexdigest()


def test_subsets_stay_documents(spark):
    d = sample.documents(spark)
    cut = doc.subset(d, 1200, 4700)
    got = cut.head().doc
    assert [len(got.visualData.keyframes), len(got.stateGraph.nodes), len(got.stateGraph.edges)] == [2, 2, 4]
    assert doc.loaded(cut).count() == 1  # with new checksums
    got = doc.subset(d, states=["set", "runs"], molecules=["log"]).head().doc
    assert [len(got.stateGraph.nodes), len(got.stateGraph.edges), len(got.molecules)] == [2, 1, 1]
    assert len(doc.subset(d, end=1500).head().doc.visualData.keyframes) == 2


@pytest.mark.parametrize(
    "change, rule",
    [
        (lambda x: x.pop("metadata"), "metadata is missing"),
        (lambda x: x.update(molecules=[]), "molecules has not the right length"),
        (lambda x: x.update(version="1"), "version is not well formed"),
        (lambda x: x["stateGraph"]["edges"][0].update(probability=1.5), "stateGraph.edges[].probability is not within 0 and 1"),
        (lambda x: x["stateGraph"]["edges"][1]["trigger"].update(type="luck"), "stateGraph.edges[].trigger.type is none of the known values"),
        (lambda x: x["visualData"]["keyframes"][0].pop("visualHash"), "visualData.keyframes[].visualHash is missing"),
        (lambda x: x["metadata"]["captureSettings"].update(frameRate=30), "metadata.captureSettings.frameRate is not within 60 and 240"),
        (lambda x: x["metadata"]["fidelityScore"].update(overall=0.9), "warning: fidelity below 0.999"),
    ],
)
def test_broken_documents(spark, change, rule):
    broken = sample.document()
    change(broken)
    assert [r.rule for r in doc.errors(sample.documents(spark, broken)).collect()] == [rule]


def test_pages_of_a_small_site(spark):
    pages = spark.createDataFrame(
        [(1, '<a href="/p1">1</a><a href="/p2">2</a><button id="b">Go</button><input type="text" id="i">'), (2, '<a href="/">h</a><button onclick="x()">b</button>'), (3, '<a href="/">h</a><form><input type="email"><input type="password"><button type="submit">s</button></form>'), (4, None)],
        "id long, html string",
    )
    got = {(r.state, r.type): r["count"] for r in ex.detected(pages).groupBy("state", "type").count().collect()}
    assert got == {(1, "link"): 2, (1, "button"): 1, (1, "input"): 1, (2, "link"): 1, (2, "button"): 1, (3, "link"): 1, (3, "input"): 2, (3, "button"): 1}
    conf = {(r.state, r.type): round(r.confidence, 6) for r in ex.detected(pages).collect()}
    assert conf[1, "link"] == 0.9 and conf[1, "button"] == 0.8 and conf[2, "button"] == 0.9
    assert [r.selector for r in ex.detected(pages).filter("type = 'input' and state = 1").collect()] == ["#i"]
    assert st.tree_hash("<p class='b a'>x</p>") == st.tree_hash("<p class='a b'>y</p>") != st.tree_hash("<div class='a b'>x</div>")


def test_tree_as_a_browser_writes_it():
    html = '<html><head><title>t</title></head><body class="b a"><p id="x">1<br>2</p><div style="display: none"><i></i></div><div style="visibility:hidden"></div><span></span></body></html>'
    assert st.tree_text(html) == '{"tag":"body","classes":["a","b"],"children":[{"tag":"p","id":"x","classes":[],"children":[{"tag":"br","classes":[]}]},{"tag":"span","classes":[]}]}'
    assert st.tree_text(None) == '{"tag":"body","classes":[]}' and st.tree_text("<p>") == '{"tag":"body","classes":[],"children":[{"tag":"p","classes":[]}]}'
    assert st.tree_text("<b>" * 20_000).count('"b"') == 20_000


def test_structural_similarity_golden(spark):
    a, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    assert abs(spark.range(1).select(st.structural_similarity(a, b)).head()[0] - (0.7 / 3 + 0.3)) < 1e-12
    none = F.array().cast("array<string>")
    assert spark.range(1).select(st.structural_similarity(none, none)).head()[0] == 1.0


def test_empty_hashes_do_not_make_states_equal(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>", "", ["a"]), (2, "u2", "<p>", "", ["b"]), (3, "u3", "<b>", "h", ["c"]), (4, "u4", "<i>", "h", ["d"])], "id long, url string, html string, visual_hash string, links array<string>")
    assert {r.id: r.same_as for r in st.canonical(pages).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_scroll_positions(spark):
    h = spark.createDataFrame([(1, 2000), (2, 0)], "id long, height long")
    y = lambda f: [r.y for r in ex.scroll_positions(h, 1000, f).filter("id = 1").orderBy("place").collect()]
    assert y(True) == [0, 800, 1600, 1000] and y(False) == [0, 1000]


def test_cycles_by_component(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("b", "c", 3), ("c", "d", 4), ("d", "e", 5), ("e", "c", 6), ("f", "f", 7), ("a", "g", 8)], "src string, dst string, pos long")
    assert {(r.component, r.states) for r in g.cyclic_components(e).collect()} == {("a", 2), ("c", 3), ("f", 1)}
    assert [(r.src, r.dst) for r in g.loops(e).collect()] == [("b", "a")]


def test_pipelines(spark, tiny):
    out = session.create("timeline", shortest=0).analyze(v.frame_pairs(spark, tiny), v.frames(spark, tiny), v.events(spark, tiny))
    n = {k: df.count() for k, df in out.items()}
    sessions = v.frames(spark, tiny).select("session").distinct().count()
    assert n["keyframes"] - n["slices"] == sessions and n["correlations"] > 0
    assert n["merged"] == out["merged"].filter("confidence >= 0.7").count()
    with pytest.raises(ValueError, match="two frames"):
        session.Timeline().analyze(v.frame_pairs(spark, tiny), v.frames(spark, tiny).limit(1), v.events(spark, tiny))
    parts = session.create("elements", least=0.6).decompose(v.boxes(spark, tiny))
    assert parts["depths"].count() == parts["elements"].count()


def test_a_frame_number_of_one_session_is_not_another_s(spark):
    rows = [(x, i, 100 * i, [200 * (x == 1 and i == 1)] * 4) for x in (1, 2) for i in range(3)]
    frames = spark.createDataFrame(rows, "session long, frame_no long, ts_ms long, px array<int>")
    pairs = frames.join(frames.select("session", (F.col("frame_no") + 1).alias("frame_no"), F.col("px").alias("prev_px")), ["session", "frame_no"])
    events = spark.createDataFrame([(1, 1, 5, "a", 0.0, 0.0)], "id long, session long, ts_ms long, type string, x double, y double")
    keys = session.create("timeline", shortest=0).analyze(pairs, frames, events)["keyframes"].collect()
    assert sorted((r.session, r.frame_no, r.reason) for r in keys) == [(1, 0, "first"), (1, 1, "change"), (1, 2, "change"), (2, 0, "first"), (2, 2, "last")]


def run_stream(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_ring_as_a_stream_equals_the_batch(spark, tiny, tmp_path):
    ev = v.table(spark, tiny, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"))
    for i in range(3):
        ev.filter(F.col("id").between(i * 400, i * 400 + 399)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run_stream(stream.ring(src, 5), "ring", "update")
    got = {r.session: (r.held, r.dropped, r.newest) for r in spark.table("ring").groupBy("session").agg(F.max_by(F.struct("held", "dropped", "newest"), F.col("held") + F.col("dropped")).alias("r")).select("session", "r.*").collect()}
    want = {r.session: (min(5, r.n), max(0, r.n - 5), r.m) for r in ev.groupBy("session").agg(F.count("*").alias("n"), F.max("id").alias("m")).collect()}
    assert got == want


def test_keyframe_stream(spark, tmp_path):
    rows = [(1, 0, 0, 0.0), (1, 1, 100, 50.0), (1, 2, 200, 1.0), (1, 3, 2500, 1.0), (1, 4, 2600, 1.0)]
    df = spark.createDataFrame(rows, "session long, frame_no long, ts_ms long, changed_pct double")
    df.write.parquet(f"{tmp_path}/in")
    run_stream(stream.keyframes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), "kf", "append")
    assert sorted((r.frame_no, r.reason) for r in spark.table("kf").collect()) == [(0, "first"), (1, "change"), (3, "forced")]


def test_batches_are_written_once(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = stream.written_once(src, f"{tmp_path}/out", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_session_windows_and_counts(spark, tiny, tmp_path):
    src = v.table(spark, tiny, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = readers.event_stream(spark, f"{tmp_path}/in")
    run_stream(stream.visit_counts(live), "visits", "complete")
    assert spark.table("visits").agg(F.sum("visits")).head()[0] == src.count()
    run_stream(stream.segments(live), "segs", "append")
    closed = spark.table("segs").agg(F.sum("n")).head()[0]
    assert 0 < closed <= src.count()


def test_history_stream_is_bounded_and_can_be_cleared(spark, tmp_path):
    ts = lambda i: datetime.datetime(2024, 1, 1, 0, 0, i)
    rows = [(1, i % 7, ts(i), None) for i in range(30)] + [(2, 1, ts(1), False), (2, 9, ts(2), True), (2, 3, ts(3), None)]
    df = spark.createDataFrame(rows, "source long, id long, ts timestamp, clear boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    run_stream(stream.correlation_history(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 3), "history", "update")
    held, want = {}, {}
    for i in range(30):  # the same by hand
        held[i % 7] = held.get(i % 7, 0) + 1
        if len(held) > 3:
            del held[next(iter(held))]
    want = {(1, k, n) for k, n in held.items()} | {(2, 3, 1)}
    assert {tuple(r) for r in spark.table("history").collect()} == want
    t = spark.createDataFrame([(i % 7, 100 * i) for i in range(30)], "id long, ts_ms long")
    assert {r.id for r in tl.history(t, 3).select("id").distinct().collect()} == {4, 5, 6} and tl.event_history(t, 2).count() == 4 and tl.event_history(t, 99).count() == 0


def test_visible_elements(spark):
    html = '<div style="display: none"><a href="/a">x</a></div><a href="/b" style="opacity:0.5">y</a><button disabled>z</button><a href="/c" style="opacity:0">w</a><a href="/d" hidden>v</a><a href="/e" style="cursor: pointer">u</a>'
    got = ex.detected(spark.createDataFrame([(1, html)], "id long, html string")).orderBy("pos").collect()
    assert [(r.visible, r.enabled) for r in got] == [(False, True), (True, True), (True, False), (False, True), (False, True), (True, True)]
    assert round(got[5].confidence, 6) == 1.0


def test_outputs_of_a_model_in_four_arrays(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.2, 0.5, 0.6, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.1, 0.1], [0.9, 0.4, 0.8], [3.0, 1.0, 0.0], 2)], "id long, boxes array<double>, scores array<double>, classes array<double>, n int")
    (r,) = el.parsed_tensors(rows).collect()  # the second is unsure, the third beyond n
    assert [round(x, 6) for x in (r.x, r.y, r.w, r.h, r.confidence)] == [64.0, 128.0, 256.0, 256.0, 0.9] and r.type_no == 3


def png(width, height, pixels):
    """RGBA bytes as a PNG file."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(pixels[y * width * 4 : (y + 1) * width * 4]) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_images_become_pairs_of_planes(spark, tmp_path):
    first = [v for i in range(6) for v in (10 * i, 100, 200, 255)]
    second = first[:4] + [250, 0, 0, 255] + first[8:]
    for name, data in (("1.png", png(3, 2, first)), ("2.png", png(3, 2, second)), ("3.png", b"no image"), ("4.png", png(2, 3, second))):
        (tmp_path / name).write_bytes(data)
    assert readers.images(spark, str(tmp_path)).count() == 3
    i = readers.planes(readers.images(spark, str(tmp_path), drop_bad=False)).withColumn("session", F.lit(1))
    names = ["path", "width", "height", "r", "g", "b", "px", "alpha", "session"]
    rows = {r.path[-5]: r for r in i.select(*names).collect() if r.path}
    assert rows["1"].r == [0, 10, 20, 30, 40, 50] and set(rows["1"].g) == {100} and rows["1"].px[0] == 82 and rows["1"].width == 3
    pairs = readers.frame_pairs(i.filter("path is not null"), "path")
    got = [r.s for r in pairs.select("frame_no", fr.visual_similarity().alias("s")).orderBy("frame_no").collect()]
    assert abs(got[0] - 5 / 6) < 1e-9 and all(x == 0 for x in got[2:])
    bad = spark.createDataFrame([(None, [1], None, [1], None, [1])], "r array<int>, prev_r array<int>, g array<int>, prev_g array<int>, b array<int>, prev_b array<int>")
    assert bad.select(fr.visual_similarity()).head()[0] == 0.0


def test_content_areas(spark):
    html = '<header class="banner"><nav></nav></header><main><div class="hero"><canvas></canvas></div><img loading="lazy"></main><div data-infinite-scroll></div><div data-infinite-scroll></div>'
    nodes = ex.page_nodes(spark.createDataFrame([(1, html), (2, None)], "id long, html string")).withColumns({"top": F.col("pos") * 10, "height": F.lit(5)})
    got = sorted((r.selector, r.top, r.bottom, r.importance) for r in ex.content_areas(nodes).collect())
    assert got == [(".banner", 0, 5, 0.9), (".hero", 30, 35, 1.0), ("header", 0, 5, 0.9), ("infinite-scroll", 60, 65, 1.0), ("lazy-image", 50, 55, 0.8), ("main", 20, 25, 1.0), ("nav", 10, 15, 0.5)]


def test_rates_that_can_be_captured():
    assert bf.checked_rate(120) == 120
    with pytest.raises(ValueError, match="none of"):
        bf.checked_rate(90)


def test_analysis_of_a_session_by_hand(spark):
    """A block appears at 1000 and vanishes at 3000; a click beside it is answered, one far away is not; another session sleeps."""
    blank, block = [0] * 64, [200 if 2 <= i % 8 < 5 and 2 <= i // 8 < 5 else 0 for i in range(64)]
    shown = {1: [blank, block, block, blank, blank], 2: [blank] * 3, 3: [blank]}
    rows = [(s, i, 1000 * i, px) for s, pictures in shown.items() for i, px in enumerate(pictures)]
    frames = spark.createDataFrame(rows, "session long, frame_no long, ts_ms long, px array<int>")
    before = frames.select("session", (F.col("frame_no") + 1).alias("frame_no"), F.col("px").alias("prev_px"))
    pairs = frames.join(before, ["session", "frame_no"])
    clicks = [(10, 1, 900, "click", 3.0, 3.0), (11, 1, 2900, "click", 500.0, 500.0), (12, 2, 100, "click", 3.0, 3.0), (13, 9, 100, "click", 3.0, 3.0)]
    events = spark.createDataFrame(clicks, "id long, session long, ts_ms long, type string, x double, y double")
    out = session.create("timeline", longest=5000, threshold=0.6, reach=2, step=1).analyze(pairs, frames, events)
    assert sorted((r.session, r.frame_no, r.reason) for r in out["keyframes"].collect()) == [
        (1, 0, "first"), (1, 1, "change"), (1, 3, "change"), (1, 4, "last"), (2, 0, "first"), (2, 2, "last"), (3, 0, "first"),
    ]
    spans = {(r.session, r.segment): r for r in out["slices"].collect()}
    assert {k: (r.start_ms, r.end_ms, r.frames, r.type) for k, r in spans.items()} == {
        (1, 1): (0, 1000, [0, 1], "appearance"), (1, 2): (1000, 3000, [1, 2, 3], "disappearance"), (1, 3): (3000, 4000, [3, 4], "none"), (2, 1): (0, 2000, [0, 1, 2], "none"),
    }
    assert [tuple(x)[1:5] for x in spans[1, 1].regions] == [(2, 2, 3, 3)] and spans[1, 3].regions == []
    assert spans[1, 1].confidence == pytest.approx(0.5 + 0.3 * 2 / 30 + 0.2 / 5)  # 9 of 64 pixels, two frames, one region
    held = {(r.session, r.segment): r for r in out["correlations"].collect()}
    # of strength 0.56: a delay of 100, animated; near by 1 - 0.707 / 100
    score = 0.3 * 0.95 + 0.3 * (1 - 0.5**0.5 / 100) + 0.2 + 0.2 * 0.9
    assert held[1, 1].events == [10] and held[1, 1].confidence == pytest.approx(score)
    assert held[1, 2].events == [10, 11] and held[2, 1].events == []
    merged = out["merged"].collect()
    assert [(r.session, r.start_ms, r.end_ms, r.type, r.events) for r in sorted(merged, key=lambda r: r.start_ms)] == [(1, 0, 1000, "appearance", [10]), (1, 1000, 3000, "disappearance", [10, 11])]
    chain = out["chains"].collect()
    assert [(r.session, r.trigger, r.n, r.duration, r.settling) for r in chain] == [(1, 10, 3, 2000, 2000)]
    assert {r.session: (r.frames, r.events, r.slices, r.mean_ms, r.common) for r in out["statistics"].collect()} == {
        1: (5, 2, 2, 1500.0, "appearance"), 2: (3, 1, 0, 0.0, "none"), 3: (1, 0, 0, 0.0, "none"),
    }


def test_empty_hashes_are_equal_to_none_and_places_count(spark):
    ddl = ", ".join(f"{s}_id long, {s}_url string, {s}_title string, {s}_visual_hash string, {s}_struct_hash string, {s}_links array<string>, {s}_scroll_x int, {s}_scroll_y int, {s}_storage array<string>" for s in "ab")
    side = lambda i, visual, struct, x=0, keys=("k",), links=("l",): (i, "u", "t", visual, struct, list(links), x, 0, None if keys is None else list(keys))
    rows = [
        side(1, "v", "s") + side(2, "v", "s", 9), side(3, "", "") + side(4, "", ""), side(5, None, "s") + side(6, None, "s"), side(7, "v", "s") + side(8, "v", "z", 9),
        side(9, "v", "s") + side(10, "v", "z", 0, ("k", "m", "n", "o")), side(11, "v", "s", 0, None) + side(12, "v", "z", 0, None), side(13, "v", "s", 9, ("k",), ()) + side(14, "v", "z", 0, (), ()),
    ]
    got = {r.a_id: (r.visual, round(r.structural, 6), r.identical) for r in st.compared(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {
        1: (1.0, 1.0, True), 3: (0.0, 1.0, False), 5: (0.0, 1.0, False), 7: (1.0, 0.96, True), 9: (1.0, 0.925, True), 11: (1.0, 1.0, True), 13: (1.0, 1.0, True),
    }


def test_a_long_chains_work_grows_with_its_links(spark):
    """One chain of 12,000 links against a loop; where each link looked through the others it took minutes."""
    pct = [(i * 7919) % 101 / 10 for i in range(12_000)]
    rows = spark.range(len(pct)).select(F.lit(1).alias("k"), (F.col("id") * 5).alias("ts_ms"), "id", ((F.col("id") * 7919) % 101 / 10).alias("pct"), F.lit(0.75).alias("confidence"), F.lit(100).alias("delay"))
    spark.sparkContext.setJobGroup("long chain", "one long chain", True)
    timer = threading.Timer(60, spark.sparkContext.cancelJobGroup, ["long chain"])
    timer.start()
    try:
        got = tl.chains(rows, ["k"]).drop("chain_id").head()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    felt = [5 * i for i, p in enumerate(pct) if p > 1]
    smooth = sum((a <= b <= c) or (a >= b >= c) for a, b, c in zip(pct, pct[1:], pct[2:], strict=False))
    assert (got.trigger, got.n, got.duration, got.settling, got.peak_ms) == (0, 12_000, 59_995, felt[-1], 5 * pct.index(max(pct)))
    assert got.animated == (smooth / 11_998 > 0.7) and not got.instantaneous


def test_documents_pass_through_workers_in_small_slices(spark):
    """However many documents a task has, a worker has about a megabyte of them in hand; a large one comes alone, none is lost."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        d = spark.range(0, 200, 1, 1).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), F.when(F.col("id") == 7, 9_000_000).otherwise(200_000).cast("int")).alias("raw"))
        assert doc.errors(d).count() == 200
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.column(1).nbytes])], ["rows", "bytes"]) for b in batches)
        whole = d.mapInArrow(sizes, "rows long, bytes long").agg(F.sum("rows"), F.max(F.when(F.col("rows") > 1, F.col("bytes")))).head()
        assert whole[0] == 200 and whole[1] < 16_000_000  # batches on their way to a worker, 40 MB without the bound
    finally:
        spark.conf.unset(key)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", None, "d", "e"]), pa.array(["x" * 600_000, None, "x" * 600_000, "x" * 3_000_000, "x"])], ["path", "raw"])
    assert [b.column(0).to_pylist() for b in doc._pieces([batch, batch.slice(4), batch.slice(5)])] == [["a", "b"], [None], ["d"], ["e"], ["e"], []]


def test_json_text_by_the_fast_writer_is_the_browsers():
    texts = ['[1.0,1e2,-0.0,-0,0.1,1.5e-3]', '[1e-7]', '[1e21,1e20]', '[9007199254740993]', '[123456789012345]', '{"a":NaN}', '[1e400]', '{"\\u00e9":"\\ud83d\\ude00 \\"x","b":[true,null,{}]}']
    for text in texts:
        value, write = jsjson.read(text)
        assert write(value) == jsjson.stringify(json.loads(text)), text
    assert jsjson.read('[0.25,3]')[1] is not jsjson.stringify and jsjson.read('[1e-7]')[1] is jsjson.stringify


def test_a_documents_columns_go_with_its_checksums(spark):
    d = sample.documents(spark).select("*", F.lit(7).cast("bigint").alias("n"), F.array(F.lit("x")).alias("more"))
    rows = doc.checksums(d, ("n", "more")).collect()
    assert len(rows) == 3 and all(r.stored == r.actual and r.n == 7 and r.more == ["x"] for r in rows)


def test_a_subset_makes_each_document_once(spark, tiny):
    plan = document_queries.QUERIES["document_subset"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # sealed, cut, summed; before twice with a join


def test_a_deep_tree_works_boxes_out_a_fixed_number_of_times(spark):
    """Twelve boxes in each other: rows of boxes that are made don't grow with the depth."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(1, i, 0.0, 0.0, 100.0 - i, 100.0 - i, 1.0, 5) for i in range(1, 13)]
    ddl = "shot long, pos long, x double, y double, w double, h double, confidence double, type_no int"
    boxes = spark.createDataFrame(rows, ddl).repartition(1).mapInArrow(counted, ddl)
    lines = [r.line for r in export.tree_lines(boxes).orderBy("path").collect()]
    assert lines == ["  " * (i - 1) + f"container {100 - i}x{100 - i}" for i in range(1, 13)]
    assert made.value <= 8 * len(rows)


def test_ways_in_documents_are_the_fewest_and_of_equal_ones_the_least(spark):
    """Random documents against a walk through all shortest ways; a long line takes no rounds over all documents."""
    rng = random.Random(4)
    made = {f"r{k}": [(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(rng.randrange(4, 24))] for k in range(60)}
    made["line"] = [(f"s{i}", f"s{i + 1}") for i in range(300)] + [("a", "s0"), ("s300", "h"), ("s5", "s2")]
    made["none"] = None
    edge = "struct<doc:struct<stateGraph:struct<edges:array<struct<fromState:string,toState:string>>>>>"
    rows = spark.createDataFrame([(p, ((e,),)) for p, e in made.items()], f"path string, {edge[7:-1].replace('doc:', 'doc ', 1)}")
    want = {}
    for p, e in made.items():
        ways, seen = [["a"]], {"a"}
        while ways and not any(w[-1] == "h" for w in ways):
            ways = [[*w, b] for w in ways for a, b in {*(e or ())} if a == w[-1] and b not in seen]
            seen |= {w[-1] for w in ways}
        if ways:
            want[p] = min(w for w in ways if w[-1] == "h")
    got = {r.path: (r.distance, r.states) for r in doc.path_between(rows, "a", "h").collect()}
    assert got == {p: (len(w) - 1, w) for p, w in want.items()} and got["line"][0] == 302 and len(got) > 20
    assert {(r.distance, *r.states) for r in doc.path_between(rows, "z", "z").collect()} == {(0, "z")}


def test_a_workers_memory_does_not_grow_with_its_batch(spark):
    """The functions that workers run, over one batch with 30 MB of documents: what they hold at a time stays at a few."""

    class Docs:
        sparkSession, dtypes = spark, [("path", "string"), ("raw", "string")]
        select = lambda self, *c: self
        mapInArrow = staticmethod(lambda run, schema: run)

    raw = json.dumps({**sample.document(), "more": ["x" * 1000] * 100})
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(300)]), pa.array([raw] * 300)], ["path", "raw"])
    for work, each in ((doc.checksums, 3), (doc.sealed, 1), (doc.errors, 0)):
        tracemalloc.start()
        try:
            assert sum(b.num_rows for b in work(Docs())(iter([batch]))) == 300 * each
            assert tracemalloc.get_traced_memory()[1] < 12_000_000
        finally:
            tracemalloc.stop()
