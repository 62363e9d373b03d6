"""The whole analysis of recorded sessions: keyframes cut a session's frames into slices; what changed between a slice's first
and last frame gives its regions, type and confidence; events are correlated with the slices, neighbours are merged, weak
slices go, and what is left explains its events as one causal chain a session.

Every step is keyed by the session, so sessions of one table don't mix. A session of one frame has no slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.functions import scoring as sc
from flowscope.operators import frames as fr
from flowscope.operators import timeline as tl


def framed(keys: DataFrame, frames: DataFrame) -> DataFrame:
    """(session, segment, start_ms, end_ms, start_no, end_no, frames): from each keyframe to the next, both among the frames.

    A running count of keyframes numbers the slices; a keyframe ends one slice and begins the next.
    """
    marked = frames.select("session", "frame_no", "ts_ms").join(keys.select("session", "frame_no", F.lit(1).alias("key")), ["session", "frame_no"], "left")
    w = Window.partitionBy("session").orderBy("ts_ms", "frame_no")
    rows = marked.withColumn("at", F.sum(F.coalesce("key", F.lit(0))).over(w))
    both = F.when((F.col("key") == 1) & (F.col("at") > 1), F.array(F.col("at") - 1, F.col("at"))).otherwise(F.array("at"))
    held = F.array_sort(F.collect_list(F.struct("ts_ms", "frame_no")))
    out = rows.withColumn("segment", F.explode(both)).groupBy("session", "segment").agg(held.alias("f")).filter(F.size("f") > 1)
    first, last = F.get("f", F.lit(0)), F.get("f", F.size("f") - 1)
    return out.select(
        "session", "segment", first["ts_ms"].alias("start_ms"), last["ts_ms"].alias("end_ms"),
        first["frame_no"].alias("start_no"), last["frame_no"].alias("end_no"), F.transform("f", lambda x: x["frame_no"]).alias("frames"),
    )


def end_pairs(spans: DataFrame, frames: DataFrame, planes=fr.GREY) -> DataFrame:
    """Each slice's first frame as the planes prev_*, and its last frame; frame_no is the slice's number."""
    names = list(dict.fromkeys(("px", *planes)))
    first = frames.select("session", F.col("frame_no").alias("start_no"), *(F.col(p).alias(fr.before(p)) for p in names))
    last = frames.select("session", F.col("frame_no").alias("end_no"), *names)
    rows = spans.select("session", "segment", "start_no", "end_no").join(first, ["session", "start_no"]).join(last, ["session", "end_no"])
    return rows.withColumnRenamed("segment", "frame_no")


def main_kind(kinds):
    """The most frequent of an array of types: complex if several are, none without any."""
    each = F.array_distinct(kinds)
    n = F.transform(each, lambda k: F.struct(F.size(F.filter(kinds, lambda x: x == k)).alias("n"), k.alias("kind")))
    best = F.filter(n, lambda x: x["n"] == F.array_max(n)["n"])
    return F.when(F.size(kinds) == 0, "none").when(F.size(best) > 1, "complex").otherwise(F.get(best, F.lit(0))["kind"])


def described(spans: DataFrame, frames: DataFrame, threshold: int = 25, side: int = fr.SIDE, planes=fr.GREY, **found) -> DataFrame:
    """The slices with what changed from their first to their last frame: regions (x, y, w, h, kind), their centres, whether one
    moved, the type that most regions have, and the confidence. ``found`` goes to ``frames.regions``.
    """
    pairs = end_pairs(spans, frames, planes)
    regions = fr.regions(pairs, threshold, side=side, planes=planes, **found)
    listed = F.array_sort(F.collect_list(F.struct("region", "x", "y", "w", "h", "kind")))
    regions = regions.groupBy("session", F.col("frame_no").alias("segment")).agg(listed.alias("regions"))
    changed = 100.0 * F.size(F.filter(fr.changed(threshold), lambda x: x > 0)) / F.size("px")
    pct = pairs.select("session", F.col("frame_no").alias("segment"), changed.alias("pct"))
    kind = "array<struct<region:bigint,x:bigint,y:bigint,w:bigint,h:bigint,kind:string>>"
    rows = spans.join(pct, ["session", "segment"]).join(regions, ["session", "segment"], "left")
    rows = rows.withColumn("regions", F.coalesce("regions", F.array().cast(kind)))
    centre = lambda r: F.struct((r["x"] + r["w"] / 2).alias("x"), (r["y"] + r["h"] / 2).alias("y"))
    return rows.select(
        "*", F.transform("regions", centre).alias("centres"), F.exists("regions", lambda r: r["kind"] == "movement").alias("moving"),
        main_kind(F.transform("regions", lambda r: r["kind"])).alias("type"),
        sc.slice_confidence(F.col("pct"), F.size("frames"), F.size("regions")).alias("confidence"),
    )


def with_events(spans: DataFrame, events: DataFrame, before_ms: int, threshold: float, near: float, longest_delay: float, width: int | None = None):
    """(slices with the ``events`` that they explain and the confidence that those give them, number of judgements by event)."""
    own = spans.select("session", "segment", "start_ms", "end_ms", "confidence", "centres", "moving")
    cands = tl.candidates(events.select("session", "id", "ts_ms", "x", "y"), own, before_ms, width or max(2 * before_ms, 1))
    found = tl.correlated(cands, threshold, near, x=F.col("x"), y=F.col("y"), longest=longest_delay)
    rows = spans.withColumnRenamed("confidence", "own").join(found, ["session", "segment"], "left")
    none = F.array().cast("array<bigint>")
    rows = rows.withColumns({"events": F.coalesce("events", none), "confidence": F.coalesce("confidence", "own")}).drop("own")
    return rows, cands.groupBy("session", "id").agg(F.count("*").alias("judged"))


def chain_links(spans: DataFrame, judged: DataFrame, events: DataFrame, near: float, longest_delay: float) -> DataFrame:
    """(session, ts_ms, id, pct, confidence, delay) of each event of each slice, judged once more by the slice it ended in."""
    places = F.transform("regions", lambda r: F.struct((r["x"] + r["w"] / 2).alias("x"), (r["y"] + r["h"] / 2).alias("y")))
    many = (F.size("regions") > 2) & F.exists("regions", lambda r: r["kind"] == "movement")
    own = F.array_distinct(places).alias("centres"), (F.size("regions") * F.lit(10.0)).alias("pct"), many.alias("moving")
    rows = spans.select("session", "grp", "start_ms", "confidence", "events", *own).withColumn("id", F.explode("events")).drop("events")
    rows = rows.join(events.select("session", "id", "ts_ms", "x", "y"), ["session", "id"]).join(judged, ["session", "id"])
    earlier = F.row_number().over(Window.partitionBy("session", "id").orderBy("start_ms", "grp")) - 1
    pct, wait = F.col("pct"), sc.delay(F.col("confidence"))
    kind = sc.correlation_type(F.col("confidence"), pct, wait, F.col("judged") + earlier, F.col("moving"))
    score = sc.correlation_confidence(wait, sc.proximity(F.col("centres"), F.col("x"), F.col("y"), near), pct, kind, longest_delay)
    return rows.withColumn("score", score).select("session", "ts_ms", "id", "pct", F.col("score").alias("confidence"), wait.alias("delay"))


def statistics(frames: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """(session, frames, events, slices, mean_ms, common): counts, mean duration and the commonest type, of equal ones the first seen."""
    kinds = spans.groupBy("session", "type").agg(F.count("*").alias("n"), F.min(F.struct("start_ms", "grp")).alias("first"))
    common = kinds.groupBy("session").agg(F.min_by("type", F.struct(-F.col("n"), F.col("first"))).alias("common"))
    whole = spans.groupBy("session").agg(F.count("*").alias("slices"), F.avg(F.col("end_ms") - F.col("start_ms")).alias("mean_ms"))
    count = lambda df, name: df.groupBy("session").agg(F.count("*").alias(name))
    rows = count(frames, "frames").join(count(events, "events"), "session", "left").join(whole, "session", "left").join(common, "session", "left")
    return rows.fillna(0, ["events", "slices"]).fillna(0.0, ["mean_ms"]).fillna("none", ["common"])
