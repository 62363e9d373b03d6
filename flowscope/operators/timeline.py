"""Keyframes, slices of a timeline, their merging, and how events explain them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.functions import scoring as sc
from flowscope.operators.folds import fold
from flowscope.operators.joins import interval_join


def keyframes(frames: DataFrame, pct_over: float = 30.0, shortest: int = 50, longest: int = 2000) -> DataFrame:
    """(session, frame_no, ts_ms, reason) from (session, frame_no, ts_ms, changed_pct; the first frame's is null).

    The first and last frame of a session; a frame that changed by more than ``pct_over``; one later than ``longest`` after
    the last keyframe. Frames closer than ``shortest`` to the one before are passed over. The forced ones depend on what
    came out before, hence an ordered fold.
    """

    def step(key, rows):
        last = rows[0]["ts_ms"]
        yield key[0], rows[0]["frame_no"], last, "first"
        for i in range(1, len(rows)):
            r, why = rows[i], None
            if r["ts_ms"] - rows[i - 1]["ts_ms"] >= shortest:
                why = "change" if (r["changed_pct"] or 0.0) > pct_over else "forced" if r["ts_ms"] - last > longest else None
            if why or i == len(rows) - 1:
                last = r["ts_ms"]
                yield key[0], r["frame_no"], last, why or "last"

    cols = frames.select(F.col("session").cast("bigint").alias("session"), "frame_no", F.col("ts_ms").cast("bigint").alias("ts_ms"), "changed_pct")
    return fold(cols, ["session"], ["ts_ms", "frame_no"], step, "session long, frame_no long, ts_ms long, reason string")


def slices(keys: DataFrame, frames: DataFrame) -> DataFrame:
    """(session, start_ms, end_ms, frames, mean_pct): from each keyframe to the next, with the frames between, ends included."""
    w = Window.partitionBy("session").orderBy("ts_ms", "frame_no")
    spans = keys.select("session", F.col("ts_ms").alias("start_ms"), F.lead("ts_ms").over(w).alias("end_ms")).filter("end_ms is not null")
    inside = interval_join(frames.select("session", "ts_ms", "changed_pct"), spans, ["session"], "ts_ms", "start_ms", "end_ms", 5000)
    return inside.groupBy("session", "start_ms", "end_ms").agg(F.count("*").alias("frames"), F.avg(F.coalesce("changed_pct", F.lit(0.0))).alias("mean_pct"))


def segments(events: DataFrame, gap_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """(session, segment, start_ms, end_ms, type, n, confidence, centres): runs of one session's events of one type without a long gap.

    Gaps and islands: a row that differs from or is far from the one before opens a segment. centres holds the places of
    the first three events, confidence comes from the number of events.
    """
    w = Window.partitionBy("session").orderBy("ts_ms", "id")
    new = (F.col("ts_ms") - F.lag("ts_ms").over(w) > gap_ms) | (F.col("type") != F.lag("type").over(w))
    rows = events.withColumn("segment", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("session", "segment").orderBy("ts_ms", "id")))
    at = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", (F.col("x") * 10).alias("x"), F.col("y").alias("y")))))
    out = rows.groupBy("session", "segment").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.first("type").alias("type"), F.count("*").alias("n"), at.alias("centres"))
    return out.withColumn("confidence", sc.slice_confidence(F.col("n") * 2.0, F.col("n"), F.size("centres")))


def candidates(events: DataFrame, spans: DataFrame, before_ms: int, width: int) -> DataFrame:
    """Events from ``before_ms`` before a span's start to its end, by session; with the event's earlier candidates as ``history``."""
    wide = spans.withColumn("from_ms", F.col("start_ms") - before_ms)
    found = interval_join(events, wide, ["session"], "ts_ms", "from_ms", "end_ms", width)
    return found.withColumn("history", F.row_number().over(Window.partitionBy("session", "id").orderBy("segment")) - 1)


def correlated(
    cands: DataFrame, threshold: float = 0.6, near: float = 150.0, keep: tuple[str, ...] = (), x=None, y=None, longest: float = 1000.0
) -> DataFrame:
    """(session, segment, events, confidence): each slice's events that reach the threshold, in order of time; ``keep`` names columns of the slice to go with it.

    An event's place is ``x`` and ``y``, by default 10 x and y. Slices may have ``moving``: with more than two regions, one of
    which moved, they count as animated.

    An accepted event raises the slice's confidence, which is the intensity the next event is judged by: an ordered fold
    over the slice's candidates, as one array. history is known before (see ``candidates``), so slices fold independently.
    """
    pct = F.size("centres") * F.lit(10.0)
    prox = sc.proximity(F.col("centres"), F.col("x") * 10 if x is None else x, F.col("y") if y is None else y, near)
    many_moving = (F.size("centres") > 2) & F.col("moving") if "moving" in cands.columns else F.lit(False)
    rows = cands.withColumns({"pct": pct, "prox": prox, "many_moving": many_moving})
    listed = F.array_sort(F.collect_list(F.struct("ts_ms", "id", "history", "pct", "prox", "many_moving")))
    per = rows.groupBy("session", "segment").agg(F.first("confidence").alias("c0"), *(F.first(c).alias(c) for c in keep), listed.alias("cands"))

    def step(acc, e):
        wait = sc.delay(acc["confidence"])
        kind = sc.correlation_type(acc["confidence"], e["pct"], wait, e["history"], e["many_moving"])
        score = sc.correlation_confidence(wait, e["prox"], e["pct"], kind, longest)
        return F.when(score >= threshold, F.struct(F.greatest(acc["confidence"], score).alias("confidence"), F.concat(acc["events"], F.array(e["id"])).alias("events"))).otherwise(acc)

    start = F.struct(F.col("c0").alias("confidence"), F.array().cast("array<bigint>").alias("events"))
    return per.withColumn("r", F.aggregate("cands", start, step)).select("session", "segment", *keep, "r.events", "r.confidence")


def regions_meet(a, b):
    """Whether any region (x, y, w, h) of one array touches one of the other; null arrays have none."""
    touch = lambda p, q: (p["x"] <= q["x"] + q["w"]) & (q["x"] <= p["x"] + p["w"]) & (p["y"] <= q["y"] + q["h"]) & (q["y"] <= p["y"] + p["h"])
    return F.coalesce(F.exists(a, lambda p: F.exists(b, lambda q: touch(p, q))), F.lit(False))


def merged(spans: DataFrame, shortest: int, apart: float = 0.3) -> DataFrame:
    """Neighbouring slices of a session joined: a gap of at most twice ``shortest``, types equal or one complex, confidences
    within ``apart``, and a common event or, where slices have ``regions``, regions that touch. Only neighbours are compared,
    so running sums of breaks number the groups.

    (session, grp, start_ms, end_ms, type, confidence, slices, events): the type is complex unless all agree, the confidence
    is the mean, events are without repeats. ``regions`` (all) and ``frames`` (without repeats), if slices have them, in order.
    """
    w = Window.partitionBy("session").orderBy("start_ms", "segment")
    p = lambda c: F.lag(c).over(w)
    common = F.coalesce(F.arrays_overlap(F.col("events"), p("events")), F.lit(False))
    if "regions" in spans.columns:
        common = common | regions_meet(F.col("regions"), p("regions"))
    same = (
        (F.col("start_ms") - p("end_ms") <= 2 * shortest) & ((F.col("type") == p("type")) | (F.col("type") == "complex") | (p("type") == "complex"))
        & (F.abs(F.col("confidence") - p("confidence")) <= apart) & common
    )
    rows = spans.withColumn("grp", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    kind = F.when(F.count_distinct("type") == 1, F.min("type")).otherwise("complex")
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "segment", c))), lambda e: e[c]))
    more = [F.array_distinct(in_order("frames")).alias("frames")] * ("frames" in spans.columns) + [in_order("regions").alias("regions")] * ("regions" in spans.columns)
    return rows.groupBy("session", "grp").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), kind.alias("type"), F.avg("confidence").alias("confidence"), F.count("*").alias("slices"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("events")))).alias("events"), *more)


def primary_type(types: DataFrame, keys: list[str], kind: str = "type") -> DataFrame:
    """keys and the most frequent type; complex if several are, none without any."""
    n = types.filter(F.col(kind).isNotNull()).groupBy(*keys, kind).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.max_by(kind, "n").alias("best"), F.max("n").alias("top"), F.collect_list("n").alias("all"))
    found = best.select(*keys, F.when(F.size(F.filter("all", lambda x: x == F.col("top"))) > 1, "complex").otherwise(F.col("best")).alias("primary"))
    return types.select(*keys).distinct().join(found, keys, "left").withColumn("primary", F.coalesce("primary", F.lit("none")))


def statistics(spans: DataFrame) -> DataFrame:
    """One row: slices, sessions, mean duration, most common type (of equal ones the first seen)."""
    kinds = spans.groupBy("type").agg(F.count("*").alias("n"), F.min(F.struct("start_ms", "session", "segment")).alias("first"))
    common = kinds.agg(F.min_by("type", F.struct(-F.col("n"), F.col("first"))).alias("common"))
    return spans.agg(F.count("*").alias("slices"), F.count_distinct("session").alias("sessions"), F.round(F.avg(F.col("end_ms") - F.col("start_ms")), 4).alias("mean_ms")).join(common)


def top_values(rows: DataFrame, value, n: int = 3, width: int = 50) -> DataFrame:
    """The n most frequent values rounded down to ``width``, and how often; of equal ones the lower."""
    return rows.groupBy((F.floor(value / F.lit(width)) * width).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def chains(events: DataFrame, keys: list[str], strict_reference: bool = False) -> DataFrame:
    """One causal chain a key from (ts_ms, id, pct, confidence, delay): trigger, links in time, duration, confidence, and its timing.

    Times count from the trigger. initial_delay: the first link's delay, below 50 instantaneous; settling: the last change
    above 1 %; peak: the first largest change, 0 if nothing changed; animated: three links or more,
    seven tenths of the inner ones between their neighbours. An id of the content, not of the clock.

    Links are numbered and meet their neighbours in one sorted pass a key, which spills; only the id needs a chain's links in
    one row, and isn't made where it isn't asked for.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("ts_ms", "id", "pct", "confidence", "delay")
    rows = events.select(*keys, "ts_ms", "id", "pct", "confidence", "delay").withColumns(
        {"_k": F.row_number().over(w), "_before": F.lag("pct").over(w), "_after": F.lead("pct").over(w), "_n": F.count("*").over(whole), "_top": F.max("pct").over(whole)}
    )
    k, n, at, before, after = F.col("_k"), F.col("_n"), F.col("pct"), F.col("_before"), F.col("_after")
    felt, inner, half = at > 1, (k > 1) & (k < n), F.floor((n - 2) / 2)
    smooth_at = ((before <= at) & (at <= after)) | ((before >= at) & (at >= after))
    accel = (after - 2 * at + before) / F.nullif(F.col("_top"), F.lit(0.0))
    # null if any of the summed is
    total = lambda part: F.when(F.count_if(part & accel.isNull()) == 0, F.coalesce(F.sum(F.when(part, accel)), F.lit(0.0)))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "id", "pct", "confidence", "delay"))), lambda e: e["id"].cast("string"))
    c = rows.groupBy(*keys).agg(
        F.sha2(F.concat_ws(",", ids), 256).alias("chain_id"), F.count("*").alias("n"), F.avg("confidence").alias("mean"),
        F.min(F.struct("ts_ms", "id", "pct", "confidence", "delay")).alias("first"), F.max("ts_ms").alias("last_ms"),
        F.min(F.when(felt, F.col("ts_ms"))).alias("felt_first"), F.max(F.when(felt, F.col("ts_ms"))).alias("felt_last"),
        F.max(F.struct("pct", (-F.col("ts_ms")).alias("back"))).alias("peak"), F.count_if(inner & smooth_at).alias("smooth"),
        total(inner).alias("accel"), total(inner & (k - 1 <= half)).alias("accel_1"), total(inner & (k - 1 > half)).alias("accel_2"),
    )
    n, first, half = F.col("n"), F.col("first"), F.floor((F.col("n") - 2) / 2)
    mean = lambda name, size: F.try_divide(F.col(name), size.cast("double"))
    easing = (
        F.when(n < 5, "linear").when(F.abs(mean("accel", n - 2)) < 0.05, "linear").when(mean("accel", n - 2) > 0.1, "ease-in").when(mean("accel", n - 2) < -0.1, "ease-out")
        .when((mean("accel_1", half) > 0) & (mean("accel_2", n - 2 - half) < 0), "ease-in-out").otherwise("custom")
    )
    some = F.col("felt_last").isNotNull()
    animated = (n >= 3) & F.coalesce(F.try_divide(F.col("smooth").cast("double"), n - 2.0) > 0.7, F.lit(False)) & some
    peak = F.when(F.col("peak.pct") > 0, -F.col("peak.back") - first["ts_ms"]).otherwise(0)
    return c.select(
        *keys, "chain_id", first["id"].alias("trigger"), "n",
        (F.col("last_ms") - first["ts_ms"]).alias("duration"), sc.chain_confidence(F.col("mean"), n, strict_reference).alias("confidence"),
        F.when(some, F.col("felt_last") - first["ts_ms"]).otherwise(0).alias("settling"), peak.alias("peak_ms"),
        first["delay"].alias("initial_delay"), (first["delay"] < 50).alias("instantaneous"),
        animated.alias("animated"), F.when(animated, F.col("felt_last") - F.col("felt_first")).alias("animation_ms"), F.when(animated, easing).alias("easing"),
    )


def history(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Correlations (id, ts_ms, ...) of the ``most`` events that came last; an event comes when its first correlation does."""
    first = rows.groupBy("id").agg(F.min("ts_ms").alias("_first")).orderBy(F.desc("_first"), F.desc("id")).limit(most)
    return rows.join(first.select("id"), "id", "left_semi")


def event_history(rows: DataFrame, event) -> DataFrame:
    """One event's correlations in order of time; none for an unknown one."""
    return rows.filter(F.col("id") == F.lit(event)).orderBy("ts_ms")


def patterns(rows: DataFrame, width: int = 50, most: int = 3) -> DataFrame:
    """One row: the most common delays (rounded down to ``width``) and types of correlations (delay, type, confidence), and their mean confidence, 0 without any."""
    ranked = lambda value, name: rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value"))), lambda e: e["value"]).alias(name))
    mean = rows.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    # three tables of one row each
    return ranked(F.floor(F.col("delay") / width) * width, "delays").join(ranked(F.col("type"), "types")).join(mean)
