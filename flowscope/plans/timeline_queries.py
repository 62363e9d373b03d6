"""Registered queries on timelines, correlations and the buffer."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.functions import scoring as sc
from flowscope.operators import buffer as bf
from flowscope.operators import frames as fr
from flowscope.operators import joins, ranges, timeline as tl
from flowscope.plans import views as v

HOUR = 3600 * 1000
BEFORE = 2 * HOUR


def _changes(s, d):
    first = v.frames(s, d).select("session", "frame_no", "ts_ms")
    pct = fr.metrics(v.frame_pairs(s, d)).select("frame_no", "changed_pct")
    return first.join(pct, "frame_no", "left")


def _segments(s, d):
    return tl.segments(v.events(s, d))


def _candidates(s, d):
    return tl.candidates(v.events(s, d), _segments(s, d).withColumnRenamed("type", "seg_type"), BEFORE, 4 * HOUR)


def _correlated(s, d):
    return tl.correlated(_candidates(s, d), 0.6)


def _slices(s, d):
    # a slice's own events are among its candidates, so none is missing
    return tl.correlated(_candidates(s, d), 0.6, keep=("start_ms", "end_ms", "seg_type", "n", "centres")).withColumnRenamed("seg_type", "type")


def _buffer(s, d):
    return v.table(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("event_id").alias("id"), v.epoch_ms("ts").alias("ts_ms"), F.length("props").alias("bytes"))


def _asof(s, d, join=joins.asof_join):
    e = v.events(s, d)
    return join(e.filter("type = 'purchase'").select("session", "id", "ts_ms"), e.filter("type = 'click'"), ["session"], "ts_ms", "ts_ms", ["id", "x"], "id")


def _nearest(s, d, join=joins.nearest_join):
    e = v.events(s, d)
    return join(e.filter("type = 'error'").select("session", "id", "ts_ms"), e.filter("type = 'view'"), ["session"], "ts_ms", "ts_ms", "id", "id")


def _chain_rows(s, d):
    return v.events(s, d).select("session", "ts_ms", "id", (F.col("y") / 10).alias("pct"), (F.col("x") / 100).alias("confidence"), sc.delay(F.col("x") / 100).alias("delay"))


def _with_regions(s, d):
    """Slices whose regions are boxes of 40 x 40 at their events' places, and whose frames are their events."""
    box = lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.lit(40.0).alias("w"), F.lit(40.0).alias("h"))
    return _slices(s, d).withColumns({"regions": F.transform("centres", box), "frames": F.transform("centres", lambda c: F.floor(c["x"] / 100).cast("bigint"))})


def _history(s, d):
    e = v.events(s, d)
    return tl.history(e.select((F.col("id") % 997).alias("id"), "ts_ms", sc.delay(F.col("x") / 100).cast("bigint").alias("delay"), "type", (F.col("x") / 100).alias("confidence")), 100)


QUERIES = {
    "keyframes": lambda s, d: tl.keyframes(_changes(s, d)).select("session", "frame_no", "reason"),
    "keyframe_slices": lambda s, d: tl.slices(tl.keyframes(_changes(s, d)), _changes(s, d)).select("session", "start_ms", "end_ms", "frames", F.round("mean_pct", 5).alias("mean_pct"), F.round(sc.slice_confidence(F.col("mean_pct"), F.col("frames"), F.lit(0)), 6).alias("confidence")),
    "event_segments": lambda s, d: _segments(s, d).select("session", "segment", "start_ms", "end_ms", "type", "n", F.round("confidence", 6).alias("confidence")),
    "event_slice_candidates": lambda s, d: _candidates(s, d).select("session", "id", "segment", F.col("history").cast("bigint").alias("history")),
    "event_slice_correlation": lambda s, d: _correlated(s, d).select("session", "segment", F.array_join("events", ",").alias("events"), F.round("confidence", 6).alias("confidence")),
    "merged_slices": lambda s, d: tl.merged(_slices(s, d), 30 * 60 * 1000).select("session", "start_ms", "end_ms", "type", F.round("confidence", 6).alias("confidence"), "slices", F.array_join("events", ",").alias("events")),
    "strong_slices": lambda s, d: tl.merged(_slices(s, d), 30 * 60 * 1000).filter("confidence >= 0.7").groupBy("type").agg(F.count("*").alias("n")),
    "slice_statistics": lambda s, d: tl.statistics(_segments(s, d)),
    "primary_types": lambda s, d: tl.primary_type(v.events(s, d).select("session", "type"), ["session"]),
    "common_delays": lambda s, d: tl.top_values(v.events(s, d), F.col("y")),
    "common_types": lambda s, d: v.events(s, d).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x") / 100), 6).alias("confidence")).orderBy(F.desc("n"), "type").limit(3),
    "causal_chains": lambda s, d: (lambda c: c.select("session", "chain_id", "trigger", "n", "duration", F.round("confidence", 6).alias("confidence"), "settling", "peak_ms", "initial_delay", "instantaneous", "animated", F.coalesce("animation_ms", F.lit(-1)).alias("animation_ms"), F.coalesce("easing", F.lit("")).alias("easing")))(tl.chains(_chain_rows(s, d).withColumn("part", F.floor(F.col("ts_ms") / (6 * HOUR))), ["session", "part"])),
    "merged_by_regions": lambda s, d: tl.merged(_with_regions(s, d), 30 * 60 * 1000).select("session", "start_ms", "end_ms", "type", F.round("confidence", 6).alias("confidence"), "slices", F.array_join("events", ",").alias("events"), F.size("regions").cast("bigint").alias("regions"), F.array_join("frames", ",").alias("frames")),
    "correlation_history": lambda s, d: _history(s, d).groupBy("id").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ms")),
    "correlation_patterns": lambda s, d: tl.patterns(_history(s, d)).select(F.array_join("delays", ",").alias("delays"), F.array_join("types", ",").alias("types"), F.round("confidence", 6).alias("confidence")),
    "asof_click": lambda s, d: _asof(s, d).select("session", "id", F.coalesce("asof_id", F.lit(-1)).alias("click"), F.coalesce("asof_x", F.lit(-1.0)).alias("x")),
    "nearest_view": lambda s, d: _nearest(s, d).select("session", "id", F.coalesce("nearest_id", F.lit(-1)).alias("view")),
    "asof_click_by_ranges": lambda s, d: _asof(s, d, ranges.asof_join).select(
        "session", "id", F.coalesce("asof_id", F.lit(-1)).alias("click"), F.coalesce("asof_x", F.lit(-1.0)).alias("x")
    ),
    "nearest_view_by_ranges": lambda s, d: _nearest(s, d, ranges.nearest_join).select("session", "id", F.coalesce("nearest_id", F.lit(-1)).alias("view")),
    "capture_rates_by_ranges": lambda s, d: ranges.rates(_buffer(s, d)).select(
        "session", "pos", F.round(F.coalesce("fps", F.lit(-1.0)), 8).alias("fps"), F.round(F.coalesce("peak", F.lit(-1.0)), 8).alias("peak")
    ),
    "buffer_range": lambda s, d: bf.in_range(_buffer(s, d), 1704100000000, 1704400000000).select("session", "id", "ts_ms"),
    "buffer_not_older": lambda s, d: bf.not_older(_buffer(s, d), 1704400000000).groupBy("session").agg(F.count("*").alias("n")),
    "buffer_recent": lambda s, d: bf.recent(_buffer(s, d), 5).select("session", "id"),
    "buffer_export": lambda s, d: bf.exported(_buffer(s, d), 2, 6).select("session", "id"),
    "buffers_cleared": lambda s, d: bf.cleared(bf.recent(_buffer(s, d), 12)),
    "buffer_statistics": lambda s, d: bf.statistics(_buffer(s, d), 50),
    "buffer_snapshot": lambda s, d: bf.snapshot(bf.recent(_buffer(s, d), 8)).select("session", "n", "bytes", "first_ms", "last_ms", F.array_join("ids", ",").alias("ids")),
    "capture_rates": lambda s, d: bf.rates(_buffer(s, d)).select("session", "pos", F.round(F.coalesce("fps", F.lit(-1.0)), 8).alias("fps"), F.round(F.coalesce("peak", F.lit(-1.0)), 8).alias("peak")),
    "capture_progress": lambda s, d: bf.progress(_buffer(s, d), 20).select("session", "frames", "elapsed_ms", F.round("fps", 9).alias("fps")),
    "capture_slow": lambda s, d: bf.slow(v.events(s, d).select("id", F.col("y").alias("actual"), F.col("x").alias("expected"))).select("id", F.round(F.coalesce("ratio", F.lit(-1.0)), 6).alias("ratio")),
    "capture_metrics": lambda s, d: bf.capture_metrics(_buffer(s, d), HOUR).select("session", "frames", F.round("seconds", 3).alias("seconds"), "fps", "dropped"),
}

_E = f"WITH RECURSIVE {v.EVENT_SQL}"
_KEY = f"""WITH RECURSIVE {v.PAIR_SQL},
ch AS (SELECT f.session, f.frame_no, f.ts_ms, 100.0::DOUBLE * len(list_filter(list_zip(p.px, p.prev_px), lambda z: abs(z[1] - z[2]) > 25)) / 64 AS pct,
       row_number() OVER (PARTITION BY f.session ORDER BY f.ts_ms, f.frame_no) AS k, count(*) OVER (PARTITION BY f.session) AS n FROM v_frame f LEFT JOIN v_pair p USING (frame_no)),
kf(session, k, n, frame_no, ts_ms, last, reason) AS (SELECT session, k, n, frame_no, ts_ms, ts_ms, 'first' FROM ch WHERE k = 1
  UNION ALL SELECT session, k, n, frame_no, ts_ms, CASE WHEN why IS NULL THEN last ELSE ts_ms END, why FROM (
    SELECT c.session, c.k, c.n, c.frame_no, c.ts_ms, f.last, coalesce(CASE WHEN c.ts_ms - f.ts_ms >= 50 THEN CASE WHEN c.pct > 30 THEN 'change' WHEN c.ts_ms - f.last > 2000 THEN 'forced' END END, CASE WHEN c.k = c.n THEN 'last' END) AS why
    FROM kf f JOIN ch c ON c.session = f.session AND c.k = f.k + 1))"""
_SEG = f"""{_E}, a AS (SELECT *, CASE WHEN lag(ts_ms) OVER w IS NULL OR ts_ms - lag(ts_ms) OVER w > 21600000 OR type <> lag(type) OVER w THEN 1 ELSE 0 END AS new FROM v_event WINDOW w AS (PARTITION BY session ORDER BY ts_ms, id)),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session ORDER BY ts_ms, id) AS BIGINT) AS segment FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY session, segment ORDER BY ts_ms, id) AS k FROM b),
seg AS (SELECT session, segment, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, min(type) AS type, count(*) AS n, list({{'x': x * 10, 'y': y}} ORDER BY k) FILTER (k <= 3) AS centres,
        least(1, least(count(*) * 2.0::DOUBLE / 10, 1) * 0.5::DOUBLE + least(count(*) / 30.0::DOUBLE, 1) * 0.3::DOUBLE + least(least(count(*), 3) / 5.0::DOUBLE, 1) * 0.2::DOUBLE) AS confidence FROM c GROUP BY 1, 2),
cand AS (SELECT e.session, e.id, e.ts_ms, segment, row_number() OVER (PARTITION BY e.session, e.id ORDER BY segment) - 1 AS history, confidence, len(centres) * 10.0::DOUBLE AS pct,
         greatest(0.0, 1 - list_min(list_transform(centres, lambda p: sqrt((p.x - e.x * 10) * (p.x - e.x * 10) + (p.y - e.y) * (p.y - e.y)))) / 150.0::DOUBLE) AS prox
         FROM v_event e JOIN seg s ON e.session = s.session AND e.ts_ms >= s.start_ms - 7200000 AND e.ts_ms <= s.end_ms)"""
_COR = f"""{_SEG}, o AS (SELECT *, row_number() OVER (PARTITION BY session, segment ORDER BY ts_ms, id) AS k, count(*) OVER (PARTITION BY session, segment) AS n FROM cand),
fold(session, segment, k, n, c, ev) AS (SELECT session, segment, CAST(0 AS BIGINT), n, confidence, CAST([] AS BIGINT[]) FROM o WHERE k = 1
  UNION ALL SELECT session, segment, k, n, CASE WHEN score >= 0.6 THEN greatest(c, score) ELSE c END, CASE WHEN score >= 0.6 THEN list_append(ev, id) ELSE ev END FROM (
   SELECT session, segment, k, n, c, ev, id, least(1, 0.3::DOUBLE * greatest(0, 1 - delay / 1000.0::DOUBLE) + 0.3::DOUBLE * prox + 0.2::DOUBLE * least(pct / 10, 1) + 0.2::DOUBLE *
     CASE WHEN delay < 50 THEN 1.0::DOUBLE WHEN c > 0.3 AND c < 0.7 THEN 0.9 WHEN history > 1 THEN 0.8 WHEN pct < 1 THEN 0.3 ELSE 1.0 END) AS score
   FROM (SELECT f.session, f.segment, o.k, f.n, f.c, f.ev, o.id, o.prox, o.pct, o.history, CASE WHEN f.c > 0.8 THEN 0 WHEN f.c > 0.5 THEN 100 ELSE 300 END AS delay
         FROM fold f JOIN o ON o.session = f.session AND o.segment = f.segment AND o.k = f.k + 1))),
cor AS (SELECT session, segment, c AS confidence, ev FROM fold WHERE k = n)"""
_MERGED = f"""{_COR}, sl AS (SELECT seg.session, segment, start_ms, end_ms, type, cor.confidence, ev FROM seg JOIN cor USING (session, segment)),
m AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w <= 3600000 AND (type = lag(type) OVER w) AND abs(confidence - lag(confidence) OVER w) <= 0.3 AND list_has_any(ev, lag(ev) OVER w) THEN 0 ELSE 1 END AS new FROM sl WINDOW w AS (PARTITION BY session ORDER BY start_ms, segment)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY start_ms, segment) AS grp FROM m),
mg AS (SELECT session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CASE WHEN count(DISTINCT type) = 1 THEN min(type) ELSE 'complex' END AS type, avg(confidence) AS confidence, count(*) AS slices, array_to_string(list_sort(list_distinct(flatten(list(ev)))), ',') AS events FROM g GROUP BY session, grp)"""
_BUF = "WITH buf AS (SELECT user_id AS session, event_id AS pos, event_id AS id, epoch_us(ts) // 1000 AS ts_ms, length(props) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events)"
_CHAIN = f"""{_E}, r AS (SELECT session, ts_ms // 21600000 AS part, list({{'t': ts_ms, 'id': id, 'p': y / 10, 'c': x / 100}} ORDER BY ts_ms, id) AS l, avg(x / 100) AS mean FROM v_event GROUP BY 1, 2),
q AS (SELECT *, len(l) AS n, list_transform(l, lambda e: e.p) AS p, list_filter(l, lambda e: e.p > 1) AS felt FROM r),
z AS (SELECT *, list_max(p) AS top, n >= 3 AND len(list_filter(range(2, n), lambda i: (p[i - 1] <= p[i] AND p[i] <= p[i + 1]) OR (p[i - 1] >= p[i] AND p[i] >= p[i + 1]))) / (n - 2.0::DOUBLE) > 0.7 AS smooth,
      list_transform(range(2, n), lambda i: (p[i + 1] - 2 * p[i] + p[i - 1]) / list_max(p)) AS acc FROM q),
y AS (SELECT *, smooth AND len(felt) > 0 AS anim, list_avg(acc) AS am, list_avg(acc[1:len(acc) // 2]) AS a1, list_avg(acc[len(acc) // 2 + 1:]) AS a2 FROM z)"""
ORACLE = {
    "keyframes": f"{_KEY} SELECT session, frame_no, reason FROM kf WHERE reason IS NOT NULL",
    "keyframe_slices": f"""{_KEY}, sp AS (SELECT session, ts_ms AS start_ms, lead(ts_ms) OVER (PARTITION BY session ORDER BY ts_ms, frame_no) AS end_ms FROM kf WHERE reason IS NOT NULL),
x AS (SELECT sp.session, start_ms, end_ms, count(*) AS frames, avg(coalesce(pct, 0)) AS mp FROM sp JOIN ch ON ch.session = sp.session AND ch.ts_ms BETWEEN start_ms AND end_ms GROUP BY 1, 2, 3)
SELECT session, start_ms, end_ms, frames, round(mp, 5) AS mean_pct, round(least(1, least(mp / 10, 1) * 0.5::DOUBLE + least(frames / 30.0::DOUBLE, 1) * 0.3::DOUBLE), 6) AS confidence FROM x""",
    "event_segments": f"{_SEG} SELECT session, segment, start_ms, end_ms, type, n, round(confidence, 6) AS confidence FROM seg",
    "event_slice_candidates": f"{_SEG} SELECT session, id, segment, history FROM cand",
    "event_slice_correlation": f"{_COR} SELECT session, segment, array_to_string(ev, ',') AS events, round(confidence, 6) AS confidence FROM cor",
    "merged_slices": f"{_MERGED} SELECT session, start_ms, end_ms, type, round(confidence, 6) AS confidence, slices, events FROM mg",
    "strong_slices": f"{_MERGED} SELECT type, count(*) AS n FROM mg WHERE confidence >= 0.7 GROUP BY type",
    "slice_statistics": f"""{_SEG}, t AS (SELECT type, count(*) AS n, min((start_ms, session, segment)) AS f FROM seg GROUP BY type)
SELECT count(*) AS slices, count(DISTINCT session) AS sessions, round(avg(end_ms - start_ms), 4) AS mean_ms, (SELECT type FROM t ORDER BY n DESC, f LIMIT 1) AS common FROM seg""",
    "merged_by_regions": f"""{_COR}, sl AS (SELECT seg.session, segment, start_ms, end_ms, type, cor.confidence, ev, centres FROM seg JOIN cor USING (session, segment)),
m AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w <= 3600000 AND (type = lag(type) OVER w) AND abs(confidence - lag(confidence) OVER w) <= 0.3
  AND (list_has_any(ev, lag(ev) OVER w) OR len(list_filter(centres, lambda p: len(list_filter(lag(centres) OVER w, lambda q: abs(p.x - q.x) <= 40 AND abs(p.y - q.y) <= 40)) > 0)) > 0) THEN 0 ELSE 1 END AS new FROM sl WINDOW w AS (PARTITION BY session ORDER BY start_ms, segment)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY start_ms, segment) AS grp FROM m),
fr AS (SELECT session, grp, frame, min((start_ms, segment, i)) AS first FROM (SELECT session, grp, start_ms, segment, unnest(range(1, len(centres) + 1)) AS i, CAST(floor(unnest(centres).x / 100) AS BIGINT) AS frame FROM g) GROUP BY 1, 2, 3)
SELECT session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CASE WHEN count(DISTINCT type) = 1 THEN min(type) ELSE 'complex' END AS type, round(avg(confidence), 6) AS confidence, count(*) AS slices, array_to_string(list_sort(list_distinct(flatten(list(ev)))), ',') AS events,
 CAST(sum(len(centres)) AS BIGINT) AS regions, any_value(f) AS frames FROM g JOIN (SELECT session, grp, string_agg(CAST(frame AS VARCHAR), ',' ORDER BY first) AS f FROM fr GROUP BY 1, 2) USING (session, grp) GROUP BY session, grp""",
    "correlation_history": f"{_E}, h AS (SELECT id % 997 AS id, ts_ms FROM v_event), k AS (SELECT id FROM h GROUP BY id ORDER BY min(ts_ms) DESC, id DESC LIMIT 100) SELECT id, count(*) AS n, max(ts_ms) AS last_ms FROM h WHERE id IN (SELECT id FROM k) GROUP BY id",
    "correlation_patterns": f"""{_E}, h AS (SELECT id % 997 AS id, ts_ms, type, x / 100 AS c, CASE WHEN x / 100 > 0.8 THEN 0 WHEN x / 100 > 0.5 THEN 100 ELSE 300 END AS delay FROM v_event), k AS (SELECT id FROM h GROUP BY id ORDER BY min(ts_ms) DESC, id DESC LIMIT 100),
r AS (SELECT * FROM h WHERE id IN (SELECT id FROM k)), d AS (SELECT delay // 50 * 50 AS value, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, value LIMIT 3), t AS (SELECT type AS value, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, value LIMIT 3)
SELECT (SELECT string_agg(CAST(value AS VARCHAR), ',' ORDER BY n DESC, value) FROM d) AS delays, (SELECT string_agg(value, ',' ORDER BY n DESC, value) FROM t) AS types, (SELECT round(avg(c), 6) FROM r) AS confidence""",
    "primary_types": f"""{_E}, n AS (SELECT session, type, count(*) AS n FROM v_event GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY session ORDER BY n DESC) AS k FROM n)
SELECT session, CASE WHEN count(*) > 1 THEN 'complex' ELSE min(type) END AS primary FROM r WHERE k = 1 GROUP BY session""",
    "common_delays": f"{_E} SELECT CAST(floor(y / 50) * 50 AS BIGINT) AS value, count(*) AS n FROM v_event GROUP BY 1 ORDER BY n DESC, value LIMIT 3",
    "common_types": f"{_E} SELECT type, count(*) AS n, round(avg(x / 100), 6) AS confidence FROM v_event GROUP BY 1 ORDER BY n DESC, type LIMIT 3",
    "causal_chains": f"""{_CHAIN} SELECT session, sha256(array_to_string(list_transform(l, lambda e: e.id), ',')) AS chain_id, l[1].id AS trigger, n, l[n].t - l[1].t AS duration,
 round(mean * greatest(0, least(1, 1 - (n - 5) * 0.1::DOUBLE)), 6) AS confidence, CASE WHEN len(felt) > 0 THEN felt[len(felt)].t - l[1].t ELSE 0 END AS settling,
 CASE WHEN top > 0 THEN list_filter(l, lambda e: e.p = top)[1].t - l[1].t ELSE 0 END AS peak_ms, CASE WHEN l[1].c > 0.8 THEN 0 WHEN l[1].c > 0.5 THEN 100 ELSE 300 END AS initial_delay, l[1].c > 0.8 AS instantaneous, anim AS animated, CASE WHEN anim THEN felt[len(felt)].t - felt[1].t ELSE -1 END AS animation_ms,
 CASE WHEN NOT anim THEN '' WHEN n < 5 OR abs(am) < 0.05 THEN 'linear' WHEN am > 0.1 THEN 'ease-in' WHEN am < -0.1 THEN 'ease-out' WHEN a1 > 0 AND a2 < 0 THEN 'ease-in-out' ELSE 'custom' END AS easing FROM y""",
    "asof_click": f"{_E} SELECT p.session, p.id, coalesce(c.id, -1) AS click, coalesce(c.x, -1) AS x FROM (SELECT * FROM v_event WHERE type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM v_event WHERE type = 'click') c ON p.session = c.session AND p.ts_ms >= c.ts_ms",
    "nearest_view": f"""{_E} SELECT session, id, coalesce(w, -1) AS view FROM (SELECT e.session, e.id, v.id AS w, row_number() OVER (PARTITION BY e.session, e.id ORDER BY abs(v.ts_ms - e.ts_ms), v.id) AS k
 FROM v_event e LEFT JOIN v_event v ON v.session = e.session AND v.type = 'view' WHERE e.type = 'error') WHERE k = 1""",
    "buffer_range": f"{_BUF} SELECT session, id, ts_ms FROM buf WHERE ts_ms BETWEEN 1704100000000 AND 1704400000000",
    "buffer_not_older": f"{_BUF} SELECT session, count(*) AS n FROM buf WHERE ts_ms >= 1704400000000 GROUP BY 1",
    "buffer_recent": f"{_BUF} SELECT session, id FROM buf WHERE back <= 5",
    "buffer_export": f"{_BUF} SELECT session, id FROM buf WHERE place >= 2 AND place < 6",
    "buffer_statistics": f"""{_BUF} SELECT session, count(*) FILTER (back <= 50) AS held, min(ts_ms) FILTER (back <= 50) AS oldest, max(ts_ms) FILTER (back <= 50) AS newest, CAST(sum(bytes) FILTER (back <= 50) AS BIGINT) AS bytes,
 round(avg(bytes) FILTER (back <= 50), 4) AS mean_bytes, greatest(count(*) - 50, 0) AS dropped FROM buf GROUP BY session""",
    "buffer_snapshot": f"{_BUF} SELECT session, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, arg_min(ts_ms, pos) AS first_ms, arg_max(ts_ms, pos) AS last_ms, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids FROM buf WHERE back <= 8 GROUP BY session",
    "capture_rates": f"""{_BUF}, f AS (SELECT session, pos, ts_ms, 1000.0::DOUBLE / nullif(ts_ms - lag(ts_ms) OVER (PARTITION BY session ORDER BY ts_ms, pos), 0) AS fps FROM buf)
SELECT session, pos, round(coalesce(fps, -1), 8) AS fps, round(coalesce(max(fps) OVER (PARTITION BY session ORDER BY ts_ms, pos ROWS UNBOUNDED PRECEDING), -1), 8) AS peak FROM f""",
    "capture_progress": f"""{_BUF}, f AS (SELECT session, row_number() OVER w AS frames, ts_ms - min(ts_ms) OVER (PARTITION BY session) AS elapsed_ms FROM buf WINDOW w AS (PARTITION BY session ORDER BY ts_ms, pos))
SELECT session, frames, elapsed_ms, round(coalesce(frames * 1000.0::DOUBLE / nullif(elapsed_ms, 0), 0), 9) AS fps FROM f WHERE frames % 20 = 0""",
    "capture_slow": f"{_E} SELECT id, round(coalesce(y / nullif(x, 0), -1), 6) AS ratio FROM v_event WHERE y > 1.5 * x",
    "capture_metrics": f"""{_BUF}, f AS (SELECT session, ts_ms, ts_ms - lag(ts_ms) OVER (PARTITION BY session ORDER BY ts_ms, pos) AS gap FROM buf)
SELECT session, count(*) AS frames, round((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE, 3) AS seconds, round(coalesce(count(*) / nullif((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE, 0), 0), 6) AS fps, count(*) FILTER (gap > 7200000) AS dropped FROM f GROUP BY session""",
}
ORACLE |= {f"{name}_by_ranges": ORACLE[name] for name in ("asof_click", "nearest_view", "capture_rates")}
ORACLE["buffers_cleared"] = f"{_BUF} SELECT session, count(*) AS dropped FROM buf WHERE back <= 12 GROUP BY 1"
