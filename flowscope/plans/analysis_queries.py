"""The whole analysis of sessions as registered queries: slices, their regions and events, chains, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope import session
from flowscope.plans import frame_queries as fq
from flowscope.plans import timeline_queries as tq
from flowscope.plans import views as v

#: Frames change by half or so, and a session has one in a second.
SETTINGS = {"pct_over": 45.0, "shortest": 600, "longest": 5000, "threshold": 0.7, "near": 100.0, "reach": 4, "step": 1}


def _analysis(s, d):
    return session.create("timeline", **SETTINGS).analyze(v.frame_pairs(s, d), v.frames(s, d), v.clicks(s, d))


def _slices(s, d):
    return _analysis(s, d)["slices"].select(
        "session", "segment", "start_ms", "end_ms", F.array_join("frames", ",").alias("frames"), F.round("pct", 6).alias("pct"), "type", "moving",
        F.array_join(F.transform("regions", lambda r: F.concat_ws(" ", r["x"], r["y"], r["w"], r["h"], r["kind"])), ",").alias("regions"),
        F.round("confidence", 6).alias("confidence"),
    )


def _correlated(s, d):
    return _analysis(s, d)["correlations"].select("session", "segment", F.array_join("events", ",").alias("events"), F.round("confidence", 6).alias("confidence"))


def _merged(s, d):
    return _analysis(s, d)["merged"].select(
        "session", "start_ms", "end_ms", "type", "slices", F.array_join("events", ",").alias("events"), F.array_join("frames", ",").alias("frames"),
        F.size("regions").cast("bigint").alias("regions"), F.round("confidence", 6).alias("confidence"),
    )


def _chains(s, d):
    return _analysis(s, d)["chains"].select(
        "session", "trigger", "n", "duration", F.round("confidence", 6).alias("confidence"), "settling", "peak_ms", "initial_delay", "instantaneous", "animated",
    )


def _statistics(s, d):
    return _analysis(s, d)["statistics"].withColumn("mean_ms", F.round("mean_ms", 4))


QUERIES = {
    "timeline_analysis": _merged,
    "timeline_slices": _slices,
    "timeline_correlation": _correlated,
    "timeline_chains": _chains,
    "timeline_statistics": _statistics,
}

# keyframes as the settings ask for them, and the frames from each to the next
_KEY = tq._KEY.replace("c.pct > 30", "c.pct > 45").replace("f.last > 2000", "f.last > 5000").replace("f.ts_ms >= 50", "f.ts_ms >= 600")
# kinds of the regions between a slice's first and last frame; a slice goes by its first frame's number, which is its own
_KIND = fq._KIND.replace("{P}", "WITH RECURSIVE v_pair AS (SELECT * FROM ends)").replace("{DIFF}", fq._DIFF)
_KIND = _KIND.replace("SELECT session, frame_no, region, CASE", "SELECT session, frame_no, region, x, y, w, h, CASE")
_SLICES = f"""{_KEY}, {v.CLICK_SQL},
seq AS (SELECT session, frame_no, ts_ms, k, reason IS NOT NULL AS key, sum(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY k) AS seg FROM kf),
mem AS (SELECT session, seg AS segment, frame_no, k, ts_ms FROM seq UNION ALL SELECT session, seg - 1, frame_no, k, ts_ms FROM seq WHERE key AND seg > 1),
sp AS (SELECT session, segment, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, arg_min(frame_no, k) AS start_no, arg_max(frame_no, k) AS end_no,
  list(frame_no ORDER BY k) AS frames FROM mem GROUP BY 1, 2 HAVING count(*) > 1),
ends AS (SELECT sp.session, start_no AS frame_no, b.px, a.px AS prev_px FROM sp JOIN v_frame a ON a.frame_no = start_no JOIN v_frame b ON b.frame_no = end_no),
found AS ({_KIND}),
reg AS (SELECT frame_no, list({{'x': x, 'y': y, 'w': w, 'h': h, 'kind': kind}} ORDER BY region) AS regions, bool_or(kind = 'movement') AS moving FROM found GROUP BY 1),
main AS (SELECT frame_no, CASE WHEN count(*) > 1 THEN 'complex' ELSE min(kind) END AS type FROM (
  SELECT frame_no, kind, rank() OVER (PARTITION BY frame_no ORDER BY count(*) DESC) AS place FROM found GROUP BY 1, 2) WHERE place = 1 GROUP BY 1),
sl AS (SELECT sp.*, pct, coalesce(regions, []) AS regions, coalesce(moving, false) AS moving, coalesce(type, 'none') AS type,
  least(1, least(pct / 10, 1) * 0.5::DOUBLE + least(len(frames) / 30.0::DOUBLE, 1) * 0.3::DOUBLE + least(len(coalesce(regions, [])) / 5.0::DOUBLE, 1) * 0.2::DOUBLE) AS confidence
  FROM sp JOIN (SELECT frame_no, 100.0::DOUBLE * len(list_filter({fq._DIFF}, lambda x: x > 25)) / 64 AS pct FROM ends) ON frame_no = start_no
  LEFT JOIN reg ON reg.frame_no = start_no LEFT JOIN main ON main.frame_no = start_no)"""
_NEAR = (
    "CASE WHEN len(regions) = 0 THEN 0 ELSE greatest(0.0, 1 - list_min(list_transform(regions, lambda r: "
    "sqrt(pow(r.x + r.w / 2.0::DOUBLE - e.x, 2) + pow(r.y + r.h / 2.0::DOUBLE - e.y, 2)))) / 100.0::DOUBLE) END"
)
_SCORE = """least(1, 0.3::DOUBLE * greatest(0, 1 - delay / 2000.0::DOUBLE) + 0.3::DOUBLE * prox + 0.2::DOUBLE * least(pct / 10, 1) + 0.2::DOUBLE *
  CASE WHEN delay < 50 THEN 1.0::DOUBLE WHEN (c > 0.3 AND c < 0.7) OR many THEN 0.9 WHEN history > 1 THEN 0.8 WHEN pct < 1 THEN 0.3 ELSE 1.0 END)"""
_DELAY = "CASE WHEN {0} > 0.8 THEN 0 WHEN {0} > 0.5 THEN 100 ELSE 300 END AS delay"
_COR = f"""{_SLICES},
cand AS (SELECT e.session, e.id, e.ts_ms, segment, row_number() OVER (PARTITION BY e.session, e.id ORDER BY segment) - 1 AS history, confidence,
  len(regions) * 10.0::DOUBLE AS pct, len(regions) > 2 AND moving AS many, {_NEAR} AS prox
  FROM v_click e JOIN sl ON e.session = sl.session AND e.ts_ms >= start_ms - 5000 AND e.ts_ms <= end_ms),
o AS (SELECT *, row_number() OVER (PARTITION BY session, segment ORDER BY ts_ms, id) AS k, count(*) OVER (PARTITION BY session, segment) AS n FROM cand),
fold(session, segment, k, n, c, ev) AS (SELECT session, segment, CAST(0 AS BIGINT), n, confidence, CAST([] AS BIGINT[]) FROM o WHERE k = 1
  UNION ALL SELECT session, segment, k, n, CASE WHEN score >= 0.7 THEN greatest(c, score) ELSE c END, CASE WHEN score >= 0.7 THEN list_append(ev, id) ELSE ev END FROM (
   SELECT session, segment, k, n, c, ev, id, {_SCORE} AS score
   FROM (SELECT f.session, f.segment, o.k, f.n, f.c, f.ev, o.id, o.prox, o.pct, o.history, o.many, {_DELAY.format('f.c')}
         FROM fold f JOIN o ON o.session = f.session AND o.segment = f.segment AND o.k = f.k + 1))),
cor AS (SELECT sl.* EXCLUDE (confidence), coalesce(c, confidence) AS confidence, coalesce(ev, []) AS ev FROM sl LEFT JOIN (FROM fold WHERE k = n) USING (session, segment))"""
_MERGED = f"""{_COR},
m AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w <= 1200 AND (type = lag(type) OVER w OR type = 'complex' OR lag(type) OVER w = 'complex')
  AND abs(confidence - lag(confidence) OVER w) <= 0.3 AND (list_has_any(ev, lag(ev) OVER w) OR len(list_filter(regions, lambda p: len(list_filter(lag(regions) OVER w,
    lambda q: p.x <= q.x + q.w AND q.x <= p.x + p.w AND p.y <= q.y + q.h AND q.y <= p.y + p.h)) > 0)) > 0) THEN 0 ELSE 1 END AS new
  FROM cor WINDOW w AS (PARTITION BY session ORDER BY start_ms, segment)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY start_ms, segment) AS grp FROM m),
mg AS (SELECT session, grp, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CASE WHEN count(DISTINCT type) = 1 THEN min(type) ELSE 'complex' END AS type,
  avg(confidence) AS confidence, count(*) AS slices, list_sort(list_distinct(flatten(list(ev)))) AS ev, list_sort(list_distinct(flatten(list(frames)))) AS frames,
  flatten(list(regions ORDER BY start_ms, segment)) AS regions FROM g GROUP BY session, grp HAVING avg(confidence) >= 0.7)"""
_LINKS = f"""{_MERGED},
ex AS (SELECT mg.session, grp, start_ms, confidence AS c, regions, unnest(ev) AS id FROM mg),
judged AS (SELECT session, id, count(*) AS judged FROM cand GROUP BY 1, 2),
li AS (SELECT session, ts_ms, id, pct, delay, {_SCORE} AS score FROM (
  SELECT x.session, e.ts_ms, x.id, x.c, len(regions) * 10.0::DOUBLE AS pct, {_DELAY.format('x.c')}, {_NEAR} AS prox,
    judged + row_number() OVER (PARTITION BY x.session, x.id ORDER BY start_ms, grp) - 1 AS history,
    len(regions) > 2 AND len(list_filter(regions, lambda r: r.kind = 'movement')) > 0 AS many
  FROM ex x JOIN v_click e ON e.session = x.session AND e.id = x.id JOIN judged j ON j.session = x.session AND j.id = x.id)),
r AS (SELECT session, list({{'t': ts_ms, 'id': id, 'p': pct, 'd': delay}} ORDER BY ts_ms, id, pct, score) AS l, avg(score) AS mean FROM li GROUP BY 1),
q AS (SELECT *, len(l) AS n, list_transform(l, lambda e: e.p) AS p, list_filter(l, lambda e: e.p > 1) AS felt FROM r)"""
ORACLE = {
    "timeline_slices": f"""{_SLICES} SELECT session, segment, start_ms, end_ms, array_to_string(frames, ',') AS frames, round(pct, 6) AS pct, type, moving,
  array_to_string(list_transform(regions, lambda r: concat_ws(' ', r.x, r.y, r.w, r.h, r.kind)), ',') AS regions, round(confidence, 6) AS confidence FROM sl""",
    "timeline_correlation": f"{_COR} SELECT session, segment, array_to_string(ev, ',') AS events, round(confidence, 6) AS confidence FROM cor",
    "timeline_analysis": f"""{_MERGED} SELECT session, start_ms, end_ms, type, slices, array_to_string(ev, ',') AS events, array_to_string(frames, ',') AS frames,
  len(regions) AS regions, round(confidence, 6) AS confidence FROM mg""",
    "timeline_chains": f"""{_LINKS} SELECT session, l[1].id AS trigger, n, l[n].t - l[1].t AS duration, round(mean * greatest(0, least(1, 1 - (n - 5) * 0.1::DOUBLE)), 6) AS confidence,
  CASE WHEN len(felt) > 0 THEN felt[len(felt)].t - l[1].t ELSE 0 END AS settling,
  CASE WHEN list_max(p) > 0 THEN list_filter(l, lambda e: e.p = list_max(p))[1].t - l[1].t ELSE 0 END AS peak_ms, l[1].d AS initial_delay, l[1].d < 50 AS instantaneous,
  n >= 3 AND len(list_filter(range(2, n), lambda i: (p[i - 1] <= p[i] AND p[i] <= p[i + 1]) OR (p[i - 1] >= p[i] AND p[i] >= p[i + 1]))) / (n - 2.0::DOUBLE) > 0.7
    AND len(felt) > 0 AS animated FROM q""",
    "timeline_statistics": f"""{_MERGED}, kinds AS (SELECT session, type, count(*) AS n, min((start_ms, grp)) AS first FROM mg GROUP BY 1, 2),
common AS (SELECT session, type FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, first) AS place FROM kinds) WHERE place = 1),
whole AS (SELECT session, count(*) AS slices, avg(end_ms - start_ms) AS mean FROM mg GROUP BY 1), fr AS (SELECT session, count(*) AS frames FROM v_frame GROUP BY 1),
ev AS (SELECT session, count(*) AS events FROM v_click GROUP BY 1)
SELECT session, frames, coalesce(events, 0) AS events, coalesce(slices, 0) AS slices, round(coalesce(mean, 0), 4) AS mean_ms, coalesce(type, 'none') AS common
FROM fr LEFT JOIN ev USING (session) LEFT JOIN whole USING (session) LEFT JOIN common USING (session)""",
}
