"""Registered queries on the state graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.operators import graph as g
from flowscope.plans import views as v

START = "view_0"


def _states(spark, d):
    return v.steps(spark, d).select("state").distinct()


def _possible(spark, d):
    return v.steps(spark, d).groupBy("state").agg((F.count_distinct("session") % 7 + 1).alias("possible"))


QUERIES = {
    "transition_counts": lambda s, d: g.transition_counts(v.edges(s, d)),
    "entry_points": lambda s, d: g.entry_points(v.edges(s, d)),
    "dead_ends": lambda s, d: g.dead_ends(v.edges(s, d)),
    "loop_pairs": lambda s, d: g.loops(v.edges(s, d)),
    "state_degrees": lambda s, d: g.degrees(v.edges(s, d)),
    "hub_states": lambda s, d: g.hubs(v.edges(s, d), 40),
    "graph_statistics": lambda s, d: g.statistics(v.edges(s, d)),
    "exploration_coverage": lambda s, d: g.coverage(v.edges(s, d), _possible(s, d)),
    "top_sources": lambda s, d: g.top_sources(v.edges(s, d)),
    "interaction_types": lambda s, d: v.edges(s, d).groupBy("kind").agg(F.count("*").alias("n")),
    "initial_state": lambda s, d: g.initial_state(v.steps(s, d)),
    "valid_edges": lambda s, d: g.valid_edges(v.edges(s, d), _states(s, d).filter("state not like 'error%'")).groupBy("src", "dst").agg(F.count("*").alias("n")),
    "adjacency_lists": lambda s, d: g.adjacency(v.edges(s, d)).select("src", F.array_join("targets", ",").alias("targets")),
    "state_visits": lambda s, d: g.visits(v.steps(s, d)),
    "explored_progress": lambda s, d: g.explored(v.steps(s, d).filter("kind <> 'signup'"), _states(s, d)),
    "bfs_distances": lambda s, d: g.distances(v.edges(s, d), START).select("state", F.col("distance").cast("bigint").alias("distance")),
    "shortest_path": lambda s, d: g.shortest_path(v.edges(s, d), START, "error_9").select(F.array_join("path", ">").alias("path"), F.col("distance").cast("bigint").alias("distance")),
    "max_depth": lambda s, d: g.max_depth(v.edges(s, d), START).select(F.col("max_depth").cast("bigint").alias("max_depth")),
    "cyclic_components": lambda s, d: g.cyclic_components(v.edges(s, d)),
}

_E = f"WITH RECURSIVE {v.EDGE_SQL}"
_NODES = "v_node AS (SELECT src AS state FROM v_edge UNION SELECT dst FROM v_edge)"
_DEG = """deg AS (SELECT state, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT src AS state, 1 AS o, 0 AS i FROM u UNION ALL SELECT dst, 0, 1 FROM u) GROUP BY state)"""
_BFS = f"""{_E}, e AS (SELECT DISTINCT src, dst FROM v_edge WHERE src <> dst),
walk(state, distance, path) AS (SELECT '{START}', 0, ['{START}']
  UNION ALL SELECT dst, distance + 1, list_append(path, dst) FROM (
    SELECT dst, distance, path, row_number() OVER (PARTITION BY dst ORDER BY path) AS k
    FROM walk JOIN e ON state = src WHERE distance < 9 AND NOT list_contains(path, dst)) WHERE k = 1),
best AS (SELECT state, min(distance) AS distance FROM walk GROUP BY state)"""

ORACLE = {
    "transition_counts": f"""{_E}, n AS (SELECT src, dst, count(*) AS n FROM v_edge GROUP BY 1, 2)
SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 6) AS probability, count(*) OVER (PARTITION BY src) AS out_degree FROM n""",
    "entry_points": f"{_E}, {_NODES} SELECT state FROM v_node WHERE state NOT IN (SELECT dst FROM v_edge)",
    "dead_ends": f"{_E}, u AS (SELECT * FROM v_edge) SELECT state FROM (SELECT src AS state FROM u UNION SELECT dst FROM u) WHERE state NOT IN (SELECT src FROM u)",
    "loop_pairs": f"""{_E}, f AS (SELECT src, dst, min(pos) AS pos FROM v_edge GROUP BY 1, 2)
SELECT a.src, a.dst, a.pos FROM f a JOIN f b ON a.src = b.dst AND a.dst = b.src AND b.pos < a.pos""",
    "state_degrees": f"{_E}, u AS (SELECT DISTINCT src, dst FROM v_edge), {_DEG} SELECT * FROM deg",
    "hub_states": f"{_E}, u AS (SELECT DISTINCT src, dst FROM v_edge), {_DEG} SELECT * FROM deg WHERE in_degree + out_degree > 40",
    "graph_statistics": f"""{_E}, u AS (SELECT DISTINCT src, dst FROM v_edge), {_DEG}
SELECT count(*) AS states, CAST(sum(out_degree) AS BIGINT) AS transitions, round(avg(CASE WHEN out_degree > 0 THEN out_degree END), 6) AS branching,
       count(*) FILTER (out_degree = 0) AS terminal, count(*) FILTER (in_degree = 0) AS unreached FROM deg""",
    "exploration_coverage": f"""{_E}, u AS (SELECT DISTINCT src, dst FROM v_edge), {_DEG},
p AS (SELECT state, count(DISTINCT session) % 7 + 1 AS possible FROM v_step GROUP BY state)
SELECT round(sum(least(coalesce(out_degree, 0), possible)) / sum(possible), 6) AS coverage FROM p LEFT JOIN deg USING (state)""",
    "top_sources": f"{_E} SELECT src, count(DISTINCT dst) AS targets FROM v_edge GROUP BY src ORDER BY 2 DESC, 1 LIMIT 5",
    "interaction_types": f"{_E} SELECT kind, count(*) AS n FROM v_edge GROUP BY kind",
    "initial_state": f"""{_E}, f AS (SELECT state, min(pos) AS pos FROM v_step GROUP BY state)
SELECT state FROM f ORDER BY state IN (SELECT dst FROM v_edge), pos LIMIT 1""",
    "valid_edges": f"{_E} SELECT src, dst, count(*) AS n FROM v_edge WHERE src NOT LIKE 'error%' AND dst NOT LIKE 'error%' GROUP BY 1, 2",
    "adjacency_lists": f"{_E} SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM v_edge GROUP BY src",
    "state_visits": f"{_E} SELECT state, count(*) AS visits, max(pos) AS last_pos FROM v_step GROUP BY state",
    "explored_progress": f"""{_E}, a AS (SELECT DISTINCT state FROM v_step), b AS (SELECT DISTINCT state FROM v_step WHERE kind <> 'signup')
SELECT (SELECT count(*) FROM b) AS explored, count(*) AS total, round((SELECT count(*) FROM b) / count(*), 6) AS progress FROM a""",
    "bfs_distances": f"{_BFS} SELECT state, CAST(distance AS BIGINT) AS distance FROM best",
    "shortest_path": f"{_BFS} SELECT array_to_string(min(path), '>') AS path, CAST(any_value(w.distance) AS BIGINT) AS distance FROM walk w JOIN best b ON w.state = b.state AND w.distance = b.distance WHERE w.state = 'error_9'",
    "max_depth": f"{_BFS} SELECT CAST(max(distance) AS BIGINT) AS max_depth FROM best",
    "cyclic_components": f"""{_E}, e AS (SELECT DISTINCT src, dst FROM v_edge),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src),
c AS (SELECT x.a, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT component, count(*) AS states FROM c GROUP BY component""",
}
