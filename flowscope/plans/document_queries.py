"""Registered queries on session documents, formulas and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.functions import equations as eq
from flowscope.operators import document as doc
from flowscope.operators import graph as g
from flowscope.plans import views as v
from flowscope.sources import export

#: Times, states and changes that the document queries ask about.
AT, FROM, TO = 200_000_000, "view_0", "purchase_1"


def _docs(s, d):
    return v.documents(s, d)


def _tampered(raw, n):
    return F.when(n % 7 == 0, F.regexp_replace(raw, '"stability":1', '"stability":0')).otherwise(raw)


def _broken(raw, n):
    raw = F.when(n % 5 == 0, F.regexp_replace(raw, '"overall":1', '"overall":2')).otherwise(raw)
    return F.when(n % 3 == 0, F.regexp_replace(raw, '"linux"', '"dos"')).otherwise(raw)


def _subset(s, d):
    cut = doc.subset(_docs(s, d), AT, 2 * AT)
    n = lambda c: F.size(c).cast("bigint")
    sizes = cut.select("path", "raw", n("doc.visualData.keyframes").alias("keyframes"), n("doc.stateGraph.nodes").alias("states"), n("doc.stateGraph.edges").alias("edges"))
    holds = F.bool_and(F.col("stored") == F.col("actual")).alias("holds")
    # sizes go with the sections, so that each document is made and cut once
    return doc.checksums(sizes, ("keyframes", "states", "edges")).groupBy("path", "keyframes", "states", "edges").agg(holds)


def _graph(s, d):
    n = g.visits(v.steps(s, d)).select(F.col("state").alias("id"), F.col("state").alias("label"), "visits", F.col("state").startswith("error").alias("error"), (F.col("visits") < 3).alias("terminal"))
    e = g.transition_counts(v.edges(s, d)).select("src", "dst", F.col("n").cast("string").alias("label"))
    return n, e


def _layout(s, d):
    nodes = g.visits(v.steps(s, d)).select(F.col("state").alias("id"), F.upper("state").alias("label"), (F.col("visits") - 40).alias("size"))
    return export.force_layout(nodes, g.transition_counts(v.edges(s, d)))


def _formula(s, d):
    names = {"price": F.col("l_extendedprice"), "off": F.col("l_discount"), "tax": F.col("l_tax"), "n": F.col("l_quantity")}
    value = eq.clamped(eq.column("price * (1 - off) / n + -tax * 100", names), 0, 1500)
    return v.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))


QUERIES = {
    "formula_values": _formula,
    "dot_export": lambda s, d: export.dot_lines(*_graph(s, d)),
    "cytoscape_export": lambda s, d: export.cytoscape(*_graph(s, d)),
    "force_layout_edges": lambda s, d: _layout(s, d)[1],
    "force_layout_nodes": lambda s, d: _layout(s, d)[0].select("id", "label", "size", (F.col("x").between(0, 1000) & F.col("y").between(0, 1000)).alias("placed")),
    "box_tree": lambda s, d: export.tree_lines(v.boxes(s, d)),
    "document_types": lambda s, d: doc.type_counts(_docs(s, d)),
    "document_state_at": lambda s, d: doc.state_at(_docs(s, d), AT),
    "document_path": lambda s, d: doc.path_between(_docs(s, d), FROM, TO).select("path", F.col("distance").cast("bigint").alias("distance"), F.array_join("states", ">").alias("states")),
    "document_difference": lambda s, d: doc.state_difference(_docs(s, d).filter(F.exists("doc.stateGraph.nodes", lambda n: n["id"] == FROM) & F.exists("doc.stateGraph.nodes", lambda n: n["id"] == TO)), FROM, TO),
    "document_equation": lambda s, d: doc.evaluated(_docs(s, d), "m", "width", {"size": 5}).select("path", F.round("value", 9).alias("value")),
    "document_subset": _subset,
    "document_checksums": lambda s, d: doc.checksums(v.documents(s, d, _tampered)).select("path", "section", (F.col("stored") == F.col("actual")).alias("holds")),
    "document_errors": lambda s, d: doc.errors(v.documents(s, d, _broken)),
    "document_summary": lambda s, d: doc.summary(_docs(s, d)),
    "document_terminals": lambda s, d: _docs(s, d).select("path", "doc.stateGraph.initialState", F.array_join(F.array_sort("doc.stateGraph.terminalStates"), ",").alias("terminal")),
}

_E = f"WITH {v.EDGE_SQL}"
_N = "coalesce((['button','text','image','input','link','container','navigation','header','footer','sidebar','card','list','table','video','icon','logo','menu','form','textarea','select','checkbox','radio','unknown'])[type_no + 1], 'unknown')"
ORACLE = {
    "formula_values": "SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice * (1 - l_discount) / l_quantity + -l_tax * 100, 0), 1500) AS value FROM lineitem",
    "dot_export": f"""{_E}, n AS (SELECT state, count(*) AS visits FROM v_step GROUP BY state), e AS (SELECT src, dst, count(*) AS c FROM v_edge GROUP BY 1, 2)
SELECT 0 AS part, 'digraph states {{' || chr(10) || '  rankdir=LR;' AS line UNION ALL SELECT 3, '}}'
UNION ALL SELECT 1, '  "' || state || '" [label="' || state || ' (' || visits || ')" color="' || CASE WHEN state LIKE 'error%' THEN 'red' WHEN visits < 3 THEN 'green' ELSE 'black' END || '"];' FROM n
UNION ALL SELECT 2, '  "' || src || '" -> "' || dst || '" [label="' || c || '"];' FROM e""",
    "cytoscape_export": f"""{_E}, e AS (SELECT src, dst, CAST(count(*) AS VARCHAR) AS c FROM v_edge GROUP BY 1, 2) SELECT 'node' AS kind, '{{"data":{{"id":"' || state || '","label":"' || state || '"}}}}' AS json FROM (SELECT DISTINCT state FROM v_step)
UNION ALL SELECT 'edge', '{{"data":{{"id":"edge-' || (row_number() OVER (ORDER BY src, dst, c) - 1) || '","source":"' || src || '","target":"' || dst || '","label":"' || c || '"}}}}' FROM e""",
    "force_layout_nodes": f"{_E} SELECT state AS id, upper(state) AS label, greatest(count(*) - 40, 1) AS size, true AS placed FROM v_step GROUP BY state",
    "force_layout_edges": f"{_E} SELECT src AS source, dst AS target, count(*) AS weight FROM v_edge GROUP BY 1, 2",
    "box_tree": f"""WITH RECURSIVE {v.BOX_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY w * h DESC, pos) AS rank FROM v_box),
link AS (SELECT b.shot, b.pos, any_value({_N.replace('type_no', 'b.type_no')}) || ' ' || CAST(any_value(b.w) AS INTEGER) || 'x' || CAST(any_value(b.h) AS INTEGER) AS t, arg_max(a.pos, a.rank) AS parent FROM ranked b
  LEFT JOIN ranked a ON a.shot = b.shot AND a.rank < b.rank AND (greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) / (b.w * b.h) >= 0.9 GROUP BY b.shot, b.pos),
tree(shot, pos, path, line, depth) AS (SELECT shot, pos, lpad(CAST(pos AS VARCHAR), 19, '0'), t, 0 FROM link WHERE parent IS NULL
  UNION ALL SELECT l.shot, l.pos, path || '/' || lpad(CAST(l.pos AS VARCHAR), 19, '0'), repeat('  ', depth + 1) || l.t, depth + 1 FROM tree r JOIN link l ON l.shot = r.shot AND l.parent = r.pos)
SELECT shot, path, line FROM tree""",
    "document_types": f"WITH {v.DOC_SQL} SELECT path, type, count(*) AS n FROM node GROUP BY 1, 2",
    "document_state_at": f"WITH {v.DOC_SQL}, k AS (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY ts DESC, id) AS k FROM node WHERE ts <= {AT}) SELECT path, k.id AS state FROM (SELECT DISTINCT path FROM node) LEFT JOIN (SELECT * FROM k WHERE k = 1) k USING (path)",
    "document_path": f"""WITH RECURSIVE {v.DOC_SQL}, walk(path, state, distance, states) AS (SELECT DISTINCT path, '{FROM}', CAST(0 AS BIGINT), ['{FROM}'] FROM node
  UNION ALL SELECT path, dst, distance + 1, list_append(states, dst) FROM (SELECT walk.path, dst, distance, states, row_number() OVER (PARTITION BY walk.path, dst ORDER BY states) AS k
    FROM walk JOIN way ON walk.path = way.path AND src = state WHERE state <> '{TO}' AND NOT list_contains(states, dst)) WHERE k = 1)
SELECT path, distance, array_to_string(states, '>') AS states FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY distance, states) AS k FROM walk WHERE state = '{TO}') WHERE k = 1""",
    "document_difference": f"WITH {v.DOC_SQL} SELECT path, 1 AS difference FROM node WHERE id IN ('{FROM}', '{TO}') GROUP BY path HAVING count(*) = 2",
    "document_equation": f"WITH {v.DOC_SQL} SELECT path, round(least(1.25::DOUBLE, 1 + count(*) / 10000.0::DOUBLE), 9) AS value FROM ev GROUP BY path",
    "document_subset": f"""WITH {v.DOC_SQL}, k AS (SELECT path, count(*) FILTER (kind = 'purchase' AND ts BETWEEN {AT} AND {2 * AT}) AS keyframes FROM ev GROUP BY path),
n AS (SELECT path, count(*) FILTER (ts BETWEEN {AT} AND {2 * AT}) AS states FROM node GROUP BY path), e AS (SELECT path, count(*) AS edges FROM way GROUP BY path)
SELECT path, keyframes, states, coalesce(edges, 0) AS edges, true AS holds FROM k JOIN n USING (path) LEFT JOIN e USING (path)""",
    "document_checksums": f"WITH {v.DOC_SQL}, s AS (SELECT unnest(['visualData', 'molecules', 'stateGraph']) AS section) SELECT path, section, section <> 'stateGraph' OR CAST(path AS BIGINT) % 7 <> 0 AS holds FROM (SELECT DISTINCT path FROM node), s",
    "document_errors": f"""WITH {v.DOC_SQL}, p AS (SELECT DISTINCT path FROM node) SELECT path, 'metadata.fidelityScore.overall is not within 0 and 1' AS rule FROM p WHERE CAST(path AS BIGINT) % 5 = 0
UNION ALL SELECT path, 'metadata.captureEnvironment.platform is none of the known values' FROM p WHERE CAST(path AS BIGINT) % 3 = 0""",
    "document_summary": f"""WITH {v.DOC_SQL}, t AS (SELECT path, type, count(*) AS n, min(id) AS first FROM node GROUP BY 1, 2), ts AS (SELECT path, string_agg('  ' || type || ': ' || n, chr(10) ORDER BY first) AS types, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY path),
k AS (SELECT path, count(*) FILTER (kind = 'purchase') AS keyframes FROM ev GROUP BY path), e AS (SELECT path, count(*) AS edges FROM way GROUP BY path)
SELECT path, 'Version: 1.0' || chr(10) || 'URL: http://events.example/' || chr(10) || 'Capture Time: 1970-01-01T00:00:00.000Z' || chr(10) || 'Platform: linux' || chr(10) || chr(10) || 'Fidelity Scores:' || chr(10)
 || '  Overall: 100.00%' || chr(10) || '  Visual: 100.00%' || chr(10) || '  Behavioral: 100.00%' || chr(10) || '  Timing: 100.00%' || chr(10) || '  Color: 100.00%' || chr(10) || chr(10)
 || 'Capture Settings:' || chr(10) || '  Frame Rate: 60 fps' || chr(10) || '  Color Space: srgb' || chr(10) || '  Mode: full' || chr(10) || chr(10) || 'Data Statistics:' || chr(10) || '  Molecules: ' || n || chr(10) || '  States: ' || n || chr(10)
 || '  Transitions: ' || coalesce(edges, 0) || chr(10) || '  Behavioral Equations: 1' || chr(10) || '  Keyframes: ' || keyframes || chr(10) || chr(10) || 'Molecule Types:' || chr(10) || types AS text FROM ts JOIN k USING (path) LEFT JOIN e USING (path)""",
    "document_terminals": f"""WITH {v.DOC_SQL}, led AS (SELECT path, dst AS id, true AS led FROM (SELECT DISTINCT path, dst FROM way)), f AS (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY coalesce(led, false), ts, id) AS k FROM node LEFT JOIN led USING (path, id)),
z AS (SELECT path, string_agg(id, ',' ORDER BY id) AS t FROM node WHERE (path, id) NOT IN (SELECT path, src FROM way) GROUP BY path)
SELECT f.path, f.id AS "initialState", coalesce(t, '') AS terminal FROM f LEFT JOIN z USING (path) WHERE k = 1""",
}
