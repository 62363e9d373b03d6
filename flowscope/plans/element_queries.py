"""Registered queries on detected boxes and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.functions import color
from flowscope.functions import geometry as geo
from flowscope.operators import elements as el
from flowscope.operators import properties as pr
from flowscope.plans import views as v

#: Written out, not taken from the library: the checks must not share its table.
_NAMES = "['button','text','image','input','link','container','navigation','header','footer','sidebar','card','list','table','video','icon','logo','menu','form','textarea','select','checkbox','radio','unknown']"
_TYPE = f"coalesce(({_NAMES})[type_no + 1], 'unknown')"


def _rgb(s, d):
    k = F.col("p_partkey")
    r, g, b = (k * 7 % 256).cast("int"), (k * 13 % 256).cast("int"), (F.col("p_size") * 5 % 256).cast("int")
    return v.table(s, d, "part").select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


def _colors(s, d):
    c = _rgb(s, d)
    hsl, back = color.hsl_of(F.col("r"), F.col("g"), F.col("b")), color.rgb_of(color.hex_of(F.col("r"), F.col("g"), F.col("b")))
    near = color.distance([F.col("r"), F.col("g"), F.col("b")], [F.lit(0), F.lit(123), F.lit(255)])
    return c.withColumns({"hsl": hsl, "back": back}).select("p_partkey", color.hex_of(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "hsl.h", "hsl.s", "hsl.l", F.col("back.r").alias("r"), F.col("back.g").alias("g"), F.col("back.b").alias("b"), F.round(near, 4).alias("distance"))


def _detections(s, d):
    return el.parsed_rows(v.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: e.cast("double")).alias("v")), 59, 0.05)


def _links(s, d):
    return el.parents(v.boxes(s, d))


def _facts(s, d):
    """Pairs of a shot's boxes with all measures of a pair."""
    p = el.pairs(v.boxes(s, d), F.col("a_pos") < F.col("b_pos"))
    return p.select("shot", "a_pos", "b_pos", F.round(geo.iou(), 6).alias("iou"), F.round(geo.overlap_area(), 4).alias("both"), geo.in_a_row().alias("row"), geo.in_a_column().alias("col"), F.round(geo.gap_right(), 4).alias("gap_right"), F.round(geo.gap_below(), 4).alias("gap_below"))


QUERIES = {
    "boxes_kept": lambda s, d: el.kept(v.boxes(s, d), 0.7, 3).select("shot", "pos", "confidence"),
    "boxes_by_area": lambda s, d: el.by_area(v.boxes(s, d)).select("shot", "pos", "rank"),
    "box_pair_measures": _facts,
    "overlapping_boxes": lambda s, d: el.overlapping(v.boxes(s, d)).select("shot", "a_pos", "b_pos", F.round("iou", 6).alias("iou")),
    "contained_boxes": lambda s, d: el.meeting(v.boxes(s, d), (F.col("a_pos") != F.col("b_pos")) & geo.contains()).select("shot", "a_pos", "b_pos"),
    "box_parents": lambda s, d: _links(s, d).select("shot", "pos", F.coalesce("parent", F.lit(-1)).alias("parent")),
    "box_depths": lambda s, d: el.depths(_links(s, d)).select("shot", "pos", F.col("depth").cast("bigint").alias("depth")),
    "boxes_per_depth": lambda s, d: el.depths(_links(s, d)).groupBy(F.col("depth").cast("bigint").alias("depth")).agg(F.count("*").alias("n")),
    "box_children": lambda s, d: _links(s, d).filter("parent is not null").groupBy("shot", "parent").agg(F.count("*").alias("children")).filter("children >= 2"),
    "root_boxes": lambda s, d: el.roots(v.boxes(s, d)),
    "box_relationships": lambda s, d: el.relationships(_links(s, d), el.sibling_groups(v.boxes(s, d), _links(s, d))).withColumn("layout", F.coalesce("layout", F.lit("-"))),
    "behaviour_hints": lambda s, d: el.hints(v.boxes(s, d), _links(s, d)),
    "box_warnings": lambda s, d: el.warnings(v.boxes(s, d)),
    "box_spacing": lambda s, d: el.spacing(v.boxes(s, d)),
    "overall_confidence": lambda s, d: v.boxes(s, d).groupBy("shot").agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("confidence")),
    "read_boxes": lambda s, d: v.boxes(s, d).filter(pr.is_read(el.type_name())).groupBy("shot").agg(F.count("*").alias("n"), F.max("confidence").alias("best")),
    "type_distribution": lambda s, d: v.boxes(s, d).groupBy(el.type_name().alias("type")).agg(F.count("*").alias("n")),
    "largest_boxes": lambda s, d: v.boxes(s, d).withColumn("area", geo.area()).orderBy(F.desc("area"), "shot", "pos").limit(5).select("shot", "pos", "area"),
    "suppressed_boxes": lambda s, d: el.suppressed(v.boxes(s, d)).select("shot", "pos"),
    "sibling_groups": lambda s, d: el.sibling_groups(v.boxes(s, d), _links(s, d)).select("shot", "parent", "kind", F.array_join("members", ",").alias("members"), F.round("spacing", 4).alias("spacing"), "alignment"),
    "sibling_grids": lambda s, d: el.grids(v.boxes(s, d), _links(s, d)).select("shot", "parent", "columns", "rows", *(F.round(c, 4).alias(c) for c in ("column_gap", "row_gap", "confidence"))),
    "layout_grid": lambda s, d: el.layout_grid(v.boxes(s, d), _links(s, d)).select("shot", "parent", "columns", "rows"),
    "parsed_detections": _detections,
    "color_conversions": _colors,
    "primary_colors": lambda s, d: _rgb(s, d).agg(F.count_distinct(color.hex_of(F.col("r"), F.col("g"), F.col("b"))).alias("colors")),
}

_B = f"WITH RECURSIVE {v.BOX_SQL}"
_TOUCH = "a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h"
_BOTH = "greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_IOU = f"({_BOTH}) / (a.w * a.h + b.w * b.h - ({_BOTH}))"
_HOLD = "a.x <= b.x AND a.y <= b.y AND a.x + a.w >= b.x + b.w AND a.y + a.h >= b.y + b.h"
_LINK = f"""{_B}, ranked AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY w * h DESC, pos) AS rank FROM v_box),
link AS (SELECT b.shot, b.pos, arg_max(a.pos, a.rank) AS parent FROM ranked b
  LEFT JOIN ranked a ON a.shot = b.shot AND a.rank < b.rank AND ({_BOTH}) / (b.w * b.h) >= 0.9 GROUP BY b.shot, b.pos)"""
_DEPTH = f"""{_LINK}, tree(shot, pos, depth) AS (SELECT shot, pos, CAST(0 AS BIGINT) FROM link WHERE parent IS NULL
  UNION ALL SELECT l.shot, l.pos, depth + 1 FROM tree t JOIN link l ON l.shot = t.shot AND l.parent = t.pos)"""

# A child's group is greedy along an axis: state of the walk over pairs (i, j) of a parent's n children in order.
_CHILD = f"""{_LINK}, kid AS (SELECT link.parent, b.* FROM link JOIN v_box b USING (shot, pos) WHERE parent IS NOT NULL)"""


def _walk(name, a, size, b, other):
    return f"""{name}_s AS (SELECT shot, parent, count(*) AS n, list({{'pos': pos, 'a': {a}, 's': {size}, 'm': {b} + {other} / 2}} ORDER BY {a}, pos) AS k FROM kid GROUP BY 1, 2 HAVING count(*) >= 2),
{name}(shot, parent, n, k, i, j, used, grp, outs) AS (SELECT shot, parent, n, k, CAST(1 AS BIGINT), CAST(2 AS BIGINT), CAST([] AS BIGINT[]), CAST([1] AS BIGINT[]), CAST([] AS BIGINT[][]) FROM {name}_s
 UNION ALL SELECT shot, parent, n, k, CASE WHEN j <= n THEN i ELSE i + 1 END, CASE WHEN j <= n THEN j + 1 ELSE i + 2 END,
  CASE WHEN j > n AND len(grp) >= 2 THEN list_concat(used, grp) ELSE used END,
  CASE WHEN j > n THEN [i + 1] WHEN NOT list_contains(used, i) AND NOT list_contains(used, j) AND abs(k[j].m - k[i].m) < 5 AND greatest(0.0, k[j].a - k[grp[len(grp)]].a - k[grp[len(grp)]].s) < 50 THEN list_append(grp, j) ELSE grp END,
  CASE WHEN j > n AND len(grp) >= 2 THEN list_append(outs, grp) ELSE outs END FROM {name} WHERE i <= n),
{name}_g AS (SELECT shot, parent, '{name}' AS kind, list_transform(g, lambda x: k[x].pos) AS members, list_avg(list_transform(range(1, len(g)), lambda x: greatest(0.0, k[g[x + 1]].a - k[g[x]].a - k[g[x]].s))) AS spacing FROM (SELECT shot, parent, k, unnest(outs) AS g FROM {name} WHERE i > n))"""


# Lines of a grid: a box opens one if its centre is 5 or more from the first box's of the line.
_GRID = """go AS (SELECT *, row_number() OVER (PARTITION BY shot, parent ORDER BY y, x, pos) AS k, count(*) OVER (PARTITION BY shot, parent) AS n FROM kid),
gl(shot, parent, k, line, mid) AS (SELECT shot, parent, k, CAST(1 AS BIGINT), y + h / 2 FROM go WHERE k = 1 AND n >= 2
 UNION ALL SELECT o.shot, o.parent, o.k, CASE WHEN abs(o.y + o.h / 2 - l.mid) < 5 THEN l.line ELSE l.line + 1 END, CASE WHEN abs(o.y + o.h / 2 - l.mid) < 5 THEN l.mid ELSE o.y + o.h / 2 END FROM gl l JOIN go o ON o.shot = l.shot AND o.parent = l.parent AND o.k = l.k + 1),
gc AS (SELECT go.*, line, row_number() OVER w AS c, x - lag(x + w) OVER w AS gap FROM go JOIN gl USING (shot, parent, k) WINDOW w AS (PARTITION BY shot, parent, line ORDER BY x, pos)),
gf AS (SELECT shot, parent, line, count(*) AS cols, arg_min(y, c) AS y0, arg_min(h, c) AS h0 FROM gc GROUP BY 1, 2, 3),
gd AS (SELECT *, y0 - lag(y0 + h0) OVER (PARTITION BY shot, parent ORDER BY line) AS down FROM gf),
ga AS (SELECT shot, parent, avg(greatest(0.0, gap)) FILTER (gap IS NOT NULL) AS cg, stddev_pop(greatest(0.0, gap)) FILTER (gap IS NOT NULL) AS cs FROM gc GROUP BY 1, 2),
gb AS (SELECT shot, parent, count(*) AS rows, min(cols) AS columns, max(cols) AS most, avg(greatest(0.0, down)) FILTER (down IS NOT NULL) AS rg, stddev_pop(greatest(0.0, down)) FILTER (down IS NOT NULL) AS rs FROM gd GROUP BY 1, 2),
grid AS (SELECT shot, parent, columns, rows, coalesce(cg, 0) AS column_gap, coalesce(rg, 0) AS row_gap, 1 - (coalesce(cs, 0) + coalesce(rs, 0)) / 2 AS confidence FROM gb JOIN ga USING (shot, parent) WHERE columns = most)"""
_GROUPS = f"""{_CHILD}, {_walk("horizontal", "x", "w", "y", "h")}, {_walk("vertical", "y", "h", "x", "w")}, {_GRID},
big AS (SELECT shot, parent, list(pos ORDER BY pos) AS members FROM kid GROUP BY 1, 2 HAVING count(*) >= 4),
grp AS (SELECT * FROM horizontal_g UNION ALL SELECT * FROM vertical_g UNION ALL SELECT shot, parent, 'grid', members, least(column_gap, row_gap) FROM big JOIN grid USING (shot, parent) WHERE confidence >= 0.8)"""
_ALIGN = """CASE WHEN kind = 'grid' THEN 'grid' WHEN stddev_pop(x) < 5 THEN 'left' WHEN stddev_pop(x + w) < 5 THEN 'right' WHEN stddev_pop(x + w / 2) < 5 THEN 'center' WHEN stddev_pop(y) < 5 THEN 'top' WHEN stddev_pop(y + h) < 5 THEN 'bottom' ELSE 'mixed' END"""

ORACLE = {
    "boxes_kept": f"{_B} SELECT shot, pos, confidence FROM (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY confidence DESC, pos) AS k FROM v_box WHERE confidence >= 0.7) WHERE k <= 3",
    "boxes_by_area": f"{_B} SELECT shot, pos, row_number() OVER (PARTITION BY shot ORDER BY w * h DESC, pos) AS rank FROM v_box",
    "box_pair_measures": f"""{_B} SELECT a.shot, a.pos AS a_pos, b.pos AS b_pos, round({_IOU}, 6) AS iou, round({_BOTH}, 4) AS both,
 abs(a.y + a.h / 2 - b.y - b.h / 2) < 5 AS row, abs(a.x + a.w / 2 - b.x - b.w / 2) < 5 AS col,
 round(greatest(0.0, b.x - a.x - a.w), 4) AS gap_right, round(greatest(0.0, b.y - a.y - a.h), 4) AS gap_below
 FROM v_box a JOIN v_box b ON a.shot = b.shot AND a.pos < b.pos""",
    "overlapping_boxes": f"{_B} SELECT a.shot, a.pos AS a_pos, b.pos AS b_pos, round({_IOU}, 6) AS iou FROM v_box a JOIN v_box b ON a.shot = b.shot AND a.pos < b.pos AND {_TOUCH}",
    "contained_boxes": f"{_B} SELECT a.shot, a.pos AS a_pos, b.pos AS b_pos FROM v_box a JOIN v_box b ON a.shot = b.shot AND a.pos <> b.pos AND {_HOLD}",
    "box_parents": f"{_LINK} SELECT shot, pos, coalesce(parent, -1) AS parent FROM link",
    "box_depths": f"{_DEPTH} SELECT * FROM tree",
    "boxes_per_depth": f"{_DEPTH} SELECT depth, count(*) AS n FROM tree GROUP BY depth",
    "box_children": f"{_LINK} SELECT shot, parent, count(*) AS children FROM link WHERE parent IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
    "root_boxes": f"""{_B}, held AS (SELECT a.shot, a.pos, count(b.pos) AS held FROM v_box a LEFT JOIN v_box b ON a.shot = b.shot AND a.pos <> b.pos AND {_HOLD} GROUP BY 1, 2)
SELECT shot, pos, held FROM (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY held DESC, pos) AS k FROM held) WHERE k = 1""",
    "box_relationships": f"""{_GROUPS} SELECT shot, parent AS a, pos AS b, 'contains' AS kind, 1.0::DOUBLE AS strength, '-' AS layout FROM link WHERE parent IS NOT NULL
UNION ALL SELECT shot, members[i], members[i + 1], 'siblings', 0.9::DOUBLE, kind FROM (SELECT shot, kind, members, unnest(range(1, len(members))) AS i FROM grp)""",
    "sibling_groups": f"""{_GROUPS}, m AS (SELECT shot, parent, kind, members, spacing, unnest(members) AS pos FROM grp)
SELECT shot, parent, kind, array_to_string(members, ',') AS members, round(any_value(spacing), 4) AS spacing, {_ALIGN} AS alignment FROM m JOIN v_box USING (shot, pos) GROUP BY shot, parent, kind, members""",
    "sibling_grids": f"{_CHILD}, {_GRID} SELECT shot, parent, columns, rows, round(column_gap, 4) AS column_gap, round(row_gap, 4) AS row_gap, round(confidence, 4) AS confidence FROM grid",
    "layout_grid": f"{_CHILD}, {_GRID} SELECT shot, parent, columns, rows FROM (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY parent) AS k FROM grid WHERE confidence > 0.8) WHERE k = 1",
    "behaviour_hints": f"""{_LINK}, kids AS (SELECT shot, parent AS pos, count(*) AS children FROM link WHERE parent IS NOT NULL GROUP BY 1, 2),
t AS (SELECT shot, pos, {_TYPE} AS type, children FROM v_box LEFT JOIN kids USING (shot, pos))
SELECT shot, pos, 'clickable' AS hint, 0.8::DOUBLE AS confidence FROM t WHERE type IN ('button', 'link', 'icon', 'menu')
UNION ALL SELECT shot, pos, 'hoverable', 0.7 FROM t WHERE type IN ('link', 'button', 'menu')
UNION ALL SELECT shot, pos, 'scrollable', 0.6 FROM t WHERE type = 'container' AND children > 5
UNION ALL SELECT shot, pos, 'editable', 0.95 FROM t WHERE type IN ('input', 'textarea')""",
    "box_warnings": f"""{_B}, met AS (SELECT a.shot, count(*) AS n FROM v_box a JOIN v_box b ON a.shot = b.shot AND a.pos < b.pos AND {_TOUCH} GROUP BY 1)
SELECT shot, count(*) FILTER (confidence < 0.6) AS unsure, coalesce(any_value(n), 0) AS overlaps, count(*) FILTER (x < 0 OR y < 0) AS outside FROM v_box LEFT JOIN met USING (shot) GROUP BY shot""",
    "box_spacing": f"""{_B}, g AS (SELECT *, greatest(0.0, x - lag(x + w) OVER (PARTITION BY shot ORDER BY x, pos)) AS g0, lag(x) OVER (PARTITION BY shot ORDER BY x, pos) AS before FROM v_box)
SELECT shot, count(*) AS n, round(coalesce(avg(g0) FILTER (before IS NOT NULL), 0), 4) AS mean_gap, round(stddev_pop(w), 4) AS deviation,
 CASE WHEN round(stddev_pop(x), 6) < 5 THEN 'left' WHEN round(stddev_pop(x + w), 6) < 5 THEN 'right' WHEN round(stddev_pop(x + w / 2), 6) < 5 THEN 'center'
      WHEN round(stddev_pop(y), 6) < 5 THEN 'top' WHEN round(stddev_pop(y + h), 6) < 5 THEN 'bottom' ELSE 'mixed' END AS alignment FROM g GROUP BY shot""",
    "overall_confidence": f"{_B} SELECT shot, round(avg(confidence), 6) AS confidence FROM v_box GROUP BY shot",
    "type_distribution": f"{_B} SELECT {_TYPE} AS type, count(*) AS n FROM v_box GROUP BY 1",
    "largest_boxes": f"{_B} SELECT shot, pos, w * h AS area FROM v_box ORDER BY area DESC, shot, pos LIMIT 5",
    "suppressed_boxes": f"""{_B}, r AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY confidence DESC, pos) AS k FROM v_box),
hit AS (SELECT b.shot, b.k, list(a.k) AS over FROM r b JOIN r a ON a.shot = b.shot AND a.k < b.k AND {_IOU} > 0.4 GROUP BY 1, 2),
s AS (SELECT shot, list(k ORDER BY k) AS ks, max(k) AS n FROM r GROUP BY shot),
f(shot, k, n, kept) AS (SELECT shot, CAST(0 AS BIGINT), n, CAST([] AS BIGINT[]) FROM s
  UNION ALL SELECT f.shot, f.k + 1, f.n, CASE WHEN list_has_any(coalesce(h.over, []), f.kept) THEN f.kept ELSE list_append(f.kept, f.k + 1) END
  FROM f LEFT JOIN hit h ON h.shot = f.shot AND h.k = f.k + 1 WHERE f.k < f.n)
SELECT r.shot, r.pos FROM f JOIN r ON r.shot = f.shot AND list_contains(f.kept, r.k) WHERE f.k = f.n""",
    "parsed_detections": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings)
SELECT id, v[1] - v[3] / 2 AS x, v[2] - v[4] / 2 AS y, v[3] AS w, v[4] AS h, v[5] AS confidence, CAST(list_position(v[6:64], list_max(v[6:64])) - 1 AS INTEGER) AS type_no FROM v WHERE v[5] > 0.05""",
    "color_conversions": """WITH c AS (SELECT p_partkey, CAST(p_partkey * 7 % 256 AS INTEGER) AS r, CAST(p_partkey * 13 % 256 AS INTEGER) AS g, CAST(p_size * 5 % 256 AS INTEGER) AS b FROM part),
n AS (SELECT *, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM c),
m AS (SELECT *, greatest(rr, gg, bb) AS hi, least(rr, gg, bb) AS lo FROM n)
SELECT p_partkey, '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') AS hex,
 CAST(floor((CASE WHEN hi = lo THEN 0 WHEN hi = rr THEN (gg - bb) / (hi - lo) + CASE WHEN gg < bb THEN 6 ELSE 0 END WHEN hi = gg THEN (bb - rr) / (hi - lo) + 2 ELSE (rr - gg) / (hi - lo) + 4 END) / 6 * 360 + 0.5) AS INTEGER) AS h,
 CAST(floor((CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END) * 100 + 0.5) AS INTEGER) AS s,
 CAST(floor((hi + lo) / 2 * 100 + 0.5) AS INTEGER) AS l, r, g, b, round(sqrt(r * r + (g - 123) * (g - 123) + (b - 255) * (b - 255)), 4) AS distance FROM m""",
    "primary_colors": "SELECT count(DISTINCT (p_partkey * 7 % 256, p_partkey * 13 % 256, p_size * 5 % 256)) AS colors FROM part",
}
# numbers of the types whose text is read: text, input, link, header
ORACLE["read_boxes"] = f"WITH {v.BOX_SQL} SELECT shot, count(*) AS n, max(confidence) AS best FROM v_box WHERE type_no IN (0, 1, 3, 4, 7) GROUP BY shot"
