"""Registered queries on frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.operators import frames as fr
from flowscope.operators import labels as lb
from flowscope.operators import pixels as px
from flowscope.operators import properties as pr
from flowscope.plans import views as v


def _rounded(df, keys, cols, digits=5):
    return df.select(*keys, *(F.round(c, digits).alias(c) for c in cols))


def _looks(s, d):
    """Two crops of each frame: its left upper part, and one that begins outside and is wider than the frame."""
    i = v.frames(s, d).select(F.col("frame_no").alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("px").alias("r"), F.col("px").alias("g"), F.col("px").alias("b"), "px", F.transform("px", lambda x: 255 - x).alias("alpha"))
    at = F.array(F.struct(F.lit(0).alias("pos"), F.lit(1.0).alias("x"), F.lit(2.5).alias("y"), F.lit(5.0).alias("w"), F.lit(4.9).alias("h"), F.lit("button").alias("type")), F.struct(F.lit(1).alias("pos"), F.lit(-3.0).alias("x"), F.lit(3.0).alias("y"), F.lit(99.0).alias("w"), F.lit(2.0).alias("h"), F.lit("image").alias("type")))
    return pr.extracted(pr.crops(i, i.select("image", F.inline(at))), pr.frequent())


_KEYS = ["session", "frame_no"]
QUERIES = {
    "frame_pair_metrics": lambda s, d: _rounded(fr.metrics(v.frame_pairs(s, d)), _KEYS, ["mse", "psnr", "ssim", "histogram_diff", "edge_diff", "color_diff"]),
    "frame_changes": lambda s, d: _rounded(fr.metrics(v.frame_pairs(s, d)), [*_KEYS, F.col("changed_pixels").cast("bigint").alias("changed_pixels")], ["changed_pct", "intensity", "max_diff", "mean_diff"]),
    "frame_histograms": lambda s, d: v.frames(s, d).select("frame_no", F.explode("px").alias("bin")).groupBy("frame_no", "bin").agg(F.count("*").alias("n")),
    "frame_edges": lambda s, d: v.frames(s, d).select("frame_no", F.array_join(fr.sobel(), ",").alias("edges")),
    "dominant_colors": lambda s, d: v.frames(s, d).select("frame_no", F.array_join(fr.dominant(), ",").alias("colors")),
    "frame_measures": lambda s, d: fr.region_measures(v.frame_pairs(s, d)).select(*_KEYS, F.round("similarity", 6).alias("similarity"), F.col("size").cast("bigint").alias("size"), "empty", F.round("average", 5).alias("average"), "style", "resized", "text", "animated"),
    "content_bounds": lambda s, d: fr.content_bounds(v.frames(s, d), 120).select("frame_no", *(F.col(c).cast("bigint").alias(c) for c in ("x", "y", "w", "h")), "alignment"),
    "changed_regions": lambda s, d: fr.regions(v.frame_pairs(s, d), kinds=False).select(*_KEYS, "n", "x", "y", "w", "h", F.round("intensity", 6).alias("intensity"), F.round("confidence", 6).alias("confidence")),
    "color_pair_metrics": lambda s, d: _rounded(fr.metrics(v.color_pairs(s, d), planes=fr.RGB), _KEYS, ["mse", "psnr", "histogram_diff", "edge_diff", "color_diff"]),
    "color_measures": lambda s, d: fr.region_measures(v.color_pairs(s, d), planes=fr.RGB).select(*_KEYS, F.round("similarity", 6).alias("similarity"), F.col("size").cast("bigint").alias("size"), F.round("average", 5).alias("average"), "style"),
    "visual_similarity": lambda s, d: v.color_pairs(s, d).select(*_KEYS, F.round(fr.visual_similarity(), 6).alias("similarity")),
    "perceived_similarity": lambda s, d: v.color_pairs(s, d).select(*_KEYS, F.round(px.like(fr.SIDE, 0.05), 6).alias("similarity")),
    "frame_palettes": lambda s, d: v.color_pairs(s, d).select(
        *_KEYS, F.array_join(F.transform(px.palette(5, 1), lambda c: F.concat_ws(" ", c["r"], c["g"], c["b"])), ",").alias("palette")
    ),
    "visual_differences": lambda s, d: fr.visual_differences(v.color_pairs(s, d)),
    "content_padding": lambda s, d: fr.content_bounds(v.frames(s, d), 120).select("frame_no", *(F.col(f"padding.{c}").cast("bigint").alias(c) for c in ("top", "right", "bottom", "left"))),
    "element_looks": lambda s, d: _looks(s, d).select("image", "pos", "width", "height", F.col("colors.background.r").alias("back_r"), F.col("colors.foreground.r").alias("fore_r"), F.coalesce("gradient.angle", F.lit(0)).alias("angle"), F.round("opacity", 6).alias("opacity"), *(F.col(f"padding.{k}").alias(f"pad_{k}") for k in ("top", "right", "bottom", "left")), F.coalesce("typography.size", F.lit(0)).alias("font"), F.coalesce("typography.align", F.lit("")).alias("align")),
    "strip_regions": lambda s, d: lb.regions_by_strips(v.frame_pairs(s, d), side=fr.SIDE, high=3).select(
        *_KEYS, "n", "x", "y", "w", "h", F.round("intensity", 6).alias("intensity"), F.round("confidence", 6).alias("confidence")
    ),
    "region_kinds": lambda s, d: fr.regions(v.frame_pairs(s, d), reach=4, step=1).select(*_KEYS, "region", "kind"),
    "total_regions": lambda s, d: fr.regions(v.frame_pairs(s, d), kinds=False).groupBy("session").agg(F.count("*").alias("n")),
}

_P = f"WITH RECURSIVE {v.PAIR_SQL}"
_DIFF = "list_transform(list_zip(px, prev_px), lambda z: abs(z[1] - z[2]))"


def _sobel(px):
    at = lambda dy, dx: f"{px}[i + {dy * 8 + dx} + 1]"
    gx = f"({at(-1, 1)} + 2 * {at(0, 1)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(0, -1)} - {at(1, -1)})"
    gy = f"({at(1, -1)} + 2 * {at(1, 0)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(-1, 0)} - {at(-1, 1)})"
    return f"list_transform(range(0, 64), lambda i: CASE WHEN i // 8 IN (0, 7) OR i % 8 IN (0, 7) THEN 0 ELSE CAST(floor(sqrt({gx} * {gx} + {gy} * {gy})) AS BIGINT) % 256 END)"


_FRAME = f"WITH {v.FRAME_SQL}"
_IN = "list_filter(range(0, 64), lambda i: px[i + 1] < 120)"
_XS, _YS = f"list_transform({_IN}, lambda i: i % 8)", f"list_transform({_IN}, lambda i: i // 8)"
_TURN = "len(list_filter(range(0, 64), lambda i: ({0}[i + 1] > 128) <> (i % 8 <> 0 AND {0}[CASE WHEN i = 0 THEN 1 ELSE i END] > 128))) / 64.0::DOUBLE"
_RADII = "list_transform(list_filter(range(0, 64), lambda i: abs(px[i + 1] - prev_px[i + 1]) > 25), lambda i: sqrt((i % 8 - 4) * (i % 8 - 4) + (i // 8 - 4) * (i // 8 - 4)))"
_BIG = "len(list_filter({0}, lambda p: p > 10))"
_C = f"WITH RECURSIVE {v.RGB_SQL}"
_Z = "list_zip(r, g, b, prev_r, prev_g, prev_b)"
_YIQ = [(0.29889531, 0.58662247, 0.11448223, 0.5053), (0.59597799, -0.2741761, -0.32180189, 0.299), (0.21147017, -0.52261711, 0.31114694, 0.1957)]
_FAR = " + ".join(f"{k}::DOUBLE * pow({a}::DOUBLE * (z[1] - z[4]) + {b}::DOUBLE * (z[2] - z[5]) + {c}::DOUBLE * (z[3] - z[6]), 2)" for a, b, c, k in _YIQ)
_AVG = lambda p: f"list_avg({p})"
# a region's kind, on its own pixels of both frames
_KIND = """{P}, c AS (SELECT session, frame_no, i, d FROM (SELECT session, frame_no, unnest(range(0, 64)) AS i, unnest({DIFF}) AS d FROM v_pair) WHERE d > 25),
near AS (SELECT a.session, a.frame_no, a.i AS a, b.i AS b FROM c a JOIN c b ON a.frame_no = b.frame_no AND abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1),
r(session, frame_no, a, b) AS (SELECT session, frame_no, i, i FROM c UNION SELECT r.session, r.frame_no, r.a, n.b FROM r JOIN near n ON n.frame_no = r.frame_no AND n.a = r.b),
l AS (SELECT session, frame_no, a AS i, min(b) AS label FROM r GROUP BY 1, 2, 3),
g AS (SELECT session, frame_no, label, count(*) AS n, min(i % 8) AS x, min(i // 8) AS y, max(i % 8) - min(i % 8) + 1 AS w, max(i // 8) - min(i // 8) + 1 AS h FROM l GROUP BY 1, 2, 3),
k AS (SELECT g.*, dense_rank() OVER (PARTITION BY frame_no ORDER BY label) AS region FROM g),
rad AS (SELECT k.frame_no, k.label, avg(sqrt(pow(i % 8 - x - w / 2.0::DOUBLE, 2) + pow(i // 8 - y - h / 2.0::DOUBLE, 2))) AS radius FROM k JOIN l ON l.frame_no = k.frame_no AND l.label = k.label GROUP BY 1, 2),
t AS (SELECT k.*, radius, px, prev_px, list_filter(range(0, 64), lambda i: i % 8 >= x AND i % 8 < x + w AND i // 8 >= y AND i // 8 < y + h) AS cells FROM k JOIN rad USING (frame_no, label) JOIN v_pair p ON p.frame_no = k.frame_no WHERE n >= 2),
u AS (SELECT *, list_transform(cells, lambda i: px[i + 1]) AS b, list_transform(cells, lambda i: prev_px[i + 1]) AS a,
  len(list_filter(cells, lambda i: (px[i + 1] > 128) <> (i % 8 > x AND px[greatest(i, 1)] > 128))) / len(cells)::DOUBLE AS tb, len(list_filter(cells, lambda i: (prev_px[i + 1] > 128) <> (i % 8 > x AND prev_px[greatest(i, 1)] > 128))) / len(cells)::DOUBLE AS ta FROM t),
s AS (SELECT *, len(list_filter(a, lambda p: p > 10)) AS sa, len(list_filter(b, lambda p: p > 10)) AS sb,
  len(list_filter(range(0, 81), lambda m: m <> 40 AND x + m % 9 - 4 >= 0 AND y + m // 9 - 4 >= 0 AND x + m % 9 - 4 + w <= 8 AND y + m // 9 - 4 + h <= 8
    AND len(list_filter(cells, lambda i: 3 * abs(px[i + 8 * (m // 9 - 4) + m % 9 - 4 + 1] - prev_px[i + 1]) < 30)) / len(cells)::DOUBLE > 0.9)) AS moves FROM u)
SELECT session, frame_no, region, CASE WHEN sa = 0 AND sb > 0 THEN 'appearance' WHEN sa > 0 AND sb = 0 THEN 'disappearance' WHEN moves > 0 THEN 'movement' WHEN sa > 0 AND NOT (sb / sa::DOUBLE BETWEEN 0.8 AND 1.2) THEN 'transformation'
  WHEN sqrt(3.0::DOUBLE) * abs(list_avg(a) - list_avg(b)) > 50 THEN 'style' WHEN abs(ta - tb) > 0.2 THEN 'text' WHEN abs(radius - sqrt(w * h) / 2) < 0.3 * sqrt(w * h) / 2 THEN 'animation' ELSE 'complex' END AS kind FROM s"""
# the crop (1, 2, 5, 4) and the crop (0, 3, 8, 2) of a grey frame; a palette colour is the mean of the pixels in an eighth of 256
_LOOKS = f"""{_FRAME}, b AS (SELECT frame_no AS image, CAST(pos AS INTEGER) AS pos, w AS width, h AS height, list_transform(list_filter(range(0, 64), lambda i: i % 8 >= x AND i % 8 < x + w AND i // 8 >= y AND i // 8 < y + h), lambda i: px[i + 1]) AS p
  FROM v_frame, (VALUES (0, 1, 2, 5, 4), (1, 0, 3, 8, 2)) AS c(pos, x, y, w, h)),
k AS (SELECT *, [p[1], p[width], p[width * (height - 1) + 1], p[width * height]] AS corner, list_filter(range(0, len(p)), lambda i: p[i + 1] < 240) AS inside FROM b),
g AS (SELECT *, list_transform(corner, lambda c: len(list_filter(corner, lambda d: d = c))) AS n FROM k),
u AS (SELECT image, pos, unnest(p) AS x FROM b), q AS (SELECT image, pos, x // 8 AS code, count(*) AS n, CAST(floor(avg(x) + 0.5) AS INTEGER) AS c FROM u GROUP BY 1, 2, 3),
t AS (SELECT image, pos, list(c ORDER BY n DESC, code) AS pal FROM (SELECT *, row_number() OVER (PARTITION BY image, pos ORDER BY n DESC, code) AS k FROM q) WHERE k <= 5 GROUP BY 1, 2),
z AS (SELECT *, corner[list_position(n, list_max(n))] AS back, list_min(list_transform(inside, lambda i: i % width)) AS x0, list_max(list_transform(inside, lambda i: i % width)) AS x1, list_min(list_transform(inside, lambda i: i // width)) AS y0, list_max(list_transform(inside, lambda i: i // width)) AS y1,
  p[width // 2 + 1] AS top, p[width * (height - 1) + width // 2 + 1] AS low, p[width * (height // 2) + 1] AS lef, p[width * (height // 2) + width] AS rig FROM g JOIN t USING (image, pos))
SELECT image, pos, width, height, back AS back_r, CASE WHEN list_max(list_transform(pal, lambda c: abs(c - back))) > 0 THEN pal[list_position(list_transform(pal, lambda c: abs(c - back)), list_max(list_transform(pal, lambda c: abs(c - back))))] ELSE 0 END AS fore_r,
 CASE WHEN sqrt(3.0::DOUBLE) * abs(top - low) > 30 THEN 180 WHEN sqrt(3.0::DOUBLE) * abs(lef - rig) > 30 THEN 90 ELSE 0 END AS angle, round((255 - list_avg(p)) / 255, 6) AS opacity,
 y0 AS pad_top, width - x1 AS pad_right, height - y1 AS pad_bottom, x0 AS pad_left, CASE WHEN pos = 0 THEN CAST(floor(height * 0.7 + 0.5) AS INTEGER) ELSE 0 END AS font,
 CASE WHEN pos = 1 THEN '' WHEN abs(x0 - (width - x1)) < 5 THEN 'center' WHEN x0 < width - x1 THEN 'left' ELSE 'right' END AS align FROM z"""
ORACLE = {
    "element_looks": _LOOKS,
    "region_kinds": _KIND.replace("{P}", _P).replace("{DIFF}", _DIFF),
    "color_pair_metrics": f"""{_C}, m AS (SELECT *, list_sum(list_transform({_Z}, lambda z: CAST(pow(z[1] - z[4], 2) + pow(z[2] - z[5], 2) + pow(z[3] - z[6], 2) AS DOUBLE))) / 192 AS e, {_sobel('r')} AS e1, {_sobel('prev_r')} AS e2, list_concat(r, g, b) AS a1, list_concat(prev_r, prev_g, prev_b) AS a0 FROM v_rgb)
SELECT session, frame_no, round(e, 5) AS mse, CASE WHEN e = 0 THEN 'inf'::DOUBLE ELSE round(10 * log10(65025.0::DOUBLE / e), 5) END AS psnr,
 round(list_sum(list_transform(range(0, 256), lambda k: CAST(abs(len(list_filter(a1, lambda p: p = k)) - len(list_filter(a0, lambda p: p = k))) AS DOUBLE))) / 192, 5) AS histogram_diff,
 round(list_sum(list_transform(list_zip(e1, e2), lambda z: CAST(abs(z[1] - z[2]) AS DOUBLE))) / 64, 5) AS edge_diff,
 round(list_sum(list_transform([1, 13, 25, 37, 49], lambda i: sqrt(CAST(pow(r[i] - prev_r[i], 2) + pow(g[i] - prev_g[i], 2) + pow(b[i] - prev_b[i], 2) AS DOUBLE)))) / (5 * sqrt(3 * 65025.0::DOUBLE)), 5) AS color_diff FROM m""",
    "color_measures": f"""{_C} SELECT session, frame_no, round(len(list_filter({_Z}, lambda z: abs(z[1] - z[4]) + abs(z[2] - z[5]) + abs(z[3] - z[6]) < 30)) / 64.0::DOUBLE, 6) AS similarity,
 len(list_filter(list_zip(r, g, b), lambda z: z[1] > 10 OR z[2] > 10 OR z[3] > 10)) AS size, round((list_avg(r) + list_avg(g) + list_avg(b)) / 3, 5) AS average,
 sqrt(pow(list_avg(r) - list_avg(prev_r), 2) + pow(list_avg(g) - list_avg(prev_g), 2) + pow(list_avg(b) - list_avg(prev_b), 2)) > 50 AS style FROM v_rgb""",
    "visual_similarity": f"{_C} SELECT session, frame_no, round(1 - len(list_filter({_Z}, lambda z: {_FAR} > 352.15::DOUBLE)) / 64.0::DOUBLE, 6) AS similarity FROM v_rgb",
    "content_padding": f"""{_FRAME}, m AS (SELECT frame_no, coalesce(list_min({_XS}), 0) AS x0, coalesce(list_max({_XS}), 7) AS x1, coalesce(list_min({_YS}), 0) AS y0, coalesce(list_max({_YS}), 7) AS y1 FROM v_frame)
SELECT frame_no, y0 AS top, 8 - x1 AS right, 8 - y1 AS bottom, x0 AS left FROM m""",
    "frame_pair_metrics": f"""{_P}, m AS (SELECT *, list_sum(list_transform({_DIFF}, lambda x: CAST(x * x AS DOUBLE))) / 64 AS e, {_sobel('px')} AS e1, {_sobel('prev_px')} AS e2 FROM v_pair)
SELECT session, frame_no, round(e, 5) AS mse, CASE WHEN e = 0 THEN 'inf'::DOUBLE ELSE round(10 * log10(65025.0::DOUBLE / e), 5) END AS psnr, round(1 - e / 65025.0::DOUBLE, 5) AS ssim,
 round(list_sum(list_transform(range(0, 256), lambda k: CAST(abs(len(list_filter(px, lambda p: p = k)) - len(list_filter(prev_px, lambda p: p = k))) AS DOUBLE))) / 64, 5) AS histogram_diff,
 round(list_sum(list_transform(list_zip(e1, e2), lambda z: CAST(abs(z[1] - z[2]) AS DOUBLE))) / 64, 5) AS edge_diff,
 round(list_sum(list_transform([1, 13, 25, 37, 49], lambda i: CAST(abs(px[i] - prev_px[i]) AS DOUBLE))) / 1275.0::DOUBLE, 5) AS color_diff FROM m""",
    "frame_changes": f"""{_P}, m AS (SELECT session, frame_no, {_DIFF} AS diff, list_filter({_DIFF}, lambda x: x > 25) AS c FROM v_pair)
SELECT session, frame_no, len(c) AS changed_pixels, round(100.0::DOUBLE * len(c) / 64, 5) AS changed_pct, round(coalesce(list_sum(list_transform(c, lambda x: CAST(x AS DOUBLE))) / len(c) / 255, 0), 5) AS intensity,
 CAST(list_max(diff) AS DOUBLE) AS max_diff, round(list_sum(list_transform(diff, lambda x: CAST(x AS DOUBLE))) / 64, 5) AS mean_diff FROM m""",
    "frame_histograms": f"{_FRAME} SELECT frame_no, bin, count(*) AS n FROM (SELECT frame_no, unnest(px) AS bin FROM v_frame) GROUP BY 1, 2",
    "frame_edges": f"{_FRAME} SELECT frame_no, array_to_string({_sobel('px')}, ',') AS edges FROM v_frame",
    "dominant_colors": f"{_FRAME} SELECT frame_no, array_to_string([px[1], px[13], px[25], px[37], px[49]], ',') AS colors FROM v_frame",
    "frame_measures": f"""{_P}, m AS (SELECT session, frame_no, px, prev_px, {_BIG.format('px')} AS s1, {_BIG.format('prev_px')} AS s0, list_avg(px) AS a1, list_avg(prev_px) AS a0,
  {_TURN.format('px')} AS t1, {_TURN.format('prev_px')} AS t0, list_avg({_RADII}) AS radius FROM v_pair)
SELECT session, frame_no, round(len(list_filter({_DIFF}, lambda x: 3 * x < 30)) / 64.0::DOUBLE, 6) AS similarity, s1 AS size, s1 = 0 AS empty, round(a1, 5) AS average,
 sqrt(3.0::DOUBLE) * abs(a1 - a0) > 50 AS style, CASE WHEN s0 = 0 THEN s1 > 0 ELSE s1 / s0 < 0.8 OR s1 / s0 > 1.2 END AS resized, abs(t1 - t0) > 0.2 AS text, coalesce(abs(radius - 4) < 1.2, false) AS animated FROM m""",
    "content_bounds": f"""{_FRAME}, m AS (SELECT frame_no, coalesce(list_min({_XS}), 0) AS x0, coalesce(list_max({_XS}), 7) AS x1, coalesce(list_min({_YS}), 0) AS y0, coalesce(list_max({_YS}), 7) AS y1 FROM v_frame)
SELECT frame_no, x0 AS x, y0 AS y, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, CASE WHEN abs(x0 - (8 - x1)) < 5 THEN 'center' WHEN x0 < 8 - x1 THEN 'left' ELSE 'right' END AS alignment FROM m""",
    "changed_regions": f"""{_P}, c AS (SELECT session, frame_no, i, d FROM (SELECT session, frame_no, unnest(range(0, 64)) AS i, unnest({_DIFF}) AS d FROM v_pair) WHERE d > 25),
near AS (SELECT a.session, a.frame_no, a.i AS a, b.i AS b FROM c a JOIN c b ON a.frame_no = b.frame_no AND abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1),
r(session, frame_no, a, b) AS (SELECT session, frame_no, i, i FROM c UNION SELECT r.session, r.frame_no, r.a, n.b FROM r JOIN near n ON n.frame_no = r.frame_no AND n.a = r.b),
l AS (SELECT session, frame_no, a AS i, min(b) AS label FROM r GROUP BY 1, 2, 3),
g AS (SELECT l.session, l.frame_no, label, count(*) AS n, min(i % 8) AS x, min(i // 8) AS y, max(i % 8) - min(i % 8) + 1 AS w, max(i // 8) - min(i // 8) + 1 AS h, avg(d) / 255 AS intensity FROM l JOIN c USING (session, frame_no, i) GROUP BY 1, 2, 3)
SELECT session, frame_no, n, x, y, w, h, round(intensity, 6) AS intensity, round((least(n / 1000.0::DOUBLE, 1) + intensity) / 2, 6) AS confidence FROM g WHERE n >= 2""",
}
ORACLE["total_regions"] = "SELECT session, count(*) AS n FROM (" + ORACLE["changed_regions"] + ") GROUP BY session"
ORACLE["strip_regions"] = ORACLE["changed_regions"]
# smoothed edges: neighbours column by column, the first darkest and brightest of them, and how many are of a pixel's own colour
_Y = " + ".join(f"{w}::DOUBLE * {p}" for w, p in zip(_YIQ[0], "rgb"))
_SHIFTS = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate((x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y))
ORACLE["perceived_similarity"] = f"""{_C},
img AS (SELECT frame_no, o, i, r, g, b, {_Y} AS y FROM (
  SELECT frame_no, 0 AS o, unnest(range(0, 64)) AS i, unnest(prev_r) AS r, unnest(prev_g) AS g, unnest(prev_b) AS b FROM v_rgb
  UNION ALL SELECT frame_no, 1, unnest(range(0, 64)), unnest(r), unnest(g), unnest(b) FROM v_rgb)),
nb AS (SELECT a.frame_no, a.o, a.i, k, b.i AS j, a.y - b.y AS d, a.r = b.r AND a.g = b.g AND a.b = b.b AS same
  FROM img a JOIN (VALUES {_SHIFTS}) AS s(k, dx, dy) ON a.i % 8 + dx BETWEEN 0 AND 7 AND a.i // 8 + dy BETWEEN 0 AND 7
  JOIN img b ON b.frame_no = a.frame_no AND b.o = a.o AND b.i = a.i + dx + 8 * dy),
one AS (SELECT frame_no, o, i, CASE WHEN i % 8 IN (0, 7) OR i // 8 IN (0, 7) THEN 1 ELSE 0 END AS edge, count(*) FILTER (d = 0) AS zeroes,
  count(*) FILTER (same) AS own, min(d) AS mn, max(d) AS mx, arg_min(j, (d, k)) AS lo, arg_min(j, (-d, k)) AS hi FROM nb GROUP BY 1, 2, 3),
solid AS (SELECT frame_no, i, bool_and(own + edge > 2) AS solid FROM one GROUP BY 1, 2),
soft AS (SELECT one.frame_no, one.i, bool_or(zeroes + edge <= 2 AND mn < 0 AND mx > 0 AND (l.solid OR h.solid)) AS soft FROM one
  JOIN solid l ON l.frame_no = one.frame_no AND l.i = lo JOIN solid h ON h.frame_no = one.frame_no AND h.i = hi GROUP BY 1, 2),
far AS (SELECT session, frame_no, unnest(range(0, 64)) AS i, unnest(list_transform({_Z}, lambda z: {_FAR} > {35215 * 0.05 * 0.05}::DOUBLE)) AS far FROM v_rgb)
SELECT session, frame_no, round(1 - count(*) FILTER (far AND NOT soft) / 64.0::DOUBLE, 6) AS similarity FROM far JOIN soft USING (frame_no, i) GROUP BY 1, 2"""
