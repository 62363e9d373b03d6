import random

import pytest
from flowscope.functions import color, equations as eq, geometry as geo, jsjson, scoring as sc
from flowscope.functions.js import js_round
from flowscope.operators import elements as el
from flowscope.operators import frames as fr
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

import numpy as np


def one(spark, *cols):
    r = spark.range(1).select(*cols).head()
    return r[0] if len(cols) == 1 else tuple(r)


def box_rows(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r[:4]), float(r[4]) if len(r) > 4 else 0.9, 5) for i, r in enumerate(rows)], "shot long, pos long, x double, y double, w double, h double, confidence double, type_no int")


def test_color_goldens(spark):
    assert tuple(one(spark, color.hsl_of(F.lit(0), F.lit(123), F.lit(255)))) == (211, 100, 50)
    assert tuple(one(spark, color.rgb_of(F.lit("#007bff")))) == (0, 123, 255) and tuple(one(spark, color.rgb_of(F.lit("nope")))) == (0, 0, 0)
    assert one(spark, color.hex_of(F.lit(0), F.lit(123), F.lit(255))) == "#007bff"
    assert [one(spark, js_round(F.lit(x))) for x in (2.5, -2.5, -2.6)] == [3, -2, -3]


def test_overlap_goldens(spark):
    p = el.pairs(box_rows(spark, [(0, 0, 10, 10), (5, 5, 10, 10)]), F.col("a_pos") < F.col("b_pos"))
    assert abs(p.select(geo.iou()).head()[0] - 25 / 175) < 1e-12
    assert p.select(geo.touches(), geo.contains(), geo.mostly_contains()).head() == (True, False, False)
    flat = el.pairs(box_rows(spark, [(0, 0, 10, 10), (5, 5, 0, 10)]), F.col("a_pos") < F.col("b_pos"))
    assert flat.select(geo.mostly_contains()).head()[0] is False


def test_suppression_golden(spark):
    rows = [(0, 0, 10, 10, 0.9), (5, 5, 10, 10, 0.8), (1, 1, 10, 10, 0.7)]
    assert sorted(r.pos for r in el.suppressed(box_rows(spark, rows)).collect()) == [0, 1]


def test_grid_golden(spark):
    cells = [(10 + 60 * c, 10 + 60 * r, 50, 50) for r in range(2) for c in range(3)]
    boxes = box_rows(spark, [(0, 0, 200, 140), *cells])
    links = el.parents(boxes)
    assert {r.parent for r in links.collect() if r.pos} == {0}
    g = el.layout_grid(boxes, links).head()
    assert (g.columns, g.rows, g.column_gap, g.row_gap, g.confidence) == (3, 2, 10.0, 10.0, 1.0)
    kinds = sorted(r.kind for r in el.sibling_groups(boxes, links).collect())
    assert kinds == ["grid", "horizontal", "horizontal", "vertical", "vertical", "vertical"]
    assert el.roots(boxes).head() == (1, 0, 6)


@settings(max_examples=200, deadline=None)
@given(some.lists(some.lists(some.booleans(), min_size=6, max_size=6), min_size=6, max_size=6), some.booleans())
def test_labels_are_components(mask, eight):
    m = np.array(mask)
    out = fr.label(m, eight)
    assert ((out > 0) == m).all()
    for y in range(6):
        for x in range(6):
            for dy, dx in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else []):
                if m[y, x] and y + dy < 6 and 0 <= x + dx < 6 and m[y + dy, x + dx]:
                    assert out[y, x] == out[y + dy, x + dx]


def test_kind_of_a_moving_block():
    a, b = np.zeros((20, 20), int), np.zeros((20, 20), int)
    a[5:9, 5:9], b[5:9, 10:14] = 200, 200
    assert fr.kind_of(a, b, (5, 5, 4, 4), a > 0, 6, 1) == "disappearance"
    b2 = b.copy()
    b2[5:9, 5:9] = 60
    assert fr.kind_of(a, b2, (5, 5, 4, 4), a > 0, 6, 1) == "movement"
    assert fr.kind_of(a, np.where(a, 100, 0), (5, 5, 4, 4), a > 0, 6, 1) == "style"


def test_scores(spark):
    kind = sc.correlation_type(F.lit(0.52), F.lit(0.0), sc.delay(F.lit(0.52)), F.lit(0))
    assert one(spark, kind) == "animated"
    assert abs(one(spark, sc.correlation_confidence(sc.delay(F.lit(0.52)), F.lit(0.0), F.lit(0.0), kind)) - 0.45) < 1e-12
    assert abs(one(spark, sc.slice_confidence(F.lit(100.0), F.lit(2), F.lit(0))) - 0.52) < 1e-12
    assert one(spark, sc.chain_confidence(F.lit(0.5), F.lit(1))) == 0.5
    assert abs(one(spark, sc.chain_confidence(F.lit(0.5), F.lit(1), True)) - 0.7) < 1e-12
    assert one(spark, sc.element_type(F.lit("input"), F.lit(None).cast("string"), F.lit("submit"))) == "button"
    assert abs(one(spark, sc.element_confidence(F.lit("a"), F.lit(True), F.lit(False))) - 0.9) < 1e-12
    assert one(spark, sc.importance(F.lit("header"), F.array(F.lit("hero")), F.lit(False))) == 0.95


def test_formulas(spark):
    assert eq.evaluate("1 + 0.05 * hover", {"hover": 5}, 1, 1.05) == 1.05
    assert eq.evaluate("-(x - 2) * max / 4", {"x": 1, "max": 8}) == 2 and eq.evaluate("1 / x", {"x": 0}) is None
    assert one(spark, eq.column("2 * (a + 1) / a", {"a": F.lit(4.0)})) == 2.5
    for bad in ("import os", "a b", "1 +", "(1", "__x__()", "a;b", ""):
        with pytest.raises(ValueError):
            eq.evaluate(bad, {"a": 1, "b": 2})


@settings(max_examples=200, deadline=None)
@given(some.integers(-50, 50), some.integers(-50, 50), some.integers(1, 9))
def test_formulas_like_python(a, b, c):
    assert abs(eq.evaluate("a * b - (a + c) / c", {"a": a, "b": b, "c": c}) - (a * b - (a + c) / c)) < 1e-9


def test_json_as_a_browser_writes_it():
    assert jsjson.stringify({"b": 1.0, "a": [None, True, 1e21, 1e-7, 0.1, -2.5e-9], "é": " \"x"}) == '{"b":1,"a":[null,true,1e+21,1e-7,0.1,-2.5e-9],"é":" \\"x"}'
    assert jsjson.number(1e20) == "100000000000000000000" and jsjson.number(1.5e300) == "1.5e+300" and jsjson.number(0.00001) == "0.00001"


def test_boxes_that_touch_are_one():
    rng = random.Random(3)
    for _ in range(60):
        boxes = [(rng.randrange(30), rng.randrange(30), rng.randrange(1, 6), rng.randrange(1, 6)) for _ in range(rng.randrange(9))]
        want = {(x, y, x + w, y + h) for x, y, w, h in boxes}
        while True:  # by definition: join any two that touch until none do
            hit = next(((a, b) for a in want for b in want if a < b and a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]), None)
            if hit is None:
                break
            a, b = hit
            want = (want - {a, b}) | {(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))}
        assert sorted(fr.joined(boxes)) == sorted((x, y, u - x, v - y) for x, y, u, v in want)


def test_frames_of_other_sizes(spark):
    """Twice as wide as high, by plain loops."""
    rng = random.Random(5)
    a, b = ([rng.randrange(256) for _ in range(32)] for _ in range(2))
    df = spark.createDataFrame([(1, 1, a, b)], "session long, frame_no long, px array<int>, prev_px array<int>")

    def edges(p):
        out = [0] * 32
        for y in range(1, 3):
            for x in range(1, 7):
                at = lambda dy, dx: p[(y + dy) * 8 + x + dx]  # noqa: E731, B023
                gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
                gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
                out[y * 8 + x] = int((gx * gx + gy * gy) ** 0.5) % 256
        return out

    assert df.select(fr.sobel("px", 8)).head()[0] == edges(a)
    got = fr.metrics(df, side=8).head()
    assert abs(got.edge_diff - sum(abs(x - y) for x, y in zip(edges(a), edges(b))) / 32) < 1e-9
    assert abs(got.color_diff - sum(abs(a[i * 6] - b[i * 6]) for i in range(5)) / 1275) < 1e-9
    assert fr.content_bounds(df.select("frame_no", "px"), 0, 8).head().h == 4
    one = fr.region_measures(df, 8).head()
    assert one.size == sum(x > 10 for x in a)
    both = spark.createDataFrame([([0], [0, 0])], "px array<int>, prev_px array<int>")
    assert both.select(fr.visual_similarity(planes=fr.GREY)).head()[0] == 0.0


def test_a_crowded_shot_on_a_grid(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.uniform(0, 400), rng.uniform(0, 300), rng.choice([5.0, 12.0, 60.0, 390.0]), rng.choice([4.0, 9.0, 250.0]), 0.9, 5) for i in range(150)]
    boxes = spark.createDataFrame(rows, "shot long, pos long, x double, y double, w double, h double, confidence double, type_no int")
    touch = lambda a, b: a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5]
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and touch(a, b)}
    for grid_from in (64, 10**6):
        got = [(r.a_pos, r.b_pos) for r in el.meeting(boxes, F.col("a_pos") < F.col("b_pos"), grid_from).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    parents = {r.pos: r.parent for r in el.parents(boxes).collect()}
    area = sorted(rows, key=lambda r: (-r[4] * r[5], r[1]))
    both = lambda a, b: max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    for i, b in enumerate(area):
        over = [a[1] for a in area[:i] if both(a, b) / (b[4] * b[5]) >= 0.9]
        assert parents[b[1]] == (over[-1] if over else None)
