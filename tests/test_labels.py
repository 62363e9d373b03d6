import random
import time

import numpy as np
import pyarrow as pa
from flowscope.operators import frames as fr
from flowscope.operators.labels import label, least_of_each, lists, measured, numbered_runs, regions_by_strips
from hypothesis import given, settings
from hypothesis import strategies as some


def flooded(mask, eight):
    """Labels by flooding from each pixel that has none yet."""
    out, n = np.zeros(mask.shape, int), 0
    near = [(-1, 0), (1, 0), (0, -1), (0, 1)] + [(-1, -1), (-1, 1), (1, -1), (1, 1)] * eight
    for y, x in np.argwhere(mask):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + dy, b + dx) for dy, dx in near]
    return out


@settings(max_examples=300, deadline=None)
@given(some.integers(1, 9), some.integers(0, 12), some.integers(0, 2**32 - 1), some.booleans())
def test_labels_equal_flooding(width, height, seed, eight):
    mask = np.random.default_rng(seed).random((height, width)) < 0.55
    assert np.array_equal(label(mask, eight), flooded(mask, eight))


def test_a_spiral_is_one_component():
    n = 101
    mask = np.zeros((n, n), bool)
    y = x = 0
    dy, dx, reach = 0, 1, n - 1
    while reach > 0:
        for _ in range(2 if reach < n - 1 else 3):
            for _ in range(reach):
                mask[y, x] = True
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
        reach -= 2
    assert label(mask, False).max() == flooded(mask, False).max()


def test_chains_join_in_few_rounds():
    n = 200_000
    order = np.random.default_rng(1).permutation(n)
    began = time.perf_counter()
    assert not least_of_each(n, order[:-1], order[1:]).any() and time.perf_counter() - began < 10


def test_measures_of_components():
    rng = np.random.default_rng(2)
    diff = rng.integers(0, 60, (30, 41))
    marks = flooded(diff > 30, True)
    got = measured(diff, *numbered_runs(diff > 30))
    assert len(got["n"]) == marks.max()
    for k in range(1, marks.max() + 1):
        ys, xs = np.nonzero(marks == k)
        want = (len(xs), diff[ys, xs].sum(), xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)
        assert tuple(got[c][k - 1] for c in ("n", "sum", "x0", "y0", "x1", "y1")) == want
    assert len(measured(diff, *numbered_runs(diff > 99))["n"]) == 0


def test_views_of_lists():
    column = pa.array([[1, 2], None, [], [3]], pa.list_(pa.int32()))
    assert [x.tolist() for x in lists(column)] == [[1, 2], [], [], [3]]
    assert [x.tolist() for x in lists(column[1:])] == [[], [], [3]]


def test_frames_of_full_size_take_seconds(spark):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 256, 1920 * 1080).astype(np.int32) for _ in range(2))
    pair = spark.createDataFrame(pa.table({"session": [1], "frame_no": [2], "px": [a], "prev_px": [b]}))
    began = time.perf_counter()
    whole = fr.regions(pair, threshold=150, side=1920, kinds=False).drop("region").toPandas()
    assert time.perf_counter() - began < 30 and len(whole) > 20_000
    parted = regions_by_strips(pair, threshold=150, side=1920, high=128).toPandas()
    order = ["y", "x", "n", "w", "h"]
    whole, parted = (t.sort_values(order).reset_index(drop=True)[parted.columns] for t in (whole, parted))
    assert whole.drop(columns=["intensity", "confidence"]).equals(parted.drop(columns=["intensity", "confidence"]))
    assert np.allclose(whole[["intensity", "confidence"]], parted[["intensity", "confidence"]])


def test_strips_of_any_height_equal_the_whole(spark):
    rng = random.Random(4)
    rows = [(s, f, [rng.choice([0, 90]) for _ in range(7 * 11)], [0] * 77) for s in (1, 2) for f in (1, 2)] + [(3, 1, [0] * 77, [0] * 77)]
    pairs = spark.createDataFrame(rows, "session int, frame_no int, px array<int>, prev_px array<int>")
    cols = ["session", "frame_no", "n", "x", "y", "w", "h", "intensity", "confidence"]
    want = sorted(tuple(r) for r in fr.regions(pairs, least=1, side=7, kinds=False).select(cols).collect())
    for high in (1, 2, 5, 11, 50):
        assert sorted(tuple(r) for r in regions_by_strips(pairs, least=1, side=7, high=high).select(cols).collect()) == want
