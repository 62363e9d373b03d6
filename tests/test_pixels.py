"""Palettes and smoothed edges against plain loops over pixels, and by hand."""

import numpy as np
from flowscope.operators import explore as ex
from flowscope.operators import frames as fr
from flowscope.operators import pixels as px
from pyspark.sql import functions as F


def plain_cut(colours, n):
    """Median cut over a dictionary of five-bit colours, box by box; bounds are inclusive."""
    bins = {}
    for c in colours:
        if not all(x > 250 for x in c):
            k = tuple(x // 8 for x in c)
            bins[k] = bins.get(k, 0) + 1
    if not bins:
        return []
    inside = lambda b: {k: v for k, v in bins.items() if all(lo <= x <= hi for x, (lo, hi) in zip(k, b))}
    count = lambda b: sum(inside(b).values())
    volume = lambda b: np.prod([hi - lo + 1 for lo, hi in b])
    tight = lambda ks: [(min(k[i] for k in ks), max(k[i] for k in ks)) for i in range(3)]
    boxes, serial = [(tight(bins), 0)], 1

    def cut(b):
        while True:
            own = inside(b)
            axis = max(range(3), key=lambda i: (b[i][1] - b[i][0], -i))
            lo, hi = b[axis]
            below = {x: sum(v for k, v in own.items() if k[axis] <= x) for x in range(lo, hi + 1)}
            total = below[hi]
            m = next(x for x in range(lo, hi + 1) if below[x] > total / 2)
            left, right = m - lo, hi - m
            at = min(hi - 1, int(m + right / 2)) if left <= right else max(lo, int(m - 1 - left / 2))
            while at < hi and at >= lo and not below[at]:
                at += 1
            while at > lo and total == below[at] and below[at - 1]:
                at -= 1
            if lo <= at and 0 < below.get(at, 0) < total:
                return [b[:axis] + [(lo, at)] + b[axis + 1 :], b[:axis] + [(at + 1, hi)] + b[axis + 1 :]]
            b = tight(own)

    done = []
    for worth, most in ((count, 0.75 * n), (lambda b: count(b) * volume(b), n)):
        while len(boxes) + len(done) < most and boxes:
            best = max(boxes, key=lambda e: (worth(e[0]), e[1]))
            boxes.remove(best)
            if len(inside(best[0])) < 2:
                done.append(best)
                continue
            x, y = cut(best[0])
            boxes += [(x, serial), (y, serial + 1)]
            serial += 2
    out = []
    for b, _ in sorted(boxes + done, key=lambda e: (-count(e[0]) * volume(e[0]), -e[1])):
        own = inside(b)
        out.append(tuple(int(sum(v * (k[i] + 0.5) * 8 for k, v in own.items()) / sum(own.values())) for i in range(3)))
    return out


def test_palettes_equal_the_plain_cut():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 8):
        for _ in range(12):
            few = rng.integers(0, 256, (rng.integers(1, 12), 3))
            pixels = np.clip(few[rng.integers(0, len(few), 300)] + rng.integers(-12, 13, (300, 3)), 0, 255)
            assert px.median_cut(pixels, n, 1) == plain_cut([tuple(int(x) for x in p) for p in pixels], n)


def test_palettes_by_hand():
    red, blue, white = (255, 0, 0), (0, 0, 255), (255, 255, 255)
    picture = np.array([red] * 60 + [blue] * 30 + [white] * 500)
    assert px.median_cut(picture, 5, 1) == [(252, 4, 4), (4, 4, 252)]  # two colours and no more; paper is none
    assert px.median_cut(np.array([white] * 9), 5, 1) == [] and px.median_cut(picture[:0], 5) == []
    assert len(px.median_cut(picture, 1, 1)) == 1


def test_palette_column(spark):
    rows = [(1, [255] * 6 + [0] * 3, [0] * 9, [0] * 9), (2, [255] * 4, [255] * 4, [255] * 4), (3, [], [], []), (4, None, None, None)]
    planes = spark.createDataFrame(rows, "id int, r array<int>, g array<int>, b array<int>")
    got = {r.id: [tuple(c) for c in r.p] for r in planes.select("id", px.palette(5, 1).alias("p")).collect()}
    assert got == {1: [(252, 4, 4), (4, 4, 4)], 2: [], 3: [], 4: []}


def plain_soft(picture, other, y, x):
    """Whether the pixel looks like a smoothed edge, a neighbour at a time."""
    h, w = len(picture), len(picture[0])
    bright = lambda c: 0.29889531 * c[0] + 0.58662247 * c[1] + 0.11448223 * c[2]
    near = lambda y, x: [(b, a) for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1) if 0 <= a < w and 0 <= b < h and (a, b) != (x, y)]
    edge = lambda y, x: int(y in (0, h - 1) or x in (0, w - 1))
    many = lambda p, y, x: edge(y, x) + sum(tuple(p[b][a]) == tuple(p[y][x]) for b, a in near(y, x)) > 2
    steps = [(bright(picture[y][x]) - bright(picture[b][a]), (b, a)) for b, a in near(y, x)]
    if edge(y, x) + sum(d == 0 for d, _ in steps) > 2:
        return False
    low, high = min(steps, key=lambda s: s[0]), max(steps, key=lambda s: s[0])
    if low[0] >= 0 or high[0] <= 0:
        return False
    return any(many(picture, *s[1]) and many(other, *s[1]) for s in (low, high))


def test_smoothed_edges_equal_the_loops():
    rng = np.random.default_rng(2)
    for _ in range(25):
        a = rng.choice([0, 0, 0, 120, 255, 255], (6, 7, 1)).repeat(3, 2)
        b = np.where(rng.random((6, 7, 1)) < 0.2, rng.choice([0, 130, 255], (6, 7, 1)), a)
        sib = [px.many_siblings(p) for p in (a, b)]
        for p, q, k in ((a, b, 0), (b, a, 1)):
            got = px.smoothed(p, sib[k], sib[1 - k])
            want = [[plain_soft(p.tolist(), q.tolist(), y, x) for x in range(7)] for y in range(6)]
            assert got.tolist() == want


def test_an_edge_moved_by_half_a_pixel_is_alike(spark):
    """A black field with a white right half; then its border column is grey, as drawn half a pixel to the side."""
    sharp = np.repeat(np.array([[0, 0, 0, 0, 255, 255, 255, 255]]), 8, 0)
    soft = sharp.copy()
    soft[:, 4] = 128
    moved = np.repeat(np.array([[0, 0, 0, 0, 0, 0, 255, 255]]), 8, 0)
    rows = [(k, *[a.reshape(-1).tolist()] * 3, *[sharp.reshape(-1).tolist()] * 3) for k, a in enumerate((sharp, soft, moved))]
    rows += [(3, [1], [1], [1], [1, 2], [1, 2], [1, 2]), (4, None, [1], [1], [1], [1], [1]), (5, [1], [1], [1], [1], [1], [1])]
    names = [*"rgb", "prev_r", "prev_g", "prev_b"]
    pairs = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} array<int>" for n in names))
    got = {r.k: r.s for r in pairs.select("k", px.like(8).alias("s")).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.75, 3: 0.0, 4: 0.0, 5: 0.0}
    every = {r.k: r.s for r in pairs.select("k", px.like(8, edges=True).alias("s")).collect()}
    assert every[1] == 0.875 and every[2] == 0.75
    assert [r.s for r in pairs.filter("k < 3").select(px.like(8, planes=("r",)).alias("s"), F.lit(1)).collect()] == [1.0, 1.0, 0.75]


def plain_boxes(marks):
    """Boxes around marks that meet at edges, in the order of their first marks; each takes in all later ones that it touches, again
    and again until none does."""
    left, found = {(y, x) for y, row in enumerate(marks) for x, m in enumerate(row) if m}, []
    while left:
        todo, own = [min(left)], []
        left.remove(todo[0])
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        ys, xs = zip(*own)
        found.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    out = []
    for i, box in enumerate(found):
        if box is None:
            continue
        grown = True
        while grown:
            grown = False
            for j in range(i + 1, len(found)):
                o = found[j]
                if o and box[0] <= o[2] and o[0] <= box[2] and box[1] <= o[3] and o[1] <= box[3]:
                    box, found[j], grown = (min(box[0], o[0]), min(box[1], o[1]), max(box[2], o[2]), max(box[3], o[3])), None, True
        out.append((box[0], box[1], box[2] - box[0], box[3] - box[1]))
    return sorted(out)


def test_visual_differences_equal_plain_boxes(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(30):
        marks = rng.random((9, 12)) < (0.02, 0.06, 0.2)[k % 3]
        before = rng.integers(100, 110, (9, 12))
        after = np.where(marks, 250, before)
        rows.append((1, k, *[after.reshape(-1).tolist()] * 3, *[before.reshape(-1).tolist()] * 3))
        want[k] = plain_boxes(marks.tolist())
    names = [*"rgb", "prev_r", "prev_g", "prev_b"]
    pairs = spark.createDataFrame(rows, "session int, frame_no long, " + ", ".join(f"{n} array<int>" for n in names))
    got = {k: [] for k in want}
    for r in fr.visual_differences(pairs, side=12).collect():
        got[r.frame_no].append((r.x, r.y, r.w, r.h))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_random_choice_is_any_open_element_by_its_seed(spark):
    rows = [(s, p, f"e{p}", "link", 0.5, True, True, "t", 0.0, 0.0, "/x") for s in range(40) for p in range(6)]
    ddl = "state int, pos int, selector string, type string, confidence double, visible boolean, enabled boolean, text string, top double, `left` double, href string"
    elements, explored = spark.createDataFrame(rows, ddl), spark.createDataFrame([(s, f"e{s % 6}") for s in range(40)] + [(0, f"e{p}") for p in range(6)], "state int, selector string")
    pick = lambda seed: {r.state: r.pos for r in ex.next_element(elements, explored, "random", seed).collect()}
    one = pick(1)
    assert set(one) == set(range(1, 40)) and all(p != s % 6 for s, p in one.items()) and one == pick(1) != pick(2)
    assert len(set(one.values())) == 6
