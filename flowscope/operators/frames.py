"""Pairs of frames as arrays of values, row by row, ``side`` to a row.

A frame is one grey plane (px) or several colour planes (by default r, g, b); the frame before has its planes as prev_*.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.labels import label, lists, measured, numbered_runs

SIDE = 8
GREY = ("px",)
RGB = ("r", "g", "b")


def _sum(array):
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _mean_of(columns):
    columns = list(columns)
    return sum(columns[1:], columns[0]) / F.lit(float(len(columns)))


def before(plane: str) -> str:
    return f"prev_{plane}"


def _diffs(a="px", b="prev_px"):
    return F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))


def mse(planes=GREY):
    """Mean over pixels and planes."""
    return _mean_of(_sum(F.zip_with(p, before(p), lambda x, y: ((x - y) * (x - y)).cast("double"))) / F.size(p) for p in planes)


def psnr(error):
    """Infinite for equal frames."""
    return F.when(error == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / F.nullif(error, F.lit(0.0))))


def ssim(error):
    """1 - mse / 255^2: the sessions' own simplified measure."""
    return 1 - error / 65025.0


def histogram(planes=GREY):
    """256 counts over all planes."""
    flat = F.concat(*planes)
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.size(F.filter(flat, lambda p: p == k)))


def histogram_difference(planes=GREY):
    """Sum of the bins' differences over the number of values, 0 to 2; only values that occur are counted."""
    a, b = F.concat(*planes), F.concat(*map(before, planes))
    n = lambda px, k: F.size(F.filter(px, lambda p: p == k))
    return _sum(F.transform(F.array_union(a, b), lambda k: F.abs(n(a, k) - n(b, k)).cast("double"))) / F.size(a)


def sobel(px="px", side=SIDE, wrap=True):
    """Gradient magnitudes of a plane, 0 on the border, as bytes: above 255 they lose 256, or without ``wrap`` stay 255."""
    at = lambda i, dy, dx: F.get(px, (i + dy * side + dx).cast("int"))
    n = F.size(px)

    def value(i):
        r, c = F.floor(i / side), i % side
        gx = at(i, -1, 1) + 2 * at(i, 0, 1) + at(i, 1, 1) - at(i, -1, -1) - 2 * at(i, 0, -1) - at(i, 1, -1)
        gy = at(i, 1, -1) + 2 * at(i, 1, 0) + at(i, 1, 1) - at(i, -1, -1) - 2 * at(i, -1, 0) - at(i, -1, 1)
        m = F.floor(F.sqrt((gx * gx + gy * gy).cast("double")))
        return F.when((r == 0) | (r == F.floor(n / side) - 1) | (c == 0) | (c == side - 1), F.lit(0)).otherwise(m % 256 if wrap else F.least(m, F.lit(255)))

    return F.transform(F.sequence(F.lit(0), n - 1), value)


def edge_difference(side=SIDE, planes=GREY, wrap=True):
    """Of the first plane's gradients."""
    p = planes[0]
    return _sum(F.zip_with(sobel(p, side, wrap), sobel(before(p), side, wrap), lambda x, y: F.abs(x - y).cast("double"))) / F.size(p)


def dominant(px="px", n=5):
    """n pixels of a plane at a fixed stride, an n-th of the image."""
    step = F.floor(F.size(px) / F.lit(n)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(px, (i * step).cast("int")))


def color_difference(n=5, planes=GREY):
    """Mean distance of the dominant colours, as a part of the largest distance; a grey plane counts as three equal ones."""
    squares = [F.zip_with(dominant(p, n), dominant(before(p), n), lambda x, y: ((x - y) * (x - y)).cast("double")) for p in planes]
    total = squares[0]
    for more in squares[1:]:
        total = F.zip_with(total, more, lambda x, y: x + y)
    return _sum(F.transform(total, lambda x: F.sqrt(x / F.lit(float(len(planes)))))) / (255.0 * n)


def changed(threshold=25, a="px", b="prev_px"):
    """Differences above the threshold, others 0."""
    return F.transform(_diffs(a, b), lambda x: F.when(x > threshold, x).otherwise(0.0))


def metrics(pairs: DataFrame, threshold: int = 25, side: int = SIDE, planes=GREY) -> DataFrame:
    """All measures of a pair of frames; what changed is told by the grey plane px."""
    p = pairs.withColumn("mse", mse(planes)).withColumn("_changed", F.filter(changed(threshold), lambda x: x > 0))
    n = F.size("_changed")
    return p.withColumns(
        {"psnr": psnr(F.col("mse")), "ssim": ssim(F.col("mse")), "histogram_diff": histogram_difference(planes), "edge_diff": edge_difference(side, planes), "color_diff": color_difference(planes=planes),
         "changed_pixels": n, "changed_pct": 100.0 * n / F.size("px"), "intensity": F.when(n > 0, _sum("_changed") / F.nullif(n, F.lit(0)) / 255.0).otherwise(0.0),
         "max_diff": F.array_max(_diffs()), "mean_diff": _sum(_diffs()) / F.size("px")}
    ).drop("_changed")


def changed_parts(pairs: DataFrame, threshold: int = 25) -> DataFrame:
    """(session, frame_no, changed_pct) alone, without the other measures."""
    n = F.size(F.filter(changed(threshold), lambda x: x > 0))
    return pairs.select("session", "frame_no", (100.0 * n / F.size("px")).alias("changed_pct"))


def average(px):
    return _sum(F.transform(px, lambda p: p.cast("double"))) / F.size(px)


def filled(planes=GREY, name=lambda p: p):
    """Pixels of which some plane is above 10."""
    top = F.transform(name(planes[0]), lambda x: x)
    for p in planes[1:]:
        top = F.zip_with(top, name(p), lambda x, y: F.greatest(x, y))
    return F.size(F.filter(top, lambda x: x > 10))


def text_pattern(px="px", side=SIDE):
    """Changes between dark and bright (above 128) along each row, which begins dark, as a part of the pixels."""
    bright = lambda i: F.get(px, i.cast("int")) > 128
    turn = lambda i: F.when(bright(i) != F.when(i % side == 0, F.lit(False)).otherwise(bright(F.greatest(i - 1, F.lit(0)))), 1.0).otherwise(0.0)
    return _sum(F.transform(F.sequence(F.lit(0), F.size(px) - 1), turn)) / F.size(px)


def region_measures(pairs: DataFrame, side: int = SIDE, planes=GREY) -> DataFrame:
    """Whole-frame forms of a region's measures: similarity, size, emptiness, average, style, resize, text and animation tests."""
    size, prev_size = filled(planes), filled(planes, before)
    apart = _diffs(planes[0], before(planes[0]))
    for p in planes[1:]:
        apart = F.zip_with(apart, _diffs(p, before(p)), lambda x, y: x + y)
    ratio = F.try_divide(size.cast("double"), prev_size.cast("double"))
    n, high = F.size(planes[0]), F.size(planes[0]) / side
    xy = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sqrt(F.pow(i % side - F.lit(side / 2), F.lit(2)) + F.pow(F.floor(i / side) - high / 2, F.lit(2))))
    moved_ = F.filter(F.zip_with(_diffs(), xy, lambda d, r: F.when(d > 25, r)), lambda r: r.isNotNull())
    radius, expected = F.try_divide(_sum(moved_), F.size(moved_).cast("double")), F.sqrt(n.cast("double")) / 2
    style = F.sqrt(3 * _mean_of(F.pow(average(p) - average(before(p)), F.lit(2)) for p in planes)) > 50
    return pairs.select(
        "session", "frame_no", (F.size(F.filter(apart, lambda x: x * F.lit(3.0 / len(planes)) < 30)) / n).alias("similarity"), size.alias("size"), (size == 0).alias("empty"),
        _mean_of(average(p) for p in planes).alias("average"), style.alias("style"),
        F.when(prev_size == 0, size > 0).otherwise((ratio < 0.8) | (ratio > 1.2)).alias("resized"),
        (F.abs(text_pattern(planes[0], side) - text_pattern(before(planes[0]), side)) > 0.2).alias("text"), F.coalesce(F.abs(radius - expected) < 0.3 * expected, F.lit(False)).alias("animated"),
    )


#: Squared distance in luma and chroma above which pixels differ at a threshold of 1 (fixed value).
FARTHEST = 35215.0


def unlike(threshold: float = 0.1, planes=RGB):
    """Per pixel whether the planes differ visibly, by a weighted distance of luma and chroma; one plane is grey."""
    r, g, b = planes if len(planes) == 3 else planes * 3
    step = lambda p: F.zip_with(p, before(p), lambda x, y: (x - y).cast("double"))
    rgb = F.zip_with(F.zip_with(step(r), step(g), lambda x, y: F.struct(x.alias("r"), y.alias("g"))), step(b), lambda c, z: F.struct(c["r"].alias("r"), c["g"].alias("g"), z.alias("b")))

    def far(c):
        y = 0.29889531 * c["r"] + 0.58662247 * c["g"] + 0.11448223 * c["b"]
        i = 0.59597799 * c["r"] - 0.2741761 * c["g"] - 0.32180189 * c["b"]
        q = 0.21147017 * c["r"] - 0.52261711 * c["g"] + 0.31114694 * c["b"]
        return 0.5053 * y * y + 0.299 * i * i + 0.1957 * q * q > FARTHEST * threshold * threshold

    return F.transform(rgb, far)


def visual_similarity(threshold: float = 0.1, planes=RGB):
    """Part of the pixels that look alike; 0 where the sizes differ or a frame is missing.

    Every pixel counts, those of smoothed edges too; ``pixels.like`` leaves these out.
    """
    same = F.size(planes[0]) == F.size(before(planes[0]))
    marks = unlike(threshold, planes)
    return F.when(F.coalesce(same, F.lit(False)), 1 - F.size(F.filter(marks, lambda m: m)) / F.size(marks)).otherwise(0.0)


def content_bounds(frames: DataFrame, below: int = 240, side: int = SIDE) -> DataFrame:
    """(frame_no, x, y, w, h, alignment, padding): the box of pixels darker than ``below``; a blank frame is its own box.

    padding is the space around it: top and left to the first row and column, right and bottom from the last to the full size.
    """
    inside = F.filter(F.sequence(F.lit(0), F.size("px") - 1), lambda i: F.get("px", i) < below)
    high = F.floor(F.size("px") / side).cast("int")
    xs, ys = F.transform(inside, lambda i: i % side), F.transform(inside, lambda i: F.floor(i / side).cast("int"))
    lo = lambda a: F.coalesce(F.array_min(a), F.lit(0))
    hi = lambda a, n=F.lit(side): F.coalesce(F.array_max(a), n - 1)
    left, right = lo(xs), side - hi(xs)
    padding = F.struct(lo(ys).alias("top"), right.alias("right"), (high - hi(ys, high)).alias("bottom"), left.alias("left"))
    align = F.when(F.abs(left - right) < 5, "center").when(left < right, "left").otherwise("right")
    return frames.select("frame_no", lo(xs).alias("x"), lo(ys).alias("y"), (hi(xs) - lo(xs) + 1).alias("w"), (hi(ys, high) - lo(ys) + 1).alias("h"), align.alias("alignment"), padding.alias("padding"))


def moved(before: np.ndarray, after: np.ndarray, box, reach: int = 50, step: int = 5) -> bool:
    """Whether a region's pixels reappear elsewhere in the later frame: nine tenths within 30 in all planes together."""
    x, y, w, h = box
    before, after = np.atleast_3d(before), np.atleast_3d(after)
    part, weight = before[y : y + h, x : x + w].astype(int), 3 / before.shape[2]
    for dy in range(-reach, reach + 1, step):
        for dx in range(-reach, reach + 1, step):
            u, v = y + dy, x + dx
            if (dy or dx) and 0 <= u and 0 <= v and u + h <= after.shape[0] and v + w <= after.shape[1]:
                if np.mean(weight * np.abs(after[u : u + h, v : v + w] - part).sum(2) < 30) > 0.9:
                    return True
    return False


def kind_of(before: np.ndarray, after: np.ndarray, box, mask, reach: int, step: int) -> str:
    """The first that fits: appearance, disappearance, movement, transformation, style, text, animation, else complex.

    Frames are (rows, columns, planes), or grey without planes.
    """
    x, y, w, h = box
    before, after = np.atleast_3d(before), np.atleast_3d(after)
    a, b = before[y : y + h, x : x + w], after[y : y + h, x : x + w]
    size = lambda p: int((p > 10).any(2).sum())
    if not size(a) and size(b):
        return "appearance"
    if size(a) and not size(b):
        return "disappearance"
    if moved(before, after, box, reach, step):
        return "movement"
    if size(a) and not 0.8 <= size(b) / size(a) <= 1.2:
        return "transformation"
    if (3 * np.mean((a.mean((0, 1)) - b.mean((0, 1))) ** 2)) ** 0.5 > 50:
        return "style"
    turns = lambda p: float((np.diff((p[:, :, 0] > 128).astype(int), axis=1, prepend=0) != 0).sum()) / (w * h)
    if abs(turns(a) - turns(b)) > 0.2:
        return "text"
    ys, xs = np.nonzero(mask[y : y + h, x : x + w])
    radius = float(np.hypot(xs - w / 2, ys - h / 2).mean()) if len(xs) else 0.0
    return "animation" if abs(radius - (w * h) ** 0.5 / 2) < 0.3 * (w * h) ** 0.5 / 2 else "complex"


class _Only:
    """One label's pixels of a labelled frame, looked at box by box."""

    def __init__(self, marks: np.ndarray, k: int):
        self.marks, self.k = marks, k

    def __getitem__(self, box):
        return self.marks[box] == self.k


def regions(pairs: DataFrame, threshold: int = 25, least: int = 2, side: int = SIDE, reach: int = 50, step: int = 5, full: int = 1000, planes=GREY, kinds: bool = True) -> DataFrame:
    """(session, frame_no, region, n, x, y, w, h, intensity, confidence, kind) of each component of changed pixels.

    Components of the grey plane's changes meet at edges or corners; the kind is told from ``planes``, and null without
    ``kinds``. A pair is one row, so its planes stay arrays and never become rows of pixels.
    """

    def run(batches):
        for batch in batches:
            out = []
            keys = (c.to_pylist() for c in batch.columns[:2])
            for session, no, px, prev, *more in zip(*keys, *map(lists, batch.columns[2:]), strict=True):
                diff = np.abs(px.astype(np.int64) - prev.astype(np.int64)).reshape(-1, side)
                row, start, end, number = numbered_runs(diff > threshold)
                found = measured(diff, row, start, end, number)
                if kinds:
                    stacked = (np.stack([p.astype(np.int64).reshape(-1, side) for p in part], axis=2) for part in (more[: len(planes)], more[len(planes) :]))
                    after, before_ = stacked
                    marks = label(diff > threshold)
                for k in np.flatnonzero(found["n"] >= least).tolist():
                    n, total, x0, y0, x1, y1 = (found[c][k].item() for c in ("n", "sum", "x0", "y0", "x1", "y1"))
                    box, light = (x0, y0, x1 - x0, y1 - y0), total / n / 255
                    kind = kind_of(before_, after, box, _Only(marks, k + 1), reach, step) if kinds else None
                    out.append((session, no, k + 1, n, *box, light, (min(n / full, 1.0) + light) / 2, kind))
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([(c, pa.int64()) for c in ("session", "frame_no", "region", "n", "x", "y", "w", "h")] + [("intensity", pa.float64()), ("confidence", pa.float64()), ("kind", pa.string())])
    own = [F.col(c).alias(f"p{i}") for i, c in enumerate((*planes, *map(before, planes)))] if kinds else []
    cols = pairs.select(F.col("session").cast("bigint"), "frame_no", "px", "prev_px", *own)
    return cols.mapInArrow(run, "session long, frame_no long, region long, n long, x long, y long, w long, h long, intensity double, confidence double, kind string")


def visual_differences(pairs: DataFrame, side: int = SIDE, threshold: float = 0.1, planes=RGB) -> DataFrame:
    """(session, frame_no, x, y, w, h): boxes around what looks different; pixels meet at edges, boxes that touch are one.

    Frames of different sizes have none. Merging depends on what was merged before, hence a loop over each pair's boxes.
    """

    def run(batches):
        for batch in batches:
            out = []
            for session, no, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mask = np.array(marks or [], bool).reshape(-1, side)
                found = measured(mask, *numbered_runs(mask, eight=False))
                corners = zip(*(found[c].tolist() for c in ("x0", "y0", "x1", "y1")), strict=True)
                boxes = [(x0, y0, x1 - x0, y1 - y0) for x0, y0, x1, y1 in corners]
                out += [dict(zip(names, (session, no, *b), strict=True)) for b in joined(boxes)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    names = ["session", "frame_no", "x", "y", "w", "h"]
    schema = pa.schema([(c, pa.int64()) for c in names])
    marks = F.when(F.size(planes[0]) == F.size(before(planes[0])), unlike(threshold, planes))
    return pairs.select(F.col("session").cast("bigint"), "frame_no", marks.alias("marks")).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def joined(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h), each grown by all that touch it until none does."""
    out, left = [], list(boxes)
    while left:
        x, y, w, h = left.pop(0)
        while (hit := next((i for i, (u, v, p, q) in enumerate(left) if x <= u + p and u <= x + w and y <= v + q and v <= y + h), None)) is not None:
            u, v, p, q = left.pop(hit)
            x, y, w, h = min(x, u), min(y, v), max(x + w, u + p) - min(x, u), max(y + h, v + q) - min(y, v)
        out.append((x, y, w, h))
    return out
