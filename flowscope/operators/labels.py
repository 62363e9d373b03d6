"""Components of changed pixels by runs: stretches of pixels in a row that changed, joined to those they touch in the row above.

A frame's cost is that of its pixels and runs, whatever the number of components. A frame that is too large for a task is cut
into strips: each gives its own components and the runs along its edges, and those that touch across an edge are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end exclusive) of the stretches of set pixels, row by row."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1]


def touching(row, start, end, other_row, other_start, other_end, width: int, eight: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (run, other run of the row above) that touch at edges, or with ``eight`` at corners too; both in order of rows."""
    wide, reach = width + 2, int(eight)
    above = (row - 1) * wide
    first = np.searchsorted(other_row * wide + other_end, above + start + 1 - reach, "left")
    last = np.searchsorted(other_row * wide + other_start, above + end - 1 + reach, "right")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(row)), n)
    return a, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(a))


def least_of_each(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component; each round joins every component to a lesser neighbour, if it has one."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(least, jumped := least[least]):
            least = jumped
    return least


def numbered_runs(mask: np.ndarray, eight: bool = True):
    """(row, start, end, number) of the runs; components are numbered from 0 in the order of their first pixel."""
    row, start, end = runs(mask)
    a, b = touching(row, start, end, row, start, end, mask.shape[1], eight)
    return row, start, end, np.unique(least_of_each(len(row), a, b), return_inverse=True)[1].astype(np.int64)


def pixels_of(row, start, end, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the flat frame, run) of every pixel of the runs."""
    n = end - start
    of = np.repeat(np.arange(len(row)), n)
    return np.repeat(row * width + start - (np.cumsum(n) - n), n) + np.arange(len(of)), of


def label(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Components of a mask, numbered from 1 in the order of their first pixel; 0 elsewhere."""
    row, start, end, number = numbered_runs(mask, eight)
    at, of = pixels_of(row, start, end, mask.shape[1])
    out = np.zeros(mask.size, np.int32)
    out[at] = number[of] + 1
    return out.reshape(mask.shape)


def measured(diff: np.ndarray, row, start, end, number) -> dict[str, np.ndarray]:
    """By component: pixels, sum of their differences, and the box (x0, y0 inclusive, x1, y1 exclusive)."""
    count = int(number.max(initial=-1)) + 1
    at, of = pixels_of(row, start, end, diff.shape[1])
    box = {"x0": np.full(count, diff.shape[1]), "y0": np.full(count, diff.shape[0]), "x1": np.zeros(count, int), "y1": np.zeros(count, int)}
    for name, value, take in (("x0", start, np.minimum), ("y0", row, np.minimum), ("x1", end, np.maximum), ("y1", row + 1, np.maximum)):
        take.at(box[name], number, value)
    n = np.bincount(number, end - start, count).astype(np.int64)
    return {"n": n, "sum": np.bincount(number[of], diff.reshape(-1)[at], count)} | box


def lists(column) -> list[np.ndarray]:
    """The arrays of a list column as numpy views, null ones empty."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    return [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def strips(pairs: DataFrame, side: int, high: int) -> DataFrame:
    """(session, frame_no, strip, px, prev_px): pairs of frames cut into strips of ``high`` rows, so that tasks can share one."""
    n = F.ceil(F.size("px") / F.lit(side * high)).cast("int")
    cut = pairs.select("session", "frame_no", "px", "prev_px", F.explode(F.sequence(F.lit(0), n - 1)).alias("strip"))
    part = lambda c: F.slice(c, F.col("strip") * (side * high) + 1, F.lit(side * high))
    return cut.select("session", "frame_no", "strip", part("px").alias("px"), part("prev_px").alias("prev_px"))


_KEYS = ["session", "frame_no", "strip"]
_SUMS = ["n", "sum", "x0", "y0", "x1", "y1"]


def _strip_parts(rows: DataFrame, side: int, high: int, threshold: int) -> DataFrame:
    """Of each strip a row for each component, in the frame's coordinates, and one for each run on its first and last row."""
    names = [*_KEYS, "part", *_SUMS, "edge", "start", "end"]
    kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2

    def run(batches):
        for batch in batches:
            out = []
            found = (c.to_pylist() for c in batch.columns[:3])
            for session, no, strip, px, prev in zip(*found, lists(batch.column(3)), lists(batch.column(4)), strict=True):
                diff = np.abs(px.astype(np.int64) - prev.astype(np.int64)).reshape(-1, side)
                row, start, end, number = numbered_runs(diff > threshold)
                sums = measured(diff, row, start, end, number)
                for k in range(len(sums["n"])):
                    n, total, x0, y0, x1, y1 = (sums[s][k].item() for s in _SUMS)
                    out.append((session, no, strip, k, n, total, x0, y0 + strip * high, x1, y1 + strip * high, None, None, None))
                for edge, at in (("top", 0), ("bottom", len(diff) - 1)):
                    own = np.flatnonzero(row == at)
                    more = zip(number[own].tolist(), start[own].tolist(), end[own].tolist(), strict=True)
                    out += [(session, no, strip, k, *[None] * 6, edge, a, b) for k, a, b in more]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    ddl = "session long, frame_no long, strip long, part long, n long, sum double, x0 long, y0 long, x1 long, y1 long, edge string, start long, end long"
    cols = rows.select(F.col("session").cast("bigint"), F.col("frame_no").cast("bigint"), F.col("strip").cast("bigint"), "px", "prev_px")
    return cols.mapInArrow(run, ddl)


def _across(key, edges):
    """One frame's runs along its strips' edges: which components of strips are one, as (strip, part) -> least (strip, part)."""
    import pandas as pd

    nodes = edges[["strip", "part"]].drop_duplicates().sort_values(["strip", "part"]).reset_index(drop=True)
    place = pd.MultiIndex.from_frame(nodes)
    top, bottom = (edges[edges.edge == e].sort_values(["strip", "start"]) for e in ("top", "bottom"))
    width = int(edges.end.max())
    runs_of = lambda e: (e.strip.to_numpy(), e.start.to_numpy(), e.end.to_numpy())
    a, b = touching(*runs_of(top), *runs_of(bottom), width, True)
    node = lambda e, i: place.get_indexer(pd.MultiIndex.from_arrays([e.strip.to_numpy()[i], e.part.to_numpy()[i]]))
    least = nodes.iloc[least_of_each(len(nodes), node(top, a), node(bottom, b))].reset_index(drop=True)
    out = pd.DataFrame({"session": key[0], "frame_no": key[1], "strip": nodes.strip, "part": nodes.part, "to_strip": least.strip, "to_part": least.part})
    return out[(out.strip != out.to_strip) | (out.part != out.to_part)]


def regions_by_strips(pairs: DataFrame, threshold: int = 25, least: int = 2, side: int = 1920, high: int = 120, full: int = 1000) -> DataFrame:
    """(session, frame_no, n, x, y, w, h, intensity, confidence) of each component of changed pixels, as ``frames.regions``
    gives them, but with the strips of a frame shared out among tasks.

    Only runs along the strips' edges of one frame meet in a task: at most its width times twice the number of strips.
    """
    spread = strips(pairs, side, high).repartition(*_KEYS)
    parts = _strip_parts(spread, side, high, threshold).persist()
    ddl = "session long, frame_no long, strip long, part long, to_strip long, to_part long"
    across = parts.filter("edge is not null").groupBy("session", "frame_no").applyInPandas(_across, ddl)
    own = parts.filter("edge is null").join(across, [*_KEYS, "part"], "left")
    root = [F.coalesce("to_strip", "strip").alias("strip"), F.coalesce("to_part", "part").alias("part")]
    sums = [f(c).alias(c) for f, cs in ((F.sum, ("n", "sum")), (F.min, ("x0", "y0")), (F.max, ("x1", "y1"))) for c in cs]
    whole = own.groupBy("session", "frame_no", *root).agg(*sums).filter(F.col("n") >= least)
    light = F.col("sum") / F.col("n") / 255
    return whole.select(
        "session", "frame_no", "n", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"),
        light.alias("intensity"), ((F.least(F.col("n") / F.lit(full), F.lit(1.0)) + light) / 2).alias("confidence"),
    )
