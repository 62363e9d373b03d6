"""What needs a whole picture at once: palettes by median cut and edges that were only smoothed, on numpy arrays in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Bits of a plane that a palette tells apart; the part of the colours that is split off by count alone.
BITS, BY_COUNT = 5, 0.75
#: Pixels brighter than this in all planes are paper and no colour; of the others every STEP-th is looked at.
PAPER, STEP = 250, 10
#: Squared distance in luma and chroma above which pixels differ at a threshold of 1 (fixed value).
FARTHEST = 35215.0
#: Weights of the planes in luma and both chromas, and of these in the distance (fixed values).
YIQ = ((0.29889531, 0.58662247, 0.11448223), (0.59597799, -0.2741761, -0.32180189), (0.21147017, -0.52261711, 0.31114694))
WEIGHTS = (0.5053, 0.299, 0.1957)
COLOURS = "array<struct<r:int,g:int,b:int>>"


class Box:
    """A part of the cube of colours: bounds by plane, ends included."""

    def __init__(self, cube: np.ndarray, low, high, made: int):
        self.cube, self.low, self.high, self.made = cube, tuple(low), tuple(high), made
        self.part = cube[tuple(slice(a, b + 1) for a, b in zip(self.low, self.high, strict=True))]
        self.count, self.volume = int(self.part.sum()), int(np.prod(self.part.shape))

    def halves(self, made: int) -> list[Box]:
        """Cut through the longest plane's median, moved to the middle of the larger side; [] if all is of one colour."""
        if np.count_nonzero(self.part) < 2:
            return []
        axis = int(np.argmax(self.part.shape))
        sums = np.cumsum(self.part.sum(tuple(k for k in range(3) if k != axis)))
        last = len(sums) - 1
        middle = int(np.searchsorted(2 * sums, sums[-1], "right"))
        cut = min(last - 1, int(middle + (last - middle) / 2)) if middle <= last - middle else max(0, int(middle - 1 - middle / 2))
        while cut < last and not sums[cut]:
            cut += 1
        while cut > 0 and sums[cut] == sums[-1] and sums[cut - 1]:
            cut -= 1
        if cut < 0 or not sums[cut] or sums[cut] == sums[-1]:  # all in one layer: cut what is left without the empty ones
            return self.shrunk().halves(made)
        at = self.low[axis] + cut
        other = lambda end, x: [x if k == axis else end[k] for k in range(3)]
        return [Box(self.cube, self.low, other(self.high, at), made), Box(self.cube, other(self.low, at + 1), self.high, made + 1)]

    def shrunk(self) -> Box:
        """Without empty layers on the outside."""
        held = np.argwhere(self.part)
        low = np.array(self.low)
        return Box(self.cube, low + held.min(0), low + held.max(0), self.made)

    def colour(self) -> tuple[int, int, int]:
        """Mean of the pixels, each counted as the middle of its cell."""
        wide = 1 << (8 - BITS)
        at = np.argwhere(self.part)
        n = self.part[tuple(at.T)]
        return tuple(int(x) for x in (n[:, None] * (at + np.array(self.low) + 0.5) * wide).sum(0) / n.sum())


def median_cut(pixels: np.ndarray, colours: int = 5, step: int = STEP) -> list[tuple[int, int, int]]:
    """A palette of at most ``colours`` of an array (pixels, 3): the box of all colours is cut again and again, first the box with
    most pixels, then that with the largest product of pixels and volume; of equal ones the one made last. The colours come
    in order of that product. Paper-white pixels are left out; a picture of nothing else has no palette.
    """
    some = pixels[::step].astype(np.int64)
    some = some[~(some > PAPER).all(1)]
    if not len(some) or colours < 1:
        return []
    side = 1 << BITS
    cells = some >> (8 - BITS)
    cube = np.bincount(cells @ np.array([side * side, side, 1]), minlength=side**3).reshape(side, side, side)
    boxes, made, whole = [Box(cube, cells.min(0), cells.max(0), 0)], 1, []
    for worth, most in ((lambda b: b.count, BY_COUNT * colours), (lambda b: b.count * b.volume, colours)):
        while len(boxes) + len(whole) < most and boxes:
            best = max(boxes, key=lambda b: (worth(b), b.made))
            boxes.remove(best)
            parts = best.halves(made)
            made += len(parts)
            boxes += parts
            if not parts:
                whole.append(best)
    return [b.colour() for b in sorted([*boxes, *whole], key=lambda b: (-b.count * b.volume, -b.made))]


def palette(n: int = 5, step: int = STEP, planes=("r", "g", "b")):
    """Column: the palette of a picture's planes by ``median_cut``."""

    @F.pandas_udf(COLOURS)
    def of(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        found = (median_cut(np.column_stack(x), n, step) if x[0] is not None and len(x[0]) else [] for x in zip(r, g, b, strict=True))
        return pd.Series([[dict(zip("rgb", c, strict=True)) for c in colours] for colours in found])

    return of(*planes)


def _shifts():
    """The eight neighbours as (rows, columns) shifts, column by column."""
    return [(dy, dx) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def _moved(a: np.ndarray, dy: int, dx: int, outside):
    """a at each pixel's neighbour, ``outside`` beyond the edges."""
    out = np.full_like(a, outside)
    h, w = a.shape[:2]
    ys, xs = slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx))
    out[ys, xs] = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def luma(picture: np.ndarray) -> np.ndarray:
    return sum(w * picture[:, :, k] for k, w in enumerate(YIQ[0]))


def _at_edge(h: int, w: int) -> np.ndarray:
    out = np.ones((h, w), np.int64)
    out[1:-1, 1:-1] = 0
    return out


def many_siblings(picture: np.ndarray) -> np.ndarray:
    """Pixels with more than two neighbours of their own colour; the picture's edge counts as one."""
    same = _at_edge(*picture.shape[:2])
    for dy, dx in _shifts():
        near = _moved(picture.astype(np.float64), dy, dx, np.nan)
        same += (near == picture).all(2)
    return same > 2


def smoothed(picture: np.ndarray, siblings: np.ndarray, other_siblings: np.ndarray) -> np.ndarray:
    """Pixels that look like a smoothed edge: between a darker and a brighter neighbour, with at most two as bright as they are,
    where the darkest or the brightest neighbour has many siblings in both pictures.
    """
    h, w = picture.shape[:2]
    y = luma(picture.astype(np.float64))
    equal, steps = _at_edge(h, w), []
    for dy, dx in _shifts():
        step = y - _moved(y, dy, dx, np.nan)
        equal += step == 0
        steps.append(step)
    steps = np.stack(steps)
    both = siblings & other_siblings
    solid = np.stack([_moved(both, dy, dx, False) for dy, dx in _shifts()])
    least, most = np.nanargmin(np.where(np.isnan(steps), np.inf, steps), 0), np.nanargmax(np.where(np.isnan(steps), -np.inf, steps), 0)
    pick = lambda a, k: np.take_along_axis(a, k[None], 0)[0]
    between = (pick(steps, least) < 0) & (pick(steps, most) > 0)
    return (equal <= 2) & between & (pick(solid, least) | pick(solid, most))


def different(before: np.ndarray, after: np.ndarray, threshold: float = 0.1, edges: bool = False) -> np.ndarray:
    """Pixels of two pictures (rows, columns, three planes) that differ visibly; smoothed edges only with ``edges``."""
    step = before.astype(np.float64) - after
    parts = (sum(w * step[:, :, k] for k, w in enumerate(plane)) for plane in YIQ)
    far = sum(w * p * p for w, p in zip(WEIGHTS, parts, strict=True)) > FARTHEST * threshold * threshold
    if edges or not far.any():
        return far
    a, b = many_siblings(before), many_siblings(after)
    return far & ~smoothed(before, a, b) & ~smoothed(after, b, a)


def like(side: int, threshold: float = 0.1, planes=("r", "g", "b"), edges: bool = False):
    """Column: part of the pixels that look alike; 0 where sizes differ, a picture is missing, or no whole number of rows."""
    names = [*planes, *(f"prev_{p}" for p in planes)]

    @F.pandas_udf("double")
    def of(*found: pd.Series) -> pd.Series:
        out = []
        for row in zip(*found, strict=True):
            sizes = {-1 if p is None else len(p) for p in row}
            n = sizes.pop()
            if sizes or n <= 0 or n % side:
                out.append(0.0)
                continue
            now, prev = (np.stack([np.asarray(p) for p in part], 1).reshape(-1, side, len(planes)) for part in (row[: len(planes)], row[len(planes) :]))
            if len(planes) == 1:
                now, prev = (np.repeat(x, 3, axis=2) for x in (now, prev))
            out.append(1 - np.count_nonzero(different(prev, now, threshold, edges)) / n)
        return pd.Series(out, dtype=float)

    return of(*names)
