"""Rectangles given by columns x, y (left, top), w and h, with a prefix for each of a pair."""

from pyspark.sql import functions as F


def _c(p, *names):
    return [F.col(f"{p}{n}") for n in names]


def area(p=""):
    w, h = _c(p, "w", "h")
    return w * h


def overlap_area(a="a_", b="b_"):
    """Area of the intersection, 0 if apart."""
    ax, ay, aw, ah = _c(a, "x", "y", "w", "h")
    bx, by, bw, bh = _c(b, "x", "y", "w", "h")
    width = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    height = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def iou(a="a_", b="b_"):
    both = overlap_area(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def touches(a="a_", b="b_"):
    """Closed rectangles meet; a common edge or corner counts."""
    ax, ay, aw, ah = _c(a, "x", "y", "w", "h")
    bx, by, bw, bh = _c(b, "x", "y", "w", "h")
    return (ax <= bx + bw) & (bx <= ax + aw) & (ay <= by + bh) & (by <= ay + ah)


def contains(a="a_", b="b_"):
    """a holds all of b."""
    ax, ay, aw, ah = _c(a, "x", "y", "w", "h")
    bx, by, bw, bh = _c(b, "x", "y", "w", "h")
    return (ax <= bx) & (ay <= by) & (ax + aw >= bx + bw) & (ay + ah >= by + bh)


def mostly_contains(a="a_", b="b_", part=0.9):
    """a covers that part of b; a b without area is in nothing."""
    return F.coalesce(F.try_divide(overlap_area(a, b), area(b)) >= part, F.lit(False))


def in_a_row(a="a_", b="b_", within=5.0):
    """Centres at about the same height."""
    (ay, ah), (by, bh) = _c(a, "y", "h"), _c(b, "y", "h")
    return F.abs(ay + ah / 2 - by - bh / 2) < within


def in_a_column(a="a_", b="b_", within=5.0):
    (ax, aw), (bx, bw) = _c(a, "x", "w"), _c(b, "x", "w")
    return F.abs(ax + aw / 2 - bx - bw / 2) < within


def gap_right(a="a_", b="b_"):
    """From a's right to b's left, 0 if they overlap."""
    (ax, aw), (bx,) = _c(a, "x", "w"), _c(b, "x")
    return F.greatest(F.lit(0.0), bx - ax - aw)


def gap_below(a="a_", b="b_"):
    (ay, ah), (by,) = _c(a, "y", "h"), _c(b, "y")
    return F.greatest(F.lit(0.0), by - ay - ah)


def alignment(within=5.0):
    """Aggregate over x, y, w, h: the first of left, right, center, top, bottom whose deviation is below ``within``, else mixed."""
    x, y, w, h = _c("", "x", "y", "w", "h")
    sd = lambda c: F.round(F.coalesce(F.stddev_pop(c), F.lit(0.0)), 6) < within
    return F.when(sd(x), "left").when(sd(x + w), "right").when(sd(x + w / 2), "center").when(sd(y), "top").when(sd(y + h), "bottom").otherwise("mixed")


def centre_distance(x1, y1, x2, y2):
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
