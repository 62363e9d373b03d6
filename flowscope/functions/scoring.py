"""Confidence and priority scores as columns."""

from pyspark.sql import functions as F

#: Score of a correlation type (fixed values).
TYPE_SCORES = {"direct": 1.0, "animated": 0.9, "sequential": 0.8, "delayed": 0.6, "unclear": 0.3}
#: Priority of an element's type when exploring, and when sorting by importance (fixed values).
EXPLORE_PRIORITY = {"button": 50, "link": 40, "input": 35, "select": 30, "checkbox": 25, "radio": 20, "textarea": 15, "custom": 10}
SORT_PRIORITY = {"button": 10, "link": 9, "input": 8, "select": 7, "checkbox": 6, "radio": 5, "textarea": 4, "custom": 1}
#: Words that make an element worth trying, or not (fixed values).
KEYWORDS = ("submit", "next", "continue", "login", "search", "add", "create")
AVOID = ("logout", "exit", "cancel", "close")


def lookup(values: dict, key, default):
    out = F
    for k, x in values.items():
        out = out.when(key == k, F.lit(x))
    return out.otherwise(F.lit(default))


def delay(intensity):
    """Estimated from the strength of a change; not a difference of times."""
    return F.when(intensity > 0.8, 0).when(intensity > 0.5, 100).otherwise(300)


def correlation_type(intensity, pct, delay_ms, history, many_moving=None):
    gradual = (intensity > 0.3) & (intensity < 0.7)
    animated = gradual if many_moving is None else gradual | many_moving
    return F.when(delay_ms < 50, "direct").when(animated, "animated").when(delay_ms > 500, "delayed").when(history > 1, "sequential").when(pct < 1, "unclear").otherwise("direct")


def correlation_confidence(delay_ms, proximity, pct, kind, longest=1000.0):
    temporal = F.greatest(F.lit(0.0), 1 - delay_ms / F.lit(longest))
    return F.least(F.lit(1.0), 0.3 * temporal + 0.3 * proximity + 0.2 * F.least(pct / F.lit(10.0), F.lit(1.0)) + 0.2 * lookup(TYPE_SCORES, kind, 0.5))


def proximity(centres, x, y, threshold=150.0):
    """1 at the nearest of an array of centres (x, y), 0 from the threshold on or without any."""
    d = F.transform(centres, lambda c: F.sqrt((c["x"] - x) * (c["x"] - x) + (c["y"] - y) * (c["y"] - y)))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.array_min(d) / threshold), F.lit(0.0))


def slice_confidence(pct, frames, regions):
    return F.least(F.lit(1.0), F.least(pct / F.lit(10.0), F.lit(1.0)) * 0.5 + F.least(frames / F.lit(30.0), F.lit(1.0)) * 0.3 + F.least(regions / F.lit(5.0), F.lit(1.0)) * 0.2)


def chain_confidence(mean, n, strict_reference=False):
    """The mean, less a tenth for each link above five. As recorded tools had it, fewer than five links raise it above the mean."""
    factor = 1 - (n - 5) * F.lit(0.1)
    return mean * (F.greatest(F.lit(0.0), factor) if strict_reference else F.greatest(F.lit(0.0), F.least(F.lit(1.0), factor)))


def element_confidence(tag, clickable, pointer):
    return F.least(F.lit(1.0), 0.5 + F.when(tag.isin("button", "a", "input", "select"), 0.3).otherwise(0.0) + F.when(clickable, 0.1).otherwise(0.0) + F.when(pointer, 0.1).otherwise(0.0))


def element_type(tag, role, kind):
    by_kind = F.when(kind.isin("checkbox", "radio"), kind).when(kind.isin("submit", "button"), "button").otherwise("input")
    return F.when((tag == "button") | F.coalesce(role == "button", F.lit(False)), "button").when(tag == "a", "link").when(tag == "input", by_kind).when(tag.isin("select", "textarea", "canvas", "video"), tag).otherwise("custom")


def element_priority(confidence, kind, visible, enabled, text):
    low = F.lower(F.coalesce(text, F.lit("")))
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    add = lambda c, n: F.when(c, n).otherwise(0)
    return confidence * 100 + lookup(EXPLORE_PRIORITY, kind, 0) + add(visible, 20) + add(enabled, 10) + add(F.length(low).between(1, 49), 15) + add(some(KEYWORDS), 25) - add(some(AVOID), 20)


def state_priority(elements, depth, form, navigation, error):
    add = lambda c, n: F.when(c, n).otherwise(0)
    return elements * 10 + (10 - depth) * 5 + add(form, 20) + add(navigation, 15) - add(error, 30)


def importance(tag, css, has_media):
    """Of a content area: later rules override earlier ones."""
    return F.when(has_media, 1.0).when(F.array_contains(css, "hero"), 0.95).when(tag == "main", 1.0).when(tag == "header", 0.9).otherwise(0.5)
