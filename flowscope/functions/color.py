"""Colours: RGB of 0-255, hex strings, HSL in degrees and percent."""

from pyspark.sql import functions as F

from flowscope.functions.js import js_round


def hex_of(r, g, b):
    two = lambda c: F.lower(F.lpad(F.hex(js_round(c).cast("bigint")), 2, "0"))
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def rgb_of(text):
    """Struct r, g, b of a hex string with or without #; zeros if it is none."""
    ok = text.rlike(r"^#?[0-9a-fA-F]{6}$")
    part = lambda i: F.when(ok, F.conv(F.substring(F.regexp_replace(text, "#", ""), i, 2), 16, 10).cast("int")).otherwise(0)
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def hsl_of(r, g, b):
    """Struct h, s, l of whole numbers."""
    r, g, b = (c / F.lit(255.0) for c in (r, g, b))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, light = hi - lo, (hi + lo) / 2
    sat = F.when(d == 0, 0.0).when(light > 0.5, F.try_divide(d, 2 - hi - lo)).otherwise(F.try_divide(d, hi + lo))
    hue = F.when(d == 0, 0.0).when(hi == r, F.try_divide(g - b, d) + F.when(g < b, 6.0).otherwise(0.0)).when(hi == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4)
    whole = lambda c: js_round(c).cast("int")
    return F.struct(whole(hue / 6 * 360).alias("h"), whole(sat * 100).alias("s"), whole(light * 100).alias("l"))


def distance(a, b):
    """Of two arrays or structs' channels given as triples."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def color_struct(r, g, b):
    return F.struct(hex_of(r, g, b).alias("hex"), F.struct(r.alias("r"), g.alias("g"), b.alias("b")).alias("rgb"), hsl_of(r, g, b).alias("hsl"), F.lit(1.0).alias("alpha"))
