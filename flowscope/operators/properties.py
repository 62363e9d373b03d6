"""Looks of an element: crops of images and what their pixels tell. An image is a row of planes (r, g, b, px, alpha or null) with width and height."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions import color
from flowscope.operators import pixels

#: Types whose text matters, and types whose text is read (fixed values).
TEXT_TYPES = ("text", "header", "button", "link")
READ_TYPES = ("text", "button", "link", "header", "input")
#: Distance from which colours count as different.
APART = 30.0
PLANES = ("r", "g", "b", "px", "alpha")


def is_text(kind):
    return kind.isin(*TEXT_TYPES)


def is_read(kind):
    return kind.isin(*READ_TYPES)


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each box (image, pos, x, y, w, h, type) with the planes of its part of the image; what lies outside the image is cut off.

    An equal join on the image; a box without a pixel of the image has empty planes.
    """
    size = images.columns
    i = images.select(F.col("image"), F.col("width").alias("_w"), F.col("height").alias("_h"), *(F.col(p).alias(f"_{p}") if p in size else F.lit(None).cast("array<int>").alias(f"_{p}") for p in PLANES))
    whole = lambda c: F.floor(c).cast("int")
    b = boxes.join(i, "image").withColumns({"_x": F.greatest(F.lit(0), whole("x")), "_y": F.greatest(F.lit(0), whole("y"))})
    b = b.withColumns({"width": F.greatest(F.lit(0), F.least(whole("w"), F.col("_w") - F.col("_x"))), "height": F.greatest(F.lit(0), F.least(whole("h"), F.col("_h") - F.col("_y")))})
    rows = F.when((F.col("width") > 0) & (F.col("height") > 0), F.sequence(F.lit(0), F.col("height") - 1)).otherwise(F.array().cast("array<int>"))
    part = lambda p: F.when(F.col(f"_{p}").isNotNull(), F.flatten(F.transform(rows, lambda r: F.slice(F.col(f"_{p}"), (F.col("_y") + r) * F.col("_w") + F.col("_x") + 1, F.col("width")))))
    return b.withColumns({p: part(p) for p in PLANES}).drop("_w", "_h", "_x", "_y", *(f"_{p}" for p in PLANES))


def pixel(x, y, width=None):
    """The colour (r, g, b) at floor(x), floor(y); null outside."""
    width = F.col("width") if width is None else width
    at = (F.floor(y) * width + F.floor(x)).cast("int")
    return F.struct(*(F.get(F.col(p), at).alias(p) for p in "rgb"))


def apart(a, b):
    return color.distance([a[p] for p in "rgb"], [b[p] for p in "rgb"])


def background():
    """The most common colour of the four corners, of equal ones the first: top left, top right, bottom left, bottom right."""
    right, low = F.col("width") - 1, F.col("height") - 1
    corners = F.array(pixel(F.lit(0), F.lit(0)), pixel(right, F.lit(0)), pixel(F.lit(0), low), pixel(right, low))
    n = F.transform(corners, lambda c: F.size(F.filter(corners, lambda d: d == c)))
    return F.get(corners, (F.array_position(n, F.array_max(n)) - 1).cast("int"))


def frequent(n: int = 5):
    """The n most frequent colours in five bits a plane, each the mean of its pixels; of equally frequent ones the darker code."""
    pixels = F.arrays_zip("r", "g", "b")
    code = lambda c: F.shiftright(c["r"], 3) * 1024 + F.shiftright(c["g"], 3) * 32 + F.shiftright(c["b"], 3)
    codes = F.transform(pixels, code)
    own = lambda k: F.filter(pixels, lambda c: code(c) == k)
    ranked = F.array_sort(F.transform(F.array_distinct(codes), lambda k: F.struct((-F.size(F.filter(codes, lambda c: c == k))).alias("n"), k.alias("k"))))
    mean = lambda k, p: F.floor(F.aggregate(own(k), F.lit(0.0), lambda s, c: s + c[p]) / F.size(own(k)) + 0.5).cast("int").alias(p)
    return F.transform(F.slice(ranked, 1, n), lambda e: F.struct(*(mean(e["k"], p) for p in "rgb")))


def roles(colours, back):
    """primary: the first colour that differs from the background, else the first; secondary: the next such; foreground: the farthest, black if none differs; accent: from the third on."""
    far = F.filter(colours, lambda c: apart(c, back) > APART)
    ranked = F.array_sort(F.transform(colours, lambda c, i: F.struct((-apart(c, back)).alias("d"), i.alias("i"), c.alias("c"))))
    black = F.struct(*(F.lit(0).alias(p) for p in "rgb"))
    top = F.get(ranked, F.lit(0))
    return F.struct(
        F.coalesce(F.get(far, F.lit(0)), F.get(colours, F.lit(0))).alias("primary"), F.get(F.filter(far, lambda c: c != F.coalesce(F.get(far, F.lit(0)), F.get(colours, F.lit(0)))), F.lit(0)).alias("secondary"), back.alias("background"),
        F.when(top["d"] < 0, top["c"]).otherwise(black).alias("foreground"), F.slice(colours, 3, 1000).alias("accent"),
    )


def gradient():
    """A linear gradient where the middles of opposite edges differ: angle 180 from top to bottom, else 90 from left to right; null for none."""
    w, h = F.col("width"), F.col("height")
    top, bottom = pixel(w / 2, F.lit(0)), pixel(w / 2, h - 1)
    left, right = pixel(F.lit(0), h / 2), pixel(w - 1, h / 2)
    made = lambda a, b, angle: F.struct(F.lit("linear").alias("type"), F.array(a, b).alias("colors"), F.lit(angle).alias("angle"))
    return F.when(apart(top, bottom) > APART, made(top, bottom, 180)).when(apart(left, right) > APART, made(left, right, 90))


def opacity():
    """Mean of the alpha plane over 255; 1 without one."""
    mean = F.aggregate("alpha", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("alpha"), F.lit(0))
    return F.when(F.col("alpha").isNotNull(), F.coalesce(mean / 255.0, F.lit(1.0))).otherwise(1.0)


def content(below: int = 240):
    """First and last row and column (top, right, bottom, left) with a pixel darker than ``below``; a blank crop's own edges."""
    w, h = F.col("width"), F.col("height")
    inside = F.filter(F.sequence(F.lit(0), F.size("px") - 1), lambda i: F.get("px", i) < below)
    xs, ys = F.transform(inside, lambda i: (i % w).cast("int")), F.transform(inside, lambda i: F.floor(i / w).cast("int"))
    return F.struct(F.coalesce(F.array_min(ys), F.lit(0)).alias("top"), F.coalesce(F.array_max(xs), w - 1).alias("right"), F.coalesce(F.array_max(ys), h - 1).alias("bottom"), F.coalesce(F.array_min(xs), F.lit(0)).alias("left"))


def padding(bounds):
    """Space around the content: to the edge on the left and above, to the full size on the right and below."""
    return F.struct(bounds["top"].alias("top"), (F.col("width") - bounds["right"]).alias("right"), (F.col("height") - bounds["bottom"]).alias("bottom"), bounds["left"].alias("left"))


def alignment(bounds):
    left, right = bounds["left"], F.col("width") - bounds["right"]
    return F.when(F.abs(left - right) < 5, "center").when(left < right, "left").otherwise("right")


def font_size(height):
    """Seven tenths of the height, rounded half up."""
    return F.floor(height * F.lit(0.7) + 0.5).cast("int")


def extracted(cropped: DataFrame, palette=None) -> DataFrame:
    """Crops with colors, gradient, padding, opacity and, for texts, typography (size, line height, weight, alignment).

    The palette is that of ``pixels.palette``, by median cut, unless another column of colours is given. A crop without pixels
    gets the defaults: black on white, no gradient or padding, opacity 1.
    """
    some = F.size("px") > 0
    white, black = (F.struct(*(F.lit(v).alias(p) for p in "rgb")) for v in (255, 0))
    nothing = F.array().cast("array<struct<r:int,g:int,b:int>>")
    plain = F.struct(black.alias("primary"), F.lit(None).cast("struct<r:int,g:int,b:int>").alias("secondary"), white.alias("background"), black.alias("foreground"), nothing.alias("accent"))
    out = cropped.withColumns({"_back": background(), "_palette": pixels.palette() if palette is None else palette, "_bounds": content()})
    zero = F.struct(*(F.lit(0).alias(k) for k in ("top", "right", "bottom", "left")))
    typo = F.struct(font_size(F.col("height")).alias("size"), (font_size(F.col("height")) * 1.5).alias("line_height"), F.lit(400).alias("weight"), alignment(F.col("_bounds")).alias("align"))
    return out.withColumns({
        "colors": F.when(some, roles(F.col("_palette"), F.col("_back"))).otherwise(plain), "gradient": F.when(some, gradient()), "padding": F.when(some, padding(F.col("_bounds"))).otherwise(zero),
        "opacity": F.when(some, opacity()).otherwise(1.0), "typography": F.when(some & is_text(F.col("type")), typo),
    }).drop("_back", "_palette", "_bounds")
