"""Boxes, resizing and vision-token arithmetic as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_box(box: Column, low: float = 0, high: float = 1000) -> Column:
    """Four finite numbers in range, with positive width and height."""
    inside = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(low, high))
    return F.coalesce((F.size(box) == 4) & inside & (box[0] < box[2]) & (box[1] < box[3]), F.lit(False))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def smart_resize(height: Column, width: Column, factor: int, least: int, most: int) -> Column:
    """struct(height, width): multiples of factor nearest to the given sizes, with an area between least and most."""
    up = lambda x: F.ceil(x / factor) * factor
    down = lambda x: F.greatest(F.lit(factor), F.floor(x / factor) * factor)
    near = lambda x: F.greatest(F.lit(factor), (F.bround(x / factor) * factor).cast("long"))
    h, w = near(height), near(width)
    shrink, grow = F.sqrt(height * width / most), F.sqrt(F.lit(float(least)) / (height * width))
    pick = lambda x, plain: F.when(h * w > most, down(x / shrink)).when(h * w < least, up(x * grow)).otherwise(plain).cast("long")
    return F.struct(pick(height, h).alias("height"), pick(width, w).alias("width"))


def refitted(height: Column, width: Column, factor: int, least: int, most: int, fetched: bool) -> Column:
    """struct(height, width) as smart_resize, with the least side of one factor kept only before an image is shrunk to the
    greatest area (fetched), or only after it (not fetched)."""
    rounded = lambda x: (F.bround(x / factor) * factor).cast("long")
    one = lambda x, on: F.greatest(F.lit(factor).cast("long"), x) if on else x
    h, w = one(rounded(height), fetched), one(rounded(width), fetched)
    shrink, grow = F.sqrt(height * width / most), F.sqrt(F.lit(float(least)) / (height * width))
    down = lambda x: one(F.floor(x / shrink / factor) * factor, not fetched)
    up = lambda x: F.ceil(x * grow / factor) * factor
    pick = lambda x, plain: F.when(h * w > most, down(x)).when(h * w < least, up(x)).otherwise(plain).cast("long")
    return F.struct(pick(height, h).alias("height"), pick(width, w).alias("width"))


def header_tokens(height: Column, width: Column, patch: int, merge: int, least: int, most: int, fetched: bool = True, resize: bool = True) -> Column:
    """struct(tokens, problem): the merged tokens that an image takes, by its size alone. fetched: it is refitted to
    multiples of 28 first; resize: the processor refits it to multiples of patch * merge. problem: sides that aren't
    positive or are missing, an aspect over 200, or sides that don't align in the end; tokens are null then."""
    factor = patch * merge

    def aspect(s: Column) -> Column:
        return F.greatest(s["height"], s["width"]) / F.least(s["height"], s["width"]) > 200

    def second(s: Column) -> Column:
        out = refitted(s["height"], s["width"], factor, least, most, False) if resize else s
        ok = (out["height"] > 0) & (out["width"] > 0) & (out["height"] % factor == 0) & (out["width"] % factor == 0)
        bad = F.when(s["problem"].isNotNull(), s["problem"]).when(F.lit(resize) & aspect(s), "aspect").when(~ok, "alignment")
        return F.struct(F.when(bad.isNull(), (out["height"] / factor).cast("long") * (out["width"] / factor).cast("long")).alias("tokens"), bad.alias("problem"))

    def first(s: Column) -> Column:
        good = F.coalesce((s["height"] > 0) & (s["width"] > 0), F.lit(False))
        bad = F.when(~good, "size")
        if fetched:
            bad = F.when(~good, "size").when(aspect(s), "aspect")
        side = lambda n: F.when(bad.isNull(), refitted(s["height"], s["width"], 28, 4 * 28**2, 16384 * 28**2, True)[n] if fetched else s[n]).cast("long")
        return F.struct(side("height").alias("height"), side("width").alias("width"), bad.alias("problem"))

    start = F.array(F.struct(height.cast("long").alias("height"), width.cast("long").alias("width")))
    return F.transform(F.transform(start, first), second)[0]


def vision_tokens(size: Column, factor: int) -> Column:
    return F.floor(size["height"] * size["width"] / (factor * factor)).cast("long")


def area_tokens(height: Column, width: Column, per_token: int) -> Column:
    return F.floor(height * width / per_token).cast("long")


def prompt_tokens(vision: Column, pages: Column, chars: Column, per_page: int = 8, base: int = 256) -> Column:
    """Vision tokens, an overhead a page, a token for three characters, and a base."""
    return vision + pages * per_page + F.floor(chars / 3) + base


def pixel_box(box: Column, width: Column, height: Column, scale: float = 1000) -> Column:
    """Normalised to pixel coordinates: outwards, and inside the page."""
    low = lambda x, n: F.greatest(F.lit(0), F.floor(x * n / scale))
    high = lambda x, n: F.least(n, F.ceil(x * n / scale))
    return F.array(low(box[0], width), low(box[1], height), high(box[2], width), high(box[3], height))


def padded_crop(box: Column, width: Column, height: Column, pad: float = 0.05) -> Column:
    """A pixel box widened by a share of its own size on each side, inside the page."""
    dx, dy = (box[2] - box[0]) * pad, (box[3] - box[1]) * pad
    return F.array(
        F.greatest(F.lit(0), F.floor(box[0] - dx)), F.greatest(F.lit(0), F.floor(box[1] - dy)),
        F.least(width, F.ceil(box[2] + dx)), F.least(height, F.ceil(box[3] + dy)),
    )


def aspect_padded(width: Column, height: Column, most: float = 199) -> Column:
    """struct(width, height) with the shorter side long enough for the aspect ratio."""
    return F.struct(
        F.greatest(width, F.ceil(height / most)).alias("width"), F.greatest(height, F.ceil(width / most)).alias("height")
    )


def expanded_box(box: Column, factor: float = 1.2, least: float = 80, high: float = 1000) -> Column:
    """A box about the same centre, factor times as large but least wide and high at least, moved inside the page."""

    def side(a: Column, b: Column) -> tuple[Column, Column]:
        size = F.least(F.lit(high), F.greatest((b - a) * factor, F.lit(least)))
        start = F.least(F.greatest((a + b) / 2 - size / 2, F.lit(0.0)), F.lit(high) - size)
        return start, start + size

    (x0, x1), (y0, y1) = side(box[0], box[2]), side(box[1], box[3])
    return F.array(x0, y0, x1, y1)


def png_size(content: Column) -> Column:
    """struct(width, height) from the header of a PNG file."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.struct(number(17).alias("width"), number(21).alias("height"))
