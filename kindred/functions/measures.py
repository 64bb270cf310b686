"""Sizes, ratios, targets and scales of images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixels(w: Column, h: Column) -> Column:
    return w.cast("long") * h.cast("long")


def aspect(w: Column, h: Column) -> Column:
    return w.cast("double") / h.cast("double")


def aspect_difference(a: Column, b: Column) -> Column:
    """Symmetric: difference over the larger of the two."""
    return F.abs(a - b) / F.greatest(a, b)


def directional(c: dict[str, Column], b: dict[str, Column], tolerance: float) -> Column:
    """``c`` is smaller than ``b`` in width, height, pixels and bytes, with the same shape."""
    smaller = (c["width"] < b["width"]) & (c["height"] < b["height"]) & (pixels(c["width"], c["height"]) < pixels(b["width"], b["height"])) & (c["file_size"] < b["file_size"])
    return smaller & (aspect_difference(aspect(c["width"], c["height"]), aspect(b["width"], b["height"])) <= tolerance)


def pair_target(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """(w, h) of the smaller of two images, by pixels, then width, then height."""
    a, b = F.struct(pixels(w1, h1).alias("p"), w1.alias("w"), h1.alias("h")), F.struct(pixels(w2, h2).alias("p"), w2.alias("w"), h2.alias("h"))
    return F.least(a, b)


def capped(w: Column, h: Column, edge: int) -> tuple[Column, Column]:
    """Scaled so that the longest edge is at most ``edge``; halves round away from zero, nothing falls below 1."""
    longest = F.greatest(w, h)
    scale = F.lit(float(edge)) / longest
    over = longest > edge
    one = lambda x: F.greatest(F.when(over, F.round(x * scale)).otherwise(x).cast("long"), F.lit(1).cast("long"))
    return one(w), one(h)


def sensitivity_threshold(s: Column) -> Column:
    return F.lit(56) - F.floor((F.lit(48) * F.least(s, F.lit(100)) + 50) / 100)


def least_area(total: Column) -> Column:
    return F.greatest(F.lit(9).cast("long"), F.floor(total / 100000))


def slider_precise(t: Column) -> Column:
    return F.when(t <= 40, (9500 + 10 * t) / 10000.0).otherwise((9900 + t - 40) / 10000.0)


def slider_precise_inverse(v: Column) -> Column:
    x = F.round(v * 10000)
    return F.when(x <= 9900, F.round((x - 9500) / 10)).otherwise(x - 9900 + 40).cast("long")


def slider_settings(t: Column) -> Column:
    return F.when(t <= 90, (9000 + 10 * t) / 10000.0).otherwise((9900 + t - 90) / 10000.0)


def slider_settings_inverse(v: Column) -> Column:
    x = F.round(v * 10000)
    return F.when(x <= 9900, F.round((x - 9000) / 10)).otherwise(x - 9900 + 90).cast("long")


def recognition_threshold(current: Column, legacy_percent: Column) -> Column:
    """The stored threshold, else the older one in percent, clamped to 0.95..1 with 4 decimals; 0.985 by default."""
    value = F.coalesce(current.try_cast("double"), legacy_percent.try_cast("double") / 100, F.lit(0.985))
    return F.round(F.least(F.greatest(value, F.lit(0.95)), F.lit(1.0)), 4)


def grouping_distance(d: Column) -> Column:
    return F.least(F.greatest(F.round(d), F.lit(0.0)), F.lit(24.0)).cast("long")


def workers(cores: Column) -> Column:
    return F.least(F.greatest(cores - 1, F.lit(2)), F.lit(16)).cast("long")


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(done / total * 100)).cast("long")


def size_label(size: Column) -> Column:
    """Bytes as they are below 1 KB, else two decimals of KB, MB or GB."""
    shown = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        shown = F.when(size >= 1024**power, F.concat(F.format_string("%.2f", size / 1024**power), F.lit(f" {unit}"))).otherwise(shown)
    return shown
