"""Plane geometry as column expressions on points struct<x, y> and rectangles struct<x, y, width, height>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def affine(p: Column, m: Column) -> Column:
    """p under the transform struct<a, b, tx, c, d, ty>."""
    return point(m["a"] * p["x"] + m["b"] * p["y"] + m["tx"], m["c"] * p["x"] + m["d"] * p["y"] + m["ty"])


def inverse(m: Column) -> Column:
    """The inverse transform; null where the determinant is under 1e-10 in size."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    over = lambda v: F.try_divide(v, det)
    parts = {"a": over(m["d"]), "b": over(-m["b"]), "tx": over(m["b"] * m["ty"] - m["d"] * m["tx"]), "c": over(-m["c"]), "d": over(m["a"]), "ty": over(m["c"] * m["tx"] - m["a"] * m["ty"])}
    return F.when(F.abs(det) >= 1e-10, F.struct(*(v.alias(k) for k, v in parts.items())))


def inside(p: Column, r: Column) -> Column:
    """Whether a point lies in a closed rectangle."""
    return p["x"].between(r["x"], r["x"] + r["width"]) & p["y"].between(r["y"], r["y"] + r["height"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def bounds(points: Column) -> Column:
    """The rectangle around an array of points; null for none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height")))


def centroid(points: Column) -> Column:
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[f])
    return F.when(F.size(points) > 0, point(total("x") / F.size(points), total("y") / F.size(points)))


def path_length(points: Column) -> Column:
    """The sum of the distances of neighbouring points."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + F.coalesce(distance(F.get(points, i - 1), F.get(points, i)), F.lit(0.0)))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """The distance from a point to a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy)))
    t = F.coalesce(t, F.lit(0.0))
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


def on_trace(p: Column, points: Column, width: Column, tolerance: float) -> Column:
    """Whether some segment of a trace lies within tolerance and half its width of the point."""
    return F.exists(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.coalesce(segment_distance(p, F.get(points, i - 1), F.get(points, i)) <= tolerance + width / 2, F.lit(False)))


def in_polygon(p: Column, polygon: Column) -> Column:
    """Whether a ray from the point crosses the outline an odd number of times."""
    n = F.size(polygon)

    def crosses(i: Column) -> Column:
        a, b = F.get(polygon, i), F.get(polygon, F.pmod(i + 1, n))
        at = a["x"] + F.try_divide((p["y"] - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & F.coalesce(p["x"] < at, F.lit(False))

    return F.when(n > 2, F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1).otherwise(False)


def circle(x: Column, y: Column, radius: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(x + radius * F.cos(i * F.lit(2) * F.pi() / n), y + radius * F.sin(i * F.lit(2) * F.pi() / n)))


def snapped(v: Column) -> Column:
    """v on the grid of 5."""
    return F.round(v / 5) * 5


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue 0 to 180, saturation and value 0 to 255, from channels of 0 to 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(span == 0, 0.0).when(top == r, F.pmod(60 * F.try_divide(g - b, span), F.lit(360.0))).when(top == g, 60 * F.try_divide(b - r, span) + 120).otherwise(60 * F.try_divide(r - g, span) + 240)
    return F.struct((hue / 2).alias("h"), F.when(top == 0, 0.0).otherwise(255 * F.try_divide(span, top)).alias("s"), top.cast("double").alias("v"))
