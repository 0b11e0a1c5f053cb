"""Rectangles struct<x, y, width, height> and transforms struct<a, b, tx, c, d, ty> as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.geometry import point


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def box_center(r: Column) -> Column:
    return point(r["x"] + r["width"] / 2, r["y"] + r["height"] / 2)


def box_union(a: Column, b: Column) -> Column:
    """The smallest box around two."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["width"], b["x"] + b["width"]) - x, F.greatest(a["y"] + a["height"], b["y"] + b["height"]) - y)


def overlap_share(a: Column, b: Column) -> Column:
    """The common area over the smaller box's; 0 for boxes that only touch."""
    wide = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.when((wide > 0) & (high > 0), F.try_divide(wide * high, F.least(a["width"] * a["height"], b["width"] * b["height"]))).otherwise(0.0)


def turned_back(r: Column, rotation: Column, width: Column, height: Column) -> Column:
    """A box of a picture that was turned by 90, 180 or 270 degrees, in the picture of width by height before."""
    x, y, w, h = (r[c] for c in ("x", "y", "width", "height"))
    return (
        F.when(rotation == 90, box(height - y - h, x, h, w)).when(rotation == 180, box(width - x - w, height - y - h, w, h))
        .when(rotation == 270, box(y, width - x - w, h, w)).otherwise(box(x, y, w, h))
    )


def turned_board(r: Column, width: Column, height: Column, new_width: Column, new_height: Column, degrees: Column) -> Column:
    """A board's box after its picture was turned about its centre into a new one: the long edge lies level."""
    turn = F.radians(degrees)
    dx, dy = r["x"] + r["width"] / 2 - width / 2, r["y"] + r["height"] / 2 - height / 2
    cx, cy = dx * F.cos(turn) - dy * F.sin(turn) + new_width / 2, dx * F.sin(turn) + dy * F.cos(turn) + new_height / 2
    long, short = F.greatest(r["width"], r["height"]), F.least(r["width"], r["height"])
    half = lambda v: F.floor(v / 2).cast("int")
    return box(cx.cast("int") - half(long), cy.cast("int") - half(short), long, short)


def rotation(radians: Column) -> Column:
    """The transform that turns about the origin."""
    zero = F.lit(0.0)
    return F.struct(F.cos(radians).alias("a"), (-F.sin(radians)).alias("b"), zero.alias("tx"), F.sin(radians).alias("c"), F.cos(radians).alias("d"), zero.alias("ty"))


def composed(m: Column, n: Column) -> Column:
    """The transform that applies n, then m."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"), (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"), (m["a"] * n["tx"] + m["b"] * n["ty"] + m["tx"]).alias("tx"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"), (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"), (m["c"] * n["tx"] + m["d"] * n["ty"] + m["ty"]).alias("ty"),
    )


def affine_through(source: list[Column], target: list[Column]) -> Column:
    """The transform that takes three points to three others; null for points on a line."""
    p, q, r = source
    det = (q["x"] - p["x"]) * (r["y"] - p["y"]) - (r["x"] - p["x"]) * (q["y"] - p["y"])

    def row(f: str, names: tuple[str, str, str]) -> list[Column]:
        u, v, w = (t[f] for t in target)
        along = F.try_divide((v - u) * (r["y"] - p["y"]) - (w - u) * (q["y"] - p["y"]), det)
        across = F.try_divide((w - u) * (q["x"] - p["x"]) - (v - u) * (r["x"] - p["x"]), det)
        return [along.alias(names[0]), across.alias(names[1]), (u - along * p["x"] - across * p["y"]).alias(names[2])]

    return F.when(F.abs(det) >= 1e-10, F.struct(*row("x", ("a", "b", "tx")), *row("y", ("c", "d", "ty"))))


def squared_outline(points: Column, tolerance: float) -> Column:
    """An outline with its nearly level and nearly upright edges made so: a corner takes the middle of the edge before
    it, or else of the one after it; slanted edges leave theirs alone."""
    n = F.size(points)

    def snapped(i: Column, own: str, other: str) -> Column:
        p, q = F.get(points, F.pmod(i, n)), F.get(points, F.pmod(i + 1, n))
        off, along = F.abs(q[own] - p[own]), F.abs(q[other] - p[other])
        return F.when((off <= tolerance) & (along > off), (p[own] + q[own]) / 2)

    at = lambda i, own, other: F.coalesce(snapped(i - 1, own, other), snapped(i, own, other), F.get(points, i)[own])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(at(i, "x", "y"), at(i, "y", "x")))).otherwise(points)
