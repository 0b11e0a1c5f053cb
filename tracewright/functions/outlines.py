"""Outlines of vias seen from two sides: one circle for a confirmed via, one boundary for two readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.geometry import centroid, circle, distance
from tracewright.functions.polygons import convex_hull


def _reach(center: Column, points: Column) -> Column:
    """The way from the centre to the farthest of the points."""
    return F.array_max(F.transform(points, lambda p: distance(center, p)))


def confirmed_outline(front: Column, back: Column) -> Column:
    """32 points of a circle for a via (center, radius, pad_boundary) of each side, null boundaries being empty.

    The circle lies midway. It takes in 0.95 of the way to the farthest point of the boundaries of three points and more
    (a hull has no farther point, so none is built), but no more than the larger radius; without such a boundary, and
    where two of them stay under 1, it has the mean radius.
    """
    x, y = (((front["center"][c] + back["center"][c]) / 2) for c in "xy")
    mean, most = (front["radius"] + back["radius"]) / 2, F.greatest(front["radius"], back["radius"])
    usable = lambda v: F.when(F.size(v["pad_boundary"]) >= 3, v["pad_boundary"]).otherwise(F.slice(F.coalesce(v["pad_boundary"], F.array()), 1, 0))
    a, b = usable(front), usable(back)
    reach = 0.95 * _reach(F.struct(x.alias("x"), y.alias("y")), F.concat(a, b))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return circle(x, y, F.when(reach.isNull(), mean).otherwise(F.least(F.when(both & (reach < 1), mean).otherwise(reach), most)), 32)


def merged_boundary(a: Column, b: Column) -> Column:
    """(center, radius, boundary, is_circle) of two such readings together.

    A reading without a boundary counts as 32 points of its circle, if it has a radius. The boundary is the hull of all
    points, the centre their mean. Of fewer than three points the reading of the larger radius stays as it is, the first
    on ties; points on one line give a circle of 64 points.
    """
    own = lambda r: F.when(F.size(r["boundary"]) > 0, r["boundary"]).when(r["radius"] > 0, circle(r["center"]["x"], r["center"]["y"], r["radius"], 32)).otherwise(F.slice(circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), 1), 1, 0))
    points = F.concat(own(a), own(b))
    center, hull = centroid(points), convex_hull(points)
    radius, flat = _reach(center, points), F.size(hull) < 3
    boundary = F.when(flat, circle(center["x"], center["y"], radius, 64)).otherwise(hull)
    merged = F.struct(center.alias("center"), radius.alias("radius"), boundary.alias("boundary"), flat.alias("is_circle"))
    same = lambda r: F.struct(*(r[c].alias(c) for c in ("center", "radius", "boundary", "is_circle")))
    return F.when(F.size(points) >= 3, merged).when(a["radius"] >= b["radius"], same(a)).otherwise(same(b))
