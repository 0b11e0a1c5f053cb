"""Outlines and paths as arrays of points: hulls, clipping and simplification, by small helpers in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
Path = list[tuple[float, float]]


def _mapped(helper: Callable[..., Path]) -> Callable[..., Column]:
    """helper on points as a column function; null in, null out."""

    @F.pandas_udf(T.ArrayType(POINT))
    def run(points: pd.Series, *more: pd.Series) -> pd.Series:
        rows = zip(points, *more, strict=True)
        read = lambda v: [(p["x"], p["y"]) for p in v] if hasattr(v, "__len__") and not isinstance(v, str) else v
        return pd.Series([None if r[0] is None else [{"x": x, "y": y} for x, y in helper(*map(read, r))] for r in rows])

    return run


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points: Path) -> Path:
    """The convex hull, counter-clockwise from the lowest x, without points on its edges."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    sides = []
    for way in (pts, pts[::-1]):
        chain: Path = []
        for p in way:
            while len(chain) > 1 and _cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        sides += chain[:-1]
    return sides


def clipped(subject: Path, window: Path) -> Path:
    """The part of an outline inside a convex, counter-clockwise window."""
    out = subject
    for a, b in zip(window, window[1:] + window[:1], strict=True):
        kept: Path = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            sp, sq = _cross(a, b, p), _cross(a, b, q)
            if sp >= 0:
                kept.append(p)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = kept
    return out


def simplified(points: Path, epsilon: float) -> Path:
    """Points farther than epsilon from the chord of their neighbours kept, by halves, without recursion."""
    if len(points) < 3:
        return points
    keep, spans = {0, len(points) - 1}, [(0, len(points) - 1)]
    while spans:
        i, j = spans.pop()
        (ax, ay), (bx, by) = points[i], points[j]
        length = math.hypot(bx - ax, by - ay)
        away = lambda p: abs(_cross((ax, ay), (bx, by), p)) / length if length else math.hypot(p[0] - ax, p[1] - ay)
        far = max(((away(points[k]), -k) for k in range(i + 1, j)), default=(0.0, 0))
        if far[0] > epsilon:
            keep.add(-far[1])
            spans += [(i, -far[1]), (-far[1], j)]
    return [points[k] for k in sorted(keep)]


def turned_only(points: Path, least: float) -> Path:
    """Inner points at which the path, seen from the last kept point, turns by least degrees or more."""
    if len(points) < 3:
        return points
    out = points[:1]
    for p, q in zip(points[1:-1], points[2:], strict=True):
        a, b = math.atan2(p[1] - out[-1][1], p[0] - out[-1][0]), math.atan2(q[1] - p[1], q[0] - p[0])
        turn = abs(math.degrees((b - a + math.pi) % (2 * math.pi) - math.pi))
        if turn >= least:
            out.append(p)
    return [*out, points[-1]]


def straightened(points: Path) -> Path:
    """turned_only by one degree until nothing changes."""
    while (shorter := turned_only(points, 1.0)) != points:
        points = shorter
    return points


def distinct_path(points: Column, epsilon: float = 1e-6) -> Column:
    """The path without points within epsilon of the one kept before."""
    step = lambda out, p: F.when((F.size(out) > 0) & (F.hypot(F.element_at(out, -1)["x"] - p["x"], F.element_at(out, -1)["y"] - p["y"]) <= epsilon), out).otherwise(F.concat(out, F.array(p)))
    return F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1), step)


def is_convex(polygon: Column) -> Column:
    """Whether all corners of an outline of three points or more turn the same way."""
    n = F.size(polygon)

    def turn(i: Column) -> Column:
        a, b, c = (F.get(polygon, F.pmod(i + k, n)) for k in range(3))
        return F.signum((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))

    signs = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), turn), lambda s: s != 0))
    return (n >= 3) & (F.size(signs) == 1)


convex_hull, clip, simplify, suppress_turns, straighten = map(_mapped, (hull, clipped, simplified, turned_only, straightened))
