"""Level and upright wire paths as arrays of points: routes, channels, scores, and the pin tips that they join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.geometry import point, snapped

#: What counts as the same place, the price of a bend, and that of running along a wire of one's own net.
EPSILON, BEND, ALONG = 0.75, 30.0, 40.0


def segment(a: Column, b: Column) -> Column:
    return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def is_upright(s: Column) -> Column:
    return F.abs(s["x1"] - s["x2"]) < EPSILON


def on_segment(p: Column, s: Column) -> Column:
    """Whether a point lies on a level or upright segment, its ends included."""
    within = lambda v, a, b: (v > F.least(a, b) - EPSILON) & (v < F.greatest(a, b) + EPSILON)
    upright = (F.abs(p["x"] - s["x1"]) < EPSILON) & within(p["y"], s["y1"], s["y2"])
    return F.when(is_upright(s), upright).otherwise((F.abs(p["y"] - s["y1"]) < EPSILON) & within(p["x"], s["x1"], s["x2"]))


def run_together(s: Column, t: Column) -> Column:
    """Whether two such segments lie on one line and share more than a point."""
    common = lambda a, b: F.least(F.greatest(s[a], s[b]), F.greatest(t[a], t[b])) - F.greatest(F.least(s[a], s[b]), F.least(t[a], t[b])) > EPSILON
    upright = (F.abs(s["x1"] - t["x1"]) < EPSILON) & common("y1", "y2")
    level = (F.abs(s["y1"] - t["y1"]) < EPSILON) & common("x1", "x2")
    return (is_upright(s) == is_upright(t)) & F.when(is_upright(s), upright).otherwise(level)


def path_segments(path: Column) -> Column:
    """The segments of a path of two points or more; none for a shorter one."""
    return F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: segment(F.get(path, i - 1), F.get(path, i)))).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def path_score(path: Column, own: Column) -> Column:
    """A path's price: its length, its bends, and each segment that runs along one of its own net (an array of segments)."""
    each = path_segments(path)
    length = F.aggregate(each, F.lit(0.0), lambda t, s: t + F.abs(s["x2"] - s["x1"]) + F.abs(s["y2"] - s["y1"]))
    doubled = F.size(F.filter(each, lambda s: F.exists(own, lambda o: run_together(s, o))))
    return length + BEND * (F.size(path) - 2) + ALONG * doubled


def manhattan(a: Column, b: Column, from_output: Column) -> Column:
    """The plain path between two points: straight if they are level or upright, through the middle from an output or to
    an input, else level first and then down."""
    straight = (F.abs(a["x"] - b["x"]) < 1) | (F.abs(a["y"] - b["y"]) < 1)
    middle = snapped((a["x"] + b["x"]) / 2)
    return F.when(straight, F.array(a, b)).when(from_output, F.array(a, point(middle, a["y"]), point(middle, b["y"]), b)).otherwise(F.array(a, point(b["x"], a["y"]), b))


def channels(a: Column, b: Column, inside: float, step: float, outside: float) -> Column:
    """Where a path may turn between a and b: grid places between them, from the middle outwards, then beyond both."""
    low, high, middle = F.least(a, b), F.greatest(a, b), snapped((a + b) / 2)
    steps = lambda first, last: F.sequence(F.lit(first), F.lit(int(last // step)))
    near = F.flatten(F.transform(steps(0, inside), lambda k: F.array(middle - k * step, middle + k * step)))
    between = F.filter(near, lambda v: (v > low + EPSILON) & (v < high - EPSILON))
    beyond = F.flatten(F.transform(steps(1, outside), lambda k: F.array(low - k * step, high + k * step)))
    return F.array_distinct(F.transform(F.concat(between, beyond), snapped))


def pin_tip(at: Column, tip: Column, flip_h: Column, flip_v: Column, degrees: Column) -> Column:
    """A pin's tip on the sheet: the symbol's tip mirrored, turned by a multiple of 90 degrees, and moved to its place."""
    x, y = F.when(flip_h, -tip["x"]).otherwise(tip["x"]), F.when(flip_v, -tip["y"]).otherwise(tip["y"])
    turn = F.pmod(degrees, F.lit(360))
    tx = F.when(turn == 90, -y).when(turn == 180, -x).when(turn == 270, y).otherwise(x)
    ty = F.when(turn == 90, x).when(turn == 180, -y).when(turn == 270, -x).otherwise(y)
    return point(at["x"] + tx, at["y"] + ty)


#: How far channels reach between two pins, their step, and how far beyond; narrow and wide. Then the
#: offsets at which a wire may leave a crowded pin.
NARROW, WIDE, TRUNKS = (120.0, 10.0, 60.0), (600.0, 5.0, 300.0), (600.0, 10.0, 300.0)
ESCAPES = (10, 15, 20, 25, 30, 40)


def tidy(path: Column) -> Column:
    """The path without points at the same place as the one before."""
    step = lambda out, p: F.when((F.abs(F.element_at(out, -1)["x"] - p["x"]) < EPSILON) & (F.abs(F.element_at(out, -1)["y"] - p["y"]) < EPSILON), out).otherwise(F.concat(out, F.array(p)))
    return F.aggregate(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 1, 1), step)


def direct_paths(a: Column, b: Column, reach: tuple[float, float, float]) -> Column:
    """Candidate paths from a to b in the order in which equal prices are settled: straight, with one bend, and with two
    bends at each channel."""
    aligned = (F.abs(a["x"] - b["x"]) < EPSILON) | (F.abs(a["y"] - b["y"]) < EPSILON)
    straight = F.when(aligned, F.array(F.array(a, b))).otherwise(F.slice(F.array(F.array(a, b)), 1, 0))
    bent = F.array(F.array(a, point(b["x"], a["y"]), b), F.array(a, point(a["x"], b["y"]), b))
    across = F.transform(channels(a["x"], b["x"], *reach), lambda m: F.array(a, point(m, a["y"]), point(m, b["y"]), b))
    along = F.transform(channels(a["y"], b["y"], *reach), lambda m: F.array(a, point(a["x"], m), point(b["x"], m), b))
    return F.filter(F.transform(F.concat(straight, bent, across, along), tidy), lambda p: F.size(p) > 1)


def escapes(direction: Column) -> Column:
    """Offsets for leaving a pin, the natural way of its direction first: outputs to the right, others to the left."""
    right = F.array(*(F.lit(float(d)) for d in ESCAPES))
    left = F.transform(right, lambda d: -d)
    return F.when(direction == "output", F.concat(right, left)).otherwise(F.concat(left, right))
