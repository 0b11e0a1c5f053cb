"""Routing against a plain Python router that lays one edge after the other."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tracewright.operators import wiring

NEAR = 0.75


def close(p, q):
    return abs(p[0] - q[0]) < NEAR and abs(p[1] - q[1]) < NEAR


def lies_on(p, s):
    (x1, y1), (x2, y2) = s
    i = 0 if abs(x1 - x2) < NEAR else 1  # the coordinate that is fixed
    low, high = sorted((s[0][1 - i], s[1][1 - i]))
    return abs(p[i] - s[0][i]) < NEAR and low - NEAR < p[1 - i] < high + NEAR


def tidy(path):
    out = path[:1]
    for p in path[1:]:
        if not close(p, out[-1]):
            out.append(p)
    return out


def grid(v):
    return float(int(abs(v) / 5 + 0.5) * 5) * (1 if v >= 0 else -1)


def places(a, b, inside, step, outside):
    low, high, mid = min(a, b), max(a, b), grid((a + b) / 2)
    near = [mid + sign * k * step for k in range(int(inside / step) + 1) for sign in (-1, 1)]
    far = [v for k in range(1, int(outside / step) + 1) for v in (low - k * step, high + k * step)]
    return list(dict.fromkeys(grid(v) for v in [v for v in near if low + NEAR < v < high - NEAR] + far))


def two_bends(a, b, reach):
    if abs(a[0] - b[0]) < NEAR or abs(a[1] - b[1]) < NEAR:
        yield [a, b]
    yield [a, (b[0], a[1]), b]
    yield [a, (a[0], b[1]), b]
    yield from ([a, (m, a[1]), (m, b[1]), b] for m in places(a[0], b[0], *reach))
    yield from ([a, (a[0], m), (b[0], m), b] for m in places(a[1], b[1], *reach))


def sideways(direction):
    right = [10, 15, 20, 25, 30, 40]
    left = [-d for d in right]
    return right + left if direction == "output" else left + right


class Sheet:
    def __init__(self, tips, lines):
        self.tips, self.lines = list(tips), list(lines)

    def clear(self, path, net):
        end = lambda p: close(p, path[0]) or close(p, path[-1])
        legs = list(itertools.pairwise(path))
        hit = any(o != net and not end(p) and any(lies_on(p, s) for s in legs) for o, p in self.tips)
        return not hit and not any(o != net and not end(p) and lies_on(p, s) for p in path for o, s in self.lines)

    def price(self, path, net):
        total = 30 * (len(path) - 2)
        for s in itertools.pairwise(path):
            total += abs(s[0][0] - s[1][0]) + abs(s[0][1] - s[1][1])
            total += 40 * any(o == net and self.shares(s, t) for o, t in self.lines)
        return total

    @staticmethod
    def shares(s, t):
        upright = [abs(q[0][0] - q[1][0]) < NEAR for q in (s, t)]
        i = 0 if upright[0] else 1
        if upright[0] != upright[1] or abs(s[0][i] - t[0][i]) >= NEAR:
            return False
        (a, b), (c, d) = (sorted((q[0][1 - i], q[1][1 - i])) for q in (s, t))
        return min(b, d) - max(a, c) > NEAR

    def lay(self, net, a, b, da, db):
        path = self.choose(net, a, b, da, db)
        self.tips += [(net, p) for p in path]
        self.lines += [(net, s) for s in itertools.pairwise(path)]
        return path

    def choose(self, net, a, b, da, db):
        for reach in ((120, 10, 60), (600, 5, 300)):
            found = [p for p in map(tidy, two_bends(a, b, reach)) if len(p) > 1 and self.clear(p, net)]
            if found:
                return min(found, key=lambda p: self.price(p, net))
        for m, u, v in itertools.product(places(a[1], b[1], 600, 10, 300), sideways(da), sideways(db)):
            x, z = grid(a[0] + u), grid(b[0] + v)
            path = tidy([a, (x, a[1]), (x, m), (z, m), (z, b[1]), b])
            if self.clear(path, net):
                return path
        if abs(a[0] - b[0]) < 1 or abs(a[1] - b[1]) < 1:
            return [a, b]
        if da == "output" or db == "input":
            return [a, (grid((a[0] + b[0]) / 2), a[1]), (grid((a[0] + b[0]) / 2), b[1]), b]
        return [a, (b[0], a[1]), b]


def tree(pins):
    groups = {i: {i} for i in range(len(pins))}
    out = []
    for _, i, j in sorted((abs(p[1] - q[1]) + abs(p[2] - q[2]), i, j) for (i, p), (j, q) in itertools.combinations(enumerate(pins), 2)):
        if groups[i] is not groups[j]:
            groups[i] |= groups[j]
            for k in groups[j]:
                groups[k] = groups[i]
            out.append((i, j))
    return out


def by_hand(pins, stubs):
    """{(sheet, net, from, to): path} of pins (sheet, net, id, x, y, direction), laid one edge after the other."""
    out = {}
    for sheet in sorted({p[0] for p in pins}):
        own = [p for p in pins if p[0] == sheet]
        board = Sheet([(p[1] or None, (p[3], p[4])) for p in own] + [(s[1], (s[2], s[3])) for s in stubs if s[0] == sheet], [(s[1], ((s[2], s[3]), (s[4], s[5]))) for s in stubs if s[0] == sheet])
        nets = {}
        for p in sorted(own, key=lambda p: p[2]):
            if p[1]:
                nets.setdefault(p[1], []).append(p[2:])
        for net in sorted(nets, key=lambda n: (-len(nets[n]), n)):
            for i, j in tree(nets[net]):
                a, b = nets[net][i], nets[net][j]
                out[sheet, net, a[0], b[0]] = board.lay(net, a[1:3], b[1:3], a[3], b[3])
    return out


def crowded(rng, sheet, columns, rows, nets):
    """Pins on both sides of columns of symbols, 20 apart, dealt to nets at random; some have none."""
    pins = []
    for c, r, side in itertools.product(range(columns), range(rows), (-40, 40)):
        net = rng.choice([*(f"n{k:02d}" for k in range(nets)), ""])
        pins.append((sheet, net, f"{sheet}-{c}-{r:02d}-{side}", 200.0 + 250 * c + side, 200.0 + 20 * r, "output" if side > 0 else "input"))
    return pins


@pytest.fixture(scope="module")
def drawing():
    rng = random.Random(11)
    pins = crowded(rng, "s1", 2, 5, 4) + crowded(rng, "s2", 2, 4, 3) + crowded(rng, "s3", 3, 4, 9)
    pins += [("s4", "a", "s4-1", 0.0, 0.0, "input"), ("s4", "a", "s4-2", 0.0, 0.0, "input"), ("s4", "b", "s4-3", 7.5, 3.0, "output")]
    # a pin that others wall in can be reached sideways only
    walls = [("s5", f"w{k}", f"s5-w{k}", x, y, "input") for k, (x, y) in enumerate((x, y) for x in (0.0, 300.0) for y in (-10.0, 10.0))]
    pins += walls + [("s5", "z", "s5-a", 0.0, 0.0, "output"), ("s5", "z", "s5-b", 300.0, 0.0, "input"), ("s5", "y", "s5-c", 100.0, 0.0, "input"), ("s5", "y", "s5-d", 100.0, 100.0, "input")]
    stubs = [("s1", "n00", 160.0, 160.0, 160.0, 200.0), ("s1", "n03", 500.0, 250.0, 490.0, 220.0)]
    return pins, stubs


def frames(spark, drawing, parts):
    pins, stubs = drawing
    p = spark.createDataFrame(pins, "sheet string, net_id string, id string, x double, y double, direction string").repartition(parts)
    s = spark.createDataFrame(stubs, "sheet string, net_id string, x double, y double, pin_x double, pin_y double").repartition(parts)
    return p, s


@pytest.mark.parametrize("parts", [1, 8])
def test_routes_like_one_after_the_other(spark, drawing, parts):
    p, s = frames(spark, drawing, parts)
    points, lines = wiring.standing(p, stubs=s)
    wires = wiring.routed(wiring.edges(wiring.net_pins(p)), points, lines)
    got = {(r.sheet, r.net_id, r.from_id, r.to_id): [tuple(q) for q in r.points] for r in wires.collect()}
    assert got == by_hand(*drawing)
    assert wires.where("NOT clear").count() < len(got) / 10
    # nothing but what lies at a wire's own end is touched by a clear wire
    bad = wiring.faults(wires.where("clear"), points)
    assert bad.where("kind = 'point'").count() == 0


def test_order_and_power(spark):
    rows = [(1, "VCC", "a", 0.0, 0.0, "power"), (1, "VCC", "b", 5.0, 0.0, "input"), (1, "x", "c", 0.0, 9.0, "output"), (1, "x", "d", 9.0, 9.0, "input"), (1, None, "e", 1.0, 1.0, "input"), (1, "GND", "f", 0.0, 1.0, "input"), (1, "GND", "g", 0.0, 2.0, "input"), (1, "GND", "h", 0.0, 3.0, "power")]
    pins = spark.createDataFrame(rows, "sheet int, net_id string, id string, x double, y double, direction string")
    power = spark.createDataFrame([("VCC",), ("GND",)], "net_id string")
    far = spark.createDataFrame([(1, "x", "z1", 50.0, 9.0, "output")], "sheet int, net_id string, id string, x double, y double, direction string")
    joined = wiring.net_pins(pins, far, power)
    assert sorted(r.id for r in joined.collect()) == ["c", "d", "f", "g", "z1"]
    order = [(r.ord, r.net_id, r.from_id, r.to_id) for r in wiring.edges(joined).orderBy("ord").collect()]
    assert order == [(1, "x", "c", "d"), (2, "x", "d", "z1"), (3, "GND", "f", "g")]


def test_labels_avoid_foreign_wires(spark):
    wires = [(1, 1, "a", None, [(0.0, 0.0), (100.0, 0.0)]), (1, 2, "b", "B", [(50.0, -50.0), (50.0, 50.0)]), (2, 1, "c", "", [(50.0, -50.0), (50.0, 50.0)]), (1, 3, "d", "D", [(3.0, 7.0)]), (1, 4, "e", "E", [(0.0, 30.0), (4.0, 30.0)])]
    w = spark.createDataFrame(wires, "sheet int, ord int, net_id string, name string, points array<struct<x:double,y:double>>")
    names = spark.createDataFrame([("a", "A"), ("a", None), ("c", "")], "net_id string, name string")
    got = {(r.sheet, r.ord): (r.name, r.x, r.y) for r in wiring.wire_labels(w, names).collect()}
    assert got == {(1, 1): ("A", 60.0, -8.0), (1, 2): ("B", 50.0, 2.0), (1, 4): ("E", 0.0, 22.0)}


def test_no_wires(spark):
    none = spark.createDataFrame([], "sheet int, net_id string, id string, x double, y double, direction string")
    points, lines = wiring.standing(none)
    assert wiring.routed(wiring.edges(wiring.net_pins(none)), points, lines).count() == 0
    one = spark.createDataFrame([(1, "a", "p", 0.0, 0.0, "input")], none.schema)
    assert wiring.edges(wiring.net_pins(one)).count() == 0


def test_kept_wires_stand(spark):
    pins = spark.createDataFrame([(1, "a", "p", 0.0, 0.0, "input"), (1, "a", "q", 100.0, 0.0, "input")], "sheet int, net_id string, id string, x double, y double, direction string")
    wall = spark.createDataFrame([(1, "b", [(50.0, 0.0), (50.0, 40.0)])], "sheet int, net_id string, points array<struct<x:double,y:double>>")
    points, lines = wiring.standing(pins, wires=wall)
    path = wiring.routed(wiring.edges(wiring.net_pins(pins)), points, lines).first()
    assert path.clear and [tuple(q) for q in path.points] == [(0.0, 0.0), (0.0, -10.0), (100.0, -10.0), (100.0, 0.0)]
    assert points.where(F.col("net_id") == "b").count() == 2


def test_small_sheets_are_routed_in_tasks(spark):
    """Rounds of jobs over all sheets took minutes for a few thousand of them."""
    k = "id % 20"
    pins = spark.range(40_000).selectExpr("id div 20 AS sheet", "concat('n', id * 7 % 11 % 6) AS net_id", "id", f"({k} div 10) * 250.0D AS x", f"{k} % 10 * 40.0D AS y", f"if({k} < 10, 'output', 'input') AS direction")
    points, lines = wiring.standing(pins)
    began = time.perf_counter()
    wires = wiring.routed(wiring.edges(wiring.net_pins(pins)), points, lines)
    n = pins.groupBy("sheet", "net_id").count().agg(F.sum(F.col("count") - 1)).head()[0]
    assert wires.count() == n and wiring.faults(wires.where("clear"), points).where("kind = 'point'").count() == 0
    assert time.perf_counter() - began < 90


def test_large_and_odd_sheets_go_by_joins(spark, monkeypatch):
    """A large sheet and one with a missing place by joins, a small one by tasks: all as one after the other."""
    rng = random.Random(5)
    pins, odd = crowded(rng, "a", 2, 3, 2) + crowded(rng, "b", 2, 2, 2), [("c", "n", f"c{i}", None if i == 2 else 50.0 * i, 10.0 * i, "input") for i in range(3)]
    df = spark.createDataFrame(pins + odd, "sheet string, net_id string, id string, x double, y double, direction string")
    points, lines = wiring.standing(df)
    by_joins = []
    joins = wiring._routed_by_joins
    monkeypatch.setattr(wiring, "_routed_by_joins", lambda *frames: by_joins.extend(r.sheet for r in frames[0].select("sheet").distinct().collect()) or joins(*frames))
    monkeypatch.setattr(wiring, "WHOLE", 14)
    wires = wiring.routed(wiring.edges(wiring.net_pins(df.where("x IS NOT NULL"))), points, lines)
    got = {(r.sheet, r.net_id, r.from_id, r.to_id): [tuple(q) for q in r.points] for r in wires.collect()}
    assert got == by_hand(pins + odd[:2], []) and sorted(by_joins) == ["a", "c"]


def test_ids_of_structs(spark):
    """Ids may be structs, whose missing fields come first."""
    pins = spark.sql("SELECT * FROM VALUES (1, 'n', named_struct('k', 1, 'name', 'b'), 0D, 0D, 'input'), (1, 'n', named_struct('k', 1, 'name', NULL), 9D, 0D, 'input'), (1, 'n', named_struct('k', 0, 'name', 'z'), 50D, 0D, 'input') AS t(sheet, net_id, id, x, y, direction)")
    got = [(tuple(r.from_id), tuple(r.to_id)) for r in wiring.edges(wiring.net_pins(pins)).orderBy("ord").collect()]
    assert got == [((1, None), (1, "b")), ((0, "z"), (1, None))]
