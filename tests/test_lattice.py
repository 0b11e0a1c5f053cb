"""Ways over lattices against plain Python."""

import heapq
import math
import random

import pytest

from tracewright.operators import lattice

AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]


def costs(lit, start, diagonal):
    """place -> (cost, parent), the parent of the least y, then x, among the best."""
    best, heap = {start: 0.0}, [(0.0, start)]
    count = {start: (0, 0)}
    while heap:
        c, p = heapq.heappop(heap)
        if c > best[p]:
            continue
        for dx, dy in AROUND:
            q = p[0] + dx, p[1] + dy
            s, d = count[p][0] + (not (dx and dy)), count[p][1] + bool(dx and dy)
            if q in lit and s + d * diagonal < best.get(q, math.inf):
                best[q], count[q] = s + d * diagonal, (s, d)
                heapq.heappush(heap, (best[q], q))
    step = lambda p, q: (count[p][0] + (p[0] == q[0] or p[1] == q[1])) + (count[p][1] + (p[0] != q[0] and p[1] != q[1])) * diagonal
    near = lambda q: [(q[0] + dx, q[1] + dy) for dx, dy in AROUND]
    return {q: (c, q if q == start else min((p for p in near(q) if p in best and step(p, q) == c), key=lambda p: (p[1], p[0]))) for q, c in best.items()}


def way(found, goal):
    out = [goal]
    while found[out[-1]][1] != out[-1]:
        out.append(found[out[-1]][1])
    return out[::-1]


def blot(rng, width, height, share):
    return {(x, y) for x in range(width) for y in range(height) if rng.random() < share}


@pytest.mark.parametrize("tile", [14, 256])
def test_distances_and_ways(spark, tile):
    rng = random.Random(4)
    boards = {"a": (blot(rng, 40, 30, 0.55), (5, 5)), "b": (blot(rng, 25, 25, 0.9), (-3, 12)), "c": (blot(rng, 30, 9, 0.3), (100, 100))}
    boards["b"][0].add((-2, 11))
    nodes = spark.createDataFrame([(k, *p) for k, (lit, _) in boards.items() for p in lit], "space string, x int, y int").repartition(3)
    seeds = spark.createDataFrame([(k, k, *s) for k, (_, s) in boards.items()] + [("a2", "a", 30, 20)], "search string, space string, x int, y int")
    tiles = lattice.distances(nodes, seeds, tile=tile)
    got = {(r.search, r.x, r.y): (r.straight + r.diagonal * math.sqrt(2), (r.px, r.py)) for r in lattice.reached(tiles).collect()}
    plain = {k: costs(lit | {s}, s, math.sqrt(2)) for k, (lit, s) in boards.items()}
    plain["a2"] = costs(boards["a"][0] | {(30, 20)}, (30, 20), math.sqrt(2))
    assert got == {(k, *p): v for k, found in plain.items() for p, v in found.items()}
    goals = [(k, n, *p) for k, found in plain.items() for n, p in enumerate(sorted(found)[:: max(1, len(found) // 6)])] + [("a", 99, 500, 500)]
    paths = lattice.ways(tiles, spark.createDataFrame(goals, "search string, goal int, x int, y int"), tile)
    assert {(r.search, r.goal): [(p.x, p.y) for p in r.points] for r in paths.collect()} == {(k, n): way(plain[k], (x, y)) for k, n, x, y in goals if n != 99}


def test_a_long_snake_takes_few_rounds(spark, monkeypatch):
    """Over 10,000 pixels of one line, folded: the way is as long as the snake, the rounds follow the tiles."""
    snake = [(x if row % 2 == 0 else 199 - x, 2 * row) for row in range(51) for x in range(200)]
    joints = {(199 if row % 2 == 0 else 0, 2 * row + 1) for row in range(50)}
    lit = spark.createDataFrame([("i", *p) for p in {*snake, *joints}], "img string, x int, y int")
    pairs = spark.createDataFrame([("i", 1, -2.4, 1.2, 203.0, 101.0), ("i", 2, 0.0, 0.0, 900.0, 900.0), ("j", 3, 0.0, 0.0, 1.0, 1.0)], "img string, id int, x1 double, y1 double, x2 double, y2 double")
    rounds = []
    plain = lattice.settled
    monkeypatch.setattr(lattice, "settled", lambda df: rounds.append(1) or plain(df))
    got = lattice.paths(pairs, lit, 5).collect()
    assert [(r.img, r.id) for r in got] == [("i", 1)] and len(rounds) < 40
    path = [(p.x, p.y) for p in got[0].points]
    found = costs({*snake, *joints}, (0, 0), math.sqrt(2))
    assert path == way(found, (199, 100)) and got[0].cost == found[199, 100][0] and len(path) > 9_900


def test_nearest_lit(spark):
    rng = random.Random(9)
    lit = blot(rng, 60, 60, 0.02)
    points = [("i", k, rng.uniform(-5, 65), rng.uniform(-5, 65)) for k in range(80)]
    df = spark.createDataFrame([("i", *p) for p in lit], "img string, x int, y int")
    got = {r.id: (r.near_x, r.near_y) for r in lattice.nearest_lit(spark.createDataFrame(points, "img string, id int, x double, y double"), df, 6).collect()}
    for _, k, x, y in points:
        cx, cy = (math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1) for v in (x, y))
        keys = []
        for px, py in lit:
            dx, dy = px - cx, py - cy
            ring, d = max(abs(dx), abs(dy)), dx * dx + dy * dy
            if ring <= 6 and d < 49:
                keys.append((ring, d, abs(dy) != ring, dx if abs(dy) == ring else dy, dy if abs(dy) == ring else dx, px, py))
        assert got[k] == (min(keys)[5:] if keys else (None, None))


def test_grown(spark):
    rng = random.Random(2)
    width, height, probe, step, share = 90, 60, 2, 3, 0.6
    lit = {(x, y) for x in range(width) for y in range(height) if (18 < y < 30 or 40 < x < 52) and rng.random() < 0.8}
    seeds = [("i", 1, 20.4, 24.0, 6.0), ("i", 2, 45.0, 50.0, 0.0), ("i", 3, 80.0, 5.0, 3.0), ("none", 4, 5.0, 5.0, 2.0)]
    ends = [("i", "t1", 46.0, 8.0, 4.0), ("i", "t2", 85.0, 24.0, 3.0), ("i", "t3", 70.0, 50.0, 5.0), ("i", "t4", 21.0, 24.0, 2.0)]
    places, walks = lattice.grown(
        spark.createDataFrame(seeds, "img string, id int, x double, y double, exclude double"), spark.createDataFrame([("i", *p) for p in lit], "img string, x int, y int"),
        spark.createDataFrame(ends, "img string, terminal string, x double, y double, radius double"), spark.createDataFrame([("i", width, height), ("none", 30, 30)], "img string, width int, height int"), probe, step, share, tile=8,
    )
    circle = [(dx, dy) for dx in range(-probe, probe + 1) for dy in range(-probe, probe + 1) if dx * dx + dy * dy <= probe**2]
    want_places, want_walks = set(), {}
    for img, k, cx, cy, out in seeds:
        w, h, pixels, own = (width, height, lit, ends) if img == "i" else (30, 30, set(), [])
        ox, oy = round(cx), round(cy)
        at = lambda i, j: (ox + i * step, oy + j * step)  # noqa: E731, B023
        room = {(i, j) for i in range(-40, 41) for j in range(-40, 41) if probe <= at(i, j)[0] < w - probe and probe <= at(i, j)[1] < h - probe}
        near = lambda p, x, y: (p[0] - x) ** 2 + (p[1] - y) ** 2
        free = {q for q in room if near(at(*q), cx, cy) < out**2 or any(near(at(*q), x, y) < r**2 for _, _, x, y, r in own) or sum((at(*q)[0] + dx, at(*q)[1] + dy) in pixels for dx, dy in circle) / len(circle) >= share}
        found = costs(free | {(0, 0)}, (0, 0), 1.0)
        want_places |= {(img, k, *at(*q), int(c)) for q, (c, _) in found.items()}
        for _, t, x, y, r in own:
            inside = [q for q in found if near(at(*q), x, y) <= r**2]
            if inside:
                goal = min(inside, key=lambda q: (found[q][0], q[1], q[0]))
                want_walks[img, k, t] = int(found[goal][0]), [at(*q) for q in way(found, goal)]
    assert {tuple(r) for r in places.collect()} == want_places
    assert {(r.img, r.id, r.terminal): (r.steps, [(p.x, p.y) for p in r.points]) for r in walks.collect()} == want_walks and len(want_walks) >= 4


def test_places_stay_in_their_tiles(spark, monkeypatch):
    """Rounds once took every tile's places out to see what improves; now only the result is taken out."""
    monkeypatch.setattr(lattice, "SLICE", 20)
    taken, kept = [], lattice.settled
    monkeypatch.setattr(lattice, "settled", lambda df: (taken.append("explode(places#" in df._jdf.queryExecution().analyzed().toString()), kept(df))[1])
    lit = {(x, y) for x in range(23) for y in range(19) if (x * 7 + y * 5) % 3}
    nodes = spark.createDataFrame([(s, x, y) for s in (1, 2) for x, y in sorted(lit)], "space int, x int, y int")
    seeds = spark.createDataFrame([(1, 1, 3, 4), (2, 2, 60, 60), (3, 2, 5, 5)], "search int, space int, x int, y int")
    steps = {}
    for search, start in ((1, (3, 4)), (2, (60, 60)), (3, (5, 5))):
        front, seen = [start], {start: 0}
        for x, y in front:
            for n in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if n in lit and n not in seen:
                    seen[n] = seen[x, y] + 1
                    front.append(n)
        steps |= {(search, *n): k for n, k in seen.items()}
    got = lattice.reached(lattice.distances(nodes, seeds, diagonal=1.0, tile=4)).collect()
    assert {(r.search, r.x, r.y): r.straight + r.diagonal for r in got} == steps and len(got) == len(steps)
    assert taken and not any(taken)
