"""Least-cost ways over the lit places of lattices: nearest places, distances with parents, paths, and seeded growth.

A search is any value that tells one search from another; it runs in a space of places, each next to its eight
neighbours. Places are gathered in tiles. A tile that gets better costs over its border is searched in one
task, and hands on to its neighbours what may improve beyond its border; so a round works on the tiles that the front has
reached, and rounds grow with the tiles that the longest best way passes through. A tile that nothing improves hands on
nothing; places are never taken out of their tiles to find that out.

Costs are counts of straight and diagonal steps, so equal costs are equal exactly. Of parents that give the same cost,
the one with the least y, then x, is taken; results do not depend on the size of tiles.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.loop import settled

#: Places along the side of a tile.
TILE = 256
#: Reached places that a task holds before it hands tiles on.
SLICE = 100_000
STEPS = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
_LEFT = "struct<tx:int,ty:int,x:int,y:int,straight:int,diagonal:int,px:int,py:int>"
_ARRAYS = ["xs", "ys", "straights", "diagonals", "pxs", "pys"]


def nearest_lit(points: DataFrame, lit: DataFrame, radius: int) -> DataFrame:
    """points(img, id, x, y) with near_x and near_y, null where nothing is lit: the lit pixel (img, x, y) on the nearest
    square around the rounded point, on that the nearest one, then along its level sides before its upright ones.

    An equi-join on cells as wide as the radius.
    """
    cx, cy = F.round("x").cast("int"), F.round("y").cast("int")
    cell = lambda v: F.floor(v / F.lit(radius + 1))
    around = lambda v: F.explode(F.sequence(cell(v) - 1, cell(v) + 1))
    p = points.select("img", "id", cx.alias("cx"), cy.alias("cy")).withColumn("tx", around(F.col("cx"))).withColumn("ty", around(F.col("cy")))
    q = lit.select("img", F.col("x").alias("near_x"), F.col("y").alias("near_y"), cell(F.col("x")).alias("tx"), cell(F.col("y")).alias("ty"))
    dx, dy = F.col("near_x") - F.col("cx"), F.col("near_y") - F.col("cy")
    ring, d = F.greatest(F.abs(dx), F.abs(dy)), dx * dx + dy * dy
    level = F.abs(dy) == ring
    key = F.struct(ring.alias("ring"), d.alias("d"), (~level).alias("upright"), F.when(level, dx).otherwise(dy).alias("major"), F.when(level, dy).otherwise(dx).alias("minor"), "near_x", "near_y")
    best = p.join(q, ["img", "tx", "ty"]).where((ring <= radius) & (d < (radius + 1) ** 2)).groupBy("img", "id").agg(F.min(key).alias("k"))
    return points.join(best, ["img", "id"], "left").select(*points.columns, F.col("k.near_x").alias("near_x"), F.col("k.near_y").alias("near_y"))


def _search(places: dict, known: dict, arrivals: list, weight: float, tile: tuple[int, int], size: int) -> list:
    """Spreads arrivals over a tile's places; known is place -> (cost, straight, diagonal, py, px). What improves beyond
    the border is returned, the best of each place."""
    heap = []

    def offer(x: int, y: int, s: int, d: int, px: int, py: int) -> None:
        if (x, y) not in places and (s or d):
            return
        cost, old = s + d * weight, known.get((x, y))
        if old is None or cost < old[0]:
            known[x, y] = (cost, s, d, py, px)
            heapq.heappush(heap, (cost, y, x))
        elif cost == old[0] and (py, px) < old[3:]:
            known[x, y] = (*old[:3], py, px)

    for a in arrivals:
        offer(a["x"], a["y"], a["straight"], a["diagonal"], a["px"], a["py"])
    beyond: dict = {}
    low_x, low_y = tile[0] * size, tile[1] * size
    while heap:
        cost, y, x = heapq.heappop(heap)
        _, s, d, _, _ = known[x, y]
        if cost > known[x, y][0]:
            continue
        for dx, dy in STEPS:
            n, s2, d2 = (x + dx, y + dy), s + (not (dx and dy)), d + bool(dx and dy)
            if low_x <= n[0] < low_x + size and low_y <= n[1] < low_y + size:
                offer(*n, s2, d2, x, y)
            else:
                new = (s2 + d2 * weight, y, x, s2, d2)
                if n not in beyond or new < beyond[n]:
                    beyond[n] = new
    return [{"tx": x // size, "ty": y // size, "x": x, "y": y, "straight": s, "diagonal": d, "px": px, "py": py} for (x, y), (_, py, px, s, d) in beyond.items()]


def distances(nodes: DataFrame, seeds: DataFrame, diagonal: float = math.sqrt(2), tile: int = TILE) -> DataFrame:
    """Tiles (search, tx, ty, xs, ys, straights, diagonals, pxs, pys) of the places that seeds reach.

    nodes(space, x, y) are the places, seeds(search, space, x, y) where searches of a space begin. Places are held once
    a space, however many searches it has. Seeds are places whether lit or not; a seed is its own parent. See reached()
    for rows.
    """
    at = lambda v: F.floor(F.col(v) / tile).cast("int")
    whole = nodes.select("space", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    tiles = settled(whole.groupBy("space", at("x").alias("tx"), at("y").alias("ty")).agg(F.collect_list(F.struct("x", "y")).alias("places")))
    start = settled(seeds.select("search", "space", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct())
    zero = F.lit(0)
    arrivals = start.select("search", "space", at("x").alias("tx"), at("y").alias("ty"), F.struct("x", "y", zero.alias("straight"), zero.alias("diagonal"), F.col("x").alias("px"), F.col("y").alias("py")).alias("a"))
    spaces = start.select("search", "space").distinct()
    kind = seeds.schema["search"].dataType.simpleString()
    key = ["search", "tx", "ty"]
    lists = ", ".join(f"{c} array<int>" for c in _ARRAYS)
    schema = f"search {kind}, tx int, ty int, {lists}, beyond array<{_LEFT}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = pa.struct([(n, pa.int32()) for n in ("tx", "ty", "x", "y", "straight", "diagonal", "px", "py")])
        for batch in batches:
            first, held, done = 0, 0, []
            for i in range(batch.num_rows):
                at = batch.column("places").slice(i, 1).flatten()
                places = set(zip(at.field("x").to_pylist(), at.field("y").to_pylist(), strict=True))
                row = {c: batch.column(c)[i].as_py() for c in ("tx", "ty", "arrivals", *_ARRAYS)}
                known = {}
                if row["xs"] is not None:
                    known = {(x, y): (s + d * diagonal, s, d, py, px) for x, y, s, d, px, py in zip(*(row[c] for c in _ARRAYS), strict=True)}
                out = _search(places, known, row["arrivals"], diagonal, (row["tx"], row["ty"]), tile)
                items = [(x, y, s, d, px, py) for (x, y), (_, s, d, py, px) in known.items()]
                done.append([*([t[k] for t in items] for k in range(6)), out])
                held += len(items)
                if held < SLICE and i + 1 < batch.num_rows:
                    continue
                part = batch.slice(first, i + 1 - first)
                columns = [pa.array([t[k] for t in done], pa.list_(pa.int32() if k < 6 else left)) for k in range(7)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), *columns], names=[*key, *_ARRAYS, "beyond"])
                first, held, done = i + 1, 0, []

    found: DataFrame | None = None
    while True:
        active = arrivals.groupBy(*key, "space").agg(F.collect_list("a").alias("arrivals"))
        # seeds may lie where nothing is lit; later on there is nothing to do there
        active = active.join(tiles, ["space", "tx", "ty"], "left" if found is None else "inner")
        before = active.withColumns({c: F.lit(None).cast("array<int>") for c in _ARRAYS}) if found is None else active.join(found, key, "left")
        ran = settled(before.select(*key, "places", "arrivals", *_ARRAYS).mapInArrow(run, schema))
        plain = ran.where(F.size("xs") > 0).select(*key, *_ARRAYS)
        found = settled(plain if found is None else found.join(plain.select(key), key, "left_anti").unionByName(plain))
        sent = ran.select("search", F.explode("beyond").alias("a")).join(spaces, "search")
        arrivals = sent.select("search", "space", "a.tx", "a.ty", F.struct(*(F.col(f"a.{c}").alias(c) for c in ("x", "y", "straight", "diagonal", "px", "py"))).alias("a"))
        if arrivals.isEmpty():
            return found


def reached(tiles: DataFrame) -> DataFrame:
    """(search, x, y, straight, diagonal, px, py) of what distances() returns."""
    names = ["x", "y", "straight", "diagonal", "px", "py"]
    zipped = F.arrays_zip(*(F.col(c).alias(n) for c, n in zip(_ARRAYS, names, strict=True)))
    each = tiles.select("search", F.explode(zipped).alias("r"))
    return each.select("search", *(F.col("r")[n].alias(n) for n in names))


def ways(tiles: DataFrame, goals: DataFrame, tile: int = TILE) -> DataFrame:
    """(search, goal, points) for goals (search, goal, x, y): the way from the seed, both ends included.

    A goal that was not reached has no row. Each round follows parents through one tile of each way.
    """
    key = ["search", "tx", "ty"]
    at = lambda v: F.floor(F.col(v) / tile).cast("int")
    kinds = {c: goals.schema[c].dataType.simpleString() for c in ("search", "goal")}
    now = goals.select("search", "goal", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.lit(0).alias("turn"))
    point = pa.struct([("x", pa.int32()), ("y", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {c: one.column(c)[0].as_py() for c in (*_ARRAYS[:2], "pxs", "pys", "walks")}
                parent = {(x, y): (px, py) for x, y, px, py in zip(row["xs"], row["ys"], row["pxs"], row["pys"], strict=True)}
                for n, w in enumerate(row["walks"]):
                    p, path = (w["x"], w["y"]), []
                    if p not in parent:
                        continue
                    while p in parent:
                        path.append({"x": p[0], "y": p[1]})
                        if parent[p] == p:
                            break
                        p = parent[p]
                    done = parent.get(p) == p
                    goal = one.column("walks").flatten().field("goal").slice(n, 1)
                    yield pa.RecordBatch.from_arrays([one.column("search"), goal, pa.array([w["turn"]], pa.int32()), pa.array([path[::-1]], pa.list_(point)), pa.array([None if done else p[0]], pa.int32()), pa.array([None if done else p[1]], pa.int32())], names=["search", "goal", "turn", "part", "x", "y"])

    parts: DataFrame | None = None
    while True:
        grouped = now.withColumns({"tx": at("x"), "ty": at("y")}).groupBy(*key).agg(F.collect_list(F.struct("goal", "x", "y", "turn")).alias("walks"))
        ran = settled(grouped.join(tiles, key).select("search", "walks", *_ARRAYS).mapInArrow(run, f"search {kinds['search']}, goal {kinds['goal']}, turn int, part array<struct<x:int,y:int>>, x int, y int"))
        new = ran.select("search", "goal", "turn", "part")
        parts = new if parts is None else parts.unionByName(new)
        now = ran.where("x IS NOT NULL").select("search", "goal", "x", "y", (F.col("turn") + 1).alias("turn"))
        if now.isEmpty():
            return parts.groupBy("search", "goal").agg(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("k"), "part"))).alias("parts")).select("search", "goal", F.flatten(F.col("parts.part")).alias("points"))


def paths(pairs: DataFrame, lit: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(img, id, cost, points) for pairs (img, id, x1, y1, x2, y2): the cheapest way over lit pixels (img, x, y) between
    the lit pixels nearest to both ends; a pair without such pixels or such a way has no row. A diagonal step costs the
    root of two. Pairs of one image are searches of their own."""
    ends = pairs.select("img", F.struct("id", F.lit(1).alias("end")).alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(pairs.select("img", F.struct("id", F.lit(2).alias("end")).alias("id"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    near = settled(nearest_lit(ends, lit, radius).where("near_x IS NOT NULL").select("img", "id.id", "id.end", F.col("near_x").alias("x"), F.col("near_y").alias("y")))
    both = near.groupBy("img", "id").agg(F.count("*").alias("n")).where("n = 2").select("img", "id")
    near = near.join(both, ["img", "id"], "left_semi").withColumn("search", F.struct("img", "id")).withColumn("space", F.col("img"))
    tiles = settled(distances(lit.withColumn("space", F.col("img")), near.where("end = 1"), tile=tile))
    goals = near.where("end = 2").select("search", F.lit(0).alias("goal"), "x", "y")
    cost = reached(tiles).join(goals, ["search", "x", "y"]).select("search", (F.col("straight") + F.col("diagonal") * math.sqrt(2)).alias("cost"))
    found = ways(tiles, goals, tile).join(cost, "search")
    return found.select("search.img", "search.id", "cost", "points")


def _disc(x: Column, y: Column, radius: Column, ox: Column, oy: Column, step: int) -> Column:
    """Lattice places (i, j), from (ox, oy) in steps, in the box around a disc."""
    span = lambda c, o: F.sequence(F.floor((c - radius - o) / step), F.ceil((c + radius - o) / step))
    return F.flatten(F.transform(span(x, ox), lambda i: F.transform(span(y, oy), lambda j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")))))


def grown(seeds: DataFrame, bright: DataFrame, terminals: DataFrame, sizes: DataFrame, probe: int, step: int, share: float, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Copper that can be walked from seeds (img, id, x, y, exclude): places (img, id, x, y, steps), and walks (img, id,
    terminal, steps, points) to terminals (img, terminal, x, y, radius).

    Places lie on a lattice of step pixels from the rounded seed and are entered in eight directions where at least a
    share of the pixels in a circle of probe pixels is bright (img, x, y); anywhere nearer than exclude to the seed, and
    inside terminals; never nearer to the image's edge than probe (sizes: img, width, height). A terminal's walk leads
    to the place of the fewest steps in it, of equal ones to that of the least y, then x.
    """
    s = settled(seeds.join(sizes, "img").select(F.struct("img", "id").alias("search"), "img", F.col("x").alias("cx"), F.col("y").alias("cy"), F.round("x").cast("int").alias("ox"), F.round("y").cast("int").alias("oy"), F.col("exclude").cast("double").alias("exclude"), "width", "height"))
    circle = [(dx, dy) for dx in range(-probe, probe + 1) for dy in range(-probe, probe + 1) if dx * dx + dy * dy <= probe * probe]
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in circle))
    met = bright.select("img", "x", "y").distinct().join(s, "img")
    hits = F.filter(offsets, lambda o: (F.pmod(F.col("x") + o["dx"] - F.col("ox"), F.lit(step)) == 0) & (F.pmod(F.col("y") + o["dy"] - F.col("oy"), F.lit(step)) == 0))
    seen = met.select("search", "x", "y", "ox", "oy", F.explode(hits).alias("o")).select("search", ((F.col("x") + F.col("o.dx") - F.col("ox")) / step).cast("int").alias("i"), ((F.col("y") + F.col("o.dy") - F.col("oy")) / step).cast("int").alias("j"))
    copper = seen.groupBy("search", "i", "j").agg(F.count("*").alias("n")).where(F.col("n") / float(len(circle)) >= share).select("search", "i", "j")
    if share <= 0:
        raise ValueError("a share of more than 0 is needed")
    ended = s.join(terminals.select("img", "terminal", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("radius").cast("double").alias("radius")), "img")
    place = lambda df, x, y, r: df.select("*", F.explode(_disc(F.col(x), F.col(y), F.col(r), F.col("ox"), F.col("oy"), step)).alias("p")).withColumns({"i": F.col("p.i"), "j": F.col("p.j")})
    px, py = F.col("ox") + F.col("i") * step, F.col("oy") + F.col("j") * step
    far = lambda x, y: (px - F.col(x)) ** 2 + (py - F.col(y)) ** 2
    near_seed = place(s, "cx", "cy", "exclude").where(far("cx", "cy") < F.col("exclude") ** 2).select("search", "i", "j")
    in_terminal = settled(place(ended, "tx", "ty", "radius").where(far("tx", "ty") <= F.col("radius") ** 2).select("search", "terminal", "i", "j", (far("tx", "ty") < F.col("radius") ** 2).alias("inner")))
    open_ = copper.unionByName(near_seed).unionByName(in_terminal.where("inner").select("search", "i", "j")).distinct()
    inside = px.between(probe, F.col("width") - probe - 1) & py.between(probe, F.col("height") - probe - 1)
    nodes = open_.join(s, "search").where(inside).select("search", F.col("i").alias("x"), F.col("j").alias("y"))
    tiles = settled(distances(nodes.withColumnRenamed("search", "space"), s.select("search", F.col("search").alias("space"), F.lit(0).alias("x"), F.lit(0).alias("y")), diagonal=1.0, tile=tile))
    steps = F.col("straight") + F.col("diagonal")
    got = reached(tiles).select("search", F.col("x").alias("i"), F.col("y").alias("j"), steps.alias("steps"))
    places = got.join(s, "search").select("search.img", "search.id", px.alias("x"), py.alias("y"), "steps")
    first = W.partitionBy("search", "terminal").orderBy("steps", "j", "i")
    arrived = got.join(in_terminal, ["search", "i", "j"]).withColumn("turn", F.row_number().over(first)).where("turn = 1")
    walks = ways(tiles, arrived.select("search", F.col("terminal").alias("goal"), F.col("i").alias("x"), F.col("j").alias("y")), tile)
    walks = walks.join(arrived.select("search", F.col("terminal").alias("goal"), "steps"), ["search", "goal"]).join(s.select("search", "ox", "oy"), "search")
    points = F.transform("points", lambda p: F.struct((F.col("ox") + p["x"] * step).cast("double").alias("x"), (F.col("oy") + p["y"] * step).cast("double").alias("y")))
    return places, walks.select("search.img", "search.id", F.col("goal").alias("terminal"), "steps", points.alias("points"))
