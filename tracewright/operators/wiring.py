"""Wires of schematic sheets, routed without touching what belongs to other nets.

Sheets are independent; a sheet is any value that tells it from all others. On a sheet edges have an order: nets with
more pins first, then by id, and in a net by the length of its tree's edges. An edge takes the cheapest path that no
pin, sheet connector or power stub blocks, and no wire of an edge before it.

Sheets of up to WHOLE rows are dealt over all tasks, which lay a sheet's wires one after the other. Of larger sheets all
edges choose at once, seen against the wires that the last round laid for the edges before them, until no path
changes. Then each edge has chosen against the final wires of those before it, as if they had been laid one by one;
the first edge of a sheet is right after one round, and a round reads only edges behind one that has just changed.
Which obstacles a path meets is an equi-join on the line that a segment lies on. Both give the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.geometry import point, snapped
from tracewright.functions.routing import ALONG, BEND, EPSILON, NARROW, TRUNKS, WIDE, channels, direct_paths, escapes, manhattan, on_segment, run_together, segment, tidy
from tracewright.operators import routes
from tracewright.operators.layout import whole
from tracewright.operators.loop import settled, spread

#: Width of a line's bucket; segments within EPSILON of its border belong to two.
BUCKET = 4.0
#: A net's pins on one sheet, at most: its tree is made in one task, in time that grows with their square.
SHEET_PINS = 20_000
#: Nets of up to so many pins have their edges sorted.
FEW = 16
#: Rows of a sheet (edges and what stands) up to which a task lays its wires, in time that grows with their square.
WHOLE = 5_000
Edge = ["sheet", "ord"]


def net_pins(pins: DataFrame, connectors: DataFrame | None = None, power_nets: DataFrame | None = None) -> DataFrame:
    """(sheet, net_id, id, x, y, direction): what each net joins on a sheet.

    pins(sheet, net_id, id, x, y, direction) without a net join nothing. Of power_nets (net_id) only pins that do not
    supply power count, and only where a sheet has two of them. connectors(sheet, net_id, id, x, y, direction) lead to
    other sheets; their ids must differ from those of pins, in an order that ids also have.
    """
    columns = ["sheet", "net_id", "id", "x", "y", "direction"]
    named = pins.where(F.col("net_id").isNotNull() & (F.col("net_id").cast("string") != "")).select(columns)
    if power_nets is not None:
        power = power_nets.select("net_id").distinct().withColumn("is_power", F.lit(True))
        seen = named.join(power, "net_id", "left").where("is_power IS NULL OR direction <> 'power'")
        n = F.count("*").over(W.partitionBy("sheet", "net_id"))
        named = seen.withColumn("n", n).where("is_power IS NULL OR n >= 2").select(columns)
    return named if connectors is None else named.unionByName(connectors.select(columns))


def _tree(x: list[float], y: list[float]) -> list[tuple[float, int, int]]:
    """The spanning tree of the least edges by (Manhattan length, first place, second place), in this order."""
    n = len(x)
    if n <= FEW:
        top = list(range(n))
        edges = []
        for length, i, j in sorted((abs(x[i] - x[j]) + abs(y[i] - y[j]), i, j) for j in range(n) for i in range(j)):
            a, b = top[i], top[j]
            if a != b:
                top = [a if t == b else t for t in top]
                edges.append((length, i, j))
        return edges
    xs, ys = np.array(x), np.array(y)
    outside = np.ones(n, bool)
    length, near = np.full(n, np.inf), np.zeros(n, np.int64)
    at, edges, numbers = 0, [], np.arange(n)
    for _ in range(n - 1):
        outside[at] = False
        d = np.abs(xs - xs[at]) + np.abs(ys - ys[at])
        low, high = np.minimum(numbers, at), np.maximum(numbers, at)
        old_low, old_high = np.minimum(numbers, near), np.maximum(numbers, near)
        better = (d < length) | ((d == length) & ((low < old_low) | ((low == old_low) & (high < old_high))))
        length, near = np.where(better, d, length), np.where(better, at, near)
        rest = np.flatnonzero(outside & (length == length[outside].min()))
        at = int(rest[np.lexsort((np.maximum(rest, near[rest]), np.minimum(rest, near[rest])))[0]])
        edges.append((float(length[at]), int(min(at, near[at])), int(max(at, near[at]))))
    return sorted(edges)


def _in_order(v: object) -> object:
    """A key that orders values as Spark does, nulls first, also those of structs."""
    parts = v.values() if isinstance(v, dict) else v if isinstance(v, tuple) else None
    return v if parts is None else tuple((p is not None, _in_order(p)) for p in parts)


def _sheet_trees(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges of all nets of a sheet, numbered."""
    nets: dict = {}
    for net, *pin in zip(*(pdf[c].tolist() for c in ("net_id", "id", "x", "y", "direction"))):
        nets.setdefault(net, []).append(pin)
    rows, sheet = [], pdf["sheet"].iloc[0]
    for net, pins in sorted(nets.items(), key=lambda n: (-len(n[1]), n[0])):
        if len(pins) > SHEET_PINS:
            raise ValueError(f"a net has {len(pins)} pins on one sheet, more than {SHEET_PINS}")
        pins.sort(key=lambda p: (_in_order(p[0]), *p[1:3]))
        ids, x, y, ways = zip(*pins)
        for _, i, j in _tree(x, y):
            rows.append((sheet, net, ids[i], ids[j], x[i], y[i], x[j], y[j], ways[i], ways[j], len(rows) + 1))
    return pd.DataFrame(rows, columns=["sheet", "net_id", "from_id", "to_id", "ax", "ay", "bx", "by", "from_direction", "to_direction", "ord"])


def edges(joined: DataFrame) -> DataFrame:
    """(sheet, ord, net_id, from_id, to_id, a, b, from_direction, to_direction): what is to be routed, in its order.

    joined are net_pins; each net's tree joins its pins by Manhattan distance, ties by the ids. A sheet's pins are one
    group of a shuffle, as there are too many nets of a few pins to have a group each.
    """
    kinds = dict(joined.dtypes)
    schema = f"sheet {kinds['sheet']}, net_id {kinds['net_id']}, from_id {kinds['id']}, to_id {kinds['id']}, ax double, ay double, bx double, by double, from_direction string, to_direction string, ord int"
    pins = joined.select("sheet", "net_id", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "direction")
    rows = spread(pins, "sheet").groupBy("sheet").applyInPandas(_sheet_trees, schema)
    return rows.select("sheet", "net_id", "from_id", "to_id", point(F.col("ax"), F.col("ay")).alias("a"), point(F.col("bx"), F.col("by")).alias("b"), "from_direction", "to_direction", "ord")


def standing(pins: DataFrame, connectors: DataFrame | None = None, stubs: DataFrame | None = None, wires: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Points (sheet, net_id, p) and segments (sheet, net_id, s) that wires must not touch before any is laid.

    pins and connectors (sheet, net_id, x, y); a pin without a net is foreign to all. stubs(sheet, net_id, x, y, pin_x,
    pin_y) lead from power ports to their pins. wires(sheet, net_id, points) stay as they are.
    """
    tip = lambda df: df.select("sheet", F.col("net_id").cast("string").alias("net_id"), point(F.col("x"), F.col("y")).alias("p"))
    points = tip(pins)
    lines = pins.select("sheet", F.col("net_id").cast("string").alias("net_id"), segment(point(F.col("x"), F.col("y")), point(F.col("x"), F.col("y"))).alias("s")).where(F.lit(False))
    if connectors is not None:
        points = points.unionByName(tip(connectors))
    if stubs is not None:
        points = points.unionByName(tip(stubs))
        ends = segment(point(F.col("x"), F.col("y")), point(F.col("pin_x"), F.col("pin_y")))
        lines = lines.unionByName(stubs.select("sheet", F.col("net_id").cast("string").alias("net_id"), ends.alias("s")))
    if wires is not None:
        laid = wires.select("sheet", F.col("net_id").cast("string").alias("net_id"), F.col("points").alias("path"))
        points = points.unionByName(laid.select("sheet", "net_id", F.explode("path").alias("p")))
        lines = lines.unionByName(_segments(laid, "sheet", "net_id").drop("k"))
    return points, lines


def _segments(paths: DataFrame, *keep: str) -> DataFrame:
    """The segments (k, s) of paths, with columns to keep."""
    k = paths.where(F.size("path") > 1).select(*keep, "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    return k.select(*keep, "k", segment(F.get("path", F.col("k") - 1), F.get("path", F.col("k"))).alias("s"))


def _lines_of(s: Column) -> Column:
    """The lines (upright, bucket) that a segment's points may be on."""
    upright = F.abs(s["x1"] - s["x2"]) < EPSILON
    at = F.when(upright, s["x1"]).otherwise(s["y1"])
    line = lambda v: F.struct(upright.alias("upright"), F.floor(v / BUCKET).alias("bucket"))
    return F.array_distinct(F.array(line(at - EPSILON), line(at + EPSILON)))


def _lines_at(p: Column) -> Column:
    """The two lines that a point is on."""
    line = lambda upright, v: F.struct(F.lit(upright).alias("upright"), F.floor(v / BUCKET).alias("bucket"))
    return F.array(line(True, p["x"]), line(False, p["y"]))


def _same(p: Column, q: Column) -> Column:
    return (F.abs(p["x"] - q["x"]) < EPSILON) & (F.abs(p["y"] - q["y"]) < EPSILON)


def _foreign() -> Column:
    """Whether an obstacle (o_net, o_ord) stands in the way of an edge (net_id, ord)."""
    other = F.col("o_net").isNull() | (F.col("o_net") == "") | (F.col("o_net") != F.col("net_id").cast("string"))
    return other & (F.col("o_ord") < F.col("ord"))


def _unblocked(paths: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    """Paths (sheet, ord, net_id, k, a, b, path) that touch nothing foreign but at their edge's ends a and b."""
    key = ["sheet", "ord", "k"]
    at = points.select("sheet", F.col("net_id").alias("o_net"), F.col("ord").alias("o_ord"), "p", F.explode(_lines_at(F.col("p"))).alias("line"))
    on = lines.select("sheet", F.col("net_id").alias("o_net"), F.col("ord").alias("o_ord"), F.col("s").alias("o"), F.explode(_lines_of(F.col("s"))).alias("line"))
    parts = paths.select("sheet", "ord", "net_id", "k", "a", "b", "path")
    k = parts.select(*key, "net_id", "a", "b", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i"))
    each = k.select(*key, "net_id", "a", "b", segment(F.get("path", F.col("i") - 1), F.get("path", F.col("i"))).alias("s"))
    met = each.withColumn("line", F.explode(_lines_of(F.col("s")))).join(at.hint("merge"), ["sheet", "line"])
    met = met.where(_foreign() & on_segment(F.col("p"), F.col("s")) & ~_same(F.col("p"), F.col("a")) & ~_same(F.col("p"), F.col("b"))).select(key)
    turns = parts.select(*key, "net_id", "a", "b", F.explode("path").alias("p")).where(~_same(F.col("p"), F.col("a")) & ~_same(F.col("p"), F.col("b")))
    run = turns.withColumn("line", F.explode(_lines_at(F.col("p")))).join(on.hint("merge"), ["sheet", "line"]).where(_foreign() & on_segment(F.col("p"), F.col("o"))).select(key)
    return paths.join(met.unionByName(run).distinct().hint("merge"), key, "left_anti")


def _cheapest(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """(sheet, ord, path): each edge's path of the least price; the first of equal ones."""
    own = lines.select("sheet", F.col("net_id").alias("o_net"), F.col("ord").alias("o_ord"), F.col("s").alias("o"), F.explode(_lines_of(F.col("s"))).alias("line"))
    s = _segments(paths.withColumnRenamed("k", "rank"), "sheet", "ord", "net_id", "rank")
    doubled = s.withColumn("line", F.explode(_lines_of(F.col("s")))).join(own.hint("merge"), ["sheet", "line"])
    doubled = doubled.where((F.col("o_net") == F.col("net_id").cast("string")) & (F.col("o_ord") < F.col("ord")) & run_together(F.col("s"), F.col("o")))
    doubled = doubled.groupBy("sheet", "ord", F.col("rank").alias("k")).agg(F.countDistinct("k").alias("doubled"))
    length = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.abs(F.get("path", i)["x"] - F.get("path", i - 1)["x"]) + F.abs(F.get("path", i)["y"] - F.get("path", i - 1)["y"])), F.lit(0.0), lambda t, v: t + v)
    price = length + BEND * (F.size("path") - 2) + ALONG * F.coalesce("doubled", F.lit(0))
    return paths.join(doubled.hint("merge"), ["sheet", "ord", "k"], "left").groupBy("sheet", "ord").agg(F.min(F.struct(price.alias("price"), "k", "path")).alias("best")).select("sheet", "ord", F.col("best.path").alias("path"))


def _tried(todo: DataFrame, reach: tuple[float, float, float]) -> DataFrame:
    """The candidates (k, path) of edges, kept, as several joins read them."""
    return settled(todo.select("sheet", "ord", "net_id", "a", "b", F.posexplode(direct_paths(F.col("a"), F.col("b"), reach)).alias("k", "path")))


def _direct(tried: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    return _cheapest(settled(_unblocked(tried, points, lines)), lines)


def _escaping(todo: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    """(sheet, ord, path): the first clear path that leaves both pins sideways and joins them by a level trunk.

    The two halves, up to the trunk, are tried apart; only clear halves are joined.
    """
    trunks = todo.select("sheet", "ord", "net_id", "a", "b", "from_direction", "to_direction", F.posexplode(channels(F.col("a.y"), F.col("b.y"), *TRUNKS)).alias("m", "level"))

    def half(pin: str, direction: str) -> DataFrame:
        side = trunks.select("sheet", "ord", "net_id", "a", "b", "m", "level", F.posexplode(escapes(F.col(direction))).alias("e", "off"))
        x = snapped(F.col(f"{pin}.x") + F.col("off"))
        path = tidy(F.array(F.col(pin), point(x, F.col(f"{pin}.y")), point(x, F.col("level"))))
        tried = side.withColumn("path", path).withColumn("k", F.col("m") * 100 + F.col("e")).where(F.size("path") > 1)
        return _unblocked(settled(tried.select("sheet", "ord", "net_id", "a", "b", "m", "e", "k", "path")), points, lines)

    left = half("a", "from_direction").select("sheet", "ord", "net_id", "a", "b", "m", F.col("e").alias("ea"), F.col("path").alias("pa"))
    right = half("b", "to_direction").select("sheet", "ord", "m", F.col("e").alias("eb"), F.reverse("path").alias("pb"))
    both = left.join(right.hint("merge"), ["sheet", "ord", "m"]).withColumn("path", tidy(F.concat("pa", "pb"))).withColumn("k", (F.col("m") * 100 + F.col("ea")) * 100 + F.col("eb"))
    return _unblocked(settled(both), points, lines).groupBy("sheet", "ord").agg(F.min(F.struct("k", "path")).alias("best")).select("sheet", "ord", F.col("best.path").alias("path"))


def routed(todo: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    """(sheet, ord, net_id, from_id, to_id, points, clear) of edges, see edges(), among what stands, see standing().

    clear says whether the path touches nothing foreign; an edge without such a path gets the plain one.
    """
    todo = settled(todo)
    parts = [(todo, "least(a.x, a.y, b.x, b.y)", "greatest(a.x, a.y, b.x, b.y)", "a.x + a.y + b.x + b.y"), (points, "least(p.x, p.y)", "greatest(p.x, p.y)", "p.x + p.y"), (lines, "least(s.x1, s.y1, s.x2, s.y2)", "greatest(s.x1, s.y1, s.x2, s.y2)", "s.x1 + s.y1 + s.x2 + s.y2")]
    # missing and endless places compare otherwise in tasks
    odd = lambda least, most, total: F.expr(f"coalesce(isnan({total}) OR {least} = double('-infinity') OR {most} = double('infinity') OR {total} IS NULL, true)")
    every = reduce(DataFrame.unionAll, (df.select("sheet", odd(*at).alias("odd")) for df, *at in parts))
    n = every.where("sheet IS NOT NULL").groupBy("sheet").agg(F.count("*").alias("n"), F.max("odd").alias("odd"))
    large = settled(n.where((F.col("n") > WHOLE) | F.col("odd")).select("sheet"))
    if large.isEmpty():
        return settled(_routed_in_tasks(todo, points, lines))
    small, rest = ([df.join(large.hint("merge"), "sheet", how) for df in (todo, points, lines)] for how in ("left_anti", "left_semi"))
    return settled(_routed_in_tasks(*small)).unionByName(_routed_by_joins(settled(rest[0]), *rest[1:]))


def _routed_in_tasks(todo: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    """routed() of sheets that fit a task."""
    kept = ["sheet", "ord", "net_id", "from_id", "to_id"]
    ends = ["x1", "y1", "x2", "y2"]
    flags = ["out_a", "out_b", "in_b"]
    empty = [F.lit(None).cast(todo.schema[c].dataType).alias(c) for c in kept[2:]]
    no = [F.lit(False).alias(c) for c in flags]
    is_ = lambda c, way: F.coalesce(F.col(c) == way, F.lit(False))
    own = todo.select(*kept, F.lit(0).alias("kind"), F.col("net_id").cast("string").alias("net"), *(F.col(c) for c in ("a.x", "a.y", "b.x", "b.y")), is_("from_direction", "output"), is_("to_direction", "output"), is_("to_direction", "input"))
    tips = points.select("sheet", F.lit(0), *empty, F.lit(1), F.col("net_id").cast("string"), "p.x", "p.y", "p.x", "p.y", *no)
    legs = lines.select("sheet", F.lit(0), *empty, F.lit(2), F.col("net_id").cast("string"), *(f"s.{c}" for c in ends), *no)
    every = own.unionAll(tips).unionAll(legs).toDF(*kept, "kind", "net", *ends, *flags).where("sheet IS NOT NULL")
    w = W.partitionBy("sheet")
    every = spread(every, "sheet").withColumn("number", F.when(F.coalesce("net", F.lit("")) != "", F.dense_rank().over(w.orderBy("net"))).otherwise(0))
    # the last order is that of the rows in a task: a sheet's edges as they are laid, then what stands
    every = every.withColumn("begins", F.row_number().over(w.orderBy("kind", "ord")) == 1).drop("net")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            get = {c: table[c].to_numpy() for c in ("kind", "begins", *ends, *flags)} | {"net": table["number"].to_numpy().astype(np.int64)}
            first = np.flatnonzero(get["begins"])
            paths = []
            for low, high in zip(first, [*first[1:], table.num_rows]):
                edge, tip, leg = (low + np.flatnonzero(get["kind"][low:high] == k) for k in range(3))
                places = lambda at, names: (get["net"][at], np.array([get[c][at] for c in names]))  # noqa: B023, E731
                paths += routes.laid({c: get[c][edge] for c in ("net", *ends, *flags)}, places(tip, ends[:2]), places(leg, ends))
            offsets = np.cumsum([0, *(len(x) for x, _, _ in paths)])
            x, y = (np.concatenate([p[i] for p in paths]) if paths else np.empty(0) for i in (0, 1))
            rows = table.select(kept).take(np.flatnonzero(get["kind"] == 0))
            path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"]))
            yield from pa.Table.from_arrays([*rows.columns, path, pa.array([p[2] for p in paths], pa.bool_())], names=[*kept, "points", "clear"]).to_batches()

    return every.mapInArrow(run, todo.select(*kept, F.array("a").alias("points"), F.lit(True).alias("clear")).schema)


def _routed_by_joins(todo: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    """routed() of settled edges of large sheets. Rounds grow with the longest chain of edges on a sheet that change each
    other's path."""
    before = F.lit(0).cast("int")
    points, lines = (settled(df.withColumn("ord", before)) for df in (points, lines))
    narrow = _tried(todo, NARROW)
    laid: DataFrame | None = None
    turn = todo
    while True:
        if laid is None:
            p, s = points, lines
        else:
            known = laid.select("sheet", "ord", F.col("net_id").cast("string").alias("net_id"), "path")
            p = points.unionByName(known.select("sheet", "net_id", F.explode("path").alias("p"), "ord"))
            s = lines.unionByName(_segments(known, "sheet", "net_id", "ord").drop("k"))
        found, rest = None, turn
        for attempt in (lambda left: _direct(narrow.join(left.select(Edge).hint("merge"), Edge, "left_semi"), p, s), lambda left: _direct(_tried(left, WIDE), p, s), lambda left: _escaping(left, p, s)):
            got = settled(attempt(rest))
            found = got if found is None else found.unionByName(got)
            rest = settled(rest.join(got.hint("merge"), Edge, "left_anti"))
            if rest.isEmpty():
                break
        plain = rest.select("sheet", "ord", manhattan(F.col("a"), F.col("b"), (F.col("from_direction") == "output") | (F.col("to_direction") == "input")).alias("path"))
        chosen = found.withColumn("clear", F.lit(True)).unionByName(plain.withColumn("clear", F.lit(False)))
        now = turn.select("sheet", "ord", "net_id").join(chosen.hint("merge"), Edge)
        if laid is None:
            laid, changed = settled(now), turn
        else:
            old = laid.select("sheet", "ord", F.col("path").alias("was"))
            now = settled(now.join(old.hint("merge"), Edge))
            changed = now.where(F.col("path") != F.col("was"))
            laid = settled(laid.join(now.select(Edge).hint("merge"), Edge, "left_anti").unionByName(now.drop("was")))
        first = settled(changed.groupBy("sheet").agg(F.min("ord").alias("first")))
        turn = settled(todo.join(first.hint("merge"), "sheet").where("ord > first").drop("first"))
        if turn.isEmpty():
            ends = todo.select("sheet", "ord", "from_id", "to_id")
            return laid.join(ends.hint("merge"), Edge).select("sheet", "ord", "net_id", "from_id", "to_id", F.col("path").alias("points"), "clear")


def faults(wires: DataFrame, points: DataFrame) -> DataFrame:
    """(sheet, net_id, ord, kind): wires (sheet, net_id, ord, points) that touch a foreign point but at their ends, or
    whose corners lie on a foreign wire."""
    key = ["sheet", "ord"]
    w = wires.select("sheet", "ord", F.col("net_id").cast("string").alias("net_id"), F.col("points").alias("path"), F.get("points", F.lit(0)).alias("a"), F.element_at("points", -1).alias("b"))
    at = points.select("sheet", F.col("net_id").cast("string").alias("o_net"), "p", F.explode(_lines_at(F.col("p"))).alias("line"))
    s = _segments(w, "sheet", "ord", "net_id", "a", "b")
    other = F.col("o_net").isNull() | (F.col("o_net") == "") | (F.col("o_net") != F.col("net_id"))
    met = s.withColumn("line", F.explode(_lines_of(F.col("s")))).join(at.hint("merge"), ["sheet", "line"]).where(other & on_segment(F.col("p"), F.col("s")) & ~_same(F.col("p"), F.col("a")) & ~_same(F.col("p"), F.col("b")))
    on = s.select("sheet", F.col("net_id").alias("o_net"), F.col("s").alias("o"), F.explode(_lines_of(F.col("s"))).alias("line"))
    turns = w.select(*key, "net_id", "a", "b", F.explode("path").alias("p")).where(~_same(F.col("p"), F.col("a")) & ~_same(F.col("p"), F.col("b")))
    run = turns.withColumn("line", F.explode(_lines_at(F.col("p")))).join(on.hint("merge"), ["sheet", "line"]).where(other & on_segment(F.col("p"), F.col("o")))
    pick = lambda df, kind: df.select("sheet", "net_id", "ord", F.lit(kind).alias("kind"))
    return pick(met, "point").unionByName(pick(run, "wire")).distinct()


def wire_labels(wires: DataFrame, names: DataFrame) -> DataFrame:
    """(sheet, ord, net_id, name, x, y): a label for each wire (sheet, ord, net_id, name, points) of two points or more.

    A wire without a name takes its net's from names (net_id, name), and has no label without one. The label is 8 above
    the first grid place, from the middle of each segment outwards, that no wire of another net runs through; the
    middle of the first segment where there is none.
    """
    named = names.where(F.col("name").isNotNull() & (F.col("name") != "")).groupBy(F.col("net_id").alias("net_id")).agg(F.min("name").alias("fallback"))
    w = wires.where(F.size("points") > 1).join(named, "net_id", "left").withColumn("name", F.coalesce(F.nullif(F.col("name"), F.lit("")), "fallback")).where(F.col("name").isNotNull())
    w = w.select("sheet", "ord", "net_id", "name", F.col("points").alias("path"))
    s = _segments(w, "sheet", "ord", "net_id")
    level = F.abs(F.col("s.y1") - F.col("s.y2")) < EPSILON
    middle = lambda i: snapped((F.col(f"s.{i}1") + F.col(f"s.{i}2")) / 2)
    tries = F.concat(F.array(F.lit(0.0)), F.flatten(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.array(k * 10.0, -k * 10.0))))
    places = s.select("sheet", "ord", "net_id", "k", level.alias("level"), "s", middle("x").alias("mx"), middle("y").alias("my"), F.posexplode(tries).alias("turn", "off"))
    places = places.withColumn("p", F.when(F.col("level"), point(F.col("mx") + F.col("off"), F.col("my"))).otherwise(point(F.col("mx"), F.col("my") + F.col("off"))))
    along = F.when(F.col("level"), F.col("p.x").between(F.least("s.x1", "s.x2") + 2, F.greatest("s.x1", "s.x2") - 2)).otherwise(F.col("p.y").between(F.least("s.y1", "s.y2") + 2, F.greatest("s.y1", "s.y2") - 2))
    places = places.where(along).select("sheet", "ord", "net_id", "k", "turn", "p")
    on = s.select("sheet", F.col("net_id").alias("o_net"), F.col("s").alias("o"), F.explode(_lines_of(F.col("s"))).alias("line"))
    crossed = places.withColumn("line", F.explode(_lines_at(F.col("p")))).join(on.hint("merge"), ["sheet", "line"]).where((F.col("o_net") != F.col("net_id")) & on_segment(F.col("p"), F.col("o"))).select("sheet", "ord", "k", "turn").distinct()
    free = places.join(crossed, ["sheet", "ord", "k", "turn"], "left_anti").groupBy("sheet", "ord").agg(F.min(F.struct("k", "turn", "p")).alias("best"))
    head = w.withColumn("first", point(snapped((F.get("path", F.lit(0))["x"] + F.get("path", F.lit(1))["x"]) / 2), snapped((F.get("path", F.lit(0))["y"] + F.get("path", F.lit(1))["y"]) / 2)))
    at = F.coalesce("best.p", "first")
    return head.join(free, Edge, "left").select("sheet", "ord", "net_id", "name", at["x"].alias("x"), (at["y"] - 8).alias("y"))
