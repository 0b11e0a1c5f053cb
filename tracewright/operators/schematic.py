"""Schematic documents: bus families, sheet connectors, junctions, and quality figures of a routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.geometry import snapped
from tracewright.functions.names import is_ground, is_power
from tracewright.operators.order import numbered


def bus_families(nets: DataFrame, least: int = 4) -> DataFrame:
    """(net_id, name, family, bit) of nets whose name less its trailing number is shared by so many nets."""
    split = nets.withColumn("family", F.regexp_extract("name", r"^(.+?)(\d+)$", 1)).withColumn("bit", F.regexp_extract("name", r"^(.+?)(\d+)$", 2))
    split = split.where("family <> ''")
    sizes = split.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return split.join(sizes.select("family"), "family", "left_semi").select("net_id", "name", "family", "bit")


def sheet_connectors(pins: DataFrame) -> DataFrame:
    """(net_id, sheet, other_sheet) for pins(net_id, name, sheet): each ordered pair of sheets of a net; no power nets."""
    on = pins.where(~is_power(F.col("name"))).select("net_id", F.when(F.col("sheet") <= 0, 1).otherwise(F.col("sheet")).alias("sheet")).distinct()
    return on.join(on.withColumnRenamed("sheet", "other_sheet"), "net_id").where("sheet <> other_sheet")


def junctions(waypoints: DataFrame, least: int = 3) -> DataFrame:
    """(sheet, x, y, n) of grid points that so many waypoints (sheet, x, y) meet at."""
    return waypoints.groupBy("sheet", snapped(F.col("x")).alias("x"), snapped(F.col("y")).alias("y")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def power_refs(ports: DataFrame) -> DataFrame:
    """ports(id, ord) with ref #PWR001 and so on, by position."""
    return numbered(ports, [F.col("ord")]).withColumn("ref", F.format_string("#PWR%03d", "number")).drop("number")


def segments(wires: DataFrame) -> DataFrame:
    """(wire, net_id, k, x1, y1, x2, y2) for wires(id, net_id, points)."""
    at = lambda i, f: F.get("points", i)[f]
    k = wires.where(F.size("points") >= 2).select(F.col("id").alias("wire"), "net_id", "points", F.explode(F.sequence(F.lit(0), F.size("points") - 2)).alias("k"))
    return k.select("wire", "net_id", "k", at(F.col("k"), "x").alias("x1"), at(F.col("k"), "y").alias("y1"), at(F.col("k") + 1, "x").alias("x2"), at(F.col("k") + 1, "y").alias("y2"))


def wire_lengths(wires: DataFrame) -> DataFrame:
    """(net_id, length, bends) of each net's wires."""
    s = segments(wires)
    flat = s.withColumn("flat", F.abs(F.col("x1") - F.col("x2")) >= F.abs(F.col("y1") - F.col("y2")))
    turned = F.col("flat") != F.lag("flat").over(W.partitionBy("wire").orderBy("k"))
    return flat.withColumn("bend", F.coalesce(turned.cast("int"), F.lit(0))).groupBy("net_id").agg(F.sum(F.abs(F.col("x1") - F.col("x2")) + F.abs(F.col("y1") - F.col("y2"))).alias("length"), F.sum("bend").alias("bends"))


def crossings(wires: DataFrame, cell: float = 200.0) -> DataFrame:
    """(net_a, net_b, x, y): strict crossings of a level and an upright segment of two nets; an equi-join on cells."""
    s = segments(wires)
    level = s.where("y1 = y2 and x1 <> x2").select(F.col("net_id").alias("net_a"), F.least("x1", "x2").alias("xa"), F.greatest("x1", "x2").alias("xb"), F.col("y1").alias("y"))
    upright = s.where("x1 = x2 and y1 <> y2").select(F.col("net_id").alias("net_b"), F.least("y1", "y2").alias("ya"), F.greatest("y1", "y2").alias("yb"), F.col("x1").alias("x"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    level = level.withColumn("cy", F.floor(F.col("y") / cell)).withColumn("cx", cells("xa", "xb"))
    upright = upright.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", cells("ya", "yb"))
    return level.join(upright, ["cx", "cy"]).where("net_a <> net_b and x > xa and x < xb and y > ya and y < yb").select("net_a", "net_b", "x", "y")


def stable_uuid(namespace, key):
    """A UUID of version 5's form from the SHA-256 of namespace:id."""
    h = F.sha2(F.concat_ws(":", namespace, key).cast("binary"), 256)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def without_stubs(symbols: DataFrame, pins: DataFrame) -> DataFrame:
    """symbols (id, kind, pins) without one-pin connectors whose net has fewer than two pins (symbol_id, net_id)."""
    lone = pins.groupBy("net_id").agg(F.count("*").alias("n")).where("n < 2").select("net_id")
    stubs = pins.join(lone, "net_id", "left_semi").select(F.col("symbol_id").alias("id"))
    drop = symbols.where("kind = 'CONNECTOR' and pins = 1").join(stubs, "id", "left_semi").select("id")
    return symbols.join(drop, "id", "left_anti")


def laid_out(symbols: DataFrame, saved: DataFrame) -> DataFrame:
    """symbols (id, x, y, rotation) with saved places (id, x, y, rotation) where there are any, on the grid of 5."""
    s = saved.select("id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("rotation").alias("sr"), F.lit(True).alias("was_saved"))
    pick = lambda c, o: F.coalesce(F.col(o), F.col(c)).alias(c)
    out = symbols.join(s, "id", "left").select("id", pick("x", "sx"), pick("y", "sy"), pick("rotation", "sr"), F.coalesce("was_saved", F.lit(False)).alias("restored"))
    return out.withColumn("x", snapped(F.col("x"))).withColumn("y", snapped(F.col("y")))


def power_places(ports: DataFrame, pins: DataFrame) -> DataFrame:
    """ports (id, symbol_id, pin_number, name) at their symbol's first such pin (symbol_id, number, ord, x, y): 40 below
    for ground, 40 above else."""
    first = pins.groupBy("symbol_id", F.col("number").alias("pin_number")).agg(F.min(F.struct("ord", "x", "y")).alias("p"))
    off = F.when(is_ground(F.col("name")), 40).otherwise(-40)
    return ports.join(first, ["symbol_id", "pin_number"]).select("id", F.col("p.x").alias("x"), (F.col("p.y") + off).alias("y"))


def sheet_bounds(objects: DataFrame, pad: float = 50.0) -> DataFrame:
    """(sheet, x1, y1, x2, y2) around all objects (sheet, x, y) of a sheet, padded."""
    return objects.groupBy("sheet").agg((F.min("x") - pad).alias("x1"), (F.min("y") - pad).alias("y1"), (F.max("x") + pad).alias("x2"), (F.max("y") + pad).alias("y2"))


def unit_numbers(symbols: DataFrame) -> DataFrame:
    """(component_id, function_name, unit): functions of a component numbered by their first symbol (ord)."""
    first = symbols.groupBy("component_id", "function_name").agg(F.min("ord").alias("first"))
    return first.select("component_id", "function_name", F.row_number().over(W.partitionBy("component_id").orderBy("first")).alias("unit"))


def axis_runs(markers: DataFrame, size: int = 50, least: int = 3, vertical: bool = True) -> DataFrame:
    """(img_id, bucket, first, last, n): of markers (img_id, value, x, y) in strips, the longest run whose values rise
    by one or two; the lowest strip and value on ties. Equal markers are runs apart. Runs shorter than least do not count."""
    strip = F.floor((F.col("x") if vertical else F.col("y")) / size)
    w = W.partitionBy("img_id", "bucket").orderBy("value", "x", "y")
    at = markers.withColumn("bucket", strip).withColumn("up", F.col("value") - F.lag("value").over(w))
    runs = at.withColumn("run", F.sum(F.when(F.col("up").between(1, 2), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("img_id", "bucket", "run").agg(F.min("value").alias("first"), F.max("value").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least)
    best = runs.groupBy("img_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "bucket", "first", "last", "n")).alias("b"))
    return best.select("img_id", F.col("b.bucket").alias("bucket"), F.col("b.first").alias("first"), F.col("b.last").alias("last"), F.col("b.n").alias("n"))
