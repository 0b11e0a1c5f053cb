"""Selecting, counting and changing feature records: vias, tracks, connectors, components, samples, buses.

A change is a new table: rows replaced by an anti-join and a union. An update is joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.geometry import distance, in_polygon, inside, on_trace, overlaps, point
from tracewright.operators.near import near_join
from tracewright.operators.order import numbered


def on_side(df: DataFrame, side: str) -> DataFrame:
    return df.where(F.col("side") == side)


def sides_of(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(front, back); what is on no known side counts as back."""
    front = F.coalesce(F.col("side") == "front", F.lit(False))
    return df.where(front), df.where(~front)


def side_counts(df: DataFrame) -> DataFrame:
    front = F.coalesce(F.col("side") == "front", F.lit(False))
    return df.agg(F.count_if(front).alias("front"), F.count_if(~front).alias("back"))


def confirmed(vias: DataFrame, yes: bool = True) -> DataFrame:
    return vias.where(F.coalesce(F.col("both_sides_confirmed"), F.lit(False)) == yes)


def in_region(df: DataFrame, region: Column) -> DataFrame:
    """Rows whose box overlaps the region."""
    return df.where(overlaps(F.col("bounds"), region))


def via_hit(p: Column) -> Column:
    """Whether a point lies on a via: in its outline if that has three points or more, else in its circle."""
    return F.when(F.size("pad_boundary") > 2, in_polygon(p, F.col("pad_boundary"))).otherwise(distance(p, F.col("center")) <= F.col("radius"))


def hits(vias: DataFrame, tracks: DataFrame, x: float, y: float, tolerance: float = 0.0) -> DataFrame:
    """(kind, id, ord) of the features at a point; the first by (kind, ord) is what a click selects: vias before tracks."""
    p = point(F.lit(x), F.lit(y))
    v = vias.where(via_hit(p)).select(F.lit(0).alias("kind"), "id", "ord")
    t = tracks.where(on_trace(p, F.col("points"), F.col("width"), tolerance)).select(F.lit(1).alias("kind"), "id", "ord")
    return v.unionByName(t)


def first_hit(found: DataFrame) -> DataFrame:
    return found.orderBy("kind", "ord").limit(1)


def connector_hits(connectors: DataFrame, x: float, y: float, side: str) -> DataFrame:
    return connectors.where((F.col("side") == side) & inside(point(F.lit(x), F.lit(y)), F.col("bounds"))).orderBy("ord").limit(1)


def track_ends(tracks: DataFrame) -> DataFrame:
    """(id, side, x, y) of the first and last vertex of tracks with two points or more."""
    ends = F.explode(F.array(F.get("points", F.lit(0)), F.element_at("points", -1)))
    return tracks.where(F.size("points") >= 2).select("id", "side", ends.alias("p")).select("id", "side", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def tracks_at(tracks: DataFrame, vias: DataFrame, tolerance: float, same_side: bool = False) -> DataFrame:
    """(via_id, trace_id) of tracks with an end within the tolerance of a via."""
    whose = F.struct("id", "side") if same_side else F.struct("id")
    of = lambda df: df.select(whose.alias("id"), "x", "y")
    pairs = near_join(of(vias), of(track_ends(tracks)), tolerance)  # ids go with their sides, so nothing is joined to them after
    if same_side:
        pairs = pairs.where("left_id.side = right_id.side")
    return pairs.select(F.col("left_id.id").alias("via_id"), F.col("right_id.id").alias("trace_id")).distinct()


def overlapping(new: DataFrame, old: DataFrame, most: float) -> DataFrame:
    """New vias (id, x, y, radius) without those closer to an old one than both radii; most bounds the sum of radii."""
    near = near_join(new, old, most, strict=True).join(new.select(F.col("id").alias("left_id"), F.col("radius").alias("r1")), "left_id").join(old.select(F.col("id").alias("right_id"), F.col("radius").alias("r2")), "right_id")
    return new.join(near.where("dist < r1 + r2").select(F.col("left_id").alias("id")), "id", "left_anti")


def supported(vias: DataFrame, centres: DataFrame, most: float) -> DataFrame:
    """Vias with a centre strictly closer than their radius; most bounds the radii."""
    near = near_join(vias, centres, most, strict=True).join(vias.select(F.col("id").alias("left_id"), "radius"), "left_id")
    return vias.join(near.where("dist < radius").select(F.col("left_id").alias("id")), "id", "left_semi")


def boosted(vias: DataFrame, factor: float) -> DataFrame:
    """Confidence of confirmed vias raised by a share of what is missing."""
    up = F.col("confidence") + (1 - F.col("confidence")) * factor
    return vias.withColumn("confidence", F.when(F.col("both_sides_confirmed"), up).otherwise(F.col("confidence")))


def confirmed_rows(matches: DataFrame, front: DataFrame, back: DataFrame) -> DataFrame:
    """Confirmed vias of matches (left_id, right_id, dist): mean centre and radius, numbered by ascending distance."""
    f = front.select(F.col("id").alias("left_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("radius").alias("r1"), F.col("confidence").alias("c1"))
    b = back.select(F.col("id").alias("right_id"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("radius").alias("r2"), F.col("confidence").alias("c2"))
    mean = lambda a, c: (F.col(a) + F.col(c)) / 2
    return numbered(matches, [F.col(c) for c in ("dist", "left_id", "right_id")]).join(f, "left_id").join(b, "right_id").select(
        F.format_string("cvia-%03d", "number").alias("id"), F.col("left_id").alias("front_via_id"), F.col("right_id").alias("back_via_id"),
        mean("x1", "x2").alias("x"), mean("y1", "y2").alias("y"), mean("r1", "r2").alias("radius"), F.least(F.lit(1.0), mean("c1", "c2") * 1.2).alias("confidence"),
    )


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def removed(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


def next_number(ids: DataFrame, prefix: str) -> DataFrame:
    """One row, number: one more than the highest number after the prefix; ids of other forms do not count."""
    n = F.regexp_extract("id", rf"^{prefix}(\d+)$", 1).try_cast("int")
    return ids.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("number"))


def assigned(features: DataFrame, chosen: DataFrame, bus: str | None, color: str | None = None) -> DataFrame:
    """features with bus and color set for the chosen ids; None takes them off."""
    mark = chosen.select("id").distinct().withColumn("chosen", F.lit(True))
    pick = lambda c, v: F.when(F.col("chosen"), F.lit(v).cast("string")).otherwise(F.col(c)).alias(c)
    others = [c for c in features.columns if c not in ("bus", "color")]
    return features.join(mark, "id", "left").select(*others, pick("bus", bus), pick("color", color))


def elements_by_type(elements: DataFrame) -> DataFrame:
    """(net_id, connector_ids, via_ids, trace_ids, pad_ids) from net elements (net_id, type, element_id)."""
    ids = lambda t: F.array_sort(F.collect_list(F.when(F.col("type") == t, F.col("element_id")))).alias(f"{t}_ids")
    return elements.groupBy("net_id").agg(*(ids(t) for t in ("connector", "via", "trace", "pad")))


def scored(samples: DataFrame, least: float) -> DataFrame:
    return samples.where(F.col("score") >= least)


def power_pins(pins: DataFrame, functions: DataFrame) -> DataFrame:
    """Part pins that are in none of the part's functions; a shuffle join, as functions hold more pins than they seem to."""
    used = functions.select("part_number", "package", F.explode(F.concat(*(F.coalesce(c, F.array().cast("array<int>")) for c in ("inputs", "outputs", "enables", "clocks")))).alias("pin_number"))
    return pins.join(used.hint("merge"), ["part_number", "package", "pin_number"], "left_anti")


def function_pins(functions: DataFrame) -> DataFrame:
    """(part_number, package, function, pin_number, role, place): the first role of each pin of a function."""
    roles = [("inputs", "input"), ("clocks", "clock"), ("enables", "enable"), ("outputs", "output")]
    rows = None
    for rank, (column, role) in enumerate(roles):
        part = functions.select("part_number", "package", F.col("name").alias("function"), F.posexplode(column).alias("k", "pin_number")).withColumn("role", F.lit(role)).withColumn("rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    key = ["part_number", "package", "function", "pin_number"]
    best = rows.groupBy(*key).agg(F.min(F.struct("rank", "k", "role")).alias("r"))
    place = F.row_number().over(W.partitionBy(*key[:3]).orderBy("r.rank", "r.k"))
    return best.select(*key, F.col("r.role").alias("role"), place.alias("place"))


def board_pins(contacts: DataFrame, pin_map: DataFrame, per_side: int, total: int) -> DataFrame:
    """Connectors of contacts (side, x, detection_pass): numbered along x by side and named by the pin map."""
    index = F.row_number().over(W.partitionBy("side").orderBy("x")) - 1
    front = F.col("side") == "front"
    numbered = contacts.withColumn("index", index).withColumn("pin_number", F.when(front, per_side - F.col("index")).otherwise(total - F.col("index")))
    trust = F.when(F.col("detection_pass") == 1, 1.0).when(F.col("detection_pass") == 2, 0.8).otherwise(0.6)
    name = F.format_string("conn-%s-%03d", F.when(front, "F").otherwise("B"), F.col("index"))
    return numbered.join(pin_map, "pin_number").withColumn("confidence", trust).withColumn("id", name)
