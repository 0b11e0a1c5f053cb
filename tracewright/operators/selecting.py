"""Views of record tables, and tables after an edit: layers, sheets, nets, samples, readings, specs, pins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.geometry import path_length
from tracewright.functions.names import base_name, natural_key
from tracewright.functions.records import saved_path, spec_problem


def on_layer(components: DataFrame, layer: int) -> DataFrame:
    return components.where(F.col("layer") == layer)


def with_prefix(designators: DataFrame, prefix: str) -> DataFrame:
    """Designators of a type, such as all resistors."""
    return designators.where(F.col("prefix") == prefix)


def purged(samples: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The samples of a score of least or more, and one row, removed: how many went."""
    low = F.coalesce(F.col("score") < least, F.lit(False))
    return samples.where(~low), samples.agg(F.count_if(low).alias("removed"))


def positives(samples: DataFrame) -> DataFrame:
    return samples.where("is_via")


def negatives(samples: DataFrame) -> DataFrame:
    return samples.where("not is_via")


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count_if("is_via").alias("positive"), F.count_if(~F.col("is_via")).alias("negative"))


def with_samples(samples: DataFrame, new: DataFrame) -> DataFrame:
    """Samples with labelled ones added at the end."""
    return samples.unionByName(new, allowMissingColumns=True)


def sheet_view(objects: DataFrame, sheet: int) -> DataFrame:
    """The objects of a sheet; what is on none is on the first."""
    return objects.where(F.when(F.coalesce("sheet", F.lit(0)) <= 0, 1).otherwise(F.col("sheet")) == max(sheet, 1))


def wires_of_net(wires: DataFrame, net_id: str) -> DataFrame:
    return wires.where(F.col("net_id") == net_id)


def wires_of_symbols(wires: DataFrame, pins: DataFrame) -> DataFrame:
    """(symbol_id, and the wire's columns) of the wires whose net meets a symbol's pin (symbol_id, net_id)."""
    return wires.join(pins.where("net_id <> ''").select("symbol_id", "net_id").distinct(), "net_id")


def net_named(nets: DataFrame, name: str) -> DataFrame:
    """The first net of that name, by its id."""
    return nets.where(F.col("name") == name).orderBy("net_id").limit(1)


def nets_by_name(nets: DataFrame) -> DataFrame:
    return nets.orderBy("name", "net_id")


def tracks_by_length(tracks: DataFrame) -> DataFrame:
    """Tracks (id, points) with their length, the longest first."""
    return tracks.withColumn("length", path_length(F.col("points"))).orderBy(F.desc("length"), "id")


def in_natural_order(components: DataFrame) -> DataFrame:
    return components.orderBy(natural_key(F.col("id")), "id")


def joined_results(*tables: DataFrame) -> DataFrame:
    """Detected tracks of several runs in one table, on the layer that the first one's rows have."""
    layer = tables[0].agg(F.first("layer", ignorenulls=True).alias("layer"))
    return reduce(lambda a, b: a.unionByName(b), tables).drop("layer").crossJoin(F.broadcast(layer))  # one row


def buses(features: DataFrame) -> DataFrame:
    """(bus, n): the buses that features are on, by name."""
    return features.where("bus is not null").groupBy("bus").agg(F.count("*").alias("n")).orderBy("bus")


def invalid_specs(specs: DataFrame) -> DataFrame:
    """(name, problem) of board specs that cannot be used."""
    problem = spec_problem(*map(F.col, ("name", "width_inches", "height_inches", "contacts", "alignment_methods")))
    return specs.select("name", problem.alias("problem")).where("problem is not null")


def spec_names(specs: DataFrame) -> DataFrame:
    """The names of all board specs, in order."""
    return specs.select("name").where("name is not null").distinct().orderBy("name")


def taken_pins(vias: DataFrame) -> DataFrame:
    """(id, taken) of vias (id, component_id, pin_number): whether another one is on the same pin."""
    named = (F.col("component_id") != "") & (F.col("pin_number") != "")
    n = vias.where(named).groupBy("component_id", "pin_number").agg(F.count("*").alias("n"))
    return vias.join(n, ["component_id", "pin_number"], "left").select("id", (F.coalesce("n", F.lit(0)) > 1).alias("taken"))


def output_pins(vias: DataFrame, components: DataFrame, part_pins: DataFrame) -> DataFrame:
    """(id) of the vias that are a part's output, by their component (component_id, part_number, package) and its pins."""
    outputs = part_pins.where("direction = 'Output'").select("part_number", "package", "pin_number").distinct()
    return vias.join(components, "component_id").join(outputs, ["part_number", "package", "pin_number"], "left_semi").select("id")


def derived_names(nets: DataFrame, members: DataFrame, connectors: DataFrame, vias: DataFrame, outputs: DataFrame) -> DataFrame:
    """(net_id, name) of nets (net_id, name, manual): a manual name stays; else the first connector's signal, the first
    output pin's signal, the first via's component.pin, or the base of the name. First is by ord of members (net_id,
    element_id, ord)."""
    first = lambda rows, value, name: rows.groupBy("net_id").agg(F.min(F.struct("ord", value.alias("v")))["v"].alias(name))
    of_connector = members.join(connectors.where("signal_name <> ''").select(F.col("id").alias("element_id"), "signal_name"), "element_id")
    on_via = members.join(vias.withColumnRenamed("id", "element_id"), "element_id")
    from_output = on_via.where("signal_name <> ''").join(outputs.select(F.col("id").alias("element_id")), "element_id", "left_semi")
    placed = on_via.where("component_id <> '' and pin_number <> ''")
    named = nets.join(first(of_connector, F.col("signal_name"), "a"), "net_id", "left").join(first(from_output, F.col("signal_name"), "b"), "net_id", "left")
    named = named.join(first(placed, F.concat_ws(".", "component_id", "pin_number"), "c"), "net_id", "left")
    return named.select("net_id", F.when(F.col("manual"), F.col("name")).otherwise(F.coalesce("a", "b", "c", base_name(F.col("name")))).alias("name"))


def new_readings(found: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Readings (id, text, x, y) that no known one of the same text lies closer to than the threshold, both ways.

    Places are compared, not readings, by equi-joins on text and cell. A place that is near all corners of its cell's
    known ones is near one of them; only the others meet the known places of the nine cells around.
    """
    cell = lambda c: F.floor(F.col(c) / threshold)
    close = lambda c, k: F.abs(F.col(c) - F.col(k)) < threshold
    places = found.select("text", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")).distinct()
    old = known.select("text", F.col("x").alias("kx"), F.col("y").alias("ky"), cell("x").alias("cx"), cell("y").alias("cy")).distinct()
    corners = old.groupBy("text", "cx", "cy").agg(*(f(c).alias(f"{n}_{c}") for c in ("kx", "ky") for n, f in (("least", F.min), ("most", F.max))))
    inside = close("x", "least_kx") & close("x", "most_kx") & close("y", "least_ky") & close("y", "most_ky")
    met = places.join(corners, ["text", "cx", "cy"], "left").select("text", "x", "y", "cx", "cy", F.coalesce(inside, F.lit(False)).alias("inside"))
    around = old.withColumn("cx", F.explode(F.array(*(F.col("cx") + i for i in (-1, 0, 1))))).withColumn("cy", F.explode(F.array(*(F.col("cy") + i for i in (-1, 0, 1)))))
    beside = met.where(~F.col("inside")).join(around, ["text", "cx", "cy"]).where(close("x", "kx") & close("y", "ky"))
    near = met.where("inside").select("text", "x", "y").unionByName(beside.select("text", "x", "y").distinct())
    return found.join(found.join(near, ["text", "x", "y"], "left_semi").select("id"), "id", "left_anti")


def pin_map(pins: DataFrame, key: str) -> DataFrame:
    """One pin for each value of key, such as pin_number or signal_name: the last by ord."""
    return pins.withColumn("k_", F.row_number().over(W.partitionBy(key).orderBy(F.desc("ord")))).where("k_ = 1").drop("k_")


def footprint_paths(symbols: DataFrame, uuid) -> DataFrame:
    """(component_id, path) of components by their first symbol (id, component_id, gate_type, sheet, ord); none for
    connectors."""
    first = symbols.where("gate_type <> 'CONNECTOR'").groupBy("component_id").agg(F.min(F.struct("ord", "id", "sheet")).alias("s"))
    return first.select("component_id", saved_path(F.col("s.id"), F.col("s.sheet"), uuid).alias("path"))


def even_widths(contacts: DataFrame, key: str = "board") -> DataFrame:
    """Contacts (key, id, x, width, center) of a board of three or more without those of a width over 1.3 or under 0.75
    of the upper median; those over 1.15 trimmed at the side that is farther out. Limits and sides are whole pixels."""
    sizes = contacts.groupBy(key, "width").agg(F.count("*").alias("n"))
    w = W.partitionBy(key)
    placed = sizes.withColumn("upto", F.sum("n").over(w.orderBy("width"))).withColumn("total", F.sum("n").over(w))
    middle = placed.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(key).agg(F.min("width").alias("m"), F.first("total").alias("total"))
    m, half = F.col("m"), F.floor(F.col("m") / 2).cast("int")
    most, reject, least = ((m * f).cast("int") for f in (1.15, 1.30, 0.75))
    left = F.col("x") - (F.col("center").cast("int") - half)
    right = F.col("x") + F.col("width") - (F.col("center").cast("int") + half)
    excess = F.col("width") - m
    from_left = F.when((left < 0) & (F.abs(left) > F.abs(right)), F.least(-left, excess)).otherwise(0)
    from_right = F.when((from_left == 0) & (right > 0), F.least(right, excess)).otherwise(0)
    wide = (F.col("total") >= 3) & (F.col("width") > most)
    new_x, new_width = F.col("x") + from_left, F.col("width") - from_left - from_right
    kept = contacts.join(middle, key).where((F.col("total") < 3) | F.col("width").between(least, reject))
    pick = lambda new, old: F.when(wide, new).otherwise(F.col(old)).alias(old)
    return kept.select(key, "id", pick(new_x, "x"), pick(new_width, "width"), pick(new_x + new_width / 2, "center"))


def shifted_grid(places: DataFrame, pitch: float, key: str = "id") -> DataFrame:
    """(key, pin, x, y): expected places (key, pin, x, y, dx, dy, found) moved by the mean way from expected to detected
    place (dx, dy) of those found, without those that then lie more than 0.3 pitches off; as they are where none is found."""
    # null keys are no one's: rows of such stay as they are
    w = W.partitionBy(key)
    mean = lambda which, c: F.avg(F.when(which & F.col(key).isNotNull(), F.col(f"d{c}") - F.col(c))).over(w)
    first = places.withColumn("ax", mean(F.col("found"), "x")).withColumn("ay", mean(F.col("found"), "y"))
    off = F.hypot(F.col("dx") - F.col("x") - F.col("ax"), F.col("dy") - F.col("y") - F.col("ay"))
    kept = F.col("found") & (off <= 0.3 * pitch)
    some = first.select(key, "pin", "x", "y", mean(kept, "x").alias("bx"), mean(kept, "y").alias("by"))
    return some.select(key, "pin", (F.col("x") + F.coalesce("bx", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("by", F.lit(0.0))).alias("y"))
