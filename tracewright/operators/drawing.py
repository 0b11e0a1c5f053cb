"""Schematic drawings from a board's parts and nets: symbols and pins, ports, sheets' connectors, wires and labels.

Tables; doc tells boards apart:
  components(doc, id, ord, part_number, package)
  parts(part_number, package, description), part_pins(part_number, package, ord, number, name, direction),
  part_functions(part_number, package, ord, name, type, inputs, clocks, enables, outputs), aliases(part_number, package, alias)
  nets(doc, net_id, ord, name), net_pads(doc, net_id, ord, component_id, pin), net_vias(doc, net_id, ord, component_id, pin)
  connectors(doc, id, ord, pin_number, signal_name, net_id), board_pins(doc, pin_number, direction)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.names import is_ground, is_power
from tracewright.operators import wiring
from tracewright.operators.features import function_pins
from tracewright.operators.layout import laid_out, pin_places
from tracewright.operators.lookup import SMALL
from tracewright.operators.loop import dealt, settled, tasks_for
from tracewright.operators.parts import tiered_lookup
from tracewright.operators.schematic import power_places, without_stubs

SYMBOL = ["doc", "id", "ord", "component_id", "function_name", "gate_type", "part_number", "package", "description"]
PIN = ["doc", "symbol_id", "ord", "pin_number", "name", "direction", "negated", "clock", "net_id", "net_name"]


def pads(nets: DataFrame, net_pads: DataFrame, net_vias: DataFrame, tasks: int = 0) -> DataFrame:
    """(doc, component_id, pin, net_id, net_name) of the pins that nets hold as pads or through vias.

    Of several nets of a pin the last counts, by the nets' order, pads before vias; a nameless net takes no name away
    through a via. Rows are dealt over so many tasks, where the shuffle partitions are fewer. Nets may look small enough to
    broadcast when they are not, so the join is a shuffle join.
    """
    n = nets.select("doc", "net_id", F.col("ord").alias("net_ord"), F.coalesce("name", F.lit("")).alias("net_name"))
    part = lambda df, phase: df.where("component_id <> '' AND pin <> ''").select("doc", "net_id", "component_id", "pin", F.lit(phase).alias("phase"), F.col("ord").alias("member_ord"))
    every = dealt(part(net_pads, 0).unionByName(part(net_vias, 1)), tasks, "doc", "net_id").join(dealt(n, tasks, "doc", "net_id").hint("merge"), ["doc", "net_id"])
    every = dealt(every, tasks, "doc", "component_id", "pin")
    order = F.struct("net_ord", "phase", "member_ord")
    name = F.max_by(F.when((F.col("phase") == 0) | (F.col("net_name") != ""), F.col("net_name")), F.when((F.col("phase") == 0) | (F.col("net_name") != ""), order))
    return every.groupBy("doc", "component_id", "pin").agg(F.max_by("net_id", order).alias("net_id"), F.coalesce(name, F.lit("")).alias("net_name"))


def _counted(library: DataFrame) -> DataFrame:
    """library, to be broadcast if it has up to SMALL rows."""
    return F.broadcast(library) if library.limit(SMALL + 1).count() <= SMALL else library.hint("merge")


def known_parts(components: DataFrame, parts: DataFrame, aliases: DataFrame) -> DataFrame:
    """components with found_part and found_package, by part and package first, else by part alone; null if unknown."""
    wanted = components.select("part_number", "package").distinct().withColumn("id", F.struct("part_number", "package"))
    first = tiered_lookup(wanted, parts, aliases).select("part_number", "package", "id", "found_part", "found_package")
    rest = first.where("found_part IS NULL").select("id", "part_number", "package")
    again = tiered_lookup(rest, parts, aliases, by_package=False).select("part_number", "package", "found_part", "found_package")
    found = first.where("found_part IS NOT NULL").select("part_number", "package", "found_part", "found_package").unionByName(again)
    keyed = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = found.select(keyed("part_number").alias("p"), keyed("package").alias("k"), "found_part", "found_package")
    return components.withColumns({"p": keyed("part_number"), "k": keyed("package")}).join(found, ["p", "k"], "left").drop("p", "k")


def _net_of(pins: DataFrame, pad: DataFrame, tasks: int) -> DataFrame:
    """pins with the net of their component's pad."""
    key = ["doc", "component_id", "pad_pin"]
    p = pad.select("doc", "component_id", F.col("pin").alias("pad_pin"), "net_id", "net_name")
    joined = dealt(pins.withColumn("pad_pin", F.col("pin_number").cast("string")), tasks, *key).join(dealt(p, tasks, *key).hint("merge"), key, "left")
    return joined.withColumn("net_name", F.coalesce("net_name", F.lit("")))


def symbols_and_pins(components: DataFrame, parts: DataFrame, part_pins: DataFrame, part_functions: DataFrame, aliases: DataFrame, pad: DataFrame, tasks: int = 0) -> tuple[DataFrame, DataFrame]:
    """Symbols and pins of components: one symbol a logic function of the part, else one block with all pins.

    A block of an unknown part has the pins that nets name, by number. ord of a symbol is struct<group, component,
    function>; connectors come after components. Pins and pads are dealt over so many tasks, where the shuffle partitions are
    fewer. A library of few rows is broadcast by their number, so that a part with very many components is no hot key.
    """
    c = known_parts(components, parts, aliases).where("doc IS NOT NULL AND id IS NOT NULL").withColumnsRenamed({"id": "component_id", "ord": "component_ord"})
    key = [F.col("part_number").alias("found_part"), F.col("package").alias("found_package")]
    texts = _counted(parts.select(*key, "description"))
    c = settled(c.join(texts, ["found_part", "found_package"], "left").withColumn("description", F.coalesce("description", F.lit(""))))
    ord_of = lambda f: F.struct(F.lit(0).alias("group"), F.col("component_ord").cast("long").alias("component"), f.cast("long").alias("function"))
    fn = part_functions.select(*key, F.col("ord").alias("f"), F.col("name").alias("function_name"), F.col("type").alias("gate_type"))
    gates = c.join(_counted(fn), ["found_part", "found_package"])
    gate_id = F.concat_ws("-", "component_id", "function_name")
    of_gates = gates.withColumn("id", gate_id).withColumn("ord", ord_of(F.col("f"))).select(SYMBOL)
    blocks = c.join(_counted(fn.select("found_part", "found_package").distinct()), ["found_part", "found_package"], "left_anti")
    of_blocks = blocks.withColumns({"id": F.col("component_id"), "ord": ord_of(F.lit(0)), "function_name": F.lit(""), "gate_type": F.lit("BLOCK")}).select(SYMBOL)

    names = part_pins.groupBy(*key, F.col("number").alias("pin_number")).agg(F.min_by("name", "ord").alias("name"))
    roles = function_pins(part_functions).select(*key, F.col("function").alias("function_name"), "pin_number", F.col("role").alias("direction"), F.col("place").alias("place"))
    roles = roles.join(names, ["found_part", "found_package", "pin_number"], "left").withColumn("name", F.coalesce("name", F.lit("")))
    slashed = F.col("name").startswith("/")
    negated = F.when(F.col("direction").isin("input", "enable"), slashed).when(F.col("direction") == "output", slashed | F.col("name").startswith("~")).otherwise(False)
    gate_pins = gates.select("doc", "component_id", "found_part", "found_package", "function_name", gate_id.alias("symbol_id")).join(_counted(roles), ["found_part", "found_package", "function_name"])
    gate_pins = gate_pins.withColumns({"ord": F.col("place"), "negated": negated, "clock": F.col("direction") == "clock"})

    way = F.lower("direction")
    side = F.when(way == "output", "output").when(way.isin("power", "ground"), "power").otherwise("input")
    listed = part_pins.select(*key, "ord", F.col("number").alias("pin_number"), "name", side.alias("direction"))
    no = F.lit(False)
    block_pins = blocks.select("doc", "component_id", "found_part", "found_package", F.col("component_id").alias("symbol_id")).join(_counted(listed), ["found_part", "found_package"]).withColumns({"negated": no, "clock": no})
    number = F.regexp_extract("pin", r"^([+-]?\d+)", 1).try_cast("int")
    key = ["doc", "component_id"]
    unknown = dealt(blocks.where("found_part IS NULL").select(key), tasks, *key).join(dealt(pad.select(*key, "pin"), tasks, *key).hint("merge"), key)
    unknown = unknown.select(*key, number.alias("pin_number")).where("pin_number IS NOT NULL").distinct()
    bare = unknown.withColumns({"symbol_id": F.col("component_id"), "ord": F.col("pin_number"), "name": F.lit(""), "direction": F.lit(None).cast("string"), "negated": no, "clock": no})
    plain = ["component_id", *(c for c in PIN if c not in ("net_id", "net_name"))]
    # the net's name tells the direction of a bare pin
    pins = _net_of(gate_pins.select(plain).unionByName(block_pins.select(plain)).unionByName(bare.select(plain)), pad, tasks)
    pins = pins.withColumn("direction", F.coalesce("direction", F.when(is_power(F.col("net_name")), "power").otherwise("input"))).select(PIN)
    return of_gates.unionByName(of_blocks), pins


def connector_symbols(connectors: DataFrame, board_pins: DataFrame, nets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and pins of the edge connectors that have a signal, but no power; a signal comes in unless the board says
    that it goes out."""
    way = board_pins.groupBy("doc", "pin_number").agg(F.min(F.lower("direction")).alias("way"))
    named = connectors.where("signal_name <> ''").where(~is_power(F.col("signal_name"))).join(way, ["doc", "pin_number"], "left")
    named = named.join(nets.select("doc", "net_id", F.col("name").alias("net_name")), ["doc", "net_id"], "left")
    symbol = F.format_string("CONN-%d", "pin_number")
    text = F.lit("")
    symbols = named.select("doc", symbol.alias("id"), F.struct(F.lit(1).alias("group"), F.col("ord").cast("long").alias("component"), F.lit(0).cast("long").alias("function")).alias("ord"), F.col("id").alias("component_id"), text.alias("function_name"), F.lit("CONNECTOR").alias("gate_type"), F.col("signal_name").alias("part_number"), text.alias("package"), text.alias("description"))
    pins = named.select("doc", symbol.alias("symbol_id"), F.lit(1).alias("ord"), "pin_number", F.col("signal_name").alias("name"), F.when(F.col("way") == "output", "output").otherwise("input").alias("direction"), F.lit(False).alias("negated"), F.lit(False).alias("clock"), "net_id", F.coalesce("net_name", F.lit("")).alias("net_name"))
    return symbols, pins


def power_ports(nets: DataFrame, symbols: DataFrame, pins: DataFrame) -> DataFrame:
    """(doc, id, net_id, name, is_ground, symbol_id, pin_number): a port for each pin on a power net; ids by the order of
    nets, symbols and pins."""
    power = nets.where(is_power(F.col("name"))).select("doc", "net_id", F.col("ord").alias("net_ord"), F.col("name").alias("port_name"))
    at = pins.join(power, ["doc", "net_id"]).join(symbols.select("doc", F.col("id").alias("symbol_id"), F.col("ord").alias("symbol_ord")), ["doc", "symbol_id"])
    number = F.row_number().over(W.partitionBy("doc", "net_id").orderBy("symbol_ord", "ord"))
    return at.select("doc", F.format_string("%s:%d", F.col("net_id").cast("string"), number).alias("id"), "net_id", F.col("port_name").alias("name"), is_ground(F.col("port_name")).alias("is_ground"), "symbol_id", "pin_number")


def off_sheet(symbols: DataFrame, pins: DataFrame, power_nets: DataFrame, left: float = 100.0, top: float = 100.0) -> DataFrame:
    """(doc, sheet, net_id, name, target_sheet, x, y, direction): for each net on several sheets and each ordered pair of
    these a connector by the net's first pin on the sheet.

    symbols(doc, id, ord, sheet), pins(doc, symbol_id, ord, direction, net_id, net_name, x, y), power_nets(doc, net_id).
    A connector stands left of pins that take signals, right of others, but not beyond left and top. A sheet of 0 or
    less is 1.
    """
    sheet = F.when(F.coalesce("sheet", F.lit(1)) <= 0, 1).otherwise(F.coalesce("sheet", F.lit(1))).alias("sheet")
    on = pins.where(F.col("net_id").isNotNull() & (F.col("net_id").cast("string") != ""))
    on = on.join(symbols.select("doc", F.col("id").alias("symbol_id"), F.col("ord").alias("symbol_ord"), sheet), ["doc", "symbol_id"])
    # pins are shuffled for their symbols and once more; all that follows has a row a net and sheet
    order, has = F.struct("symbol_ord", "ord"), F.col("net_name") != ""
    named = F.max(F.when(has, F.struct(order.alias("order"), F.col("net_name").alias("name")))).alias("named")
    place = F.struct("symbol_ord", "ord", "x", "y", "direction")
    first = on.groupBy("doc", "net_id", "sheet").agg(F.min(place).alias("pin"), named)
    first = first.join(power_nets.select("doc", "net_id").distinct(), ["doc", "net_id"], "left_anti")
    nets = first.groupBy("doc", "net_id").agg(F.max("named")["name"].alias("name"), F.collect_list(F.struct("sheet", "pin")).alias("firsts")).where(F.size("firsts") > 1)
    takes = F.col("pin.direction").isin("input", "clock", "enable")
    x = F.when(takes, F.greatest(F.col("pin.x") - 140, F.lit(left))).otherwise(F.col("pin.x") + 60)
    each = nets.select("doc", "net_id", "name", F.col("firsts.sheet").alias("sheets"), F.explode("firsts").alias("own")).select("doc", "net_id", "name", "own.*", F.explode("sheets").alias("target_sheet"))
    pairs = each.where("sheet <> target_sheet")
    return pairs.select("doc", "sheet", "net_id", F.coalesce("name", F.lit("")).alias("name"), "target_sheet", x.alias("x"), F.greatest(F.col("pin.y") - 10, F.lit(top)).alias("y"), F.when(takes, "input").otherwise("output").alias("direction"))


def wired(symbols: DataFrame, pins: DataFrame, connectors: DataFrame, ports: DataFrame, power_nets: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wires (doc, sheet, ord, net_id, points, clear) and labels (doc, sheet, ord, net_id, name, x, y) of placed drawings.

    symbols(doc, id, sheet), pins(doc, symbol_id, ord, direction, net_id, net_name, x, y), connectors as off_sheet
    returns them, ports(doc, symbol_id, net_id, x, y, pin_x, pin_y), power_nets(doc, net_id), names(doc, net_id, name).
    """
    key = F.struct("doc", "sheet").alias("sheet")
    net = F.struct("doc", "net_id").alias("net_id")
    on = pins.join(symbols.select("doc", F.col("id").alias("symbol_id"), "sheet", F.col("ord").alias("symbol_ord")), ["doc", "symbol_id"])
    no_net = F.col("net_id").isNull() | (F.col("net_id").cast("string") == "")
    own = F.struct(F.lit(0).alias("kind"), F.col("symbol_ord").cast("string").alias("owner"), F.format_string("%09d", "ord").alias("place"), F.col("symbol_id").cast("string").alias("name"))
    far = F.struct(F.lit(1).alias("kind"), F.format_string("%09d", "target_sheet").alias("owner"), F.lit("").alias("place"), F.lit("").alias("name"))
    pin = on.select(key, F.when(~no_net, net).alias("net_id"), own.alias("id"), "x", "y", "direction")
    con = connectors.select(key, net, far.alias("id"), "x", "y", "direction")
    power = power_nets.select(net)
    # nets are told apart by text there, so their ids go as text
    text = lambda df: df.withColumn("net_id", F.to_json("net_id"))
    pin, con, power = text(pin), text(con), text(power)
    stubs = text(ports.select(key, net, "x", "y", "pin_x", "pin_y")) if "sheet" in ports.columns else text(ports.join(symbols.select("doc", F.col("id").alias("symbol_id"), "sheet"), ["doc", "symbol_id"]).select(key, net, "x", "y", "pin_x", "pin_y"))
    points, lines = wiring.standing(pin, con, stubs)
    wires = settled(wiring.routed(wiring.edges(wiring.net_pins(pin, con, power)), points, lines))
    called = text(names.select(net, "name")).where("name <> ''").unionByName(text(on.select(net, F.col("net_name").alias("name"))).where("name <> ''"))
    preferred = text(names.select(net, "name")).where("name <> ''").groupBy("net_id").agg(F.min("name").alias("name"))
    labels = wiring.wire_labels(wires.select("sheet", "ord", "net_id", "points").join(preferred, "net_id", "left"), called)
    kind = pins.select(net).schema["net_id"].dataType
    plain = lambda df, *more: df.withColumn("net", F.from_json("net_id", kind)).select(F.col("sheet.doc").alias("doc"), F.col("sheet.sheet").alias("sheet"), "ord", F.col("net.net_id").alias("net_id"), *more)
    return plain(wires, "points", "clear"), plain(labels, "name", "x", "y")


def generated(components: DataFrame, parts: DataFrame, part_pins: DataFrame, part_functions: DataFrame, aliases: DataFrame, nets: DataFrame, net_pads: DataFrame, net_vias: DataFrame, connectors: DataFrame, board_pins: DataFrame, stubs: bool = False) -> dict[str, DataFrame]:
    """A drawing of each doc on one sheet: symbols, pins, ports, wires and labels.

    Without stubs, connectors on nets with no other pin are left out, though not the ports of their pins, which then
    have no place. Parts and nets without rows, and docs without components, give empty tables.
    """
    tasks = tasks_for(nets, net_pads.count() + net_vias.count())
    pad = settled(pads(nets, net_pads, net_vias, tasks))
    of_parts, part_rows = symbols_and_pins(components, parts, part_pins, part_functions, aliases, pad, tasks)
    of_edge, edge_rows = connector_symbols(connectors, board_pins, nets)
    symbols, pins = settled(of_parts.unionByName(of_edge)), settled(part_rows.unionByName(edge_rows))
    ports = settled(power_ports(nets, symbols, pins))
    if not stubs:
        unique = F.struct("doc", F.col("id")).alias("id")
        n = pins.groupBy("doc", F.col("symbol_id").alias("id")).agg(F.count("*").alias("pins"))
        known = symbols.join(n, ["doc", "id"], "left").select(unique, F.col("gate_type").alias("kind"), F.coalesce("pins", F.lit(0)).alias("pins"))
        of_nets = pins.select(F.struct("doc", F.col("symbol_id").alias("id")).alias("symbol_id"), F.struct("doc", "net_id", F.when(F.col("net_id").isNull(), F.col("symbol_id")).alias("alone")).alias("net_id"))
        kept = without_stubs(known, of_nets).select("id.doc", "id.id")
        symbols = settled(symbols.join(kept, ["doc", "id"], "left_semi"))
        pins = settled(pins.join(kept.withColumnRenamed("id", "symbol_id"), ["doc", "symbol_id"], "left_semi"))
    symbols = settled(laid_out(symbols, pins).withColumn("sheet", F.lit(1)))
    pins = settled(pin_places(symbols, pins).withColumn("negated", F.col("negated") | F.col("inverted")).drop("inverted"))
    owner = lambda df: df.withColumn("symbol_id", F.struct("doc", "symbol_id"))
    places = power_places(owner(ports.withColumn("id", F.struct("doc", "id"))), owner(pins.withColumnRenamed("pin_number", "number"))).select("id.doc", "id.id", "x", "y")
    tip = pins.groupBy("doc", "symbol_id", "pin_number").agg(F.min(F.struct("ord", "x", "y")).alias("p")).select("doc", "symbol_id", "pin_number", F.col("p.x").alias("pin_x"), F.col("p.y").alias("pin_y"))
    placed = settled(ports.join(places, ["doc", "id"]).join(tip, ["doc", "symbol_id", "pin_number"]))
    power = nets.where(is_power(F.col("name"))).select("doc", "net_id")
    far = off_sheet(symbols, pins, power)
    wires, labels = wired(symbols, pins, far, placed, power, nets.select("doc", "net_id", F.coalesce("name", F.lit("")).alias("name")))
    return {"symbols": symbols, "pins": pins, "ports": placed, "wires": wires, "labels": labels}


def moved(symbols: DataFrame, pins: DataFrame, connectors: DataFrame, moves: DataFrame, power_nets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbols on other sheets, and their drawings' sheet connectors after that.

    moves(doc, id, sheet) must name a symbol once. Only connectors of nets that a moved symbol is on are made anew; one
    that was there before, by sheet and net, keeps its place. The others stay as they are, which is what making all
    anew would give.
    """
    to = moves.select("doc", "id", F.col("sheet").alias("to_sheet"))
    now = symbols.join(to, ["doc", "id"], "left").withColumn("sheet", F.coalesce("to_sheet", "sheet")).drop("to_sheet")
    named = pins.where(F.col("net_id").isNotNull() & (F.col("net_id").cast("string") != ""))
    touched = settled(named.join(to.select("doc", F.col("id").alias("symbol_id")), ["doc", "symbol_id"], "left_semi").select("doc", "net_id").distinct())
    anew = off_sheet(now, pins.join(touched, ["doc", "net_id"], "left_semi"), power_nets)
    saved = connectors.groupBy("doc", "sheet", "net_id").agg(F.min_by(F.struct("x", "y"), "target_sheet").alias("old"))
    anew = anew.join(saved, ["doc", "sheet", "net_id"], "left").withColumns({"x": F.coalesce("old.x", "x"), "y": F.coalesce("old.y", "y")}).drop("old")
    return now, connectors.join(touched, ["doc", "net_id"], "left_anti").unionByName(anew)
