"""Nets: which vias, connectors and tracks conduct together, what they are called, and what each pin connects to.

Tables (see FIXTURES.md): vias(id, x, y), connectors(id, side, bx, by, bw, bh), tracks(id, side, points), and
net_members(net_id, element_id), nets(net_id, name, manual).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.names import base_name, net_priority, output_name
from tracewright.operators.graph import components
from tracewright.operators.loop import settled
from tracewright.operators.near import near_join
from tracewright.operators.order import numbered

TOLERANCE = 5.0


def conducting_pairs(tracks: DataFrame, vias: DataFrame, connectors: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b): trace ends within the tolerance of a via, trace ends in a connector's closed box on their side, and
    trace ends within the tolerance of any vertex of another trace on any side. Tracks of one point are ignored."""
    real = tracks.where(F.size("points") >= 2)
    vertices = real.select("id", "side", F.posexplode("points").alias("k", "p"), F.size("points").alias("n"))
    vertices = vertices.select("id", "side", F.concat_ws("@", "id", "k").alias("vertex"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), ((F.col("k") == 0) | (F.col("k") == F.col("n") - 1)).alias("end"))
    ends = vertices.where("end")
    owner = vertices.select(F.col("vertex").alias("left_id"), F.col("id").alias("a"))
    end_points = ends.select(F.col("vertex").alias("id"), "x", "y")
    to_via = near_join(end_points, vias.select("id", "x", "y"), tolerance).join(owner, "left_id").select("a", F.col("right_id").alias("b"))
    other = vertices.select(F.col("vertex").alias("right_id"), F.col("id").alias("b"))
    to_trace = near_join(end_points, vertices.select(F.col("vertex").alias("id"), "x", "y"), tolerance).join(owner, "left_id").join(other, "right_id").where("a <> b").select("a", "b")
    side = F.when(F.col("side") == "front", "front").otherwise("back")
    cell = 64.0
    span = lambda low, size: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(low) + F.col(size)) / cell)))
    boxes = connectors.select(F.col("id").alias("b"), F.col("side").alias("on"), "bx", "by", "bw", "bh", span("bx", "bw").alias("cx")).select("*", span("by", "bh").alias("cy"))
    in_cell = ends.select(F.col("id").alias("a"), side.alias("on"), "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    to_connector = in_cell.join(boxes, ["on", "cx", "cy"]).where("x between bx and bx + bw and y between by and by + bh").select("a", "b")
    return to_via.unionByName(to_trace).unionByName(to_connector).distinct()


def reconciled(pairs: DataFrame, elements: DataFrame, nets: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (nets, members) from conducting pairs and the old ones. elements(id, kind): the vias, connectors and tracks.

    A component stays if it holds a trace or an element of an old net. Of its old nets, manual ones beat the rest,
    then the name's priority, its length and the id decide; a component without one gets a number after the highest,
    by its smallest element. An old id goes to the claimant with the smallest element; others get new ids and keep
    the name. Ids and members that are no elements any more vanish.
    """
    everything = elements.select(F.col("id")).unionByName(members.select(F.col("element_id").alias("id"))).distinct()
    # what was in one net stays in one net only if it still conducts
    roots = everything.join(components(pairs).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    live = roots.join(elements, "id")
    had = roots.join(members.select(F.col("element_id").alias("id"), "net_id"), "id").join(nets, "net_id").select("root", "net_id", "name", "manual").distinct()
    best_key = F.struct(F.col("manual").cast("int"), net_priority(F.col("name")), -F.octet_length("name"))
    rank = F.row_number().over(W.partitionBy("root").orderBy(F.desc(best_key), "net_id"))
    chosen = had.withColumn("rank", rank).where("rank = 1").select("root", "net_id", "name").join(had.groupBy("root").agg(F.max("manual").alias("manual")), "root")
    kept = live.groupBy("root").agg(F.max((F.col("kind") == "trace").cast("int")).alias("trace"), F.min("id").alias("first"))
    kept = kept.join(chosen, "root", "left").where("trace = 1 or net_id is not null")
    claim = F.row_number().over(W.partitionBy("net_id").orderBy("first"))
    kept = kept.withColumn("own", F.col("net_id").isNotNull() & (claim == 1))
    number = F.regexp_extract("net_id", r"^net-(\d+)$", 1).try_cast("int")
    last = nets.agg(F.coalesce(F.max(number), F.lit(0)).alias("last"))
    new = numbered(kept.where("not own").select("root", "first"), [F.col("first")], "k").select("root", "k")
    named = kept.join(new, "root", "left").crossJoin(F.broadcast(last))  # one row of last
    fresh_id = F.format_string("net-%03d", F.col("last") + F.col("k"))
    named = named.select("root", F.when(F.col("own"), F.col("net_id")).otherwise(fresh_id).alias("new_id"), "name", F.coalesce("manual", F.lit(False)).alias("manual"))
    out = named.select(F.col("new_id").alias("net_id"), F.coalesce("name", "new_id").alias("name"), "manual")
    return out, live.join(named.select("root", "new_id"), "root").select(F.col("new_id").alias("net_id"), F.col("id").alias("element_id"))


def disambiguated(nets: DataFrame) -> DataFrame:
    """nets(net_id, name) with #2, #3 and so on after the base name of all but the first by id."""
    rank = F.row_number().over(W.partitionBy("base").orderBy("net_id"))
    return nets.withColumn("base", base_name(F.col("name"))).withColumn("rank", rank).withColumn("name", F.when(F.col("rank") == 1, F.col("base")).otherwise(F.concat_ws("#", "base", "rank"))).drop("base", "rank")


def resolved_pins(members: DataFrame, vias: DataFrame, connectors: DataFrame, pads: DataFrame) -> DataFrame:
    """(net_id, component, pin, signal, ord) of net members: vias with a component, connectors as CONN, pads C.P."""
    of_via = members.join(vias.where("component_id <> ''"), members["element_id"] == vias["id"]).select("net_id", F.col("component_id").alias("component"), F.col("pin_number").alias("pin"), F.col("signal_name").alias("signal"), F.lit(0).alias("ord"))
    of_connector = members.join(connectors, members["element_id"] == connectors["id"]).select("net_id", F.lit("CONN").alias("component"), F.col("pin_number").cast("string").alias("pin"), F.col("signal_name").alias("signal"), F.lit(1).alias("ord"))
    parts = F.regexp_extract("element_id", r"^([^.]+)\.(.+)$", 1), F.regexp_extract("element_id", r"^([^.]+)\.(.+)$", 2)
    of_pad = members.join(pads, members["element_id"] == pads["id"], "left_semi").select("net_id", parts[0].alias("component"), parts[1].alias("pin"), F.lit("").alias("signal"), F.lit(2).alias("ord")).where("component <> ''")
    return of_via.unionByName(of_connector).unionByName(of_pad)


def pin_connections(pins: DataFrame, key: str = "net_id") -> DataFrame:
    """(component, pin, other_component, other_pin): for each pin the others of its nets, once each.

    A net with very many pins is a skewed join key; adaptive execution splits it. What comes out is the list itself: only
    pairs of two pins that are on several nets each can come twice, so only these are shuffled again.
    """
    pair = ["component", "pin", "other_component", "other_pin"]
    ends = pins.select(key, "component", "pin").repartition("component", "pin").distinct()
    ends = ends.withColumn("often", F.count("*").over(W.partitionBy("component", "pin")) > 1)
    others = ends.select(F.col(key), F.col("component").alias("other_component"), F.col("pin").alias("other_pin"), F.col("often").alias("other_often"))
    linked = ends.join(others, key).where("component <> other_component or pin <> other_pin")
    twice = F.col("often") & F.col("other_often")
    return linked.where(~twice).select(pair).unionAll(linked.where(twice).select(pair).distinct())


def pin_order(pin) -> tuple:
    """Sort keys of pins: those that begin with a number by it, then the text."""
    lead = F.regexp_extract(pin, r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.when(lead.isNull(), 1).otherwise(0), lead, pin


def netlist_text(pins: DataFrame, names: DataFrame) -> DataFrame:
    """(component, line_no, line): the netlist dump, a heading and a line a pin; lone pins have no connections.

    No pair of pins is shuffled: a net gives each of its pins the list of the others at once. A pin on one net has its line
    from that; a pin on several has lists drawn together, of texts that hold the label and the lengths of component and
    pin, which tell pins with the same label apart.
    """
    called = names.groupBy("net_id").agg(F.min(F.struct("net_id", "name")).alias("net"))
    named = pins.join(called.select("net_id", F.lit(True).alias("known")), "net_id", "left")
    of_pin = W.partitionBy("component", "pin")
    named = named.repartition("component", "pin").withColumns({"signal": F.min(F.when(F.col("known"), F.col("signal"))).over(of_pin), "known": F.max("known").over(of_pin), "often": F.count("*").over(of_pin) > 1}).where("known AND net_id IS NOT NULL")
    label = F.when(F.col("signal") != "", F.concat("component", F.lit("-"), "pin", F.lit("("), "signal", F.lit(")"))).otherwise(F.concat_ws("-", "component", "pin"))
    entry = F.concat_ws(" ", label, F.length("component"), F.length("pin"), F.col("often").cast("int"))
    whole = F.col("component").isNotNull() & F.col("pin").isNotNull()
    nets = named.groupBy("net_id").agg(F.collect_set(F.when(whole, entry)).alias("pins"), F.collect_set(F.when(~whole, F.struct("component", "pin"))).alias("bare"))
    tail = lambda e, n: F.substring_index(e, " ", -n)
    text_of = lambda e: e.substr(F.lit(1), F.length(e) - F.length(tail(e, 3)) - 1)
    number = lambda e, n: F.substring_index(tail(e, n), " ", 1).cast("int")
    own = F.transform("pins", lambda e, i: F.struct(e.substr(F.lit(1), number(e, 3)).alias("component"), e.substr(number(e, 3) + 2, number(e, 2)).alias("pin"), (number(e, 1) == 1).alias("often"), i.alias("at")))
    bare = F.transform("bare", lambda b: F.struct(b["component"].alias("component"), b["pin"].alias("pin"), F.lit(False).alias("often"), F.lit(-1).alias("at")))
    each = nets.join(called, "net_id", "left").select("net", "pins", F.explode(F.concat(own, bare)).alias("own"))
    each = each.select("own.*", "net", F.when(F.col("own.at") >= 0, F.filter("pins", lambda _, i: i != F.col("own.at"))).alias("others"))
    joined = lambda others: F.when(F.size(others) > 0, F.array_join(F.array_sort(F.transform(others, text_of)), ", "))
    each = each.select("component", "pin", "net", F.when(~F.col("often"), joined("others")).alias("body"), F.when(F.col("often"), F.col("others")).alias("others"))
    lines = each.repartition("component").groupBy("component", "pin").agg(F.min("net")["name"].alias("net"), F.max("body").alias("body"), F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    body = F.coalesce("body", joined("others"), F.lit("(no connections)"))
    padded = F.when(F.length("pin") < 4, F.rpad("pin", 4, " ")).otherwise(F.col("pin"))
    text = F.concat(F.lit("  pin "), padded, F.lit(" ["), "net", F.lit("] -> "), body)
    rank = F.row_number().over(W.partitionBy("component").orderBy(*pin_order(F.col("pin"))))
    rows = lines.select("component", rank.alias("line_no"), text.alias("line"))
    head = F.struct(F.lit(0).alias("line_no"), F.concat("component", F.lit(":")).alias("line"))
    own = F.struct("line_no", "line")
    return rows.select("component", F.explode(F.when(F.col("line_no") == 1, F.array(head, own)).otherwise(F.array(own))).alias("row")).select("component", "row.line_no", "row.line")


def signals(vias: DataFrame, components_: DataFrame, part_pins: DataFrame) -> DataFrame:
    """(id, signal, direction): COMPONENT-PIN and the part pin's direction; Input where any step misses."""
    chain = vias.join(components_, vias["component_id"] == components_["cid"], "left").join(part_pins, ["part_number", "package", "pin_number"], "left")
    return chain.select("id", F.concat_ws("-", F.nullif("component_id", F.lit("")), F.coalesce("pin_name", "pin_number")).alias("signal"), F.coalesce("direction", F.lit("Input")).alias("direction"))


def net_statistics(pins: DataFrame, all_pins: DataFrame) -> DataFrame:
    """One row: components, nets, connections and pins without any."""
    loose = all_pins.join(pins, ["component", "pin"], "left_anti").agg(F.count("*").alias("loose_pins"))
    return pins.agg(F.countDistinct("component").alias("components"), F.countDistinct("net_id").alias("nets"), F.count("*").alias("connections")).crossJoin(loose)  # one row each


def gate_links(functions: DataFrame, components_: DataFrame, pins: DataFrame) -> DataFrame:
    """(net_out, net_in, gate) of logic functions with a single input, by the nets of their pins."""
    single = functions.where(F.size("inputs") == 1).select("part_number", "package", F.col("type").alias("gate"), F.get("inputs", F.lit(0)).cast("string").alias("in_pin"), F.explode("outputs").alias("o"))
    placed = components_.join(single, ["part_number", "package"]).select("component", "gate", "in_pin", F.col("o").cast("string").alias("out_pin"))
    first = pins.groupBy("component", "pin").agg(F.min("net_id").alias("net_id"))
    out = placed.join(first.select("component", F.col("pin").alias("out_pin"), F.col("net_id").alias("net_out")), ["component", "out_pin"])
    both = out.join(first.select("component", F.col("pin").alias("in_pin"), F.col("net_id").alias("net_in")), ["component", "in_pin"])
    return both.where("net_out <> net_in").select("net_out", "net_in", "gate").distinct()


def logic_names(nets: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """nets(net_id, name, manual) with names of gate outputs after their inputs' names: not for manual nets, only over
    names of low priority, only from names of the highest. Each round works on the names of the one before; without
    rounds until nothing changes. Of several gates the smallest (input net, gate) names the output."""
    nets, links, turn = settled(nets), settled(links), 0
    while rounds is None or turn < rounds:
        source = nets.where(net_priority(F.col("name")) == 2).select(F.col("net_id").alias("net_in"), F.col("name").alias("from_name"))
        named = links.join(source, "net_in").withColumn("new", output_name(F.col("gate"), F.col("from_name"))).where("new <> ''")
        best = named.groupBy(F.col("net_out").alias("net_id")).agg(F.min(F.struct("net_in", "gate", "new"))["new"].alias("new"))
        change = F.col("new").isNotNull() & ~F.col("manual") & (net_priority(F.col("name")) < 2)
        step = settled(nets.join(best, "net_id", "left").select("net_id", F.when(change, F.col("new")).otherwise(F.col("name")).alias("name"), "manual", change.alias("changed")))
        nets, turn = step.drop("changed"), turn + 1
        if step.where("changed").isEmpty():
            break
    return nets
