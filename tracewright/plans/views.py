"""Queries on views and edits of record tables, pins and parts, contacts, and schematic symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tracewright.functions import geometry, names
from tracewright.operators import alignment, features, nets, packages, pixels, schematic, selecting, training
from tracewright.operators.near import thinned
from tracewright.plans.inputs import points, table
from tracewright.plans.layout import _PIXELS, _pixels


def _features(spark, d):
    """Vias of the embeddings' points: every third on the back, some confirmed, each in a box."""
    p = points(spark, d)
    box = F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.lit(2).alias("width"), F.lit(2).alias("height"))
    return p.select(
        "id", F.col("id").alias("ord"), "x", "y", F.when(F.col("id") % 3 == 0, "back").otherwise("front").alias("side"), (F.col("id") % 5 + 1.0).alias("radius"), box.alias("bounds"), geometry.point(F.col("x"), F.col("y")).alias("center"),
        F.array().cast("array<struct<x:double,y:double>>").alias("pad_boundary"), (F.col("id") % 4 == 0).alias("both_sides_confirmed"), (F.col("id") % 10 / 10).alias("confidence"), F.lit(None).cast("string").alias("bus"), F.lit(None).cast("string").alias("color"),
    )


_FEATURES = "f AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 100, 6) AS x, round(embedding[2]::DOUBLE * 100, 6) AS y, CASE WHEN vec_id % 3 = 0 THEN 'back' ELSE 'front' END AS side, vec_id % 5 + 1.0 AS radius FROM embeddings)"


def _tracks(spark, d):
    """A track from each point two to the right, and one up."""
    path = F.array(geometry.point(F.col("x") + 0.5, F.col("y")), geometry.point(F.col("x") + 2, F.col("y")), geometry.point(F.col("x") + 2, F.col("y") + 1))
    return _features(spark, d).select("id", "ord", "side", path.alias("points"), F.lit(1.0).alias("width"))


def view_counts(spark, d):
    """How many rows each view of the vias, samples, orders and customers has."""
    f, c = _features(spark, d), table(spark, d, "customer")
    layered = c.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("layer"), (F.col("c_custkey") % 5 - 1).alias("sheet"), F.concat(F.lit("N"), "c_nationkey").alias("net_id"), F.substring("c_mktsegment", 1, 1).alias("prefix"), (F.col("c_acctbal") / 10000).alias("score"), (F.col("c_custkey") % 7 < 3).alias("is_via"))
    symbols = layered.where("id % 50 = 0").select(F.col("id").alias("symbol_id"), F.when(F.col("id") % 100 > 0, F.col("net_id")).otherwise("").alias("net_id"))
    region = F.struct(F.lit(-10).alias("x"), F.lit(-10).alias("y"), F.lit(15).alias("width"), F.lit(15).alias("height"))
    front, back = features.sides_of(f)
    kept, gone = selecting.purged(layered, 0.3)
    chosen = f.where("id % 10 = 0").select("id")
    marked = features.assigned(f, chosen, "DATA", "red")
    views = {
        "layer": selecting.on_layer(layered, 1), "prefix": selecting.with_prefix(layered, "B"), "kept": kept, "positive": selecting.positives(layered), "negative": selecting.negatives(layered),
        "more": selecting.with_samples(layered, layered.where("id <= 10")), "sheet one": selecting.sheet_view(layered, 0), "sheet three": selecting.sheet_view(layered, 3), "net": selecting.wires_of_net(layered, "N5"),
        "of symbols": selecting.wires_of_symbols(layered, symbols), "named": selecting.net_named(layered.withColumn("name", F.col("net_id")), "N7"), "front": front, "back": back, "on back": features.on_side(f, "back"),
        "region": features.in_region(f, region), "confirmed": features.confirmed(f), "hits": features.hits(f, _tracks(spark, d), 1.0, 1.0), "connector": features.connector_hits(f, 1.0, 1.0, "front"),
        "removed": features.removed(f, chosen, ["id"]), "on bus": marked.where("bus = 'DATA' and color = 'red'"), "off bus": features.assigned(marked, chosen, None).where("bus is not null"), "good": features.scored(layered, 0.5),
    }
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("view"), "n") for k, df in views.items()]
    rows += [gone.select(F.lit("gone").alias("view"), F.col("removed").alias("n")), selecting.sample_counts(layered).select(F.lit("balance").alias("view"), (F.col("positive") - F.col("negative")).alias("n")), selecting.buses(marked).select(F.lit("bus").alias("view"), "n")]
    return reduce(lambda a, b: a.unionByName(b), rows)


def track_lengths(spark, d):
    t = selecting.joined_results(_tracks(spark, d).withColumn("layer", F.lit(1)), _tracks(spark, d).where("id % 2 = 0").withColumn("layer", F.lit(2)))
    return selecting.tracks_by_length(t).groupBy("id", "layer").agg(F.count("*").alias("n"), F.round(F.max("length"), 6).alias("length"))


def tracks_at_vias(spark, d):
    """Vias and the tracks that end near them, on their side."""
    return features.tracks_at(_tracks(spark, d), _features(spark, d), 1.0, same_side=True)


def boosted_vias(spark, d):
    return features.boosted(_features(spark, d), 0.5).select("id", F.round("confidence", 6).alias("confidence"))


def _vias(spark, d):
    """Lines as vias of suppliers, on pins by part number."""
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.concat(F.lit("U"), "l_suppkey").alias("component_id"), F.when(k % 6 == 0, "").otherwise((F.col("l_partkey") % 14 + 1).cast("string")).alias("pin_number"), F.when(k % 4 == 0, F.concat(F.lit("SIG"), k)).otherwise("").alias("signal_name"), k.alias("net_id"), F.col("l_linenumber").alias("ord")).dropDuplicates(["id"])


_VIAS = "v AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'U' || l_suppkey AS component_id, CASE WHEN l_orderkey % 6 = 0 THEN '' ELSE (l_partkey % 14 + 1)::VARCHAR END AS pin_number, CASE WHEN l_orderkey % 4 = 0 THEN 'SIG' || l_orderkey ELSE '' END AS signal_name, l_orderkey AS net_id, l_linenumber AS ord FROM lineitem)"


def _parts(spark, d):
    comps = table(spark, d, "supplier").select(F.concat(F.lit("U"), "s_suppkey").alias("component_id"), F.concat(F.lit("P"), F.col("s_suppkey") % 5).alias("part_number"), F.lit("DIP-14").alias("package"))
    ways = F.array(*map(F.lit, ["Input", "Output", "Power"]))
    pins = spark.range(5).select(F.concat(F.lit("P"), "id").alias("part_number"), F.lit("DIP-14").alias("package"), F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(14))).alias("n"))
    return comps, pins.select("part_number", "package", F.col("n").cast("string").alias("pin_number"), F.concat(F.lit("A"), "n").alias("pin_name"), F.element_at(ways, ((F.col("k") + F.col("n")) % 3 + 1).cast("int")).alias("direction"))


_OUT = "(substr(component_id, 2)::BIGINT % 5 + pin_number::BIGINT) % 3"


def taken_pins(spark, d):
    return selecting.taken_pins(_vias(spark, d)).groupBy("taken").agg(F.count("*").alias("n"))


def output_vias(spark, d):
    return selecting.output_pins(_vias(spark, d), *_parts(spark, d))


def via_signals(spark, d):
    comps, pins = _parts(spark, d)
    return nets.signals(_vias(spark, d), comps.withColumnRenamed("component_id", "cid"), pins)


def net_labels(spark, d):
    """Names of orders' nets, by the contacts and vias on them."""
    v = _vias(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("net_id"), F.concat(F.lit("n#"), "o_orderkey").alias("name"), (F.col("o_orderkey") % 9 == 0).alias("manual"), "o_custkey")
    contacts = o.where("o_custkey % 10 = 0").select(F.concat(F.lit("c"), "net_id").alias("id"), F.concat(F.lit("BUS"), "o_custkey").alias("signal_name"), "net_id", F.lit(0).alias("ord"))
    members = v.select("net_id", F.col("id").alias("element_id"), "ord", "component_id").withColumn("ord", F.struct("ord", F.col("element_id").alias("e"))).select("net_id", "element_id", "ord")
    members = members.unionByName(contacts.select("net_id", F.col("id").alias("element_id"), F.struct("ord", F.col("id").alias("e")).alias("ord")))
    return selecting.derived_names(o.drop("o_custkey"), members, contacts.drop("net_id", "ord"), v.drop("net_id", "ord"), selecting.output_pins(v, *_parts(spark, d)))


def new_readings(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") * 37 % 499).alias("x"), (F.col("o_orderkey") * 53 % 491).alias("y"))
    return selecting.new_readings(o.where("id % 2 = 0"), o.where("id % 2 = 1"), 9).select("id")


def pin_maps(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 100).alias("pin_number"), F.col("p_brand").alias("signal_name"), F.col("p_partkey").alias("ord"))
    by_number = selecting.pin_map(p, "pin_number").select(F.col("pin_number").cast("string").alias("key"), "ord")
    return by_number.unionByName(selecting.pin_map(p, "signal_name").select(F.col("signal_name").alias("key"), "ord"))


def _symbols(spark, d):
    k = F.col("p_partkey")
    gate = F.when(k % 5 == 0, "CONNECTOR").otherwise("NAND")
    return table(spark, d, "part").select(F.concat(F.lit("s"), k).alias("id"), F.concat(F.lit("U"), k % 300).alias("component_id"), F.col("p_brand").alias("function_name"), gate.alias("gate_type"), gate.alias("kind"), (k % 3 + 1).cast("int").alias("sheet"), k.alias("ord"), (k % 90 * 7.0).alias("x"), (k % 70 * 9.0).alias("y"), (k % 4 * 90).alias("rotation"), F.lit(1).alias("pins"))


_SYMBOLS = "s AS (SELECT 's' || p_partkey AS id, 'U' || (p_partkey % 300) AS component_id, p_brand AS function_name, p_partkey % 5 = 0 AS edge, (p_partkey % 3 + 1)::INTEGER AS sheet, p_partkey AS ord, p_partkey % 90 * 7.0::DOUBLE AS x, p_partkey % 70 * 9.0::DOUBLE AS y, p_partkey % 4 * 90 AS rotation FROM part)"


def footprints(spark, d):
    return selecting.footprint_paths(_symbols(spark, d), schematic.stable_uuid)


def symbol_units(spark, d):
    return schematic.unit_numbers(_symbols(spark, d))


def sheet_frames(spark, d):
    return schematic.sheet_bounds(_symbols(spark, d))


def placed_symbols(spark, d):
    saved = _symbols(spark, d).where("ord % 7 = 0").select("id", (F.col("x") + 3).alias("x"), (F.col("y") - 4).alias("y"), F.lit(180).cast("long").alias("rotation"))
    return schematic.laid_out(_symbols(spark, d), saved)


def kept_symbols(spark, d):
    """Symbols without edge connectors that nothing else is on the net of; nets are shared by symbols of one brand."""
    pins = _symbols(spark, d).select(F.col("id").alias("symbol_id"), F.when(F.col("ord") % 10 == 0, F.concat(F.lit("x"), "ord")).otherwise(F.col("function_name")).alias("net_id"))
    return schematic.without_stubs(_symbols(spark, d), pins).select("id")


def power_ports(spark, d):
    """Power ports of symbols, with their refs in order and their places."""
    s = _symbols(spark, d)
    ports = schematic.power_refs(s.select("id", F.col("id").alias("symbol_id"), F.lit(7).alias("pin_number"), F.when(F.col("ord") % 2 == 0, "GND").otherwise("VCC").alias("name"), "ord"))
    pins = s.select(F.col("id").alias("symbol_id"), F.lit(7).alias("number"), "ord", "x", "y")
    return ports.select("id", "ref").join(schematic.power_places(ports, pins), "id")


def even_contacts(spark, d):
    k = F.col("c_custkey")
    width = F.when(k % 11 == 0, 30).when(k % 7 == 0, 24).when(k % 13 == 0, 12).otherwise(20)
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("board"), k.alias("id"), (k * 40).cast("int").alias("x"), width.alias("width"), (k * 40 + 10 + k % 3 * 2.0).alias("center"))
    return selecting.even_widths(c)


def moved_grids(spark, d):
    """Pins of fourteen for each part, moved to where most were found; some were found far off."""
    k, n = F.col("p_partkey"), F.col("pin")
    p = table(spark, d, "part").select(k, F.explode(F.sequence(F.lit(1), F.lit(14))).alias("pin"))
    p = p.select(k.alias("id"), "pin", (n * 10.0).alias("x"), F.lit(0.0).alias("y"), (n * 10.0 + k % 5 + F.when(n == 3, 50).otherwise(0)).alias("dx"), (k % 3 * 1.0).alias("dy"), ((k + n) % 4 > 0).alias("found"))
    out = selecting.shifted_grid(p, 30.0)
    return out.select("id", "pin", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def marker_axes(spark, d):
    k = F.col("c_custkey")
    m = table(spark, d, "customer").select(F.col("c_nationkey").alias("img_id"), (k * 7 % 40).alias("value"), (k % 3 * 60.0).alias("x"), (k % 97 * 1.0).alias("y"))
    return schematic.axis_runs(m)


def sized_parts(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("template"), (F.col("n_nationkey") * 2.0).alias("width_low"), (F.col("n_nationkey") * 2.0 + 0.9).alias("width_high"), F.lit(20.0).alias("height_low"), F.lit(26.0).alias("height_high"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 1.0).alias("width_mm"), (F.col("p_retailprice") / 60).alias("height_mm"))
    return packages.template_matches(p, t)


def contact_lines(spark, d):
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("board"), (F.col("c_custkey") * 1.0).alias("x"), F.col("c_acctbal").alias("y"))
    return alignment.contact_angle(s).withColumn("angle", F.round("angle", 6))


def coarse_contacts(spark, d):
    """Contacts of two sides by their place from the mean, one to one."""
    s = table(spark, d, "supplier")
    side = lambda far, odd: s.where(F.col("s_suppkey") % 2 == odd).select((F.col("s_nationkey") % 4).alias("board"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") + far).alias("x"))
    m = alignment.coarse_match(side(0, 0), side(5000, 1), 300.0)
    return m.select("left_id", "right_id", F.round("dist", 6).alias("dist"))


def border_colors(spark, d):
    return pixels.border_color(_pixels(spark, d).groupBy("img_id", "x", "y").agg(*(F.max(c).alias(c) for c in "hsv")))


def dense_boxes(spark, d):
    return pixels.dense_bounds(pixels.matching_cells(_pixels(spark, d), 4, F.col("v") < 128, 0.49), 16, 12, 0.4)


def first_boxes(spark, d):
    """Boxes of customers less those that equal an earlier one of their nation to less than a unit."""
    k = F.col("c_custkey")
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("board"), k.alias("id"), (k % 10 * 2.0).alias("x"), (k % 4 * 3.0).alias("y"), (k % 3 * 2.0).alias("width"), F.lit(5.0).alias("height"))
    b = training.apart(b)
    return thinned(b, training.same_box(b), "id").select("id")


def record_kinds(spark, d):
    """Directions by code or text, and weak names, of parts."""
    k = F.col("p_partkey")
    way = F.when(k % 7 < 5, (k % 7).cast("string")).when(k % 7 == 5, "Output").otherwise("any")
    name = F.when(k % 3 == 0, F.concat(F.lit("net-"), k)).when(k % 3 == 1, F.concat(F.lit("U1."), k)).otherwise(F.concat(F.lit("GND"), k))
    return table(spark, d, "part").select(k.alias("id"), names.direction(way).alias("direction"), names.is_low_priority(name).alias("weak"), names.is_ground(name).alias("ground"))


def renumbered_vias(spark, d):
    """Vias of suppliers in two rows, numbered round."""
    k = F.col("l_linenumber")
    pts = table(spark, d, "supplier").select(F.concat(F.lit("U"), "s_suppkey").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(13))).alias("id"))
    pts = pts.select("component", "id", (F.floor(F.col("id") / 7) * 60.0).alias("x"), (F.col("id") % 7 * 20.0).alias("y"))
    return packages.renumbered(pts)


def guessed_pins(spark, d):
    """The pins of packages nearest to vias that lie a little off them."""
    k = F.col("p_partkey")
    comps = table(spark, d, "part").select(k.alias("id"), F.lit("DIP-14").alias("package"), F.lit(0.0).alias("bx"), F.lit(0.0).alias("by"), F.lit(100.0).alias("bw"), F.lit(300.0).alias("bh"), F.lit(0.0).alias("rotation"))
    places = packages.pin_places(comps, 254.0).select(F.col("id").alias("component"), "pin", "x", "y")
    vias = places.select("component", F.concat_ws(".", "component", "pin").alias("id"), (F.col("x") + 4).alias("x"), (F.col("y") - 5).alias("y"))
    return packages.guessed_pin(vias, places)


QUERIES = {f.__name__: f for f in (view_counts, track_lengths, tracks_at_vias, boosted_vias, taken_pins, output_vias, via_signals, net_labels, new_readings, pin_maps, footprints, symbol_units, sheet_frames, placed_symbols, kept_symbols, power_ports, even_contacts, moved_grids, marker_axes, sized_parts, contact_lines, coarse_contacts, border_colors, dense_boxes, first_boxes, record_kinds, renumbered_vias, guessed_pins)}

_UUID = "(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] FROM (SELECT sha256({}) AS h))"

SQL = {
    "view_counts": f"""WITH {_FEATURES}, c AS (SELECT c_custkey AS id, c_nationkey % 3 AS layer, CASE WHEN c_custkey % 5 <= 1 THEN 1 ELSE c_custkey % 5 - 1 END AS sheet, c_nationkey AS net, c_mktsegment[1:1] AS prefix, c_acctbal / 10000 AS score, c_custkey % 7 < 3 AS is_via FROM customer),
h AS (SELECT id FROM f WHERE sqrt(pow(1 - x, 2) + pow(1 - y, 2)) <= radius),
t AS (SELECT id FROM f WHERE (1 >= x + 0.5 AND 1 <= x + 2 AND abs(1 - y) <= 0.5) OR (1 BETWEEN y AND y + 1 AND abs(x + 2 - 1) <= 0.5) OR sqrt(pow(x + 0.5 - 1, 2) + pow(y - 1, 2)) <= 0.5 OR sqrt(pow(x + 2 - 1, 2) + pow(y - 1, 2)) <= 0.5 OR sqrt(pow(x + 2 - 1, 2) + pow(y, 2)) <= 0.5)
SELECT 'layer' AS view, count(*) AS n FROM c WHERE layer = 1 UNION ALL SELECT 'prefix', count(*) FROM c WHERE prefix = 'B' UNION ALL SELECT 'kept', count(*) FROM c WHERE score >= 0.3 UNION ALL SELECT 'gone', count(*) FROM c WHERE score < 0.3
UNION ALL SELECT 'positive', count(*) FROM c WHERE is_via UNION ALL SELECT 'negative', count(*) FROM c WHERE NOT is_via UNION ALL SELECT 'balance', count(*) FILTER (WHERE is_via) - count(*) FILTER (WHERE NOT is_via) FROM c UNION ALL SELECT 'more', count(*) + count(*) FILTER (WHERE id <= 10) FROM c
UNION ALL SELECT 'sheet one', count(*) FROM c WHERE sheet = 1 UNION ALL SELECT 'sheet three', count(*) FROM c WHERE sheet = 3 UNION ALL SELECT 'net', count(*) FROM c WHERE net = 5
UNION ALL SELECT 'of symbols', count(*) FROM c JOIN (SELECT DISTINCT id AS s, net FROM c WHERE id % 100 = 50) y ON y.net = c.net UNION ALL SELECT 'named', least(count(*), 1) FROM c WHERE net = 7
UNION ALL SELECT 'front', count(*) FROM f WHERE side = 'front' UNION ALL SELECT 'back', count(*) FROM f WHERE side = 'back' UNION ALL SELECT 'on back', count(*) FROM f WHERE side = 'back' UNION ALL SELECT 'region', count(*) FROM f WHERE trunc(x) < 5 AND trunc(x) > -12 AND trunc(y) < 5 AND trunc(y) > -12
UNION ALL SELECT 'confirmed', count(*) FROM f WHERE id % 4 = 0 UNION ALL SELECT 'hits', (SELECT count(*) FROM h) + (SELECT count(*) FROM t) UNION ALL SELECT 'connector', least(count(*), 1) FROM f WHERE side = 'front' AND 1 BETWEEN trunc(x) AND trunc(x) + 2 AND 1 BETWEEN trunc(y) AND trunc(y) + 2
UNION ALL SELECT 'removed', count(*) FROM f WHERE id % 10 <> 0 UNION ALL SELECT 'on bus', count(*) FROM f WHERE id % 10 = 0 UNION ALL SELECT 'bus', count(*) FROM f WHERE id % 10 = 0 UNION ALL SELECT 'off bus', 0 UNION ALL SELECT 'good', count(*) FROM c WHERE score >= 0.5""",
    "track_lengths": f"WITH {_FEATURES} SELECT id, 1 AS layer, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS n, 2.5::DOUBLE AS length FROM f",
    "tracks_at_vias": f"WITH {_FEATURES}, e AS (SELECT id, side, x + 0.5 AS x, y FROM f UNION ALL SELECT id, side, x + 2, y + 1 FROM f) SELECT DISTINCT f.id AS via_id, e.id AS trace_id FROM f JOIN e ON e.side = f.side AND sqrt((f.x - e.x) * (f.x - e.x) + (f.y - e.y) * (f.y - e.y)) <= 1.0",
    "boosted_vias": "SELECT vec_id AS id, round(CASE WHEN vec_id % 4 = 0 THEN vec_id % 10 / 10 + (1 - vec_id % 10 / 10) * 0.5 ELSE vec_id % 10 / 10 END, 6)::DOUBLE AS confidence FROM embeddings",
    "taken_pins": f"WITH {_VIAS}, n AS (SELECT pin_number <> '' AND count(*) OVER (PARTITION BY component_id, pin_number) > 1 AS taken FROM v) SELECT taken, count(*) AS n FROM n GROUP BY 1",
    "output_vias": f"WITH {_VIAS} SELECT id FROM v WHERE pin_number <> '' AND {_OUT} = 1",
    "via_signals": f"WITH {_VIAS} SELECT id, component_id || '-' || CASE WHEN pin_number = '' THEN '' ELSE 'A' || pin_number END AS signal, CASE WHEN pin_number = '' THEN 'Input' ELSE ['Input', 'Output', 'Power'][({_OUT} + 1)::INTEGER] END AS direction FROM v".replace("{_OUT} + 1", f"{_OUT} + 1"),
    "net_labels": f"WITH {_VIAS}, a AS (SELECT net_id, arg_min(signal_name, (ord, id)) FILTER (WHERE signal_name <> '' AND pin_number <> '' AND {_OUT.replace('pin_number::BIGINT', 'coalesce(try_cast(pin_number AS BIGINT), 0)')} = 1) AS b, arg_min(component_id || '.' || pin_number, (ord, id)) FILTER (WHERE pin_number <> '') AS c FROM v GROUP BY 1) SELECT o_orderkey AS net_id, CASE WHEN o_orderkey % 9 = 0 THEN 'n#' || o_orderkey WHEN o_custkey % 10 = 0 THEN 'BUS' || o_custkey ELSE coalesce(b, c, 'n') END AS name FROM orders LEFT JOIN a ON a.net_id = o_orderkey",
    "new_readings": "WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS text, o_orderkey * 37 % 499 AS x, o_orderkey * 53 % 491 AS y FROM orders) SELECT id FROM o a WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM o b WHERE b.id % 2 = 1 AND b.text = a.text AND abs(a.x - b.x) < 9 AND abs(a.y - b.y) < 9)",
    "pin_maps": "SELECT (p_partkey % 100)::VARCHAR AS key, max(p_partkey) AS ord FROM part GROUP BY 1 UNION ALL SELECT p_brand, max(p_partkey) FROM part GROUP BY 1",
    "footprints": f"WITH {_SYMBOLS}, m AS (SELECT component_id, arg_min(id, ord) AS id, arg_min(sheet, ord) AS sheet FROM s WHERE NOT edge GROUP BY 1) SELECT component_id, CASE WHEN sheet > 1 THEN '/' || {_UUID.format(chr(39) + 'sheet:sheet-' + chr(39) + ' || sheet')} ELSE '' END || '/' || {_UUID.format(chr(39) + 'symbol:' + chr(39) + ' || id')} AS path FROM m",
    "symbol_units": f"WITH {_SYMBOLS}, m AS (SELECT component_id, function_name, min(ord) AS o FROM s GROUP BY 1, 2) SELECT component_id, function_name, row_number() OVER (PARTITION BY component_id ORDER BY o)::INTEGER AS unit FROM m",
    "sheet_frames": f"WITH {_SYMBOLS} SELECT sheet, min(x) - 50 AS x1, min(y) - 50 AS y1, max(x) + 50 AS x2, max(y) + 50 AS y2 FROM s GROUP BY 1",
    "placed_symbols": f"WITH {_SYMBOLS} SELECT id, round((x + CASE WHEN ord % 7 = 0 THEN 3 ELSE 0 END) / 5) * 5 AS x, round((y - CASE WHEN ord % 7 = 0 THEN 4 ELSE 0 END) / 5) * 5 AS y, CASE WHEN ord % 7 = 0 THEN 180 ELSE rotation END AS rotation, ord % 7 = 0 AS restored FROM s",
    "kept_symbols": f"WITH {_SYMBOLS} SELECT id FROM s WHERE NOT edge OR ord % 10 <> 0",
    "power_ports": f"WITH {_SYMBOLS} SELECT id, '#PWR' || lpad(row_number() OVER (ORDER BY ord)::VARCHAR, greatest(3, length(row_number() OVER (ORDER BY ord)::VARCHAR))::INTEGER, '0') AS ref, x, y + CASE WHEN ord % 2 = 0 THEN 40 ELSE -40 END AS y FROM s",
    "even_contacts": """WITH c AS (SELECT c_nationkey AS board, c_custkey AS id, c_custkey * 40 AS x, CASE WHEN c_custkey % 11 = 0 THEN 30 WHEN c_custkey % 7 = 0 THEN 24 WHEN c_custkey % 13 = 0 THEN 12 ELSE 20 END AS width, c_custkey * 40 + 10 + c_custkey % 3 * 2.0::DOUBLE AS center FROM customer),
m AS (SELECT board, list_sort(list(width))[count(*) // 2 + 1] AS m FROM c GROUP BY 1),
e AS (SELECT c.*, m, x - (trunc(center)::BIGINT - m // 2) AS l, x + width - (trunc(center)::BIGINT + m // 2) AS r, width > trunc(m * 1.15) AS wide FROM c JOIN m ON m.board = c.board WHERE width <= trunc(m * 1.30) AND width >= trunc(m * 0.75)),
t AS (SELECT *, CASE WHEN wide AND l < 0 AND abs(l) > abs(r) THEN least(-l, width - m) ELSE 0 END AS tl FROM e), u AS (SELECT *, CASE WHEN wide AND tl = 0 AND r > 0 THEN least(r, width - m) ELSE 0 END AS tr FROM t)
SELECT board, id, (x + tl)::INTEGER AS x, (width - tl - tr)::INTEGER AS width, CASE WHEN wide THEN x + tl + (width - tl - tr) / 2 ELSE center END AS center FROM u""",
    "moved_grids": """WITH p AS (SELECT p_partkey AS k, unnest(range(1, 15)) AS n FROM part), q AS (SELECT k, n, k % 5 + CASE WHEN n = 3 THEN 50 ELSE 0 END AS ox, k % 3 AS oy, (k + n) % 4 > 0 AS found FROM p),
a AS (SELECT k, avg(ox) AS ax, avg(oy) AS ay FROM q WHERE found GROUP BY 1), b AS (SELECT q.k, avg(ox) AS bx, avg(oy) AS by_ FROM q JOIN a ON a.k = q.k WHERE found AND sqrt(pow(ox - ax, 2) + pow(oy - ay, 2)) <= 9.0 GROUP BY 1)
SELECT q.k AS id, n::INTEGER AS pin, round(n * 10 + coalesce(bx, 0), 6)::DOUBLE AS x, round(coalesce(by_, 0), 6)::DOUBLE AS y FROM q LEFT JOIN b ON b.k = q.k""",
    "marker_axes": """WITH m AS (SELECT c_nationkey AS img_id, c_custkey * 7 % 40 AS value, floor(c_custkey % 3 * 60 / 50)::BIGINT AS bucket, c_custkey % 3 * 60.0 AS x, c_custkey % 97 * 1.0 AS y FROM customer),
u AS (SELECT *, CASE WHEN value - lag(value) OVER w BETWEEN 1 AND 2 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY img_id, bucket ORDER BY value, x, y)),
r AS (SELECT *, sum(new) OVER (PARTITION BY img_id, bucket ORDER BY value, x, y ROWS UNBOUNDED PRECEDING) AS run FROM u),
g AS (SELECT img_id, bucket, min(value) AS first, max(value) AS last, count(*) AS n FROM r GROUP BY img_id, bucket, run HAVING count(*) >= 3)
SELECT img_id, bucket, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, bucket, first, last) AS k FROM g) WHERE k = 1""",
    "sized_parts": """WITH p AS (SELECT p_partkey AS id, p_size * 1.0::DOUBLE AS w, p_retailprice / 60 AS h FROM part), b AS (SELECT id, 0 AS turned, w, h FROM p UNION ALL SELECT id, 1, h, w FROM p),
m AS (SELECT b.id, n_nationkey AS template, turned, row_number() OVER (PARTITION BY b.id ORDER BY turned, n_nationkey) AS k FROM b JOIN nation ON w BETWEEN n_nationkey * 2.0 AND n_nationkey * 2.0 + 0.9 AND h BETWEEN 20.0 AND 26.0)
SELECT p.id, template, turned = 1 AS turned, CASE WHEN template IS NOT NULL THEN 'template' WHEN (abs(least(w, h) - 7.62) <= 1.5 OR abs(least(w, h) - 15.24) <= 1.5) THEN 'DIP width' ELSE 'no size fits' END AS reason FROM p LEFT JOIN m ON m.id = p.id AND m.k = 1""",
    "contact_lines": "SELECT c_nationkey AS board, round(coalesce(degrees(atan(regr_slope(c_acctbal, c_custkey * 1.0))), 0.0), 6) AS angle FROM customer GROUP BY 1",
    "coarse_contacts": """WITH RECURSIVE s AS (SELECT s_nationkey % 4 AS board, s_suppkey AS id, s_suppkey % 2 AS odd, s_acctbal + CASE WHEN s_suppkey % 2 = 1 THEN 5000 ELSE 0 END AS x FROM supplier), c AS (SELECT *, x - avg(x) OVER (PARTITION BY board, odd) AS a FROM s),
pairs AS (SELECT f.id AS left_id, b.id AS right_id, abs(f.a - b.a) AS dist FROM c f JOIN c b ON f.board = b.board AND f.odd = 0 AND b.odd = 1 WHERE abs(f.a - b.a) <= 300), ranked AS (SELECT *, row_number() OVER (ORDER BY dist, left_id, right_id) AS r FROM pairs),
pick AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS ls, []::BIGINT[] AS rs, false AS hit UNION ALL SELECT k.r, CASE WHEN ok THEN list_append(ls, k.left_id) ELSE ls END, CASE WHEN ok THEN list_append(rs, k.right_id) ELSE rs END, ok FROM (SELECT ranked.*, ls, rs, NOT list_contains(ls, left_id) AND NOT list_contains(rs, right_id) AS ok FROM pick JOIN ranked ON ranked.r = pick.r + 1) k)
SELECT left_id, right_id, round(dist, 6) AS dist FROM pick JOIN ranked USING (r) WHERE hit""",
    "border_colors": f"WITH {_PIXELS}, p AS (SELECT img_id, x, y, max(h) AS h, max(s) AS s, max(v) AS v FROM px GROUP BY 1, 2, 3), b AS (SELECT img_id AS i, max(x) AS mx, max(y) AS my FROM p GROUP BY 1), e AS (SELECT p.*, (x = 0)::INTEGER + (x = mx)::INTEGER + (y = 0)::INTEGER + (y = my)::INTEGER AS t FROM p JOIN b ON i = img_id) SELECT img_id, " + ", ".join(f"floor(sum({c} * t) / sum(t))::BIGINT AS {c}" for c in "hsv") + " FROM e WHERE t > 0 GROUP BY 1",
    "dense_boxes": f"""WITH {_PIXELS}, c AS (SELECT img_id, x // 4 AS cx, y // 4 AS cy FROM px GROUP BY 1, 2, 3 HAVING avg((v < 128)::INTEGER) > 0.49), xs AS (SELECT img_id, min(cx) AS x1, max(cx) AS x2 FROM (SELECT img_id, cx FROM c GROUP BY 1, 2 HAVING count(*) >= 4.8) GROUP BY 1), ys AS (SELECT img_id, min(cy) AS y1, max(cy) AS y2 FROM (SELECT img_id, cy FROM c GROUP BY 1, 2 HAVING count(*) >= 6.4) GROUP BY 1),
w AS (SELECT img_id, min(cx) AS a, min(cy) AS b, max(cx) AS d, max(cy) AS e FROM c GROUP BY 1) SELECT w.img_id, coalesce(x1, a) AS x1, coalesce(y1, b) AS y1, coalesce(x2, d) AS x2, coalesce(y2, e) AS y2 FROM w LEFT JOIN xs ON xs.img_id = w.img_id LEFT JOIN ys ON ys.img_id = w.img_id""",
    "first_boxes": "SELECT min(c_custkey) AS id FROM customer GROUP BY c_nationkey, c_custkey % 10, c_custkey % 4, c_custkey % 3",
    "record_kinds": "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'Input' WHEN 1 THEN 'Output' WHEN 2 THEN 'Bidirectional' WHEN 3 THEN 'Power' WHEN 4 THEN 'Ground' WHEN 5 THEN 'Output' ELSE 'Bidirectional' END AS direction, p_partkey % 3 < 2 AS weak, p_partkey % 3 = 2 AS ground FROM part",
    "renumbered_vias": "SELECT 'U' || s_suppkey AS component, id::INTEGER AS id, CASE WHEN id < 7 THEN id + 1 ELSE 21 - id END::INTEGER AS pin FROM supplier, range(14) r(id)",
    "guessed_pins": "SELECT p_partkey || '.' || n AS id, n::INTEGER AS pin FROM part, range(1, 15) r(n)",
}
