"""Queries on nets, graphs and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.names import base_name, better_name, is_power, net_priority
from tracewright.operators.graph import components, layers
from tracewright.operators.lookup import looked_up
from tracewright.operators.loop import stored
from tracewright.operators.near import dense_filter, greedy_match, near_join, nearest, nearest_k, thinned, vote_peak
from tracewright.operators.nets import disambiguated, net_statistics, pin_connections
from tracewright.operators.schematic import bus_families, sheet_connectors
from tracewright.plans.inputs import DIST, EDGES, POINTS, SIDES, node_name, numbered_edges, part_supplier_edges, points, sides, table

TOLERANCE = 1.0


def net_components(spark, d):
    """Numbers take the place of names while components are found, as they are a fraction of these on disk."""
    edges = numbered_edges(spark, d)
    if edges is None:
        return components(part_supplier_edges(spark, d), stored)
    of = components(edges, stored)
    roots = stored(of.groupBy("root").agg(F.min(node_name(F.col("node"))).alias("name")))
    return looked_up(of, "root", roots, keep=stored).select(node_name(F.col("node")).alias("node"), F.col("name").alias("root"))


def component_sizes(spark, d):
    edges = numbered_edges(spark, d)
    if edges is None:
        return components(part_supplier_edges(spark, d), stored).groupBy("root").agg(F.count("*").alias("size"))
    return components(edges, stored).groupBy("root").agg(F.min(node_name(F.col("node"))).alias("name"), F.count("*").alias("size")).select(F.col("name").alias("root"), "size")


def _order_pins(spark, d):
    """Nets are orders; pins are their lines' parts at suppliers."""
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_orderkey").alias("net_id"), F.concat(F.lit("S"), "l_suppkey").alias("component"), F.col("l_partkey").cast("string").alias("pin")).distinct()


def pin_links(spark, d):
    return pin_connections(_order_pins(spark, d))


def netlist_figures(spark, d):
    pins = _order_pins(spark, d)
    every = table(spark, d, "part").select(F.concat(F.lit("S"), F.col("p_partkey") % 100 + 1).alias("component"), F.col("p_partkey").cast("string").alias("pin"))
    return net_statistics(pins, every)


def near_pairs(spark, d):
    f, b = sides(spark, d)
    return near_join(f, b, TOLERANCE).withColumn("dist", F.round("dist", 9))


def via_match(spark, d):
    f, b = sides(spark, d)
    return greedy_match(near_join(f, b, TOLERANCE)).withColumn("dist", F.round("dist", 9))


def nearest_part(spark, d):
    f, b = sides(spark, d)
    return nearest(f, b, 3.0).withColumn("dist", F.round("dist", 9))


def nearest_three(spark, d):
    f, b = sides(spark, d)
    return nearest_k(near_join(f, b, 3.0), 3).withColumn("dist", F.round("dist", 9))


def sparse_points(spark, d):
    return dense_filter(points(spark, d), 2.0, 2).select("id", "x", "y")


def thin_points(spark, d):
    p = points(spark, d)
    return thinned(p, near_join(p, p, TOLERANCE, strict=True), "id").select("id", "x", "y")


def peak_offset(spark, d):
    f, b = sides(spark, d)
    pairs = near_join(f, b, 12.0).join(f.select(F.col("id").alias("left_id"), F.col("x").alias("x1"), F.col("y").alias("y1")), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("x").alias("x2"), F.col("y").alias("y2")), "right_id")
    return vote_peak(pairs.select((F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy")), 5.0)


def match_error(spark, d):
    """Root mean square distance of the matched vias, and their number."""
    f, b = sides(spark, d)
    m = greedy_match(near_join(f, b, TOLERANCE))
    return m.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sqrt(F.avg(F.col("dist") * F.col("dist"))), F.lit(0.0)), 9).alias("rms"))


def unmatched_front(spark, d):
    f, b = sides(spark, d)
    return f.join(near_join(f, b, TOLERANCE).select(F.col("left_id").alias("id")), "id", "left_anti").select("id")


def net_names(spark, d):
    """Disambiguated names of nets that are called after parts."""
    nets = table(spark, d, "part").select(F.format_string("net-%05d", "p_partkey").alias("net_id"), F.col("p_name").alias("name"))
    return disambiguated(nets)


def name_priority(spark, d):
    names = _names(spark, d)
    better = better_name(F.col("a"), F.col("b"))
    return names.select("id", net_priority(F.col("a")).alias("pa"), net_priority(F.col("b")).alias("pb"), better.alias("better"), base_name(F.col("c")).alias("base"), is_power(F.col("c")).alias("power"))


def _names(spark, d):
    key = F.col("p_partkey")
    a = F.when(key % 3 == 0, F.format_string("net-%03d", key)).when(key % 3 == 1, F.concat(F.lit("U"), key, F.lit(".1"))).otherwise(F.col("p_name"))
    b = F.when(key % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("U"), key, F.lit(".22")))
    c = F.when(key % 5 == 0, F.concat(F.lit("VCC#"), key)).otherwise(F.concat(F.col("p_name"), F.lit("#2#3")))
    return table(spark, d, "part").select(key.alias("id"), a.alias("a"), b.alias("b"), c.alias("c"))


def bus_groups(spark, d):
    """Buses among nets that are called after customers, by the number of their nation."""
    nets = table(spark, d, "customer").select(F.col("c_custkey").alias("net_id"), F.concat(F.lit("A"), F.col("c_nationkey") % 7, F.lit("_"), F.col("c_custkey")).alias("name"))
    return bus_families(nets).select("net_id", "name", "family", "bit")


def off_sheet(spark, d):
    o = table(spark, d, "orders")
    pins = o.select(F.col("o_custkey").alias("net_id"), F.when(F.col("o_custkey") % 100 == 0, "GND1").otherwise("sig").alias("name"), (F.col("o_orderkey") % 4).cast("int").alias("sheet"))
    return sheet_connectors(pins)


def signal_layers(spark, d):
    """Layers of a signal graph from nations to regions and on to a sink."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    a = n.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    b = n.where("n_nationkey % 4 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("n"), F.col("n_nationkey") + 1).alias("b")).where("a <> 'n24'")
    return layers(a.unionByName(b).unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("a"), F.lit("out").alias("b"))))


QUERIES = {f.__name__: f for f in (net_components, component_sizes, pin_links, netlist_figures, near_pairs, via_match, nearest_part, nearest_three, sparse_points, thin_points, peak_offset, match_error, unmatched_front, net_names, name_priority, bus_groups, off_sheet, signal_layers)}

_REACH = f"""WITH RECURSIVE {EDGES},
both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
comp(node, root) USING KEY (node) AS (
  SELECT a, min(least(a, b)) FROM both_ GROUP BY a
  UNION SELECT both_.b, min(c.root) FROM comp c JOIN both_ ON both_.a = c.node JOIN recurring.comp o ON o.node = both_.b WHERE c.root < o.root GROUP BY both_.b)"""
_PAIRS = f"WITH RECURSIVE {SIDES}, pairs AS (SELECT f.id AS left_id, b.id AS right_id, {DIST} AS dist FROM f JOIN b ON {DIST} <= {{tol}})"
_PINS = "WITH pins AS (SELECT DISTINCT l_orderkey AS net_id, 'S' || l_suppkey AS component, l_partkey::VARCHAR AS pin FROM lineitem)"
_MATCH = _PAIRS.format(tol=1.0) + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY dist, left_id, right_id) AS r FROM pairs),
pick AS (
  SELECT 0::BIGINT AS r, []::BIGINT[] AS ls, []::BIGINT[] AS rs, false AS hit
  UNION ALL
  SELECT k.r, CASE WHEN ok THEN list_append(ls, k.left_id) ELSE ls END, CASE WHEN ok THEN list_append(rs, k.right_id) ELSE rs END, ok
  FROM (SELECT ranked.*, ls, rs, NOT list_contains(ls, left_id) AND NOT list_contains(rs, right_id) AS ok FROM pick JOIN ranked ON ranked.r = pick.r + 1) k),
matched AS (SELECT ranked.left_id, ranked.right_id, ranked.dist FROM pick JOIN ranked USING (r) WHERE hit)"""
_NAMES = """WITH n AS (
  SELECT p_partkey AS id, p_name,
    CASE WHEN p_partkey % 3 = 0 THEN 'net-' || lpad(p_partkey::VARCHAR, greatest(3, length(p_partkey::VARCHAR))::INTEGER, '0') WHEN p_partkey % 3 = 1 THEN 'U' || p_partkey || '.1' ELSE p_name END AS a,
    CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'U' || p_partkey || '.22' END AS b,
    CASE WHEN p_partkey % 5 = 0 THEN 'VCC#' || p_partkey ELSE p_name || '#2#3' END AS c FROM part),
p AS (SELECT *, CASE WHEN regexp_matches(a, '^net-[0-9]+$') THEN 0 WHEN contains(a, '.') THEN 1 ELSE 2 END AS pa, CASE WHEN regexp_matches(b, '^net-[0-9]+$') THEN 0 WHEN contains(b, '.') THEN 1 ELSE 2 END AS pb FROM n)"""

SQL = {
    "net_components": _REACH + " SELECT node, root FROM comp",
    "component_sizes": _REACH + " SELECT root, count(*) AS size FROM comp GROUP BY root",
    "pin_links": _PINS + " SELECT DISTINCT p.component, p.pin, o.component AS other_component, o.pin AS other_pin FROM pins p JOIN pins o ON p.net_id = o.net_id AND (p.component <> o.component OR p.pin <> o.pin)",
    "netlist_figures": _PINS + ", every_ AS (SELECT 'S' || (p_partkey % 100 + 1) AS component, p_partkey::VARCHAR AS pin FROM part) SELECT count(DISTINCT component) AS components, count(DISTINCT net_id) AS nets, count(*) AS connections, (SELECT count(*) FROM every_ e WHERE NOT EXISTS (SELECT 1 FROM pins q WHERE q.component = e.component AND q.pin = e.pin)) AS loose_pins FROM pins",
    "near_pairs": _PAIRS.format(tol=1.0) + " SELECT left_id, right_id, round(dist, 9) AS dist FROM pairs",
    "via_match": _MATCH + " SELECT left_id, right_id, round(dist, 9) AS dist FROM matched",
    "match_error": _MATCH + " SELECT count(*) AS n, round(coalesce(sqrt(avg(dist * dist)), 0.0), 9) AS rms FROM matched",
    "nearest_part": _PAIRS.format(tol=3.0) + " SELECT left_id, right_id, round(dist, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY dist, right_id) AS k FROM pairs) WHERE k = 1",
    "nearest_three": _PAIRS.format(tol=3.0) + " SELECT left_id, right_id, round(dist, 9) AS dist, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY dist, right_id) AS rank FROM pairs) WHERE rank <= 3",
    "sparse_points": f"WITH {POINTS} SELECT f.id, any_value(f.x) AS x, any_value(f.y) AS y FROM points f LEFT JOIN points b ON f.id <> b.id AND {DIST} <= 2.0 GROUP BY f.id HAVING count(b.id) <= 2",
    "thin_points": f"""WITH RECURSIVE {POINTS}, ranked AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM points),
near AS (SELECT f.id AS id, list(b.id) AS others FROM points f JOIN points b ON f.id > b.id AND {DIST} < 1.0 GROUP BY f.id),
pick AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL
  SELECT n.r, CASE WHEN n.others IS NULL OR NOT list_has_any(kept, n.others) THEN list_append(kept, n.id) ELSE kept END FROM pick JOIN (SELECT ranked.r, ranked.id, near.others FROM ranked LEFT JOIN near ON near.id = ranked.id) n ON n.r = pick.r + 1),
last AS (SELECT unnest(kept) AS id FROM pick WHERE r = (SELECT max(r) FROM pick))
SELECT id, x, y FROM points WHERE id IN (SELECT id FROM last)""",
    "peak_offset": _PAIRS.format(tol=12.0) + """, o AS (SELECT floor((b.x - f.x) / 5)::BIGINT AS bx, floor((b.y - f.y) / 5)::BIGINT AS by_, count(*) AS n FROM pairs JOIN f ON f.id = left_id JOIN b ON b.id = right_id GROUP BY 1, 2),
s AS (SELECT o.bx, o.by_, (SELECT sum(n) FROM o q WHERE abs(q.bx - o.bx) <= 1 AND abs(q.by_ - o.by_) <= 1)::BIGINT AS score FROM o)
SELECT bx, by_ AS by, score FROM s WHERE score >= 3 ORDER BY score DESC, (bx + 0.5) * (bx + 0.5) + (by_ + 0.5) * (by_ + 0.5), bx, by_ LIMIT 1""",
    "unmatched_front": f"WITH {SIDES} SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE {DIST} <= 1.0)",
    "net_names": "WITH n AS (SELECT 'net-' || lpad(p_partkey::VARCHAR, greatest(5, length(p_partkey::VARCHAR))::INTEGER, '0') AS net_id, p_name AS base FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY net_id) AS k FROM n) SELECT net_id, CASE WHEN k = 1 THEN base ELSE base || '#' || k END AS name FROM r",
    "name_priority": _NAMES + " SELECT id, pa, pb, CASE WHEN pa > pb THEN a WHEN pb > pa THEN b WHEN strlen(a) <= strlen(b) THEN a ELSE b END AS better, CASE WHEN id % 5 = 0 THEN 'VCC' ELSE p_name || '#2' END AS base, (upper(c) LIKE 'VCC%' OR upper(c) LIKE 'GND%' OR upper(c) LIKE 'VDD%' OR upper(c) LIKE 'VSS%' OR upper(c) IN ('VEE', 'AGND', 'DGND')) AS power FROM p",
    "bus_groups": "WITH n AS (SELECT c_custkey AS net_id, 'A' || (c_nationkey % 7) || '_' || c_custkey AS name FROM customer), s AS (SELECT *, regexp_extract(name, '^(.+?)([0-9]+)$', 1) AS family, regexp_extract(name, '^(.+?)([0-9]+)$', 2) AS bit FROM n) SELECT net_id, name, family, bit FROM s WHERE family IN (SELECT family FROM s GROUP BY family HAVING count(*) >= 4)",
    "off_sheet": "WITH p AS (SELECT DISTINCT o_custkey AS net_id, CASE WHEN o_orderkey % 4 <= 0 THEN 1 ELSE o_orderkey % 4 END::INTEGER AS sheet FROM orders WHERE o_custkey % 100 <> 0) SELECT a.net_id, a.sheet, b.sheet AS other_sheet FROM p a JOIN p b ON a.net_id = b.net_id AND a.sheet <> b.sheet",
    "signal_layers": """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1) FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey <> 24 UNION SELECT 'r' || r_regionkey, 'out' FROM region),
n AS (SELECT a AS node FROM e UNION SELECT b FROM e),
w AS (SELECT node, 0 AS layer FROM n WHERE node NOT IN (SELECT b FROM e) UNION SELECT e.b, w.layer + 1 FROM w JOIN e ON e.a = w.node)
SELECT node, max(layer)::INTEGER AS layer FROM w GROUP BY node""",
}
