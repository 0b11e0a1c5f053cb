"""Drawings and lattices over the driver's tables: wires of sheets, columns and rows of symbols, pins, links, copper."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators import drawing, lattice, layout, wiring
from tracewright.operators.alignment import sampled_rigid
from tracewright.operators.loop import dealt, stored, tasks_for
from tracewright.plans.inputs import table

SIDE = 25


def _sheet_pins(spark, d):
    """Customers as pins, 20 on a sheet in two columns; nations make the nets of a sheet."""
    k = F.col("c_custkey") % 20
    column, row = F.floor(k / 10), k % 10
    return table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 20).alias("sheet"), F.concat(F.lit("n"), F.col("c_nationkey") % 7).alias("net_id"), F.col("c_custkey").alias("id"), (column * 250 + 100).cast("double").alias("x"), (row * 40 + 100).cast("double").alias("y"), F.when(column % 2 == 0, "output").otherwise("input").alias("direction"))


def sheet_edges(spark, d):
    """The edges of all nets' trees on their sheets, in the order in which they are routed."""
    return wiring.edges(wiring.net_pins(_sheet_pins(spark, d))).select("sheet", "ord", "net_id", "from_id", "to_id")


def sheet_wires(spark, d):
    """For each net of a sheet: its wires, those that end at two of its pins, and clear ones that touch another's pin."""
    pins = _sheet_pins(spark, d)
    points, lines = wiring.standing(pins)
    wires = wiring.routed(wiring.edges(wiring.net_pins(pins)), points, lines)
    at = pins.select("sheet", "net_id", F.struct("x", "y").alias("p")).distinct()
    ends = wires.select("sheet", "net_id", "ord", F.explode(F.array(F.get("points", F.lit(0)), F.element_at("points", -1))).alias("p")).join(at, ["sheet", "net_id", "p"], "left_semi")
    good = ends.groupBy("sheet", "ord").agg((F.count("*") == 2).cast("int").alias("good"))
    bad = wiring.faults(wires.where("clear"), points).where("kind = 'point'").select("sheet", "ord", F.lit(1).alias("bad"))
    of = wires.join(good, ["sheet", "ord"], "left").join(bad, ["sheet", "ord"], "left")
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias
    return of.groupBy("sheet", "net_id").agg(F.count("*").alias("wires"), count("good")("ended"), count("bad")("touching"))


def _circuits(spark, d):
    """Twelve parts a drawing; a part drives its own net and reads those of two parts before it."""
    k = F.col("p_partkey") % 12
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 12).alias("doc"), k.alias("k"), F.format_string("s%02d", k).alias("id"), F.col("p_size"))
    symbols = p.select("doc", "id", F.col("k").alias("ord"), F.when(F.col("k") % 3 == 0, "NOT").otherwise("NAND").alias("gate_type"))
    read = [(1, (F.col("k") * 7 + F.col("p_size")) % F.greatest("k", F.lit(1))), (2, (F.col("k") * 3 + 1) % F.greatest("k", F.lit(1)))]
    pins = p.select("doc", F.col("id").alias("symbol_id"), F.lit(3).alias("ord"), F.lit(3).alias("pin_number"), F.lit("output").alias("direction"), F.concat(F.lit("D"), "k").alias("net_id"))
    for n, k in read:
        pins = pins.unionByName(p.where("k > 0").select("doc", F.col("id").alias("symbol_id"), F.lit(n).alias("ord"), F.lit(n).alias("pin_number"), F.lit("input").alias("direction"), F.concat(F.lit("D"), k).alias("net_id")))
    return symbols, pins.withColumn("net_name", F.col("net_id"))


def drawing_columns(spark, d):
    return layout.columns(*_circuits(spark, d)).select("doc", "id", "column")


def drawing_places(spark, d):
    """Rows only: where every part of every drawing stands; tested against plain Python on small circuits."""
    return layout.laid_out(*_circuits(spark, d)).select("doc", "id", "column", "row", "x", "y", "flip_v")


def _boards(spark, d):
    """Orders as components of customers' boards, lines as pads, some lines as vias of another net as well."""
    o, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    name = F.concat(F.lit("U"), F.col("o_orderkey"))
    components = o.select(F.col("o_custkey").alias("doc"), name.alias("id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("P"), F.col("o_orderkey") % 7).alias("part_number"), F.lit("DIP").alias("package"))
    kinds = table(spark, d, "part").select((F.col("p_size") % 6).alias("k")).distinct()
    part, package = F.concat(F.lit("P"), "k").alias("part_number"), F.lit("DIP").alias("package")
    parts = kinds.select(part, package, F.concat(F.lit("kind "), "k").alias("description"))
    pins = kinds.select(part, package, F.posexplode(F.array(*map(F.lit, ("A", "/B", "Y", "VCC")))).alias("ord", "name")).withColumn("number", F.col("ord") + 1)
    pins = pins.withColumn("direction", F.when(F.col("number") == 3, "Output").when(F.col("number") == 4, "Power").otherwise("Input"))
    ints = lambda *v: F.array(*map(F.lit, v)).cast("array<int>")
    functions = kinds.where("k < 4").select(part, package, F.lit(0).alias("ord"), F.lit("a").alias("name"), F.lit("NAND").alias("type"), ints(1, 2).alias("inputs"), ints().alias("clocks"), ints(2, 4).alias("enables"), ints(3).alias("outputs"))
    second = kinds.where("k = 3").select(part, package, F.lit(1).alias("ord"), F.lit("b").alias("name"), F.lit("NOT").alias("type"), ints(5).alias("inputs"), ints().alias("clocks"), ints().alias("enables"), ints(6).alias("outputs"))
    aliases = kinds.where("k < 0").select(part, package, F.lit("").alias("alias"))
    net = table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("ord"))
    nets = net.select("doc", F.concat(F.lit("n"), "ord").alias("net_id"), "ord", F.when(F.col("ord") == 6, "GND").when(F.col("ord") == 5, "").otherwise(F.concat(F.lit("D"), "ord")).alias("name"))
    tasks = tasks_for(lines, lines.count())
    on = dealt(lines.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity"), tasks, "l_orderkey").join(dealt(o.select("o_orderkey", "o_custkey"), tasks, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    held = lambda df, key: df.select(F.col("o_custkey").alias("doc"), F.concat(F.lit("n"), F.col(key) % 7).alias("net_id"), F.col("l_linenumber").alias("ord"), name.alias("component_id"), F.col("l_linenumber").cast("string").alias("pin"))
    return components, parts, pins, functions.unionByName(second), aliases, nets, held(on, "l_suppkey"), held(on.where("l_quantity > 25"), "l_partkey"), tasks


def drawn_pins(spark, d):
    """The pins of all symbols of all boards, with their nets."""
    components, parts, pins, functions, aliases, nets, net_pads, net_vias, tasks = _boards(spark, d)
    pad = stored(drawing.pads(nets, net_pads, net_vias, tasks))  # read twice
    _, rows = drawing.symbols_and_pins(components, parts, pins, functions, aliases, pad, tasks)
    return rows.select("doc", "symbol_id", F.col("pin_number").cast("int").alias("pin_number"), F.col("ord").cast("int").alias("place"), "name", "direction", "negated", F.coalesce("net_id", F.lit("")).alias("net_id"), "net_name")


def sheet_links(spark, d):
    """Connectors between sheets for lines as pins of orders on three sheets a customer."""
    o, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    symbols = o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 4).cast("int").alias("sheet"))
    pins = lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("doc"), F.col("l_orderkey").alias("symbol_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_linenumber") % 3 == 0, "output").otherwise("input").alias("direction"), (F.col("l_suppkey") % 5).alias("net_id"), F.concat(F.lit("N"), F.col("l_suppkey") % 5).alias("net_name"), (F.col("l_partkey") % 900).cast("double").alias("x"), (F.col("l_suppkey") % 500).cast("double").alias("y"))
    power = o.select(F.col("o_custkey").alias("doc"), F.lit(4).cast("long").alias("net_id")).distinct()
    return drawing.off_sheet(symbols, pins, power).select("doc", F.col("sheet").cast("int").alias("sheet"), "net_id", "name", F.col("target_sheet").cast("int").alias("target_sheet"), "x", "y", "direction")


def _pixels(spark, d):
    """Lines as lit pixels of their supplier's image."""
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_suppkey").alias("img"), (F.col("l_partkey") % SIDE).cast("int").alias("x"), (F.col("l_orderkey") % SIDE).cast("int").alias("y")).distinct()


def lattice_reach(spark, d):
    """How many pixels of each image can be reached from its middle over lit ones."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("img"))
    seeds = s.select(F.col("img").alias("search"), F.col("img").alias("space"), F.lit(12).alias("x"), F.lit(12).alias("y"))
    tiles = lattice.distances(_pixels(spark, d).withColumnRenamed("img", "space"), seeds, tile=16)
    return lattice.reached(tiles).groupBy(F.col("search").alias("img")).agg(F.count("*").alias("places"), F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))


def lattice_ways(spark, d):
    """Rows only: the cheapest way across each image, from the lit pixel nearest to one corner to that nearest to the
    other; tested against plain Python."""
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("img"), F.lit(0).alias("id"), *(F.lit(v).alias(n) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", SIDE - 1.0), ("y2", SIDE - 1.0))))
    return lattice.paths(pairs, _pixels(spark, d), 8).select("img", F.round("cost", 9).alias("cost"), F.size("points").alias("pixels"))


def copper_reach(spark, d):
    """Places that copper grows over from each image's middle, and which of four corners it gets to."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("img"))
    seeds = s.select("img", F.lit(0).alias("id"), F.lit(12.0).alias("x"), F.lit(12.0).alias("y"), F.lit(2.0).alias("exclude"))
    ends = s.select("img", F.posexplode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (3.0, 21.0) for y in (3.0, 21.0)))).alias("terminal", "p")).select("img", "terminal", "p.x", "p.y", F.lit(2.5).alias("radius"))
    sizes = s.select("img", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))
    places, walks = lattice.grown(seeds, _pixels(spark, d), ends, sizes, probe=1, step=1, share=0.7, tile=16)
    got = walks.groupBy("img").agg(F.sum(F.pow(F.lit(2.0), F.col("terminal"))).cast("int").alias("corners"))
    return places.groupBy("img").agg(F.count("*").alias("places")).join(got, "img", "left").select("img", "places", F.coalesce("corners", F.lit(0)).alias("corners"))


def sampled_turns(spark, d):
    """The turn of each nation's customers' places among a quarter of strays."""
    k = F.col("c_custkey")
    x, y = (k * 37 % 1000).cast("double"), (k * 53 % 700).cast("double")
    stray = F.when(k % 4 == 0, 200 + k % 90).otherwise(0)
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("board"), k.alias("k"), x.alias("x1"), y.alias("y1"), (0.8 * x - 0.6 * y + 12 + stray).alias("x2"), (0.6 * x + 0.8 * y - 7 - stray).alias("y2"))
    pairs = c.withColumn("ord", F.row_number().over(W.partitionBy("board").orderBy("k")) - 1)
    r = sampled_rigid(pairs, "board", 40, 2.0)
    return r.select("board", "inliers", *(F.round(c, 6).alias(c) for c in ("angle", "tx", "ty")))


QUERIES = {f.__name__: f for f in (sheet_edges, sheet_wires, drawing_columns, drawing_places, drawn_pins, sheet_links, lattice_reach, lattice_ways, copper_reach, sampled_turns)}

_PINS = "p AS (SELECT c_custkey // 20 AS sheet, 'n' || c_nationkey % 7 AS net_id, c_custkey AS id, c_custkey % 20 // 10 * 250 + 100 AS x, c_custkey % 10 * 40 + 100 AS y FROM customer)"
_LIT = "lit AS (SELECT DISTINCT l_suppkey AS img, l_partkey % 25 AS x, l_orderkey % 25 AS y FROM lineitem)"
_NEXT = "(VALUES (-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)) s(dx, dy)"

SQL = {
    "sheet_edges": f"""
WITH RECURSIVE {_PINS}, q AS (SELECT *, row_number() OVER (PARTITION BY sheet, net_id ORDER BY id) AS i, count(*) OVER (PARTITION BY sheet, net_id) AS n FROM p),
e AS (SELECT a.sheet, a.net_id, a.n, a.i, b.i AS j, a.id AS from_id, b.id AS to_id, row_number() OVER (PARTITION BY a.sheet, a.net_id ORDER BY abs(a.x - b.x) + abs(a.y - b.y), a.i, b.i) AS k
  FROM q a JOIN q b ON a.sheet = b.sheet AND a.net_id = b.net_id AND a.i < b.i),
r(sheet, net_id, k, i) AS (SELECT sheet, net_id, k, i FROM e
  UNION SELECT r.sheet, r.net_id, r.k, CASE WHEN e.i = r.i THEN e.j ELSE e.i END FROM r JOIN e ON e.sheet = r.sheet AND e.net_id = r.net_id AND e.k < r.k AND (e.i = r.i OR e.j = r.i))
SELECT sheet, (row_number() OVER (PARTITION BY sheet ORDER BY n DESC, net_id, k))::INTEGER AS ord, net_id, from_id, to_id
FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.sheet = e.sheet AND r.net_id = e.net_id AND r.k = e.k AND r.i = e.j)""",
    "sheet_wires": f"WITH {_PINS} SELECT sheet, net_id, count(*) - 1 AS wires, count(*) - 1 AS ended, 0::BIGINT AS touching FROM p GROUP BY ALL HAVING count(*) > 1",
    "drawing_columns": """
WITH RECURSIVE p AS (SELECT p_partkey // 12 AS doc, p_partkey % 12 AS k, p_size FROM part),
e AS (SELECT doc, k, (k * 7 + p_size) % k AS up FROM p WHERE k > 0 UNION SELECT doc, k, (k * 3 + 1) % k FROM p WHERE k > 0),
own AS (SELECT e.* FROM e JOIN p ON p.doc = e.doc AND p.k = e.up),
w(doc, k, depth) AS (SELECT doc, k, 0 FROM p UNION SELECT own.doc, own.k, depth + 1 FROM w JOIN own ON own.doc = w.doc AND own.up = w.k)
SELECT doc, printf('s%02d', k) AS id, max(depth)::INTEGER AS "column" FROM w GROUP BY ALL""",
    "drawn_pins": """
WITH c AS (SELECT o_custkey AS doc, 'U' || o_orderkey AS u, o_orderkey % 7 AS k, o_orderkey FROM orders),
kinds AS (SELECT DISTINCT p_size % 6 AS k FROM part),
held AS (SELECT l_orderkey, l_linenumber AS pin, l_suppkey % 7 AS net, 0 AS phase FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey % 7, 1 FROM lineitem WHERE l_quantity > 25),
named AS (SELECT *, CASE net WHEN 6 THEN 'GND' WHEN 5 THEN '' ELSE 'D' || net END AS name FROM held),
pad AS (SELECT l_orderkey, pin, 'n' || arg_max(net, net * 2 + phase) AS net_id, coalesce(arg_max(name, net * 2 + phase) FILTER (WHERE phase = 0 OR name <> ''), '') AS net_name FROM named GROUP BY ALL),
fn(k, f, place, pin, direction) AS (
  SELECT k, 'a', unnest([1, 2, 3, 4]), unnest([1, 2, 4, 3]), unnest(['input', 'input', 'enable', 'output']) FROM kinds WHERE k < 4
  UNION ALL SELECT k, 'b', unnest([1, 2]), unnest([5, 6]), unnest(['input', 'output']) FROM kinds WHERE k = 3),
nm(pin, name) AS (VALUES (1, 'A'), (2, '/B'), (3, 'Y'), (4, 'VCC')),
rows AS (
  SELECT doc, u || '-' || f AS symbol_id, o_orderkey, pin, place, coalesce(nm.name, '') AS name, direction, coalesce(nm.name, '') LIKE '/%' AS negated FROM c JOIN fn USING (k) LEFT JOIN nm USING (pin)
  UNION ALL SELECT doc, u, o_orderkey, pin, pin - 1, name, CASE pin WHEN 3 THEN 'output' WHEN 4 THEN 'power' ELSE 'input' END, false FROM c JOIN kinds USING (k), nm WHERE k >= 4
  UNION ALL SELECT doc, u, c.o_orderkey, pin, pin, '', CASE WHEN net_name = 'GND' THEN 'power' ELSE 'input' END, false FROM c JOIN pad ON l_orderkey = o_orderkey WHERE k NOT IN (SELECT k FROM kinds))
SELECT doc, symbol_id, r.pin::INTEGER AS pin_number, place::INTEGER AS place, name, direction, negated, coalesce(net_id, '') AS net_id, coalesce(net_name, '') AS net_name
FROM rows r LEFT JOIN pad ON pad.l_orderkey = r.o_orderkey AND pad.pin = r.pin""",
    "sheet_links": """
WITH p AS (SELECT o_custkey AS doc, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 4 END AS sheet, l_suppkey % 5 AS net_id, l_orderkey, l_linenumber, l_partkey % 900 AS x, l_suppkey % 500 AS y, l_linenumber % 3 <> 0 AS takes
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 5 <> 4),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc, sheet, net_id ORDER BY l_orderkey, l_linenumber, x, y) = 1)
SELECT a.doc, a.sheet::INTEGER AS sheet, a.net_id, 'N' || a.net_id AS name, b.sheet::INTEGER AS target_sheet,
  (CASE WHEN a.takes THEN greatest(a.x - 140, 100) ELSE a.x + 60 END)::DOUBLE AS x, greatest(a.y - 10, 100)::DOUBLE AS y, CASE WHEN a.takes THEN 'input' ELSE 'output' END AS direction
FROM f a JOIN f b ON a.doc = b.doc AND a.net_id = b.net_id AND a.sheet <> b.sheet""",
    "lattice_reach": f"""
WITH RECURSIVE {_LIT}, w(img, x, y) AS (SELECT s_suppkey, 12::BIGINT, 12::BIGINT FROM supplier
  UNION SELECT lit.img, lit.x, lit.y FROM w, {_NEXT}, lit WHERE lit.img = w.img AND lit.x = w.x + dx AND lit.y = w.y + dy)
SELECT img, count(*) AS places, min(x)::INTEGER AS "left", max(x)::INTEGER AS "right", min(y)::INTEGER AS top, max(y)::INTEGER AS bottom FROM w GROUP BY img""",
    "copper_reach": f"""
WITH RECURSIVE {_LIT}, g AS (SELECT a.range AS x, b.range AS y FROM range(1, 24) a, range(1, 24) b),
hit AS (SELECT img, lit.x + dx AS x, lit.y + dy AS y, count(*) AS n FROM lit, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) GROUP BY ALL),
term(terminal, cx, cy) AS (VALUES (0, 3, 3), (1, 3, 21), (2, 21, 3), (3, 21, 21)),
free AS (SELECT img, x, y FROM hit JOIN g USING (x, y) WHERE n >= 3.5
  UNION SELECT s_suppkey, x, y FROM supplier, g WHERE (x - 12) * (x - 12) + (y - 12) * (y - 12) < 4
  UNION SELECT s_suppkey, x, y FROM supplier, g, term WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) < 6.25),
w(img, x, y) AS (SELECT s_suppkey, 12::BIGINT, 12::BIGINT FROM supplier
  UNION SELECT free.img, free.x, free.y FROM w, {_NEXT}, free WHERE free.img = w.img AND free.x = w.x + dx AND free.y = w.y + dy),
got AS (SELECT DISTINCT img, terminal FROM w, term WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 6.25)
SELECT w.img, count(*) AS places, coalesce((SELECT sum(1 << terminal) FROM got WHERE got.img = w.img), 0)::INTEGER AS corners FROM w GROUP BY w.img""",
    "sampled_turns": """
WITH c AS (SELECT c_nationkey AS board, c_custkey AS k, (c_custkey * 37 % 1000)::DOUBLE AS x1, (c_custkey * 53 % 700)::DOUBLE AS y1, CASE WHEN c_custkey % 4 = 0 THEN 200 + c_custkey % 90 ELSE 0 END AS off FROM customer),
p AS (SELECT board, row_number() OVER (PARTITION BY board ORDER BY k) - 1 AS ord, x1, y1, 0.8::DOUBLE * x1 - 0.6::DOUBLE * y1 + 12 + off AS x2, 0.6::DOUBLE * x1 + 0.8::DOUBLE * y1 - 7 - off AS y2 FROM c),
r AS (SELECT board, n, round, (round * 2654435761 + 97) % n AS p FROM (SELECT board, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 2), (SELECT unnest(range(1, 41)) AS round)),
t AS (SELECT r.board, r.round, a.x1 AS ax, a.y1 AS ay, a.x2 AS au, a.y2 AS av, b.x1 - a.x1 AS sx, b.y1 - a.y1 AS sy, b.x2 - a.x2 AS dx, b.y2 - a.y2 AS dy
  FROM r JOIN p a ON a.board = r.board AND a.ord = r.p JOIN p b ON b.board = r.board AND b.ord = (r.p + 1 + (r.round * 40503 + 1) % (r.n - 1)) % r.n),
m AS (SELECT *, atan2(dy, dx) - atan2(sy, sx) AS g FROM t WHERE sqrt(sx * sx + sy * sy) >= 0.001 AND sqrt(dx * dx + dy * dy) >= 0.001),
h AS (SELECT m.board, m.round, p.x1, p.y1, p.x2, p.y2 FROM m JOIN p ON p.board = m.board
  WHERE sqrt(pow(cos(g) * (x1 - ax) - sin(g) * (y1 - ay) + au - x2, 2) + pow(sin(g) * (x1 - ax) + cos(g) * (y1 - ay) + av - y2, 2)) < 2),
b AS (SELECT board, round, count(*) AS inliers FROM h GROUP BY board, round HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY board ORDER BY count(*) DESC, round) = 1),
i AS (SELECT h.*, inliers, avg(x1) OVER w AS a1, avg(y1) OVER w AS b1, avg(x2) OVER w AS a2, avg(y2) OVER w AS b2 FROM h JOIN b USING (board, round) WINDOW w AS (PARTITION BY board)),
f AS (SELECT board, inliers, a1, b1, a2, b2, atan2(sum((x1 - a1) * (y2 - b2) - (y1 - b1) * (x2 - a2)), sum((x1 - a1) * (x2 - a2) + (y1 - b1) * (y2 - b2))) AS g FROM i GROUP BY ALL)
SELECT board, inliers, round(g, 6) AS angle, round(a2 - cos(g) * a1 + sin(g) * b1, 6) AS tx, round(b2 - sin(g) * a1 - cos(g) * b1, 6) AS ty FROM f""",
}
