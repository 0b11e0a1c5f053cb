"""Queries on feature records, netlists in text, wires and reading samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import dates
from tracewright.operators.alignment import grid_run, without_outliers
from tracewright.operators.features import board_pins, confirmed_rows, elements_by_type, overlapping, power_pins, supported
from tracewright.operators.graph import spanning_trees
from tracewright.operators.near import greedy_match, near_join
from tracewright.operators.nets import logic_names, netlist_text
from tracewright.operators.schematic import crossings, junctions, wire_lengths
from tracewright.operators.stats import ocr_statistics
from tracewright.operators.training import loosely_contains, score_report
from tracewright.plans.inputs import DIST, SIDES, sides, table


def _vias(spark, d):
    f, b = sides(spark, d)
    radius = (F.col("id") % 5 + 1) / 4
    more = lambda df: df.withColumn("radius", radius).withColumn("confidence", (F.col("id") % 10) / 10)
    return more(f), more(b)


_VIAS = SIDES.replace("SELECT * FROM points WHERE label % 2 = 0", "SELECT *, (id % 5 + 1) / 4 AS radius, (id % 10) / 10 AS confidence FROM points WHERE label % 2 = 0").replace("SELECT * FROM points WHERE label % 2 = 1", "SELECT *, (id % 5 + 1) / 4 AS radius, (id % 10) / 10 AS confidence FROM points WHERE label % 2 = 1")


def free_vias(spark, d):
    """Front vias that overlap no back via."""
    return overlapping(*_vias(spark, d), 2.5).select("id")


def supported_vias(spark, d):
    """Front vias with a back via's centre inside them."""
    return supported(*_vias(spark, d), 1.25).select("id")


def confirmed_vias(spark, d):
    f, b = _vias(spark, d)
    c = confirmed_rows(greedy_match(near_join(f, b, 1.0)), f, b)
    # means of two numbers of six digits end in a tie half the time, so they are rounded as binary numbers, away from zero
    six = lambda v: F.signum(v) * F.floor(F.abs(F.col(v) * 1e6) + 0.5) / 1e6
    return c.select("id", "front_via_id", "back_via_id", *(six(v).alias(v) for v in ("x", "y", "radius", "confidence")))


def net_elements(spark, d):
    """Element lists by type of nets, which are users' events."""
    kinds = F.element_at(F.array(*map(F.lit, ["connector", "via", "trace", "pad"])), (F.col("event_id") % 4 + 1).cast("int"))
    return elements_by_type(table(spark, d, "events").select(F.col("user_id").alias("net_id"), kinds.alias("type"), F.col("event_id").alias("element_id")))


def named_contacts(spark, d):
    """Contacts of both sides, numbered along their line and named by a pin map of every third pin."""
    c = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "front").otherwise("back").alias("side"), (F.col("s_acctbal") * 1000 + F.col("s_suppkey")).alias("x"), (F.col("s_suppkey") % 4).cast("int").alias("detection_pass"))
    names = spark.range(1, 101).where("id % 3 = 0").select(F.col("id").cast("int").alias("pin_number"), F.concat(F.lit("SIG"), "id").alias("signal_name"))
    return board_pins(c, names, 50, 100).select("id", "pin_number", "signal_name", "confidence")


def loose_pins(spark, d):
    """Pins of parts in none of their functions."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("part_number"), F.lit("DIP").alias("package"), "p_size")
    pins = p.select("part_number", "package", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("pin_number"))
    k = F.col("p_size")
    fn = p.select("part_number", "package", F.array(k % 7, k % 5 + 1).alias("inputs"), F.array(k % 3 + 8).alias("outputs"), F.array(k % 2 + 12).alias("enables"), F.array().cast("array<int>").alias("clocks"))
    return power_pins(pins, fn).select("part_number", "pin_number")


def _board(spark, d):
    """Pins of nets: parts at suppliers on orders."""
    lines = table(spark, d, "lineitem").repartition("l_orderkey")  # one shuffle for lines, nets and their names
    return lines.groupBy(F.col("l_orderkey").alias("net_id"), F.concat(F.lit("S"), "l_suppkey").alias("component"), F.col("l_partkey").cast("string").alias("pin")).agg(F.when(F.min("l_linenumber") == 1, "CLK").otherwise("").alias("signal"))


def netlist_dump(spark, d):
    pins = _board(spark, d)
    names = pins.select("net_id").distinct().select("net_id", F.format_string("net-%03d", "net_id").alias("name"))
    return netlist_text(pins, names)


def _wires(spark, d):
    c = table(spark, d, "customer").withColumn("far", F.floor(F.col("c_custkey") / 300) * 2000)
    at = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((F.col("c_custkey") * 37 % 1000 + F.col("far"), F.col("c_custkey") * 91 % 1000), (F.col("c_custkey") * 37 % 1000 + F.col("far"), F.col("c_custkey") * 53 % 1000), (F.col("c_custkey") * 71 % 1000 + F.col("far"), F.col("c_custkey") * 53 % 1000))))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("net_id"), at.alias("points"))


_WIRES = "w AS (SELECT c_custkey AS id, c_nationkey AS net_id, c_custkey * 37 % 1000 + c_custkey // 300 * 2000 AS xa, c_custkey * 91 % 1000 AS ya, c_custkey * 53 % 1000 AS yb, c_custkey * 71 % 1000 + c_custkey // 300 * 2000 AS xb FROM customer)"


def wire_crossings(spark, d):
    return crossings(_wires(spark, d)).groupBy("net_a", "net_b").agg(F.count("*").alias("n"))


def wire_figures(spark, d):
    return wire_lengths(_wires(spark, d)).select("net_id", "length")


def wire_junctions(spark, d):
    dots = _wires(spark, d).select(F.lit(1).alias("sheet"), F.explode("points").alias("p")).select("sheet", (F.col("p.x") % 60).alias("x"), (F.col("p.y") % 60).alias("y"))
    return junctions(dots)


def net_trees(spark, d):
    """Rows only: spanning trees of the customers of a nation."""
    pts = table(spark, d, "customer").select(F.col("c_nationkey").alias("net_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 101).cast("double").alias("x"), (F.col("c_custkey") * 53 % 97).cast("double").alias("y"))
    return spanning_trees(pts)


def _samples(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    params = F.struct(F.lit(0.0).alias("brightest_pct"), F.when(k % 4 == 2, (k % 9 * 10 + 90).cast("int")).otherwise(0).alias("fixed_threshold"), (k % 4 == 0).alias("use_adaptive"), (k % 4 == 1).alias("use_otsu"), (k % 2 == 0).alias("invert"), (k % 5).cast("int").alias("psm_mode"))
    return o.select(F.substring("o_orderpriority", 1, 1).alias("orientation"), (F.col("o_totalprice") % 100 / 100).alias("score"), params.alias("params"))


def reading_orientations(spark, d):
    s = ocr_statistics(_samples(spark, d))["orientation"]
    return s.select("orientation", "n", F.round("mean", 6).alias("mean"), F.round("best", 6).alias("best"))


def reading_methods(spark, d):
    s = ocr_statistics(_samples(spark, d))["method"]
    return s.select("method", "n", F.round("mean", 6).alias("mean"))


def reading_best(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("component"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("params"))
    return score_report(o, 3)


def year_letters(spark, d):
    """Codes of year digit, month letter and week of the month."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"))
    letter = F.substr(F.lit(dates.MONTHS), F.month("at"), F.lit(1))
    code = F.concat((F.year("at") % 10).cast("string"), letter, (F.floor((F.dayofmonth("at") - 1) / 7) + 1).cast("string"))
    found = dates.decode(code, 1994)
    return o.select("o_orderkey", code.alias("code"), found["year"].alias("year"), found["month"].alias("month"), found["week"].alias("week"))


def loose_words(spark, d):
    """Part names that hold a misread word."""
    p = table(spark, d, "part")
    return p.select("p_partkey", loosely_contains(F.upper("p_brand"), "BRANO", 0).alias("same"), loosely_contains(F.upper("p_brand"), "BXAND", 0).alias("wrong"), loosely_contains(F.upper("p_brand"), "BXAND", 1).alias("close"))


def contact_outliers(spark, d):
    """Suppliers that stay on their nation's line."""
    s = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("board"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 10.0).alias("x"), F.when(F.col("s_suppkey") % 19 == 0, 400.0).otherwise(F.col("s_suppkey") % 3 + 100.0).alias("y"), F.when(F.col("s_suppkey") % 23 == 0, 40).otherwise(8).alias("width"), F.lit(20).alias("height"))
    return without_outliers(s, 0.3).select("board", "id")


def contact_runs(spark, d):
    s = table(spark, d, "supplier").select(F.floor(F.col("s_suppkey") / 30).alias("board"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 10.0 + F.col("s_suppkey") % 4 * 0.5).alias("x"))
    return grid_run(s, 20.0, 12).groupBy("board").agg(F.count("*").alias("n"), F.min("start").alias("start"))


def gate_chain(spark, d):
    """Names along a chain of gates between nations."""
    n = table(spark, d, "nation")
    nets = n.select(F.col("n_nationkey").alias("net_id"), F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).otherwise(F.format_string("net-%03d", "n_nationkey")).alias("name"), (F.col("n_nationkey") % 7 == 3).alias("manual"))
    links = n.where("n_nationkey % 5 <> 4").select((F.col("n_nationkey") + 1).alias("net_out"), F.col("n_nationkey").alias("net_in"), F.lit("NOT").alias("gate"))
    return logic_names(nets, links).select("net_id", "name")


QUERIES = {f.__name__: f for f in (free_vias, supported_vias, confirmed_vias, net_elements, named_contacts, loose_pins, netlist_dump, wire_crossings, wire_figures, wire_junctions, net_trees, reading_orientations, reading_methods, reading_best, year_letters, loose_words, contact_outliers, contact_runs, gate_chain)}

_MATCHED = f"""WITH RECURSIVE {_VIAS}, pairs AS (SELECT f.id AS left_id, b.id AS right_id, {DIST} AS dist FROM f JOIN b ON {DIST} <= 1.0),
ranked AS (SELECT *, row_number() OVER (ORDER BY dist, left_id, right_id) AS r FROM pairs),
pick AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS ls, []::BIGINT[] AS rs, false AS hit UNION ALL
  SELECT k.r, CASE WHEN ok THEN list_append(ls, k.left_id) ELSE ls END, CASE WHEN ok THEN list_append(rs, k.right_id) ELSE rs END, ok
  FROM (SELECT ranked.*, ls, rs, NOT list_contains(ls, left_id) AND NOT list_contains(rs, right_id) AS ok FROM pick JOIN ranked ON ranked.r = pick.r + 1) k),
m AS (SELECT ranked.*, row_number() OVER (ORDER BY dist, left_id, right_id) AS n FROM pick JOIN ranked USING (r) WHERE hit)"""
_SEGMENTS = "s AS (SELECT net_id, xa AS x1, ya AS y1, xa AS x2, yb AS y2 FROM w UNION ALL SELECT net_id, xa, yb, xb, yb FROM w)"
_SAMPLES = "s AS (SELECT o_orderpriority[1:1] AS orientation, o_totalprice % 100 / 100 AS score, CASE o_orderkey % 4 WHEN 0 THEN 'adaptive' WHEN 1 THEN 'otsu' WHEN 2 THEN 'fixed' END AS method FROM orders)"

SQL = {
    "free_vias": f"WITH {_VIAS} SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE {DIST} < f.radius + b.radius)",
    "supported_vias": f"WITH {_VIAS} SELECT id FROM f WHERE EXISTS (SELECT 1 FROM b WHERE {DIST} < f.radius)",
    "confirmed_vias": _MATCHED + " SELECT 'cvia-' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS id, left_id AS front_via_id, right_id AS back_via_id, round((f.x + b.x) / 2, 6) AS x, round((f.y + b.y) / 2, 6) AS y, round((f.radius + b.radius) / 2, 6) AS radius, round(least(1.0, (f.confidence + b.confidence) / 2 * 1.2), 6) AS confidence FROM m JOIN f ON f.id = left_id JOIN b ON b.id = right_id",
    "net_elements": "SELECT user_id AS net_id, " + ", ".join(f"coalesce(list(event_id ORDER BY event_id) FILTER (WHERE event_id % 4 = {i}), []) AS {t}_ids" for i, t in enumerate(("connector", "via", "trace", "pad"))) + " FROM events GROUP BY 1",
    "named_contacts": "WITH c AS (SELECT s_suppkey % 2 = 0 AS front, s_acctbal * 1000 + s_suppkey AS x, s_suppkey % 4 AS p FROM supplier), i AS (SELECT *, row_number() OVER (PARTITION BY front ORDER BY x) - 1 AS k FROM c), n AS (SELECT *, CASE WHEN front THEN 50 - k ELSE 100 - k END AS pin FROM i) SELECT 'conn-' || CASE WHEN front THEN 'F' ELSE 'B' END || '-' || lpad(k::VARCHAR, 3, '0') AS id, pin::INTEGER AS pin_number, 'SIG' || pin AS signal_name, CASE p WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.6 END AS confidence FROM n WHERE pin % 3 = 0 AND pin BETWEEN 1 AND 100",
    "loose_pins": "WITH p AS (SELECT p_partkey::VARCHAR AS part_number, p_size AS k FROM part), q AS (SELECT part_number, k, unnest(range(1, 15))::INTEGER AS pin_number FROM p) SELECT part_number, pin_number FROM q WHERE pin_number NOT IN (k % 7, k % 5 + 1, k % 3 + 8, k % 2 + 12)",
    "netlist_dump": """WITH p AS (SELECT l_orderkey AS net_id, 'S' || l_suppkey AS component, l_partkey::VARCHAR AS pin, CASE WHEN min(l_linenumber) = 1 THEN 'CLK' ELSE '' END AS signal FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT component, pin, min(net_id) AS net_id, min(signal) AS signal FROM p GROUP BY 1, 2),
l AS (SELECT *, component || '-' || pin || CASE WHEN signal <> '' THEN '(' || signal || ')' ELSE '' END AS label FROM f),
c AS (SELECT DISTINCT a.component, a.pin, l.label FROM p a JOIN p b ON a.net_id = b.net_id AND (a.component <> b.component OR a.pin <> b.pin) JOIN l ON l.component = b.component AND l.pin = b.pin),
g AS (SELECT component, pin, string_agg(label, ', ' ORDER BY label) AS labels FROM c GROUP BY 1, 2),
t AS (SELECT f.component, row_number() OVER (PARTITION BY f.component ORDER BY f.pin::BIGINT, f.pin)::INTEGER AS line_no, '  pin ' || CASE WHEN length(f.pin) < 4 THEN rpad(f.pin, 4, ' ') ELSE f.pin END || ' [net-' || lpad(f.net_id::VARCHAR, greatest(3, length(f.net_id::VARCHAR))::INTEGER, '0') || '] -> ' || coalesce(labels, '(no connections)') AS line FROM f LEFT JOIN g ON g.component = f.component AND g.pin = f.pin)
SELECT * FROM t UNION ALL SELECT DISTINCT component, 0, component || ':' FROM t""",
    "wire_crossings": f"WITH {_WIRES}, {_SEGMENTS} SELECT a.net_id AS net_a, b.net_id AS net_b, count(*) AS n FROM s a JOIN s b ON a.y1 = a.y2 AND a.x1 <> a.x2 AND b.x1 = b.x2 AND b.y1 <> b.y2 AND a.net_id <> b.net_id AND b.x1 > least(a.x1, a.x2) AND b.x1 < greatest(a.x1, a.x2) AND a.y1 > least(b.y1, b.y2) AND a.y1 < greatest(b.y1, b.y2) GROUP BY 1, 2",
    "wire_figures": f"WITH {_WIRES} SELECT net_id, sum(abs(ya - yb) + abs(xa - xb))::DOUBLE AS length FROM w GROUP BY 1",
    "wire_junctions": f"WITH {_WIRES}, d AS (SELECT xa % 60 AS x, ya % 60 AS y FROM w UNION ALL SELECT xa % 60, yb % 60 FROM w UNION ALL SELECT xb % 60, yb % 60 FROM w) SELECT 1 AS sheet, round(x / 5.0) * 5 AS x, round(y / 5.0) * 5 AS y, count(*) AS n FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 3",
    "reading_orientations": f"WITH {_SAMPLES} SELECT orientation, count(*) AS n, round(avg(score), 6) AS mean, round(max(score), 6) AS best FROM s WHERE score >= 0.7 GROUP BY 1",
    "reading_methods": f"WITH {_SAMPLES} SELECT method, count(*) AS n, round(avg(score), 6) AS mean FROM s WHERE score >= 0.7 AND method IS NOT NULL GROUP BY 1",
    "reading_best": "SELECT component, place::INTEGER AS place, score, params FROM (SELECT o_custkey AS component, o_totalprice AS score, o_orderpriority AS params, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
    "year_letters": "WITH o AS (SELECT o_orderkey, year(o_orderdate) % 10 AS y, month(o_orderdate) AS m, (day(o_orderdate) - 1) // 7 + 1 AS w FROM orders) SELECT o_orderkey, y || substr('ABCDEFGHJKLM', m, 1) || w AS code, (1990 + y)::INTEGER AS year, m::INTEGER AS month, w::INTEGER AS week FROM o",
    "loose_words": "SELECT p_partkey, contains(upper(p_brand), 'BRAND') AS same, contains(upper(p_brand), 'BXAND') AS wrong, contains(upper(p_brand), 'BRAND') AS close FROM part",
    "contact_outliers": """WITH c AS (SELECT s_nationkey % 5 AS board, s_suppkey AS id, s_suppkey * 10.0::DOUBLE AS x, CASE WHEN s_suppkey % 19 = 0 THEN 400.0 ELSE s_suppkey % 3 + 100.0 END::DOUBLE AS y, CASE WHEN s_suppkey % 23 = 0 THEN 40 ELSE 8 END AS width FROM supplier),
f AS (SELECT board, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS level, list_sort(list(y))[count(*) // 2 + 1] AS my, list_sort(list(width))[count(*) // 2 + 1] AS mw FROM c GROUP BY 1),
o AS (SELECT c.*, f.n, f.mw, abs(y - coalesce(slope * x + level, my)) AS off FROM c JOIN f ON f.board = c.board),
q AS (SELECT board, (list_sort(list(off))[floor(count(*) * 3 / 4)::BIGINT + 1] - list_sort(list(off))[floor(count(*) / 4)::BIGINT + 1]) AS iqr FROM o GROUP BY 1),
s AS (SELECT o.board, id, n, (greatest(width / mw, mw / width) - 1) * 3 + off / greatest(iqr * 3, 5.0) AS score FROM o JOIN q ON q.board = o.board),
r AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY score, id) AS rank FROM s)
SELECT board, id FROM r WHERE n <= 2 OR rank <= greatest(floor(n * 0.7), 2) OR score < 1""",
    "contact_runs": "WITH c AS (SELECT s_suppkey // 30 AS board, s_suppkey AS id, s_suppkey * 10.0 + s_suppkey % 4 * 0.5 AS x FROM supplier), m AS (SELECT a.board, a.id AS start, a.x AS x0, round((b.x - a.x) / 20.0) AS place, abs(b.x - a.x - round((b.x - a.x) / 20.0) * 20.0) AS off FROM c a JOIN c b ON a.board = b.board), g AS (SELECT board, start, x0, count(DISTINCT place) AS n FROM m WHERE place BETWEEN 0 AND 11 AND off <= 4.0 GROUP BY 1, 2, 3) SELECT board, n, start FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY n DESC, x0) AS k FROM g) WHERE k = 1 AND n >= 7",
    "gate_chain": "WITH RECURSIVE n AS (SELECT n_nationkey AS k, n_name, n_nationkey % 7 = 3 AS manual FROM nation), r AS (SELECT k, CASE WHEN k % 5 = 0 THEN n_name ELSE 'net-' || lpad(k::VARCHAR, 3, '0') END AS name, k % 5 = 0 AS good FROM n WHERE k % 5 = 0 UNION ALL SELECT n.k, CASE WHEN NOT r.good OR n.manual THEN 'net-' || lpad(n.k::VARCHAR, 3, '0') WHEN r.name LIKE '/%' THEN substr(r.name, 2) ELSE '/' || r.name END, r.good AND NOT n.manual FROM r JOIN n ON n.k = r.k + 1 AND n.k % 5 <> 0) SELECT k AS net_id, name FROM r",
}
