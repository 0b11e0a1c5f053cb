"""Queries on alignment, grids, pixels and packages, over projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators.alignment import affine_fit, alignment_error, anchor, contact_scale, interval_pitch, pitch_votes, rigid_fit
from tracewright.operators.exports import kicad_netlist, spice_netlist
from tracewright.operators.features import function_pins, next_number, side_counts, upserted
from tracewright.operators.grids import grid_axes, information, suggested
from tracewright.operators.packages import package_of, pin_places
from tracewright.operators.pixels import brightest_threshold, cell_variance, class_statistics, matching_cells, on_score, regions, value_peaks
from tracewright.plans.inputs import table


def _pixels(spark, d):
    """Pixels: an image for each return flag; place and colour from the line's numbers."""
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_returnflag").alias("img_id"), (F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_suppkey") % 48).cast("int").alias("y"), (F.col("l_partkey") % 180).cast("int").alias("h"), (F.col("l_quantity") * 5).cast("int").alias("s"), (F.col("l_extendedprice") % 256).cast("int").alias("v")).distinct()


_PIXELS = "px AS (SELECT DISTINCT l_returnflag AS img_id, (l_partkey % 64)::INTEGER AS x, (l_suppkey % 48)::INTEGER AS y, (l_partkey % 180)::INTEGER AS h, trunc(l_quantity * 5)::INTEGER AS s, trunc(l_extendedprice % 256)::INTEGER AS v FROM lineitem)"


def cell_figures(spark, d):
    return cell_variance(_pixels(spark, d), 16).withColumn("variance", F.round("variance", 6))


def dark_cells(spark, d):
    return matching_cells(_pixels(spark, d), 4, F.col("v") < 100)


def dark_regions(spark, d):
    """Boxes of regions of cells most of whose pixels are dark."""
    return regions(matching_cells(_pixels(spark, d), 4, F.col("v") < 100, 0.5)).select("img_id", "x1", "y1", "x2", "y2", "cells")


def image_peaks(spark, d):
    p = value_peaks(_pixels(spark, d))
    return p.select("img_id", "background", F.round("background_pct", 6).alias("background_pct"), "marking", F.round("marking_pct", 6).alias("marking_pct"))


def bright_limit(spark, d):
    return brightest_threshold(_pixels(spark, d), 7.5, 120)


def _classes(spark, d):
    return _pixels(spark, d).withColumn("class", F.when(F.col("v") >= 128, "on").otherwise("off"))


def color_classes(spark, d):
    s = class_statistics(_classes(spark, d))
    return s.select("class", *(F.round(c, 6).alias(c) for c in s.columns if c != "class"))


def pixel_scores(spark, d):
    scored = on_score(_pixels(spark, d), class_statistics(_classes(spark, d)))
    return scored.groupBy("img_id").agg(F.round(F.avg("score"), 6).alias("score"), F.count_if(F.col("score") > 0.5).alias("n_on"))


def _contacts(spark, d):
    """Contacts of boards: a board for some sixty customers of a nation, contacts at their balances."""
    board = F.col("c_nationkey") + F.floor(F.col("c_custkey") / 1500) * 100
    return table(spark, d, "customer").select(board.alias("board"), F.col("c_custkey").alias("ord"), F.round(F.col("c_acctbal") / 10, 3).alias("x"))


_CONTACTS = "c AS (SELECT c_nationkey + c_custkey // 1500 * 100 AS board, c_custkey AS ord, round(c_acctbal / 10, 3) AS x FROM customer)"


def board_scale(spark, d):
    return contact_scale(_contacts(spark, d), 0.125, least=5).withColumn("dpi", F.round("dpi", 6))


def board_pitch(spark, d):
    from pyspark.sql import Window as W

    gaps = _contacts(spark, d).select("board", F.round(F.lead("x").over(W.partitionBy("board").orderBy("x", "ord")) - F.col("x"), 6).alias("gap")).where("gap is not null")
    return interval_pitch(gaps).withColumn("pitch", F.round("pitch", 6))


def voted_pitch(spark, d):
    return pitch_votes(_contacts(spark, d), 20.0).withColumn("pitch", F.round("pitch", 6))


def board_anchor(spark, d):
    every = _contacts(spark, d)
    return anchor(every, every.select("board").distinct().withColumn("pitch", F.lit(25.0))).withColumn("error", F.round("error", 6))


def _pairs(spark, d):
    """Points of suppliers and where they went: a turn, a stretch and a shift, with some noise."""
    s = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("board"), (F.col("s_suppkey") % 17 * 10.0).alias("x1"), F.round(F.col("s_acctbal") / 100, 3).alias("y1"), ((F.col("s_suppkey") % 7 - 3) / 10).alias("e"))
    return s.select("board", "x1", "y1", (F.col("x1") * 0.9 - F.col("y1") * 0.2 + 5 + F.col("e")).alias("x2"), (F.col("x1") * 0.2 + F.col("y1") * 0.9 - 3 - F.col("e")).alias("y2"))


_PAIRS = "s AS (SELECT s_nationkey % 5 AS board, (s_suppkey % 17) * 10.0 AS x1, round(s_acctbal / 100, 3) AS y1, (s_suppkey % 7 - 3) / 10 AS e FROM supplier), p AS (SELECT board, x1, y1, x1 * 0.9 - y1 * 0.2 + 5 + e AS x2, x1 * 0.2 + y1 * 0.9 - 3 - e AS y2 FROM s)"


def board_turn(spark, d):
    r = rigid_fit(_pairs(spark, d), ["board"])
    return r.select("board", F.round("angle", 6).alias("angle"), F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))


def board_affine(spark, d):
    """The affine transform and its mean residual."""
    pairs = _pairs(spark, d)
    fit = affine_fit(pairs, ["board"])
    out = fit.join(alignment_error(pairs, fit, ["board"]), "board")
    return out.select("board", *(F.round(c, 4).alias(c) for c in ("a", "b", "tx", "c", "d", "ty", "error")))


def _grid(spark, d):
    """Named components on grids: letters by row, numbers by column, some unnamed."""
    p = table(spark, d, "part")
    letter, number = F.col("p_partkey") % 7, F.floor(F.col("p_partkey") / 7) % 9
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("NEW"), "p_partkey")).otherwise(F.concat(F.char(letter.cast("int") * 2 + 65), (number * 2 + 1).cast("string")))
    return p.select((F.col("p_partkey") % 3).alias("board"), name.alias("id"), (number * 200 + F.col("p_size") / 10).alias("x"), (letter * 150 + F.col("p_size") / 5).alias("y"), F.col("p_partkey").alias("key"))


def name_axes(spark, d):
    return grid_axes(_grid(spark, d))


def grid_names(spark, d):
    """Rows only: suggested names of the unnamed components."""
    g = _grid(spark, d)
    return suggested(g.where(information(F.col("id")) < 2).select("board", F.col("key").alias("place"), "x", "y"), g)


def package_names(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", package_of(F.col("p_size") * 0.5, F.col("p_retailprice") / 40).alias("package"))


def package_pins(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("DIP-"), (F.col("p_size") % 4) * 2 + 14).alias("package"), F.lit(0.0).alias("bx"), F.lit(0.0).alias("by"), F.lit(100.0).alias("bw"), F.lit(300.0).alias("bh"), F.lit(0.0).alias("rotation"))
    return pin_places(p, 254.0).select("id", "pin", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "row")


def via_sides(spark, d):
    e = table(spark, d, "embeddings").select(F.when(F.col("label") % 3 == 0, "front").when(F.col("label") % 3 == 1, "back").alias("side"))
    return side_counts(e)


def next_net(spark, d):
    return next_number(table(spark, d, "orders").select(F.format_string("net-%03d", "o_orderkey").alias("id")), "net-")


def merged_parts(spark, d):
    """The parts with those of a size over 40 replaced by versions of theirs."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    new = p.where("p_size > 40").withColumn("p_size", F.lit(0).cast("int"))
    return upserted(p, new, ["p_partkey"])


def gate_pins(spark, d):
    """Pins of logic functions by their first role."""
    k = F.col("p_partkey").cast("int")
    f = table(spark, d, "part").select(F.col("p_brand").alias("part_number"), F.lit("DIP-14").alias("package"), F.col("p_partkey").cast("string").alias("name"), F.array(k % 7, k % 7 + 1).alias("inputs"), F.array(k % 5 + 7).alias("outputs"), F.array(k % 3).alias("enables"), F.array(k % 4 + 1).alias("clocks"))
    return function_pins(f).select("function", "pin_number", "role")


def _netlist(spark, d):
    comps = table(spark, d, "supplier").select(F.concat(F.lit("U"), "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("part_number"), F.lit("DIP-14").alias("package"))
    nets = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    conns = table(spark, d, "supplier").join(nets, F.col("s_nationkey") == F.col("n_nationkey")).select("name", F.concat(F.lit("U"), "s_suppkey").alias("component"), (F.col("s_suppkey") % 14 + 1).alias("pin"), F.col("s_suppkey").alias("ord"))
    return comps, nets.select("name"), conns


def netlist_lines(spark, d):
    return kicad_netlist("board", *_netlist(spark, d)).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


def spice_lines(spark, d):
    return spice_netlist("board", *_netlist(spark, d)).where("part in (1, 3)").select("part", "line")


QUERIES = {f.__name__: f for f in (cell_figures, dark_cells, dark_regions, image_peaks, bright_limit, color_classes, pixel_scores, board_scale, board_pitch, voted_pitch, board_anchor, board_turn, board_affine, name_axes, grid_names, package_names, package_pins, via_sides, next_net, merged_parts, gate_pins, netlist_lines, spice_lines)}

_CELLS = "cells AS (SELECT img_id, x // 4 AS cx, y // 4 AS cy FROM px GROUP BY 1, 2, 3 HAVING avg((v < 100)::INTEGER) > {0})"
_CLASS = "st AS (SELECT CASE WHEN v >= 128 THEN 'on' ELSE 'off' END AS class, " + ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in "hsv") + " FROM px GROUP BY 1)"
_AWAY = "sqrt(" + " + ".join(f"{w} * pow((px.{c} - {{0}}.{c}_mean) / ({{0}}.{c}_std + 1), 2)" for c, w in (("h", "1.0"), ("s", "1.5"), ("v", "1.5"))) + ")"

SQL = {
    "cell_figures": f"WITH {_PIXELS} SELECT img_id, x // 16 AS cx, y // 16 AS cy, round(var_pop(s) + var_pop(v), 6) AS variance FROM px GROUP BY 1, 2, 3",
    "dark_cells": f"WITH {_PIXELS}, {_CELLS.format(0.4)} SELECT * FROM cells",
    "dark_regions": f"""WITH RECURSIVE {_PIXELS}, {_CELLS.format(0.5)}, n AS (SELECT *, cy * 1000 + cx AS k FROM cells),
e AS (SELECT a.img_id, a.k AS a, b.k AS b FROM n a JOIN n b ON a.img_id = b.img_id AND abs(a.cx - b.cx) + abs(a.cy - b.cy) <= 1),
r AS (SELECT img_id, a, b FROM e UNION SELECT r.img_id, r.a, e.b FROM r JOIN e ON e.img_id = r.img_id AND e.a = r.b),
g AS (SELECT img_id, a, min(b) AS root FROM r GROUP BY 1, 2)
SELECT n.img_id, min(cx) AS x1, min(cy) AS y1, max(cx) AS x2, max(cy) AS y2, count(*) AS cells FROM n JOIN g ON g.img_id = n.img_id AND g.a = n.k GROUP BY n.img_id, root""",
    "image_peaks": f"""WITH {_PIXELS}, b AS (SELECT img_id, v // 16 AS bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY img_id) AS total FROM px GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, bin) AS k FROM b), top AS (SELECT * FROM t WHERE k = 1),
m AS (SELECT b.img_id, max(b.bin) AS bin FROM b JOIN top ON top.img_id = b.img_id AND b.bin > top.bin AND b.n > b.total // 100 GROUP BY 1)
SELECT top.img_id, top.bin * 16 + 8.0 AS background, round(100.0 * top.n / top.total, 6) AS background_pct, coalesce(m.bin, top.bin) * 16 + 8.0 AS marking, round(100.0 * coalesce(b.n, top.n) / top.total, 6) AS marking_pct FROM top LEFT JOIN m ON m.img_id = top.img_id LEFT JOIN b ON b.img_id = m.img_id AND b.bin = m.bin""",
    "bright_limit": f"WITH {_PIXELS}, b AS (SELECT img_id, v, count(*) AS n FROM px GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY img_id ORDER BY v DESC) AS upto, trunc(sum(n) OVER (PARTITION BY img_id) * 7.5 / 100) AS target FROM b) SELECT img_id, greatest(max(v), 120)::INTEGER AS threshold FROM c WHERE upto >= target GROUP BY 1",
    "color_classes": f"WITH {_PIXELS}, {_CLASS} SELECT class, " + ", ".join(f"round({c}_{n}, 6) AS {c}_{n}" for c in "hsv" for n in ("mean", "std")) + " FROM st",
    "pixel_scores": f"WITH {_PIXELS}, {_CLASS}, sc AS (SELECT px.img_id, {_AWAY.format('o')} AS d_on, {_AWAY.format('f')} AS d_off FROM px, st o, st f WHERE o.class = 'on' AND f.class = 'off') SELECT img_id, round(avg(d_off / (d_on + d_off)), 6) AS score, count(*) FILTER (WHERE d_off / (d_on + d_off) > 0.5) AS n_on FROM sc GROUP BY 1",
    "board_scale": f"WITH {_CONTACTS}, g AS (SELECT board, lead(x) OVER (PARTITION BY board ORDER BY x) - x AS gap FROM c), m AS (SELECT board, list_sort(list(gap))[count(*) // 2 + 1] AS median FROM g WHERE gap IS NOT NULL GROUP BY 1), f AS (SELECT g.board, avg(gap) AS mean FROM g JOIN m ON m.board = g.board WHERE gap > median * 0.7 AND gap < median * 1.3 GROUP BY 1) SELECT n.board, round(CASE WHEN n.n >= 5 AND mean IS NOT NULL THEN mean / 0.125 ELSE 0.0 END, 6) AS dpi FROM (SELECT board, count(*) AS n FROM c GROUP BY 1) n LEFT JOIN f ON f.board = n.board",
    "board_pitch": f"WITH {_CONTACTS}, g AS (SELECT * FROM (SELECT board, round(lead(x) OVER (PARTITION BY board ORDER BY x, ord) - x, 6) AS gap FROM c) WHERE gap IS NOT NULL), l AS (SELECT board, list_sort(list(gap)) AS a, count(*) AS n FROM g GROUP BY 1), q AS (SELECT board, a[(n // 2 + 1) // 2 + 1] AS guess, n FROM l), r AS (SELECT g.board, count(*) AS c, avg(gap) AS mean FROM g JOIN q ON q.board = g.board WHERE abs(gap - guess) < guess * 0.15 GROUP BY 1) SELECT q.board, round(CASE WHEN r.c >= n // 3 THEN mean ELSE guess END, 6) AS pitch FROM q LEFT JOIN r ON r.board = q.board",
    "voted_pitch": f"WITH {_CONTACTS}, f AS (SELECT * FROM c), g AS (SELECT a.board, b.x - a.x AS gap FROM f a JOIN f b ON a.board = b.board AND b.x > a.x WHERE b.x - a.x >= 20), v AS (SELECT board, gap / k AS v FROM (SELECT board, gap, unnest(range(1, floor(gap / 20.0)::BIGINT + 1)) AS k FROM g)), h AS (SELECT board, floor(v)::BIGINT AS bin, count(*) AS votes, avg(v) AS pitch FROM v GROUP BY 1, 2) SELECT board, bin, votes, round(pitch, 6) AS pitch FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY votes DESC, bin) AS k FROM h) WHERE k = 1",
    "board_anchor": f"WITH {_CONTACTS}, f AS (SELECT * FROM c), e AS (SELECT a.board, a.ord, sum(abs(abs(b.x - a.x) - greatest(round(abs(b.x - a.x) / 25.0), 1.0) * 25.0)) AS error FROM f a JOIN f b ON a.board = b.board AND a.ord <> b.ord GROUP BY 1, 2) SELECT board, ord, round(error, 6) AS error FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY error, ord) AS k FROM e) WHERE k = 1",
    "board_turn": f"WITH {_PAIRS}, m AS (SELECT board, avg(x1) AS a1, avg(y1) AS b1, avg(x2) AS a2, avg(y2) AS b2 FROM p GROUP BY 1), t AS (SELECT p.board, any_value(a1) AS a1, any_value(b1) AS b1, any_value(a2) AS a2, any_value(b2) AS b2, atan2(sum((x1 - a1) * (y2 - b2) - (y1 - b1) * (x2 - a2)), sum((x1 - a1) * (x2 - a2) + (y1 - b1) * (y2 - b2))) AS angle FROM p JOIN m ON m.board = p.board GROUP BY 1) SELECT board, round(angle, 6) AS angle, round(a2 - cos(angle) * a1 + sin(angle) * b1, 6) AS tx, round(b2 - sin(angle) * a1 - cos(angle) * b1, 6) AS ty FROM t",
    "board_affine": f"""WITH {_PAIRS}, m AS (SELECT board, avg(x1) AS a1, avg(y1) AS b1, avg(x2) AS a2, avg(y2) AS b2 FROM p GROUP BY 1),
t AS (SELECT p.board, any_value(a1) AS a1, any_value(b1) AS b1, any_value(a2) AS a2, any_value(b2) AS b2, sum((x1 - a1) * (x1 - a1)) AS xx, sum((x1 - a1) * (y1 - b1)) AS xy, sum((y1 - b1) * (y1 - b1)) AS yy, sum((x1 - a1) * (x2 - a2)) AS xu, sum((y1 - b1) * (x2 - a2)) AS yu, sum((x1 - a1) * (y2 - b2)) AS xw, sum((y1 - b1) * (y2 - b2)) AS yw FROM p JOIN m ON m.board = p.board GROUP BY 1),
f AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b, (xw * yy - yw * xy) / (xx * yy - xy * xy) AS c, (yw * xx - xw * xy) / (xx * yy - xy * xy) AS d FROM t),
g AS (SELECT *, a2 - a * a1 - b * b1 AS tx, b2 - c * a1 - d * b1 AS ty FROM f),
e AS (SELECT p.board, avg(sqrt(pow(a * x1 + b * y1 + tx - x2, 2) + pow(c * x1 + d * y1 + ty - y2, 2))) AS error FROM p JOIN g ON g.board = p.board GROUP BY 1)
SELECT g.board, round(a, 4) AS a, round(b, 4) AS b, round(tx, 4) AS tx, round(c, 4) AS c, round(d, 4) AS d, round(ty, 4) AS ty, round(error, 4) AS error FROM g JOIN e ON e.board = g.board""",
    "name_axes": "SELECT DISTINCT p_partkey % 3 AS board, 'Y' AS letter_axis, 'X' AS number_axis, 'LN' AS format FROM part",
    "package_names": "WITH p AS (SELECT p_partkey, p_size * 0.5 AS w, round(p_retailprice / 40 / 2.54) * 2 AS n FROM part), o AS (SELECT p_partkey, c, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(n - c), c) AS k FROM p, (SELECT unnest([8, 14, 16, 18, 20, 24, 28, 40]) AS c) WHERE (w > 11 AND c IN (24, 28, 40)) OR (w <= 11 AND c < 40)) SELECT p_partkey, 'DIP-' || c AS package FROM o WHERE k = 1",
    "package_pins": "WITH p AS (SELECT p_partkey AS id, (p_size % 4) * 2 + 14 AS n FROM part), q AS (SELECT id, n, unnest(range(1, n + 1))::INTEGER AS pin FROM p) SELECT id, pin, round(50 + CASE WHEN pin <= n / 2 THEN -38.1 ELSE 38.1 END, 6) AS x, round(150 + (CASE WHEN pin <= n / 2 THEN pin - 1 ELSE n - pin END - (n / 2 - 1) / 2) * 25.4, 6) AS y, CASE WHEN pin <= n / 2 THEN 1 ELSE 2 END AS row FROM q",
    "via_sides": "SELECT count(*) FILTER (WHERE label % 3 = 0) AS front, count(*) FILTER (WHERE label % 3 <> 0) AS back FROM embeddings",
    "next_net": "SELECT (max(o_orderkey) + 1)::INTEGER AS number FROM orders",
    "merged_parts": "SELECT p_partkey, p_brand, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size FROM part",
    "gate_pins": "WITH f AS (SELECT p_partkey AS k FROM part), r AS (SELECT k, k % 7 AS pin, 0 AS rank, 'input' AS role FROM f UNION ALL SELECT k, k % 7 + 1, 0, 'input' FROM f UNION ALL SELECT k, k % 4 + 1, 1, 'clock' FROM f UNION ALL SELECT k, k % 3, 2, 'enable' FROM f UNION ALL SELECT k, k % 5 + 7, 3, 'output' FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY k, pin ORDER BY rank) AS i FROM r) SELECT k::VARCHAR AS function, pin::INTEGER AS pin_number, role FROM b WHERE i = 1",
    "netlist_lines": "WITH s AS (SELECT 'U' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS part, s_nationkey, s_suppkey FROM supplier), n AS (SELECT n_name AS name, n_nationkey, row_number() OVER (ORDER BY n_name) AS code FROM nation), l AS (SELECT 0 AS part, unnest(['(export (version \"E\")', '  (design', '    (source \"board\")', '    (tool \"tracewright\")', '  )', '  (components']) AS line UNION ALL SELECT 2, unnest(['  )', '  (nets']) UNION ALL SELECT 4, unnest(['  )', ')']) UNION ALL SELECT 1, '    (comp (ref \"' || id || '\")' FROM s UNION ALL SELECT 1, '      (value \"' || part || '\")' FROM s WHERE part <> '' UNION ALL SELECT 1, '      (footprint \"DIP-14\")' FROM s UNION ALL SELECT 1, '    )' FROM s UNION ALL SELECT 3, '    (net (code \"' || code || '\") (name \"' || name || '\")' FROM n UNION ALL SELECT 3, '    )' FROM n UNION ALL SELECT 3, '      (node (ref \"' || id || '\") (pin \"' || (s_suppkey % 14 + 1) || '\"))' FROM s JOIN n ON n_nationkey = s_nationkey) SELECT part, count(*) AS n, sum(length(line))::BIGINT AS chars FROM l GROUP BY 1",
    "spice_lines": "WITH s AS (SELECT 'U' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS part, s_nationkey, s_suppkey FROM supplier) SELECT 1 AS part, '* ' || id || ': ' || part || ' (DIP-14)' AS line FROM s UNION ALL SELECT 3, '* ' || n_name || ':' || coalesce((SELECT string_agg(' ' || id || '.' || (s_suppkey % 14 + 1), '' ORDER BY s_suppkey) FROM s WHERE s_nationkey = n_nationkey), '') FROM nation",
}
