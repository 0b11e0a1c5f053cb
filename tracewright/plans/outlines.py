"""Queries on outlines seen from two sides, pins beside known pins, and board specs by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import outlines
from tracewright.functions.geometry import circle, point
from tracewright.operators import packages, selecting
from tracewright.plans.inputs import POINTS, points, table


def _two_sides(spark, d):
    """(id, front, back): readings of each point from two sides, with boundaries of 0, 2, 4 and of 0 or 5 points."""
    k = F.col("id")

    def reading(shift, radius, n):
        x = F.col("x") + shift
        return F.struct(point(x, F.col("y")).alias("center"), radius.cast("double").alias("radius"), F.slice(circle(x, F.col("y"), radius.cast("double"), 5), 1, n.cast("int")).alias("boundary"), F.lit(False).alias("is_circle"))

    return points(spark, d).select("id", reading(0, k % 5 + 1, k % 3 * 2).alias("front"), reading(1, k % 4 * (k % 2), k % 2 * 5).alias("back"))


_SIDES = f"""WITH {POINTS}, v AS (SELECT id, x, y, id % 5 + 1 AS fr, id % 4 * (id % 2) AS br, id % 3 * 2 AS fn, id % 2 * 5 AS bn FROM points),
c AS (SELECT v.*, k, x + fr * cos(k * 2 * pi() / 5) AS fx, y + fr * sin(k * 2 * pi() / 5) AS fy, x + 1 + br * cos(k * 2 * pi() / 5) AS bx, y + br * sin(k * 2 * pi() / 5) AS "by" FROM v, range(5) r(k))"""


def via_outlines(spark, d):
    """Size, centre and radius of the circle of each via seen from two sides."""
    sides = _two_sides(spark, d)
    via = lambda c: F.struct(F.col(c)["center"].alias("center"), F.col(c)["radius"].alias("radius"), F.col(c)["boundary"].alias("pad_boundary"))
    out = sides.select("id", outlines.confirmed_outline(via("front"), via("back")).alias("o"), ((F.col("front.center.x") + F.col("back.center.x")) / 2).alias("x"))
    return out.select("id", F.size("o").alias("n"), F.round(F.get("o", F.lit(0))["x"] - F.col("x"), 7).alias("radius"), F.round(F.get("o", F.lit(0))["y"], 7).alias("y"))


def merged_outlines(spark, d):
    """Centre and radius of the boundary of both readings."""
    m = _two_sides(spark, d).select("id", outlines.merged_boundary(F.col("front"), F.col("back")).alias("m"))
    return m.select("id", F.round("m.center.x", 7).alias("x"), F.round("m.center.y", 7).alias("y"), F.round("m.radius", 7).alias("radius"), "m.is_circle")


def neighbour_pins(spark, d):
    """Pins of every third line, guessed from the other lines of the order; of lines of one number the first in the file."""
    lines = table(spark, d, "lineitem")
    row = F.struct("_metadata.file_path", "_metadata.row_index")
    k = F.col("l_linenumber")
    pin = F.when(F.col("l_suppkey") % 3 > 0, k.cast("string")).otherwise("")
    via = F.struct(pin.alias("pin"), (k * 20.0 + F.col("l_partkey") % 7).alias("x"), (F.col("l_partkey") % 3 * 20.0).alias("y"))
    vias = lines.groupBy(F.col("l_orderkey").alias("component"), k.alias("id")).agg(F.min_by(via, row).alias("via"))
    return packages.pin_by_neighbours(vias.select("component", "id", "via.*"), 200.0)


def spec_list(spark, d):
    return selecting.spec_names(table(spark, d, "part").select(F.col("p_type").alias("name")))


QUERIES = {f.__name__: f for f in (via_outlines, merged_outlines, neighbour_pins, spec_list)}

SQL = {
    "via_outlines": f"""{_SIDES}, m AS (SELECT id, any_value(y) AS y, any_value(fr) AS fr, any_value(br) AS br, any_value(fn) AS fn, any_value(bn) AS bn,
max(sqrt(pow(fx - x - 0.5, 2) + pow(fy - y, 2))) FILTER (WHERE k < fn AND fn >= 3) AS f, max(sqrt(pow(bx - x - 0.5, 2) + pow("by" - y, 2))) FILTER (WHERE k < bn) AS b FROM c GROUP BY id),
r AS (SELECT *, 0.95 * greatest(coalesce(f, 0), coalesce(b, 0)) AS reach FROM m)
SELECT id, 32 AS n, round(CASE WHEN f IS NULL AND b IS NULL THEN (fr + br) / 2 ELSE least(CASE WHEN f IS NOT NULL AND b IS NOT NULL AND reach < 1 THEN (fr + br) / 2 ELSE reach END, greatest(fr, br)) END, 7) AS radius, round(y, 7) AS y FROM r""",
    "merged_outlines": f"""{_SIDES}, p AS (SELECT id, fx AS px, fy AS py FROM c WHERE k < fn UNION ALL SELECT id, bx, "by" FROM c WHERE k < bn
UNION ALL SELECT id, x + fr * cos(k * 2 * pi() / 32), y + fr * sin(k * 2 * pi() / 32) FROM v, range(32) r(k) WHERE fn = 0
UNION ALL SELECT id, x + 1 + br * cos(k * 2 * pi() / 32), y + br * sin(k * 2 * pi() / 32) FROM v, range(32) r(k) WHERE bn = 0 AND br > 0),
m AS (SELECT id, avg(px) AS mx, avg(py) AS my, count(*) AS n FROM p GROUP BY id), d AS (SELECT id, max(sqrt(pow(px - mx, 2) + pow(py - my, 2))) AS r FROM p JOIN m USING (id) GROUP BY id)
SELECT id, round(CASE WHEN n < 3 THEN x ELSE mx END, 7) AS x, round(CASE WHEN n < 3 THEN y ELSE my END, 7) AS y, round(CASE WHEN n < 3 THEN fr ELSE r END, 7) AS radius, false AS is_circle FROM v JOIN m USING (id) JOIN d USING (id)""",
    "neighbour_pins": """WITH v AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS c, l_linenumber AS id, l_suppkey % 3 > 0 AS named, l_linenumber * 20.0::DOUBLE + l_partkey % 7 AS x, l_partkey % 3 * 20.0::DOUBLE AS y FROM lineitem),
p AS (SELECT a.c, a.id, a.x, a.y, b.id AS n, b.x AS px, b.y AS py, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS far FROM v a JOIN v b ON a.c = b.c WHERE NOT a.named AND b.named),
k AS (SELECT *, row_number() OVER (PARTITION BY c, id ORDER BY far, n) AS k FROM p),
j AS (SELECT a.c, a.id, a.n, round(sqrt(a.far) / 20) AS steps, b.n - a.n AS diff, (a.x - a.px) * (b.px - a.px) + (a.y - a.py) * (b.py - a.py) AS dot, round(sqrt(pow(b.px - a.px, 2) + pow(b.py - a.py, 2)) / 20) AS apart FROM k a LEFT JOIN k b ON b.c = a.c AND b.id = a.id AND b.k = 2 WHERE a.k = 1),
g AS (SELECT *, n + steps * sign(diff) * CASE WHEN dot < 0 THEN -1 ELSE 1 END AS t FROM j)
SELECT c AS component, id, (CASE WHEN coalesce(diff <> 0 AND apart > 0 AND t >= 1, false) THEN t ELSE n + steps END)::INTEGER AS pin FROM g WHERE steps >= 1""",
    "spec_list": "SELECT DISTINCT p_type AS name FROM part WHERE p_type IS NOT NULL",
}
