"""Queries on texts, boxes, points, outlines, paths and colours of single records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import boxes, geometry, polygons, records, routing
from tracewright.operators.packages import is_dip_width
from tracewright.operators.pixels import box_figures, color_histogram, colors_around, feature_figures, white_share
from tracewright.operators.selecting import invalid_specs
from tracewright.plans.inputs import table
from tracewright.plans.layout import _PIXELS, _pixels


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _sql_pick(names, k="k"):
    return f"[{', '.join('NULL' if n is None else repr(n) for n in names)}][({k} % {len(names)} + 1)::INTEGER]"


GATES, WAYS, SENSES = ["CONNECTOR", "TRISTATE", "NAND", "NOT"], ["input", "enable", "clock", "output", "power", "other", "output"], ["Active High", "Active Low", "Rising Edge", "Falling Edge", "low", None]


def record_texts(spark, d):
    k, p = F.col("p_partkey"), table(spark, d, "part")
    pin, signal = (k % 14 + 1).cast("string"), F.when(k % 3 == 0, "").otherwise(F.col("p_brand"))
    links = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), k % 4), lambda i: F.concat(F.lit("U"), i))).otherwise(F.array().cast("array<string>"))
    truth = F.when(k % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit("\n<"), "p_brand", F.lit(">\n"))).otherwise(F.col("p_name"))
    return p.select(
        k.alias("id"), records.pin_ref(F.concat(F.lit("U"), k), pin, signal).alias("ref"), records.pin_line(pin, signal, F.concat(F.lit("net-"), k), links).alias("line"),
        records.grid_text(F.char((k % 26 + 65).cast("int")), k % 50, k % 2 == 0).alias("grid"), records.edge_pin_name(k % 50, k % 2 == 0).alias("edge"),
        records.electrical_type(_pick(GATES, k), _pick(WAYS, k), k % 5 == 0).alias("kind"), records.logic_sense(_pick(SENSES, k)).alias("sense"),
        records.date_text((k % 30 + 1990).cast("int"), (k % 12 + 1).cast("int"), (k % 5).cast("int"), k % 2 == 0, k % 3 == 0).alias("date"), records.sample_figures(truth).alias("f"),
    ).select("*", "f.*").drop("f")


def record_figures(spark, d):
    k, p = F.col("p_partkey"), table(spark, d, "part")
    places = records.contact_places(F.lit(0.5), F.lit(0.125), (k % 60).cast("int"))
    limits = records.radius_limits(k % 7 * 100.0, 0.02, 0.05)
    pixel = F.struct((k % 180).alias("h"), (k % 250).alias("s"), (k % 256).alias("v"))
    figures = F.struct(*(F.lit(v).alias(n) for n, v in (("h_mean", 60.0), ("h_std", 9.0), ("s_mean", 100.0), ("s_std", 19.0), ("v_mean", 120.0), ("v_std", 29.0))))
    score = records.class_score(F.when(k % 9 > 0, k % 5 * 1.0), k % 3 * 2.0)
    six = lambda c, n: F.round(c, 6).alias(n)
    return p.select(
        k.alias("id"), six(records.contact_span(k % 60, F.lit(0.125), F.lit(0.08)), "span"), F.size(places).alias("n_places"), six(F.try_element_at(places, F.lit(-1)), "last_place"),
        six(records.match_tolerance(k % 7 * 100.0), "tolerance"), limits["least"].alias("least"), limits["most"].alias("most"), limits["apart"].alias("apart"),
        six(records.color_distance(pixel, figures), "away"), six(score, "score"), six(records.confirmed_score(score, k % 2 == 0, 0.4), "confirmed"),
        records.bucket(k % 256, 16).alias("bucket"), records.is_dip_length(F.col("p_retailprice") / 40).alias("dip"), is_dip_width(F.col("p_size") * 0.5).alias("narrow"),
    )


def spec_problems(spark, d):
    k = F.col("s_suppkey")
    contacts = F.when(k % 4 > 0, F.struct((k % 5 - 1).alias("count"), (k % 7 - 1.0).alias("pitch_inches")))
    specs = table(spark, d, "supplier").select(F.when(k % 11 == 0, "").otherwise(F.col("s_name")).alias("name"), (k % 13 * 1.0).alias("width_inches"), F.lit(5.0).alias("height_inches"), contacts.alias("contacts"), F.when(k % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("alignment_methods"))
    return invalid_specs(specs)


def box_moves(spark, d):
    k = F.col("o_orderkey").cast("int")
    a, b = boxes.box(k % 97, k % 89, k % 31 + 1, k % 29 + 1), boxes.box(k % 83, k % 79, k % 37 + 1, k % 41 + 1)
    union, back, turned = boxes.box_union(a, b), boxes.turned_back(a, k % 5 * 90, F.lit(200), F.lit(150)), boxes.turned_board(a, F.lit(200), F.lit(150), F.lit(150), F.lit(200), F.lit(90.0))
    center = boxes.box_center(b)
    flat = lambda r, n: [r[c].alias(f"{n}_{c}") for c in ("x", "y", "width", "height")]
    return table(spark, d, "orders").select(k.alias("id"), *flat(union, "union"), *flat(back, "back"), *flat(turned, "turned"), F.round(boxes.overlap_share(a, b), 6).alias("share"), geometry.overlaps(a, b).alias("meet"), geometry.inside(center, a).alias("holds"), center["x"].alias("cx"), center["y"].alias("cy"))


def point_moves(spark, d):
    k = F.col("o_orderkey")
    p, q = geometry.point(k % 101, k % 103), geometry.point(k % 107 - 50, k % 109 - 50)
    turn = boxes.rotation(F.radians(k % 360))
    scale = F.struct((k % 3 + 1.0).alias("a"), F.lit(0.5).alias("b"), F.lit(7.0).alias("tx"), F.lit(0.0).alias("c"), (k % 5 * 1.0).alias("d"), F.lit(-3.0).alias("ty"))
    both = boxes.composed(turn, scale)
    moved, back = geometry.affine(p, both), geometry.affine(geometry.affine(p, scale), geometry.inverse(scale))
    corners = [geometry.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (10, 0), (0, 10))]
    found = boxes.affine_through(corners, [geometry.affine(c, scale) for c in corners])
    color = geometry.hsv(k % 256, k % 251, k % 241)
    six = lambda c, n: (F.round(c, 6) + F.lit(0.0)).alias(n)
    return table(spark, d, "orders").select(
        k.alias("id"), six(geometry.distance(p, q), "apart"), six(moved["x"], "mx"), six(moved["y"], "my"), six(back["x"], "bx"), six(back["y"], "by"),
        six(found["a"], "fa"), six(found["d"], "fd"), six(found["tx"], "ftx"), six(geometry.segment_distance(p, geometry.point(F.lit(0), F.lit(0)), q), "off"),
        six(color["h"], "h"), six(color["s"], "s"), six(color["v"], "v"),
    )


def outline_figures(spark, d):
    """Circles of eight points around suppliers: the hull of the points and the centre, its right half, and more."""
    k = F.col("s_suppkey")
    x, y, r = k * 3.0, k % 17 * 1.0, k % 5 + 1.0
    ring = geometry.circle(x, y, r, 8)
    hull = F.col("hull")
    window = F.array(geometry.point(x, y - 99), geometry.point(x + 99, y - 99), geometry.point(x + 99, y + 99), geometry.point(x, y + 99))
    base = table(spark, d, "supplier").select(k.alias("id"), x.alias("x"), y.alias("y"), r.alias("r"), ring.alias("ring"), polygons.convex_hull(F.concat(ring, F.array(geometry.point(x, y)))).alias("hull"), window.alias("window"))
    base = base.withColumn("half", polygons.clip(F.col("ring"), F.col("window")))
    area = lambda c: F.abs(F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), F.lit(0.0), lambda s, i: s + F.get(c, i)["x"] * F.get(c, F.pmod(i + 1, F.size(c)))["y"] - F.get(c, F.pmod(i + 1, F.size(c)))["x"] * F.get(c, i)["y"])) / 2
    box, center = geometry.bounds(F.col("ring")), geometry.centroid(F.col("ring"))
    four = lambda c, n: F.round(c, 4).alias(n)
    return base.select(
        "id", F.size(hull).alias("corners"), four(area(hull), "area"), four(area(F.col("half")), "half"), four(box["width"], "width"), four(center["x"], "cx"), four(center["y"], "cy"), four(geometry.path_length(F.col("ring")), "around"),
        geometry.in_polygon(geometry.point(F.col("x") + F.col("r") / 2, F.col("y") + 0.1), F.col("ring")).alias("inside"), geometry.in_polygon(geometry.point(F.col("x") + F.col("r") * 2, F.col("y")), F.col("ring")).alias("outside"), polygons.is_convex(F.col("ring")).alias("convex"),
    )


def path_figures(spark, d):
    """Paths with doubled and straight points, nearly square outlines and shuffled corners, by supplier."""
    k = F.col("s_suppkey")
    at = lambda x, y: geometry.point(F.lit(x) if isinstance(x, (int, float)) else x, F.lit(y) if isinstance(y, (int, float)) else y)
    path = F.array(at(0, 0), at(0, 0), at(1, 0), at(2, 0), at(k * 1.0 + 3, 0), at(k * 1.0 + 3, 5), at(k * 1.0 + 3, 9))
    outline = F.array(at(0, 0), at(100, k % 3), at(101, 80), at(0, 80 + k % 5))
    corners = F.array(at(k, 50), at(0, 0), at(0, 50 + k % 7), at(k, k % 11))
    s = table(spark, d, "supplier").select(k.alias("id"), path.alias("path"), boxes.squared_outline(outline, 2.0).alias("square"), records.corner_order(corners).alias("corners"))
    s = s.withColumn("once", polygons.distinct_path(F.col("path")))
    straight, simple, turned = polygons.straighten(F.col("once")), polygons.simplify(F.col("once"), F.lit(0.5)), polygons.suppress_turns(F.col("once"), F.lit(45.0))
    flat = lambda c, n: [F.get(c, i)[f].alias(f"{n}{i}{f}") for i in range(4) for f in "xy"]
    return s.select("id", F.size("once").alias("once"), F.size(straight).alias("straight"), F.size(simple).alias("simple"), F.size(turned).alias("turned"), geometry.path_length(F.col("path")).alias("length"), *flat(F.col("square"), "q"), *flat(F.col("corners"), "c"))


def wire_paths(spark, d):
    k = F.col("o_orderkey")
    a, b = geometry.point(k % 40 * 5, k % 30 * 5), geometry.point(k % 23 * 5, k % 19 * 5)
    path = routing.manhattan(a, b, k % 2 == 0)
    own = F.array(routing.segment(geometry.point(F.lit(0), F.lit(50)), geometry.point(F.lit(500), F.lit(50))))
    found = routing.channels(a["x"], b["x"], 30.0, 10.0, 20.0)
    tip = routing.pin_tip(a, geometry.point(F.lit(30), F.lit(10)), k % 2 == 0, k % 3 == 0, k % 4 * 90)
    level = routing.segment(geometry.point(F.lit(0), a["y"]), a)
    return table(spark, d, "orders").select(k.alias("id"), F.size(path).alias("points"), F.get(path, F.lit(1))["x"].alias("turn_x"), routing.path_score(path, own).alias("score"), F.array_join(F.transform(found, lambda v: v.cast("int").cast("string")), ",").alias("channels"), tip["x"].alias("tip_x"), tip["y"].alias("tip_y"), routing.on_segment(geometry.point(k % 50, a["y"]), level).alias("on_level"))


MODES = ["normal", "multiply", "screen", "overlay", "difference"]


def blended_pixels(spark, d):
    k = F.col("o_orderkey")
    rgba = lambda m: F.struct(*((k * f % m).alias(c) for c, f in zip("rgba", (3, 5, 7, 11), strict=True)))
    out = records.blended(rgba(256), rgba(251), _pick(MODES, k), k % 4 / 4.0)
    return table(spark, d, "orders").select(k.alias("id"), *(out[c].alias(c) for c in "rgba"))


def picture_histogram(spark, d):
    return color_histogram(_pixels(spark, d)).withColumn("percent", F.round("percent", 6))


def white_shares(spark, d):
    return white_share(_pixels(spark, d)).withColumn("percent", F.round("percent", 6))


def box_colors(spark, d):
    f = box_figures(_pixels(spark, d), 10, 10, 40, 30)
    return f.select("img_id", *(F.round(c, 6).alias(c) for c in f.columns[1:]))


def contact_colors(spark, d):
    """Colours around contacts that lie where suppliers' numbers put them, on each picture."""
    flags = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("img_id")).distinct()
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 60).cast("int").alias("x"), (F.col("s_suppkey") % 44).cast("int").alias("y"))
    c = colors_around(_pixels(spark, d), flags.join(F.broadcast(s.distinct()), F.lit(True)), 2)  # at most 60 * 44 places
    return c.select("img_id", *(F.round(x, 6).alias(x) for x in "hsv"))


def sample_classes(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 3 == 0).alias("is_via"), "p_size", "p_retailprice")
    f = feature_figures(p, ["p_size", "p_retailprice"])
    return f.select("is_via", *(F.round(c, 6).alias(c) for c in f.columns[1:]))


QUERIES = {f.__name__: f for f in (record_texts, record_figures, spec_problems, box_moves, point_moves, outline_figures, path_figures, wire_paths, blended_pixels, picture_histogram, white_shares, box_colors, contact_colors, sample_classes)}

_SIGNAL = "CASE WHEN k % 3 = 0 THEN '' ELSE p_brand END"
_BRACKET = "CASE WHEN k % 3 = 0 THEN '' ELSE '(' || p_brand || ')' END"
_TRUTH = "CASE WHEN k % 3 = 0 THEN ' ' || p_name || chr(10) || '<' || p_brand || '>' || chr(10) ELSE p_name END"
_LABEL = f"(k % 14 + 1) || {_BRACKET}"
_BLEND = {"normal": "s", "multiply": "s * d", "screen": "1 - (1 - s) * (1 - d)", "overlay": "CASE WHEN d < 0.5 THEN 2 * s * d ELSE 1 - 2 * (1 - s) * (1 - d) END", "difference": "abs(s - d)"}


def _blend_sql(c: str, f: int) -> str:
    s, d = f"(k * {f} % 251) / 255.0::DOUBLE", f"(k * {f} % 256) / 255.0::DOUBLE"
    mixed = "CASE k % 5 " + " ".join(f"WHEN {i} THEN {_BLEND[m]}" for i, m in enumerate(MODES)) + " END"
    return f"(SELECT trunc(greatest(0.0, least(1.0, ({mixed}) * al + d * (1 - al))) * 255)::INTEGER FROM (SELECT {s} AS s, {d} AS d)) AS {c}"


SQL = {
    "record_texts": f"""WITH p AS (SELECT p_partkey AS k, p_name, p_brand FROM part)
SELECT k AS id, 'U' || k || '-' || (k % 14 + 1) || {_BRACKET} AS ref,
  '    pin ' || CASE WHEN length({_LABEL}) < 12 THEN rpad({_LABEL}, 12, ' ') ELSE {_LABEL} END || ' [net-' || k || '] ' || CASE k % 4 WHEN 0 THEN '(no connections)' WHEN 1 THEN '-> U1' WHEN 2 THEN '-> U1, U2' ELSE '-> U1, U2, U3' END AS line,
  CASE WHEN k % 2 = 0 THEN chr((k % 26 + 65)::INTEGER) || (k % 50) ELSE (k % 50) || chr((k % 26 + 65)::INTEGER) END AS grid,
  chr((65 + (k % 50 + CASE WHEN k % 2 = 0 THEN 0 ELSE 50 END) // 26)::INTEGER) || (k % 10) AS edge,
  CASE WHEN k % 4 = 0 THEN 'bidirectional' WHEN k % 7 < 3 THEN 'input' WHEN k % 7 IN (3, 6) THEN CASE WHEN k % 4 = 1 OR k % 5 = 0 THEN 'tri_state' ELSE 'output' END WHEN k % 7 = 4 THEN 'power_in' ELSE 'passive' END AS kind,
  CASE WHEN k % 6 < 4 THEN {_sql_pick(SENSES)} ELSE 'Active High' END AS sense,
  {_sql_pick(records.MONTH_NAMES)} || ' ' || (k % 30 + 1990) || CASE WHEN k % 2 = 0 THEN ' (or ' || (k % 30 + 1980) || ', ' || (k % 30 + 2000) || ')' ELSE '' END || CASE WHEN k % 5 > 0 THEN ', week ' || (k % 5) || CASE WHEN k % 3 = 0 THEN ' of month' ELSE '' END ELSE '' END AS date,
  strlen(replace({_TRUTH}, ' ', ''))::INTEGER AS text_length, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS line_count, k % 3 = 0 AS has_logos FROM p""",
    "record_figures": """WITH p AS (SELECT p_partkey AS k, p_size, p_retailprice, k % 7 * 100.0::DOUBLE AS dpi, CASE WHEN k % 9 > 0 THEN k % 5 * 1.0::DOUBLE END AS a, k % 3 * 2.0::DOUBLE AS b FROM part),
q AS (SELECT *, greatest(trunc(dpi * 0.02 / 2)::INTEGER, 3) AS low, trunc(dpi * 0.05 / 2)::INTEGER AS high, CASE WHEN a IS NULL OR (a = 0 AND b = 0) THEN 0.5::DOUBLE ELSE (1 / (a + 0.001)) / (1 / (a + 0.001) + 1 / (b + 0.001)) END AS sc FROM p)
SELECT k AS id, round(CASE WHEN k % 60 = 0 THEN 0.0::DOUBLE ELSE (k % 60 - 1) * 0.125::DOUBLE + 0.08 END, 6) AS span, (k % 60)::INTEGER AS n_places, CASE WHEN k % 60 > 0 THEN round(0.5 + (k % 60 - 1) * 0.125::DOUBLE, 6) END AS last_place,
  round(CASE WHEN dpi > 0 THEN dpi * 0.015 ELSE 15.0 END, 6)::DOUBLE AS tolerance, CASE WHEN dpi > 0 THEN low END AS least, CASE WHEN dpi > 0 THEN CASE WHEN high < low THEN low * 2 ELSE high END END AS most, CASE WHEN dpi > 0 THEN greatest(10, low * 2) END AS apart,
  round(sqrt(pow((k % 180 - 60) / 10.0::DOUBLE, 2) + 1.5 * pow((k % 250 - 100) / 20.0::DOUBLE, 2) + 1.5 * pow((k % 256 - 120) / 30.0::DOUBLE, 2)), 6) AS away, round(sc, 6) AS score, round(CASE WHEN k % 2 = 0 THEN sc * 0.6 + 0.4 ELSE sc * 0.88 END, 6)::DOUBLE AS confirmed,
  least(k % 256 // 16, 15)::INTEGER AS bucket, true AS dip, abs(p_size * 0.5 - 7.62) <= 1.5 OR abs(p_size * 0.5 - 15.24) <= 1.5 AS narrow FROM q""",
    "spec_problems": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name END AS name FROM supplier),
p AS (SELECT name, CASE WHEN name = '' THEN 'board spec name is required' WHEN k % 13 = 0 THEN 'board dimensions must be positive' WHEN k % 4 > 0 AND k % 5 - 1 <= 0 THEN 'contact count must be positive' WHEN k % 4 > 0 AND k % 7 - 1 <= 0 THEN 'contact pitch must be positive' WHEN k % 3 = 0 THEN 'at least one alignment method is required' END AS problem FROM s)
SELECT * FROM p WHERE problem IS NOT NULL""",
    "box_moves": """WITH o AS (SELECT o_orderkey::INTEGER AS k FROM orders), b AS (SELECT k, k % 97 AS ax, k % 89 AS ay, k % 31 + 1 AS aw, k % 29 + 1 AS ah, k % 83 AS bx, k % 79 AS by_, k % 37 + 1 AS bw, k % 41 + 1 AS bh FROM o),
c AS (SELECT *, least(ax + aw, bx + bw) - greatest(ax, bx) AS w, least(ay + ah, by_ + bh) - greatest(ay, by_) AS h FROM b)
SELECT k AS id, least(ax, bx) AS union_x, least(ay, by_) AS union_y, greatest(ax + aw, bx + bw) - least(ax, bx) AS union_width, greatest(ay + ah, by_ + bh) - least(ay, by_) AS union_height,
  CASE k % 5 WHEN 1 THEN 150 - ay - ah WHEN 2 THEN 200 - ax - aw WHEN 3 THEN ay ELSE ax END AS back_x, CASE k % 5 WHEN 1 THEN ax WHEN 2 THEN 150 - ay - ah WHEN 3 THEN 200 - ax - aw ELSE ay END AS back_y,
  CASE WHEN k % 5 IN (1, 3) THEN ah ELSE aw END AS back_width, CASE WHEN k % 5 IN (1, 3) THEN aw ELSE ah END AS back_height,
  trunc((ax + aw / 2 - 100) * cos(radians(90)) - (ay + ah / 2 - 75) * sin(radians(90)) + 75)::INTEGER - greatest(aw, ah) // 2 AS turned_x, trunc((ax + aw / 2 - 100) * sin(radians(90)) + (ay + ah / 2 - 75) * cos(radians(90)) + 100)::INTEGER - least(aw, ah) // 2 AS turned_y, greatest(aw, ah) AS turned_width, least(aw, ah) AS turned_height,
  round(CASE WHEN w > 0 AND h > 0 THEN w * h / least(aw * ah, bw * bh) ELSE 0.0 END, 6)::DOUBLE AS share, w > 0 AND h > 0 AS meet,
  bx + bw / 2 BETWEEN ax AND ax + aw AND by_ + bh / 2 BETWEEN ay AND ay + ah AS holds, (bx + bw / 2)::DOUBLE AS cx, (by_ + bh / 2)::DOUBLE AS cy FROM c""",
    "point_moves": """WITH o AS (SELECT o_orderkey AS k, (k % 101)::DOUBLE AS px, (k % 103)::DOUBLE AS py, (k % 107 - 50)::DOUBLE AS qx, (k % 109 - 50)::DOUBLE AS qy, radians(k % 360) AS r, (k % 3 + 1)::DOUBLE AS sa, (k % 5)::DOUBLE AS sd, (k % 256)::DOUBLE AS cr, (k % 251)::DOUBLE AS cg, (k % 241)::DOUBLE AS cb FROM orders),
m AS (SELECT *, sa * px + 0.5 * py + 7 AS ux, sd * py - 3 AS uy, greatest(cr, cg, cb) AS top, greatest(cr, cg, cb) - least(cr, cg, cb) AS span, greatest(0.0, least(1.0, coalesce((px * qx + py * qy) / nullif(qx * qx + qy * qy, 0), 0))) AS t FROM o)
SELECT k AS id, round(sqrt(pow(px - qx, 2) + pow(py - qy, 2)), 6) AS apart, round(cos(r) * ux - sin(r) * uy, 6) + 0.0 AS mx, round(sin(r) * ux + cos(r) * uy, 6) + 0.0 AS my, CASE WHEN sd > 0 THEN px END AS bx, CASE WHEN sd > 0 THEN py END AS by, sa AS fa, sd AS fd, 7.0::DOUBLE AS ftx,
  round(sqrt(pow(px - t * qx, 2) + pow(py - t * qy, 2)), 6) AS off,
  round(CASE WHEN span = 0 THEN 0 WHEN top = cr THEN ((60 * (cg - cb) / span + 360) % 360) / 2 WHEN top = cg THEN (60 * (cb - cr) / span + 120) / 2 ELSE (60 * (cr - cg) / span + 240) / 2 END, 6) + 0.0 AS h, round(CASE WHEN top = 0 THEN 0 ELSE 255 * span / top END, 6) + 0.0 AS s, top AS v FROM m""",
    "outline_figures": "WITH s AS (SELECT s_suppkey AS id, s_suppkey * 3.0::DOUBLE AS x, (s_suppkey % 17)::DOUBLE AS y, (s_suppkey % 5 + 1)::DOUBLE AS r FROM supplier) SELECT id, 8 AS corners, round(4 * r * r * sin(pi() / 4), 4) AS area, round(2 * r * r * sin(pi() / 4), 4) AS half, round(2 * r, 4) AS width, x AS cx, y AS cy, round(14 * r * sin(pi() / 8), 4) AS around, true AS inside, false AS outside, true AS convex FROM s",
    "path_figures": """WITH s AS (SELECT s_suppkey AS k FROM supplier), q AS (SELECT k, (k % 3)::DOUBLE AS e, (k % 5)::DOUBLE AS f FROM s),
r AS (SELECT *, CASE WHEN e <= 2 THEN e / 2 END AS low, CASE WHEN f <= 2 THEN (80 + 80 + f) / 2 END AS high FROM q),
p AS (SELECT k, list_sort([[50, k], [0, 0], [50 + k % 7, 0], [k % 11, k]]) AS c FROM s)
SELECT r.k AS id, 6 AS once, 3 AS straight, 3 AS simple, 3 AS turned, (r.k + 3 + 9)::DOUBLE AS length, 0.0::DOUBLE AS q0x, coalesce(low, 0.0)::DOUBLE AS q0y, 100.5::DOUBLE AS q1x, coalesce(low, e)::DOUBLE AS q1y, 100.5::DOUBLE AS q2x, coalesce(high, 80.0)::DOUBLE AS q2y, 0.0::DOUBLE AS q3x, coalesce(high, 80 + f)::DOUBLE AS q3y,
  CASE WHEN c[1][2] < c[2][2] OR (c[1][2] = c[2][2] AND c[1][1] <= c[2][1]) THEN c[1][2] ELSE c[2][2] END::DOUBLE AS c0x, CASE WHEN c[1][2] < c[2][2] OR (c[1][2] = c[2][2] AND c[1][1] <= c[2][1]) THEN c[1][1] ELSE c[2][1] END::DOUBLE AS c0y,
  CASE WHEN c[1][2] < c[2][2] OR (c[1][2] = c[2][2] AND c[1][1] <= c[2][1]) THEN c[2][2] ELSE c[1][2] END::DOUBLE AS c1x, CASE WHEN c[1][2] < c[2][2] OR (c[1][2] = c[2][2] AND c[1][1] <= c[2][1]) THEN c[2][1] ELSE c[1][1] END::DOUBLE AS c1y,
  CASE WHEN c[3][2] < c[4][2] OR (c[3][2] = c[4][2] AND c[3][1] <= c[4][1]) THEN c[4][2] ELSE c[3][2] END::DOUBLE AS c2x, CASE WHEN c[3][2] < c[4][2] OR (c[3][2] = c[4][2] AND c[3][1] <= c[4][1]) THEN c[4][1] ELSE c[3][1] END::DOUBLE AS c2y,
  CASE WHEN c[3][2] < c[4][2] OR (c[3][2] = c[4][2] AND c[3][1] <= c[4][1]) THEN c[3][2] ELSE c[4][2] END::DOUBLE AS c3x, CASE WHEN c[3][2] < c[4][2] OR (c[3][2] = c[4][2] AND c[3][1] <= c[4][1]) THEN c[3][1] ELSE c[4][1] END::DOUBLE AS c3y
FROM r JOIN p ON p.k = r.k""",
    "wire_paths": """WITH o AS (SELECT o_orderkey AS k, k % 40 * 5 AS ax, k % 30 * 5 AS ay, k % 23 * 5 AS bx, k % 19 * 5 AS by_, round((k % 40 + k % 23) / 2.0) * 5 AS mid, least(k % 40, k % 23) * 5 AS lo, greatest(k % 40, k % 23) * 5 AS hi FROM orders),
p AS (SELECT *, ax = bx OR ay = by_ AS straight, CASE WHEN k % 2 = 0 THEN -30 ELSE 30 END AS fx, CASE WHEN k % 3 = 0 THEN -10 ELSE 10 END AS fy FROM o)
SELECT k AS id, CASE WHEN straight THEN 2 WHEN k % 2 = 0 THEN 4 ELSE 3 END AS points, (CASE WHEN straight THEN bx WHEN k % 2 = 0 THEN mid ELSE bx END)::DOUBLE AS turn_x,
  (abs(ax - bx) + abs(ay - by_) + CASE WHEN straight THEN 0 WHEN k % 2 = 0 THEN 60 ELSE 30 END
   + 40 * CASE WHEN straight THEN (ay = 50 AND by_ = 50 AND ax <> bx)::INTEGER WHEN k % 2 = 0 THEN (ay = 50 AND ax <> mid)::INTEGER + (by_ = 50 AND bx <> mid)::INTEGER ELSE (ay = 50)::INTEGER END)::DOUBLE AS score,
  array_to_string(list_transform(list_concat(list_filter([mid, mid - 10, mid + 10, mid - 20, mid + 20, mid - 30, mid + 30], lambda v: v > lo + 0.75 AND v < hi - 0.75), [lo - 10, hi + 10, lo - 20, hi + 20]), lambda v: v::INTEGER::VARCHAR), ',') AS channels,
  (ax + CASE k % 4 WHEN 0 THEN fx WHEN 1 THEN -fy WHEN 2 THEN -fx ELSE fy END)::DOUBLE AS tip_x, (ay + CASE k % 4 WHEN 0 THEN fy WHEN 1 THEN fx WHEN 2 THEN -fy ELSE -fx END)::DOUBLE AS tip_y, CASE WHEN ax = 0 THEN k % 50 = 0 ELSE k % 50 < ax + 0.75 END AS on_level FROM p""",
    "blended_pixels": "WITH o AS (SELECT o_orderkey AS k, (o_orderkey * 11 % 251) / 255.0::DOUBLE * (o_orderkey % 4 / 4.0::DOUBLE) AS al FROM orders) SELECT k AS id, " + ", ".join(_blend_sql(c, f) for c, f in zip("rgb", (3, 5, 7), strict=True)) + ", trunc(greatest(0.0, least(1.0, al + (k * 11 % 256) / 255.0::DOUBLE * (1 - al))) * 255)::INTEGER AS a FROM o",
    "picture_histogram": f"WITH {_PIXELS}, b AS (SELECT img_id, 'h' AS channel, least(h // 11, 15) AS bucket FROM px UNION ALL SELECT img_id, 's', least(s // 16, 15) FROM px UNION ALL SELECT img_id, 'v', least(v // 16, 15) FROM px) SELECT img_id, channel, bucket::INTEGER AS bucket, round(count(*) * 100.0 / (SELECT count(*) FROM px WHERE px.img_id = b.img_id), 6)::DOUBLE AS percent FROM b GROUP BY 1, 2, 3",
    "white_shares": f"WITH {_PIXELS} SELECT img_id, round(avg((v > 180)::INTEGER) * 100, 6) AS percent FROM px GROUP BY 1",
    "box_colors": f"WITH {_PIXELS} SELECT img_id, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in "hsv") + " FROM px WHERE x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 30 GROUP BY 1",
    "contact_colors": f"WITH {_PIXELS}, c AS (SELECT DISTINCT s_suppkey % 60 AS x, s_suppkey % 44 AS y FROM supplier) SELECT img_id, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in "hsv") + " FROM px JOIN c ON abs(px.x - c.x) <= 2 AND abs(px.y - c.y) <= 2 GROUP BY 1",
    "sample_classes": "SELECT p_partkey % 3 = 0 AS is_via, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("p_size", "p_retailprice")) + " FROM part GROUP BY 1",
}
