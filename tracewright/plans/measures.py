"""Queries on statistics, text, parts and dates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import dates
from tracewright.functions.names import corrected_part, logic_part, logo_names, natural_key, normal_part, output_name
from tracewright.functions.text import char_overlap, lcs_length, normal_text, text_lines, text_similarity, trigram_share, without_logos
from tracewright.operators.order import numbered
from tracewright.operators.parts import tiered_lookup
from tracewright.operators.schematic import stable_uuid
from tracewright.operators.stats import best_by_group, group_variance, line_fit, longest_run, otsu, score_bands, size_templates, spread, upper_median
from tracewright.plans.inputs import table


def median_quantity(spark, d):
    return upper_median(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


def sample_spread(spark, d):
    s = spread(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])
    return s.select("l_returnflag", "l_linestatus", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


def axis_variance(spark, d):
    return group_variance(table(spark, d, "lineitem"), "l_suppkey", "l_quantity").select(F.round("variance", 6).alias("variance"))


def price_line(spark, d):
    s = line_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return s.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("angle", 6).alias("angle"))


def best_order(spark, d):
    o = table(spark, d, "orders")
    return best_by_group(o, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderpriority", "o_orderkey", "o_totalprice")


def balance_bands(spark, d):
    return score_bands(table(spark, d, "customer"), F.col("c_acctbal") / 10000)


def busy_days(spark, d):
    """The longest run of hours with more than the given number of events."""
    e = table(spark, d, "events").groupBy(F.floor(F.unix_timestamp("ts") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    return longest_run(e, "hour", F.col("n") >= 1)


def part_templates(spark, d):
    p = table(spark, d, "part").select((F.col("p_size") * 1.0).alias("width_mm"), (F.col("p_retailprice") / 50).alias("height_mm"))
    s = size_templates(p)
    return s.select("wide", "units", "n", *(F.round(c, 6).alias(c) for c in s.columns if c not in ("wide", "units", "n")))


def separating_value(spark, d):
    return otsu(table(spark, d, "lineitem").select((F.col("l_extendedprice") % 256).cast("int").alias("v")), "v")


def top_products(spark, d):
    """The ten part types with most lines."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    out = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))
    return out.orderBy(F.desc("n"), "p_type").limit(10)


def user_paths(spark, d):
    """The length of each user's path through events, by value, and its turns of more than 50."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.abs(F.col("value") - F.lag("value").over(w))
    out = table(spark, d, "events").withColumn("step", step).groupBy("user_id").agg(F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 6).alias("length"), F.count_if(F.col("step") > 50).alias("turns"))
    return out


def part_lookup(spark, d):
    """Wanted parts in the tiers of a library that is made of the parts' brands and types."""
    p = table(spark, d, "part")
    family = F.element_at(F.array(*map(F.lit, ["LS", "HC", "F", "ALS"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    lib = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("SN74"), family, (F.col("p_partkey") % 400), F.lit("N")).alias("part_number"), F.concat(F.lit("DIP-"), (F.col("p_size") % 3) * 2 + 14).alias("package")).distinct()
    aliases = lib.select("part_number", "package", F.concat(F.lit("A-"), F.substr("part_number", F.lit(3))).alias("alias"))
    want = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("SN74"), family, (F.col("p_partkey") % 400), F.lit("N"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("a-74"), family, (F.col("p_partkey") % 400), F.lit("n"))).otherwise(F.concat(F.lit("DM74"), (F.col("p_partkey") % 400)))
    wanted = p.select(F.col("p_partkey").alias("id"), want.alias("part_number"), F.concat(F.lit("DIP-"), (F.col("p_size") % 4) * 2 + 14).alias("package"))
    return tiered_lookup(wanted, lib, aliases).select("id", "part_number", "package", "found_part", "found_package", F.coalesce("tier", F.lit(0)).alias("tier"))


def part_forms(spark, d):
    key = F.col("p_partkey")
    name = F.concat(F.element_at(F.array(*map(F.lit, ["SN74LS", "74HCT", "DM54", "7A1S", "MC68", "74F0"])), (key % 6 + 1).cast("int")), key % 500, F.element_at(F.array(*map(F.lit, ["N", "", "-02", "P-15"])), (key % 4 + 1).cast("int")))
    return table(spark, d, "part").select(key.alias("id"), name.alias("name")).select("id", "name", logic_part(F.col("name")).alias("logic"), normal_part(F.col("name")).alias("normal"))


def part_repairs(spark, d):
    """Misread part numbers set right."""
    key = F.col("p_partkey")
    name = F.concat(F.element_at(F.array(*map(F.lit, ["74L5", "SN7ALS", "74H0", "54L"])), (key % 4 + 1).cast("int")), key % 500, F.lit("N"))
    return table(spark, d, "part").select(key.alias("id"), name.alias("name")).select("id", "name", corrected_part(F.col("name")).alias("fixed"))


def order_codes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"))
    week = F.floor((F.dayofyear("at") - 1) / 7) + 1
    code = F.concat(F.lpad((F.year("at") % 100).cast("string"), 2, "0"), F.lpad(week.cast("string"), 2, "0"))
    found = dates.extract(F.concat(F.lit("LOT "), code, F.lit(" MADE")), 1990)
    return o.select("o_orderkey", code.alias("code"), found["year"].alias("year"), found["month"].alias("month"), found["week"].alias("week"), found["format"].alias("format"))


def label_text(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", normal_text(F.col("text")).alias("normal"), F.size(text_lines(F.col("text"))).alias("n_lines"), without_logos(F.concat(F.lit("<TI>"), F.col("text"))).alias("bare"))


def label_trigrams(spark, d):
    b = table(spark, d, "benchmark").select("item_id", normal_text(F.col("text")).alias("t"))
    other = b.select((F.col("item_id") + 1).alias("item_id"), F.col("t").alias("f"))
    return b.join(other, "item_id").select("item_id", F.round(trigram_share(F.col("f"), F.col("t")), 9).alias("trigrams"), F.round(char_overlap(F.col("f"), F.col("t")), 9).alias("overlap"))


def label_similarity(spark, d):
    """Rows only: similarity of each benchmark text to the next, and the length of their common subsequence."""
    b = table(spark, d, "benchmark")
    other = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("found"))
    return b.join(other, "item_id").select("item_id", lcs_length("found", "text").alias("lcs"), F.round(text_similarity(F.col("found"), F.col("text")), 9).alias("similarity"))


def page_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(logo_names(F.col("html"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def gate_names(spark, d):
    gate = F.element_at(F.array(*map(F.lit, ["NOT", "BUFFER", "NAND", "AND"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), gate.alias("gate"), F.when(F.col("p_partkey") % 8 < 4, F.concat(F.lit("/"), F.col("p_brand"))).otherwise(F.col("p_brand")).alias("name"))
    return p.select("id", "gate", output_name(F.col("gate"), F.col("name")).alias("output"))


def signal_chain(spark, d):
    """Line, order, customer and nation in a chain of outer joins: a signal's component, part and direction."""
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct()
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    chain = lines.join(o, lines["l_orderkey"] == o["o_orderkey"], "left").join(c.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return chain.select("l_orderkey", F.concat_ws("-", "c_name", "n_name").alias("signal"), F.coalesce("c_mktsegment", F.lit("Input")).alias("direction"))


def idle_parts(spark, d):
    """Parts without a line of 50 pieces, and how many there are by brand."""
    lines = table(spark, d, "lineitem").where("l_quantity = 50")
    p = table(spark, d, "part")
    return p.join(lines, p["p_partkey"] == lines["l_partkey"], "left_anti").groupBy("p_brand").agg(F.count("*").alias("n"))


def name_order(spark, d):
    """Places of customers in the natural order of their names."""
    c = table(spark, d, "customer").select(F.concat(F.lit("U"), F.col("c_custkey") % 97, F.lit("b"), F.col("c_nationkey")).alias("name")).distinct()
    return numbered(c, [natural_key(F.col("name"))], "place").select("name", "place")


def stable_ids(spark, d):
    return table(spark, d, "nation").select("n_nationkey", stable_uuid(F.lit("symbol"), F.col("n_name")).alias("uuid"))


QUERIES = {f.__name__: f for f in (median_quantity, sample_spread, axis_variance, price_line, best_order, balance_bands, busy_days, part_templates, separating_value, top_products, user_paths, part_lookup, part_forms, part_repairs, order_codes, label_text, label_trigrams, label_similarity, page_tags, gate_names, signal_chain, idle_parts, name_order, stable_ids)}

_FORM = "CASE (p_partkey % 6) WHEN 0 THEN 'SN74LS' WHEN 1 THEN '74HCT' WHEN 2 THEN 'DM54' WHEN 3 THEN '7A1S' WHEN 4 THEN 'MC68' ELSE '74F0' END || (p_partkey % 500) || CASE (p_partkey % 4) WHEN 0 THEN 'N' WHEN 1 THEN '' WHEN 2 THEN '-02' ELSE 'P-15' END"
_LOGIC = "upper(regexp_extract({0}, '^[A-Za-z]{{0,3}}((?:74|54)[A-Za-z]{{0,4}}[0-9]{{1,4}})[A-Za-z]{{0,3}}$', 1))"
_BARE = "regexp_replace(regexp_replace(regexp_replace({0}, ' +$', ''), '^(.+)-[0-9]+$', '\\1'), '^(.*[0-9])[A-Z]$', '\\1')"


def _norm(x: str) -> str:
    bare = _BARE.format(x)
    logic = _LOGIC.format(bare)
    return f"regexp_replace(CASE WHEN {logic} <> '' THEN {logic} ELSE {bare} END, '^(74|54)(?:GTLP|HCT|ACT|ALS|LVC|LVT|ABT|BCT|FCT|GTL|HC|AC|AS|LV|LS|F|S)?([0-9]+)$', '\\1\\2')"


_FAMILY = "CASE (p_partkey % 4) WHEN 0 THEN 'LS' WHEN 1 THEN 'HC' WHEN 2 THEN 'F' ELSE 'ALS' END"
_PART_SQL = f"""WITH lib AS (SELECT DISTINCT 'SN74' || {_FAMILY} || (p_partkey % 400) || 'N' AS part_number, 'DIP-' || ((p_size % 3) * 2 + 14) AS package FROM part WHERE p_partkey % 3 = 0),
l AS (SELECT part_number AS found_part, package AS found_package, lower(part_number || ' / ' || package) AS key, lower({_norm('upper(part_number)')}) AS norm, lower('A-' || substr(part_number, 3)) AS alias FROM lib),
w AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'SN74' || {_FAMILY} || (p_partkey % 400) || 'N' WHEN p_partkey % 4 = 1 THEN 'a-74' || {_FAMILY} || (p_partkey % 400) || 'n' ELSE 'DM74' || (p_partkey % 400) END AS part_number, 'DIP-' || ((p_size % 4) * 2 + 14) AS package FROM part),
v AS (SELECT *, lower({_norm('upper(part_number)')}) AS want_norm FROM w),
h AS (SELECT v.id, l.*, CASE WHEN v.part_number = found_part AND v.package = found_package THEN 1 WHEN lower(v.part_number) = alias AND v.package = found_package THEN 2 WHEN want_norm = norm AND v.package = found_package THEN 3 WHEN lower(v.part_number) = alias THEN 4 ELSE 5 END AS tier FROM v JOIN l ON v.part_number = found_part AND v.package = found_package OR lower(v.part_number) = alias OR want_norm = norm),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, key) AS k FROM h)
SELECT v.id, v.part_number, v.package, r.found_part, r.found_package, coalesce(r.tier, 0)::INTEGER AS tier FROM v LEFT JOIN r ON r.id = v.id AND r.k = 1"""
_WEEK = "(floor((dayofyear(o_orderdate) - 1) / 7)::BIGINT + 1)"
_CODE = f"lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') || lpad({_WEEK}::VARCHAR, 2, '0')"

SQL = {
    "median_quantity": "SELECT l_returnflag, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1",
    "sample_spread": "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_pop(l_discount), 6) AS l_discount_std FROM lineitem GROUP BY 1, 2",
    "axis_variance": "SELECT round(avg(v), 6) AS variance FROM (SELECT var_pop(l_quantity) AS v FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 2)",
    "price_line": "SELECT l_returnflag, round(coalesce(regr_slope(l_extendedprice, l_quantity), 0), 4) AS slope, round(degrees(atan(coalesce(regr_slope(l_extendedprice, l_quantity), 0))), 6) AS angle FROM lineitem GROUP BY 1",
    "best_order": "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
    "balance_bands": "SELECT count(*) FILTER (WHERE s >= 0.95) AS band1, count(*) FILTER (WHERE s >= 0.7 AND s < 0.95) AS band2, count(*) FILTER (WHERE s >= 0.5 AND s < 0.7) AS band3, count(*) FILTER (WHERE s < 0.5) AS rest FROM (SELECT c_acctbal / 10000 AS s FROM customer)",
    "busy_days": "WITH h AS (SELECT DISTINCT floor(epoch(ts) / 3600)::BIGINT AS hour FROM events), g AS (SELECT hour, hour - row_number() OVER (ORDER BY hour) AS island FROM h), r AS (SELECT min(hour) AS first, max(hour) AS last FROM g GROUP BY island) SELECT first, last, last - first + 1 AS length FROM r ORDER BY length DESC, first LIMIT 1",
    "part_templates": "WITH p AS (SELECT least(p_size * 1.0, p_retailprice / 50) AS s, greatest(p_size * 1.0, p_retailprice / 50) AS l FROM part), g AS (SELECT s > 11 AS wide, round(l / 2.54)::INTEGER AS units, count(*) AS n, avg(s) AS mean_width, avg(l) AS mean_height, min(s) AS least_width, max(s) AS most_width FROM p GROUP BY 1, 2) SELECT wide, units, n, round(mean_width, 6) AS mean_width, round(mean_height, 6) AS mean_height, round(least_width, 6) AS least_width, round(most_width, 6) AS most_width, round(greatest(least_width - 1.5, 1.0), 6) AS width_low, round(most_width + 1.5, 6) AS width_high, round(greatest((units - 0.75) * 2.54, 1.0), 6) AS height_low, round((units + 0.75) * 2.54, 6) AS height_high FROM g",
    "separating_value": "WITH h AS (SELECT trunc(l_extendedprice % 256)::INTEGER AS v, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT r.v::INTEGER AS v, coalesce(h.n, 0) AS n FROM range(256) r(v) LEFT JOIN h ON h.v = r.v), c AS (SELECT v, sum(n) OVER (ORDER BY v)::DOUBLE AS w0, sum(n * v) OVER (ORDER BY v)::DOUBLE AS s0, sum(n) OVER ()::DOUBLE AS w, sum(n * v) OVER ()::DOUBLE AS s FROM b) SELECT v AS threshold FROM c ORDER BY CASE WHEN w0 * (w - w0) = 0 THEN 0 ELSE (s0 * w - s * w0) * (s0 * w - s * w0) / (w0 * (w - w0)) END DESC, v LIMIT 1",
    "top_products": "SELECT p_type, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10",
    "user_paths": "WITH s AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events) SELECT user_id, round(coalesce(sum(step), 0), 6) AS length, count(*) FILTER (WHERE step > 50) AS turns FROM s GROUP BY 1",
    "part_lookup": _PART_SQL,
    "part_forms": f"WITH n AS (SELECT p_partkey AS id, {_FORM} AS name FROM part) SELECT id, name, {_LOGIC.format('name')} AS logic, {_norm('name')} AS normal FROM n",
    "part_repairs": """WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS w, (p_partkey % 500)::VARCHAR AS n FROM part), m AS (SELECT id, w, n, ['74L5', 'SN7ALS', '74H0', '54L'][w + 1] || n || 'N' AS name FROM p)
SELECT id, name, CASE w WHEN 0 THEN '74LS' || n || 'N' WHEN 1 THEN 'SN74LS' || n || 'N' WHEN 2 THEN name ELSE CASE WHEN n LIKE '5_%' THEN '54LS' || substr(n, 2) || 'N' WHEN n = '5' THEN name ELSE '541' || n || 'N' END END AS fixed FROM m""",
    "order_codes": f"WITH c AS (SELECT o_orderkey, {_CODE} AS code, {_WEEK} AS week, year(o_orderdate) % 100 AS yy FROM orders) SELECT o_orderkey, code, (CASE WHEN 1900 + yy > 2010 THEN 1800 + yy ELSE 1900 + yy END)::INTEGER AS year, least(12, (week - 1) // 4 + 1)::INTEGER AS month, week::INTEGER AS week, 'YYWW' AS format FROM c",
    "label_text": r"SELECT item_id, regexp_replace(replace(upper(replace(text, 'ß', chr(57344))), chr(57344), 'ß'), '[^\p{L}\p{Nd}\n]', '', 'g') AS normal, len(list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(x) <> ''))::INTEGER AS n_lines, text AS bare FROM benchmark",
    "label_trigrams": r"""WITH b AS (SELECT item_id, regexp_replace(replace(upper(replace(text, 'ß', chr(57344))), chr(57344), 'ß'), '[^\p{L}\p{Nd}\n]', '', 'g') AS t FROM benchmark), p AS (SELECT b.item_id, b.t, o.t AS f FROM b JOIN b o ON o.item_id + 1 = b.item_id)
SELECT item_id, round(CASE WHEN length(t) >= 3 THEN len(list_filter(range(1, length(t) - 1), lambda i: contains(f, substr(t, i, 3)))) / (length(t) - 2) ELSE 0 END, 9) AS trigrams,
  round(CASE WHEN length(t) > 0 THEN list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: least(length(f) - length(replace(f, c, '')), length(t) - length(replace(t, c, ''))))) / length(t) ELSE 0 END, 9) AS overlap FROM p""",
    "page_tags": "WITH t AS (SELECT page_id, upper(unnest(regexp_extract_all(html, '<([A-Za-z0-9]+)>', 1))) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY 1",
    "gate_names": "WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'NOT' WHEN 1 THEN 'BUFFER' WHEN 2 THEN 'NAND' ELSE 'AND' END AS gate, CASE WHEN p_partkey % 8 < 4 THEN '/' || p_brand ELSE p_brand END AS name FROM part) SELECT id, gate, CASE gate WHEN 'NOT' THEN CASE WHEN name LIKE '/%' THEN substr(name, 2) ELSE '/' || name END WHEN 'BUFFER' THEN 'b' || name WHEN 'NAND' THEN '/' || name ELSE '' END AS output FROM p",
    "signal_chain": "WITH l AS (SELECT DISTINCT l_orderkey FROM lineitem) SELECT l_orderkey, concat_ws('-', c_name, n_name) AS signal, coalesce(c_mktsegment, 'Input') AS direction FROM l LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "idle_parts": "SELECT p_brand, count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50) GROUP BY 1",
    "name_order": "WITH c AS (SELECT DISTINCT c_custkey % 97 AS a, c_nationkey AS b, 'U' || (c_custkey % 97) || 'b' || c_nationkey AS name FROM customer) SELECT name, row_number() OVER (ORDER BY a, b)::INTEGER AS place FROM c",
    "stable_ids": "WITH h AS (SELECT n_nationkey, sha256('symbol:' || n_name) AS h FROM nation) SELECT n_nationkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS uuid FROM h",
}
