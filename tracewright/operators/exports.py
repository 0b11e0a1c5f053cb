"""Netlists as text lines (part, seq, line), to be written in that order by sources.documents.save_text.

Lines are rows, ordered by (part, seq), so a netlist of any size is written without gathering it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.nets import pin_order
from tracewright.operators.order import numbered

TOOL = "tracewright"


def _fixed(df: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    """Lines that do not depend on the data."""
    part = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.array(F.lit(i).cast("long")).alias("seq"), F.lit(s).alias("line")) for i, (p, s) in enumerate(rows))))
    return df.sparkSession.range(1).select(part.alias("r")).select("r.*")


def _numbered(nets: DataFrame) -> DataFrame:
    """nets with code, their number by name from 1: the format needs one count over all nets of a board."""
    return numbered(nets, [F.col("name")], "code").withColumn("code", F.col("code").cast("long"))


def kicad_netlist(title: str, components: DataFrame, nets: DataFrame, connections: DataFrame) -> DataFrame:
    """The s-expression netlist of components(id, part_number, package), nets(name) and connections(name, component, pin, ord)."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    head = _fixed(nets, [(0, '(export (version "E")'), (0, "  (design"), (0, f'    (source "{title}")'), (0, f'    (tool "{TOOL}")'), (0, "  )"), (0, "  (components"), (2, "  )"), (2, "  (nets"), (4, "  )"), (4, ")")])
    lines = F.filter(F.array(F.concat(F.lit("    (comp (ref "), quoted(F.col("id")), F.lit(")")), F.when(F.col("part_number") != "", F.concat(F.lit("      (value "), quoted(F.col("part_number")), F.lit(")"))), F.when(F.col("package") != "", F.concat(F.lit("      (footprint "), quoted(F.col("package")), F.lit(")"))), F.lit("    )")), lambda x: x.isNotNull())
    comps = numbered(components, [F.col("id")], "place").withColumn("place", F.col("place").cast("long")).select("place", F.posexplode(lines).alias("k", "line")).select(F.lit(1).alias("part"), F.array("place", F.col("k").cast("long")).alias("seq"), "line")
    coded = _numbered(nets)
    first = coded.select(F.array("code", F.lit(0).cast("long")).alias("seq"), F.concat(F.lit("    (net (code "), quoted(F.col("code").cast("string")), F.lit(") (name "), quoted(F.col("name")), F.lit(")")).alias("line"))
    nodes = connections.join(coded, "name").select(F.array("code", F.col("ord").cast("long") + 1).alias("seq"), F.concat(F.lit("      (node (ref "), quoted(F.col("component")), F.lit(") (pin "), quoted(F.col("pin").cast("string")), F.lit("))")).alias("line"))
    last = coded.select(F.array("code", F.lit(2**62).cast("long")).alias("seq"), F.lit("    )").alias("line"))
    body = first.unionByName(nodes).unionByName(last).select(F.lit(3).alias("part"), "seq", "line")
    return head.unionByName(comps).unionByName(body)


def spice_netlist(title: str, components: DataFrame, nets: DataFrame, connections: DataFrame) -> DataFrame:
    """The comment-style netlist of the same tables. A net is one line, as the format has it."""
    head = _fixed(nets, [(0, f"* {title}"), (0, f"* Generated by {TOOL}"), (0, ""), (0, "* Components:"), (2, ""), (2, "* Nets:"), (4, ""), (4, ".END")])
    comps = numbered(components, [F.col("id")], "place").select(F.lit(1).alias("part"), F.array(F.col("place").cast("long")).alias("seq"), F.concat(F.lit("* "), "id", F.lit(": "), "part_number", F.lit(" ("), "package", F.lit(")")).alias("line"))
    lists = connections.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(".", "component", "pin").alias("t")))).alias("c"))
    rows = _numbered(nets).join(lists, "name", "left").select(F.lit(3).alias("part"), F.array("code").alias("seq"), F.concat(F.lit("* "), "name", F.lit(":"), F.coalesce(F.array_join(F.transform("c", lambda x: F.concat(F.lit(" "), x["t"])), ""), F.lit(""))).alias("line"))
    return head.unionByName(comps).unionByName(rows)


def logic_lines(pins: DataFrame, parts: DataFrame, functions: DataFrame) -> DataFrame:
    """(component, rank, fn, role, place, line): pins(component, part_number, package, pin, text) under the gates of
    their parts: inputs, enables, clocks, outputs, an enable or clock once; what is left under Power."""
    roles = [("inputs", 0), ("enables", 1), ("clocks", 2), ("outputs", 3)]
    used = None
    for column, role in roles:
        part = functions.select("part_number", "package", F.col("ord").alias("fn"), F.posexplode(column).alias("place", "n")).withColumn("role", F.lit(role)).withColumn("pin", F.col("n").cast("string"))
        used = part if used is None else used.unionByName(part)
    rows = pins.join(used, ["part_number", "package", "pin"])
    again = F.row_number().over(W.partitionBy("component", "pin").orderBy("fn", "role", "place"))
    shown = rows.withColumn("again", again).where((F.col("again") == 1) | F.col("role").isin(0, 3)).select("component", F.lit(1).alias("rank"), "fn", "role", "place", F.concat(F.lit("    "), "text").alias("line"))
    present = pins.select("component", "part_number", "package").distinct()
    title = F.concat(F.lit("  Gate "), "name", F.lit(" ("), "type", F.lit(")"), F.when(F.col("expr") != "", F.concat(F.lit(": "), "expr")).otherwise(""))
    gates = present.join(functions, ["part_number", "package"]).select("component", F.lit(1).alias("rank"), F.col("ord").alias("fn"), F.lit(-1).alias("role"), F.lit(0).alias("place"), title.alias("line"))
    rest = pins.join(rows.select("component", "pin"), ["component", "pin"], "left_anti").join(functions.select("part_number", "package").distinct(), ["part_number", "package"], "left_semi")
    order = F.row_number().over(W.partitionBy("component").orderBy(*pin_order(F.col("pin"))))
    power = rest.select("component", F.lit(2).alias("rank"), F.lit(0).alias("fn"), F.lit(0).alias("role"), order.alias("place"), F.concat(F.lit("    "), "text").alias("line"))
    label = rest.select("component").distinct().select("component", F.lit(2).alias("rank"), F.lit(-1).alias("fn"), F.lit(0).alias("role"), F.lit(0).alias("place"), F.lit("  Power:").alias("line"))
    named = present.join(parts, ["part_number", "package"], "left")
    head = F.concat(F.lit("=== "), "component", F.when(F.col("part_number") != "", F.concat(F.lit(" ("), "part_number", F.when(F.col("description") != "", F.concat(F.lit(" - "), "description")).otherwise(""), F.lit(")"))).otherwise(""), F.lit(" ==="))
    heads = named.select("component", F.lit(0).alias("rank"), F.lit(0).alias("fn"), F.lit(0).alias("role"), F.lit(0).alias("place"), head.alias("line"))
    return heads.unionByName(gates).unionByName(shown).unionByName(label).unionByName(power)
