"""Pins of dual in-line packages: sizes, places, and numbering from detected points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.names import dip_pins

# Standard pin counts, pin pitch in mm, and row spacing of narrow and wide packages in mm.
NARROW, WIDE = (8, 14, 16, 18, 20, 24, 28), (24, 28, 40)
PITCH, NARROW_ROWS, WIDE_ROWS = 2.54, 7.62, 15.24


def package_of(width_mm: Column, height_mm: Column) -> Column:
    """DIP-n with the standard count nearest to two rows along the height; the first on ties."""
    pins = F.round(height_mm / PITCH) * 2
    near = lambda counts: F.array_min(F.array(*(F.struct(F.abs(pins - n).alias("off"), F.lit(i).alias("k"), F.lit(n).alias("n")) for i, n in enumerate(counts))))["n"]
    return F.concat(F.lit("DIP-"), F.when(width_mm > 11, near(WIDE)).otherwise(near(NARROW)))


def is_dip_width(width_mm: Column) -> Column:
    return (F.abs(width_mm - NARROW_ROWS) <= 1.5) | (F.abs(width_mm - WIDE_ROWS) <= 1.5)


def pin_places(components: DataFrame, dpi: float) -> DataFrame:
    """(id, pin, x, y, row) of the pins of components(id, package, bx, by, bw, bh, rotation): down one side, up the other."""
    n = dip_pins(F.upper("package"))
    rows = F.when(F.col("n") >= 40, WIDE_ROWS).otherwise(NARROW_ROWS) / 25.4 * dpi
    base = components.withColumn("n", n).where("n is not null").withColumn("rows", rows)
    base = base.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pin"))
    half = F.col("n") / 2
    first = F.col("pin") <= half
    along = (F.when(first, F.col("pin") - 1).otherwise(F.col("n") - F.col("pin")) - (half - 1) / 2) * (PITCH / 25.4 * dpi)
    across = F.when(first, -F.col("rows") / 2).otherwise(F.col("rows") / 2)
    tall = F.col("bh") >= F.col("bw")
    dx, dy = F.when(tall, across).otherwise(along), F.when(tall, along).otherwise(across)
    turn = F.radians("rotation")
    x = F.col("bx") + F.col("bw") / 2 + dx * F.cos(turn) - dy * F.sin(turn)
    y = F.col("by") + F.col("bh") / 2 + dx * F.sin(turn) + dy * F.cos(turn)
    return base.select("id", "pin", x.alias("x"), y.alias("y"), F.when(first, 1).otherwise(2).alias("row"))


def renumbered(vias: DataFrame) -> DataFrame:
    """(component, id, pin) of a component's vias (component, id, x, y): two rows split at the largest gap across the
    shorter spread, numbered down the first and up the second; one row if that spread is less than twice the mean
    spacing along the longer one."""
    w = W.partitionBy("component")
    box = vias.groupBy("component").agg((F.max("x") - F.min("x")).alias("sx"), (F.max("y") - F.min("y")).alias("sy"), F.count("*").alias("n"))
    tall = F.col("sy") >= F.col("sx")
    turned = vias.join(box, "component").withColumn("along", F.when(tall, F.col("y")).otherwise(F.col("x"))).withColumn("across", F.when(tall, F.col("x")).otherwise(F.col("y")))
    single = F.least("sx", "sy") < 2 * F.greatest("sx", "sy") / F.greatest(F.col("n") - 1, F.lit(1))
    gaps = turned.withColumn("gap", F.col("across") - F.lag("across").over(w.orderBy("across", "id")))
    split = gaps.groupBy("component").agg(F.max(F.struct("gap", -F.col("across"), "across"))["across"].alias("split"))
    second = ~single & (F.col("across") >= F.col("split"))
    sided = turned.join(split, "component").withColumn("second", F.coalesce(second, F.lit(False)))
    order = F.row_number().over(w.orderBy("second", F.when(F.col("second"), -F.col("along")).otherwise(F.col("along")), "id"))
    return sided.select("component", "id", order.alias("pin"))


def started_at(numbered: DataFrame, start: DataFrame) -> DataFrame:
    """numbered with pins turned so that the via start(component, id, pin) has its pin."""
    n = numbered.groupBy("component").agg(F.count("*").alias("n"))
    slot = start.select("component", "id", F.col("pin").alias("want")).join(numbered, ["component", "id"]).select("component", (F.col("want") - F.col("pin")).alias("shift"))
    return numbered.join(n, "component").join(slot, "component").select("component", "id", (F.pmod(F.col("pin") - 1 + F.col("shift"), F.col("n")) + 1).alias("pin"))


def template_matches(parts: DataFrame, templates: DataFrame) -> DataFrame:
    """(id, template, turned, reason) of parts (id, width_mm, height_mm) by size templates (template, width_low,
    width_high, height_low, height_high): upright before turned, then the smaller template; else the DIP rule.

    Templates are derived from grouped samples, a few dozen rows; widths are met by an equi-join on whole millimetres.
    """
    both = parts.select("id", F.lit(0).alias("turned"), F.col("width_mm").alias("w"), F.col("height_mm").alias("h")).unionByName(parts.select("id", F.lit(1).alias("turned"), F.col("height_mm").alias("w"), F.col("width_mm").alias("h")))
    spans = templates.withColumn("mm", F.explode(F.sequence(F.floor("width_low"), F.floor("width_high"))))
    hit = both.withColumn("mm", F.floor("w")).join(spans, "mm").where("w between width_low and width_high and h between height_low and height_high")
    best = hit.groupBy("id").agg(F.min(F.struct("turned", "template")).alias("m"))
    narrow, long = F.least("width_mm", "height_mm"), F.greatest("width_mm", "height_mm")
    dip = is_dip_width(narrow) & (F.abs(long / PITCH - F.round(long / PITCH)) <= 1.5 / PITCH)
    out = parts.join(best, "id", "left")
    reason = F.when(F.col("m").isNotNull(), "template").when(dip, "DIP width").otherwise("no size fits")
    return out.select("id", F.col("m.template").alias("template"), (F.col("m.turned") == 1).alias("turned"), reason.alias("reason"))


def guessed_pin(vias: DataFrame, places: DataFrame) -> DataFrame:
    """(id, pin) of vias (component, id, x, y): the nearest pin place (component, pin, x, y), the lower pin on ties.

    A component's places, as many as its package has pins, are one row of a shuffle join; what they are derived from may
    look small enough to broadcast when they are not.
    """
    p = places.groupBy("component").agg(F.collect_list(F.struct("pin", F.col("x").alias("px"), F.col("y").alias("py"))).alias("places"))
    off = lambda p: F.struct(F.hypot(F.col("x") - p["px"], F.col("y") - p["py"]).alias("off"), p["pin"].alias("pin"))
    best = vias.join(p.hint("merge"), "component").select("id", F.array_min(F.transform("places", off)).alias("best"))
    return best.groupBy("id").agg(F.min("best")["pin"].alias("pin"))


def pin_by_neighbours(vias: DataFrame, dpi: float) -> DataFrame:
    """(component, id, pin) for vias (component, id, pin, x, y) without a pin, guessed from the two nearest pins of their
    component that have a number; smaller ids on ties.

    Steps are tenths of an inch, at least one, else there is no guess. Numbers go on from the nearest pin, up or down as
    they do towards the second one; up, where the second gives no direction or a number under 1. The pairs are those of a
    component's pins, and only two a via are shuffled.
    """
    pitch = 0.1 * dpi
    away = lambda v: F.floor(v) + (v - F.floor(v) >= 0.5).cast("int")
    number = F.when(F.col("pin").rlike(r"^\+?[0-9]{1,9}$"), F.col("pin").cast("int"))
    known = vias.select("component", F.col("id").alias("other"), number.alias("n"), F.col("x").alias("px"), F.col("y").alias("py")).where("n > 0")
    square = lambda x, y: x * x + y * y
    pairs = vias.where("pin = ''").join(known, "component").withColumn("far", square(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    pairs = pairs.withColumn("k", F.row_number().over(W.partitionBy("component", "id").orderBy("far", "other"))).where("k <= 2")
    of = lambda k: F.max(F.when(F.col("k") == k, F.struct("n", "px", "py", "far")))
    near = pairs.groupBy("component", "id").agg(F.first("x").alias("x"), F.first("y").alias("y"), of(1).alias("a"), of(2).alias("b"))
    a, b = F.col("a"), F.col("b")
    steps = away(F.sqrt(a["far"]) / pitch)
    rx, ry = b["px"] - a["px"], b["py"] - a["py"]
    way = F.when(away(F.sqrt(square(rx, ry)) / pitch) > 0, F.signum((b["n"] - a["n"]).cast("double")))
    back = (F.col("x") - a["px"]) * rx + (F.col("y") - a["py"]) * ry < 0
    turned = a["n"] + steps * F.when(back, -way).otherwise(way)
    pin = F.when((way != 0) & (turned >= 1), turned).otherwise(a["n"] + steps)
    return near.where(steps >= 1).select("component", "id", pin.cast("int").alias("pin"))
