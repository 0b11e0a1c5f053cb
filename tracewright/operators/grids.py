"""Grid names of components: which axis letters and numbers run along, and names for places between known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.names import grid_id


def _variance(df: DataFrame, part: str, name: str) -> DataFrame:
    groups = df.groupBy("board", part).agg(F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.count("*").alias("n")).where("n >= 2")
    return groups.groupBy("board").agg(F.avg("vx").alias(f"{name}_x"), F.avg("vy").alias(f"{name}_y"))


def grid_axes(components: DataFrame) -> DataFrame:
    """(board, letter_axis, number_axis, format) from components (board, id, x, y).

    An axis is the coordinate that varies less within groups of two or more, y on ties; if only one kind is known the
    other takes the other axis, and letters take y where both want the same.
    """
    named = components.withColumn("g", grid_id(F.col("id"))).where("g is not null").select("board", "x", "y", F.col("g.letter").alias("letter"), F.col("g.number").alias("number"), F.col("id").rlike(r"^\d").cast("int").alias("nl"))
    axes = named.groupBy("board").agg(F.sum("nl").alias("nl"), F.count("*").alias("n")).join(_variance(named, "letter", "l"), "board", "left").join(_variance(named, "number", "m"), "board", "left")
    own = lambda p: F.when(F.col(f"{p}_x").isNull(), None).when(F.col(f"{p}_x") < F.col(f"{p}_y"), "X").otherwise("Y")
    other = lambda c: F.when(c == "X", "Y").otherwise("X")
    letter, number = own("l"), own("m")
    clash = (letter.isNull() & number.isNull()) | F.coalesce(letter == number, F.lit(False))
    return axes.select(
        "board",
        F.when(clash, "Y").otherwise(F.coalesce(letter, other(number))).alias("letter_axis"),
        F.when(clash, "X").otherwise(F.coalesce(number, other(letter))).alias("number_axis"),
        F.when(F.col("nl") > F.col("n") - F.col("nl"), "NL").otherwise("LN").alias("format"),
    )


def grid_coordinates(components: DataFrame, axes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((board, id, at) of letters, the same of numbers): mean places along their axes."""
    named = components.withColumn("g", grid_id(F.col("id"))).where("g is not null").join(axes, "board")
    along = lambda axis: F.when(F.col(axis) == "X", F.col("x")).otherwise(F.col("y"))
    letters = named.groupBy("board", F.ascii("g.letter").alias("id")).agg(F.avg(along("letter_axis")).alias("at"))
    return letters, named.groupBy("board", F.col("g.number").alias("id")).agg(F.avg(along("number_axis")).alias("at"))


def _named(places: DataFrame, marks: DataFrame, coord: Column, tolerance: float, name: str) -> DataFrame:
    """places (board, place) with name: the smallest mark within the tolerance, else one strictly between brackets.

    Marks of a board are a few dozen, so a place meets them by an equi-join on the board and is aggregated at once.
    """
    found = places.withColumn("c", coord).join(marks, "board", "left").groupBy("board", "place").agg(
        F.min(F.when(F.abs(F.col("at") - F.col("c")) <= tolerance, F.col("id"))).alias("near"),
        F.max(F.when(F.col("at") <= F.col("c"), F.struct("id", "at"))).alias("low"),
        F.min(F.when(F.col("at") >= F.col("c"), F.struct("id", "at"))).alias("high"),
        F.first("c").alias("c"),
    )
    span = F.col("high.at") - F.col("low.at")
    between = F.round(F.col("low.id") + F.try_divide(F.col("c") - F.col("low.at"), span) * (F.col("high.id") - F.col("low.id"))).cast("int")
    inner = F.when((span > 0) & (between > F.col("low.id")) & (between < F.col("high.id")), between)
    return found.select("board", "place", F.coalesce("near", inner).alias(name))


def suggested(places: DataFrame, components: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """places (board, place, x, y) with name: letter and number, ? for an unknown half, null where both are unknown."""
    axes = grid_axes(components)
    letters, numbers = grid_coordinates(components, axes)
    at = places.join(axes, "board")
    along = lambda axis: F.when(F.col(axis) == "X", F.col("x")).otherwise(F.col("y"))
    out = at.join(_named(at, letters, along("letter_axis"), tolerance, "l"), ["board", "place"]).join(_named(at, numbers, along("number_axis"), tolerance, "n"), ["board", "place"])
    letter, number = F.coalesce(F.char("l"), F.lit("?")), F.coalesce(F.col("n").cast("string"), F.lit("?"))
    name = F.when(F.col("format") == "NL", F.concat(number, letter)).otherwise(F.concat(letter, number))
    return out.select("board", "place", "x", "y", F.when(F.col("l").isNotNull() | F.col("n").isNotNull(), name).alias("name"))


def information(name: Column) -> Column:
    """0 for a new or empty name, 1 for one with an unknown half, 2 for a whole one."""
    return F.when(name.isNull() | (name == "") | name.startswith("NEW"), 0).when(F.contains(name, F.lit("?")), 1).otherwise(2)


def propagated(components: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """components (board, key, id, x, y) with better ids where two or more of the board are named, from one snapshot."""
    enough = components.where(grid_id(F.col("id")).isNotNull()).groupBy("board").agg(F.count("*").alias("n")).where("n >= 2").select("board")
    weak = components.where(information(F.col("id")) < 2).join(enough, "board", "left_semi")
    better = suggested(weak.select("board", F.col("key").alias("place"), "x", "y"), components, tolerance).select("board", F.col("place").alias("key"), "name")
    change = information(F.col("name")) > information(F.col("id"))
    return components.join(better, ["board", "key"], "left").withColumn("id", F.when(F.col("name").isNotNull() & change, F.col("name")).otherwise(F.col("id"))).drop("name")
