"""Outlines of schematic symbols: their bodies' sizes, and where the stubs of their pins begin and end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.geometry import point, snapped

# Gates drawn as triangles, gates with a flat or curved back, those whose output is inverted; the length of
# a stub, the width of an inversion bubble, and the space of a pin.
TRIANGLES = ["NOT", "BUFFER", "TRISTATE"]
SHIELDS = ["AND", "NAND", "OR", "NOR", "XOR"]
INVERTED = ["NOT", "NAND", "NOR"]
STUB, BUBBLE, PITCH = 50.0, 16.0, 50.0


def body(gate: Column, inputs: Column, outputs: Column, enables: Column, clocks: Column) -> Column:
    """struct<width, height> of a gate with so many pins."""
    tall = lambda n: n * PITCH + 10.0
    sides = F.greatest(inputs + clocks + enables, outputs, F.lit(2))
    size = lambda w, h: F.struct(F.lit(w).alias("width"), h.cast("double").alias("height"))
    return (
        F.when(gate.isin(TRIANGLES), size(100.0, F.lit(80.0)))
        .when(gate.isin(SHIELDS), size(150.0, tall(F.greatest(inputs, F.lit(2)))))
        .when(gate == "FLIPFLOP", size(200.0, tall(sides)))
        .otherwise(size(250.0, tall(sides)))
    )


def stub_side(gate: Column, inputs: Column, outputs: Column, enables: Column, clocks: Column, width: Column, height: Column, direction: Column, place: Column) -> Column:
    """struct<side, along> of the pin at a place (from 0) among those of its direction: the side of the body, and where
    along it from the middle; side is null where the outline has no such place, as for supply pins."""
    triangle, shield, flipflop = gate.isin(TRIANGLES), gate.isin(SHIELDS), gate == "FLIPFLOP"
    block = ~(triangle | shield | flipflop)
    slots = F.when(direction == "input", F.when(triangle, 1).when(shield, F.greatest(inputs, F.lit(2))).otherwise(inputs)).when(direction == "output", F.when(triangle | shield, 1).otherwise(outputs))
    slots = slots.when(direction == "enable", F.when(gate == "TRISTATE", 1).when(triangle | shield, 0).otherwise(enables)).when(direction == "clock", F.when(triangle | shield, 0).otherwise(clocks)).otherwise(0)
    side = F.when(direction == "output", "right").when((direction == "enable") & ~block, "top").otherwise("left")
    even = F.when(slots == 1, 0.0).otherwise(snapped(-height / 2 + height / (slots + 1) * (place + 1)))
    before = F.when(direction == "input", 0).when(direction == "clock", inputs).otherwise(inputs + clocks)
    stacked = F.when(inputs + clocks + enables == 1, 0.0).otherwise(-height / 2 + (before + place) * PITCH + 25)
    along = F.when(direction == "output", even).when(block, stacked).when(direction == "input", even).when(direction == "clock", height / 2 - place * PITCH - 25).when(gate == "TRISTATE", 0.0).otherwise(-width / 4 + place * PITCH)
    return F.struct(F.when(place < slots, side).alias("side"), along.alias("along"))


def stub(gate: Column, width: Column, height: Column, side: Column, along: Column) -> Column:
    """struct<body point, tip point, bubble> of a stub on a side, from the middle of the symbol; null for a null side."""
    inverted = (side == "right") & gate.isin(INVERTED)
    edge = F.when(inverted, snapped(width / 2 + BUBBLE)).otherwise(width / 2)
    at = lambda out: point(F.when(side == "left", -width / 2 - out).when(side == "right", edge + out).otherwise(along), F.when(side == "top", -height / 2 - out).otherwise(along))
    return F.when(side.isNotNull(), F.struct(at(0.0).alias("body"), at(STUB).alias("tip"), inverted.alias("bubble")))
