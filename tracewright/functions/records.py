"""Texts and figures of single records as column expressions: pins, grids, contacts, dates, specs, scores, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.geometry import point

# Month names, signal senses, the widths of colour buckets, and a contact row of an S-100 board in inches.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SENSES = ["Active High", "Active Low", "Rising Edge", "Falling Edge"]
BUCKETS = 16


def pin_ref(component: Column, pin: Column, signal: Column) -> Column:
    """COMPONENT-PIN, with the signal in brackets if there is one."""
    short = F.concat(component, F.lit("-"), pin)
    return F.when(F.coalesce(signal, F.lit("")) != "", F.concat(short, F.lit("("), signal, F.lit(")"))).otherwise(short)


def padded(text: Column, width: int) -> Column:
    """text with spaces up to the width; longer text stays whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def pin_line(pin: Column, signal: Column, net: Column, links: Column) -> Column:
    """A pin's line in a logic listing: pin and signal in twelve places, the net, and the refs that it meets (an array)."""
    label = F.concat(pin, F.when(F.coalesce(signal, F.lit("")) != "", F.concat(F.lit("("), signal, F.lit(")"))).otherwise(""))
    met = F.when(F.size(links) > 0, F.concat(F.lit("-> "), F.array_join(links, ", "))).otherwise("(no connections)")
    return F.concat(F.lit("    pin "), padded(label, 12), F.lit(" ["), net, F.lit("] "), met)


def grid_text(letter: Column, number: Column, letter_first: Column) -> Column:
    """A grid position as it is written on the board: A12 or 12A."""
    return F.when(letter_first, F.concat(letter, number.cast("string"))).otherwise(F.concat(number.cast("string"), letter))


def edge_pin_name(index: Column, front: Column) -> Column:
    """The two-character name of an edge contact by its place from 0; back contacts count on from 50."""
    i = F.when(front, index).otherwise(index + 50)
    return F.concat(F.char(F.lit(65) + F.floor(i / 26).cast("int")), (i % 10).cast("string"))


def contact_span(count: Column, pitch: Column, width: Column) -> Column:
    """From the first contact's outer edge to the last one's."""
    return F.when(count == 0, 0.0).otherwise((count - 1) * pitch + width)


def contact_places(margin: Column, pitch: Column, count: Column) -> Column:
    """The centres of a row of contacts, an array."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: margin + i * pitch)).otherwise(F.array().cast("array<double>"))


def spec_problem(name: Column, width: Column, height: Column, contacts: Column, methods: Column) -> Column:
    """What is wrong with a board spec, the first thing found, or null. contacts is a struct (count, pitch_inches) or null."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "board spec name is required")
        .when((width <= 0) | (height <= 0), "board dimensions must be positive")
        .when(contacts.isNotNull() & (contacts["count"] <= 0), "contact count must be positive")
        .when(contacts.isNotNull() & (contacts["pitch_inches"] <= 0), "contact pitch must be positive")
        .when(F.size(methods) == 0, "at least one alignment method is required")
    )


def electrical_type(gate: Column, direction: Column, has_enable: Column) -> Column:
    """A pin's electrical type in a schematic file. Outputs behind an enable may share a net with others."""
    output = F.when((gate == "TRISTATE") | has_enable, "tri_state").otherwise("output")
    return F.when(gate == "CONNECTOR", "bidirectional").when(direction.isin("input", "enable", "clock"), "input").when(direction == "output", output).when(direction == "power", "power_in").otherwise("passive")


def logic_sense(text: Column) -> Column:
    """A signal's sense from its text; anything unknown is Active High."""
    return F.when(text.isin(SENSES), text).otherwise(F.lit(SENSES[0]))


def date_text(year: Column, month: Column, week: Column, ambiguous: Column, of_month: Column) -> Column:
    """A decoded date for display, with the decades around it where the year is ambiguous."""
    name = F.element_at(F.array(*map(F.lit, MONTH_NAMES)), month)
    others = F.when(ambiguous, F.concat(F.lit(" (or "), year - 10, F.lit(", "), year + 10, F.lit(")"))).otherwise("")
    tail = F.when(week > 0, F.concat(F.lit(", week "), week.cast("string"), F.when(of_month, " of month").otherwise(""))).otherwise("")
    return F.concat(name, F.lit(" "), year.cast("string"), others, tail)


def sample_figures(truth: Column) -> Column:
    """Of a reading sample's text: its bytes without spaces, its lines, and whether it holds logo marks."""
    return F.struct(
        F.octet_length(F.replace(truth, F.lit(" "), F.lit(""))).alias("text_length"),
        F.size(F.split(F.regexp_replace(truth, r"^\s+|\s+$", ""), "\n", -1)).alias("line_count"),
        (F.contains(truth, F.lit("<")) & F.contains(truth, F.lit(">"))).alias("has_logos"),
    )


def match_tolerance(dpi: Column) -> Column:
    """How far apart two sides' vias may lie, in pixels."""
    return F.when(dpi > 0, dpi * 0.015).otherwise(15.0)


def radius_limits(dpi: Column, least_inches: float, most_inches: float) -> Column:
    """(least, most, apart): a detector's limits in whole pixels, not under 3, 2 * least and 10."""
    low = F.greatest((dpi * least_inches / 2).cast("int"), F.lit(3))
    high = (dpi * most_inches / 2).cast("int")
    return F.when(dpi > 0, F.struct(low.alias("least"), F.when(high < low, low * 2).otherwise(high).alias("most"), F.greatest(F.lit(10), low * 2).alias("apart")))


def color_distance(pixel: Column, figures: Column) -> Column:
    """How far a pixel (h, s, v) is from a class (h_mean, h_std and so on), in its own spread; hue weighs less."""
    part = lambda c, w: w * F.pow((pixel[c] - figures[f"{c}_mean"]) / (figures[f"{c}_std"] + 1), F.lit(2.0))
    return F.sqrt(part("h", 1.0) + part("s", 1.5) + part("v", 1.5))


def class_score(to_positive: Column, to_negative: Column) -> Column:
    """The weight of the positive class by inverse distances; half where neither class is away, or one is missing."""
    near, far = 1 / (to_positive + 0.001), 1 / (to_negative + 0.001)
    return F.when(to_positive.isNull() | to_negative.isNull() | ((to_positive == 0) & (to_negative == 0)), 0.5).otherwise(near / (near + far))


def confirmed_score(score: Column, both_sides: Column, weight: float) -> Column:
    """A score raised towards 1 where both sides confirm it, else lowered by three tenths of the weight."""
    return F.when(both_sides, score * (1 - weight) + weight).otherwise(score * (1 - weight * 0.3))


def bucket(value: Column, width: int) -> Column:
    """The colour bucket of a channel; the last one takes what is beyond."""
    return F.least(F.floor(value / width).cast("int"), F.lit(BUCKETS - 1))


def blended(below: Column, above: Column, mode: Column, opacity: Column) -> Column:
    """Two pixels (r, g, b, a, from 0 to 255) in one, by the blend mode: normal, multiply, screen, overlay, difference."""
    share = lambda p, c: p[c] / 255.0
    alpha = share(above, "a") * opacity

    def channel(c: str) -> Column:
        s, d = share(above, c), share(below, c)
        mixed = (
            F.when(mode == "normal", s).when(mode == "multiply", s * d).when(mode == "screen", 1 - (1 - s) * (1 - d))
            .when(mode == "overlay", F.when(d < 0.5, 2 * s * d).otherwise(1 - 2 * (1 - s) * (1 - d))).when(mode == "difference", F.abs(s - d)).otherwise(0.0)
        )
        return whole(mixed * alpha + d * (1 - alpha)).alias(c)

    whole = lambda v: (F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int")
    return F.struct(*map(channel, "rgb"), whole(alpha + share(below, "a") * (1 - alpha)).alias("a"))


def is_dip_length(length_mm: Column) -> Column:
    """Whether a length is a whole number of pin pitches, give or take 1.5 mm; with a pitch of 2.54 every length is."""
    units = length_mm / 2.54
    return F.abs(units - F.round(units)) <= 1.5 / 2.54


def saved_path(symbol_id: Column, sheet: Column, uuid) -> Column:
    """A footprint's path: its symbol's id, below its sheet's from the second sheet on. uuid(kind, id) makes the ids."""
    of_symbol = F.concat(F.lit("/"), uuid(F.lit("symbol"), symbol_id))
    return F.when(sheet > 1, F.concat(F.lit("/"), uuid(F.lit("sheet"), F.concat(F.lit("sheet-"), sheet.cast("string"))), of_symbol)).otherwise(of_symbol)


def corner_order(corners: Column) -> Column:
    """Four corners as top left, top right, bottom right, bottom left; the upper two by y, then each pair by x."""
    by_y = F.transform(F.array_sort(F.transform(corners, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))), lambda p: point(p["x"], p["y"]))
    pair = lambda i: F.array_sort(F.slice(by_y, i, 2))
    return F.when(F.size(corners) == 4, F.concat(pair(1), F.reverse(pair(3)))).otherwise(corners)
