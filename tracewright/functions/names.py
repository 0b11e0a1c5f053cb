"""Names of nets, parts and packages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Logic families, longest first, and the letters and digits that label readers confuse.
FAMILIES = ["GTLP", "HCT", "ACT", "ALS", "LVC", "LVT", "ABT", "BCT", "FCT", "GTL", "HC", "AC", "AS", "LV", "LS", "F", "S"]
DIGITS_AS_LETTERS = ("0518", "OSLB")
LETTERS_AS_DIGITS = ("OSILBZG", "0511826")
# Power nets.
POWER_NAMES = ["VCC", "VDD", "VSS", "VEE", "GND", "AGND", "DGND"]


def net_priority(name: Column) -> Column:
    """0 for a numbered net, 1 for a name with a dot such as component.pin, else 2."""
    return F.when(name.rlike(r"^net-\d+$"), 0).when(F.contains(name, F.lit(".")), 1).otherwise(2)


def is_low_priority(name: Column) -> Column:
    return net_priority(name) < 2


def better_name(a: Column, b: Column) -> Column:
    """The name of higher priority, then the one of fewer bytes, then a."""
    key = lambda n, first: F.struct(net_priority(n), -F.octet_length(n), F.lit(first))
    return F.when(key(a, 1) >= key(b, 0), a).otherwise(b)


def base_name(name: Column) -> Column:
    """The name up to its last #, unless that is its first character."""
    return F.regexp_replace(name, r"(?s)^(.+)#[^#]*$", "$1")


def is_power(name: Column) -> Column:
    return F.upper(name).isin(POWER_NAMES) | F.upper(name).rlike("^(VCC|GND|VDD|VSS)")


def is_ground(name: Column) -> Column:
    return F.upper(name).rlike("^(GND|VSS)")


def output_name(gate: Column, name: Column) -> Column:
    """What a gate's output is called after its input's name; empty if the gate says nothing."""
    toggled = F.when(name.startswith("/"), F.substr(name, F.lit(2))).otherwise(F.concat(F.lit("/"), name))
    return F.when(gate == "NOT", toggled).when(gate.isin("BUFFER", "TRISTATE"), F.concat(F.lit("b"), name)).when(gate.isin("NAND", "NOR"), F.concat(F.lit("/"), name)).otherwise("")


def logic_part(part: Column) -> Column:
    """The 74 or 54 series core of a part number, upper-cased; empty if there is none."""
    return F.upper(F.regexp_extract(part, r"(?i)^[A-Z]{0,3}((?:74|54)[A-Z]{0,4}\d{1,4})[A-Z]{0,3}$", 1))


def normal_part(part: Column) -> Column:
    """The form by which part numbers are matched loosely: no speed grade, package letter, maker or family."""
    bare = F.regexp_replace(F.regexp_replace(part, r" +$", ""), r"^(.+)-\d+$", "$1")
    bare = F.regexp_replace(bare, r"^(.*\d)[A-Z]$", "$1")
    core = F.when(logic_part(bare) != "", logic_part(bare)).otherwise(bare)
    return F.regexp_replace(core, rf"^(74|54)(?:{'|'.join(FAMILIES)})?(\d+)$", "$1$2")


def corrected_part(part: Column) -> Column:
    """A misread 74 or 54 series number set right: family by letters, number by digits; else the input."""
    upper = F.upper(F.trim(part))
    pattern = r"^([A-Z]{0,3})(7[4A]|54)([A-Z0-9]{2,8})$"
    maker, series, body = (F.regexp_extract(upper, pattern, i) for i in (1, 2, 3))
    family = F.lit("")
    for known in reversed(FAMILIES):
        fits = (F.length(body) > len(known)) & (F.translate(F.substring(body, 1, len(known)), *DIGITS_AS_LETTERS) == known)
        family = F.when(fits, known).otherwise(family)
    rest = F.substr(body, F.length(family) + 1)
    number = F.regexp_extract(F.translate(rest, *LETTERS_AS_DIGITS), r"^(.*\d)", 1)
    fixed = F.concat(maker, F.when(series == "7A", "74").otherwise(series), family, number, F.substr(rest, F.length(number) + 1))
    return F.when(upper.rlike(pattern) & (number != ""), fixed).otherwise(part)


def dip_pins(package: Column) -> Column:
    """The pins of a package DIP-n with n even and at least 4, else null."""
    n = F.regexp_extract(package, r"^DIP-(\d{1,4})$", 1).try_cast("int")
    return F.when((n >= 4) & (n % 2 == 0), n)


def grid_id(name: Column) -> Column:
    """(letter, number) of a grid position such as A12 or 12A; null if it is none."""
    letter = F.concat(F.regexp_extract(name, r"^([A-Z])\d{1,2}$", 1), F.regexp_extract(name, r"^\d{1,2}([A-Z])$", 1))
    number = F.regexp_extract(name, r"^(?:[A-Z](\d{1,2})|\d{1,2}[A-Z])$", 1)
    number = F.when(number != "", number).otherwise(F.regexp_extract(name, r"^(\d{1,2})[A-Z]$", 1))
    return F.when(letter != "", F.struct(letter.alias("letter"), number.cast("int").alias("number")))


def logo_names(text: Column) -> Column:
    """All names in angle brackets, upper-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"<([A-Za-z0-9]+)>"), 1), F.upper)


def natural_key(name: Column) -> Column:
    """A key that sorts digit runs by value and text without regard to case; shorter chunk lists come first."""
    chunk = lambda c: F.when(c.rlike(r"^\d"), F.lpad(F.regexp_replace(c, "^0+(?=.)", ""), 20, "0")).otherwise(F.lower(c))
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1), chunk)


def direction(value: Column) -> Column:
    """A signal direction from its code or its text; anything unknown is Bidirectional."""
    names = ["Input", "Output", "Bidirectional", "Power", "Ground"]
    by_code = F.get(F.array(*map(F.lit, names)), value.try_cast("int"))
    return F.coalesce(by_code, F.when(value.isin(names), value), F.lit("Bidirectional"))
