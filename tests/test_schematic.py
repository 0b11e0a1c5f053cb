"""Schematic rows and package sizes."""

from tracewright.operators import packages, schematic


def test_stubs_go_only_from_lone_nets(spark):
    symbols = spark.createDataFrame([("c1", "CONNECTOR", 1), ("c2", "CONNECTOR", 1), ("u1", "NAND", 1)], "id string, kind string, pins int")
    pins = spark.createDataFrame([("c1", "n1"), ("c2", "n2"), ("u1", "n2"), ("u1", "n3")], "symbol_id string, net_id string")
    assert sorted(r.id for r in schematic.without_stubs(symbols, pins).collect()) == ["c2", "u1"]


def test_saved_places_win(spark):
    symbols = spark.createDataFrame([("a", 12.0, 3.0, 0), ("b", 7.6, 0.0, 90)], "id string, x double, y double, rotation int")
    saved = spark.createDataFrame([("a", 101.0, 99.0, 180), ("z", 0.0, 0.0, 0)], "id string, x double, y double, rotation int")
    assert {r.id: tuple(r)[1:] for r in schematic.laid_out(symbols, saved).collect()} == {"a": (100.0, 100.0, 180, True), "b": (10.0, 0.0, 90, False)}


def test_power_units_and_bounds(spark):
    ports = spark.createDataFrame([("p1", "s1", 7, "GND"), ("p2", "s1", 14, "VCC"), ("p3", "s9", 1, "VCC")], "id string, symbol_id string, pin_number int, name string")
    pins = spark.createDataFrame([("s1", 7, 0, 10.0, 20.0), ("s1", 14, 1, 30.0, 40.0), ("s1", 14, 2, 0.0, 0.0)], "symbol_id string, number int, ord int, x double, y double")
    assert {r.id: (r.x, r.y) for r in schematic.power_places(ports, pins).collect()} == {"p1": (10.0, 60.0), "p2": (30.0, 0.0)}
    symbols = spark.createDataFrame([("U1", "B", 0), ("U1", "A", 1), ("U1", "B", 2), ("U2", "A", 3)], "component_id string, function_name string, ord int")
    assert {(r.component_id, r.function_name): r.unit for r in schematic.unit_numbers(symbols).collect()} == {("U1", "B"): 1, ("U1", "A"): 2, ("U2", "A"): 1}
    dots = spark.createDataFrame([(1, 0.0, 5.0), (1, 10.0, -5.0)], "sheet int, x double, y double")
    assert tuple(schematic.sheet_bounds(dots).first()) == (1, -50.0, -55.0, 60.0, 55.0)


def test_axis_runs(spark):
    rows = [("i", v, 10.0, v * 30.0) for v in (1, 2, 4, 5, 9, 10)] + [("i", v, 70.0, 0.0) for v in (1, 2, 3)]
    got = schematic.axis_runs(spark.createDataFrame(rows, "img_id string, value int, x double, y double"))
    assert [tuple(r) for r in got.collect()] == [("i", 0, 1, 5, 4)]


def test_template_matches(spark):
    parts = spark.createDataFrame([(1, 7.0, 20.0), (2, 20.0, 7.0), (3, 7.6, 50.0), (4, 30.0, 33.0)], "id int, width_mm double, height_mm double")
    templates = spark.createDataFrame([("DIP-14", 6.0, 8.0, 18.0, 22.0), ("wide", 5.0, 9.0, 18.0, 22.0)], "template string, width_low double, width_high double, height_low double, height_high double")
    got = {r.id: (r.template, r.turned, r.reason) for r in packages.template_matches(parts, templates).collect()}
    assert got == {1: ("DIP-14", False, "template"), 2: ("DIP-14", True, "template"), 3: (None, None, "DIP width"), 4: (None, None, "no size fits")}


def test_guessed_pin(spark):
    vias = spark.createDataFrame([("U1", "v", 5.0, 0.0)], "component string, id string, x double, y double")
    places = spark.createDataFrame([("U1", 2, 10.0, 0.0), ("U1", 1, 0.0, 0.0), ("U2", 9, 5.0, 0.0)], "component string, pin int, x double, y double")
    assert packages.guessed_pin(vias, places).first().pin == 1
