"""Drawings made from parts and nets, on a small board by hand; and symbols moved between sheets."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import drawing, wiring


@pytest.fixture(scope="module")
def board(spark):
    make = spark.createDataFrame
    arrays = "inputs array<int>, clocks array<int>, enables array<int>, outputs array<int>"
    return {
        "components": make([("b", "U1", 0, "SN7400", "DIP-14"), ("b", "U2", 1, "7404", "DIP-14"), ("b", "R1", 2, "RPACK", "SIP-8"), ("b", "U3", 3, "8212", "DIP-24"), ("c", "U1", 0, "7404", "SO-14")], "doc string, id string, ord int, part_number string, package string"),
        "parts": make([("7400", "DIP-14", "quad nand"), ("7404", "DIP-14", "hex not"), ("8212", "DIP-24", "port")], "part_number string, package string, description string"),
        "part_pins": make([("7400", "DIP-14", k, k + 1, n, "Input") for k, n in enumerate(["1A", "1B", "/1Y", "2A", "2B", "~2Y"])] + [("8212", "DIP-24", 0, 1, "DI", "Input"), ("8212", "DIP-24", 1, 2, "DO", "Output"), ("8212", "DIP-24", 2, 3, "IO", "Bidirectional"), ("8212", "DIP-24", 3, 24, "VCC", "Power")], "part_number string, package string, ord int, number int, name string, direction string"),
        "part_functions": make([("7400", "DIP-14", 0, "A", "NAND", [1, 2], [], [], [3]), ("7400", "DIP-14", 1, "B", "NAND", [4, 5], [], [], [6]), ("7404", "DIP-14", 0, "A", "NOT", [1], [], [], [2])], f"part_number string, package string, ord int, name string, type string, {arrays}"),
        "aliases": make([("7400", "DIP-14", "sn7400")], "part_number string, package string, alias string"),
        "nets": make([("b", "n1", 0, "A0"), ("b", "n2", 1, "SEL"), ("b", "n3", 2, ""), ("b", "gnd", 3, "GND"), ("b", "late", 4, "LATE"), ("c", "n1", 0, "X")], "doc string, net_id string, ord int, name string"),
        "net_pads": make([("b", "n1", 0, "U1", "1"), ("b", "n2", 0, "U1", "2"), ("b", "n2", 1, "U1", "4"), ("b", "n3", 0, "U1", "3"), ("b", "gnd", 0, "U1", "5"), ("b", "gnd", 1, "R1", "2"), ("b", "n3", 1, "R1", "10"), ("b", "gnd", 2, "U3", "24")], "doc string, net_id string, ord int, component_id string, pin string"),
        "net_vias": make([("b", "n3", 0, "U2", "1"), ("b", "n1", 0, "U2", "2"), ("b", "late", 0, "U2", "2"), ("b", "n3", 1, "U1", "2x"), ("b", "n1", 1, "", "7"), ("c", "n1", 0, "U1", "1")], "doc string, net_id string, ord int, component_id string, pin string"),
        "connectors": make([("b", "k1", 0, 5, "A0", "n1"), ("b", "k2", 1, 6, "OUT", "late"), ("b", "k3", 2, 7, "GND", "gnd"), ("b", "k4", 3, 8, "", "n2"), ("b", "k5", 4, 9, "LONE", None)], "doc string, id string, ord int, pin_number int, signal_name string, net_id string"),
        "board_pins": make([("b", 6, "Output"), ("b", 5, "Bidirectional")], "doc string, pin_number int, direction string"),
    }


@pytest.fixture(scope="module")
def made(board):
    return {k: df.persist() for k, df in drawing.generated(**board).items()}


def test_symbols_and_pins(made):
    symbols = {(r.doc, r.id): (r.gate_type, r.part_number, r.description) for r in made["symbols"].collect()}
    assert symbols == {
        ("b", "U1-A"): ("NAND", "SN7400", "quad nand"), ("b", "U1-B"): ("NAND", "SN7400", "quad nand"), ("b", "U2-A"): ("NOT", "7404", "hex not"), ("b", "R1"): ("BLOCK", "RPACK", ""), ("b", "U3"): ("BLOCK", "8212", "port"),
        ("b", "CONN-5"): ("CONNECTOR", "A0", ""), ("b", "CONN-6"): ("CONNECTOR", "OUT", ""), ("c", "U1-A"): ("NOT", "7404", "hex not"),
    }
    pins = {(r.doc, r.symbol_id, r.pin_number): (r.direction, r.net_id or "", r.net_name, r.negated) for r in made["pins"].collect()}
    assert pins == {
        ("b", "U1-A", 1): ("input", "n1", "A0", False), ("b", "U1-A", 2): ("input", "n2", "SEL", False), ("b", "U1-A", 3): ("output", "n3", "", True),
        ("b", "U1-B", 4): ("input", "n2", "SEL", False), ("b", "U1-B", 5): ("input", "gnd", "GND", False), ("b", "U1-B", 6): ("output", "", "", True),
        ("b", "U2-A", 1): ("input", "n3", "", False), ("b", "U2-A", 2): ("output", "late", "LATE", True),
        ("b", "R1", 2): ("power", "gnd", "GND", False), ("b", "R1", 10): ("input", "n3", "", False),
        ("b", "U3", 1): ("input", "", "", False), ("b", "U3", 2): ("output", "", "", False), ("b", "U3", 3): ("input", "", "", False), ("b", "U3", 24): ("power", "gnd", "GND", False),
        ("b", "CONN-5", 5): ("input", "n1", "A0", False), ("b", "CONN-6", 6): ("output", "late", "LATE", False),
        ("c", "U1-A", 1): ("input", "n1", "X", False), ("c", "U1-A", 2): ("output", "", "", True),
    }


def test_places_and_ports(made):
    at = {(r.doc, r.symbol_id, r.pin_number): (r.x, r.y) for r in made["pins"].collect()}
    column = {(r.doc, r.id): r.column for r in made["symbols"].collect()}
    assert column["b", "U1-A"] < column["b", "U2-A"] < column["b", "CONN-6"] and column["b", "CONN-5"] == 0
    ports = {(r.doc, r.symbol_id, r.pin_number): (r.id, r.x, r.y, r.is_ground) for r in made["ports"].collect()}
    assert ports == {k: (f"gnd:{i}", at[k][0], at[k][1] + 40, True) for i, k in enumerate([("b", "U1-B", 5), ("b", "R1", 2), ("b", "U3", 24)], 1)}


def test_wires_and_labels(made):
    at = {}
    for r in made["pins"].collect():
        at.setdefault((r.doc, r.net_id), set()).add((r.x, r.y))
    wires = made["wires"].collect()
    nets = {}
    for w in wires:
        assert w.clear and {tuple(w.points[0]), tuple(w.points[-1])} <= at[w.doc, w.net_id]
        nets[w.doc, w.net_id] = nets.get((w.doc, w.net_id), 0) + 1
    # n1 joins U1-A and CONN-5, n2 two inputs, n3 the output and two readers, late the inverter and its connector
    assert nets == {("b", "n1"): 1, ("b", "n2"): 1, ("b", "n3"): 2, ("b", "late"): 1}
    assert {(r.net_id, r.name) for r in made["labels"].collect()} == {("n1", "A0"), ("n2", "SEL"), ("late", "LATE")}
    points = made["pins"].select(F.struct("doc").alias("sheet"), "net_id", F.struct("x", "y").alias("p"))
    assert wiring.faults(made["wires"].select(F.struct("doc").alias("sheet"), "net_id", "ord", "points"), points).count() == 0


def test_stubs_stay_if_wanted(board):
    pins, _ = drawing.connector_symbols(board["connectors"], board["board_pins"], board["nets"])
    assert {r.id for r in pins.collect()} == {"CONN-5", "CONN-6", "CONN-9"}


def test_moves_touch_only_their_nets(spark):
    rng = random.Random(3)
    symbols = spark.createDataFrame([("d", f"s{i:02d}", i, rng.choice([0, 1, 2, 3])) for i in range(30)], "doc string, id string, ord int, sheet int")
    rows = [("d", f"s{rng.randrange(30):02d}", k, rng.choice(["input", "output", "clock"]), f"n{rng.randrange(12)}" if k % 9 else None, rng.choice(["", "N"]), rng.uniform(0, 900), rng.uniform(0, 900)) for k in range(120)]
    pins = spark.createDataFrame(rows, "doc string, symbol_id string, ord int, direction string, net_id string, net_name string, x double, y double")
    power = spark.createDataFrame([("d", "n3")], "doc string, net_id string")
    before = drawing.off_sheet(symbols, pins, power).withColumns({"x": F.col("x") + 7}).persist()
    moves = spark.createDataFrame([("d", "s04", 9), ("d", "s17", 2)], "doc string, id string, sheet int")
    now, after = drawing.moved(symbols, pins, before, moves, power)
    whole = drawing.off_sheet(now, pins, power)
    kept = {(r.sheet, r.net_id): (r.x, r.y) for r in before.collect()}
    want = {(r.sheet, r.net_id, r.target_sheet, r.direction, *kept.get((r.sheet, r.net_id), (r.x, r.y))) for r in whole.collect()}
    got = [(r.sheet, r.net_id, r.target_sheet, r.direction, r.x, r.y) for r in after.collect()]
    assert len(got) == len(want) and set(got) == want and {r.sheet for r in after.collect()} == {1, 2, 3, 9}


def test_no_board(spark, board):
    none = {k: df.limit(0) for k, df in board.items()}
    assert {k: df.count() for k, df in drawing.generated(**none).items()} == dict.fromkeys(["symbols", "pins", "ports", "wires", "labels"], 0)
