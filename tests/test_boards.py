"""Board operators on hand-made boards and tables."""

import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewright.functions import dates, geometry, names, text
from tracewright.operators import graph, near, nets, parts, schematic, stats
from tracewright.sources import documents


def points(spark, rows):
    return spark.createDataFrame(rows, "id string, x double, y double")


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("v")).first().v


@pytest.mark.parametrize(("name", "value"), [("net-001", 0), ("B13.1", 1), ("GND", 2), ("net-1a", 2), ("CLK.2", 1)])
def test_net_priority(spark, name, value):
    assert one(spark, names.net_priority(F.col("n")), n=name) == value


@pytest.mark.parametrize(("a", "b", "best"), [("net-001", "U1.2", "U1.2"), ("GND#2", "GND", "GND"), ("AB", "CD", "AB"), ("U1.2", "net-001", "U1.2")])
def test_better_name(spark, a, b, best):
    assert one(spark, names.better_name(F.col("a"), F.col("b")), a=a, b=b) == best


@pytest.mark.parametrize(("name", "base"), [("GND#2", "GND"), ("#5", "#5"), ("A#1#2", "A#1"), ("A", "A")])
def test_base_name(spark, name, base):
    assert one(spark, names.base_name(F.col("n")), n=name) == base


@pytest.mark.parametrize(("gate", "name", "out"), [("NOT", "FOO", "/FOO"), ("NOT", "/FOO", "FOO"), ("BUFFER", "FOO", "bFOO"), ("NAND", "/FOO", "//FOO"), ("AND", "FOO", "")])
def test_output_name(spark, gate, name, out):
    assert one(spark, names.output_name(F.col("g"), F.col("n")), g=gate, n=name) == out


@pytest.mark.parametrize(("part", "normal"), [("74LS373N", "74373"), ("SN74LS244N", "74244"), ("54LS123", "54123"), ("MC68B02-02", "MC68B02"), ("Z80A", "Z80"), ("6502", "6502")])
def test_normal_part(spark, part, normal):
    assert one(spark, names.normal_part(F.col("p")), p=part) == normal


@pytest.mark.parametrize(("part", "fixed"), [("74L5244N", "74LS244N"), ("7ALS00", "74LS00"), ("7450", "74S0"), ("Z80", "Z80"), ("SN74LS24O", "SN74LS240"), ("74ALS", "74A15")])
def test_corrected_part(spark, part, fixed):
    assert one(spark, names.corrected_part(F.col("p")), p=part) == fixed


def test_natural_order(spark):
    df = spark.createDataFrame([("U10",), ("u2",), ("U2B",), ("A1",)], "n string")
    assert [r.n for r in df.orderBy(names.natural_key(F.col("n"))).collect()] == ["A1", "u2", "U2B", "U10"]


@pytest.mark.parametrize(("code", "context", "want"), [("8923", 0, (1989, 6, 23)), ("9L5", 0, (1999, 11, 5)), ("923", 1990, (1989 + 0, 6, 23)), ("8954", 0, None), ("9I3", 0, None), ("0453", 1990, (1904, 12, 53)), ("8923", 1990, (1989, 6, 23))])
def test_date_codes(spark, code, context, want):
    got = one(spark, dates.decode(F.col("c"), context), c=code)
    if code == "923":
        want = (1999 - 10, 6, 23) if 1999 > context + 5 else (1999, 6, 23)
    assert (got and (got.year, got.month, got.week)) == want


def test_date_search_order(spark):
    assert one(spark, dates.extract(F.col("t"), 1990)["format"], t="LOT 8923 9L5") == "YMW"
    assert one(spark, dates.extract(F.col("t"), 1990)["format"], t="LOT 8923 912") == "YYWW"
    assert one(spark, dates.extract(F.col("t"), 1990), t="no code") is None


def test_text_similarity(spark):
    v = lambda f, t: one(spark, text.text_similarity(F.col("f"), F.col("t")), f=f, t=t)
    assert v("abc", "ABC") == 1.0
    assert v("abc", "<TI>") == 0.5 and v("", "<TI>") == 0.0
    assert v("ABD", "ABC") == pytest.approx(0.35 * 2 / 3 + 0.25 * 2 / 3 + 0.25 * 2 / 3)
    assert text.common_subsequence("AGCAT", "GAC") == 2


def test_geometry(spark):
    p = geometry.point(F.lit(1.0), F.lit(1.0))
    square = F.array(*(geometry.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))))
    got = spark.range(1).select(geometry.in_polygon(p, square).alias("a"), geometry.in_polygon(geometry.point(F.lit(3.0), F.lit(1.0)), square).alias("b"), geometry.path_length(square).alias("c"), geometry.segment_distance(p, geometry.point(F.lit(0.0), F.lit(0.0)), geometry.point(F.lit(2.0), F.lit(0.0))).alias("d"), geometry.bounds(square).alias("e"), geometry.snapped(F.lit(12.6)).alias("f"), geometry.hsv(F.lit(255), F.lit(0), F.lit(0)).alias("g")).first()
    assert (got.a, got.b, got.c, got.d) == (True, False, 6.0, 1.0)
    assert tuple(got.e) == (0.0, 0.0, 2.0, 2.0) and got.f == 15.0 and tuple(got.g) == (0.0, 255.0, 255.0)


def board(spark):
    tracks = spark.createDataFrame(
        [("t1", "front", [(0.0, 0.0), (100.0, 0.0)]), ("t2", "back", [(100.0, 0.0), (100.0, 80.0)]), ("t3", "back", [(500.0, 500.0), (600.0, 500.0)]), ("t4", "front", [(900.0, 900.0)]), ("t5", "front", [(300.0, 0.0), (400.0, 0.0)])],
        "id string, side string, points array<struct<x:double,y:double>>",
    )
    vias = points(spark, [("v1", 0.0, 5.0), ("v2", 100.0, 85.01), ("v3", 305.0, 0.0), ("v4", 900.0, 900.0)])
    connectors = spark.createDataFrame([("c1", "front", 495.0, 495.0, 10.0, 10.0), ("c2", "back", 595.0, 495.0, 10.0, 10.0)], "id string, side string, bx double, by double, bw double, bh double")
    return tracks, vias, connectors


def test_conducting_pairs(spark):
    got = {(r.a, r.b) for r in nets.conducting_pairs(*board(spark)).collect()}
    # v1 at 5.0 joins, v2 at 5.01 does not; t3 is on the back: c2 joins, c1 does not; t4 has one point
    assert got == {("t1", "v1"), ("t1", "t2"), ("t2", "t1"), ("t3", "c2"), ("t5", "v3")}


def test_reconciled(spark):
    pairs = nets.conducting_pairs(*board(spark))
    elements = spark.createDataFrame([("t1", "trace"), ("t2", "trace"), ("t3", "trace"), ("t5", "trace"), ("v1", "via"), ("v2", "via"), ("v3", "via"), ("c2", "connector")], "id string, kind string")
    old = spark.createDataFrame([("net-001", "CLOCK", False), ("net-002", "net-002", True), ("net-007", "GND", False)], "net_id string, name string, manual boolean")
    members = spark.createDataFrame([("net-001", "v1"), ("net-001", "t3"), ("net-002", "t2"), ("net-007", "v2"), ("net-007", "gone")], "net_id string, element_id string")
    new, own = nets.reconciled(pairs, elements, old, members)
    held = {}
    for r in own.collect():
        held.setdefault(r.net_id, set()).add(r.element_id)
    named = {r.net_id: (r.name, r.manual) for r in new.collect()}
    assert held == {"net-002": {"t1", "t2", "v1"}, "net-001": {"t3", "c2"}, "net-007": {"v2"}, "net-008": {"t5", "v3"}}
    assert named == {"net-002": ("net-002", True), "net-001": ("CLOCK", False), "net-007": ("GND", False), "net-008": ("net-008", False)}


def test_disambiguated(spark):
    df = spark.createDataFrame([("net-003", "GND"), ("net-001", "GND#7"), ("net-002", "GND"), ("net-004", "A")], "net_id string, name string")
    assert {r.net_id: r.name for r in nets.disambiguated(df).collect()} == {"net-001": "GND", "net-002": "GND#2", "net-003": "GND#3", "net-004": "A"}


def test_netlist_text(spark):
    pins = spark.createDataFrame([("n1", "U1", "1", "CLK"), ("n1", "U2", "10", ""), ("n1", "U1", "2", ""), ("n2", "U1", "1A", ""), ("n2", "U1", "10", "")], "net_id string, component string, pin string, signal string")
    named = spark.createDataFrame([("n1", "CLOCK"), ("n2", "X")], "net_id string, name string")
    got = [r.line for r in nets.netlist_text(pins, named).orderBy("component", "line_no").collect()]
    assert got == ["U1:", "  pin 1    [CLOCK] -> U1-2, U2-10", "  pin 1A   [X] -> U1-10", "  pin 2    [CLOCK] -> U1-1(CLK), U2-10", "  pin 10   [X] -> U1-1A", "U2:", "  pin 10   [CLOCK] -> U1-1(CLK), U1-2"]


def test_signals(spark):
    vias = spark.createDataFrame([("v1", "U1", "3"), ("v2", "", "")], "id string, component_id string, pin_number string")
    comps = spark.createDataFrame([("U1", "7404", "DIP-14")], "cid string, part_number string, package string")
    pins = spark.createDataFrame([("7404", "DIP-14", "3", "2A", "Output")], "part_number string, package string, pin_number string, pin_name string, direction string")
    assert {r.id: (r.signal, r.direction) for r in nets.signals(vias, comps, pins).collect()}["v1"] == ("U1-2A", "Output")


def test_tiers(spark):
    lib = spark.createDataFrame([("74LS00N", "DIP-14"), ("74HC00", "SO-14"), ("Z80", "DIP-40")], "part_number string, package string")
    alias = spark.createDataFrame([("Z80", "DIP-40", "MK3880")], "part_number string, package string, alias string")
    want = spark.createDataFrame([(1, "74LS00N", "DIP-14"), (2, "mk3880", "DIP-40"), (3, "SN74F00", "DIP-14"), (4, "MK3880", "X"), (5, "74S00", "X"), (6, "none", "X")], "id int, part_number string, package string")
    got = {r.id: (r.found_part, r.tier) for r in parts.tiered_lookup(want, lib, alias).collect()}
    assert got == {1: ("74LS00N", 1), 2: ("Z80", 2), 3: ("74LS00N", 3), 4: ("Z80", 4), 5: ("74HC00", 5), 6: (None, None)}
    loose = {r.id: r.tier for r in parts.tiered_lookup(want, lib, alias, by_package=False).collect()}
    assert loose == {1: 1, 2: 2, 3: 3, 4: 2, 5: 3, 6: None}


def test_matching_ties_and_leftovers(spark):
    a = points(spark, [("a1", 0.0, 0.0), ("a2", 2.0, 0.0), ("a3", 50.0, 0.0)])
    b = points(spark, [("b1", 1.0, 0.0), ("b2", 3.0, 0.0)])
    got = {(r.left_id, r.right_id) for r in near.greedy_match(near.near_join(a, b, 1.5)).collect()}
    assert got == {("a1", "b1"), ("a2", "b2")}
    assert near.greedy_match(near.near_join(a.limit(0), b, 1.5)).count() == 0


def test_thinning_follows_the_order(spark):
    p = points(spark, [("a", 0.0, 0.0), ("b", 0.9, 0.0), ("c", 1.8, 0.0), ("d", 9.0, 0.0)])
    kept = near.thinned(p, near.near_join(p, p, 1.0, strict=True), "id")
    assert sorted(r.id for r in kept.collect()) == ["a", "c", "d"]


def test_results_do_not_depend_on_partitions(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10] + [(5, 5)], "a long, b long")
    got = [sorted(map(tuple, graph.components(edges.repartition(n)).collect())) for n in (1, 5)]
    assert got[0] == got[1] and {r for n, r in got[0] if 1 <= n <= 10} == {1}


def test_layers_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "a string, b string")
    assert {r.node: r.layer for r in graph.layers(edges).collect()} == {"a": 0, "b": 1, "c": 2, "x": 1, "y": 1}


def test_spanning_tree(spark):
    df = spark.createDataFrame([("n", "p1", 0.0, 0.0), ("n", "p2", 0.0, 10.0), ("n", "p3", 5.0, 10.0), ("m", "q", 0.0, 0.0)], "net_id string, id string, x double, y double")
    assert sorted((r.a, r.b, r.length) for r in graph.spanning_trees(df).collect()) == [("p1", "p2", 10.0), ("p2", "p3", 5.0)]


def test_statistics(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)] + [("h", 7), ("h", None)], "k string, v int")
    assert {r.k: r.median for r in stats.upper_median(df, ["k"], "v").collect()} == {"g": 3, "h": 7}
    runs = spark.createDataFrame([(i,) for i in (1, 2, 5, 6, 7, 4095, 4096, 4097, 4098)], "p long")
    assert tuple(stats.longest_run(runs, "p", F.lit(True)).first()) == (4095, 4098, 4)
    assert stats.group_variance(df, "k", "v").first().variance == pytest.approx(1.25)
    assert stats.group_variance(df.where("k = 'h'"), "k", "v").first().variance is None


def test_crossings_and_junctions(spark):
    wires = spark.createDataFrame([("w1", "a", [(0.0, 5.0), (300.0, 5.0)]), ("w2", "b", [(250.0, 0.0), (250.0, 10.0)]), ("w3", "c", [(0.0, 5.0), (0.0, 9.0)])], "id string, net_id string, points array<struct<x:double,y:double>>")
    assert [tuple(r) for r in schematic.crossings(wires).collect()] == [("a", "b", 250.0, 5.0)]
    assert {r.net_id: (r.length, r.bends) for r in schematic.wire_lengths(wires).collect()}["a"] == (300.0, 0)
    dots = spark.createDataFrame([(1, 10.0, 10.0), (1, 11.0, 9.0), (1, 10.0, 12.0), (1, 40.0, 0.0)], "sheet int, x double, y double")
    assert [tuple(r) for r in schematic.junctions(dots).collect()] == [(1, 10.0, 10.0, 3)]


def test_documents(spark, tmp_path):
    vias = spark.createDataFrame([("p", 0, "v2", (1.0, 2.0), 3.0), ("p", 1, "v1", (0.0, 2.0), 1.0)], "document string, ord int, id string, center struct<x:double,y:double>, radius double")
    settings = spark.createDataFrame([("p", "board", 600.0, 1.5), ("q", "none", None, None)], "document string, name string, dpi double, front_rotation double")
    documents.save_project({"vias": vias, "settings": settings}, str(tmp_path / "doc"))
    back = documents.load_project(spark, str(tmp_path / "doc"))
    assert [(r.id, tuple(r.center), r.radius) for r in back["vias"].orderBy("ord").collect()] == [("v2", (1.0, 2.0), 3.0), ("v1", (0.0, 2.0), 1.0)]
    assert back["nets"].count() == 0 and back["tracks"].count() == 0
    assert {(r.version, r.name, r.dpi, r.front_rotation) for r in back["settings"].collect()} == {(3, "board", 600.0, 1.5), (3, "none", None, None)}


@pytest.mark.parametrize("kind", list(documents.DOCUMENTS))
def test_documents_survive_a_round(spark, tmp_path, kind):
    """Every kind of document: written, read, written again, with records in their order."""
    settings, arrays = documents.DOCUMENTS[kind]
    columns = ("document string" + (f", {settings}" if settings else ""), {k: f"document string, ord int, {documents.SCHEMAS[r]}" for k, r in arrays.items()})
    row = lambda d, schema, *first: spark.createDataFrame([tuple([d, *first] + [None] * (len(spark.createDataFrame([], schema).columns) - 1 - len(first)))], schema)
    tables = {"settings": row("a", columns[0]).unionByName(row("b", columns[0]))}
    for key, schema in columns[1].items():
        tables[key] = row("a", schema, 1).unionByName(row("a", schema, 0)).unionByName(row("b", schema, 0))
    documents.save_documents(tables, str(tmp_path / "one"), kind)
    read = documents.load_documents(spark, str(tmp_path / "one"), kind)
    assert read["settings"].count() == 2 and all(read[k].count() == 3 for k in arrays)
    documents.save_documents(read, str(tmp_path / "two"), kind)
    text = lambda name: sorted(r.value for r in spark.read.text(str(tmp_path / name), wholetext=True).collect())
    assert text("one") == text("two")


def _filled(kind, depth=0):
    """A value of a type with something in every field."""
    name = kind.typeName()
    if name == "struct":
        return {f.name: _filled(f.dataType, depth + 1) for f in kind.fields}
    if name == "array":
        return [_filled(kind.elementType, depth + 1)] * 2
    if name == "map":
        return {"7": _filled(kind.valueType, depth + 1)}
    made = {"string": f"s{depth}", "double": 1.5 + depth, "integer": 3 + depth, "long": 2**40, "boolean": True, "binary": b"\x01\xff", "timestamp": datetime.datetime(2024, 5, 6, 7, 8, 9)}
    return made[name]


@pytest.mark.parametrize("kind", list(documents.DOCUMENTS))
def test_every_field_survives(spark, tmp_path, kind):
    """A value in each field of each record of two documents, and an array without rows in one of them."""
    settings, arrays = documents.DOCUMENTS[kind]
    types = lambda ddl: spark.createDataFrame([], ddl).schema
    full = types("document string" + (f", {settings}" if settings else ""))
    rows = [_filled(full) | {"document": d} for d in ("a b+c%", "b")]
    tables = {"settings": spark.createDataFrame(rows, full)}
    for key, record in arrays.items():
        schema = types(f"document string, ord int, {documents.SCHEMAS[record]}")
        tables[key] = spark.createDataFrame([_filled(schema) | {"document": "b", "ord": k} for k in (0, 1)], schema)
    documents.save_documents(tables, str(tmp_path / "saved"), kind)
    read = documents.load_documents(spark, str(tmp_path / "saved"), kind)
    for key, df in tables.items():
        assert sorted(map(repr, read[key].select(df.columns).collect())) == sorted(map(repr, df.collect())), key
    texts = {r.document: r.value for r in documents.document_texts(tables, kind, pretty=False).collect()}
    assert all(f'"{key}":[]' in texts["a b+c%"] for key in arrays)


def test_documents_in_lines(spark, tmp_path):
    (tmp_path / "two.jsonl").write_text('{"parts": [{"part_number": "A"}]}\n\n{"parts": [{"part_number": "B"}, {"part_number": "C"}]}\n')
    read = documents.load_documents(spark, str(tmp_path / "two.jsonl"), "library", lines=True)
    assert sorted(r.part_number for r in read["parts"].collect()) == ["A", "B", "C"]
    names = {r.document for r in read["settings"].collect()}
    assert len(names) == 2 and all(n.startswith("two#") for n in names)
    with pytest.raises(Exception, match="text after its end"):
        documents.load_documents(spark, str(tmp_path / "two.jsonl"), "library")["parts"].collect()


def test_documents_as_people_write_them(spark, tmp_path):
    (tmp_path / "library.json").write_text('{\n "parts": [\n {"part_number": "74LS00", "package": "DIP-14", "pins": [{"number": 1, "name": "A", "direction": "Input"}], "aliases": ["7400"], "functions": [{"name": "a", "type": "NAND", "inputs": [1, 2], "outputs": [3]}]},\n {"part_number": "B"}]}')
    parts = documents.load_parts(spark, str(tmp_path / "library.json"))
    assert [r.part_number for r in parts["parts"].collect()] == ["74LS00", "B"]
    assert [tuple(r)[2:4] for r in parts["part_pins"].collect()] == [(1, "A")] and parts["part_aliases"].first().alias == "7400" and parts["part_functions"].first().inputs == [1, 2]
    (tmp_path / "readings.json").write_text('{"version": 1, "samples": [{"truth": "a", "score": 0.9}, {"truth": "b", "score": 0.2}], "orientation_stats": {"N": {"count": 1, "avg_score": 0.9, "best": 0.9}}}')
    start = documents.startup_tables(spark, {"reading_training": str(tmp_path / "readings.json")})
    assert [r.truth for r in start["reading_training"].collect()] == ["a"] and start["logos"].count() == 0
    (tmp_path / "layout.json").write_text('{"symbols": {"U1": {"x": 5, "y": 10, "flip_h": true}, "U2": {"x": 1, "y": 2, "sheet": 2}}, "sheets": [{"number": 1, "name": "one"}]}')
    layout = documents.load_documents(spark, str(tmp_path / "layout.json"), "layout")
    rows = documents.places(layout["settings"])
    assert {(r.id, r.x, r.flip_h, r.sheet) for r in rows.collect()} == {("U1", 5.0, True, None), ("U2", 1.0, None, 2)}
    assert {*documents.places_map(rows).first().symbols} == {"U1", "U2"}
    (tmp_path / "broken.json").write_text('{"parts": [{"part_number": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.load_parts(spark, str(tmp_path / "broken.json"))["parts"].collect()


def test_records_in_lines_and_arrays(spark, tmp_path):
    rows = spark.range(10).selectExpr("cast(id as string) id", "cast(id as double) radius")
    documents.save_records(rows.coalesce(1), str(tmp_path / "lines"))
    assert documents.load_records(spark, str(tmp_path / "lines"), "vias").count() == 10
    (tmp_path / "array.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert documents.load_records(spark, str(tmp_path / "array.json"), "vias", lines=False).count() == 2


def test_queries_have_sql():
    import __spark_entry__ as entry

    from tracewright.plans import catalog

    known, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(known) and set(known) - set(sql) <= {"part_repairs", "label_similarity", "board_affine", "grid_names", "net_trees", "contact_outliers", "drawing_places", "lattice_ways"}
    assert set(known) <= set(entry.queries())
