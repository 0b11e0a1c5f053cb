"""Steps whose work once grew faster than their input, and results that once depended on the partitions."""

import random
import time

from pyspark.sql import functions as F

from tracewright.operators import alignment, features, graph, near, nets, packages, schematic, selecting, training, wiring
from tracewright.plans import outlines


def _plain_tree(points):
    """Prim's tree from the least id; ties by the tree's end, then the other."""
    points = sorted(points)
    at = {p: (x, y) for p, x, y in points}
    far = lambda p, q: abs(at[p][0] - at[q][0]) + abs(at[p][1] - at[q][1])
    best = {p: (far(p, points[0][0]), points[0][0]) for p, _, _ in points[1:]}
    rows = set()
    while best:
        node = min(best, key=lambda p: (*best[p], p))
        length, source = best.pop(node)
        rows.add((min(node, source), max(node, source), length))
        for p, old in best.items():
            best[p] = min(old, (far(p, node), node))
    return rows


def test_trees_of_points_at_few_places(spark):
    draw = random.Random(3)
    nets = {n: [(f"p{i:03d}", float(draw.randrange(4 + 3 * n)), float(draw.randrange(5))) for i in range(120)] for n in range(6)}
    df = spark.createDataFrame([(n, *p) for n, pts in nets.items() for p in pts], "net_id int, id string, x double, y double")
    got = graph.spanning_trees(df).collect()
    for n, pts in nets.items():
        assert {(r.a, r.b, r.length) for r in got if r.net_id == n} == _plain_tree(pts)
    assert len(got) == 6 * 119


def test_tree_of_a_large_net(spark):
    pins = spark.range(40_000).selectExpr("1 AS net_id", "id", "id * 37 % 31 * 1.0D AS x", "id * 53 % 29 * 1.0D AS y")
    began = time.perf_counter()
    assert graph.spanning_trees(pins).count() == 39_999
    assert time.perf_counter() - began < 60  # every pair of pins in plain Python takes minutes


def test_pins_by_a_shuffle_join(spark):
    """What pins are derived from looks small; a broadcast of them took the driver's memory."""
    places = spark.range(50).selectExpr("id AS component", "explode(sequence(1, 14)) AS pin").selectExpr("component", "pin", "pin * 10.0D AS x", "0.0D AS y")
    vias = places.selectExpr("component", "concat_ws('.', component, pin) AS id", "x + 5 AS x", "y")
    got = packages.guessed_pin(vias, places)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.pin) for r in got.collect()} == {(f"{c}.{n}", n) for c in range(50) for n in range(1, 15)}


def test_moved_grid_without_joins(spark):
    rows = [(k, n, n * 10.0, 0.0, n * 10.0 + k + (50 if n == 3 else 0), 2.0, k < 2) for k in range(3) for n in range(1, 15)]
    rows += [(None, 1, 10.0, 0.0, 12.0, 1.0, True)]
    df = spark.createDataFrame(rows, "id long, pin int, x double, y double, dx double, dy double, found boolean")
    got = selecting.shifted_grid(df, 30.0)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.pin): (round(r.x, 9), r.y) for r in got.collect()} == {(k, n): (x + (k if f and k else 0), 2.0 if f and k is not None else 0.0) for k, n, x, _, _, _, f in rows}


def test_anchor_by_a_fixed_order(spark):
    draw = random.Random(5)
    rows = [(b, o, round(draw.uniform(-100, 1000), 3)) for b in range(40) for o in range(20)]
    rows += [(b, 100 + o, round(900 - x, 3)) for b, o, x in rows]  # mirrored: each error twice
    pitches = spark.createDataFrame([(b, 25.0) for b in range(40)], "board int, pitch double")
    want = {}
    for board in range(40):
        at = sorted(((o, x) for b, o, x in rows if b == board), reverse=True)
        for o, x in at:
            error = 0.0
            for p, y in at:
                if p != o:
                    n = abs(y - x) / 25.0
                    error += abs(abs(y - x) - max(n // 1 + (n - n // 1 >= 0.5), 1.0) * 25.0)
            want[board] = min(want.get(board, (error, o)), (error, o))
    for parts in (1, 7):
        draw.shuffle(rows)
        df = spark.createDataFrame(rows, "board int, ord int, x double").repartition(parts)
        assert {r.board: (r.error, r.ord) for r in alignment.anchor(df, pitches).collect()} == want


def test_equal_markers_are_runs_apart(spark):
    rows = [("i", v, 10.0, 5.0) for v in (1, 2, 3, 3, 5)]
    got = schematic.axis_runs(spark.createDataFrame(rows, "img_id string, value int, x double, y double"))
    assert [tuple(r) for r in got.collect()] == [("i", 0, 1, 3, 3)]


def test_first_line_of_a_number_counts(spark, tmp_path):
    rows = [(o, n, 10 + 7 * n, 3 * n + 1, k) for o in range(300) for k, n in enumerate((1, 2, 3))]
    rows += [(o, n, 5, 3, 9) for o in range(300) for n in (1, 2, 3)]  # of the same numbers, unnamed and later in the file
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, k int").coalesce(1).sortWithinPartitions("k", "l_orderkey")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert outlines.neighbour_pins(spark, str(tmp_path)).count() == 0  # all first lines have pins
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_new_readings_by_places(spark):
    draw = random.Random(7)
    place = lambda n: [(i, draw.choice("ab"), draw.randrange(-40, 400), draw.randrange(-40, 60)) for i in range(n)]
    found, known = place(400), place(120)
    schema = "id long, text string, x long, y long"
    got = selecting.new_readings(spark.createDataFrame([*found, (900, "a", None, 1), (901, None, 1, 1)], schema), spark.createDataFrame(known, schema), 9)
    near = lambda r: any(r[1] == k[1] and abs(r[2] - k[2]) < 9 and abs(r[3] - k[3]) < 9 for k in known)
    assert sorted(r.id for r in got.collect()) == [r[0] for r in found if not near(r)] + [900, 901]


def test_new_readings_of_crowded_places(spark):
    one = spark.range(60_000).selectExpr("id", "'t' AS text", "id % 3 AS x", "id % 2 AS y")
    began = time.perf_counter()
    assert selecting.new_readings(one, one, 9).count() == 0
    assert time.perf_counter() - began < 60  # all pairs of readings are 3.6e9


def test_votes_by_board(spark):
    draw = random.Random(11)
    rows = [(b, round(draw.uniform(0, 300), 1)) for b in range(5) for _ in range(25)] + [(9, 1.0), (None, 3.0), (0, None)]
    got = {r.board: (r.bin, r.votes, r.pitch) for r in alignment.pitch_votes(spark.createDataFrame(rows, "board int, x double"), 20.0).collect()}
    want = {}
    for board in range(5):
        x = [v for b, v in rows if b == board and v is not None]
        votes = {}
        for p in x:
            for q in x:
                if q > p:
                    for k in range(1, int((q - p) // 20) + 1):
                        votes.setdefault(int((q - p) / k), []).append((q - p) / k)
        best = min(votes, key=lambda b: (-len(votes[b]), b))
        want[board] = (best, len(votes[best]), sum(votes[best]) / len(votes[best]))
    assert set(got) == set(want)
    for board, (b, n, pitch) in want.items():
        assert got[board][:2] == (b, n) and abs(got[board][2] - pitch) < 1e-9
    plan = alignment.pitch_votes(spark.createDataFrame(rows, "board int, x double"), 20.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # positions are shuffled, not their pairs


def test_many_nets_of_a_few_pins(spark):
    """A sheet is a group, not each of its nets."""
    k = "id % 20"
    pins = spark.range(40_000).selectExpr("id div 20 AS sheet", f"concat('n', {k} % 6) AS net_id", "id", f"({k} div 10) * 250.0D AS x", f"{k} % 10 * 40.0D AS y", "'input' AS direction")
    got = wiring.edges(wiring.net_pins(pins))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    assert got.count() == 2_000 * 14
    first = [(r.ord, r.net_id, r.from_id, r.to_id) for r in got.where("sheet = 0").orderBy("ord").collect()]
    assert first[:6] == [(1, "n0", 0, 6), (2, "n0", 12, 18), (3, "n0", 0, 12), (4, "n1", 1, 7), (5, "n1", 13, 19), (6, "n1", 1, 13)]


def test_routing_joins_by_shuffles(spark):
    """Candidates of edges are many more than what they are derived from; nothing of them is broadcast."""
    pins = spark.createDataFrame([(1, "a", i, 100.0 * (i % 2), 40.0 * i, "input") for i in range(6)], "sheet int, net_id string, id int, x double, y double, direction string")
    points, lines = (df.withColumn("ord", F.lit(0)) for df in wiring.standing(pins))
    tried = wiring._tried(wiring.edges(wiring.net_pins(pins)), wiring.NARROW)
    for df in (wiring._unblocked(tried, points, lines), wiring._cheapest(tried, lines)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_equal_boxes_are_thinned_once(spark):
    draw = random.Random(13)
    rows = [(draw.randrange(2), i, *(draw.randrange(8) / 2 for _ in range(2)), 5.0, 5.0) for i in range(300)] + [(None, 900, 1.0, 1.0, 5.0, 5.0), (0, 901, None, 1.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "board int, id int, x double, y double, width double, height double")
    few = training.apart(df)
    assert few.count() <= 2 * 64 + 2
    kept = lambda b: sorted(r.id for r in near.thinned(b, training.same_box(b), "id").collect())
    assert kept(few) == kept(df)


def test_loose_pins_by_a_shuffle_join(spark):
    p = spark.range(20).selectExpr("cast(id AS string) AS part_number", "'DIP' AS package")
    pins = p.selectExpr("*", "explode(sequence(1, 14)) AS pin_number")
    none = "cast(array() AS array<int>)"
    got = features.power_pins(pins, p.selectExpr("*", "array(1, 2) AS inputs", "array(3) AS outputs", f"{none} AS enables", f"{none} AS clocks"))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 20 * 11


def _random_pins(spark):
    draw = random.Random(17)
    rows = [(draw.randrange(40), f"U{draw.randrange(6)}", str(draw.randrange(12))) for _ in range(150)]
    return rows, spark.createDataFrame([(*r, "") for r in rows], "net_id int, component string, pin string, signal string")


def test_links_of_pins_on_one_net_are_not_shuffled_again(spark):
    rows, pins = _random_pins(spark)
    got = nets.pin_connections(pins)
    assert "other_often" in got._jdf.queryExecution().executedPlan().toString()
    want = {(a[1], a[2], b[1], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1:] != b[1:]}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_netlist_of_pins_on_several_nets(spark):
    """No pair of pins is shuffled; labels that look the same are of two pins, and a pin without a named net has no line."""
    pins = [(1, "A", "1", ""), (1, "B", "2", "CLK"), (1, "A-1", "x", ""), (1, "A", "1-x", ""), (1, None, "9", ""), (2, "A", "1", "S"), (2, "B", "2", ""), (3, "C", "10", ""), (None, "C", "10", ""), (4, "D", "1", ""), (4, "C", "10", "")]
    got = nets.netlist_text(spark.createDataFrame(pins, "net_id int, component string, pin string, signal string"), spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "net_id int, name string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum(line.count("Join [") for line in plan.split("\n")) <= 2  # the nets' names only
    rows = {(r.component, r.line_no): r.line for r in got.collect()}
    # an empty signal is the least of a pin's signals
    assert rows.pop((None, 0)) is None and rows.pop((None, 1)) == "  pin 9    [one] -> (no connections)"
    assert rows == {
        ("A", 0): "A:", ("A", 1): "  pin 1    [one] -> A-1-x, A-1-x, B-2", ("A", 2): "  pin 1-x  [one] -> A-1, A-1-x, B-2", ("A-1", 0): "A-1:", ("A-1", 1): "  pin x    [one] -> A-1, A-1-x, B-2",
        ("B", 0): "B:", ("B", 1): "  pin 2    [one] -> A-1, A-1-x, A-1-x", ("C", 0): "C:", ("C", 1): "  pin 10   [three] -> (no connections)",
    }


def test_coarse_match_without_pairs(spark):
    """The same as the greedy choice of all pairs, with ties, equal places and gaps."""
    draw = random.Random(5)
    side = lambda far, least: [(n, i + least, (draw.randrange(40) if n else draw.randrange(6000)) * (0.25 if n else 0.01) + far + (900 if n == 2 and i % 2 else 0)) for n in range(3) for i in draw.sample(range(1000 * n, 1000 * n + 90), 55 + n)]
    f, b = (spark.createDataFrame(rows, "board int, id long, x double") for rows in (side(0, 0), side(70, 5)))
    want = near.greedy_match(alignment.coarse_pairs(f, b, 2.0)).collect()
    got = alignment.coarse_match(f, b, 2.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 80


def test_coarse_match_of_contacts_at_one_place(spark):
    """A million pairs, of which rounds of the greedy choice took one each."""
    side = lambda odd: spark.range(1000).selectExpr("1 AS board", f"id * 2 + {odd} AS id", "id % 2 * 1.0D AS x")
    got = {(r.left_id, r.right_id) for r in alignment.coarse_match(side(0), side(1), 5.0).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(1000)}
