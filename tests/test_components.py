"""Components of edges that tasks draw together before any shuffle."""

from tracewright.operators import graph, loop
from tracewright.plans import connectivity, inputs


def test_components_of_dense_edges(spark):
    """Tasks draw their own edges together: what is shuffled grows with the nodes, not with the edges."""
    edges = spark.range(0, 300_000, 1, 3).selectExpr("concat('p', id * 37 % 400, '.', id % 3) AS a", "concat('s', id * 53 % 211, '.', id % 3) AS b")
    edges = edges.unionAll(spark.sql("SELECT * FROM VALUES ('x', 'x'), ('y', null), ('é', 'z')"))
    sizes = []

    def kept(df):
        sizes.append((df := loop.settled(df)).count())
        return df

    got = {r.node: r.root for r in graph.components(edges, kept).collect()}
    assert max(sizes) < 5_000
    pairs = [tuple(r) for r in edges.where("b IS NOT NULL").distinct().collect()]
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {n: find(n) for n in root}


def test_components_of_a_path_over_tasks(spark):
    path = spark.range(0, 64, 1, 16).selectExpr("id * 7 % 64 AS a", "(id + 1) * 7 % 64 AS b").where("a <> 0 OR b <> 7")
    assert {(r.node, r.root) for r in graph.components(path).collect()} == {(n, 0) for n in range(64)}


def test_components_of_scattered_edges(spark, monkeypatch):
    """Every task meets nodes of all components: links are drawn together level by level, rounds get the last few."""
    edges = spark.range(0, 40_000, 1, 16).selectExpr("id * 37 % 5003 * 40 + id % 40 AS a", "-(id * 53 % 307 * 40 + id % 40) - 1 AS b")
    edges = edges.unionAll(spark.range(0, 300).selectExpr("1000000 + id", "1000001 + id"))  # and a long path
    want = {r.node: r.root for r in graph.rounds(edges).collect()}
    rounds, seen = graph.rounds, []
    monkeypatch.setattr(graph, "LINKS", 2_000, raising=False)
    monkeypatch.setattr(graph, "rounds", lambda links, *more: seen.append(links.count()) or rounds(links, *more))
    assert {r.node: r.root for r in graph.components(edges, getattr(loop, "stored", loop.settled)).collect()} == want
    assert len(seen) == 1 and seen[0] <= 2_000


def test_nodes_by_number_or_name(spark, tmp_path):
    """Names and numbers give the same; a key that no number holds has the names taken."""
    rows = "(1, 7, DATE'1994-01-02'), (10, 7, DATE'1994-03-02'), (2, 8, DATE'1994-03-02'), (1, 8, DATE'1995-03-02')"
    for name, more, roots in (("a", "", {"s7.1994": "p1.1994", "p10.1994": "p1.1994", "s8.1994": "p2.1994", "s8.1995": "p1.1995"}), ("b", ", (9000000000000000000, 8, DATE'1994-03-02')", {"p9000000000000000000.1994": "p2.1994"})):
        spark.sql(f"SELECT * FROM VALUES {rows}{more} AS t(l_partkey, l_suppkey, l_shipdate)").selectExpr("bigint(l_partkey)", "bigint(l_suppkey)", "l_shipdate").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got = {r.node: r.root for r in connectivity.net_components(spark, f"{tmp_path}/{name}").collect()}
        sizes = {r.root: r.size for r in connectivity.component_sizes(spark, f"{tmp_path}/{name}").collect()}
        assert got.items() >= roots.items() and sizes == {r: sum(v == r for v in got.values()) for r in got.values()}
    assert inputs.numbered_edges(spark, f"{tmp_path}/b") is None
