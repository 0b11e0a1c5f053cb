"""Components, layering and spanning trees over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.lookup import Keep, hot_keys, looked_up
from tracewright.operators.loop import dealt, settled, spread, tasks_for

#: Edges that a task holds before it draws them together.
HELD = 1_000_000
#: Links up to which rounds take over.
LINKS = 1_000_000


def _drawn_together(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Edges that connect what a to b connect: each node to the least that it reaches by these, itself included."""
    nodes = pa.chunked_array([a, b]).dictionary_encode().combine_chunks()
    order = pc.sort_indices(nodes.dictionary)
    names, place = nodes.dictionary.take(order), np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    codes = place[nodes.indices.to_numpy(zero_copy_only=False)]
    left, right, label = codes[: len(a)], codes[len(a) :], np.arange(len(names))
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return names, names.take(pa.array(label))


def _within_tasks(edges: DataFrame) -> DataFrame:
    """Edges that connect what edges (a, b) connect: a row for each node of a task, to the least that it reaches there (or in
    a part of the task's edges, where the nodes are many). One scan, no shuffle."""
    held = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        for batch in batches:
            kept.append((batch.column(0), batch.column(1)))
            if sum(len(a) for a, _ in kept) < held:
                continue
            kept = [_drawn_together(*(pa.concat_arrays([k[i] for k in kept]) for i in (0, 1)))]
            if len(kept[0][0]) > held // 2:
                yield pa.RecordBatch.from_arrays(list(kept.pop()), names=["a", "b"])
        if kept:
            yield pa.RecordBatch.from_arrays(list(_drawn_together(*(pa.concat_arrays([k[i] for k in kept]) for i in (0, 1)))), names=["a", "b"])

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, keep: Keep = settled) -> DataFrame:
    """(node, root) for edges (a, b): root is the smallest node reachable. A null end is no edge.

    Each task first draws its own edges together, so that a node is shuffled once a task that meets it; the roots of one
    node in several tasks are then linked. While these links are many, tasks draw them together in turn, dealt by their
    roots; the last few go through rounds. keep cuts the lineage of a level or a round.
    """
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    if not all(f.dataType.typeName() in ("string", "long", "integer") for f in known.schema):
        return rounds(known, keep)
    return keep(_levels(_within_tasks(known), known.count(), keep))


def _levels(stars: DataFrame, rows: int, keep: Keep) -> DataFrame:
    """components() of stars (a, b): nodes and what they reach in some task, of that many links."""
    tops = dealt(stars, tasks_for(stars, rows), "a").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"), F.collect_set("b").alias("roots"))
    row = lambda node, link: F.struct(node.alias("node"), F.col("root"), F.lit(link).alias("link"))
    others = F.filter("roots", lambda r: r != F.col("root"))
    told = keep(tops.select(F.explode(F.concat(F.array(row(F.col("node"), False)), F.transform(others, lambda r: row(r, True)))).alias("t")).select("t.*"))
    labels, links = told.where("NOT link").select("node", "root"), told.where("link").select(F.col("node").alias("a"), F.col("root").alias("b"))
    left = links.count()
    # links become fewer by a level, as each node but the least of a star leaves
    few = left <= LINKS or left >= rows
    lower = rounds(links.distinct(), keep) if few else keep(_levels(_within_tasks(links.repartition(tasks_for(links, left), "b")), left, keep))
    lower = lower.select(F.col("node").alias("root"), F.col("root").alias("top")).where("root <> top")
    return looked_up(labels, "root", lower, "left", keep=keep).select("node", F.coalesce("top", "root").alias("root"))


def rounds(edges: DataFrame, keep: Keep = settled) -> DataFrame:
    """What components() gives, by rounds over all edges; for few edges, and for those that tasks can't draw together.

    Each round passes the smallest label on along the edges, pre-aggregated by node, and then has each label replaced by
    its own label; only labels that change are looked up, and hot nodes meet a broadcast copy. Rounds grow with the
    logarithm of a component's diameter.
    """
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = keep(known.unionAll(known.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    hot = hot_keys(both, "a", keep)
    while True:
        near = looked_up(both, "a", labels.withColumnRenamed("node", "a"), hot=hot, keep=keep).groupBy("b").agg(F.min("root").alias("near"))
        lower = keep(labels.join(near, labels["node"] == near["b"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("before")))
        if lower.where("root <> before").isEmpty():
            return labels
        tops = lower.select(F.col("node").alias("root"), F.col("root").alias("top")).where("root <> top")
        moves = keep(tops.join(lower.select("root").distinct(), "root", "left_semi"))
        labels = keep(looked_up(lower.select("node", "root"), "root", moves, "left", keep=keep).select("node", F.coalesce("top", "root").alias("root")))


def merged(labels: DataFrame, links: DataFrame, keep: Keep = settled) -> DataFrame:
    """Components (node, root) after links (a, b) between their roots, or nodes that are alone, have been added."""
    tops = rounds(links, keep)
    alone = tops.join(labels, "node", "left_anti").select("node", F.col("node").alias("root"))
    tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return keep(looked_up(labels.unionByName(alone), "root", tops, "left", keep=keep).select("node", F.coalesce("top", "root").alias("root")))


def visits(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, layer) for edges (a, b) by longest path: sources 0, else one more than the highest parent; null for nodes
    on or behind cycles, which no order reaches. nodes (node) may hold some without edges.

    There is a round for each layer; a node counts the parents that it still waits for, so a round reads the edges of
    the last layer only.
    """
    edges = settled(edges.select("a", "b").distinct())
    named = edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node")))
    named = (named if nodes is None else named.unionAll(nodes.select("node"))).distinct()
    waits = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("waits"))
    state = settled(named.join(waits, "node", "left").select("node", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(None).cast("int").alias("layer")))
    turn = 0
    while True:
        ready = (F.col("waits") == 0) & F.col("layer").isNull()
        state = state.select("node", "waits", F.when(ready, turn).otherwise(F.col("layer")).alias("layer"))
        last = state.where(F.col("layer") == turn).select(F.col("node").alias("a"))
        met = edges.join(last, "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("met"))
        state = settled(state.join(met, "node", "left").select("node", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits"), "layer"))
        turn += 1
        if state.where(ready).isEmpty():
            return state.select("node", "layer")


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer), see visits(); nodes on or behind cycles get 1."""
    return visits(edges).select("node", F.coalesce("layer", F.lit(1)).alias("layer"))


def spanning_trees(points: DataFrame, group: str = "net_id") -> DataFrame:
    """(group, a, b, length): the Manhattan spanning tree of each group's points (id, x, y); ties by ids.

    Points at one place join its least id at length 0, which takes a shuffle; only places reach the task that makes a
    group's tree. A net's places must fit a task, whose time is quadratic in them. A missing number is a place of its
    own, infinitely far from all others.
    """

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, x, y = pdf["id"].to_numpy(), pdf["x"].to_numpy(dtype=np.float64), pdf["y"].to_numpy(dtype=np.float64)
        # what is still outside, in the order of the ids: place, distance to the tree, the place that it is reached from
        left = np.arange(1, len(ids))
        length, near, node, rows = np.full(len(left), np.inf), np.zeros(len(left), np.int64), 0, []
        while len(left):
            d = np.nan_to_num(np.abs(x[left] - x[node]) + np.abs(y[left] - y[node]), nan=np.inf)
            better = (d < length) | ((d == length) & (node < near))
            length, near = np.where(better, d, length), np.where(better, node, near)
            tied = np.flatnonzero(length == length.min())
            at = tied[near[tied].argmin()]
            node, source = int(left[at]), int(near[at])
            rows.append((min(node, source), max(node, source), float(length[at])))
            left, length, near = np.delete(left, at), np.delete(length, at), np.delete(near, at)
        a, b = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        return pd.DataFrame({group: pdf[group].to_numpy()[: len(rows)], "a": ids[a], "b": ids[b], "length": np.array([r[2] for r in rows], np.float64)})

    kind, node = dict(points.dtypes)[group], dict(points.dtypes)["id"]
    apart = points.groupBy(group, "x", "y").agg(F.min("id").alias("id"))
    ways = spread(apart, group).groupBy(group).applyInPandas(tree, f"{group} {kind}, a {node}, b {node}, length double")
    w = W.partitionBy(group, "x", "y").orderBy("id")
    same = points.select(group, F.first("id").over(w).alias("a"), F.col("id").alias("b"), F.lag("id").over(w).alias("before")).where("b <> before")
    same = same.select(group, "a", "b", F.lit(0.0).alias("length"))
    return ways.unionByName(same)
