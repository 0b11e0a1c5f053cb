"""Exact top-k search by inner product, after MaxScore.

A dimension is a term. A vector's impact in it is its part of the score, counted from the least that the shard's vectors
can have; a posting list is a shard's vectors in the order of a component.

1. Vectors near one of some sampled pivots are a shard, split where there are many; a shard knows its least and greatest
   components, which bound any query's score in it.
2. A query is searched in its own shard first. Its k-th best score there is its threshold.
3. A query goes to those shards only whose bound reaches its threshold.
4. In a shard, the terms of the smallest bounds, which together cannot reach the threshold, are non-essential. Of the
   others, the essential ones, postings are read from the best impact down to where a vector that reaches the threshold
   must have appeared in some list; for these vectors the other terms are probed while they stay competitive.
5. The shards' best are merged by query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import stored
from tracewright.llm.graph import looked_up

SCALE = 256
#: Vectors of a shard, and queries searched in it at a time, about; pivots, at most, a sample by a hash of the row's number.
SHARD, CELL_QUERIES, PIVOTS = 2_048, 2_048, 256
#: The share of its bound down to which a posting list is read; a vector that must be read further down is simply scored.
DEEP = 0.6
#: Non-essential terms that are probed at a time.
PROBED = 8
#: Vectors, and shards, that a block of queries meets at a time.
CELL_VECTORS, CELL_SHARDS = 16_384, 4_096
#: Vectors with a quantised component from this on up are scored apart, so that the sums of the others stay exact in 64 bits.
LIMIT = 2**25
#: What a null id is called on the way; it is behind all ids.
NO_ID = 2**63 - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, row, q, large) of the vectors that take part: the row's number and floor(256 * x) of each component; a
    null id is NO_ID.

    Where one of them reaches LIMIT, q is null and large holds the components as they are; else large is null.
    """
    each = F.col(f"`{vector_col}`")
    x = F.transform(each, lambda v: F.floor(F.lit(SCALE) * v.cast("double")))
    sane = F.forall(each, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    small = F.forall(each, lambda v: F.abs(F.lit(SCALE) * v.cast("double")) < LIMIT)
    known = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    numbered = vectors.select(known.alias("vec_id"), F.monotonically_increasing_id().alias("row"), each)
    taking_part = numbered.where(each.isNotNull() & sane)
    return taking_part.select("vec_id", "row", F.when(small, x).alias("q"), F.when(~small, each.cast("array<double>")).alias("large"))


def _matrix(rows: list) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), width)
    return np.array([list(r) + [0] * (width - len(r)) for r in rows], np.int64)


def _whole(row: list) -> list[int]:
    """floor(256 * x) of each component, without a bound."""
    return [SCALE * int(x) if abs(x) >= 2**53 else math.floor(SCALE * x) for x in row]


def search_apart(queries: tuple, vectors: tuple, k: int) -> Iterator[tuple[int, int, int, int]]:
    """search_cell for rows of integers of any size: 64 bits where no sum can pass them, else Python's integers."""
    v_ids, v_rows, v = vectors
    if not len(v):
        return
    width = max(len(r) for r in (*queries[2], *v))
    v = np.array([[*r, *[0] * (width - len(r))] for r in v], object)
    most = max(sum(map(abs, r)) for r in v.tolist()) if width else 0
    narrow = v.astype(np.int64) if most < 2**63 else None
    for q_id, q_row, query in zip(*queries, strict=True):
        query = [*query, *[0] * (width - len(query))]
        fits = narrow is not None and most * max(map(abs, query), default=0) < 2**63
        score = (narrow @ np.array(query, np.int64) if fits else v @ np.array(query, object)).tolist() if width else [0] * len(v)
        found = heapq.nsmallest(k, ((-s, i) for s, i, row in zip(score, v_ids, v_rows, strict=True) if row != q_row))
        for s, i in found:
            yield q_id, q_row, i, -s


class Shard:
    """Vectors in the order of their ids, with their bounds and posting lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        self.postings = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.postings, axis=0)

        self.floats, self.largest = self.vectors.astype(float), int(np.abs(self.vectors).max(initial=0))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """All inner products; by floats where they hold every sum exactly."""
        if self.largest * int(np.abs(query).sum()) < 2**53:
            return (self.floats @ query.astype(float)).astype(np.int64)
        return self.vectors @ query

    def _part(self, query: np.ndarray, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What the terms add to the scores of some places."""
        if 8 * len(places) < len(self.ids):
            return self.vectors[np.ix_(places, terms)] @ query[terms]
        masked = np.zeros_like(query)
        masked[terms] = query[terms]
        return self.scores(masked)[places]

    def reaching(self, query: np.ndarray, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The places of the vectors that score threshold or more, all for None, and their scores."""
        every = np.arange(len(self.ids))
        if threshold is None:
            return every, self.scores(query)
        ends = np.stack((query * self.low, query * self.high))
        least, span = ends.min(axis=0), ends.max(axis=0) - ends.min(axis=0)
        need = threshold - int(least.sum())
        if need <= 0:
            scores = self.scores(query)
            return every[scores >= threshold], scores[scores >= threshold]
        terms = np.argsort(span, kind="stable")
        upto = np.cumsum(span[terms])
        if not len(terms) or upto[-1] < need:
            return every[:0], every[:0]
        rest = int(np.searchsorted(upto, need, side="left"))  # so many terms are non-essential
        other, essential = terms[:rest], terms[rest:]
        missing = need - (int(upto[rest - 1]) if rest else 0)
        share = missing / float(span[essential].sum()) * (1 - 1e-9)
        seen = np.full(len(every), share < DEEP)  # so deep, the lists hold nearly all
        for t in essential[::-1]:
            if share < DEEP or not query[t]:
                continue
            # impact >= share * span, as a limit on the component; one more than needed for rounding
            depth = share * float(span[t]) / abs(int(query[t]))
            if query[t] > 0:
                seen[self.postings[np.searchsorted(self.sorted[:, t], self.low[t] + math.floor(depth) - 1, side="left") :, t]] = True
            else:
                seen[self.postings[: np.searchsorted(self.sorted[:, t], self.high[t] - math.floor(depth) + 1, side="right"), t]] = True
        alive = np.flatnonzero(seen)
        score = self._part(query, essential, alive)
        bound = int(least[other].sum()) + int(span[other].sum())  # still to be had from the terms not probed
        for at in range(len(other), 0, -PROBED):  # the largest bounds first
            stay = score + bound >= threshold
            alive, score = alive[stay], score[stay]
            if not len(alive):
                break
            probed = other[max(0, at - PROBED) : at]
            score = score + self._part(query, probed, alive)
            bound -= int(least[probed].sum()) + int(span[probed].sum())
        stay = score >= threshold
        return alive[stay], score[stay]

    def best(self, query: np.ndarray, row: int, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The k best places and scores, ties to the smaller id; the query's own row is none."""
        at, score = self.reaching(query, threshold)
        other = self.rows[at] != row
        at, score = at[other], score[other]
        top = np.lexsort((self.ids[at], -score))[:k]
        return at[top], score[top]


def _sides(t: pa.Table, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = _matrix(t.column("q").to_pylist())
    return t.column("vec_id").to_numpy(), t.column("row").to_numpy(), np.pad(q, ((0, 0), (0, max(0, width - q.shape[1]))))


def top_k(vectors: DataFrame, k: int, queries_every: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by queries_every, the k best other rows.

    Ties go to the smaller id, null last; a row with a null id is a candidate but asks nothing. Vectors that are null or
    hold a null or non-finite component take no part; missing dimensions count as 0. Repeated rows are candidates of their own, and each repeated query row
    has results of its own. A score that 64 bits cannot hold is an error, as in SQL. No rows: no results.
    """
    table = stored(quantised(vectors, id_col, vector_col))
    is_query = (F.col("vec_id") % queries_every == 0) & (F.col("vec_id") != NO_ID)
    n, n_large, width = table.agg(F.count("*"), F.count("large"), F.coalesce(F.max(F.size(F.coalesce("q", "large"))), F.lit(0))).first()
    found = _searched(table.where("q is not null").select("vec_id", "row", "q", is_query.alias("asks")), k, n - n_large, width)
    if n_large:
        found = found.unionByName(_searched_apart(table, is_query, k, n))
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif(F.col("vec_id"), F.lit(NO_ID)).alias("vec_id"), "score")


_FOUND = "query_id long, query_row long, vec_id long, score long"


def _searched(table: DataFrame, k: int, n: int, width: int) -> DataFrame:
    """(query_id, query_row, vec_id, score): for the rows (vec_id, row, q, asks) that ask, at least their k best."""
    sample = table.orderBy(F.xxhash64("row"), "row").limit(int(np.clip(n // SHARD, 1, PIVOTS))).select("q").collect()  # PIVOTS rows at most
    pivots = np.pad(p := _matrix([r.q for r in sample]), ((0, 0), (0, max(0, width - p.shape[1])))).astype(float)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, q = _sides(pa.Table.from_batches([batch]), width)
            pivot = np.argmax(q @ pivots.T - (pivots**2).sum(axis=1) / 2, axis=1) if len(pivots) and len(q) else np.zeros(len(q), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int64())], names=[*batch.schema.names, "pivot"])

    placed = table.mapInArrow(near, "vec_id long, row long, q array<long>, asks boolean, pivot long")
    sizes = {r.pivot: -(-r.n // SHARD) for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    parts = F.element_at(F.create_map(*(F.lit(int(x)) for pair in sizes.items() for x in pair)), F.col("pivot").cast("int")) if sizes else F.lit(1)
    placed = stored(placed.withColumn("shard", F.col("pivot") * 2**32 + F.pmod(F.xxhash64("row"), parts)).drop("pivot"))

    def own(key: tuple, rows: pa.Table) -> pa.Table:
        ids, numbers, q = _sides(rows, width)
        shard = Shard(ids, numbers, q)
        asks = np.flatnonzero(rows.column("asks").to_numpy(zero_copy_only=False))
        hits = [shard.best(q[i], numbers[i], k, None) for i in asks]
        least = [int(s[-1]) if len(s) == k else None for _, s in hits]
        bounds = [pa.array([key[0].as_py()] * (len(asks) + 1), pa.int64()), pa.array([0] + [1] * len(asks), pa.int32())]
        lists = pa.array([shard.low.tolist(), *q[asks].tolist()], pa.list_(pa.int64())), pa.array([shard.high.tolist(), *([None] * len(asks))], pa.list_(pa.int64()))
        ids_, scores = pa.array([None, *(shard.ids[at].tolist() for at, _ in hits)], pa.list_(pa.int64())), pa.array([None, *(s.tolist() for _, s in hits)], pa.list_(pa.int64()))
        return pa.table([*bounds, *lists, pa.array([None, *ids[asks].tolist()], pa.int64()), pa.array([None, *numbers[asks].tolist()], pa.int64()), pa.array([None, *least], pa.int64()), ids_, scores], names=["shard", "kind", "q", "high", "query_id", "query_row", "least", "ids", "scores"])

    first = stored(placed.groupBy("shard").applyInArrow(own, "shard long, kind int, q array<long>, high array<long>, query_id long, query_row long, least long, ids array<long>, scores array<long>"))
    here = first.where("kind = 1").select("query_id", "query_row", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select("query_id", "query_row", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))

    n_shards, n_queries = first.agg(F.count_if(F.col("kind") == 0), F.count_if(F.col("kind") == 1)).first()
    across, down = -(-max(n_shards, 1) // CELL_SHARDS), -(-max(n_queries, 1) // CELL_QUERIES)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asking = first.where("kind = 1").select("shard", "query_id", "query_row", "q", "least", F.pmod(F.xxhash64("query_row"), F.lit(down)).cast("int").alias("down"), every(across).alias("across"))
    bounds = first.where("kind = 0").select("shard", "q", "high", every(down).alias("down"), F.pmod(F.xxhash64("shard"), F.lit(across)).cast("int").alias("across"))

    def route(key: tuple, queries: pa.Table, shards: pa.Table) -> pa.Table:
        names = ["shard", "query_id", "query_row", "q", "least"]
        if not queries.num_rows or not shards.num_rows:
            return queries.slice(0, 0).select(names)
        wide = lambda t, c: np.pad(m := _matrix(t.column(c).to_pylist()), ((0, 0), (0, max(0, width - m.shape[1])))).astype(float)
        q, low, high = wide(queries, "q"), wide(shards, "q"), wide(shards, "high")
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        least = np.array([-np.inf if x is None else float(x) for x in queries.column("least").to_pylist()])[:, None]
        away = queries.column("shard").to_numpy()[:, None] != shards.column("shard").to_numpy()[None, :]
        i, j = np.nonzero((bound * (1 + np.sign(bound) * 1e-9) + 1 >= least) & away)  # floats: a little more than the bound
        return queries.take(pa.array(i)).set_column(0, "shard", shards.column("shard").take(pa.array(j))).select(names)

    routed = stored(asking.groupBy("down", "across").cogroup(bounds.groupBy("down", "across")).applyInArrow(route, "shard long, query_id long, query_row long, q array<long>, least long"))
    blocks = stored(routed.groupBy("shard").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("blocks")))
    left = looked_up(routed, "shard", blocks).withColumn("block", F.pmod(F.xxhash64("query_row"), F.col("blocks")).cast("int"))
    right = looked_up(placed, "shard", blocks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if queries.num_rows and rows.num_rows:
            shard = Shard(*_sides(rows, width))
            q = _matrix(queries.column("q").to_pylist())
            q = np.pad(q, ((0, 0), (0, max(0, width - q.shape[1]))))
            for i, query_id, row, least in zip(range(len(q)), *(queries.column(c).to_pylist() for c in ("query_id", "query_row", "least")), strict=True):
                at, score = shard.best(q[i], row, k, least)
                for c, x in zip(columns, ([query_id] * len(at), [row] * len(at), shard.ids[at].tolist(), score.tolist()), strict=True):
                    c += x
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_row", "vec_id", "score"])

    there = left.select("shard", "block", "query_id", "query_row", "q", "least").groupBy("shard", "block").cogroup(right.select("shard", "block", "vec_id", "row", "q").groupBy("shard", "block")).applyInArrow(search, _FOUND)
    return here.unionByName(there)


def _searched_apart(table: DataFrame, is_query, k: int, n: int) -> DataFrame:
    """The same for pairs of which one has large components, all against all in cells, as only Python's integers hold them."""
    n_queries = table.where(is_query).count()
    across, down = -(-max(n, 1) // CELL_VECTORS), -(-max(n_queries, 1) // CELL_QUERIES)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    spread = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    left = table.where(is_query).select("vec_id", "row", "q", "large", spread(down).alias("down"), every(across).alias("across"))
    right = table.select("vec_id", "row", "q", "large", every(down).alias("down"), spread(across).alias("across"))

    def cell(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        whole = [t.filter(pc.is_valid(t.column("q"))) for t in (a, b)]
        apart = [t.filter(pc.is_valid(t.column("large"))) for t in (a, b)]
        wide = lambda t, large: (t.column("vec_id").to_pylist(), t.column("row").to_pylist(), [_whole(r) for r in t.column("large").to_pylist()] if large else t.column("q").to_pylist())
        q, v = ((wide(t, False), wide(u, True)) for t, u in zip(whole, apart, strict=True))
        found = [hit for x, y in ((q[1], v[0]), (q[0], v[1]), (q[1], v[1])) for hit in search_apart(x, y, k)]
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_row", "vec_id", "score"])

    return left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(cell, _FOUND)


def op5_max_score(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 5, 50)


SQL_OP5 = """
WITH q AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score, a.rid
  FROM q a JOIN q b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
