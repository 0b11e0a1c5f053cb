"""MinHash near-dedup with an LSH forest, confirmed on full sets.

1. Documents with the same set of shingles are one class. Each class gets a signature of HASHES minhashes, a byte each.
2. A tree is an order of the signatures, rotated by MIN_DEPTH positions a tree. Classes that share a tree's first
   MIN_DEPTH values form a region; classes alone in a region leave that tree.
3. A region of up to REGION classes is compared whole. A larger one is read in the order of its tree and cut where its
   neighbours share the least of their prefixes, which is a greater depth there; neighbouring parts share some classes.
   Then its classes outside its largest component so far are compared with all of it, in blocks. Classes whose
   signatures agree on enough positions are provisionally linked; a star is emitted for each linked set, not its pairs.
4. The components of these links are verified on full sets, from the whole texts, in groups of bounded size. A component
   of many blocks is verified by chance blocks first, and what its largest part leaves out then meets all blocks. What
   is confirmed is again emitted as stars.
5. The components of the confirmed links are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import fresh, ragged, slices, stored, with_columns
from tracewright.llm.graph import components, looked_up, merged
from tracewright.operators.lookup import HOT

HASHES, MIN_DEPTH = 128, 4
#: Classes of a region that are compared at a time; classes that neighbouring parts of a larger region share.
REGION, SHARED = 1024, 64
#: Classes, and shingles, of a block of a component, about; a block has one class at least.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Of the classes that a block's verification has linked, one in so many meets those of other blocks.
DRAWN = 8
#: Standard errors by which a signature may fall short of the wanted similarity and still link provisionally.
SLACK = 6.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, all in a row, and how many each has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten().dictionary_encode()
    names = words.dictionary.cast(pa.binary()).to_pylist()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    which = words.indices.to_numpy(zero_copy_only=False)
    real = np.array([bool(n) for n in names], bool)[which] if len(names) else np.zeros(0, bool)
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    bounds = np.concatenate(([0], np.cumsum(real)))[bounds]  # edges of a text split off empty words
    flat = hashed[which[real]] if len(names) else np.zeros(0, np.uint64)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = min(width, b - a)
        key = np.full(b - a - n + 1 if n else 0, n, np.uint64)
        for k in range(n):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + flat[a + k : a + k + len(key)])
        sets.append(np.unique(key))
    return (np.concatenate(sets) if sets else flat), np.array([len(s) for s in sets], np.int64)


def signatures(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(sets, HASHES) bytes of minhashes; an empty set has zeros."""
    out = np.zeros((len(counts), HASHES), np.uint8)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    if len(full):
        for k, factor in enumerate(_FACTORS):
            out[full, k] = (_mix(np.minimum.reduceat(flat * factor, starts)) >> np.uint64(56)).astype(np.uint8)
    return out


def linked(signs: np.ndarray, least: int) -> np.ndarray:
    """The smallest row that each row is linked with, directly or not, by agreeing on at least so many positions."""
    n = len(signs)
    near = np.zeros((n, n), bool)
    for at in range(0, n, 64):
        near[at : at + 64] = (signs[at : at + 64, None, :] == signs[None, :, :]).sum(axis=2) >= least
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _star(nodes: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """(a, b): each node of a group, once, with the group's smallest one, which is often the same in many regions."""
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, group, nodes)
    star = np.unique(np.stack((nodes, least[group]))[:, nodes != least[group]], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(star[0]), pa.array(star[1])], names=["a", "b"])


def _signs(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint8).reshape(-1, HASHES)


def members(table: DataFrame) -> DataFrame:
    """(region, node, wide) of the classes (node, sign) that share a region of a tree with others.

    A region is wide if it has more than REGION classes, or may go on in another task. The low bits of a region name
    its tree.
    """
    trees = HASHES // MIN_DEPTH
    powers = _mix(np.arange(1, HASHES + 1, dtype=np.uint64)).reshape(trees, MIN_DEPTH)
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["region", "node", "wide"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _signs(batch).reshape(-1, trees, MIN_DEPTH).astype(np.uint64)
            keys = _mix((signs * powers).sum(axis=2, dtype=np.uint64) + np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys = (keys & ~np.uint64(31)) | np.arange(trees, dtype=np.uint64)
            node = np.repeat(batch.column("node").to_numpy(), trees)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(node)], names=names[:2])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = node = np.zeros(0, np.int64)  # the last run so far
        first = open_ = None  # the task's first region, and the wide one that was passed on last
        for batch in batches:
            region, node = (np.concatenate((x, batch.column(c).to_numpy())) for x, c in ((region, "region"), (node, "node")))
            if not len(region):
                continue
            first = region[0] if first is None else first
            starts = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
            sizes = np.diff(np.append(starts, len(region)))
            wide = (sizes > REGION) | (region[starts] == first) | (region[starts] == open_)
            done = wide | (sizes > 1)
            done[-1] = wide[-1]
            rows = np.repeat(done, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(region[rows]), pa.array(node[rows]), pa.array(np.repeat(wide, sizes)[rows])], names=names)
            open_ = region[-1] if wide[-1] else open_
            last = len(region) if wide[-1] else starts[-1]
            region, node = region[last:], node[last:]
        if len(region):
            yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(node), pa.array(np.ones(len(region), bool))], names=names)

    keyed = table.mapInArrow(prefixes, "region long, node long").repartitionByRange(parts, "region", "node").sortWithinPartitions("region", "node")
    return stored(keyed.mapInArrow(shared, "region long, node long, wide boolean"))


def provisional_components(table: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of classes (node, sign) that are linked provisionally, by the regions that they share.

    Every two classes of one region whose signatures agree on enough positions are of one component.
    Regions that are not wide are compared whole. A wide one is read in the order of its tree and compared in windows,
    which overlap; then its classes outside its largest component so far are compared with all its classes, in blocks.
    """
    least = int(np.floor(HASHES * (similarity - SLACK * np.sqrt(similarity * (1 - similarity) / HASHES))))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row, link = "region long, node long, sign binary", "a long, b long"

    def links(nodes: list[int], signs: list[bytes]) -> pa.RecordBatch:
        found = linked(np.frombuffer(b"".join(signs), np.uint8).reshape(-1, HASHES), least)
        return _star(np.array(nodes, np.int64), found)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, shift = _signs(batch), (batch.column("region").to_numpy() & 31) * MIN_DEPTH
            turned = signs[np.arange(len(signs))[:, None], (np.arange(HASHES)[None, :] + shift[:, None]) % HASHES]
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("node"), pa.array([r.tobytes() for r in turned], pa.binary())], names=["region", "node", "sign"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        nodes: list[int] = []
        signs: list[bytes] = []
        for batch in batches:
            for region, node, sign in zip(*(batch.column(c).to_pylist() for c in ("region", "node", "sign")), strict=True):
                if region != now:
                    if len(nodes) > 1:
                        yield links(nodes, signs)
                    now, nodes, signs = region, [], []
                elif len(nodes) == REGION:  # wide: cut where neighbours share the least of their prefixes
                    depth = [next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), HASHES) for a, b in zip(signs[REGION // 2 :], signs[REGION // 2 + 1 :], strict=False)]
                    cut = REGION // 2 + 1 + int(np.argmin(depth))
                    yield links(nodes[:cut], signs[:cut])
                    nodes, signs = nodes[cut - SHARED :], signs[cut - SHARED :]
                nodes.append(node)
                signs.append(sign)
        if len(nodes) > 1:
            yield links(nodes, signs)

    def compare_blocks(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([links(rows.column("part").to_pylist(), rows.column("sign").to_pylist())])

    whole = shared.where("not wide").select("region", "node").join(table, "node").select("region", "node", "sign").repartition(parts, "region").sortWithinPartitions("region", "node")
    wide = shared.where("wide").select("region", "node")
    found = whole.mapInArrow(compare, link)
    if wide.isEmpty():
        return components(found)
    turned = stored(wide.join(table, "node").select("region", "node", "sign").mapInArrow(rotate, row))
    found = stored(found.unionAll(turned.repartitionByRange(parts, "region", "sign").sortWithinPartitions("region", "sign").mapInArrow(compare, link)))
    label = components(found)
    parted = wide.join(label.withColumnRenamed("root", "part"), "node", "left").select(F.col("region").alias("root"), "node", F.coalesce("part", "node").alias("part"), F.lit(1).alias("size"))
    met = dealt(stored(parted), REGION // 2, REGION // 2).join(table, "node").select("root", "i", "j", "part", "sign")
    more = stored(met.groupBy("root", "i", "j").applyInArrow(compare_blocks, link))
    return label if more.isEmpty() else merged(label, more)


def dealt(rows: DataFrame, most: int, most_size: int) -> DataFrame:
    """(root, i, j, node, part): the groups in which the nodes of a root meet, for rows (root, node, part, size).

    Nodes of one part are linked already. The nodes of a root's largest part, and the others, are dealt into blocks of at
    most about so many nodes and so much size, one node at least. A group is two blocks, not both of the largest part; so
    every two nodes of different parts meet in some group, and a root of one part has no group.
    """
    of_part = rows.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = of_part.groupBy("root").agg(F.max(F.struct("n", (-F.col("part")).alias("part"), "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > main.n")
    needed = lambda n, size: F.ceil(F.greatest(n / most, size / most_size)).cast("int")
    plan = largest.select("root", (-F.col("main.part")).alias("main"), needed(F.col("main.n"), F.col("main.size")).alias("main_blocks"), needed(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("blocks"))
    placed = looked_up(rows, "root", stored(plan))
    is_main = F.col("part") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int") + F.when(is_main, F.col("blocks")).otherwise(0)
    others = F.sequence(F.lit(0), F.when(is_main, F.col("blocks") - 1).otherwise(F.col("blocks") + F.col("main_blocks") - 1))
    placed = placed.select("root", "node", "part", own.alias("own"), others.alias("others"))
    pairs = F.filter("others", lambda j: j != F.col("own"))
    meet = F.transform(pairs, lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j")))
    return placed.select("root", "node", "part", F.explode(meet).alias("pair")).select("root", "pair.i", "pair.j", "node", "part")


def confirmed(flat: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The smallest set that each set is linked with, directly or not, by 100 * intersection >= percent * union."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate(([True], flat[order][1:] != flat[order][:-1])) if len(flat) else np.zeros(0, bool)
    which = np.empty(len(flat), np.int64)
    which[order] = np.cumsum(new) - 1
    owners, first = owner[order], np.flatnonzero(new)
    degree = np.diff(np.append(first, len(flat)))
    starts = np.cumsum(counts) - counts
    label = np.arange(n)

    def top(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return int(i)

    for i in range(n):
        own = which[starts[i] : starts[i] + counts[i]]
        own = own[degree[own] > 1]
        common = np.bincount(ragged(owners, first[own], degree[own]), minlength=n)
        for j in np.flatnonzero((100 * common >= percent * (counts[i] + counts - common)) & (np.arange(n) < i) & (common > 0)):
            a, b = top(i), top(int(j))
            label[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)])


def confirmed_components(rough: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) by confirmed links, for classes (root, node, size, text) of the components of provisional links.

    Every two texts that are linked are of one component of the result. A component of one block is
    verified whole. A larger one is dealt into blocks by chance, which are verified; then again those that lead a set of
    their block and one in DRAWN of the others, as long as that leaves few. What the largest part of the component then
    leaves out meets all blocks.
    """

    def confirm(key: tuple, rows: pa.Table) -> pa.Table:
        flat, counts = shingle_sets(rows.column("text").combine_chunks(), width)
        return pa.Table.from_batches([_star(rows.column("part").to_numpy(), confirmed(flat, counts, percent))])

    texts = rough.select("node", "text")
    verified = lambda groups: stored(groups.join(texts, "node").groupBy("root", "i", "j").applyInArrow(confirm, "a long, b long"))
    needed = F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)
    level, n, links, turn = rough.select("root", "node", "size"), rough.count(), [], 0
    large = None
    while True:
        blocks = stored(level.groupBy("root").agg(F.ceil(needed).cast("int").alias("blocks")))
        block = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")).cast("int")
        at = looked_up(level, "root", blocks)
        links.append(verified(at.select("root", block.alias("i"), block.alias("j"), "node", F.col("node").alias("part"))))
        at = stored(at.where("blocks > 1").select("root", "node", "size"))
        large = at if large is None else large
        led = at.join(links[-1].select(F.col("a").alias("node")).distinct().withColumn("led", F.lit(True)), "node", "left")
        level = stored(led.where(F.col("led").isNull() | (F.pmod(F.xxhash64("node", F.lit(-1 - turn)), F.lit(DRAWN)) == 0)).select("root", "node", "size"))
        before, n, turn = n, level.count(), turn + 1
        if not n or 2 * n > before:
            break
    every = links[0]
    for more in links[1:]:
        every = every.unionAll(more)
    label = components(every)
    if large.isEmpty():
        return label
    parted = large.join(label.withColumnRenamed("root", "part"), "node", "left").select("root", "node", F.coalesce("part", "node").alias("part"), "size")
    more = verified(dealt(stored(parted), BLOCK, BLOCK_SHINGLES))
    return label if more.isEmpty() else merged(label, more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with n_shingles (long), component_id (the id's type), kept and is_first (boolean) added.

    A shingle is width words, A-Z lower-cased, split at ASCII white space; a text with fewer words is one shingle; one
    without words, or null, has none and is linked with nothing. Texts with 100 * intersection >= percent * union are
    linked; component_id is the smallest id reachable (null only where all ids are null), kept tells whether the row
    has it (false for a null id), and is_first is true for exactly one row of a component, also among repeated rows.
    Input columns named like an added one give way to it. No rows: no rows.
    """
    names = {"n_shingles", "component_id", "kept", "is_first"}
    others = [c for c in docs.columns if c.lower() not in names]
    row, key, sign, size = (fresh([*others, *names], f"near_{x}") for x in ("row", "key", "sign", "size"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            flat, counts = shingle_sets(batch.column(text_col), width)
            ends, own = np.cumsum(counts), batch.column(row).to_pylist()
            # an empty set is of no class: its key is the row's own
            keys = [hashlib.blake2b(flat[e - n : e].tobytes(), digest_size=16).digest() if n else o.to_bytes(8, "big") for e, n, o in zip(ends, counts, own, strict=True)]
            signs = [s.tobytes() for s in signatures(flat, counts)]
            yield with_columns(batch, {size: pa.array(counts, pa.int64()), key: pa.array(keys, pa.binary()), sign: pa.array(signs, pa.binary())})

    source = docs.select(*(F.col(f"`{c}`") for c in others), F.monotonically_increasing_id().alias(row))
    described = stored(source.mapInArrow(describe, T.StructType([*source.schema.fields, T.StructField(size, T.LongType()), T.StructField(key, T.BinaryType()), T.StructField(sign, T.BinaryType())])))
    own_id = F.col(f"`{id_col}`")
    first = F.struct(own_id.isNull().alias("none"), own_id.alias("id"), F.col(row).alias("row"))
    classes = stored(described.where(F.col(size) > 0).groupBy(key).agg(F.min(row).alias("node"), F.min(first).alias("first"), F.first(sign).alias("sign"), F.count("*").alias("copies")))
    table = classes.select("node", "sign")
    rough = provisional_components(table, members(table), percent / 100)
    texts = described.select(F.col(row).alias("node"), F.col(size).alias("size"), F.col(f"`{text_col}`").alias("text"))
    final = confirmed_components(stored(rough.join(texts, "node")), width, percent)
    best = stored(final.join(classes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("best")))
    of_node = looked_up(final, "root", best).select("node", "best")
    of_class = classes.join(of_node, "node", "left").where(F.col("best").isNotNull() | (F.col("copies") > 1))
    of_class = stored(of_class.select(key, F.coalesce("best", "first").alias("best"), "copies"))
    hot = of_class.where(F.col("copies") > described.count() / HOT).select(key)
    result = looked_up(described.drop(sign).withColumnRenamed(size, "n_shingles"), key, of_class.drop("copies"), "left", hot)
    result = result.withColumn("component_id", F.when(F.col("best").isNotNull(), F.col("best.id")).otherwise(own_id))
    result = result.withColumn("kept", F.coalesce(own_id == F.col("component_id"), F.lit(False)))
    result = result.withColumn("is_first", F.coalesce(F.col(row) == F.col("best.row"), F.lit(True)))
    return result.select(*(F.col(f"`{c}`") for c in others), "n_shingles", "component_id", "kept", "is_first")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id", "kept")


SQL_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS k FROM s),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_
  FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * both_ >= 80 * (na + nb - both_)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM s UNION SELECT r.node, d.b FROM r JOIN d ON d.a = r.other),
m AS (SELECT node, min(other) AS root FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, root AS component_id, s.doc_id = root AS kept FROM s JOIN m ON m.node = s.doc_id
"""
