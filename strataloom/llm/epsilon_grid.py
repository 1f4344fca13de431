"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors within an angle lie within a distance, epsilon. They are projected on the leading principal directions;
projections never lengthen a distance, so vectors whose grid cells of side epsilon aren't neighbours, or whose boxes lie
further apart, can't be near. Cells in lexicographic order form the sequence; it is cut into blocks of bounded size, a
cell with more rows into several by hash. Pairs of blocks that may hold near vectors are found by an equi-join on cells;
a task joins the two sequence intervals recursively, skipping halves whose boxes are further apart than epsilon, and
emits link counts and a spanning forest, never the pairs. Pairs of blocks are dealt in tiles of neighbouring blocks, and a
block's vectors go to a tile once, whatever the number of its partners there.

Equal vectors are one class with a multiplicity. Defined results: a vector that is null, empty, zero or has a null or
non-finite component links with nothing; vectors of another length than the most common one are compared among
themselves; rows may repeat and each counts; a null id has no component and is kept.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Vectors in a block; bytes of a tile's side as double precision; vectors of a leaf of the recursion; grid cells at most.
BLOCK = 4096
TILE_BYTES = 32 << 20
LEAF = 256
MOST_CELLS = 4096


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled by their largest part first, so none overflows."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def directions(covariance: np.ndarray, p: int, rounds: int = 60) -> np.ndarray:
    """p orthonormal rows near the leading principal directions, by subspace iteration. Any such rows give right results."""
    d = len(covariance)
    basis = np.random.default_rng(0).normal(size=(p, d))
    for k in range(rounds + 1):
        if k:
            basis = np.einsum("pi,ij->pj", basis, covariance)
        for a in range(p):
            for b in itertools.chain(range(a), range(a)):  # twice, for orthogonality to the last digit
                basis[a] -= (basis[a] * basis[b]).sum() * basis[b]
            size = math.sqrt((basis[a] ** 2).sum())
            basis[a] = basis[a] / size if size > 1e-150 else np.eye(d)[a]
    for a in range(p):
        for b in range(a):
            basis[a] -= (basis[a] * basis[b]).sum() * basis[b]
        basis[a] /= math.sqrt((basis[a] ** 2).sum())
    return basis


def _kind(vectors: DataFrame) -> str:
    """How components are held: as single precision if they are that, else as double."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def _classes(vectors: DataFrame, kind: str) -> DataFrame:
    """(id, key, dim, vec): vec holds the components as `kind`, null if the vector links with nothing; durable."""
    size = int(kind[2:])
    fine = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(embedding, x -> x <> 0)")

    def pack(batches):
        for batch in batches:
            lists, ok = batch.column(1), np.asarray(batch.column(2))
            raw = [np.asarray(x.values, dtype=kind).tobytes() if good else None for x, good in zip(lists, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // size if x else None for x in raw], pa.int32()), pa.array(raw, pa.binary())], ["id", "dim", "vec"])

    rows = vectors.select("id", F.col("embedding").cast("array<float>" if size == 4 else "array<double>").alias("embedding"), F.coalesce(fine, F.lit(False)).alias("ok"))
    return common.durable(rows.mapInArrow(common.trimmed(pack), "id bigint, dim int, vec binary").withColumn("key", F.sha2("vec", 256)))


def _covariance(classes: DataFrame, dim: int, kind: str) -> np.ndarray:
    """Second moments of the unit vectors; dim * dim sums come to the driver."""

    def sums(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = unit(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(-1, dim))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["i", "x"])

    out = np.zeros(dim * dim)
    for row in classes.select("vec").mapInArrow(common.trimmed(sums), "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[row.i] = row.x
    return out.reshape(dim, dim)


def _leaf_pairs(ya: np.ndarray, yb: np.ndarray, eps: float, same: bool, a0: int = 0, b0: int = 0):
    """Intervals of the two sequences that may hold near vectors, by recursion; of one sequence, only a0 <= b0."""
    if same and b0 + len(yb) <= a0:
        return
    gap = np.maximum(ya.min(axis=0) - yb.max(axis=0), yb.min(axis=0) - ya.max(axis=0))
    if (np.maximum(gap, 0) ** 2).sum() > eps * eps:
        return
    if len(ya) <= LEAF and len(yb) <= LEAF:
        yield a0, a0 + len(ya), b0, b0 + len(yb)
    elif len(ya) >= len(yb):
        h = len(ya) // 2
        yield from _leaf_pairs(ya[:h], yb, eps, same, a0, b0)
        yield from _leaf_pairs(ya[h:], yb, eps, same, a0 + h, b0)
    else:
        h = len(yb) // 2
        yield from _leaf_pairs(ya, yb[:h], eps, same, a0, b0)
        yield from _leaf_pairs(ya, yb[h:], eps, same, a0, b0 + h)


def join_blocks(a: tuple, b: tuple, same: bool, basis: np.ndarray, threshold: float, eps: float):
    """Of blocks (ids, multiplicities, vectors): links of each vector of a and of b, and a forest as pairs of ids."""
    (ids_a, times_a, xa), (ids_b, times_b, xb) = a, b
    na, nb = len(ids_a), len(ids_b)
    ya, yb = np.einsum("ij,pj->ip", xa, basis), np.einsum("ij,pj->ip", xb, basis)
    links_a, links_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    parent = list(range(na + (0 if same else nb)))
    shift = 0 if same else na
    forest = []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    label_stale, label = True, None
    for a0, a1, b0, b1 in _leaf_pairs(ya, yb, eps, same):
        near = xa[a0:a1] @ xb[b0:b1].T >= threshold
        if same:
            near &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if not near.any():
            continue
        links_a[a0:a1] += np.einsum("ij,j->i", near, times_b[b0:b1], dtype=np.int64)
        links_b[b0:b1] += np.einsum("ij,i->j", near, times_a[a0:a1], dtype=np.int64)
        if label_stale:
            label = np.array([root(x) for x in range(len(parent))])
            label_stale = False
        i, j = np.nonzero(near & (label[a0:a1][:, None] != label[shift + b0 : shift + b1][None, :]))
        for x, y in zip((i + a0).tolist(), (j + b0).tolist(), strict=True):
            if (p := root(x)) != (q := root(shift + y)):
                parent[max(p, q)] = min(p, q)
                forest.append((int(ids_a[x]), int(ids_b[y])))
                label_stale = True
    if same:
        links_a += links_b
    return links_a, links_b, forest


def _of_dim(classes: DataFrame, dim: int, threshold: float, kind: str) -> DataFrame:
    """(a, b, n): link counts (a, null, n) and forest links (a, b, null) among classes (rep, times, vec) of one length."""
    spark = classes.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    side = math.floor(2 / eps) + 2
    p = max(1, min(dim, int(math.log(MOST_CELLS) / math.log(side))))
    covariance = _covariance(classes, dim, kind)
    basis = directions(covariance, p)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                y = np.einsum("ij,pj->ip", unit(np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(-1, dim)), basis)
                cell = (np.floor(y / eps).astype(np.int64) + side) @ ((2 * side) ** np.arange(p)[::-1])
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(cell)], ["rep", "times", "vec", "cell"])

    placed = common.durable(classes.select("rep", "times", "vec").mapInArrow(common.trimmed(place), "rep bigint, times bigint, vec binary, cell bigint"))
    plan, block, room = {}, -1, 0  # cell -> first block, blocks; cells are bounded in number
    for row in sorted(placed.groupBy("cell").agg(F.count("*").alias("n")).collect(), key=lambda r: r.cell):
        if row.n > room:
            parts = math.ceil(row.n / BLOCK)
            plan[row.cell] = (block + 1, parts)
            block += parts
            room = BLOCK - row.n if parts == 1 else 0
        else:
            plan[row.cell] = (block, 1)
            room -= row.n
    table = spark.createDataFrame([(int(c), int(b), int(n)) for c, (b, n) in plan.items()], "cell bigint, first bigint, parts bigint")
    dealt = placed.join(F.broadcast(table), "cell").select("rep", "times", "vec", "cell", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"))

    def gather(batches):
        at, held = None, []

        def done():
            ids, times, vecs = zip(*held, strict=True)
            y = np.einsum("ij,pj->ip", unit(np.frombuffer(b"".join(vecs), kind).reshape(-1, dim)), basis)
            low, high = y.min(axis=0), y.max(axis=0)
            data = [[at], [low.tolist()], [high.tolist()], [np.array(ids, "<i8").tobytes()], [np.array(times, "<i8").tobytes()], [b"".join(vecs)]]
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kinds, strict=True)], ["block", "low", "high", "ids", "times", "vecs"])

        for batch in batches:
            for block, *row in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if block != at:
                    if held:
                        yield done()
                    at, held = block, []
                held.append(row)
        if held:
            yield done()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.select("block", "rep", "times", "vec", "cell").repartition(n, "block").sortWithinPartitions("block", "cell", "rep").select("block", "rep", "times", "vec")
    blocks = common.durable(rows.mapInArrow(common.trimmed(gather), "block bigint, low array<double>, high array<double>, ids binary, times binary, vecs binary"))
    # candidate pairs of blocks: an equi-join on cells of the first two projections, then the boxes' distance
    q = min(2, p)
    cells = [f"transform(sequence(cast(floor(low[{k}] / {eps}) as int) - {{0}}, cast(floor(high[{k}] / {eps}) as int) + {{0}}), x{k} -> x{k})" for k in range(q)]
    grid = f"flatten(transform({cells[0]}, a -> transform({cells[1]}, b -> struct(a, b))))" if q == 2 else f"transform({cells[0]}, a -> struct(a, 0 as b))"
    left = blocks.select(F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), F.explode(F.expr(grid.format(0))).alias("cell"))
    right = blocks.select(F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), F.explode(F.expr(grid.format(1))).alias("cell"))
    apart = F.expr("aggregate(zip_with(arrays_zip(low_i, high_i), arrays_zip(low_j, high_j), (x, y) -> pow(greatest(x.low_i - y.high_j, y.low_j - x.high_i, 0D), 2)), 0D, (a, x) -> a + x)")
    pairs = left.join(right, "cell").where("i <= j").where(apart <= eps * eps).select("i", "j").distinct()
    pairs = common.durable(pairs)
    # blocks of a tile's side: within its bytes, and few enough that every task slot has tiles
    side = max(1, min(TILE_BYTES // (8 * BLOCK * dim), math.isqrt(pairs.count() // n)))
    tiled = pairs.select(F.expr(f"i div {side}").alias("ti"), F.expr(f"j div {side}").alias("tj"), "i", "j")
    partners = tiled.groupBy("ti", "tj", F.col("i").alias("block")).agg(F.collect_list("j").alias("partners"))  # a side's blocks at most
    needed = partners.unionByName(tiled.select("ti", "tj", F.col("j").alias("block"), F.array().cast("array<bigint>").alias("partners")).distinct())
    needed = needed.groupBy("ti", "tj", "block").agg(F.sort_array(F.flatten(F.collect_list("partners"))).alias("partners"))
    tasks = needed.join(blocks.select("block", "ids", "times", "vecs"), "block").select("ti", "tj", "block", "partners", "ids", "times", "vecs")

    def joined(tile: dict):
        for i, (a, js) in tile.items():
            for j in js:
                b = tile[j][0]
                links_a, links_b, forest = join_blocks(a, b, i == j, basis, threshold, eps)
                ends = np.array(forest, dtype=np.int64).reshape(-1, 2)
                counts = [(a[0][links_a > 0], links_a[links_a > 0]), *([] if i == j else [(b[0][links_b > 0], links_b[links_b > 0])])]
                first, m = np.concatenate([ends[:, 0], *[c[0] for c in counts]]), len(ends)
                second = pa.array(np.concatenate([ends[:, 1], np.zeros(len(first) - m, np.int64)]), mask=np.arange(len(first)) >= m)
                third = pa.array(np.concatenate([np.zeros(m, np.int64), *[c[1] for c in counts]]), mask=np.arange(len(first)) < m)
                yield pa.RecordBatch.from_arrays([pa.array(first), second, third], ["a", "b", "n"])

    def compare(batches):
        at, tile = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                ti, tj, block, js, ids, times, vecs = (batch.column(c)[k].as_py() for c in range(7))
                if (ti, tj) != at:
                    yield from joined(tile)
                    at, tile = (ti, tj), {}
                tile[block] = ((np.frombuffer(ids, "<i8"), np.frombuffer(times, "<i8"), unit(np.frombuffer(vecs, kind).reshape(-1, dim))), js)
        yield from joined(tile)

    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a row holds a block
    try:
        return common.durable(tasks.repartition(n, "ti", "tj").sortWithinPartitions("ti", "tj", "block").mapInArrow(common.trimmed(compare), "a bigint, b bigint, n bigint"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def near_vectors(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links, component_id) of every row of vectors(id, embedding)."""
    start = common.mark()
    kind = _kind(vectors)
    rows = _classes(vectors, kind)
    classes = common.durable(rows.where("vec is not null and id is not null").groupBy("key", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.first("vec").alias("vec")))
    found = None
    for row in classes.select("dim").distinct().collect():  # lengths of vectors: a schema's few
        part = _of_dim(classes.where(F.col("dim") == row.dim), row.dim, threshold, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    labels = common.components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "rep")
    by_class = classes.select("key", "rep", "times").join(links, "rep", "left").join(labels, "rep", "left")
    by_class = by_class.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    # a vector that many rows repeat is dealt over several tasks
    some, none = rows.where("key is not null").select("id", "key"), rows.where("key is null").select("id", "key")
    out = common.join_each(some, by_class, ["key"], "id", rows.count(), "left", counts=classes.select("key", F.col("times").alias("n"))).unionByName(none, allowMissingColumns=True)
    some = F.col("id").isNotNull()
    out = common.durable(out.select("id", F.when(some, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), F.when(some, F.coalesce("component_id", "id")).alias("component_id")))
    common.drop_scratch(start, keep=(out,))
    return out


def op9_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    out = near_vectors(vectors, 0.9)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
