"""Near-duplicate texts by HyperMinHash.

A text's shingle hashes fall into buckets; a bucket's register keeps the leading-zero count of its least remainder and
the mantissa bits that follow, two bytes in all; for an empty bucket it is the set's least hash by a function of that
register. Bands of registers find the candidates, the Jaccard similarity that is estimated from equal registers, corrected
for chance collisions, decides which are verified, and the full shingle sets decide which are links.

Texts with equal shingle sets are one class from the start. Each class is first held against the least class of each of
its bands: the links found join most copies. Where a band still holds classes that no link joins, all classes of what
it connects are dealt into blocks by size of set and hash, and a task compares two blocks; classes that are already joined
are not compared, and the largest joined group of each cluster never meets itself. So a group of copies costs work in
proportion to its rows, no task holds more than two blocks, which are bounded in rows and bytes, no pair is a row, and
only the links of a spanning forest leave a task. Sizes further apart than the threshold allows never meet. Texts have to
share all registers of some band: at the threshold they do but for `MISS` of the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import U64, Words, mix

#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
MOST_REGISTERS = 192
MANTISSA = 10
#: Classes in a block and bytes of their sets, a larger set being a block of its own.
BLOCK, BLOCK_BYTES = 400, 16 << 20
#: Standard deviations below the threshold at which an estimate rules a pair out: 1e-9 of the pairs at the threshold.
#: Sets of up to SMALL shingles are always verified.
SIGMAS, SMALL = 6.0, 64
#: Shingles that are hashed at a time for the registers of empty buckets.
ROWS = 1024


def tune_bands(threshold: float, miss: float = MISS, most: int = MOST_REGISTERS) -> tuple[int, int]:
    """(rows, bands): the most selective banding that misses at most `miss` at the threshold within `most` registers."""
    best = (1, math.ceil(math.log(miss) / math.log(1 - threshold)))
    for rows in range(2, 20):
        bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
        if rows * bands <= most:
            best = rows, bands
    return best


def sketch(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Registers (texts by k, 16 bits) of shingle sets; those of an empty set are all 65535.

    A register whose bucket is empty holds the least of the set under a hash of its own. So two sets agree in a register
    that the bucket of either fills, and in one that neither does, with the chance of their similarity, whatever their sizes.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), k), 65535, dtype=np.uint16)
    if not n.sum():
        return out
    owner = np.repeat(np.arange(len(sets)), n)
    with np.errstate(over="ignore"):
        h = np.concatenate(sets)
        bucket = ((mix(h ^ U64(0x5851F42D4C957F2D)) >> U64(32)) * U64(k) >> U64(32)).astype(np.int64)
        rest = mix(h + U64(0x14057B7EF767814F))
    top = np.iinfo(np.uint64).max
    least = np.full(len(sets) * k, top, dtype=U64)
    np.minimum.at(least, owner * k + bucket, rest)
    least = least.reshape(len(sets), k)
    at = np.concatenate([[0], np.cumsum(n)])
    seeds = mix(np.arange(1, k + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    for r in np.flatnonzero((least == top).any(axis=1) & (n > 0)):
        col = np.flatnonzero(least[r] == top)
        for c in range(at[r], at[r + 1], ROWS):
            with np.errstate(over="ignore"):
                least[r, col] = np.minimum(least[r, col], mix(rest[c : min(c + ROWS, at[r + 1]), None] ^ seeds[col]).min(axis=0))
    bits = (least >> U64(11)).astype(np.int64)
    width = np.frexp(bits.astype(float))[1].astype(np.int64)  # exact: 53 bits
    mantissa = (bits >> np.maximum(width - 1 - MANTISSA, 0)) & ((1 << MANTISSA) - 1)
    out[n > 0] = ((53 - width) << MANTISSA | mantissa).astype(np.uint16)[n > 0]
    return out


def band_keys(registers: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A hash for each text and band; the band is part of it."""
    cut = registers[:, : rows * bands].reshape(len(registers), bands, rows).astype(U64)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), cut.shape[:2]).copy()
        for r in range(rows):
            acc = mix(acc * U64(0xD6E8FEB86659FD93) + cut[:, :, r])
    return acc.view(np.int64)


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that the registers of disjoint sets of these sizes agree (Yu and Weber, HyperMinHash)."""
    big, small = np.maximum(n, m).astype(float), np.maximum(np.minimum(n, m), 1).astype(float)
    ratio = big / small
    return 0.169919487159739093975315012348 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2


def estimate(equal: np.ndarray, k: int, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    chance = collision_rate(n, m)
    return (equal / k - chance) / (1 - chance)


class Source:
    """Texts to compare: docs(id, text), or with `cut` the units that it makes of runs of docs' rows, text last.

    cut(batch) gives the units' key columns, of this schema, and their texts.
    """

    def __init__(self, docs: DataFrame, schema: str = "id bigint", cut=None):
        self.docs, self.schema, self.cut = docs, schema, cut or (lambda batch: (batch.columns[:1], common.text_column(batch.column(1))))
        self.names = [part.split()[0] for part in schema.split(",")]

    def made(self, docs: DataFrame, size: int, schema: str, extra) -> DataFrame:
        """Key columns, set size, a 128-bit digest of the set and extra(sets) of every text."""
        common.small_batches(docs.sparkSession)
        names, cut, last = self.names, self.cut, docs.columns.index("text")

        def run(batches):
            for batch in batches:
                batch = batch.set_column(last, "text", common.text_column(batch.column(last)))
                for a, b in common.chunks(batch.column(last)):
                    keys, parts = cut(batch.slice(a, b - a))
                    sets = Words(parts, lower=True).shingles(size)
                    n = np.array([len(s) for s in sets], dtype=np.int64)
                    with np.errstate(over="ignore"):
                        fp = [np.array([mix(s ^ U64(seed)).sum(dtype=U64) for s in sets], dtype=U64).view(np.int64) for seed in (0x2545F4914F6CDD1D, 0x6C62272E07BB0142)]
                    more = extra(sets, n)
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(n), *map(pa.array, fp), *more.values()], [*names, "n_shingles", "fp_a", "fp_b", *more])

        return docs.mapInArrow(common.trimmed(run), f"{self.schema}, n_shingles bigint, fp_a bigint, fp_b bigint, {schema}")

    def sketches(self, size: int, rows: int, bands: int) -> DataFrame:
        """... and bands array: the band keys, none for an empty set."""

        def extra(sets, n):
            flat = pa.array(band_keys(sketch(sets, rows * bands), rows, bands)[n > 0].ravel())
            return {"bands": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)), flat)}

        return self.made(self.docs, size, "bands array<bigint>", extra)

    def sets(self, docs: DataFrame, size: int, k: int) -> DataFrame:
        """... and registers and shingles, as bytes."""

        def extra(sets, n):
            registers = sketch(sets, k)
            return {"registers": pa.array([r.tobytes() for r in registers], pa.binary()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())}

        return self.made(docs, size, "registers binary, shingles binary", extra)


def _forest(ids: np.ndarray, label: np.ndarray, registers: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int):
    """Links of a spanning forest among the pairs of different sides (or of all, when there is one side) and labels."""
    n, k = np.array([len(s) for s in sets], dtype=np.int64), registers.shape[1]
    t = num / den
    _, group = np.unique(label, return_inverse=True)
    parent = list(range(int(group.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
    one = side.max() == 0
    found = []
    for i in left:
        js = right[right > i] if one else right
        js = js[(group[js] != group[i]) & (n[js] * den >= n[i] * num) & (n[i] * den >= n[js] * num)]
        if not len(js):
            continue
        likely = estimate((registers[js] == registers[i]).sum(axis=1), k, n[js], n[i])
        js = js[(n[js] <= SMALL) | (likely >= t - SIGMAS * np.sqrt(t * (1 - t) / np.minimum(k, n[js])))]
        for j in js:
            if root(group[i]) == root(group[j]):
                continue
            common_ones = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * common_ones >= num * (len(sets[i]) + len(sets[j]) - common_ones):
                parent[root(group[j])] = root(group[i])
                found.append((int(ids[i]), int(ids[j])))
    return found


def _compare(tasks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst): links that tasks(task, side, node, label) find among their nodes. sets(node, registers, shingles)."""
    spark = tasks.sparkSession

    def run(batches):
        def done(left, right):
            held = left + right
            ids, label = (np.array([x[c] for x in held]) for c in (0, 1))
            side = np.repeat([0, 1], [len(left), len(right)])
            registers = np.stack([np.frombuffer(x[2], np.uint16) for x in held])
            found = _forest(ids, label, registers, [np.frombuffer(x[3], U64) for x in held], side, num, den)
            return [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["src", "dst"])] if found else []

        at, left, right, size, met = None, [], [], 0, False
        for batch in batches:
            for task, side, *row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if task != at:
                    yield from done(left, right) if left and (right or not met) else []
                    at, left, right, size, met = task, [], [], 0, False
                if not side:
                    left.append(row)
                    continue
                right.append(row)
                met, size = True, size + len(row[3])
                if size > BLOCK_BYTES:  # only pairs with the left side count, so these can go
                    yield from done(left, right) if left else []
                    right, size = [], 0
        yield from done(left, right) if left and (right or not met) else []

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common.small_batches(spark)
    tasks = common.durable(tasks)
    rows = common.join_each(tasks, sets, ["node"], "task", tasks.count()).select("task", "side", "node", "label", "registers", "shingles")
    return common.durable(rows.repartition(n, "task").sortWithinPartitions("task", "side", "node").mapInArrow(common.trimmed(run), "src bigint, dst bigint"))


def _lead_tasks(near: DataFrame, total: int) -> DataFrame:
    """Tasks that hold each node of near(src, dst) against its src, BLOCK nodes at a time."""
    count = near.groupBy("src").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = common.join_each(near, count, ["src"], "dst", total)
    task = lambda part: F.xxhash64("src", part).alias("task")
    right = dealt.select(task(F.pmod(F.xxhash64("dst"), "parts").cast("int")), F.lit(1).alias("side"), F.col("dst").alias("node"), F.col("dst").alias("label"))
    left = count.select("src", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(task(F.col("part")), F.lit(0).alias("side"), F.col("src").alias("node"), F.col("src").alias("label"))
    return right.unionByName(left)


def _block_tasks(member: DataFrame, num: int, den: int) -> DataFrame:
    """Tasks that compare the members (node, label, n_shingles, cluster) of each cluster that differ in label.

    A cluster's largest label is pool 0, the others are pool 1; blocks are of one kind (size of set) and pool. Pairs of
    blocks of pool 0 hold no pair, pairs of kinds that aren't neighbours none that can be a link.
    """
    total = member.count()
    sizes = member.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    big = sizes.groupBy("cluster").agg(F.max(F.struct("n", "label"))["label"].alias("big"))
    step = math.log(den / num) * (1 + 1e-9)  # so that rounding never puts a kind between two sizes that may link
    kind = F.floor(F.log(F.col("n_shingles").cast("double")) / step).cast("int")
    member = common.join_each(member, big, ["cluster"], "node", total).select("node", "label", "n_shingles", "cluster", kind.alias("kind"), (F.col("label") != F.col("big")).cast("int").alias("pool"))
    cells = member.groupBy("cluster", "kind", "pool").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("words"))
    whole = cells.groupBy("cluster").agg(((F.sum("n") <= BLOCK) & (F.sum("words") * 8 <= BLOCK_BYTES)).alias("small"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.exp((F.col("kind") + 1) * step)))))
    cells = cells.join(whole, "cluster").select("cluster", F.when(F.col("small"), 0).otherwise(F.col("kind")).alias("k"), F.when(F.col("small"), 1).otherwise(F.col("pool")).alias("p"), "kind", "pool", F.when(F.col("small"), 1).otherwise(F.ceil(F.col("n") / most)).cast("int").alias("blocks"))
    a, b = cells.select("cluster", "kind", "pool", "k", "p", "blocks").distinct(), cells.select("cluster", F.col("k").alias("k2"), F.col("p").alias("p2"), F.col("blocks").alias("blocks2")).distinct()
    near = a.join(b, "cluster").where("abs(k - k2) <= 1 and p + p2 > 0")
    plan = near.groupBy("cluster", "kind", "pool", "k", "p", "blocks").agg(F.collect_list(F.struct("k2", "p2", "blocks2")).alias("cells"))  # six at most
    dealt = common.join_each(member, plan, ["cluster", "kind", "pool"], "node", total).withColumn("b", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    own, other = F.expr("struct(k as k, p as p, b as b)"), "struct(c.k2 as k, c.p2 as p, j as b)"
    partners = F.expr(f"flatten(transform(cells, c -> transform(sequence(0, c.blocks2 - 1), j -> {other})))")
    each = dealt.select("cluster", "node", "label", own.alias("own"), F.explode(partners).alias("other"))
    return each.select(F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "label")


def links(classes: DataFrame, sets, num: int, den: int) -> DataFrame:
    """(src, dst): links that connect each component of classes(rep, n_shingles, fp_a, fp_b, bands).

    sets(nodes) gives (node, registers, shingles) of durable nodes(node), one row for each class.
    """
    keys = classes.select("rep", F.explode("bands").alias("key"))
    lead = common.durable(keys.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    met = common.join_each(keys, lead.select("key", "lead"), ["key"], "rep", lead.agg(F.sum("n")).first()[0] or 0, counts=lead.select("key", "n"))
    near = common.durable(met.where("rep <> lead").select(F.col("lead").alias("src"), F.col("rep").alias("dst")).distinct())
    n_near = near.count()
    if not n_near:
        return near
    nodes = common.durable(near.select(F.col("src").alias("node")).union(near.select("dst")).distinct())
    held = common.durable(sets(nodes))
    found = _compare(_lead_tasks(near, n_near), held, num, den)
    label = common.durable(common.components(found).withColumnRenamed("component_id", "label"))
    ends = near
    for end, spread in (("src", "dst"), ("dst", "src")):
        ends = common.join_each(ends, label.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), [end], spread, n_near, "left")
    named = [F.coalesce(f"label_{end}", end).alias(end) for end in ("src", "dst")]
    apart = common.durable(ends.select(*named).where("src <> dst").distinct())
    if apart.isEmpty():
        return found
    cluster = common.durable(common.components(apart).withColumnRenamed("node", "label").withColumnRenamed("component_id", "cluster"))
    total = nodes.count()
    labelled = nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    member = common.join_each(labelled, cluster, ["label"], "node", total)
    size = classes.select(F.col("rep").alias("node"), "n_shingles").distinct()
    more = _compare(_block_tasks(common.durable(member.join(size, "node")), num, den), held, num, den)
    return found.unionByName(more)


def _same_id(some: DataFrame, reps: DataFrame) -> DataFrame:
    """(src, dst): links between the representatives of the classes that hold different texts of one id."""
    one = F.struct("n_shingles", "fp_a", "fp_b")
    ids = common.durable(some.groupBy("id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <> hi").select("id"))
    held = common.rows_of(some, "id", ids).select("id", "n_shingles", "fp_a", "fp_b").join(reps, ["n_shingles", "fp_a", "fp_b"]).select("id", "rep")
    least = held.groupBy("id").agg(F.min("rep").alias("src"))
    return held.join(least, "id").where("rep <> src").select("src", F.col("rep").alias("dst")).distinct()


#: Labels up to this number are broadcast, about 15 MB; more are joined by a shuffle.
BROADCAST_LABELS = 250_000


def near_rows(sk: DataFrame, sets, num: int, den: int, same_id: bool = False) -> DataFrame:
    """The rows of sk that others equal or are linked with, and their component_id.

    sk(id, n_shingles, fp_a, fp_b, bands) is durable. sets(nodes, classes) gives (node, registers, shingles) of the
    classes(node, n_shingles, fp_a, fp_b) of durable nodes(node).
    """
    digest = ["n_shingles", "fp_a", "fp_b"]
    some = sk.where("n_shingles > 0 and id is not null")
    # rows of a class have the same bands; its representative is its least id
    classes = common.durable(some.groupBy(*digest).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("n")))
    reps = classes.select("rep", *digest)
    edges = links(classes, lambda nodes: sets(nodes, classes.select(F.col("rep").alias("node"), *digest).join(nodes, "node", "left_semi")), num, den)
    if same_id:
        edges = edges.unionByName(_same_id(some, reps))
    label = common.components(edges).withColumnRenamed("node", "rep")
    labels = classes.select("rep", *digest, "n").join(label, "rep", "left").where("n > 1 or component_id is not null")
    labels = common.durable(labels.select(*digest, "n", F.coalesce("component_id", "rep").alias("component_id")))
    rows, table = some.drop("bands"), labels.drop("n")
    if labels.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(table), digest)
    return common.join_each(rows, table, digest, "id", labels.agg(F.sum("n")).first()[0], counts=labels.drop("component_id"))


def near_duplicates(docs: DataFrame, size: int, num: int, den: int, miss: float = MISS, most: int = MOST_REGISTERS) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs(id, text): texts of a component link from num / den. Durable.

    A text without words links with nothing. Rows of one id are one node, whatever their texts. A null id links with
    nothing and has no component. An empty table gives no row.
    """
    start = common.mark()
    rows, bands = tune_bands(num / den, miss, most)
    docs = docs.select("id", "text")
    source = Source(docs)
    sk = common.durable(source.sketches(size, rows, bands))

    def sets(nodes: DataFrame, classes: DataFrame) -> DataFrame:
        some = common.rows_of(docs, "id", nodes.select(F.col("node").alias("id")))
        digest = ["n_shingles", "fp_a", "fp_b"]
        made = source.sets(some, size, rows * bands).withColumnRenamed("id", "node")
        return made.join(classes, ["node", *digest], "left_semi").groupBy("node", *digest).agg(F.first("registers").alias("registers"), F.first("shingles").alias("shingles")).drop(*digest)

    found = near_rows(sk, sets, num, den, same_id=True).select("id", "n_shingles", "component_id")
    found = common.durable(found)
    ids = common.durable(found.groupBy("id").agg(F.min("component_id").alias("component_id")))
    few = F.broadcast(ids) if ids.count() <= BROADCAST_LABELS else ids
    rows = sk.select("id", "n_shingles")  # an id has one component, whatever its texts
    whole = rows.where("id is not null").join(few, "id", "left").unionByName(rows.where("id is null"), allowMissingColumns=True)
    out = common.durable(whole.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id")))
    common.drop_scratch(start, keep=(out,))
    return out


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    out = near_duplicates(docs, 3, 85, 100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).alias("kept"))
