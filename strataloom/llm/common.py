"""What the operators share: durable intermediate tables, batches of text, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_scratch, durable, mark, scratch_dir  # noqa: F401  the operators take them from here

#: Bytes of text that a Python worker handles at a time, and the rows of an Arrow batch.
CHUNK_BYTES = 1 << 18
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Long texts come in batches of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores until no column has it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever marks the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


#: A set of ids up to this size is broadcast (under 64 MB in memory); a larger one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def rows_of(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key is among ids, which must be durable: counted first, broadcast only below a bound."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


#: Rows of one key that a task may join, if that is more than a partition's share; no key of a table of FEW rows is hot.
LEAST_HOT, FEW = 200, 5_000


def _hot_limit(spark: SparkSession, total: int) -> int:
    return max(LEAST_HOT, 2 * total // int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_each(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, total: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with table, which has one row a key; a key of many rows is dealt over several tasks by a hash of `spread`.

    total is about the number of rows, counts(keys, n) that of each key, if stored. Hot keys are those of over twice a partition's share: fewer than partitions, so
    their list is broadcast whatever the size of the corpus.
    """
    if total <= FEW:
        return rows.join(table, keys, how)
    limit = _hot_limit(rows.sparkSession, total)
    known = counts is not None
    counts = counts if known else rows.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("n_hot"))
    if known and hot.isEmpty():
        return rows.join(table, keys, how)
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("salt_hot", F.coalesce(F.pmod(F.xxhash64(spread), "n_hot").cast("int"), F.lit(0))).drop("n_hot")
    dealt = table.join(F.broadcast(hot), keys, "left").withColumn("salt_hot", F.explode(F.sequence(F.lit(0), F.coalesce("n_hot", F.lit(1)) - 1))).drop("n_hot")
    return salted.join(dealt, [*keys, "salt_hot"], how).drop("salt_hot")


def trimmed(run):
    """run, for mapInArrow, after which its worker gives the memory that it doesn't use back to the system."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


# ---- texts in Arrow batches -------------------------------------------------------------------------


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together; a longer text has its own range."""
    ends = np.cumsum(np.asarray(byte_lengths(texts)))
    at, n = 0, len(texts)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, to
        at = to


def byte_lengths(texts: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + texts.offset + 1)[texts.offset :]
    return np.diff(offsets).astype(np.int64)


def text_column(column) -> pa.Array:
    """One string array without nulls; a null text counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if array.type != pa.string():
        array = array.cast(pa.string())
    return array.fill_null("") if array.null_count else array


# ---- connected components ---------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label of every node that an edge touches: the smallest node that edges reach.

    edges(src, dst) of any orientation, with repeats and loops. Alternates large-star and small-star steps
    (Kiveris et al., Connected Components in MapReduce and Beyond), each a window-free group by node, until the
    edges no longer change; only their number and a checksum come to the driver. Returns (node, component_id);
    nodes without edges are absent.
    """
    spark = edges.sparkSession
    both = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    start = mark()
    now, seen = durable(both), None
    for _ in range(most_rounds):
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (found.n, found.s) == seen or not found.n:
            break
        seen = (found.n, found.s)
        now = durable(_star(_star(now, found.n, large=True), found.n, large=False))
        drop_scratch(start, keep=(now,))
    else:
        raise RuntimeError("connected components did not settle")
    root = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component_id"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(root)


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Large: each node's larger neighbours are tied to its least one. Small: its smaller ones and itself are.

    A hub's neighbours are dealt over several tasks; its least neighbour is found by an aggregate with map-side combine.
    """
    near = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        near = near.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = near.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"), F.count("*").alias("n"))
    least = durable(least) if 2 * total > FEW else least
    tied = join_each(near, least.select("x", "m"), ["x"], "y", 2 * total, counts=least.select("x", "n"))
    if large:
        out = tied.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()
