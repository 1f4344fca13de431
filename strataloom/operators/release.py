"""A packed release: chunks in write order, each stored once, with offsets, metrics and digests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.trees import order_key
from . import prefix
from .codec import compress_chunks

#: Lines that a bucket of the root hash holds, about.
BUCKET_LINES = 1 << 16


def file_digests(tree: DataFrame) -> DataFrame:
    """(path, size, file_hash)."""
    return tree.select("path", "size", F.sha2("content", 256).alias("file_hash"))


def first_writers(chunks: DataFrame) -> DataFrame:
    """One row per chunk: the reference that comes first by path components and offset, and the number of references.

    An aggregate, not a window, so a chunk that most files hold is combined before the shuffle.
    """
    ref = F.struct(order_key().alias("parts"), F.col("file_offset").alias("file_offset"), F.col("path").alias("path"))
    out = chunks.groupBy("chunk_id").agg(F.min(ref).alias("first"), F.first("raw_len").alias("raw_len"), F.count("*").alias("refs"))
    return out.select("chunk_id", "raw_len", F.col("first.path").alias("first_path"), F.col("first.file_offset").alias("first_offset"), "refs")


def pack_offsets(stored: DataFrame, length: str = "raw_len") -> DataFrame:
    """stored(chunk_id, raw_len, first_path, first_offset, ...) with its place in the pack: the sum of `length` before it in write order."""
    return prefix.sums_before(stored, [order_key("first_path"), F.col("first_offset"), F.col("chunk_id")], length, "pack_offset")


def file_offsets(chunks: DataFrame) -> DataFrame:
    """A chunk's offset as the sum of the lengths before it in its file."""
    before = Window.partitionBy("path").orderBy("file_offset").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select("path", "file_offset", "raw_len", F.coalesce(F.sum("raw_len").over(before), F.lit(0)).cast("bigint").alias("running_offset"))


def stored_chunks(tree: DataFrame, cutting, codec: str = "auto") -> DataFrame:
    """Every chunk once, as it is stored: chunk_id, raw_len, first_path, first_offset, refs, codec, pack_len, compressed_hash, payload."""
    parts = cutting(tree, payload=True)
    body = parts.select("chunk_id", "payload").dropDuplicates(["chunk_id"])
    return compress_chunks(first_writers(cutting(tree)).join(body, "chunk_id"), codec)


def release_metrics(tree: DataFrame, chunks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row of totals. stored(pack_len) has what is stored for each chunk; without it chunks are stored raw."""
    files = tree.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("logical_size"))
    each = chunks.groupBy("chunk_id").agg(F.first("raw_len").alias("raw_len"), F.count("*").alias("refs"))
    unique = each.agg(F.count("*").alias("unique_chunks"), F.coalesce(F.sum("raw_len"), F.lit(0)).cast("bigint").alias("stored_bytes"), F.coalesce(F.sum(F.col("refs") - 1), F.lit(0)).cast("bigint").alias("reused_refs"))
    if stored is not None:
        unique = unique.drop("stored_bytes").crossJoin(stored.agg(F.coalesce(F.sum("pack_len"), F.lit(0)).cast("bigint").alias("stored_bytes")))
    both = files.crossJoin(unique)  # one row each
    return both.withColumn("storage_ratio", F.when(F.col("logical_size") > 0, F.bround(F.col("stored_bytes") / F.col("logical_size"), 6)).otherwise(F.lit(0.0)))


def tree_size(tree: DataFrame) -> DataFrame:
    return tree.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def _digest(rows: DataFrame, line: Column) -> DataFrame:
    """SHA-256 over a line per file, in path order.

    That digest is sequential by definition: its lines, not the contents, pass one task as a sorted stream, in bounded memory.
    """

    def run(batches):
        total, n = hashlib.sha256(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(text)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.hexdigest()]), pa.array([n], pa.int64())], ["digest", "files"])

    one = rows.select(order_key().alias("k"), line.cast("binary").alias("line")).repartition(1).sortWithinPartitions("k")
    return one.select("line").mapInArrow(run, "digest string, files bigint")


def tree_digest(tree: DataFrame, with_size: bool = True) -> DataFrame:
    """SHA-256 of `path NUL size NUL hash` lines in path order, or of `path NUL hash` lines. root_hash has no sequential step."""
    parts = ["path", F.col("size").cast("string"), "file_hash"] if with_size else ["path", "file_hash"]
    return _digest(file_digests(tree), F.concat(F.concat_ws("\0", *parts), F.lit("\n")))


def bucket_digits(lines: int, most: int = BUCKET_LINES) -> int:
    """Hex digits of the buckets of so many lines: 3, 6, 9, ..., so that a bucket holds `most` lines at most, about."""
    digits = 3
    while lines > most * 16**digits:
        digits += 3
    return digits


def root_hash(tree: DataFrame, chunks: DataFrame, most: int = BUCKET_LINES) -> DataFrame:
    """A tree of digests by hash of path and chunk: every file and chunk line counts.

    Lines are sorted and hashed in buckets of bucket_digits() of their key's digest; 4,096 buckets at a time are folded
    into one, so a task holds one bucket's lines whatever the number of files.
    """

    def folded(rows: DataFrame, key: str, line: Column, name: str) -> DataFrame:
        digits = bucket_digits(rows.count(), most)
        bucket = F.substring(F.sha2(F.col(key), 256), 1, digits)
        leaf = rows.groupBy(bucket.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("leaf"))
        while digits:
            digits -= 3
            lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "bucket", "leaf"))), "\n")  # 4,096 at most
            leaf = leaf.groupBy(F.substring("bucket", 1, digits).alias("above")).agg(F.sha2(lines, 256).alias("leaf")).withColumnRenamed("above", "bucket")
        return leaf.agg(F.coalesce(F.max("leaf"), F.sha2(F.lit(""), 256)).alias(name))

    files = folded(file_digests(tree), "path", F.concat_ws(" ", "path", F.col("size").cast("string"), "file_hash"), "files_hash")
    parts = folded(chunks.select("chunk_id", "raw_len").distinct(), "chunk_id", F.concat_ws(" ", "chunk_id", F.col("raw_len").cast("string")), "chunks_hash")
    return files.crossJoin(parts).withColumn("root_hash", F.sha2(F.concat_ws("\n", "files_hash", "chunks_hash"), 256))


def object_manifest(tree: DataFrame) -> DataFrame:
    return file_digests(tree).select(F.concat(F.lit("objects/"), "path").alias("key"), F.col("size").alias("bytes"), F.col("file_hash").alias("sha256"))


def manifest_verify(manifest: DataFrame, tree: DataFrame) -> DataFrame:
    """MISSING, MISMATCH or OK for each line (path, file_hash) of a manifest."""
    found = file_digests(tree).select("path", F.col("file_hash").alias("actual"))
    return manifest.join(found, "path", "left").select("path", F.when(F.col("actual").isNull(), "MISSING").when(F.col("actual") != F.col("file_hash"), "MISMATCH").otherwise("OK").alias("status"))
