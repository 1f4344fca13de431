"""Releases as streams (an addition of this library): files arrive, their chunks are stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import FIXED_SIZE, fixed_chunks


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they appear below a folder: (path, content, size, seen)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("seen"))


def new_chunks(files: DataFrame, size: int = FIXED_SIZE, delay: str = "1 hour") -> DataFrame:
    """Chunks not seen within the delay of the watermark; state is bounded by it."""
    seen = files.withWatermark("seen", delay)
    at = F.expr(f"if(octet_length(content) > 0, sequence(0, octet_length(content) - 1, {size}), array())")
    part = F.substring("content", F.col("o") + 1, F.lit(size))
    chunks = seen.select("seen", "content", F.explode(at).alias("o")).select("seen", F.sha2(part, 256).alias("chunk_id"), F.octet_length(part).cast("bigint").alias("raw_len"))
    return chunks.dropDuplicatesWithinWatermark(["chunk_id"])


def store_batches(files: DataFrame, table: str, checkpoint: str, size: int = FIXED_SIZE):
    """A query that appends each batch's chunks that the table lacks; a batch that is run again adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        chunks = fixed_chunks(batch, size).groupBy("chunk_id").agg(F.first("raw_len").alias("raw_len"))
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            chunks = chunks.join(spark.read.parquet(table).select("chunk_id"), "chunk_id", "left_anti")
        chunks.write.mode("append").parquet(table)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
