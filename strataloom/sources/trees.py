"""Trees of files as DataFrames: tree(path, content, size), one row per file.

A path sorts by its components (`order_key`), so `a/b` comes before `a-b`; that order decides which writer is first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part of a path that marks the engine's own files in an installed tree.
PRIVATE = ".strata"
INSERTED, APPENDED, OVERWRITTEN = "[inserted block of the second release]", "\n-- appended in the second release\n", 64


def order_key(path: str = "path") -> Column:
    return F.split(F.col(path), "/")


def directory_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root but the engine's own: path relative to root, content, size, modification time.

    The scan passes over empty files; they come from the listing, without a time.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    scanned = files.select("path", "content", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"))
    listed = spark.createDataFrame([(p.replace("file:///", "file:/"),) for p in files.inputFiles()], "path string").join(files.select("path"), "path", "left_anti")
    every = scanned.unionByName(listed.select(F.url_decode("path").alias("path"), F.expr("cast('' as binary)").alias("content"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("mtime_us")))
    rel = F.substring("path", F.instr("path", F.lit(base)) + len(base), F.length("path"))
    return every.withColumn("path", rel).where(~F.array_contains(F.split("path", "/"), PRIVATE))


def local_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, mode, mtime_ns) of the files below a folder of the driver's file system, from their directory entries."""
    import os

    rows = []
    for folder, names, files in os.walk(root):
        names[:] = [x for x in names if x != PRIVATE]
        for name in files:
            at = os.path.join(folder, name)
            state = os.stat(at)
            rows.append((os.path.relpath(at, root), state.st_mode & 0o777, state.st_mtime_ns))
    return spark.createDataFrame(rows, "path string, mode int, mtime_ns bigint")


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".txt")))
    return docs.select(path.alias("path"), "source", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def release_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two releases of all documents as files. A source's files share one fate in the second release.

    src1 removed, src2 a block inserted in the middle, src3 appended to, src4 a prefix overwritten, src5 moved,
    src6 new; the others stay.
    """
    files = _document_files(spark, sf_dir)
    size = F.octet_length("content")
    v1 = files.where("source <> 'src6'").select("path", "content", size.cast("bigint").alias("size"))
    half = F.expr("cast(floor(octet_length(content) / 2) as int)")
    head = F.least(size, F.lit(OVERWRITTEN))
    content = (
        F.when(F.col("source") == "src2", F.concat(F.expr("substring(content, 1, cast(floor(octet_length(content) / 2) as int))"), F.encode(F.lit(INSERTED), "UTF-8"), F.substring("content", half + 1, size)))
        .when(F.col("source") == "src3", F.concat("content", F.encode(F.lit(APPENDED), "UTF-8")))
        .when(F.col("source") == "src4", F.concat(F.encode(F.repeat(F.lit("#"), head), "UTF-8"), F.substring("content", head + 1, size)))
        .otherwise(F.col("content"))
    )
    path = F.when(F.col("source") == "src5", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    v2 = files.where("source <> 'src1'").select(path.alias("path"), content.alias("content")).withColumn("size", size.cast("bigint"))
    return v1, v2


#: The same pair as common table expressions v1 and v2.
PAIR_SQL = f"""
docs_ AS (SELECT lang || '/' || source || '/doc_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.txt' AS path, source, encode(coalesce(text, '')) AS content FROM documents),
v1 AS (SELECT path, content, CAST(octet_length(content) AS BIGINT) AS size FROM docs_ WHERE source <> 'src6'),
v2_ AS (SELECT CASE WHEN source = 'src5' THEN 'moved/' || path ELSE path END AS path,
  CASE source
    WHEN 'src2' THEN array_slice(content, 1, octet_length(content) // 2) || encode('{INSERTED}') || array_slice(content, octet_length(content) // 2 + 1, octet_length(content))
    WHEN 'src3' THEN content || encode(chr(10) || '{APPENDED.strip()}' || chr(10))
    WHEN 'src4' THEN encode(repeat('#', CAST(least(octet_length(content), {OVERWRITTEN}) AS INTEGER))) || array_slice(content, least(octet_length(content), {OVERWRITTEN}) + 1, octet_length(content))
    ELSE content END AS content
  FROM docs_ WHERE source <> 'src1'),
v2 AS (SELECT path, content, CAST(octet_length(content) AS BIGINT) AS size FROM v2_)"""
