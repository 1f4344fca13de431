"""Releases on disk: tables of files, references, chunks and payloads beside one release document.

A release is written to a staging folder. An older one in its place is moved aside first and comes back if the new one
can't be moved in, so readers see a whole release or, for a moment, none. Payloads are stored once for each chunk, by
the codec that pays, and lie in folders by the first two digits of the chunk id; a read of some chunks prunes to their
folders, and columns that aren't asked for stay unread.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import chunk_violations, unsafe
from ..operators import chunking, codec, diff, install, release


@dataclass
class Release:
    document: dict
    files: DataFrame
    references: DataFrame
    chunks: DataFrame
    payloads: DataFrame


def canonical_json(value) -> bytes:
    """Sorted keys, two spaces, characters as they are, a closing line feed: the bytes that digests and signatures cover."""
    return (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _write_document(spark: SparkSession, path: str, value: dict) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(canonical_json(value)))
    out.close()


def _read_document(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


PACK_ID = "pack-000000"


def write_release(
    tree: DataFrame,
    out: str,
    release_id: str,
    release_seq: int,
    chunk_size: int | None = None,
    force: bool = False,
    expires_at: str | None = None,
    not_before: str | None = None,
    cutting: chunking.Cutting | None = None,
    codec_policy: str = "auto",
    profile: dict | None = None,
) -> dict:
    """Pack tree(path, content, size, and mode and mtime_ns if known) into `out`.

    Refuses unsafe paths, and an existing folder unless forced. chunk_size asks for fixed chunks; cutting says it in full.
    """
    spark = tree.sparkSession
    cutting = cutting or (chunking.Cutting("fixed", fixed_size=chunk_size) if chunk_size else chunking.Cutting())
    fs, target = _fs(spark, out)
    if fs.exists(target) and not force:
        raise FileExistsError(out)
    if bad := tree.where(unsafe(F.col("path"))).select("path").limit(5).collect():
        raise ValueError(f"unsafe paths: {[r.path for r in bad]}")
    staging = f"{out.rstrip('/')}.staging-{uuid.uuid4().hex}"
    part = lambda name: f"{staging}/{name}"
    known = lambda name, kind: (F.col(name) if name in tree.columns else F.lit(None)).cast(kind).alias(name)
    digests = tree.select("path", "size", F.sha2("content", 256).alias("file_hash"), known("mode", "int"), known("mtime_ns", "bigint"))
    digests.withColumn("mode", F.col("mode").bitwiseAND(0o777)).withColumn("executable", F.col("mode").bitwiseAND(0o111) != 0).write.parquet(part("files"))
    cutting(tree).write.parquet(part("references"))
    refs = spark.read.parquet(part("references"))
    stored = release.stored_chunks(tree, cutting, codec_policy)
    stored.withColumn("prefix", F.substring("chunk_id", 1, 2)).repartitionByRange("chunk_id").write.partitionBy("prefix").parquet(part("payloads"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    held = spark.read.schema(f"{kinds}, prefix string").parquet(part("payloads")).drop("payload", "prefix")
    release.pack_offsets(held, "pack_len").withColumn("pack_id", F.lit(PACK_ID)).write.parquet(part("chunks"))
    chunks = spark.read.parquet(part("chunks"))
    metrics = release.release_metrics(tree, refs, chunks).crossJoin(chunking.chunk_stats(refs)).first().asDict()
    document = {"schema": "strata.release", "version": 2, "release_id": release_id, "release_seq": release_seq, "chunker": asdict(cutting), "codec_policy": codec_policy, "expires_at": expires_at, "not_before": not_before, "metrics": metrics}
    if profile:
        document["profile"] = dict(profile)
    document["root_hash"] = release.root_hash(tree, refs).first().root_hash
    _write_document(spark, part("release.json"), document)
    backup = f"{out.rstrip('/')}.backup-{uuid.uuid4().hex}"
    if had := fs.exists(target):
        fs.rename(target, _fs(spark, backup)[1])
    if not fs.rename(_fs(spark, staging)[1], target):
        if had:
            fs.rename(_fs(spark, backup)[1], target)
        raise OSError(f"could not move {staging} to {out}")
    if had:
        fs.delete(_fs(spark, backup)[1], True)
    return document


def load_release(spark: SparkSession, source: str, mirrors: tuple[str, ...] = ()) -> Release:
    """The first of the source and its mirrors whose document and tables all load; a row of each table is read to know it."""
    errors = []
    for base in (source, *mirrors):
        try:
            document = _read_document(spark, f"{base}/release.json")
            tables = [spark.read.parquet(f"{base}/{name}") for name in ("files", "references", "chunks", "payloads")]
            for table in tables:
                table.limit(1).collect()
            return Release(document, *tables)
        except Exception as error:  # noqa: BLE001  any failure of a mirror leads to the next
            errors.append(f"{base}: {str(error)[:200]}")
    raise OSError("no source has the release: " + "; ".join(errors[:5]))


def cutting_of(document: dict) -> chunking.Cutting:
    return chunking.Cutting(**document["chunker"])


def payloads(held: Release, ids: DataFrame | None = None) -> DataFrame:
    """(chunk_id, payload) of all chunks, or of ids(chunk_id): expanded, both hashes checked. What is stored raw stays in the JVM."""
    rows = held.payloads if ids is None else held.payloads.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    fails = lambda what: F.raise_error(F.concat(F.lit(f"{what} differs for chunk "), "chunk_id"))
    plain = rows.where("codec = 'raw'").select("chunk_id", F.when(F.sha2("payload", 256) == F.col("chunk_id"), F.col("payload")).otherwise(fails("hash").cast("binary")).alias("payload"))
    return plain.unionByName(codec.expand_chunks(rows.where("codec <> 'raw'")))


def extract_files(held: Release, paths: DataFrame | None = None) -> DataFrame:
    """(path, content, size, file_hash, mode, mtime_ns) rebuilt from payloads, all files or those of paths(path); verified by digest."""
    refs = held.references if paths is None else held.references.join(paths, "path", "left_semi")
    files = held.files if paths is None else held.files.join(paths, "path", "left_semi")
    rows = refs.join(payloads(held, None if paths is None else refs), "chunk_id").groupBy("path").agg(install.in_order("file_offset", "payload").alias("body"))
    out = files.join(rows, "path", "left").select("path", F.coalesce("body", F.expr("cast('' as binary)")).alias("content"), "size", "file_hash", "mode", "mtime_ns")
    return out.withColumn("content", F.when(F.sha2("content", 256) == F.col("file_hash"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "path")).cast("binary")))


def verify(held: Release) -> DataFrame:
    """(kind, id): references without a chunk, chunks without a payload or with impossible rows, payloads whose bytes aren't those that were stored."""
    gone = held.references.join(held.chunks.select("chunk_id"), "chunk_id", "left_anti").select(F.lit("missing-chunk").alias("kind"), F.col("chunk_id").alias("id")).distinct()
    lost = held.chunks.join(held.payloads.select("chunk_id"), "chunk_id", "left_anti").select(F.lit("missing-payload").alias("kind"), F.col("chunk_id").alias("id"))
    bad = held.payloads.where(F.sha2("payload", 256) != F.col("compressed_hash")).select(F.lit("bad-payload").alias("kind"), F.col("chunk_id").alias("id"))
    size = held.chunks.groupBy("pack_id").agg(F.coalesce(F.sum("pack_len"), F.lit(0)).alias("size"))
    odd = chunk_violations(held.chunks.withColumn("raw_hash", F.col("chunk_id")), size).select(F.col("violation").alias("kind"), F.col("chunk_id").alias("id"))
    return gone.unionByName(lost).unionByName(bad).unionByName(odd)


def fetch(held: Release, installed: DataFrame | None, cache: DataFrame | None, installed_seq: int | None = None, allow_downgrade: bool = False, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tree, downloads): the release's files, and the chunks that neither the cache(chunk_id) nor the installed tree has.

    allowed(chunk_id) are those that a plan names: another one that is missing is an error.
    """
    if installed_seq is not None and held.document["release_seq"] < installed_seq and not allow_downgrade:
        raise ValueError("the release is older than what is installed")
    missing = held.chunks.select("chunk_id", "raw_len", "pack_offset", "pack_len")
    if cache is not None:
        missing = missing.join(cache.select("chunk_id").distinct(), "chunk_id", "left_anti")
    if installed is not None:
        own = cutting_of(held.document)(installed)
        missing = missing.join(own.select("chunk_id").distinct(), "chunk_id", "left_anti")
    if allowed is not None and (row := missing.join(allowed.select("chunk_id"), "chunk_id", "left_anti").first()):
        raise ValueError(f"the plan doesn't name a chunk that is missing: {row.chunk_id}")
    return extract_files(held), missing


def _named(document: dict) -> dict:
    return {k: document[k] for k in ("release_id", "release_seq", "root_hash")}


def write_plan(old: Release, new: Release, out: str) -> dict:
    """The patch plan from one release to another: a document and the chunks to transfer."""
    spark = new.chunks.sparkSession
    rows = diff.patch_plan(old.chunks, new.chunks)
    rows.write.mode("overwrite").parquet(f"{out}/chunks")
    total = spark.read.parquet(f"{out}/chunks").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("pack_len"), F.lit(0)).cast("bigint").alias("pack_bytes"), F.coalesce(F.sum("raw_len"), F.lit(0)).cast("bigint").alias("raw_bytes")).first()
    plan = {"schema": "strata.patch-plan", "version": 1, "old": _named(old.document), "new": _named(new.document), "download": total.asDict()}
    _write_document(spark, f"{out}/plan.json", plan)
    return plan


def load_plan(spark: SparkSession, path: str, held: Release, installed: dict | None) -> tuple[dict, DataFrame]:
    """(document, chunks) of a plan that holds against the release and the installation; else an error with all reasons."""
    plan, rows = _read_document(spark, f"{path}/plan.json"), spark.read.parquet(f"{path}/chunks")
    errors = diff.plan_errors(plan, held.document, installed)
    errors += [f"{r.violation}: {r.chunk_id}" for r in diff.patch_plan_violations(rows, held.chunks).limit(5).collect()]
    if errors:
        raise ValueError("; ".join(errors))
    return plan, rows


def repair(held: Release, installed: DataFrame) -> DataFrame:
    """Every missing or damaged file of the installed tree, rebuilt."""
    state = install.audit(held.files, installed)
    return extract_files(held, state.where("status not in ('ok', 'extra')").select("path"))
