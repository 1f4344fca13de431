"""Predicates over paths, chunk rows, times, policies and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Device names and characters that some file systems reserve, and their limits.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
BAD_CHARACTERS = r'[<>:"|?*\\]'
MOST_PATH, MOST_COMPONENT = 240, 255


def unsafe(path: Column) -> Column:
    """Absolute, empty, `.` alone, or with a parent step."""
    return path.isNull() | (path == "") | (path == ".") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def portability(path: Column) -> Column:
    """What keeps a path from common file systems, in a fixed order, joined by commas; empty for none."""
    parts = F.split(path, "/")
    base = lambda p: F.upper(F.regexp_replace(F.regexp_extract(p, r"^([^.]*)", 1), r"[ .]+$", ""))
    issues = F.array(
        F.when(path.rlike(r"[\x00-\x1f]"), "control-character"),
        F.when(path.rlike(BAD_CHARACTERS), "reserved-character"),
        F.when(F.exists(parts, lambda p: p.rlike(r"[ .]$") & ~p.isin(".", "..")), "trailing-space-or-dot"),
        F.when(F.exists(parts, lambda p: base(p).isin(RESERVED)), "reserved-name"),
    )
    return F.array_join(F.array_compact(issues), ",")


def portability_warnings(paths: DataFrame) -> DataFrame:
    """(path, warnings): what may give trouble with older tools: another normal form than NFC, lengths. Joined by commas."""
    import unicodedata

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            odd = [p is not None and not unicodedata.is_normalized("NFC", p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odd)], ["path", "odd"])

    parts = F.split("path", "/")
    warnings = F.array(F.when(F.col("odd"), "not-nfc"), F.when(F.length("path") > MOST_PATH, "long-path"), F.when(F.exists(parts, lambda p: F.octet_length(p) > MOST_COMPONENT), "long-component"))
    return paths.select("path").mapInArrow(run, "path string, odd boolean").select("path", F.array_join(F.array_compact(warnings), ",").alias("warnings"))


def casefold_keys(paths: DataFrame) -> DataFrame:
    """(path, key): backslashes as slashes, NFC, full case folding; Arrow batches, as no built-in folds fully."""
    import unicodedata

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            keys = [None if p is None else unicodedata.normalize("NFC", p.replace("\\", "/")).casefold() for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], ["path", "key"])

    return paths.select("path").mapInArrow(run, "path string, key string")


def collisions(keyed: DataFrame) -> DataFrame:
    """(path, first_path): paths whose key an earlier path has, in path order. keyed(path, key)."""
    first = F.min(F.struct(F.split("path", "/").alias("k"), F.col("path").alias("p"))).over(Window.partitionBy("key"))
    return keyed.withColumn("f", first).where("path <> f.p").select("path", F.col("f.p").alias("first_path"))


def window_status(now: Column, not_before: Column, expires: Column) -> Column:
    """Too early is told first; both bounds are still valid; a missing bound is none."""
    return F.when(now < not_before, "not-yet-valid").when(now > expires, "expired").otherwise("valid")


def rollback(current: Column, target: Column, allowed: Column) -> Column:
    return F.when((target < F.coalesce(current, F.lit(-1))) & ~allowed, "refused").otherwise("accepted")


def chunk_violations(chunks: DataFrame, packs: DataFrame) -> DataFrame:
    """Rows (chunk_id, violation) of chunks(chunk_id, raw_hash, raw_len, pack_id, pack_offset, pack_len) against packs(pack_id, size)."""
    rows = chunks.join(packs.select("pack_id", F.col("size").alias("pack_size")), "pack_id", "left")
    tests = F.array(
        F.when(~F.col("chunk_id").eqNullSafe(F.col("raw_hash")), "id-is-not-hash"),
        F.when((F.col("raw_len") < 0) | (F.col("pack_len") < 0), "negative-length"),
        F.when(F.col("pack_size").isNull(), "unknown-pack"),
        F.when((F.col("pack_offset") < 0) | (F.col("pack_offset") + F.col("pack_len") > F.col("pack_size")), "outside-pack"),
    )
    return rows.select("chunk_id", F.explode(F.array_compact(tests)).alias("violation"))


def provider_verdict(rows: DataFrame) -> DataFrame:
    """rows(ok, digest_ok, audit_ok, expected, actual, pinned): the reasons against a provider's result, in order."""
    same = F.lower("expected") == F.lower("actual")
    reasons = F.array(
        F.when(~F.coalesce("ok", F.lit(False)), "not-ok"),
        F.when(~F.coalesce("digest_ok", F.lit(False)), "digest-not-ok"),
        F.when(~F.coalesce("audit_ok", F.lit(False)), "audit-not-ok"),
        F.when(F.col("expected").isNull() | F.col("actual").isNull(), "digest-missing").when(~same, "digest-differs"),
        F.when(F.col("pinned").isNotNull() & ~F.lower("pinned").eqNullSafe(F.lower("actual")), "not-the-pinned-digest"),
    )
    out = rows.withColumn("reasons", F.array_join(F.array_compact(reasons), ","))
    return out.withColumn("accepted", F.col("reasons") == "")


# What a profile may name.
CHUNKERS, CODECS = ["fixed", "cdc", "fastcdc", "gear"], ["auto", "raw", "zlib", "zstd"]


def profile_issues(rows: DataFrame) -> DataFrame:
    """rows(name, version, chunker, codec, low, avg, high, stride): issues in order; defaults for what is missing."""
    low, avg, high, stride = (F.coalesce(F.col(c), F.lit(d)) for c, d in (("low", 65_536), ("avg", 262_144), ("high", 1_048_576), ("stride", 16)))
    issues = F.array(
        F.when(~F.col("version").eqNullSafe(F.lit(1)), "schema-version"),
        F.when(~F.coalesce(F.col("chunker").isin(CHUNKERS), F.lit(False)), "chunker"),
        F.when(~F.coalesce(F.col("codec").isin(CODECS), F.lit(False)), "codec"),
        F.when(~((low > 0) & (low <= avg) & (avg <= high)), "sizes"),
        F.when(stride <= 0, "stride"),
    )
    return rows.select("name", low.alias("low"), avg.alias("avg"), high.alias("high"), stride.alias("stride"), F.array_join(F.array_compact(issues), ",").alias("issues"))


def signed_prefix_ok(path: Column, prefix: Column, expires: Column, now: Column) -> Column:
    """A signed URL serves paths below its prefix until it expires."""
    return F.when(now > expires, "expired").when(~path.startswith(F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"))), "outside-prefix").otherwise("ok")
