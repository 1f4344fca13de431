"""What changes between two releases, by chunk and by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .release import file_digests


def unique_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.first("raw_len").alias("raw_len"))


def chunks_reused(old: DataFrame, new: DataFrame) -> DataFrame:
    return unique_chunks(new).join(old.select("chunk_id").distinct(), "chunk_id", "left_semi")


def chunks_added(old: DataFrame, new: DataFrame) -> DataFrame:
    return unique_chunks(new).join(old.select("chunk_id").distinct(), "chunk_id", "left_anti")


def chunks_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return chunks_added(new, old)


def file_status(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, status, old_size, new_size) of two file tables(path, size, file_hash): added, removed, changed or unchanged, by content; the size of no file is 0. With `by`, each of these groups apart."""
    a = old.select(*by, "path", F.col("file_hash").alias("old_hash"), F.col("size").alias("old_size"))
    b = new.select(*by, "path", F.col("file_hash").alias("new_hash"), F.col("size").alias("new_size"))
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return a.join(b, [*by, "path"], "full_outer").select(*by, "path", status.alias("status"), F.coalesce("old_size", F.lit(0)).alias("old_size"), F.coalesce("new_size", F.lit(0)).alias("new_size"))


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_status of two trees."""
    return file_status(file_digests(old), file_digests(new))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of the new release whose content isn't the old one's at that path; removed files are none of them."""
    a = file_digests(old).select("path", F.col("file_hash").alias("was"))
    b = file_digests(new)
    return b.join(a, "path", "left").where(~F.col("file_hash").eqNullSafe(F.col("was"))).select("path", "size", "file_hash")


def pair_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """Numbers of files by fate, and of those whose size changed."""
    d = file_diff(old, new)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return d.agg(n("added"), n("removed"), n("changed"), n("unchanged"), F.count_if((F.col("status") == "changed") & (F.col("old_size") != F.col("new_size"))).alias("resized"))


def tree_compare(source: DataFrame, received: DataFrame) -> DataFrame:
    d = file_diff(received, source)
    return d.agg(F.count_if(F.col("status") == "added").alias("missing"), F.count_if(F.col("status") == "removed").alias("extra"), F.count_if(F.col("status") == "changed").alias("mismatch")).withColumn("equal", (F.col("missing") + F.col("extra") + F.col("mismatch")) == 0)


def stored_raw(chunks: DataFrame) -> DataFrame:
    """Distinct chunks of references, stored as they are: (chunk_id, raw_len, pack_len)."""
    return unique_chunks(chunks).withColumn("pack_len", F.col("raw_len"))


def diff_summary(old_files: DataFrame, new_files: DataFrame, old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What an update moves: one row, or one for each group of `by`, which all four tables have.

    Files are (path, size, file_hash), chunks (chunk_id, raw_len, pack_len), one row each. Bytes to download are stored
    ones, `download_raw_bytes` those before compression. Reuse goes by the number of distinct chunks. Added files count
    as changed. Savings are at least 0; a ratio is 1 where nothing changed, and 0 of nothing stored.
    """
    a = old.select(*by, "chunk_id", F.lit(True).alias("is_old"))
    b = new.select(*by, "chunk_id", F.lit(True).alias("is_new"), "raw_len", "pack_len")
    is_old, is_new = F.coalesce("is_old", F.lit(False)), F.coalesce("is_new", F.lit(False))
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    chunks = a.join(b, [*by, "chunk_id"], "full_outer").groupBy(*by).agg(
        F.count_if(is_old).alias("old_unique_chunks"),
        F.count_if(is_new).alias("new_unique_chunks"),
        F.count_if(is_old & is_new).alias("reused_chunks"),
        F.count_if(~is_old).alias("added_chunks"),
        F.count_if(~is_new).alias("removed_chunks"),
        total(~is_old, "pack_len").alias("download_pack_bytes"),
        total(~is_old, "raw_len").alias("download_raw_bytes"),
        total(is_new, "pack_len").alias("stored_size_new"),
        total(is_new, "raw_len").alias("raw_unique_size_new"),
    )
    changed = F.col("status").isin("added", "changed")
    files = file_status(old_files, new_files, by).groupBy(*by).agg(
        F.count_if(F.col("status") == "added").alias("files_added"),
        F.count_if(F.col("status") == "removed").alias("files_removed"),
        F.count_if(changed).alias("files_changed"),
        F.count_if(F.col("status") == "unchanged").alias("files_unchanged"),
        F.coalesce(F.sum(F.when(changed, F.col("new_size"))), F.lit(0)).cast("bigint").alias("changed_file_bytes"),
        F.coalesce(F.sum("new_size"), F.lit(0)).cast("bigint").alias("logical_size_new"),
    )
    left = lambda whole, part: F.greatest(F.lit(0), F.col(whole) - F.col(part)).cast("bigint")
    ratio = lambda part, whole, none: F.when(F.col(whole) > 0, F.bround(F.col(part) / F.col(whole), 6)).otherwise(F.lit(none))
    # one row each, or one for each group; a group of empty files only has no chunks
    one = files.join(chunks, list(by), "left").na.fill(0) if by else chunks.crossJoin(files)
    one = one.withColumn("chunk_reuse_ratio", ratio("reused_chunks", "new_unique_chunks", 1.0))
    one = one.withColumn("saved_vs_full_stored", left("stored_size_new", "download_pack_bytes"))
    one = one.withColumn("saved_ratio_vs_full_stored", ratio("saved_vs_full_stored", "stored_size_new", 0.0))
    one = one.withColumn("saved_vs_changed_files", left("changed_file_bytes", "download_pack_bytes"))
    one = one.withColumn("saved_ratio_vs_changed_files", ratio("saved_vs_changed_files", "changed_file_bytes", 1.0))
    one = one.withColumn("raw_saved_vs_changed_files", left("changed_file_bytes", "download_raw_bytes"))
    return one.withColumn("raw_saved_ratio_vs_changed_files", ratio("raw_saved_vs_changed_files", "changed_file_bytes", 1.0))


def changed_paths_sample(old: DataFrame, new: DataFrame, n: int = 20) -> DataFrame:
    """The first changed paths in path order; the limit is the report's."""
    return changed_files(old, new).select("path").orderBy(F.split("path", "/")).limit(n)


#: What a plan says of a chunk, and what has to hold of it against the release.
PLAN_COLUMNS = ["raw_len", "codec", "compressed_hash", "pack_id", "pack_offset", "pack_len"]


def removed_paths_sample(old: DataFrame, new: DataFrame, n: int = 20) -> DataFrame:
    """The first removed paths by name; the limit is the report's."""
    return old.select("path").join(new.select("path"), "path", "left_anti").orderBy("path").limit(n)


def size_changes_sample(old: DataFrame, new: DataFrame, n: int = 20) -> DataFrame:
    """(path, old_size, new_size, size_delta) of the first files by name that are in both trees with other sizes; the limit is the report's."""
    both = old.select("path", F.col("size").alias("old_size")).join(new.select("path", F.col("size").alias("new_size")), "path").where("old_size <> new_size")
    return both.withColumn("size_delta", F.col("new_size") - F.col("old_size")).orderBy("path").limit(n)


def patch_plan(old: DataFrame, stored_new: DataFrame) -> DataFrame:
    """Chunks to transfer: those of the new release's table that the old one lacks."""
    named = [c for c in PLAN_COLUMNS if c in stored_new.columns]
    return stored_new.join(old.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", *named)


def patch_plan_violations(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """(chunk_id, violation) of plan rows that don't hold against the release: missing id, repeated, unknown, or the first column that differs, null-safe."""
    named = [c for c in PLAN_COLUMNS if c in plan.columns and c in stored.columns]
    n = plan.groupBy("chunk_id").agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in named])
    known = stored.select("chunk_id", *[F.col(c).alias(f"is_{c}") for c in named], F.lit(True).alias("_known"))
    what = F.when(F.coalesce(F.col("chunk_id"), F.lit("")) == "", "missing-id").when(F.col("_n") > 1, "duplicate").when(F.col("_known").isNull(), "unknown")
    for c in named:
        what = what.when(~F.col(c).eqNullSafe(F.col(f"is_{c}")), f"differs: {c}")
    return n.join(known, "chunk_id", "left").select("chunk_id", what.alias("violation")).where("violation is not null")


def plan_errors(plan: dict, document: dict, installed: dict | None) -> list[str]:
    """What speaks against applying a plan {old, new} of a release to an installation, in order. Each names id, sequence and root hash."""
    old, new = plan.get("old") or {}, plan.get("new") or {}
    seq = lambda d: int(d.get("release_seq", -1))
    tests = [
        ("not-a-plan", plan.get("schema") != "strata.patch-plan"),
        ("target-root", new.get("root_hash") != document.get("root_hash")),
        ("target-id", new.get("release_id") != document.get("release_id")),
        ("target-seq", seq(new) != int(document.get("release_seq", 0))),
        ("target-older-than-source", seq(new) < seq(old)),
        ("nothing-installed", installed is None),
        ("installed-root", installed is not None and installed.get("root_hash") != old.get("root_hash")),
        ("installed-seq", installed is not None and seq(installed) != seq(old)),
        ("installed-id", installed is not None and installed.get("release_id") != old.get("release_id")),
    ]
    return [name for name, bad in tests if bad]
