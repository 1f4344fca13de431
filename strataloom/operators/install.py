"""Reading releases back: resolving, extracting, auditing an install, and what a fetch takes from the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix
from .diff import unique_chunks
from .release import file_digests


def resolve(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    return chunks.join(stored.select("chunk_id", "pack_offset"), "chunk_id").select("path", "file_offset", "raw_len", "chunk_id", "pack_offset")


def extract(members: DataFrame, tree: DataFrame, size: int = 256) -> DataFrame:
    """Files rebuilt from their chunks in order: (path, size, sha256, rebuilt_size)."""
    parts = members.select("path", "size", F.explode(F.expr(f"if(octet_length(content) > 0, sequence(0, octet_length(content) - 1, {size}), array(0))")).alias("o"), "content")
    parts = parts.select("path", "size", "o", F.sha2(F.substring("content", F.col("o") + 1, F.lit(size)), 256).alias("chunk_id"))
    rows = parts.join(fixed_payloads(tree, size), "chunk_id").groupBy("path", "size").agg(in_order("o", "payload").alias("body"))
    return rows.select("path", "size", F.sha2("body", 256).alias("sha256"), F.octet_length("body").cast("bigint").alias("rebuilt_size"))


def in_order(place: str, payload: str) -> Column:
    """An aggregate: the payloads of a group, one after the other by place; every byte is copied once. A group is one file."""
    return F.expr(f"listagg({payload}) within group (order by {place})")


def fixed_payloads(tree: DataFrame, size: int = 256) -> DataFrame:
    """(chunk_id, payload): each chunk's bytes once; an empty file's chunk is empty."""
    at = F.expr(f"if(octet_length(content) > 0, sequence(0, octet_length(content) - 1, {size}), array(0))")
    part = F.substring("content", F.col("o") + 1, F.lit(size))
    return tree.select("content", F.explode(at).alias("o")).select(F.sha2(part, 256).alias("chunk_id"), part.alias("payload")).dropDuplicates(["chunk_id"])


def audit(expected: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, status): missing, then size, then hash decide; files beyond the manifest are extra."""
    actual = file_digests(tree).select("path", F.col("size").alias("is_size"), F.col("file_hash").alias("is_hash"))
    status = F.when(F.col("is_hash").isNull(), "missing").when(F.col("file_hash").isNull(), "extra").when(F.col("size") != F.col("is_size"), "size-mismatch").when(F.col("file_hash") != F.col("is_hash"), "hash-mismatch").otherwise("ok")
    return expected.select("path", "size", "file_hash").join(actual, "path", "full_outer").select("path", status.alias("status"))


def seed_cache(installed: DataFrame, required: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """Chunks of the installed files that the release needs and the cache lacks."""
    out = unique_chunks(installed).join(required.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return out if cached is None else out.join(cached.select("chunk_id"), "chunk_id", "left_anti")


def missing(required: DataFrame, cache: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    out = unique_chunks(required).join(cache.select("chunk_id"), "chunk_id", "left_anti")
    return out if allowed is None else out.join(allowed.select("chunk_id"), "chunk_id", "left_semi")


def fetch_accounting(required: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits and downloads over distinct ids, so neither depends on the order of work."""
    hit = F.col("held").isNotNull()
    rows = unique_chunks(required).join(cache.select("chunk_id", F.lit(True).alias("held")), "chunk_id", "left")
    size = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("raw_len"))), F.lit(0)).cast("bigint")
    return rows.agg(F.count("*").alias("required"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("downloaded"), size(hit).alias("hit_bytes"), size(~hit).alias("downloaded_bytes"))


def first_seen(stored: DataFrame) -> DataFrame:
    """Ordinal of each chunk by its first use."""
    return prefix.ordinals(stored.select("chunk_id", "first_path", "first_offset"), [F.split("first_path", "/"), F.col("first_offset")], "ordinal")


def cache_status(name: Column, content: Column) -> Column:
    """A name must be 64 hex digits, and the digest of its content."""
    return F.when(~name.rlike("^[0-9a-fA-F]{64}$"), "not-a-chunk-name").when(content.isNull(), "unreadable").when(F.sha2(content, 256) != F.lower(name), "sha256-mismatch").otherwise("ok")


def cache_index(entries: DataFrame) -> DataFrame:
    """Entries(name, content) by status."""
    return entries.groupBy(cache_status(F.col("name"), F.col("content")).alias("status")).agg(F.count("*").alias("entries"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


def missing_references(file_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    gone = file_chunks.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")
    each = gone.groupBy("chunk_id").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("missing_refs"), F.count("*").alias("missing_chunks"))


def cache_upsert(index: DataFrame, touches: DataFrame) -> DataFrame:
    """Index(chunk_id, raw_len, last_used) after a batch of touches: the latest use and its length win."""
    return index.unionByName(touches).groupBy("chunk_id").agg(F.max(F.struct("last_used", "raw_len")).alias("m")).select("chunk_id", F.col("m.raw_len").alias("raw_len"), F.col("m.last_used").alias("last_used"))


def cache_gc(index: DataFrame, limit: int, older_than: int | None = None) -> DataFrame:
    """Rows that go, least recently used first, until the total is within the limit; rows too young stay and don't count."""
    total = index.agg(F.coalesce(F.sum("raw_len"), F.lit(0)).alias("_all"))
    rows = index if older_than is None else index.where(F.col("last_used") <= older_than)
    out = prefix.sums_before(rows, [F.col("last_used"), F.col("chunk_id")], "raw_len", "_freed").crossJoin(F.broadcast(total))  # one row
    return out.where(F.col("_all") - F.col("_freed") > limit).select(*index.columns)
