"""Predicates over paths, chunk tables, times, policies and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import text as T
from ..operators import chunking, release
from ..sources.trees import release_pair
from . import query
from .releases import C2, F1, S2, P2, sql

PATHS = ["a/b.txt", "a-b/c.txt", "/etc/passwd", "../up.txt", "a/../b", "", ".", "Foo.txt", "foo.TXT", "CON.txt", "dir/nul", "com1.log/x", "bad:name.txt", "tail./x", "space /x", "x" * 241, "d/" + "é" * 130, "que?", "a\\b", "Straße.txt", "strasse.TXT", "tab\tname", "ok/lpt1x", "nfd/e\u0301.txt", "nfc/\u00e9.txt"]


def _literal(rows: list[tuple], names: list[str]) -> str:
    def show(v):
        if v is None:
            return "NULL"
        if isinstance(v, int) and abs(v) >= 100_000:
            return f"{v}::BIGINT"
        return str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({', '.join(names)}))"


_PATHS_SQL = f"(SELECT * FROM {_literal([(p,) for p in PATHS], ['path'])} UNION ALL SELECT path FROM v2)"
_UNSAFE_SQL = "path = '' OR path = '.' OR starts_with(path, '/') OR list_contains(string_split(path, '/'), '..')"


def _paths(spark, sf):
    return spark.createDataFrame([(p,) for p in PATHS], "path string").unionByName(release_pair(spark, sf)[1].select("path"))


@query(sql(f"SELECT path, {_UNSAFE_SQL} AS unsafe FROM {_PATHS_SQL}"))
def unsafe_paths(spark, sf):
    return _paths(spark, sf).select("path", C.unsafe(F.col("path")).alias("unsafe"))


_RESERVED_SQL = ", ".join(f"'{n}'" for n in C.RESERVED)


@query(
    sql(
        f"""SELECT path, array_to_string(list_filter([
  CASE WHEN regexp_matches(path, '[\\x00-\\x1f]') THEN 'control-character' END,
  CASE WHEN regexp_matches(path, '[<>:"|?*\\\\]') THEN 'reserved-character' END,
  CASE WHEN len([p FOR p IN string_split(path, '/') IF regexp_matches(p, '[ .]$') AND p NOT IN ('.', '..')]) > 0 THEN 'trailing-space-or-dot' END,
  CASE WHEN len([p FOR p IN string_split(path, '/') IF upper(rtrim(string_split(p, '.')[1], ' .')) IN ({_RESERVED_SQL})]) > 0 THEN 'reserved-name' END], lambda x: x IS NOT NULL), ',') AS issues FROM {_PATHS_SQL}"""
    )
)
def path_portability(spark, sf):
    return _paths(spark, sf).select("path", C.portability(F.col("path")).alias("issues"))


@query(sql(f"""SELECT path, array_to_string(list_filter([CASE WHEN nfc_normalize(path) <> path THEN 'not-nfc' END, CASE WHEN length(path) > 240 THEN 'long-path' END,
  CASE WHEN len([p FOR p IN string_split(path, '/') IF octet_length(encode(p)) > 255]) > 0 THEN 'long-component' END], lambda x: x IS NOT NULL), ',') AS warnings FROM {_PATHS_SQL}"""))
def path_warnings(spark, sf):
    return C.portability_warnings(_paths(spark, sf))


@query(sql(f"SELECT path, first_path FROM (SELECT path, first(path) OVER (PARTITION BY lower(path) ORDER BY string_split(path, '/')) AS first_path FROM {_PATHS_SQL}) WHERE path <> first_path"))
def path_collisions(spark, sf):
    return C.collisions(_paths(spark, sf).withColumn("key", F.lower("path")))


@query()
def path_collisions_casefold(spark, sf):
    return C.collisions(C.casefold_keys(_paths(spark, sf)))


# The chunk table with four kinds of damage, by the id's first hex digit.
_ROWS = """rows AS (SELECT chunk_id, CASE WHEN chunk_id LIKE '1%' THEN 'f' || chunk_id ELSE chunk_id END AS raw_hash, CASE WHEN chunk_id LIKE '2%' THEN -1 ELSE raw_len END AS raw_len,
  CASE WHEN chunk_id LIKE '3%' THEN 'pack-9' ELSE 'pack-0' END AS pack_id, CASE WHEN chunk_id LIKE '4%' THEN pack_offset + 1000000000000 ELSE pack_offset END AS pack_offset, raw_len AS pack_len FROM p2)"""


@query(
    sql(C2, S2, P2, _ROWS, "packs AS (SELECT 'pack-0' AS pack_id, sum(raw_len) AS size FROM p2)",
        """SELECT chunk_id, unnest(list_filter([CASE WHEN chunk_id <> raw_hash THEN 'id-is-not-hash' END, CASE WHEN raw_len < 0 OR pack_len < 0 THEN 'negative-length' END, CASE WHEN size IS NULL THEN 'unknown-pack' END,
  CASE WHEN pack_offset < 0 OR pack_offset + pack_len > size THEN 'outside-pack' END], lambda x: x IS NOT NULL)) AS violation FROM rows LEFT JOIN packs USING (pack_id)""")
)
def release_check_chunks(spark, sf):
    stored = release.pack_offsets(release.first_writers(chunking.fixed_chunks(release_pair(spark, sf)[1])))
    first = F.substring("chunk_id", 1, 1)
    rows = stored.select(
        "chunk_id",
        F.when(first == "1", F.concat(F.lit("f"), "chunk_id")).otherwise(F.col("chunk_id")).alias("raw_hash"),
        F.when(first == "2", F.lit(-1)).otherwise(F.col("raw_len")).alias("raw_len"),
        F.when(first == "3", "pack-9").otherwise("pack-0").alias("pack_id"),
        F.when(first == "4", F.col("pack_offset") + 1_000_000_000_000).otherwise(F.col("pack_offset")).alias("pack_offset"),
        F.col("raw_len").alias("pack_len"),
    )
    return C.chunk_violations(rows, stored.agg(F.sum("raw_len").alias("size")).withColumn("pack_id", F.lit("pack-0")))


@query("SELECT o_orderkey, CASE WHEN TIMESTAMP '1996-01-01' < o_orderdate THEN 'not-yet-valid' WHEN TIMESTAMP '1996-01-01' > o_orderdate + INTERVAL 365 DAY THEN 'expired' ELSE 'valid' END AS status FROM orders")
def validity_window(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    begin = F.col("o_orderdate")
    return orders.select("o_orderkey", C.window_status(F.lit("1996-01-01").cast(dict(orders.dtypes)["o_orderdate"]), begin, begin + F.expr("INTERVAL 365 DAYS")).alias("status"))


_SEQ = [(1, None, 0, False), (2, 5, 4, False), (3, 5, 4, True), (4, 5, 5, False), (5, 5, 6, False), (6, None, -1, False)]


@query(f"SELECT id, CASE WHEN target < coalesce(installed, -1) AND NOT allowed THEN 'refused' ELSE 'accepted' END AS verdict FROM {_literal(_SEQ, ['id', 'installed', 'target', 'allowed'])}")
def rollback_guard(spark, sf):
    rows = spark.createDataFrame(_SEQ, "id int, installed int, target int, allowed boolean")
    return rows.select("id", C.rollback(F.col("installed"), F.col("target"), F.col("allowed")).alias("verdict"))


@query("SELECT DISTINCT 'https://' || split_part(url, '/', 3) AS base FROM pages WHERE split_part(url, '/', 3) NOT IN (SELECT 'site' || (n_nationkey % 5) || '.example.com' FROM nation) AND (url LIKE 'http://%' OR url LIKE 'https://%')")
def mirror_allowlist(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").where(F.col("url").rlike("^https?://")).select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    allowed = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("site"), (F.col("n_nationkey") % 5).cast("string"), F.lit(".example.com")).alias("host"))
    return pages.join(allowed, "host", "left_anti").select(F.concat(F.lit("https://"), "host").alias("base")).distinct()


_RESULTS = [(1, True, True, True, "AB", "ab", None), (2, False, True, True, "ab", "ab", None), (3, True, False, None, "ab", "cd", None), (4, True, True, True, None, "cd", "cd"), (5, True, True, True, "cd", "cd", "ee"), (6, True, True, True, "cd", "cd", "CD")]


@query(
    f"""SELECT id, reasons, reasons = '' AS accepted FROM (SELECT id, array_to_string(list_filter([CASE WHEN NOT coalesce(ok, false) THEN 'not-ok' END, CASE WHEN NOT coalesce(digest_ok, false) THEN 'digest-not-ok' END,
  CASE WHEN NOT coalesce(audit_ok, false) THEN 'audit-not-ok' END, CASE WHEN expected IS NULL OR actual IS NULL THEN 'digest-missing' WHEN lower(expected) <> lower(actual) THEN 'digest-differs' END,
  CASE WHEN pinned IS NOT NULL AND lower(pinned) IS DISTINCT FROM lower(actual) THEN 'not-the-pinned-digest' END], lambda x: x IS NOT NULL), ',') AS reasons FROM {_literal(_RESULTS, ['id', 'ok', 'digest_ok', 'audit_ok', 'expected', 'actual', 'pinned'])})"""
)
def provider_policy(spark, sf):
    rows = spark.createDataFrame(_RESULTS, "id int, ok boolean, digest_ok boolean, audit_ok boolean, expected string, actual string, pinned string")
    return C.provider_verdict(rows).select("id", "reasons", "accepted")


_PROFILES = [("plain", 1, "cdc", "auto", None, None, None, None), ("old", 0, "cdc", "auto", None, None, None, None), ("odd", 1, "rabin", "brotli", 10, 5, 20, 1), ("stride", 1, "fastcdc", "zstd", 10, 20, 30, 0), ("big", 1, "fixed", "raw", 70_000, 80_000, 90_000, 4), ("none", None, None, None, 0, None, None, None)]
_PNAMES = ["name", "version", "chunker", "codec", "low", "avg", "high", "stride"]


@query(
    f"""SELECT name, low, avg, high, stride, array_to_string(list_filter([CASE WHEN version IS DISTINCT FROM 1 THEN 'schema-version' END, CASE WHEN NOT coalesce(chunker IN ('fixed', 'cdc', 'fastcdc', 'gear'), false) THEN 'chunker' END,
  CASE WHEN NOT coalesce(codec IN ('auto', 'raw', 'zlib', 'zstd'), false) THEN 'codec' END, CASE WHEN NOT (low > 0 AND low <= avg AND avg <= high) THEN 'sizes' END, CASE WHEN stride <= 0 THEN 'stride' END], lambda x: x IS NOT NULL), ',') AS issues
FROM (SELECT name, version, chunker, codec, coalesce(low, 65536) AS low, coalesce(avg, 262144) AS avg, coalesce(high, 1048576) AS high, coalesce(stride, 16) AS stride FROM {_literal(_PROFILES, _PNAMES)})"""
)
def profile_validation(spark, sf):
    return C.profile_issues(spark.createDataFrame(_PROFILES, "name string, version int, chunker string, codec string, low int, avg int, high int, stride int"))


_MODES = [("quick", "both"), ("large-file", "both"), ("large-file-small", "both"), ("dataset", "fixed"), ("media", "fastcdc")]


@query(f"SELECT name, unnest(CASE WHEN mode <> 'both' THEN [mode] WHEN starts_with(name, 'large-file') THEN ['fixed', 'fastcdc'] ELSE ['fixed', 'cdc'] END) AS chunker FROM {_literal(_MODES, ['name', 'mode'])}")
def profile_modes(spark, sf):
    rows = spark.createDataFrame(_MODES, "name string, mode string")
    modes = F.when(F.col("mode") != "both", F.array("mode")).when(F.col("name").startswith("large-file"), F.array(F.lit("fixed"), F.lit("fastcdc"))).otherwise(F.array(F.lit("fixed"), F.lit("cdc")))
    return rows.select("name", F.explode(modes).alias("chunker"))


@query(sql("needed AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || f AS path FROM v1, (VALUES ('LICENSE'), ('README.md')) AS t(f) UNION ALL SELECT path FROM v1)", "SELECT path FROM needed WHERE path NOT IN (SELECT path FROM v2)"))
def required_files_missing(spark, sf):
    v1, v2 = release_pair(spark, sf)
    extra = v1.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).distinct().select(F.explode(F.array(F.concat("dir", F.lit("/LICENSE")), F.concat("dir", F.lit("/README.md")))).alias("path"))
    return extra.unionByName(v1.select("path")).join(v2.select("path"), "path", "left_anti")


_HINT_SQL = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ('.7z', '.zip', '.rar', '.gz', '.xz', '.bz2', '.zst', '.mp4', '.mkv', '.mov', '.webm', '.mp3', '.aac', '.ogg', '.opus', '.flac', '.jpg', '.jpeg', '.png', '.webp', '.avif', '.heic', '.gif', '.pdf', '.woff', '.woff2')"
_SUFFIXES = ["", ".GZ", ".zip", ".d/x", ".bak", ".tgz", ".pdf", ".aac", ".avi", "/.gz", ".m4a"]
_SUFFIXED = "(SELECT path || suffix AS path, size FROM v2, (VALUES " + ", ".join(f"('{s}')" for s in _SUFFIXES) + ") AS t(suffix))"


def _suffixed(spark, sf):
    return release_pair(spark, sf)[1].select(F.explode(F.array(*[F.concat("path", F.lit(s)) for s in _SUFFIXES])).alias("path"), "size")


@query(sql(f"SELECT path, {_HINT_SQL} AS precompressed FROM {_SUFFIXED}"))
def precompressed_hint(spark, sf):
    return _suffixed(spark, sf).select("path", T.precompressed_hint(F.col("path")).alias("precompressed"))


@query(sql(f"SELECT path, size FROM {_SUFFIXED} WHERE regexp_matches(path, '\\.(txt|md|json|csv|html)$') AND size <= 8192 AND NOT list_contains(string_split(path, '/'), 'moved')"))
def review_candidates(spark, sf):
    p = F.col("path")
    return _suffixed(spark, sf).where(p.rlike(r"\.(txt|md|json|csv|html)$") & (F.col("size") <= 8192) & ~F.array_contains(F.split(p, "/"), "moved"))


@query(sql(f"SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM {_SUFFIXED} WHERE size >= 4096 AND NOT regexp_matches(path, '\\.(txt|md|json|csv)$')"))
def heavy_artifacts(spark, sf):
    rows = _suffixed(spark, sf).where((F.col("size") >= 4096) & ~F.col("path").rlike(r"\.(txt|md|json|csv)$"))
    return rows.agg(F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes"))


@query(sql("SELECT path, CASE WHEN length(path) % 7 = 0 THEN 'expired' WHEN NOT starts_with(path, 'en/') THEN 'outside-prefix' ELSE 'ok' END AS status FROM v2"))
def signed_prefix_check(spark, sf):
    v2 = release_pair(spark, sf)[1]
    expires = F.when(F.length("path") % 7 == 0, 0).otherwise(100)
    return v2.select("path", C.signed_prefix_ok(F.col("path"), F.lit("en/"), expires, F.lit(50)).alias("status"))


@query(sql(F1, "SELECT path || '.tmp-' || k AS path, CASE WHEN size % 5 = 0 THEN 'staging' WHEN size % 5 = 1 THEN 'lock' ELSE 'backup' END AS kind, size > 1000 AS stale FROM f1, (VALUES (1)) AS t(k)"))
def doctor_leftovers(spark, sf):
    f1 = release.file_digests(release_pair(spark, sf)[0])
    kind = F.when(F.col("size") % 5 == 0, "staging").when(F.col("size") % 5 == 1, "lock").otherwise("backup")
    return f1.select(F.concat("path", F.lit(".tmp-1")).alias("path"), kind.alias("kind"), (F.col("size") > 1000).alias("stale"))
