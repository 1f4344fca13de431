"""Chunking, packing, diffing, reading and installing releases of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive, chunking, codec, diff, install, release
from ..operators.chunking import chunk_sql
from ..plans import drivers
from ..sources.ranges import pack_slices
from ..sources.trees import PAIR_SQL, release_pair
from . import query

C1 = f"c1 AS {chunk_sql('v1')}"
C2 = f"c2 AS {chunk_sql('v2')}"
U1 = "u1 AS (SELECT chunk_id, any_value(raw_len) AS raw_len FROM c1 GROUP BY 1)"
U2 = "u2 AS (SELECT chunk_id, any_value(raw_len) AS raw_len FROM c2 GROUP BY 1)"
#: Write order: path components, then offset; the first writer stores a chunk.
S2 = """s2 AS (SELECT chunk_id, raw_len, path AS first_path, file_offset AS first_offset, refs FROM
  (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY string_split(path, '/'), file_offset) AS k, count(*) OVER (PARTITION BY chunk_id) AS refs FROM c2) WHERE k = 1)"""
P2 = """p2 AS (SELECT *, CAST(coalesce(sum(raw_len) OVER (ORDER BY string_split(first_path, '/'), first_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pack_offset FROM s2)"""
F1 = "f1 AS (SELECT path, size, sha256(content) AS file_hash FROM v1)"
F2 = "f2 AS (SELECT path, size, sha256(content) AS file_hash FROM v2)"
FD = """fd AS (SELECT coalesce(f1.path, f2.path) AS path, CASE WHEN f1.path IS NULL THEN 'added' WHEN f2.path IS NULL THEN 'removed' WHEN f1.file_hash = f2.file_hash THEN 'unchanged' ELSE 'changed' END AS status,
  coalesce(f1.size, 0) AS old_size, coalesce(f2.size, 0) AS new_size FROM f1 FULL JOIN f2 ON f1.path = f2.path)"""


def sql(*parts: str) -> str:
    *ctes, last = parts
    return "WITH " + ", ".join([PAIR_SQL, *ctes]) + "\n" + last


def _pair(spark, sf):
    v1, v2 = release_pair(spark, sf)
    return v1, v2, chunking.fixed_chunks(v1), chunking.fixed_chunks(v2)


@query(sql(C2, "SELECT * FROM c2"))
def chunk_fixed(spark, sf):
    return _pair(spark, sf)[3]


@query(sql(C2, "SELECT chunk_id, count(*) AS refs, min(raw_len) AS raw_len FROM c2 GROUP BY 1"))
def chunk_hash(spark, sf):
    return _pair(spark, sf)[3].groupBy("chunk_id").agg(F.count("*").alias("refs"), F.min("raw_len").alias("raw_len"))


@query(sql(C2, "SELECT count(*) AS chunk_refs, CAST(coalesce(min(raw_len), 0) AS BIGINT) AS min_len, CAST(coalesce(sum(raw_len), 0) AS BIGINT) AS total_len, CAST(coalesce(max(raw_len), 0) AS BIGINT) AS max_len, CASE WHEN count(*) > 0 THEN round_even(sum(raw_len) / count(*), 2) ELSE 0.0 END AS avg_len FROM c2"))
def chunk_stats(spark, sf):
    return chunking.chunk_stats(_pair(spark, sf)[3])


@query(sql(C2, "SELECT path, file_offset, raw_len, CAST(coalesce(sum(raw_len) OVER (PARTITION BY path ORDER BY file_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS running_offset FROM c2"))
def file_offsets(spark, sf):
    return release.file_offsets(_pair(spark, sf)[3])


# Content-defined boundaries in SQL: bytes joined to the table of the gear hash, its low bits summed over a sliding window.
_MASK = lambda k: (1 << k) - 1
_GEAR = "gear AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {int(g) & _MASK(9)})" for i, g in enumerate(chunking.gear_table())) + ") AS t(b, g))"
_BYTES = "bytes AS (SELECT path, size, i, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS b FROM (SELECT path, size, hex(content) AS h, unnest(range(0, size)) AS i FROM v2))"
_SUMS = "sums AS (SELECT path, size, i, g, (" + " + ".join(f"coalesce(lag(g, {j}) OVER w, 0) * {1 << j}" for j in range(9)) + ") & 511 AS s FROM bytes JOIN gear USING (b) WINDOW w AS (PARTITION BY path ORDER BY i))"


@query(sql(_GEAR, _BYTES, _SUMS, f"SELECT path, i AS position FROM sums WHERE s & {_MASK(chunking.chunk_bits())} = 0"))
def gear_candidates(spark, sf):
    return chunking.gear_candidates(_pair(spark, sf)[1])


_LOW, _AVG, _HIGH = chunking.CDC_MIN, chunking.CDC_AVG, chunking.CDC_MAX
_K = chunking.chunk_bits()
# One row per file: the values of the table at its bytes, and the candidates of either mask; then the cuts, one by one.
_LISTS = f"""lists AS (SELECT path, any_value(size) AS size, list(g ORDER BY i) AS gs,
  coalesce(list(i ORDER BY i) FILTER (s & {_MASK(_K + 1)} = 0), []) AS strict, coalesce(list(i ORDER BY i) FILTER (s & {_MASK(_K - 1)} = 0), []) AS easy FROM sums GROUP BY path)"""
_NEXT = f"""CASE WHEN size - e <= {_LOW} THEN size ELSE least(size, e + {_HIGH}, coalesce(
   list_min([p + 1 FOR p IN range(e + {_LOW}, least(e + {_LOW} + {_K}, size))
     IF CAST(list_sum([gs[q + 1] * (1 << CAST(p - q AS INTEGER)) FOR q IN range(e + {_LOW}, p + 1)]) AS BIGINT) & {_MASK(_K + 1)} = 0]),
   list_min([p + 1 FOR p IN strict IF p >= e + {_LOW + _K} AND p < e + {_AVG}]),
   list_min([p + 1 FOR p IN easy IF p >= e + {_AVG} AND p < e + {_HIGH}]), size)) END"""

def _cuts_sql(next_cut: str, sums: str, lists: str) -> str:
    cuts = f"""cuts AS (SELECT *, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e FROM lists UNION ALL SELECT * EXCLUDE (s, e), e, CAST({next_cut} AS BIGINT) FROM cuts WHERE e < size)"""
    last = "SELECT c.path, c.s AS file_offset, c.e - c.s AS raw_len, sha256(array_slice(v2.content, c.s + 1, c.e)) AS chunk_id FROM cuts c JOIN v2 ON v2.path = c.path WHERE c.e > 0"
    return "WITH RECURSIVE " + sql(_GEAR, _BYTES, sums, lists, cuts, last)[5:]


@query(_cuts_sql(_NEXT, _SUMS, _LISTS))
def chunk_cdc(spark, sf):
    return chunking.content_chunks(_pair(spark, sf)[1], "cdc")


# The least chunk is longer than the window, so every candidate past it is one for the hash from the chunk's beginning too.
_PLAIN = f"lists AS (SELECT path, any_value(size) AS size, coalesce(list(i ORDER BY i) FILTER (s & {_MASK(_K)} = 0), []) AS clear FROM sums GROUP BY path)"
_PLAIN_NEXT = f"least(size, e + {_HIGH}, coalesce(list_min([p + 1 FOR p IN clear IF p >= e + {_LOW - 1} AND p < e + {_HIGH}]), size))"


@query(_cuts_sql(_PLAIN_NEXT, _SUMS, _PLAIN))
def chunk_gear(spark, sf):
    return chunking.content_chunks(_pair(spark, sf)[1], "gear")


# Strided: the window holds every fourth byte, in the phase of the scan's beginning.
_STRIDE = 4
_STRIDED = _SUMS.replace("lag(g, ", f"lag(g, {_STRIDE} * ")
_STRIDED_NEXT = f"""CASE WHEN size - e <= {_LOW} THEN size ELSE least(size, e + {_HIGH}, coalesce(
   list_min([p + 1 FOR p IN range(e + {_LOW}, least(e + {_LOW} + {_STRIDE * _K}, size), {_STRIDE})
     IF CAST(list_sum([gs[q + 1] * (1 << CAST((p - q) // {_STRIDE} AS INTEGER)) FOR q IN range(e + {_LOW}, p + 1, {_STRIDE})]) AS BIGINT) & {_MASK(_K + 1)} = 0]),
   list_min([p + 1 FOR p IN strict IF p >= e + {_LOW + _STRIDE * _K} AND p < e + {_AVG} AND (p - e - {_LOW}) % {_STRIDE} = 0]),
   list_min([p + 1 FOR p IN easy IF p >= e + {_AVG} AND p < e + {_HIGH} AND (p - e - {_LOW}) % {_STRIDE} = 0]), size)) END"""


@query(_cuts_sql(_STRIDED_NEXT, _STRIDED, _LISTS))
def chunk_fastcdc(spark, sf):
    return chunking.content_chunks(_pair(spark, sf)[1], "fastcdc", stride=_STRIDE)


_FIXED = chunking.Cutting("fixed", fixed_size=chunking.FIXED_SIZE)


@query()
def codec_choice(spark, sf):
    """Stored bytes of the second release's chunks by codec."""
    return codec.choose_codecs(release.stored_chunks(_pair(spark, sf)[1], _FIXED))


@query(sql(C2, S2, "SELECT * FROM s2"))
def chunk_dedup(spark, sf):
    return release.first_writers(_pair(spark, sf)[3])


@query(sql(C2, S2, P2, "SELECT * FROM p2"))
def pack_offsets(spark, sf):
    return release.pack_offsets(release.first_writers(_pair(spark, sf)[3]))


_METRICS = """metrics AS (SELECT * , CASE WHEN logical_size > 0 THEN round_even(stored_bytes / logical_size, 6) ELSE 0.0 END AS storage_ratio FROM
  (SELECT count(*) AS file_count, CAST(coalesce(sum(size), 0) AS BIGINT) AS logical_size FROM v2),
  (SELECT count(*) AS unique_chunks, CAST(coalesce(sum(raw_len), 0) AS BIGINT) AS stored_bytes, CAST(coalesce(sum(refs - 1), 0) AS BIGINT) AS reused_refs FROM s2))"""


@query(sql(C2, S2, _METRICS, "SELECT * FROM metrics"))
def release_metrics(spark, sf):
    _, v2, _, c2 = _pair(spark, sf)
    return release.release_metrics(v2, c2)


@query(sql(C2, S2, _METRICS, "SELECT 'v2' AS release_id, file_count, unique_chunks, stored_bytes, logical_size FROM metrics"))
def inspect_release(spark, sf):
    _, v2, _, c2 = _pair(spark, sf)
    return release.release_metrics(v2, c2).select(F.lit("v2").alias("release_id"), "file_count", "unique_chunks", "stored_bytes", "logical_size")


_FOLD = "(SELECT sha256(string_agg(bucket || ' ' || leaf, chr(10) ORDER BY bucket)) FROM (SELECT substr(sha256({key}), 1, 3) AS bucket, sha256(string_agg({line}, chr(10) ORDER BY {line})) AS leaf FROM {rows} GROUP BY 1))"


@query(sql(F2, C2, U2, f"SELECT *, sha256(files_hash || chr(10) || chunks_hash) AS root_hash FROM (SELECT {_FOLD.format(key='path', line="path || ' ' || size || ' ' || file_hash", rows='f2')} AS files_hash, {_FOLD.format(key='chunk_id', line="chunk_id || ' ' || raw_len", rows='u2')} AS chunks_hash)"))
def root_hash(spark, sf):
    _, v2, _, c2 = _pair(spark, sf)
    return release.root_hash(v2, c2)


@query(sql(F2, "SELECT sha256(string_agg(path || chr(0) || size || chr(0) || file_hash || chr(10), '' ORDER BY string_split(path, '/'))) AS digest, count(*) AS files FROM f2"))
def tree_digest(spark, sf):
    return release.tree_digest(_pair(spark, sf)[1])


@query(sql(F2, "SELECT sha256(string_agg(path || chr(0) || file_hash || chr(10), '' ORDER BY string_split(path, '/'))) AS digest, count(*) AS files FROM f2"))
def tree_digest_nosize(spark, sf):
    return release.tree_digest(_pair(spark, sf)[1], with_size=False)


@query(sql("SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM v2"))
def tree_size(spark, sf):
    return release.tree_size(_pair(spark, sf)[1])


@query(sql(F2, "SELECT 'objects/' || path AS key, size AS bytes, file_hash AS sha256 FROM f2"))
def object_manifest(spark, sf):
    return release.object_manifest(_pair(spark, sf)[1])


@query(sql(F1, F2, "SELECT f1.path, CASE WHEN f2.path IS NULL THEN 'MISSING' WHEN f1.file_hash <> f2.file_hash THEN 'MISMATCH' ELSE 'OK' END AS status FROM f1 LEFT JOIN f2 ON f1.path = f2.path"))
def manifest_verify(spark, sf):
    v1, v2, _, _ = _pair(spark, sf)
    return release.manifest_verify(release.file_digests(v1), v2)


@query(sql(C1, C2, U2, "SELECT * FROM u2 WHERE chunk_id IN (SELECT chunk_id FROM c1)"))
def chunks_reused(spark, sf):
    return diff.chunks_reused(*_pair(spark, sf)[2:])


@query(sql(C1, C2, U2, "SELECT * FROM u2 WHERE chunk_id NOT IN (SELECT chunk_id FROM c1)"))
def chunks_added(spark, sf):
    return diff.chunks_added(*_pair(spark, sf)[2:])


@query(sql(C1, C2, U1, "SELECT * FROM u1 WHERE chunk_id NOT IN (SELECT chunk_id FROM c2)"))
def chunks_removed(spark, sf):
    return diff.chunks_removed(*_pair(spark, sf)[2:])


@query(sql(C1, C2, "SELECT chunk_id FROM c1 INTERSECT SELECT chunk_id FROM c2"))
def set_intersect_chunks(spark, sf):
    _, _, c1, c2 = _pair(spark, sf)
    return c1.select("chunk_id").intersect(c2.select("chunk_id"))


@query(sql("SELECT path FROM v2 EXCEPT SELECT path FROM v1"))
def set_except_paths(spark, sf):
    v1, v2, _, _ = _pair(spark, sf)
    return v2.select("path").subtract(v1.select("path"))


@query(sql(F1, F2, FD, "SELECT * FROM fd"))
def file_diff(spark, sf):
    return diff.file_diff(*_pair(spark, sf)[:2])


_LEFT = lambda whole, part: f"greatest(0, {whole} - {part})"
_RATIO = lambda part, whole, none: f"CASE WHEN {whole} > 0 THEN round_even({part} / {whole}, 6) ELSE {none} END"


# Chunks are stored as they are here, so that SQL can tell the stored bytes.
@query(
    sql(F1, F2, FD, C1, C2, U1, U2, """ch AS (SELECT count(u1.chunk_id) AS old_unique_chunks, count(u2.chunk_id) AS new_unique_chunks, count(*) FILTER (u1.chunk_id IS NOT NULL AND u2.chunk_id IS NOT NULL) AS reused_chunks, count(*) FILTER (u1.chunk_id IS NULL) AS added_chunks,
  count(*) FILTER (u2.chunk_id IS NULL) AS removed_chunks, CAST(coalesce(sum(u2.raw_len) FILTER (u1.chunk_id IS NULL), 0) AS BIGINT) AS down, CAST(coalesce(sum(u2.raw_len), 0) AS BIGINT) AS stored FROM u1 FULL JOIN u2 ON u1.chunk_id = u2.chunk_id),
fl AS (SELECT count(*) FILTER (status = 'added') AS files_added, count(*) FILTER (status = 'removed') AS files_removed, count(*) FILTER (status IN ('added', 'changed')) AS files_changed,
  count(*) FILTER (status = 'unchanged') AS files_unchanged, CAST(coalesce(sum(new_size) FILTER (status IN ('added', 'changed')), 0) AS BIGINT) AS changed_file_bytes, CAST(coalesce(sum(new_size), 0) AS BIGINT) AS logical_size_new FROM fd)""",
    f"""SELECT ch.* EXCLUDE (down, stored), fl.*, down AS download_pack_bytes, down AS download_raw_bytes, stored AS stored_size_new, stored AS raw_unique_size_new, {_RATIO('reused_chunks', 'new_unique_chunks', '1.0')} AS chunk_reuse_ratio,
  {_LEFT('stored', 'down')} AS saved_vs_full_stored, {_RATIO(_LEFT('stored', 'down'), 'stored', '0.0')} AS saved_ratio_vs_full_stored, {_LEFT('changed_file_bytes', 'down')} AS saved_vs_changed_files, {_RATIO(_LEFT('changed_file_bytes', 'down'), 'changed_file_bytes', '1.0')} AS saved_ratio_vs_changed_files,
  {_LEFT('changed_file_bytes', 'down')} AS raw_saved_vs_changed_files, {_RATIO(_LEFT('changed_file_bytes', 'down'), 'changed_file_bytes', '1.0')} AS raw_saved_ratio_vs_changed_files FROM ch, fl""")
)
def diff_summary(spark, sf):
    v1, v2, c1, c2 = _pair(spark, sf)
    return diff.diff_summary(release.file_digests(v1), release.file_digests(v2), diff.stored_raw(c1), diff.stored_raw(c2))


@query()
def diff_summary_packed(spark, sf):
    """The bytes that an update moves as they are stored: cut by content, compressed by the better codec."""
    v1, v2, _, _ = _pair(spark, sf)
    cutting = chunking.Cutting("cdc", min=chunking.CDC_MIN, avg=chunking.CDC_AVG, max=chunking.CDC_MAX)
    old, new = (release.stored_chunks(v, cutting).select("chunk_id", "raw_len", "pack_len") for v in (v1, v2))
    return diff.diff_summary(release.file_digests(v1), release.file_digests(v2), old, new)


# What happened to a document's source between the releases is its scenario; each is an update of its own.
SCENARIO = "CASE source WHEN 'src1' THEN 'removed' WHEN 'src2' THEN 'middle-insert' WHEN 'src3' THEN 'append-only' WHEN 'src4' THEN 'prefix-overwrite' WHEN 'src5' THEN 'rename-move' WHEN 'src6' THEN 'added' ELSE 'unchanged' END"
_BY_SOURCE = "regexp_extract(path, '(src[0-9]+)/', 1)"
_IN = lambda view: f"(SELECT *, {SCENARIO.replace('CASE source', f'CASE {_BY_SOURCE}')} AS scenario FROM {view})"


def _in_scenario(rows):
    return rows.withColumn("scenario", F.expr(SCENARIO.replace("CASE source", f"CASE {_BY_SOURCE}")))


_SCENARIOS = f"""a AS (SELECT scenario, chunk_id, any_value(raw_len) AS raw_len FROM {_IN('c1')} GROUP BY ALL), b AS (SELECT scenario, chunk_id, any_value(raw_len) AS raw_len FROM {_IN('c2')} GROUP BY ALL),
ch AS (SELECT scenario, count(a.chunk_id) FILTER (b.chunk_id IS NOT NULL) AS reused, count(b.chunk_id) AS new_chunks, coalesce(sum(b.raw_len) FILTER (a.chunk_id IS NULL), 0) AS down, coalesce(sum(b.raw_len), 0) AS stored FROM a FULL JOIN b USING (scenario, chunk_id) GROUP BY 1),
fs AS (SELECT scenario, coalesce(sum(size) FILTER (was IS DISTINCT FROM file_hash), 0) AS changed, coalesce(sum(size), 0) AS whole FROM (SELECT scenario, f.path, f.size, f.file_hash, f1.file_hash AS was FROM {_IN('f2')} f LEFT JOIN f1 ON f1.path = f.path) GROUP BY 1),
every AS (SELECT scenario FROM {_IN('f1')} UNION SELECT scenario FROM {_IN('f2')})"""


@query(
    sql(F1, F2, C1, C2, _SCENARIOS, """SELECT scenario, CAST(down AS BIGINT) AS update_bytes, CAST(coalesce(changed, 0) AS BIGINT) AS changed_file_bytes, CAST(coalesce(whole, 0) AS BIGINT) AS full_bytes, CASE WHEN new_chunks > 0 THEN round_even(reused / new_chunks, 6) ELSE 1.0 END AS chunk_reuse_ratio,
  CASE WHEN coalesce(whole, 0) = 0 THEN 'unknown' WHEN 1 - down / whole >= 0.5 THEN 'strong_win' WHEN 1 - down / whole >= 0.1 THEN 'moderate_or_weak_win' WHEN 1 - down / whole > 0 THEN 'near_no_win' ELSE 'regression' END AS class,
  CASE WHEN coalesce(changed, 0) = 0 OR down = 0 THEN 'inconclusive' WHEN down / changed < 0.8::DOUBLE THEN 'win' WHEN down / changed > 1.2::DOUBLE THEN 'loss' ELSE 'near_tie' END AS verdict
FROM every LEFT JOIN ch USING (scenario) LEFT JOIN fs USING (scenario)""")
)
def scenario_bench(spark, sf):
    """Fixed chunks, stored raw, by scenario: bytes of the update against changed files and the whole, and how that is classed."""
    v1, v2, c1, c2 = _pair(spark, sf)
    files = [_in_scenario(release.file_digests(v)) for v in (v1, v2)]
    chunks = [_in_scenario(c).groupBy("scenario", "chunk_id").agg(F.first("raw_len").alias("raw_len")).withColumn("pack_len", F.col("raw_len")) for c in (c1, c2)]
    return drivers.classed(diff.diff_summary(*files, *chunks, by=("scenario",))).select("scenario", "update_bytes", "changed_file_bytes", "full_bytes", "chunk_reuse_ratio", "class", "verdict")


@query()
def plan_bench(spark, sf):
    """Every chunker and codec on every scenario: bytes as they are stored, and the plans that follow from them."""
    v1, v2, _, _ = _pair(spark, sf)
    small = {"fixed_size": chunking.FIXED_SIZE, "min": chunking.CDC_MIN, "avg": chunking.CDC_AVG, "max": chunking.CDC_MAX, "stride": _STRIDE}
    cuttings = [chunking.Cutting(mode, **small) for mode in ("fixed", "cdc", "fastcdc")]
    return drivers.choices(drivers.measure(_in_scenario(v1), _in_scenario(v2), cuttings, ["raw", "auto"], by=("scenario",)), ("scenario",))


# The size of an uncompressed archive: a block for each header, contents in whole blocks, two blocks at the end, in records of twenty.
_TAR = lambda rows: f"(SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(ceil((coalesce(sum(512 + 512 * ((size + 511) // 512)), 0) + 1024) / 10240.0) * 10240 AS BIGINT) AS tar_bytes FROM {rows})"


@query(sql(F1, F2, "changed AS (SELECT f2.* FROM f2 LEFT JOIN f1 ON f1.path = f2.path WHERE f1.file_hash IS DISTINCT FROM f2.file_hash)", f"SELECT 'full' AS kind, * FROM {_TAR('f2')} UNION ALL SELECT 'changed', * FROM {_TAR('changed')}"))
def baseline_tar_sizes(spark, sf):
    v1, v2, _, _ = _pair(spark, sf)
    changed = diff.changed_files(v1, v2).select("path")
    return archive.tar_sizes(v2).select(F.lit("full").alias("kind"), "*").unionByName(archive.tar_sizes(v2.join(changed, "path", "left_semi")).select(F.lit("changed").alias("kind"), "*"))


@query()
def baseline_archive_sizes(spark, sf):
    """Compressed archives of the second release and of its changed files."""
    v1, v2, _, _ = _pair(spark, sf)
    return archive.baseline_sizes(v1, v2)


@query(sql(F1, F2, "SELECT f2.path FROM f2 LEFT JOIN f1 ON f1.path = f2.path WHERE f1.file_hash IS DISTINCT FROM f2.file_hash ORDER BY string_split(f2.path, '/') LIMIT 20"))
def changed_paths_sample(spark, sf):
    return diff.changed_paths_sample(*_pair(spark, sf)[:2])


@query(sql("SELECT path FROM v1 WHERE path NOT IN (SELECT path FROM v2) ORDER BY path LIMIT 20"))
def removed_paths_sample(spark, sf):
    return diff.removed_paths_sample(*_pair(spark, sf)[:2])


@query(sql("SELECT path, v1.size AS old_size, v2.size AS new_size, v2.size - v1.size AS size_delta FROM v1 JOIN v2 USING (path) WHERE v1.size <> v2.size ORDER BY path LIMIT 20"))
def size_changes_sample(spark, sf):
    return diff.size_changes_sample(*_pair(spark, sf)[:2])


@query(sql(F1, F2, "SELECT f2.* FROM f2 LEFT JOIN f1 ON f1.path = f2.path WHERE f1.file_hash IS DISTINCT FROM f2.file_hash"))
def changed_files_raw(spark, sf):
    return diff.changed_files(*_pair(spark, sf)[:2])


@query(sql(F1, F2, FD, "SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'changed' AND old_size <> new_size) AS resized FROM fd"))
def pair_metadata(spark, sf):
    return diff.pair_metadata(*_pair(spark, sf)[:2])


@query(sql(F1, F2, FD, "SELECT *, missing + extra + mismatch = 0 AS equal FROM (SELECT count(*) FILTER (status = 'added') AS missing, count(*) FILTER (status = 'removed') AS extra, count(*) FILTER (status = 'changed') AS mismatch FROM fd)"))
def tree_compare(spark, sf):
    v1, v2, _, _ = _pair(spark, sf)
    return diff.tree_compare(v2, v1)


@query(sql(C1, C2, S2, P2, "SELECT chunk_id, raw_len, pack_offset FROM p2 WHERE chunk_id NOT IN (SELECT chunk_id FROM c1)"))
def patch_plan(spark, sf):
    _, _, c1, c2 = _pair(spark, sf)
    return diff.patch_plan(c1, release.pack_offsets(release.first_writers(c2)))


# A plan with three kinds of damage, by the first hex digit of the chunk id.
_TAMPER = """bad AS (SELECT chunk_id, CASE WHEN chunk_id LIKE 'a%' THEN raw_len + 1 ELSE raw_len END AS raw_len, pack_offset FROM plan
  UNION ALL SELECT * FROM plan WHERE chunk_id LIKE 'b%' UNION ALL SELECT 'z' || chunk_id, raw_len, pack_offset FROM plan WHERE chunk_id LIKE 'c%')"""


@query(
    sql(C1, C2, S2, P2, "plan AS (SELECT chunk_id, raw_len, pack_offset FROM p2 WHERE chunk_id NOT IN (SELECT chunk_id FROM c1))", _TAMPER,
        """SELECT * FROM (SELECT b.chunk_id, CASE WHEN n > 1 THEN 'duplicate' WHEN p2.chunk_id IS NULL THEN 'unknown' WHEN b.raw_len IS DISTINCT FROM p2.raw_len THEN 'differs: raw_len' WHEN b.pack_offset IS DISTINCT FROM p2.pack_offset THEN 'differs: pack_offset' END AS violation
FROM (SELECT chunk_id, count(*) AS n, min(raw_len) AS raw_len, min(pack_offset) AS pack_offset FROM bad GROUP BY 1) b LEFT JOIN p2 ON p2.chunk_id = b.chunk_id) WHERE violation IS NOT NULL""")
)
def patch_plan_violations(spark, sf):
    _, _, c1, c2 = _pair(spark, sf)
    stored = release.pack_offsets(release.first_writers(c2))
    plan = diff.patch_plan(c1, stored)
    a, b, c = (F.col("chunk_id").startswith(x) for x in "abc")
    bad = plan.withColumn("raw_len", F.when(a, F.col("raw_len") + 1).otherwise(F.col("raw_len"))).unionByName(plan.where(b)).unionByName(plan.where(c).withColumn("chunk_id", F.concat(F.lit("z"), "chunk_id")))
    return diff.patch_plan_violations(bad, stored)


@query(sql(C2, S2, P2, "SELECT c2.path, c2.file_offset, c2.raw_len, c2.chunk_id, p2.pack_offset FROM c2 JOIN p2 ON p2.chunk_id = c2.chunk_id"))
def file_chunk_resolve(spark, sf):
    c2 = _pair(spark, sf)[3]
    return install.resolve(c2, release.pack_offsets(release.first_writers(c2)))


@query(sql("SELECT path, size, sha256(content) AS sha256, size AS rebuilt_size FROM v2 WHERE path LIKE '%/src2/%'"))
def extract_member(spark, sf):
    v2 = _pair(spark, sf)[1]
    members = v2.where(F.col("path").contains("/src2/"))
    return install.extract(members, v2)


@query(sql("SELECT path, CAST(o AS BIGINT) AS start, CAST(least(128, size - o) AS BIGINT) AS length, sha256(array_slice(content, o + 1, least(o + 128, size))) AS sha256 FROM (SELECT path, content, size, size // 3 AS o FROM v2) WHERE size > o"))
def pack_range_read(spark, sf):
    return pack_slices(_pair(spark, sf)[1], F.floor(F.col("size") / 3), 128)


_AUDIT = """SELECT coalesce(f2.path, f1.path) AS path, CASE WHEN f1.path IS NULL THEN 'missing' WHEN f2.path IS NULL THEN 'extra' WHEN f1.size <> f2.size THEN 'size-mismatch' WHEN f1.file_hash <> f2.file_hash THEN 'hash-mismatch' ELSE 'ok' END AS status FROM f2 FULL JOIN f1 ON f1.path = f2.path"""


@query(sql(F1, F2, _AUDIT))
def audit_install(spark, sf):
    v1, v2, _, _ = _pair(spark, sf)
    return install.audit(release.file_digests(v2), v1)


@query(sql(C1, C2, U1, "SELECT * FROM u1 WHERE chunk_id IN (SELECT chunk_id FROM c2)"))
def seed_cache(spark, sf):
    _, _, c1, c2 = _pair(spark, sf)
    return install.seed_cache(c1, c2)


# The cache holds what the old release has, but for ids beginning with 0, which were lost.
_CACHE = "cache AS (SELECT chunk_id, raw_len FROM u1 WHERE chunk_id NOT LIKE '0%')"


@query(sql(C1, C2, U1, U2, _CACHE, "SELECT chunk_id, raw_len FROM u2 WHERE chunk_id NOT IN (SELECT chunk_id FROM cache)"))
def fetch_missing(spark, sf):
    _, _, c1, c2 = _pair(spark, sf)
    return install.missing(c2, diff.unique_chunks(c1).where("chunk_id not like '0%'"))


@query(sql(C1, C2, U1, U2, _CACHE, "SELECT count(*) AS required, count(*) FILTER (h) AS hits, count(*) FILTER (NOT h) AS downloaded, CAST(coalesce(sum(raw_len) FILTER (h), 0) AS BIGINT) AS hit_bytes, CAST(coalesce(sum(raw_len) FILTER (NOT h), 0) AS BIGINT) AS downloaded_bytes FROM (SELECT u2.*, chunk_id IN (SELECT chunk_id FROM cache) AS h FROM u2)"))
def fetch_accounting(spark, sf):
    _, _, c1, c2 = _pair(spark, sf)
    return install.fetch_accounting(c2, diff.unique_chunks(c1).where("chunk_id not like '0%'"))


@query(sql(C2, "SELECT chunk_id, first_path, first_offset, row_number() OVER (ORDER BY string_split(first_path, '/'), first_offset) AS ordinal FROM (SELECT chunk_id, path AS first_path, file_offset AS first_offset, row_number() OVER (PARTITION BY chunk_id ORDER BY string_split(path, '/'), file_offset) AS k FROM c2) WHERE k = 1"))
def first_seen_chunks(spark, sf):
    return install.first_seen(release.first_writers(_pair(spark, sf)[3]))


# Cached files by claimed id: content of one document in seven was damaged, some names aren't ids.
_FILES = """entries AS (SELECT CASE WHEN source = 'src7' THEN 'tmp-' || path WHEN source = 'src8' THEN sha256(content || encode('x')) ELSE sha256(content) END AS name, content, octet_length(content) AS size FROM docs_)"""


@query(sql(_FILES, "SELECT CASE WHEN NOT regexp_full_match(name, '[0-9a-fA-F]{64}') THEN 'not-a-chunk-name' WHEN sha256(content) <> lower(name) THEN 'sha256-mismatch' ELSE 'ok' END AS status, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM entries GROUP BY 1"))
def cache_index(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".txt")))
    name = F.when(F.col("source") == "src7", F.concat(F.lit("tmp-"), path)).when(F.col("source") == "src8", F.sha2(F.concat(body, F.encode(F.lit("x"), "UTF-8")), 256)).otherwise(F.sha2(body, 256))
    return install.cache_index(docs.select(name.alias("name"), body.alias("content")))


@query(sql(C1, F2, "SELECT count(*) AS missing_refs, count(DISTINCT chunk_id) AS missing_chunks FROM (SELECT c1.chunk_id FROM c1 WHERE chunk_id NOT IN (SELECT chunk_id FROM (SELECT * FROM " + chunk_sql("v2") + "))) x"))
def verify_missing_chunks(spark, sf):
    _, _, c1, c2 = _pair(spark, sf)
    return install.missing_references(c1, c2)
