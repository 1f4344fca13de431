"""Fetch attempts (the events as a log), retries, and the chunk cache as a log of touches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import install, network
from . import query
from .checks import _literal

#: Attempts: an event's type is its mirror, its value in whole units its bytes, a whole multiple of seven a failure.
LOG = """log AS (SELECT event_id AS ordinal, ts, 'https://' || event_type || '.example.com' AS mirror, CAST(floor(coalesce(value, 0)) AS BIGINT) AS bytes, event_id % 7 <> 0 AS ok, user_id % 5 = 0 AS hedged,
  CASE WHEN event_id % 7 = 0 THEN 'HTTP ' || CAST(500 + user_id % 5 AS VARCHAR) END AS error, user_id FROM events)"""


def _log(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    bad = F.col("event_id") % 7 == 0
    return e.select(
        F.col("event_id").alias("ordinal"),
        "ts",
        F.concat(F.lit("https://"), "event_type", F.lit(".example.com")).alias("mirror"),
        F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint").alias("bytes"),
        (~bad).alias("ok"),
        (F.col("user_id") % 5 == 0).alias("hedged"),
        F.when(bad, F.concat(F.lit("HTTP "), (500 + F.col("user_id") % 5).cast("string"))).alias("error"),
        "user_id",
    )


_SCORE = """score AS (SELECT mirror, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes_requested, count(*) FILTER (hedged) AS hedged_attempts,
  arg_max(error, (ts, ordinal)) FILTER (NOT ok) AS last_error, count(*) FILTER (ok) - count(*) FILTER (NOT ok) AS score, count(*) FILTER (NOT ok) >= {0} AS blacklisted,
  greatest(0, count(*) FILTER (NOT ok) - {0} + 1) AS blacklist_events, CASE WHEN count(*) FILTER (NOT ok) >= {0} THEN max(ts) FILTER (NOT ok) + INTERVAL 60 SECOND END AS blacklisted_until FROM log GROUP BY mirror)"""
_HALF = "(SELECT count(*) // 40 FROM events)"


@query(f"WITH {LOG}, {_SCORE.format(3)} SELECT * FROM score")
def mirror_scorecard(spark, sf):
    return network.scorecard(_log(spark, sf))


_MIRRORS = """mirrors AS (SELECT mirror || '/packs/p-' || ordinal AS url, ordinal FROM log UNION ALL SELECT mirror || '/', ordinal + 1 FROM log)"""


@query(f"WITH {LOG}, {_SCORE.format(100)}, {_MIRRORS} SELECT mirror, ordinal, blacklisted, row_number() OVER (ORDER BY blacklisted, ordinal) AS position FROM (SELECT m.mirror, m.ordinal, coalesce(s.blacklisted, false) AS blacklisted FROM (SELECT rtrim(split_part(url, '/packs/', 1), '/') AS mirror, min(ordinal) AS ordinal FROM mirrors GROUP BY 1) m LEFT JOIN score s ON s.mirror = m.mirror)")
def mirror_candidates(spark, sf):
    log = _log(spark, sf)
    urls = log.select(F.concat("mirror", F.lit("/packs/p-"), F.col("ordinal").cast("string")).alias("url"), "ordinal").unionByName(log.select(F.concat("mirror", F.lit("/")).alias("url"), (F.col("ordinal") + 1).alias("ordinal")))
    return network.candidates(urls, network.scorecard(log, 100))


@query(f"WITH {LOG} SELECT count(*) AS requests, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (hedged) AS hedged, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, count(DISTINCT mirror) AS mirrors FROM log")
def network_stats(spark, sf):
    return network.counters(_log(spark, sf))


_REQUESTS = """requests AS (SELECT ['GET', 'HEAD', 'RANGE'][1 + user_id % 3] AS op, 1 + event_id % 3 AS attempt, event_id % 7 <> 0 AS ok, event_id % 3 = 2 AS last, user_id % 2 = 0 AS tag_sent, event_id % 5 <> 0 AS tag_seen, CAST(floor(coalesce(value, 0)) AS BIGINT) AS bytes FROM events)"""


@query(f"""WITH {_REQUESTS} SELECT count(*) FILTER (op = 'GET') AS full_get_requests, count(*) FILTER (op = 'HEAD') AS head_requests, count(*) FILTER (op = 'RANGE') AS range_requests,
  count(*) FILTER (op = 'RANGE' AND NOT ok AND NOT last) AS range_retries, count(*) FILTER (op = 'GET' AND NOT ok AND NOT last) AS full_get_retries, count(*) FILTER (op = 'RANGE' AND NOT ok AND last) AS range_failures, count(*) FILTER (op = 'GET' AND NOT ok AND last) AS full_get_failures,
  count(*) FILTER (op = 'RANGE' AND tag_sent) AS if_range_used, count(*) FILTER (op = 'HEAD' AND ok AND tag_seen) AS etag_observed, CAST(sum(bytes) FILTER (ok) AS BIGINT) AS bytes_received FROM requests""")
def request_counters(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = F.col("event_id")
    rows = e.select(F.get(F.array(F.lit("GET"), F.lit("HEAD"), F.lit("RANGE")), (F.col("user_id") % 3).cast("int")).alias("op"), (1 + n % 3).alias("attempt"), (n % 7 != 0).alias("ok"), (n % 3 == 2).alias("last"), (F.col("user_id") % 2 == 0).alias("tag_sent"), (n % 5 != 0).alias("tag_seen"), F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint").alias("bytes"))
    return network.request_counters(rows)


@query("SELECT user_id, count(*) AS file_count, count(*) FILTER (good) AS ok_count, CAST(coalesce(sum(expected) FILTER (good), 0) AS BIGINT) AS downloaded_bytes, count(*) = count(*) FILTER (good) AS ok FROM (SELECT user_id, length(props) AS expected, event_id % 50 <> 0 AND event_id % 70 <> 1 AS good FROM events) GROUP BY 1")
def full_download_baseline(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    n, size = F.col("event_id"), F.length("props").cast("bigint")
    return network.full_download(e.select("user_id", (n % 50 != 0).alias("ok"), F.when(n % 70 == 1, size - 1).otherwise(size).alias("bytes"), size.alias("expected")), ["user_id"])


_PROBES = [("sync", 1, "sync-a", False, None), ("sync", 2, "sync-b", True, "3.2"), ("sync", 3, "sync-c", True, "3.3"), ("delta", 1, "delta", False, None), ("pack", 1, "pack", True, "1.0"), ("none", 2, "b", False, "x"), ("none", 1, "a", False, None)]
_PROBE_NAMES = ["tool", "ordinal", "executable", "found", "version"]


@query(f"SELECT tool, bool_or(found) AS installed, arg_min(executable, (NOT found, ordinal)) AS executable, coalesce(arg_min(coalesce(version, ''), (NOT found, ordinal)), '') AS version FROM {_literal(_PROBES, _PROBE_NAMES)} GROUP BY 1")
def tool_probe(spark, sf):
    return network.probe_rollup(spark.createDataFrame(_PROBES, "tool string, ordinal int, executable string, found boolean, version string"))


# A priority's orders are gates of its readiness: one that is pending wasn't answered, a dear one isn't ok.
@query("SELECT o_custkey, bool_and(good) AS ok, coalesce(string_agg(DISTINCT gate, ',' ORDER BY gate) FILTER (NOT good), '') AS failed FROM (SELECT o_custkey, o_orderpriority AS gate, o_orderstatus <> 'P' AND o_totalprice < 180000 AS good FROM orders) GROUP BY 1")
def readiness_gates(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return network.gates(o.select("o_custkey", F.col("o_orderpriority").alias("gate"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") < 180_000).alias("ok")), ["o_custkey"])


_TRIED = [(1, 1, False, "Resource is unwritable"), (1, 2, False, "request timed out"), (1, 3, True, None), (1, 4, True, None), (2, 1, False, "no such bucket"), (2, 2, True, None), (3, 1, False, "server BUSY"), (3, 2, False, "busy"), (3, 3, False, "busy"), (3, 4, False, "busy"), (3, 5, True, None), (4, 1, True, None), (5, 1, False, None), (5, 2, True, None)]


@query(f"""WITH t AS (SELECT *, ok OR NOT regexp_matches(lower(coalesce(error, '')), 'unwritable|reduce your request rate|temporarily|timeout|timed out|connection refused|busy') AS stops FROM {_literal(_TRIED, ['run', 'attempt', 'ok', 'error'])})
SELECT run, attempt, ok, (attempt - 1) * 2.0::DOUBLE AS wait, CASE WHEN attempt > 1 THEN '-r' || attempt ELSE '' END AS suffix, coalesce(error, '') AS error FROM t a WHERE attempt <= 4 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.run = a.run AND b.attempt < a.attempt AND b.stops)""")
def attach_retry(spark, sf):
    return network.attach_retries(spark.createDataFrame(_TRIED, "run int, attempt int, ok boolean, error string"))


@query(f"WITH {LOG} SELECT *, status = 206 AS partial FROM (SELECT CAST(CASE WHEN NOT ok THEN 500 + user_id % 5 WHEN bytes % 2 = 0 THEN 206 ELSE 200 END AS BIGINT) AS status, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM log GROUP BY 1)")
def http_status_counts(spark, sf):
    status = F.when(~F.col("ok"), 500 + F.col("user_id") % 5).when(F.col("bytes") % 2 == 0, 206).otherwise(200).cast("bigint")
    return network.http_status(_log(spark, sf).select(status.alias("status"), "bytes"))


@query(f"""WITH {LOG}, r AS (SELECT mirror, user_id, ordinal, epoch_us(ts) AS now_us, bytes * 1000 AS cost FROM log),
d AS (SELECT *, sum(cost) OVER w AS d FROM r WINDOW w AS (PARTITION BY mirror, user_id ORDER BY now_us, ordinal ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, d + max(now_us - d + cost) OVER (PARTITION BY mirror, user_id ORDER BY now_us, ordinal ROWS UNBOUNDED PRECEDING) AS free FROM d)
SELECT mirror, user_id, ordinal, now_us, cost, CAST(free AS BIGINT) AS free, CAST(free - cost - now_us AS BIGINT) AS wait FROM f""")
def token_bucket(spark, sf):
    rows = _log(spark, sf).select("mirror", "user_id", "ordinal", F.unix_micros(F.col("ts").cast("timestamp")).alias("now_us"), (F.col("bytes") * 1000).alias("cost"))
    return network.token_bucket(rows, ["mirror", "user_id"])


@query("SELECT o_orderkey AS request, CAST(a AS INTEGER) AS attempt, 0.25::DOUBLE AS backoff, 0.25 * pow(2.0, a - 1) AS wait, sum(0.25 * pow(2.0, a - 1)) OVER (PARTITION BY o_orderkey ORDER BY a) AS waited FROM orders, range(1, 6) AS t(a)")
def retry_backoff(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("request"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempt"), F.lit(0.25).alias("backoff"))
    return network.backoff_schedule(rows)


_TOUCH = """touch AS (SELECT 'chunk-' || user_id || '-' || event_type AS chunk_id, CAST(floor(coalesce(value, 0)) AS BIGINT) AS raw_len, epoch(ts)::BIGINT AS last_used FROM events)"""
_INDEX = "idx AS (SELECT chunk_id, arg_max(raw_len, (last_used, raw_len)) AS raw_len, max(last_used) AS last_used FROM touch GROUP BY 1)"


def _touches(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.concat_ws("-", F.lit("chunk"), F.col("user_id").cast("string"), "event_type").alias("chunk_id"), F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint").alias("raw_len"), F.expr("floor(unix_micros(cast(ts as timestamp)) / 1000000)").cast("bigint").alias("last_used"))


@query(f"WITH {_TOUCH.replace('epoch(ts)::BIGINT', 'epoch_us(ts) // 1000000')}, {_INDEX} SELECT * FROM idx")
def cache_upsert(spark, sf):
    touches = _touches(spark, sf)
    return install.cache_upsert(touches, touches)


@query(f"WITH {_TOUCH.replace('epoch(ts)::BIGINT', 'epoch_us(ts) // 1000000')}, {_INDEX} SELECT chunk_id, raw_len, last_used FROM (SELECT *, sum(raw_len) OVER () - coalesce(sum(raw_len) OVER (ORDER BY last_used, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM idx) WHERE rest > 5000")
def cache_gc(spark, sf):
    touches = _touches(spark, sf)
    return install.cache_gc(install.cache_upsert(touches, touches), 5000)
