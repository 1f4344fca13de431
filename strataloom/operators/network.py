"""Fetch attempts as facts: scorecards, counters, retry schedules and the token bucket as window passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLACKLIST_AFTER, BLACKLIST_SECONDS = 3, 60


def scorecard(attempts: DataFrame, blacklist_after: int = BLACKLIST_AFTER, seconds: int = BLACKLIST_SECONDS) -> DataFrame:
    """attempts(mirror, ts, ok, bytes, hedged, error, ordinal) by mirror; the last error is the latest one's.

    From its blacklist_after-th failure on, each failure blacklists a mirror until `seconds` after it; 0 means never.
    """
    failed = F.struct("ts", "ordinal", "error")
    out = attempts.groupBy("mirror").agg(
        F.count("*").alias("attempts"),
        F.count_if("ok").alias("successes"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes_requested"),
        F.count_if("hedged").alias("hedged_attempts"),
        F.max(F.when(~F.col("ok"), failed)).alias("_last"),
    )
    over = (F.col("failures") >= blacklist_after) & F.lit(blacklist_after > 0)
    return out.select(
        *out.columns[:-1],
        F.col("_last.error").alias("last_error"),
        (F.col("successes") - F.col("failures")).alias("score"),
        over.alias("blacklisted"),
        F.when(over, F.col("failures") - blacklist_after + 1).otherwise(0).cast("bigint").alias("blacklist_events"),
        F.when(over, F.col("_last.ts") + F.expr(f"interval {max(0, seconds)} seconds")).alias("blacklisted_until"),
    )


def candidates(mirrors: DataFrame, scores: DataFrame) -> DataFrame:
    """Order in which mirrors(url, ordinal) are tried: each address once, blacklisted ones last but never dropped."""
    base = F.regexp_replace(F.substring_index("url", "/packs/", 1), "/+$", "")
    once = mirrors.select(base.alias("mirror"), "ordinal").groupBy("mirror").agg(F.min("ordinal").alias("ordinal"))
    joined = once.join(scores.select("mirror", "blacklisted"), "mirror", "left").withColumn("blacklisted", F.coalesce("blacklisted", F.lit(False)))
    return joined.withColumn("position", F.row_number().over(Window.orderBy("blacklisted", "ordinal")).cast("bigint"))  # a release's few mirrors


def counters(attempts: DataFrame) -> DataFrame:
    return attempts.agg(F.count("*").alias("requests"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("hedged").alias("hedged"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"), F.countDistinct("mirror").alias("mirrors"))


def request_counters(requests: DataFrame) -> DataFrame:
    """requests(op, attempt, ok, last, tag_sent, tag_seen, bytes), op being GET, HEAD or RANGE: the counters of a fetch, one row.

    An attempt that failed and isn't the last is a retry to come, one that is the last is a failure.
    """
    is_op = lambda op: F.col("op") == op
    again, lost = ~F.col("ok") & ~F.col("last"), ~F.col("ok") & F.col("last")
    return requests.agg(
        F.count_if(is_op("GET")).alias("full_get_requests"),
        F.count_if(is_op("HEAD")).alias("head_requests"),
        F.count_if(is_op("RANGE")).alias("range_requests"),
        F.count_if(is_op("RANGE") & again).alias("range_retries"),
        F.count_if(is_op("GET") & again).alias("full_get_retries"),
        F.count_if(is_op("RANGE") & lost).alias("range_failures"),
        F.count_if(is_op("GET") & lost).alias("full_get_failures"),
        F.count_if(is_op("RANGE") & F.col("tag_sent")).alias("if_range_used"),
        F.count_if(is_op("HEAD") & F.col("ok") & F.col("tag_seen")).alias("etag_observed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes_received"),
    )


def full_download(results: DataFrame, by: list[str]) -> DataFrame:
    """results(*by, ok, bytes, expected) of whole downloads: what counts are those that came whole; ok if all did and there are any."""
    whole = F.coalesce(F.col("ok") & (F.col("bytes") == F.col("expected")), F.lit(False))
    out = results.groupBy(*by).agg(F.count("*").alias("file_count"), F.count_if(whole).alias("ok_count"), F.coalesce(F.sum(F.when(whole, F.col("bytes"))), F.lit(0)).cast("bigint").alias("downloaded_bytes"))
    return out.withColumn("ok", (F.col("file_count") > 0) & (F.col("ok_count") == F.col("file_count")))


def probe_rollup(probes: DataFrame) -> DataFrame:
    """probes(tool, ordinal, executable, found, version) by tool: installed if any was found, and the first found or else the first."""
    best = F.min(F.struct((~F.col("found")).alias("missing"), "ordinal", "executable", "version"))
    return probes.groupBy("tool").agg(F.bool_or("found").alias("installed"), best.alias("b")).select("tool", "installed", F.col("b.executable").alias("executable"), F.coalesce("b.version", F.lit("")).alias("version"))


def gates(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(*by, gate, ok): ok if every gate is; a gate without an answer isn't."""
    good = F.coalesce("ok", F.lit(False))
    return rows.groupBy(*by).agg(F.bool_and(good).alias("ok"), F.array_join(F.array_sort(F.collect_set(F.when(~good, F.col("gate")))), ",").alias("failed"))


# What an error says that another attempt may not meet.
TRANSIENT = ["unwritable", "reduce your request rate", "temporarily", "timeout", "timed out", "connection refused", "busy"]


def transient(error: Column) -> Column:
    text = F.lower(F.coalesce(error, F.lit("")))
    found = F.lit(False)
    for term in TRANSIENT:
        found = found | text.contains(term)
    return found


def attach_retries(runs: DataFrame, most: int = 4, backoff: float = 2.0) -> DataFrame:
    """runs(run, attempt, ok, error): the attempts that are made, one after the other, with the wait before each and its bucket's suffix.

    Another attempt follows one that failed for a transient reason, up to `most`; the wait grows by `backoff` each time.
    """
    before = Window.partitionBy("run").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    stops = F.col("ok") | ~transient(F.col("error"))
    made = runs.withColumn("_stopped", F.coalesce(F.max(stops).over(before), F.lit(False))).where(~F.col("_stopped") & (F.col("attempt") <= most))
    wait = F.when(F.col("attempt") > 1, (F.col("attempt") - 1) * F.lit(float(backoff))).otherwise(0.0)
    suffix = F.when(F.col("attempt") > 1, F.concat(F.lit("-r"), F.col("attempt").cast("string"))).otherwise("")
    return made.select("run", "attempt", "ok", wait.alias("wait"), suffix.alias("suffix"), F.coalesce("error", F.lit("")).alias("error"))


def backoff_schedule(rows: DataFrame) -> DataFrame:
    """rows(request, attempt, backoff): the wait before each attempt and the waits so far, in exact binary fractions."""
    wait = F.col("backoff") * F.pow(F.lit(2.0), F.col("attempt") - 1)
    so_far = Window.partitionBy("request").orderBy("attempt")
    return rows.withColumn("wait", wait).withColumn("waited", F.sum(wait).over(so_far))


def token_bucket(requests: DataFrame, by: list[str]) -> DataFrame:
    """requests(*by, now_us, ordinal, cost): when each may go, `now_us` and `cost` in the same whole unit of time.

    free_i = max(now_i, free_{i-1}) + cost_i is a maximum of prefix sums: D_i + max over j <= i of (now_j - D_{j-1}).
    """
    order = Window.partitionBy(*by).orderBy("now_us", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    spent = requests.withColumn("_d", F.sum("cost").over(order))
    lead = F.max(F.col("now_us") - F.col("_d") + F.col("cost")).over(order)
    out = spent.withColumn("free", F.col("_d") + lead)
    return out.withColumn("wait", F.col("free") - F.col("cost") - F.col("now_us")).drop("_d")


def http_status(log: DataFrame) -> DataFrame:
    """Requests and bytes by status; partial answers apart from whole ones."""
    return log.groupBy("status").agg(F.count("*").alias("requests"), F.sum("bytes").cast("bigint").alias("bytes")).withColumn("partial", F.col("status") == 206)
