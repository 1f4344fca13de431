"""Scalar functions, over literals and whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import query
from .checks import _literal

SIZES = ["64KiB", "1.5 MiB", "2gb", "100", "7b", " 3 kb ", "0.5GiB", "12 xb", "", "KiB", "250MB", "1e3", "1.5", "1 000", "-5", "1e3 kb", ".5kib", "-1.5b", "5.KB", "\t9 mb"]
_SIZE_RE = "^([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:e[+-]?[0-9]+)?)([kmg]i?b|b)$"


@query(f"""SELECT text, coalesce(CASE WHEN regexp_matches(t, '{_SIZE_RE}') THEN CAST(trunc(CAST(regexp_extract(t, '{_SIZE_RE}', 1) AS DOUBLE) * CASE regexp_extract(t, '{_SIZE_RE}', 2) WHEN 'kib' THEN 1024 WHEN 'mib' THEN 1048576 WHEN 'gib' THEN 1073741824 WHEN 'kb' THEN 1000 WHEN 'mb' THEN 1000000 WHEN 'gb' THEN 1000000000 ELSE 1 END) AS BIGINT)
 WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN CAST(t AS BIGINT) END, -1) AS bytes FROM (SELECT text, replace(lower(trim(text, ' ' || chr(9))), ' ', '') AS t FROM {_literal([(s,) for s in SIZES], ['text'])})""")
def parse_size(spark, sf):
    return spark.createDataFrame([(s,) for s in SIZES], "text string").select("text", F.coalesce(T.parse_size(F.col("text")), F.lit(-1)).alias("bytes"))


RATIOS = ["1%,10%, 50%", "0.25,,0.5", "", "100%", " 5 % "]


@query(f"SELECT text, coalesce(list_sum(r), 0.0::DOUBLE) AS total, len(r) AS n FROM (SELECT text, [CASE WHEN ends_with(trim(p), '%') THEN CAST(trim(replace(p, '%', '')) AS DOUBLE) / 100 ELSE CAST(trim(p) AS DOUBLE) END FOR p IN string_split(text, ',') IF trim(p) <> ''] AS r FROM {_literal([(s,) for s in RATIOS], ['text'])})")
def parse_ratio_list(spark, sf):
    rows = spark.createDataFrame([(s,) for s in RATIOS], "text string").withColumn("r", T.parse_ratios("text"))
    return rows.select("text", F.aggregate("r", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("r").cast("bigint").alias("n"))


_CASTS = ["12", " 7 ", "x", "", "3.5", None]


@query(f"SELECT coalesce(text, '(none)') AS text, coalesce(TRY_CAST(trim(text) AS DOUBLE), -1.0::DOUBLE) AS number FROM {_literal([(s,) for s in _CASTS], ['text'])}")
def safe_cast(spark, sf):
    rows = spark.createDataFrame([(s,) for s in _CASTS], "text string")
    return rows.select(F.coalesce("text", F.lit("(none)")).alias("text"), T.safe_cast(F.col("text"), "double", -1.0).alias("number"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents")
def replace_count(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.replace_count(F.col("text"), "the").alias("n"))




# Reports with thousands commas, fractions, a repeated line, one without a number, and other lines.
@query("""SELECT o_orderkey, CAST(o_orderkey % 1000 AS DOUBLE) AS number_of_files, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 7.0 END::DOUBLE AS created, CAST(o_custkey AS DOUBLE) AS total_bytes_sent, 1234.0::DOUBLE AS total_bytes_received, 0.25::DOUBLE AS seconds, CAST(o_custkey + 1234 AS BIGINT) AS network_bytes_total FROM orders""")
def kv_stats_parse(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    report = F.concat(
        F.lit("Number of files: 5 (reg: 3)\nNumber of files: "),
        (F.col("o_orderkey") % 1000).cast("string"),
        F.lit(" (reg: 1)\nNumber of created files: "),
        F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise("7 (reg: 7)"),
        F.lit("\n\nFile list generation time: 0.250 seconds\n  Total bytes sent: "),
        F.format_number(F.col("o_custkey"), 0),
        F.lit("\nno number here\nTotal bytes received: 1,234\n\nsent 99 bytes  received 98 bytes  394.00 bytes/sec\ntotal size is 9: speedup 1\n"),
    )
    got = o.select("o_orderkey", T.kv_stats(report).alias("m"))
    return got.select("o_orderkey", "m.number_of_files", F.col("m.number_of_created_files").alias("created"), "m.total_bytes_sent", "m.total_bytes_received", F.col("m.file_list_generation_time").alias("seconds"), "m.network_bytes_total")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.metrics.k'), json_extract_string(props, '$.k'), json_extract_string(props, '$.page'), 'none') AS value FROM events")
def json_path_coalesce(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.coalesce(T.json_first(F.col("props"), "$.metrics.k", "$.k", "$.page"), F.lit("none")).alias("value"))


# Sizes from bytes to TiB, of either sign and unknown.
@query("""SELECT doc_id, k, CASE WHEN n IS NULL THEN '0 B' WHEN abs(n) >= 1099511627776 THEN printf('%.2f TiB', n / 1099511627776.0::DOUBLE) WHEN abs(n) >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0::DOUBLE)
 WHEN abs(n) >= 1048576 THEN printf('%.2f MiB', n / 1048576.0::DOUBLE) WHEN abs(n) >= 1024 THEN printf('%.2f KiB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS shown
FROM (SELECT doc_id, k, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE n_chars * (1 - 2 * (doc_id % 2)) * CAST(pow(1024, k) AS BIGINT) END AS n FROM documents, range(0, 5) AS t(k))""")
def fmt_bytes(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("k"))
    n = F.when(F.col("doc_id") % 50 != 0, F.col("n_chars") * (1 - 2 * (F.col("doc_id") % 2)) * F.pow(F.lit(1024), "k").cast("bigint"))
    return d.select("doc_id", "k", T.fmt_bytes(n).alias("shown"))


@query("SELECT p_partkey, CASE WHEN x IS NULL OR abs(x) < 0.000001::DOUBLE THEN '0' WHEN abs(x) < 1 THEN printf('%.6f', x) ELSE printf('%.3f', x) END || ' USD' AS shown FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_size / 32.0::DOUBLE - 0.25 END AS x FROM part)")
def fmt_cost(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", T.fmt_cost(F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") / F.lit(32.0) - 0.25)).alias("shown"))


@query("SELECT event_id, replace(props, '\"k\": 1', '\"k\": one') AS props, replace(props, 'k', 'k\\\"q') AS quoted FROM events")
def json_string_rewrite(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.replace("props", F.lit('"k": 1'), F.lit('"k": one')).alias("props"), T.replace_strings(F.col("props"), "k", 'k"q').alias("quoted"))
