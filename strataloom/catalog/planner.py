"""Policies over candidate plans. Bytes and seconds are data: the orders' lines give volumes, literals the candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import policy as P
from . import query
from .checks import _literal

PLANS = [
    (1, "zstd:fixed", False, 52_000_000, 3.5), (2, "zstd:cdc", False, 41_000_000, 9.25), (3, "auto:fastcdc", False, 41_000_000, 6.5), (4, "raw:fixed", False, 160_000_000, 1.25),
    (5, "zlib:cdc", False, 43_000_000, 12.0), (6, "none:same", False, 0, 0.5), (7, "archive:full", True, 210_000_000, 2.0), (8, "archive:changed", True, 47_000_000, 4.0), (9, "sync:rolling", True, 45_500_000, None),
    (10, "raw:cdc", False, 41_500_000, None), (11, "sync:delta", True, None, None), (12, "dry:fixed", False, 42_000_000, 0.0),  # untimed, unmeasured, no time taken
]
RUNS = [(1, "fixed", 300_000_000, 4.0), (2, "cdc", 280_000_000, 9.0), (3, "fastcdc-small", 281_000_000, 5.0), (4, "fastcdc-large", 600_000_000, 3.0), (5, "large-file-untimed", 290_000_000, None)]
PLAN_SQL = _literal(PLANS, ["ordinal", "plan", "external", "bytes", "seconds"])
RUN_SQL = _literal(RUNS, ["ordinal", "plan", "bytes", "seconds"])
SCEN_SQL = _literal(P.SCENARIOS, ["scenario", "downloads"])
TRANSFER, HOUR = 0.0625, 1.5  # prices that are exact in binary


def _plans(spark):
    return spark.createDataFrame(PLANS, "ordinal int, plan string, external boolean, bytes bigint, seconds double")


def _runs(spark):
    return spark.createDataFrame(RUNS, "ordinal int, plan string, bytes bigint, seconds double")


def _scenarios(spark):
    return spark.createDataFrame(P.SCENARIOS, "scenario string, downloads int")


_COST = f"""SELECT *, transfer + pack AS total FROM (SELECT *, per_download * downloads AS transfer FROM (SELECT *, CAST(bytes AS DOUBLE) / 1073741824.0::DOUBLE * {TRANSFER}::DOUBLE AS per_download, coalesce(CAST(seconds AS DOUBLE), 0.0::DOUBLE) / 3600 * {HOUR}::DOUBLE AS pack"""
_COST1 = f"cost AS ({_COST} FROM {PLAN_SQL}, (SELECT 100 AS downloads) WHERE bytes IS NOT NULL))) "
_COST3 = f"cost AS ({_COST} FROM {PLAN_SQL}, {SCEN_SQL} WHERE bytes IS NOT NULL))) "
_KEEP = "CAST(seconds AS DOUBLE) AS seconds"


def _arg(col: str, cond: str = "true") -> str:
    return f"arg_min(plan, ({col}, ordinal)) FILTER ({cond} AND {col} IS NOT NULL)"


_RECS = f"""{_arg('bytes')} AS smallest, {_arg('bytes', 'NOT external')} AS own_smallest,
  CASE WHEN min(bytes) FILTER (external) < min(bytes) FILTER (NOT external) THEN {_arg('bytes', 'external')} ELSE {_arg('bytes', 'NOT external')} END AS public,
  {_arg('total')} AS lowest_total, {_arg('total', 'NOT external')} AS own_lowest_total, {_arg('total', 'external')} AS external_lowest_total,
  {_arg('seconds', 'NOT external')} AS own_fastest, {_arg('total', 'NOT external AND bytes <= floor(least_own * 1.05::DOUBLE)')} AS balanced"""


def _costed(spark):
    return P.enrich(_plans(spark).where("bytes is not null").withColumn("downloads", F.lit(100)), TRANSFER, HOUR)


@query("SELECT l_orderkey, l_linenumber, round_even(CAST(l_quantity AS BIGINT) * 1048576 / 1073741824.0::DOUBLE * 10 * 0.0625::DOUBLE, 6) AS cost FROM lineitem")
def egress_cost(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.select("l_orderkey", "l_linenumber", P.egress_cost(F.col("l_quantity").cast("bigint") * 1048576, F.lit(10), F.lit(TRANSFER)).alias("cost"))


# Volumes of each order priority against each number of downloads: whole bytes, one division at the end.
@query(f"""SELECT o_orderpriority, scenario, downloads, bytes, CAST(bytes AS DOUBLE) / 1073741824.0::DOUBLE * downloads * 0.0625::DOUBLE AS cost FROM
(SELECT o_orderpriority, CAST(sum(CAST(l_quantity AS BIGINT)) * 65536 AS BIGINT) AS bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), {SCEN_SQL}""")
def cost_model(spark, sf):
    lines, orders = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    by = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_orderpriority").agg((F.sum(F.col("l_quantity").cast("bigint")) * 65536).alias("bytes"))
    return by.crossJoin(F.broadcast(_scenarios(spark))).select("o_orderpriority", "scenario", "downloads", "bytes", (P.gib(F.col("bytes")) * F.col("downloads") * TRANSFER).alias("cost"))


# Runs against baselines of which one may be unknown or empty.
_BASED = [("fixed", 300_000_000, 480_000_000, 350_000_000, 700_000_000), ("cdc", 280_000_000, 480_000_000, None, 0), ("large", 600_000_000, 480_000_000, 350_000_000, 700_000_000), ("same", None, 480_000_000, 1, 700_000_000)]
_BASED_SQL = _literal(_BASED, ["plan", "bytes", *P.BASELINES])
_EGRESS = lambda x: f"round_even({x} / 1073741824.0::DOUBLE * 1000 * {TRANSFER}::DOUBLE, 6)"
_AGAINST = ", ".join(
    f"CASE WHEN {b} > 0 THEN greatest(0, {b} - bytes) END AS saved_vs_{b}_bytes, CASE WHEN {b} > 0 THEN round_even({_EGRESS(b)} - {_EGRESS('bytes')}, 6) END AS saved_vs_{b}_cost, CASE WHEN {b} > 0 THEN round_even(greatest(0, {b} - bytes) / CAST({b} AS DOUBLE), 6) END AS saved_vs_{b}_ratio"
    for b in P.BASELINES
)


@query(f"SELECT *, round_even(bytes / 1073741824.0::DOUBLE, 6) AS gib_per_download, {_EGRESS('bytes')} AS estimated_cost, {_AGAINST} FROM (SELECT * REPLACE (CAST(coalesce(bytes, 0) AS BIGINT) AS bytes) FROM {_BASED_SQL})")
def cost_projection(spark, sf):
    return P.project_costs(spark.createDataFrame(_BASED, "plan string, bytes bigint, " + ", ".join(f"{b} bigint" for b in P.BASELINES)), 1000, TRANSFER)


@query(f"WITH {_COST1} SELECT ordinal, plan, bytes, per_download, transfer, pack, total FROM cost")
def cost_enrich(spark, sf):
    return _costed(spark).select("ordinal", "plan", "bytes", "per_download", "transfer", "pack", "total")


@query(f"WITH {_COST1} SELECT {_RECS} FROM cost, (SELECT min(bytes) FILTER (NOT external) AS least_own FROM cost)")
def cost_aware_recs(spark, sf):
    return P.recommend(_costed(spark), [])


@query(f"WITH {_COST3} SELECT scenario, {_RECS} FROM cost, (SELECT min(bytes) FILTER (NOT external) AS least_own FROM cost) GROUP BY scenario")
def cost_scenarios(spark, sf):
    return P.recommend(P.enrich(_plans(spark).where("bytes is not null").crossJoin(F.broadcast(_scenarios(spark))), TRANSFER, HOUR), ["scenario"])


@query(f"""WITH {_COST1} SELECT a.plan AS a, b.plan AS b, CAST(coalesce(CASE WHEN b.per_download <= a.per_download AND b.pack <= a.pack THEN 0 WHEN b.per_download < a.per_download THEN greatest(0, ceil((b.pack - a.pack) / (a.per_download - b.per_download))) END, -1) AS BIGINT) AS downloads
FROM cost a, cost b WHERE a.ordinal <> b.ordinal""")
def break_even(spark, sf):
    cost = _costed(spark)
    a = cost.select(F.col("ordinal").alias("oa"), F.col("plan").alias("a"), F.col("per_download").alias("ta"), F.col("pack").alias("pa"))
    b = cost.select(F.col("ordinal").alias("ob"), F.col("plan").alias("b"), F.col("per_download").alias("tb"), F.col("pack").alias("pb"))
    pairs = a.join(F.broadcast(b), F.col("oa") != F.col("ob"))  # a handful of plans
    return pairs.select("a", "b", F.coalesce(P.break_even(F.col("ta"), F.col("pa"), F.col("tb"), F.col("pb")), F.lit(-1)).alias("downloads"))


_PAIRS = "(SELECT * FROM (VALUES ('own_fastest', 'own_smallest'), ('own_fastest', 'smallest'), ('own_fastest', 'balanced'), ('lowest_total', 'own_smallest')) AS t(f, t))"


@query(f"""WITH {_COST1}, recs AS (SELECT {_RECS} FROM cost, (SELECT min(bytes) FILTER (NOT external) AS least_own FROM cost)), named AS (UNPIVOT recs ON COLUMNS(*) INTO NAME rec VALUE plan)
SELECT f || ':' || t AS comparison, a.plan AS from_plan, b.plan AS to_plan, CAST(coalesce(CASE WHEN b.per_download <= a.per_download AND b.pack <= a.pack THEN 0 WHEN b.per_download < a.per_download THEN greatest(0, ceil((b.pack - a.pack) / (a.per_download - b.per_download))) END, -1) AS BIGINT) AS downloads,
  CASE WHEN b.per_download <= a.per_download AND b.pack <= a.pack THEN 'no-dearer-already' WHEN b.per_download < a.per_download THEN 'from-these-downloads' ELSE 'never' END AS relation
FROM {_PAIRS} JOIN named x ON x.rec = f JOIN named y ON y.rec = t JOIN cost a ON a.plan = x.plan JOIN cost b ON b.plan = y.plan WHERE f <> 'lowest_total' OR a.plan <> b.plan""")
def recommended_break_even(spark, sf):
    out = P.recommended_break_even(_costed(spark))
    return out.withColumn("downloads", F.coalesce("downloads", F.lit(-1)))


@query(f"""SELECT bandwidth, speed, CASE WHEN best_bytes > 0 AND (fixed_bytes - best_bytes) / CAST(best_bytes AS DOUBLE) <= 0.10::DOUBLE AND fixed_seconds <= default_seconds THEN 'fixed' ELSE default_plan END AS "default", near_best_strided, best_bytes FROM
(SELECT arg_min(plan, (bytes, ordinal)) AS bandwidth, arg_min(plan, (seconds, ordinal)) AS speed, arg_min(plan, (seconds, ordinal)) FILTER (near) AS default_plan, min(seconds) FILTER (near) AS default_seconds,
  arg_min(plan, (seconds, ordinal)) FILTER (near AND (starts_with(plan, 'fastcdc') OR starts_with(plan, 'large-file'))) AS near_best_strided,
  arg_min(bytes, ordinal) FILTER (plan = 'fixed') AS fixed_bytes, arg_min(seconds, ordinal) FILTER (plan = 'fixed') AS fixed_seconds, min(best) AS best_bytes FROM
  (SELECT r.* REPLACE (coalesce(seconds, 0) AS seconds), best, bytes <= best + greatest(floor(best * 0.10::DOUBLE), 268435456) AS near FROM {RUN_SQL} r, (SELECT min(bytes) AS best FROM {RUN_SQL})))""")
def adaptive_policy(spark, sf):
    return P.adaptive(_runs(spark))


# Untimed plans have no speed; a time of 0 comes after all others.
_TIMED = "NOT external AND seconds IS NOT NULL"
_SLOWLY = "(CASE WHEN seconds = 0 THEN 1 ELSE 0 END, seconds, ordinal)"


@query(f"""SELECT arg_min(plan, (bytes, ordinal)) AS smallest, arg_min(plan, (bytes, ordinal)) FILTER (NOT external) AS own_best, coalesce(arg_min(plan, {_SLOWLY}) FILTER ({_TIMED} AND bytes <= greatest(floor(own * 1.1::DOUBLE), own + 268435456)), arg_min(plan, (bytes, ordinal)) FILTER (NOT external)) AS "default",
  arg_min(plan, {_SLOWLY}) FILTER ({_TIMED}) AS speed FROM {PLAN_SQL}, (SELECT min(bytes) AS own FROM {PLAN_SQL} WHERE NOT external AND bytes > 0) WHERE bytes > 0""")
def hybrid_planner(spark, sf):
    return P.hybrid(_plans(spark))


@query(f"SELECT 'external:' || plan AS plan, bytes, bytes / 1073741824.0::DOUBLE AS gib, bytes / 1073741824.0::DOUBLE * 10::DOUBLE * {TRANSFER}::DOUBLE AS estimated_cost FROM {PLAN_SQL} WHERE external AND bytes IS NOT NULL")
def external_baselines(spark, sf):
    return P.external_rows(_plans(spark).where("external"), 10, TRANSFER).select("plan", "bytes", "gib", "estimated_cost")


_KEYS = [("zstd", "fixed"), ("", "cdc"), (None, "gear"), ("raw", None), (None, None)]


@query(f"SELECT coalesce(codec, '-') AS codec, coalesce(method, '-') AS method, CASE WHEN coalesce(codec, '') = '' THEN coalesce(method, '') ELSE codec || ':' || coalesce(method, '') END AS plan FROM {_literal(_KEYS, ['codec', 'method'])}")
def plan_keys(spark, sf):
    rows = spark.createDataFrame(_KEYS, "codec string, method string")
    return rows.select(F.coalesce("codec", F.lit("-")).alias("codec"), F.coalesce("method", F.lit("-")).alias("method"), P.plan_key(F.col("codec"), F.col("method")).alias("plan"))


# Fetches: an order's lines are chunks, those with a discount of 5 % or more came from the cache.
_FETCHES = """(SELECT l_orderkey AS fetch_id, count(*) FILTER (l_discount < 0.05) AS downloaded_chunks, count(*) FILTER (l_discount >= 0.05) AS cache_hit_chunks, sum(CAST(l_quantity AS BIGINT)) FILTER (l_discount < 0.05)::BIGINT AS downloaded_pack_bytes, sum(CAST(l_extendedprice AS BIGINT)) FILTER (l_discount >= 0.05 AND l_tax > 0.03)::BIGINT AS reused_cache_raw_bytes FROM lineitem GROUP BY 1)"""


@query(f"""SELECT fetch_id, downloaded_chunks, cache_hit_chunks, coalesce(downloaded_pack_bytes, 0) AS downloaded_pack_bytes, downloaded_chunks + cache_hit_chunks AS total_chunks_seen, cache_hit_chunks / CAST(nullif(downloaded_chunks + cache_hit_chunks, 0) AS DOUBLE) AS cache_hit_ratio,
  coalesce(coalesce(downloaded_pack_bytes, 0) / CAST(nullif(coalesce(downloaded_pack_bytes, 0) + coalesce(reused_cache_raw_bytes, 0), 0) AS DOUBLE), -1) AS downloaded_vs_reused_ratio FROM {_FETCHES.replace('CAST(l_extendedprice AS BIGINT)', 'CAST(trunc(l_extendedprice) AS BIGINT)')}""")
def step_metrics(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    new = F.col("l_discount") < 0.05
    fetches = lines.groupBy(F.col("l_orderkey").alias("fetch_id")).agg(
        F.count_if(new).alias("downloaded_chunks"),
        F.count_if(~new).alias("cache_hit_chunks"),
        F.sum(F.when(new, F.col("l_quantity").cast("bigint"))).alias("downloaded_pack_bytes"),
        F.sum(F.when(~new & (F.col("l_tax") > 0.03), F.col("l_extendedprice").cast("bigint"))).alias("reused_cache_raw_bytes"),
    )
    out = P.step_metrics(fetches)
    return out.select("fetch_id", "downloaded_chunks", "cache_hit_chunks", F.coalesce("downloaded_pack_bytes", F.lit(0)).alias("downloaded_pack_bytes"), "total_chunks_seen", "cache_hit_ratio", F.coalesce("downloaded_vs_reused_ratio", F.lit(-1.0)).alias("downloaded_vs_reused_ratio"))


@query(f"SELECT arg_min(plan, (bytes, coalesce(seconds, 0), plan)) AS best_plan, min(bytes) AS best_bytes, greatest(0, min(bytes) FILTER (plan = 'fixed') - min(bytes)) AS saved_vs_fixed FROM {RUN_SQL}")
def best_transfer(spark, sf):
    return _runs(spark).agg(F.min(F.struct("bytes", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), "plan"))["plan"].alias("best_plan"), F.min("bytes").alias("best_bytes"), F.min(F.when(F.col("plan") == "fixed", F.col("bytes"))).alias("fixed")).select("best_plan", "best_bytes", F.greatest(F.lit(0), F.col("fixed") - F.col("best_bytes")).cast("bigint").alias("saved_vs_fixed"))


# The least positive of a row's four baselines, the first of equals.
_BASES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT l_orderkey, l_linenumber, coalesce(best, -1) AS best, coalesce(CASE WHEN l_quantity > 0 AND l_quantity = best THEN 'l_quantity' WHEN l_extendedprice > 0 AND l_extendedprice = best THEN 'l_extendedprice' WHEN l_discount > 0 AND l_discount = best THEN 'l_discount' WHEN l_tax > 0 AND l_tax = best THEN 'l_tax' END, 'none') AS name FROM (SELECT *, least(CASE WHEN l_quantity > 0 THEN l_quantity END, CASE WHEN l_extendedprice > 0 THEN l_extendedprice END, CASE WHEN l_discount > 0 THEN l_discount END, CASE WHEN l_tax > 0 THEN l_tax END) AS best FROM lineitem)")
def best_baseline(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    best = F.least(*[F.when(F.col(c) > 0, F.col(c)) for c in _BASES])
    name = F.coalesce(*[F.when((F.col(c) > 0) & (F.col(c) == best), F.lit(c)) for c in _BASES], F.lit("none"))
    return lines.select("l_orderkey", "l_linenumber", F.coalesce(best, F.lit(-1.0)).alias("best"), name.alias("name"))


@query(f"SELECT codec, method, ratio FROM (VALUES ('auto'), ('zstd'), ('zlib'), ('raw')) AS c(codec), (SELECT plan AS method FROM {RUN_SQL}), (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (0.4::DOUBLE)) AS r(ratio)")
def plan_matrix(spark, sf):
    codecs = spark.createDataFrame([("auto",), ("zstd",), ("zlib",), ("raw",)], "codec string")
    ratios = spark.createDataFrame([(0.01,), (0.1,), (0.4,)], "ratio double")
    return codecs.coalesce(1).crossJoin(F.broadcast(_runs(spark).select(F.col("plan").alias("method")))).crossJoin(F.broadcast(ratios))


@query(f"SELECT 'own' AS category, plan, bytes FROM {PLAN_SQL} WHERE NOT external UNION ALL SELECT 'external', plan, bytes FROM {PLAN_SQL} WHERE external UNION ALL SELECT 'measured', plan, bytes FROM {RUN_SQL}")
def plan_union(spark, sf):
    p = _plans(spark)
    part = lambda df, name: df.select(F.lit(name).alias("category"), "plan", "bytes")
    return part(p.where("not external"), "own").unionByName(part(p.where("external"), "external")).unionByName(part(_runs(spark), "measured"))


_SUMMED = [
    ("normal", "quick", "fixed", "fixed", "quick", 16, 700_000_000, 400_000_000, 390_000_000, 480_000_000, 360_000_000, 350_000_000, 300_000_000, 420_000_000, 0.25, 100, 300, 20, 1.5, 2.25),
    ("normal", "quick", "cdc", "cdc", "quick", 16, 700_000_000, None, None, 480_000_000, None, None, 280_000_000, 400_000_000, 0.5, 200, 200, 20, 3.5, 5.75),
    ("same", "quick", "fixed", "fixed", "quick", 16, 700_000_000, None, 390_000_000, 0, None, 0, 0, 0, 1.0, 400, 0, 0, 1.5, 1.25),
    ("rewrite", "quick", "fixed", "fixed", "quick", 16, 700_000_000, None, 390_000_000, 100_000_000, None, 90_000_000, 120_000_000, 130_000_000, 0.0, 0, 400, 400, 1.0, 1.0),
]
_SUMMED_NAMES = ["scenario", "profile", "method", "chunker", "method_profile", "stride", "logical_bytes", "full_tar_gz", "full_tar_zstd", "file_level_raw", "file_level_tar_gz", "file_level_tar_zstd", "download_pack_bytes", "download_raw_bytes", "chunk_reuse_ratio", "reused_chunks", "added_chunks", "removed_chunks", "old_seconds", "new_seconds"]
_SUMMED_KINDS = ["string"] * 5 + ["int"] + ["bigint"] * 8 + ["double"] + ["int"] * 3 + ["double"] * 2
_SAVED = lambda b: f"round_even(CASE WHEN {b} > 0 THEN greatest(0, {b} - download_pack_bytes) / CAST({b} AS DOUBLE) END, 6)"
_DOUBLES = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("chunk_reuse_ratio", "old_seconds", "new_seconds"))


@query(f"""SELECT * REPLACE ({_DOUBLES}, CAST(download_pack_bytes AS BIGINT) AS download_pack_bytes, CAST(download_raw_bytes AS BIGINT) AS download_raw_bytes, CAST(file_level_raw AS BIGINT) AS file_level_raw, CAST(file_level_tar_zstd AS BIGINT) AS file_level_tar_zstd),
  coalesce({_SAVED('file_level_raw')}, 1.0::DOUBLE) AS saved_ratio_vs_file_level_raw, {_SAVED('file_level_tar_zstd')} AS saved_ratio_vs_file_level_tar_zstd, {_SAVED('full_tar_zstd')} AS saved_ratio_vs_full_tar_zstd,
  round_even(CAST(old_seconds AS DOUBLE) + CAST(new_seconds AS DOUBLE), 4) AS total_seconds FROM {_literal(_SUMMED, _SUMMED_NAMES)}""")
def bench_summary(spark, sf):
    kinds = ", ".join(f"{n} {k}" for n, k in zip(_SUMMED_NAMES, _SUMMED_KINDS, strict=True))
    return P.summary_rows(spark.createDataFrame(_SUMMED, kinds))


_VERDICT_SQL = "CASE WHEN coalesce(l_discount, 0) = 0 OR coalesce(l_tax, 0) = 0 THEN 'inconclusive' WHEN l_discount / l_tax < 0.8::DOUBLE THEN 'win' WHEN l_discount / l_tax > 1.2::DOUBLE THEN 'loss' ELSE 'near_tie' END"


def _verdicts(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", P.verdict(F.col("l_discount"), F.col("l_tax")).alias("verdict"))


@query(f"SELECT l_orderkey, l_linenumber, {_VERDICT_SQL} AS verdict FROM lineitem")
def scenario_verdict(spark, sf):
    return _verdicts(spark, sf)


@query(f"SELECT verdict, count(*) AS n FROM (SELECT {_VERDICT_SQL} AS verdict FROM lineitem) GROUP BY 1")
def verdict_counts(spark, sf):
    return _verdicts(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


# Scenarios: an order that is pending failed, one in eleven has no figure.
_CLASS_SQL = "CASE WHEN o_orderstatus = 'P' THEN 'invalid' WHEN s IS NULL THEN 'unknown' WHEN s >= 0.5::DOUBLE THEN 'strong_win' WHEN s >= 0.1::DOUBLE THEN 'moderate_or_weak_win' WHEN s > 0 THEN 'near_no_win' ELSE 'regression' END"
_BUCKET_SQL = "CASE class WHEN 'strong_win' THEN 'safe_positive_example' WHEN 'moderate_or_weak_win' THEN 'qualified_positive_example' WHEN 'near_no_win' THEN 'negative_or_neutral_example' WHEN 'regression' THEN 'negative_example' ELSE 'do_not_claim' END"
_SAVED_SQL = "(SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN 1 - o_totalprice / 200000.0::DOUBLE END AS s FROM orders)"


def _classes(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    saved = F.when(F.col("o_orderkey") % 11 != 0, 1 - F.col("o_totalprice") / F.lit(200_000.0))
    label = P.savings_class(F.col("o_orderstatus") != "P", saved)
    return orders.select("o_orderkey", "o_orderpriority", "o_custkey", label.alias("class"), P.claim_bucket(label).alias("claim"))


@query(f"SELECT *, {_BUCKET_SQL} AS claim FROM (SELECT o_orderkey, o_orderpriority, o_custkey, {_CLASS_SQL} AS class FROM {_SAVED_SQL})")
def savings_class(spark, sf):
    return _classes(spark, sf)


@query(f"SELECT o_custkey, CASE WHEN list_contains(c, 'strong_win') AND (list_contains(c, 'near_no_win') OR list_contains(c, 'regression')) THEN 'strong-and-limits' WHEN list_contains(c, 'strong_win') THEN 'strong' ELSE 'not-strong' END AS headline FROM (SELECT o_custkey, list(DISTINCT {_CLASS_SQL}) AS c FROM {_SAVED_SQL} GROUP BY 1)")
def claims_headline(spark, sf):
    return _classes(spark, sf).groupBy("o_custkey").agg(F.collect_set("class").alias("c")).select("o_custkey", P.claims(F.col("c")).alias("headline"))


# Each rule and each missing figure in turn: best plan, raw changed files, best compressed baseline, whole artifact.
_ARTIFACTS = [
    (1, None, 100, 100, 100), (2, 90, 100, 100, 100), (3, 89, 98, 100, 100), (4, 25, 50, 100, 1000), (5, 26, 50, 100, 1000), (6, 75, 150, 100, 1000), (7, 76, 400, 100, 1000), (8, 76, 304, 100, 1000),
    (9, 76, 300, 100, 1000), (10, 76, None, 100, 1000), (11, 1, 100, None, 1000), (12, 2, 100, None, 1000), (13, 25, 100, None, 1000), (14, 26, 100, None, 1000), (15, 5, None, None, 1000), (16, 5, 0, 0, 0), (17, 5, 5, None, None), (18, 0, 100, 0, 1000),
]
_ARTIFACT_NAMES = ["id", "best", "raw", "packed", "logical"]


@query(f"""SELECT id, CASE WHEN best IS NULL THEN 'invalid' WHEN w >= 0.90::DOUBLE THEN 'bad-fit' WHEN r >= 0.90::DOUBLE THEN 'near-parity'
  WHEN p IS NOT NULL THEN CASE WHEN p <= 0.25::DOUBLE THEN 'high-reuse-win' WHEN p <= 0.75::DOUBLE THEN 'moderate-win' WHEN r <= 0.25::DOUBLE THEN 'compressed-baseline-parity' ELSE 'near-parity' END
  WHEN r <= 0.01::DOUBLE THEN 'high-reuse-win' WHEN r <= 0.25::DOUBLE THEN 'moderate-win' ELSE 'unknown' END AS class
FROM (SELECT id, best, best / CAST(nullif(logical, 0) AS DOUBLE) AS w, best / CAST(nullif(raw, 0) AS DOUBLE) AS r, best / CAST(nullif(packed, 0) AS DOUBLE) AS p FROM
  (SELECT * FROM {_literal(_ARTIFACTS, _ARTIFACT_NAMES)} UNION ALL SELECT 100 + l_orderkey * 10 + l_linenumber, CAST(l_quantity AS BIGINT), CAST(trunc(l_extendedprice / 1000) AS BIGINT), CASE WHEN l_linenumber % 2 = 0 THEN CAST(trunc(l_extendedprice / 400) AS BIGINT) END, 1000 FROM lineitem))""")
def artifact_class(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    n = lambda c: c.cast("bigint")
    rows = lines.select((100 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("id"), n(F.col("l_quantity")).alias("best"), n(F.col("l_extendedprice") / 1000).alias("raw"), F.when(F.col("l_linenumber") % 2 == 0, n(F.col("l_extendedprice") / 400)).alias("packed"), F.lit(1000).cast("bigint").alias("logical"))
    rows = rows.unionByName(spark.createDataFrame(_ARTIFACTS, ", ".join(f"{c} bigint" for c in _ARTIFACT_NAMES)))
    return rows.select("id", P.artifact_class(*[F.col(c) for c in _ARTIFACT_NAMES[1:]]).alias("class"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'failed' WHEN l_tax = 0 THEN 'pass_metrics_unavailable' WHEN r <= 0.05::DOUBLE THEN 'high-reuse-win' WHEN r <= 0.35::DOUBLE THEN 'moderate-win' WHEN r <= 0.85::DOUBLE THEN 'partial-win' ELSE 'near-parity-or-bad-fit' END AS class
FROM (SELECT *, CASE WHEN l_discount = 0 THEN 1.0::DOUBLE ELSE l_quantity / 50.0::DOUBLE END AS r FROM lineitem)""")
def showcase_class(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    warm, full = F.when(F.col("l_tax") != 0, F.col("l_quantity")), F.when(F.col("l_discount") == 0, 0.0).otherwise(50.0)
    return lines.select("l_orderkey", "l_linenumber", P.showcase_class(F.col("l_linenumber") != 7, warm, full).alias("class"))


_PUBLISHED = [("normal", 419, 239_827), ("small-files", 2_147, 3_515_724), ("heavy-change", 26_845_855, 27_078_879), ("unmeasured", None, 10)]


@query(f"SELECT scenario, own, other, coalesce(own / CAST(nullif(other, 0) AS DOUBLE), -1) AS ratio FROM (SELECT scenario, coalesce(own, 0) AS own, other FROM {_literal(_PUBLISHED, ['scenario', 'own', 'other'])})")
def baseline_compare(spark, sf):
    rows = spark.createDataFrame(_PUBLISHED, "scenario string, own bigint, other bigint").withColumn("own", F.coalesce("own", F.lit(0)))
    return rows.withColumn("ratio", F.coalesce(F.col("own") / F.nullif(F.col("other"), F.lit(0)), F.lit(-1.0)))


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice < 100000 THEN 'full' END, CASE WHEN o_orderstatus = 'F' THEN 'changed' END, CASE WHEN o_custkey % 2 = 0 THEN 'rolling' END], lambda x: x IS NOT NULL), ',') AS missing FROM orders")
def missing_baselines(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    names = F.array(F.when(F.col("o_totalprice") < 100_000, "full"), F.when(F.col("o_orderstatus") == "F", "changed"), F.when(F.col("o_custkey") % 2 == 0, "rolling"))
    return o.select("o_orderkey", F.array_join(F.array_compact(names), ",").alias("missing"))
