"""Choosing an update plan: costs, tolerance bands, recommendations, break-even points and verdicts.

Candidates carry an ordinal, so the first of equals wins; bands are cut to whole bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB = float(1 << 30)
# Tolerances and thresholds of the policies.
NEAR_RATIO, NEAR_BYTES, FIXED_CLOSE, BALANCED_RATIO = 0.10, 256 << 20, 0.10, 0.05
WIN, LOSS = 0.80, 1.20
SCENARIOS = [("internal", 10), ("public", 10_000), ("massive", 100_000)]


def gib(n: Column) -> Column:
    return n / F.lit(GIB)


def egress_cost(n: Column, downloads: Column, price: Column) -> Column:
    return F.bround(gib(n) * F.greatest(downloads, F.lit(0)) * price, 6)


def _best(key: list[str], where: Column | None = None) -> Column:
    """The plan that is least by key, then by ordinal, among those whose key is known."""
    known = F.lit(True) if where is None else where
    for k in key:
        known = known & F.col(k).isNotNull()
    return F.min(F.when(known, F.struct(*key, "ordinal", "plan")))["plan"]


def enrich(plans: DataFrame, transfer_price: float, hour_price: float) -> DataFrame:
    """plans(ordinal, plan, external, bytes, seconds, downloads) with what a download, all of them, packing and all cost."""
    out = plans.withColumn("per_download", gib(F.col("bytes")) * transfer_price)
    out = out.withColumn("transfer", F.col("per_download") * F.col("downloads"))
    out = out.withColumn("pack", F.coalesce(F.col("seconds"), F.lit(0.0)) / 3600 * hour_price)
    return out.withColumn("total", F.col("transfer") + F.col("pack"))


def recommend(costed: DataFrame, by: list[str]) -> DataFrame:
    """By group, over plans of known bytes, 0 included: the least bytes of all (also the choice for mass distribution) and
    of our own, the choice for public distribution, the least total cost of all, of our own and of others, the fastest
    of our own that was timed, and the cheapest of our own within a band of the least bytes.
    """
    costed = costed.where("bytes is not null")
    own, ext = ~F.col("external"), F.col("external")
    least = costed.groupBy(*by).agg(F.min(F.when(own, F.col("bytes"))).alias("_least"))
    rows = costed.join(least, by) if by else costed.crossJoin(F.broadcast(least))  # then it is one row
    band = own & (F.col("bytes") <= F.floor(F.col("_least") * F.lit(1 + BALANCED_RATIO)))
    smallest = F.min(F.struct("bytes", "ordinal", "plan", "external"))
    return rows.groupBy(*by).agg(
        smallest["plan"].alias("smallest"),
        _best(["bytes"], own).alias("own_smallest"),
        F.when(smallest["external"], smallest["plan"]).otherwise(_best(["bytes"], own)).alias("public"),
        _best(["total"]).alias("lowest_total"),
        _best(["total"], own).alias("own_lowest_total"),
        _best(["total"], ext).alias("external_lowest_total"),
        _best(["seconds"], own).alias("own_fastest"),
        _best(["total"], band).alias("balanced"),
    )


def adaptive(runs: DataFrame) -> DataFrame:
    """Bandwidth, speed and default choice over runs(ordinal, plan, bytes, seconds); an unknown time counts as none taken.

    The default is the fastest near the least bytes; the fixed chunker overrides where it is close in bytes and not
    slower. The fastest near plan of the strided chunker or a large-file profile is named beside it.
    """
    runs = runs.withColumn("bytes", F.coalesce("bytes", F.lit(0))).withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    best = runs.agg(F.min("bytes").alias("_best"))
    rows = runs.crossJoin(F.broadcast(best))  # one row
    near = F.col("bytes") <= F.col("_best") + F.greatest(F.floor(F.col("_best") * F.lit(NEAR_RATIO)), F.lit(NEAR_BYTES))
    strided = F.col("plan").startswith("fastcdc") | F.col("plan").startswith("large-file")
    got = rows.agg(
        _best(["bytes"]).alias("bandwidth"),
        _best(["seconds"]).alias("speed"),
        _best(["seconds"], near & strided).alias("near_best_strided"),
        F.min(F.when(near, F.struct("seconds", "ordinal", "plan"))).alias("_default"),
        F.min(F.when(F.col("plan") == "fixed", F.struct("ordinal", "bytes", "seconds"))).alias("_fixed"),
        F.min("_best").alias("best_bytes"),
    )
    close = (F.col("best_bytes") > 0) & ((F.col("_fixed.bytes") - F.col("best_bytes")) / F.col("best_bytes") <= FIXED_CLOSE) & (F.col("_fixed.seconds") <= F.col("_default.seconds"))
    return got.select("bandwidth", "speed", F.when(F.coalesce(close, F.lit(False)), "fixed").otherwise(F.col("_default.plan")).alias("default"), "near_best_strided", "best_bytes")


def hybrid(plans: DataFrame) -> DataFrame:
    """Over plans that move something: the smallest, the best of our own, the fastest timed of our own near it, else that
    best one, and the fastest timed of our own. A time of 0 is taken for one that wasn't measured well: it comes last.
    """
    rows = plans.where("bytes > 0").withColumn("seconds", F.when(F.col("seconds") == 0, 1e99).otherwise(F.col("seconds")))
    own = ~F.col("external")
    best = rows.agg(F.min(F.when(own, F.col("bytes"))).alias("_own"))
    rows = rows.crossJoin(F.broadcast(best))  # one row
    near = own & (F.col("bytes") <= F.greatest(F.floor(F.col("_own") * F.lit(1 + NEAR_RATIO)), F.col("_own") + NEAR_BYTES))
    got = rows.agg(_best(["bytes"]).alias("smallest"), _best(["bytes"], own).alias("own_best"), _best(["seconds"], near).alias("_timed"), _best(["seconds"], own).alias("speed"))
    return got.select("smallest", "own_best", F.coalesce("_timed", "own_best").alias("default"), "speed")


#: Names of the baselines that a projection is held against.
BASELINES = ["file_level_raw", "file_level_tar_zstd", "full_tar_zstd"]


def project_costs(runs: DataFrame, downloads: int, price: float) -> DataFrame:
    """runs(..., bytes and a column for each of BASELINES) with their cost, and bytes, cost and ratio saved against each.

    What is held against a baseline that is unknown or 0 is null; bytes and ratios saved are at least 0, costs aren't.
    """
    count, unit = F.lit(downloads), F.lit(float(price))
    out = runs.withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("bigint"))
    cost = egress_cost(F.col("bytes"), count, unit)
    out = out.withColumn("gib_per_download", F.bround(gib(F.col("bytes")), 6)).withColumn("estimated_cost", cost)
    for name in BASELINES:
        base = F.when(F.col(name) > 0, F.col(name))
        left = base - F.col("bytes")
        out = out.withColumn(f"saved_vs_{name}_bytes", F.when(left > 0, left).otherwise(left * 0).cast("bigint"))
        out = out.withColumn(f"saved_vs_{name}_cost", F.bround(egress_cost(base, count, unit) - cost, 6))
        out = out.withColumn(f"saved_vs_{name}_ratio", F.bround(F.when(left > 0, left / base).otherwise(left * 0.0), 6))
    return out


def summary_rows(runs: DataFrame) -> DataFrame:
    """A row of a comparison for each of runs: what was measured, and ratios saved, null where the baseline is unknown or 0."""
    saved = lambda base: F.bround(F.when(F.col(base) > 0, F.greatest(F.lit(0), F.col(base) - F.col("download_pack_bytes")) / F.col(base)), 6)
    raw = F.coalesce(saved("file_level_raw"), F.lit(1.0))  # nothing changed: all is saved
    return runs.select(
        "scenario", "profile", "method", "chunker", "method_profile", "stride", "logical_bytes", "full_tar_gz", "full_tar_zstd", "file_level_raw", "file_level_tar_gz", "file_level_tar_zstd",
        "download_pack_bytes", "download_raw_bytes", "chunk_reuse_ratio", raw.alias("saved_ratio_vs_file_level_raw"), saved("file_level_tar_zstd").alias("saved_ratio_vs_file_level_tar_zstd"),
        saved("full_tar_zstd").alias("saved_ratio_vs_full_tar_zstd"), "reused_chunks", "added_chunks", "removed_chunks", "old_seconds", "new_seconds", F.bround(F.col("old_seconds") + F.col("new_seconds"), 4).alias("total_seconds"),
    )


def external_rows(values: DataFrame, downloads: int, price: float) -> DataFrame:
    """Plans for the known of values(ordinal, plan, bytes): external, never timed."""
    known = values.where("bytes is not null")
    cost = gib(F.col("bytes")) * F.lit(float(downloads)) * F.lit(float(price))
    return known.select("ordinal", plan_key(F.lit("external"), F.col("plan")).alias("plan"), F.lit(True).alias("external"), "bytes", gib(F.col("bytes")).alias("gib"), cost.alias("estimated_cost"), F.lit(None).cast("double").alias("seconds"))


def plan_key(codec: Column, method: Column) -> Column:
    """`codec:method`, the method alone without a codec."""
    method = F.coalesce(method, F.lit(""))
    return F.when(F.coalesce(codec, F.lit("")) == "", method).otherwise(F.concat(codec, F.lit(":"), method))


def step_metrics(fetches: DataFrame) -> DataFrame:
    """fetches with the chunks seen and the shares that came from the cache and over the network, null where nothing was seen."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    seen, moved = n("downloaded_chunks") + n("cache_hit_chunks"), n("downloaded_pack_bytes") + n("reused_cache_raw_bytes")
    return fetches.select(
        "*",
        seen.alias("total_chunks_seen"),
        (n("cache_hit_chunks") / F.nullif(seen, F.lit(0))).alias("cache_hit_ratio"),
        (n("downloaded_pack_bytes") / F.nullif(moved, F.lit(0))).alias("downloaded_vs_reused_ratio"),
    )


def break_even(a_transfer: Column, a_pack: Column, b_transfer: Column, b_pack: Column) -> Column:
    """Downloads from which b costs no more than a: 0 if b is no dearer in both, null if it never is."""
    needed = F.greatest(F.lit(0), F.ceil((b_pack - a_pack) / (a_transfer - b_transfer)))
    return F.when((b_transfer <= a_transfer) & (b_pack <= a_pack), F.lit(0)).when(b_transfer < a_transfer, needed).cast("bigint")


#: Comparisons of recommended plans: from the one that is quickly made to the one that moves less.
COMPARED = [("own_fastest", "own_smallest"), ("own_fastest", "smallest"), ("own_fastest", "balanced"), ("lowest_total", "own_smallest")]


def recommended_break_even(costed: DataFrame) -> DataFrame:
    """(comparison, from_plan, to_plan, downloads, relation) between the recommended of costed plans.

    A plan named twice is its last row. Comparisons without both plans are absent, as is the last where both are one.
    """
    rows = costed.groupBy("plan").agg(F.max_by(F.struct("per_download", "pack"), "ordinal").alias("c"))
    pairs = F.array(*[F.struct(F.lit(f"{a}:{b}").alias("comparison"), F.col(a).alias("from_plan"), F.col(b).alias("to_plan"), F.lit(a == "lowest_total").alias("distinct")) for a, b in COMPARED])
    each = recommend(costed, []).select(F.explode(pairs).alias("p")).select("p.*").where("from_plan is not null and to_plan is not null and not (distinct and from_plan = to_plan)")
    side = lambda end: rows.select(F.col("plan").alias(f"{end}_plan"), F.col("c.per_download").alias(f"{end}_transfer"), F.col("c.pack").alias(f"{end}_pack"))
    out = each.join(side("from"), "from_plan").join(side("to"), "to_plan")
    n = break_even(F.col("from_transfer"), F.col("from_pack"), F.col("to_transfer"), F.col("to_pack"))
    now = (F.col("to_pack") <= F.col("from_pack")) & (F.col("to_transfer") <= F.col("from_transfer"))
    relation = F.when(now, "no-dearer-already").when(F.col("to_transfer") < F.col("from_transfer"), "from-these-downloads").otherwise("never")
    return out.select("comparison", "from_plan", "to_plan", n.alias("downloads"), relation.alias("relation"))


def verdict(own: Column, external: Column) -> Column:
    """How our least cost stands against the least external one; a cost of 0 or none says nothing."""
    ratio = own / external
    known = (F.coalesce(own, F.lit(0)) != 0) & (F.coalesce(external, F.lit(0)) != 0)
    return F.when(~known, "inconclusive").when(ratio < WIN, "win").when(ratio > LOSS, "loss").otherwise("near_tie")


# Thresholds, classes and the claim that each class allows.
STRONG, WEAK = 0.50, 0.10
CLAIMS = {
    "invalid": "do_not_claim",
    "unknown": "do_not_claim",
    "strong_win": "safe_positive_example",
    "moderate_or_weak_win": "qualified_positive_example",
    "near_no_win": "negative_or_neutral_example",
    "regression": "negative_example",
}


def savings_class(ok: Column, saved: Column, strong: float = STRONG, weak: float = WEAK) -> Column:
    return (
        F.when(~F.coalesce(ok, F.lit(False)), "invalid")
        .when(saved.isNull(), "unknown")
        .when(saved >= strong, "strong_win")
        .when(saved >= weak, "moderate_or_weak_win")
        .when(saved > 0, "near_no_win")
        .otherwise("regression")
    )


def claim_bucket(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CLAIMS.items() for x in pair])[label]


def claims(classes: Column) -> Column:
    """A headline from the set of classes that occur: strong gains, strong gains beside limits, or no strong gains."""
    has = lambda c: F.array_contains(classes, c)
    return F.when(has("strong_win") & (has("near_no_win") | has("regression")), "strong-and-limits").when(has("strong_win"), "strong").otherwise("not-strong")


def artifact_class(best: Column, raw: Column, converted: Column, logical: Column) -> Column:
    """Ordered rules over what our best plan moves, against the whole artifact, raw changed files and the best compressed baseline."""
    share = lambda y: F.when(y > 0, best / y)
    whole, plain, packed = share(logical), share(raw), share(converted)
    return (
        F.when(best.isNull(), "invalid")
        .when(whole >= 0.90, "bad-fit")
        .when(plain >= 0.90, "near-parity")
        .when(packed <= 0.25, "high-reuse-win")
        .when(packed <= 0.75, "moderate-win")
        .when(packed.isNotNull() & (plain <= 0.25), "compressed-baseline-parity")
        .when(packed.isNotNull(), "near-parity")
        .when(plain <= 0.01, "high-reuse-win")
        .when(plain <= 0.25, "moderate-win")
        .otherwise("unknown")
    )


def showcase_class(ok: Column, warm: Column, full: Column) -> Column:
    """By the share of the full payload that a warm update moves; an unknown or empty payload counts as a share of 1."""
    r = F.when(F.coalesce(full, F.lit(0)) != 0, warm / full).otherwise(F.lit(1.0))
    return (
        F.when(~F.coalesce(ok, F.lit(False)), "failed")
        .when(warm.isNull(), "pass_metrics_unavailable")
        .when(r <= 0.05, "high-reuse-win")
        .when(r <= 0.35, "moderate-win")
        .when(r <= 0.85, "partial-win")
        .otherwise("near-parity-or-bad-fit")
    )
