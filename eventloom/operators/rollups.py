"""Corpus rollups, promotion rules and scorecards over candidate-match rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import ordered as o


def team_rollup(df, keys, sums: Mapping[str, str], maxima: Mapping[str, str], vote: str) -> DataFrame:
    """Sums per member, maxima for shared objectives and a strict-majority vote."""
    votes = F.count(vote)
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
        *[F.coalesce(F.max(c), F.lit(0)).alias(n) for n, c in maxima.items()],
        F.count("*").alias("members"),
        F.when(votes > 0, F.count_if(F.col(vote)) > votes / 2).alias("win"),
    )


def best_per(df: DataFrame, keys, order: Sequence[Column]) -> DataFrame:
    return o.best(df, keys, order)


def window_aggregate(matches: DataFrame, window, metric, participant: str, order, score: str, passes: str) -> DataFrame:
    """Best match per participant, averaged per (window, metric); then the best metric per window."""
    best = o.best(matches, [*window, *metric, participant], order)
    n = F.count("*")
    support = F.least(F.lit(1.0), n / 4)
    agg = best.groupBy(*window, *metric).agg(
        n.alias("participants"),
        F.count_if(F.col(passes)).alias("pass_count"),
        F.avg(score).alias("average_score"),
        (F.avg(score) * (0.5 + support) * (0.5 + F.count_if(F.col(passes)) / n)).alias("aggregate"),
    )
    # rounded, so that sums in another order rank alike
    return o.best(agg, window, [F.desc(F.round("aggregate", 9)), *[F.asc(c) for c in metric]])


def pattern_confidence(effective: Column, rows: Column, participants: Column, validator: Column) -> Column:
    one = F.lit(1.0)
    return effective * (0.5 + F.least(one, rows / 3)) * (0.5 + F.least(one, participants / 4)) * (0.5 + validator)


def qualifies(participants, correlation, nrmse, validator) -> Column:
    """At least 6 participants, correlation .5, nRMSE at most 1 and validator .6 (fixed values).

    Means are rounded to nine digits first, so that sums in another order compare alike.
    """
    c, n, v = (F.round(x, 9) for x in (correlation, nrmse, validator))
    return (F.col(participants) >= 6) & (c >= 0.5) & (n <= 1.0) & (v >= 0.6)


def leave_one_out(entries: DataFrame, group: Sequence[str], match: str, qualified: str, match_counts: DataFrame, version: str):
    """Held-out support per group: entries for which another match qualifies.

    ``count(distinct qualifying matches) - own`` replaces a self-join.
    """
    group = list(group)
    per = entries.groupBy(*group, match).agg(F.max(F.col(qualified).cast("int")).alias("_own"))
    total = per.groupBy(*group).agg(F.sum("_own").alias("_all"))
    rows = entries.join(per, [*group, match]).join(total, group).join(match_counts, version)
    eligible = (F.col("_all") - F.col("_own") > 0) & (F.col("match_count") >= 2)
    out = rows.groupBy(*group).agg(
        F.count_if(eligible).alias("held_out_eligible"),
        F.count_if(eligible & F.col(qualified)).alias("held_out_hits"),
    )
    return out.withColumn("held_out_rate", F.try_divide("held_out_hits", "held_out_eligible"))


def winner_gap(df: DataFrame, group, participant: str, order: Sequence[Column], score: str, min_gap: float) -> DataFrame:
    """Best row per group and its gap to the best row of another participant."""
    per = o.best(df, [*group, participant], order)
    two = o.top_k(per, group, order, 2, "_r")
    runner = F.max(F.when(F.col("_r") == 2, F.col(score)))
    cols = [c for c in df.columns if c not in group]
    win = F.max(F.when(F.col("_r") == 1, F.struct(*cols)))
    rivals = per.groupBy(*group).agg(F.count("*").alias("participants"))
    out = two.groupBy(*group).agg(win.alias("_w"), runner.alias("runner_up"))
    out = out.select(*group, "_w.*", "runner_up").withColumn("gap", F.col(score) - F.col("runner_up"))
    out = out.withColumn("unambiguous", F.col("gap").isNull() | (F.col("gap") >= min_gap))
    return out.join(rivals, list(group))


def identity_evidence(matches: DataFrame, slot, participant: str, metric: str, order, weights: Mapping[str, float], default: float = 0.5) -> DataFrame:
    """Participant-slot evidence: best match per metric, weighted support and bonuses."""
    best = o.best(matches, [*slot, participant, metric], order)
    weight = F.coalesce(
        F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[F.col(metric)], F.lit(default)
    )
    n = F.count("*")
    out = best.groupBy(*slot, participant).agg(
        n.alias("metrics"), F.sum(weight).alias("identity_weight"),
        F.count_if(weight >= 1).alias("identity_metrics"),
        F.sum(weight * F.col("score")).alias("weighted_support"),
        F.avg(F.greatest(F.lit(0.0), F.col("correlation"))).alias("average_correlation"),
        F.avg("nrmse").alias("average_nrmse"), F.max("score").alias("best_score"),
    )
    out = out.filter("metrics >= 2")
    bonus = F.least(F.lit(0.75), (F.col("metrics") - 1) * 0.18)
    return out.withColumn("evidence", F.col("weighted_support") + bonus)


def normalized_priors(hits: DataFrame, bucket, label, score: str, match: str) -> DataFrame:
    """Label priors per bucket: .55 support + .45 score, each relative to the bucket's best."""
    bucket, label = list(bucket), list(label)
    per = hits.groupBy(*bucket, *label).agg(
        F.count("*").alias("support"), F.count_distinct(match).alias("matches"), F.avg(score).alias("average_score")
    )
    top = per.groupBy(*bucket).agg(F.max("support").alias("_ms"), F.greatest(F.max("average_score"), F.lit(1e-9)).alias("_mx"))
    out = per.join(top, bucket)
    prior = 0.55 * F.col("support") / F.col("_ms") + 0.45 * F.col("average_score") / F.col("_mx")
    return out.withColumn("prior", prior).drop("_ms", "_mx")


def alignment_class(overlap, axis, path, nrmse) -> Column:
    """strong / moderate / weak by fixed gates."""
    def gate(a, p, e):
        return (F.col(overlap) >= 6) & (F.col(axis) >= a) & (F.col(path) >= p) & (F.col(nrmse) <= e)

    return F.when(gate(0.8, 0.35, 0.08), "strong").when(gate(0.65, 0.2, 0.14), "moderate").otherwise("weak")


def policy_tier(stats: DataFrame, min_samples: int) -> DataFrame:
    """Tier per family from class rates and averages (fixed thresholds)."""
    clean = (
        (F.col("weak_rate") <= 0.15) & (F.col("axis") >= 0.74) & (F.col("path") >= 0.7) & (F.col("nrmse") <= 0.11)
    )
    tier = (
        F.when(F.col("entities") < min_samples, "insufficient")
        .when((F.col("weak_rate") > 0.45) | (F.col("axis") < 0.62), "rejected")
        .when((F.col("strong_rate") >= 0.35) | clean, "trusted")
        .otherwise("strict")
    )
    return stats.withColumn("tier", tier)


def reasons(**rules: Column) -> Column:
    """Names of the rules that fire, in order."""
    names = F.array(*[F.when(rule, F.lit(name.replace("_", "-"))) for name, rule in rules.items()])
    return F.filter(names, lambda r: r.isNotNull())


def strength(effective, correlation, nrmse) -> Column:
    """Match strength by fixed gates."""
    e, c, n = F.col(effective), F.col(correlation), F.col(nrmse)
    return (
        F.when((e >= 0.28) & (c >= 0.55) & (n <= 1.1), "strong")
        .when((e >= 0.18) & (c >= 0.4) & (n <= 1.5), "moderate")
        .otherwise("weak")
    )


def collision_bucket(count) -> Column:
    c = F.col(count)
    return F.when(c >= 7, "7_plus").when(c >= 4, "4_to_6").when(c >= 1, "1_to_3").otherwise("none")


def merge_count_maps(df: DataFrame, keys, counts: str) -> DataFrame:
    """Sum count maps entry by entry."""
    return df.select(*keys, F.explode(counts).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("n"))


def state_class(direct_exact: Column, matches: Column, changing: Column, within: Column, diff: Column, min_within: Column, min_corr: Column, binary: Column) -> Column:
    """Candidate ladder from exact to not promotable (fixed thresholds)."""
    pair = matches >= 2
    lively = pair & (changing >= 10)
    w, d = F.abs(within), F.abs(diff)
    return (
        F.when(pair & direct_exact, "direct-exact-validation-match")
        .when(lively & (w >= 0.8) & (d >= 0.65) & (min_within >= 0.7) & (min_corr >= 0.6), "stable-strong-correlation")
        .when(lively & (w >= 0.6) & (d >= 0.45) & (min_within >= 0.45), "stable-moderate-correlation")
        .when((min_corr >= 0.75) & (w < 0.35), "participant-static-correlation-only")
        .when((w >= 0.6) & (d < 0.35), "progression-correlation-only")
        .when(binary & (min_corr >= 0.5), "binary-correlation-candidate")
        .otherwise("not-promotable")
    )
