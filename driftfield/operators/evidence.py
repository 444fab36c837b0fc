"""Reporting operators over score tables: one row per (event, model)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as ev

EVENT = ("session", "event_index")


def with_support(scores: DataFrame, heldout: bool = False, labels: tuple[str, ...] = ("support_label",)) -> DataFrame:
    """Adds evidence_support, evidence_comparison and evidence_comparable.

    A row without a label is exact only by the name of its model or by its state-space mode,
    which is read from the column `mode` where there is one. `heldout` says that scores are
    joint less training evidence.
    """
    mode = F.col("mode") if "mode" in scores.columns else None
    out = scores.withColumn("evidence_support", ev.support(F.col("status"), F.col("model"), [F.col(c) for c in labels], heldout, mode))
    return out.withColumn("evidence_comparison", ev.comparison(F.col("evidence_support"))).withColumn(
        "evidence_comparable", ev.succeeded(F.col("status")) & ev.finite(F.col("log_evidence")) & (F.col("evidence_support") == ev.EXACT)
    )


def one_per_model(scores: DataFrame, scope=EVENT) -> DataFrame:
    """Of repeated rows of a model in a scope the best one; ties go to the smallest row_key."""
    w = Window.partitionBy(*scope, "model").orderBy(F.desc_nulls_last("log_evidence"), "row_key")
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _best_name(flag: Column, w) -> Column:
    """The model of the highest evidence among flagged rows; ties go to the smaller name."""
    return F.min(F.when(flag, F.struct((-F.col("log_evidence")).alias("e"), F.col("model").alias("m")))).over(w)["m"]


def model_evidence(scores: DataFrame, scope=EVENT) -> DataFrame:
    """Relative evidence, model probability and best models within each event, by one shuffle.

    Only exact scores are normalised; truncated ones are ranked among themselves.
    """
    s = one_per_model(with_support(scores), scope)
    w = Window.partitionBy(*scope)
    exact, cut = F.col("evidence_comparable"), ev.succeeded(F.col("status")) & (F.col("evidence_support") == ev.TRUNCATED)
    e = F.when(exact, F.col("log_evidence"))
    s = s.withColumn("_max", F.max(e).over(w)).withColumn("_cut", F.when(cut, F.col("log_evidence")))
    s = s.withColumn("relative_log_evidence", e - F.col("_max"))
    s = s.withColumn("model_probability", F.exp(F.col("relative_log_evidence")) / F.sum(F.exp(F.col("relative_log_evidence"))).over(w))
    s = s.withColumn("best_model", _best_name(exact, w)).withColumn("is_best_model", exact & (F.col("model") == F.col("best_model")))
    for family in ("trajectory", "nontrajectory"):
        of = exact & (F.col("model_family") == family)
        s = s.withColumn(f"best_{family}_model", _best_name(of, w)).withColumn(f"delta_vs_{family}_best", e - F.max(F.when(of, F.col("log_evidence"))).over(w))
    s = s.withColumn("truncated_relative_log_evidence", F.col("_cut") - F.max("_cut").over(w))
    s = s.withColumn("best_truncated_model", _best_name(cut, w)).withColumn("is_best_truncated", cut & (F.col("model") == F.coalesce(F.col("best_truncated_model"), F.lit(""))))
    return s.withColumn("is_best_model", F.coalesce("is_best_model", F.lit(False))).drop("_max", "_cut")


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """Events, wins and mean evidence of each model and support."""
    ok = evidence.where(ev.succeeded(F.col("status")))
    return ok.groupBy("model", "model_family", "evidence_support", "evidence_comparable").agg(
        F.count("event_index").alias("events"), F.sum(F.col("is_best_model").cast("long")).alias("wins"), F.sum(F.col("is_best_truncated").cast("long")).alias("truncated_wins"),
        F.avg("log_evidence").alias("mean_log_evidence"), F.median("log_evidence").alias("median_log_evidence"), F.avg("relative_log_evidence").alias("mean_relative_log_evidence"),
        F.avg("model_probability").alias("mean_model_probability"), F.avg("runtime_s").alias("mean_runtime_s"),
    ).withColumn("win_fraction", F.col("wins") / F.greatest(F.col("events"), F.lit(1)))


def evidence_margins(scores: DataFrame, scope=EVENT) -> DataFrame:
    """Best and second-best exact model of each event and the margin between them.

    An event of one model leads without limit, which the category calls missing.
    """
    s = one_per_model(with_support(scores).where("evidence_comparable"), scope)
    w = Window.partitionBy(*scope).orderBy(F.desc("log_evidence"), "model")
    top = s.withColumn("r", F.row_number().over(w)).groupBy(*scope).agg(
        F.max(F.when(F.col("r") == 1, F.col("model"))).alias("best_model_by_evidence"), F.max(F.when(F.col("r") == 2, F.col("model"))).alias("second_best_model_by_evidence"),
        F.max(F.when(F.col("r") == 1, F.col("log_evidence"))).alias("best_log_evidence"), F.max(F.when(F.col("r") == 2, F.col("log_evidence"))).alias("second_best_log_evidence"),
        F.count(F.lit(1)).alias("models_compared"),
    )
    margin = F.when(F.col("models_compared") == 1, float("inf")).otherwise(F.col("best_log_evidence") - F.col("second_best_log_evidence"))
    return top.withColumn("evidence_margin", margin).withColumn("evidence_margin_category", ev.margin_category(F.col("evidence_margin")))


def support_scope_margins(scores: DataFrame, scope=EVENT) -> DataFrame:
    """Rank and margin of each row among exact rows of its event, and among truncated ones; never across."""
    s = with_support(scores)
    exact = F.col("evidence_comparable")
    cut = ev.succeeded(F.col("status")) & (F.col("evidence_support") == ev.TRUNCATED)
    s = s.withColumn("scope", F.when(exact, "exact_model").when(cut, "truncated_lower_bound")).where("scope is not null")
    w = Window.partitionBy(*scope, "scope").orderBy(F.desc("log_evidence"), "model", "row_key")
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.nth_value("log_evidence", 2).over(everything)
    best = F.first("log_evidence").over(everything)
    s = s.withColumn("scope_rank", F.row_number().over(w)).withColumn("scope_best_model", F.first("model").over(everything)).withColumn("scope_relative", F.col("log_evidence") - best)
    s = s.withColumn("scope_margin", F.when(second.isNull(), float("inf")).otherwise(best - second))
    return s.withColumn("scope_margin_label", ev.margin_label(F.col("scope_margin")))


def baseline_relative(scores: DataFrame, static: tuple[str, ...], scope=EVENT) -> DataFrame:
    """Each row against the best exact static baseline of its scope, in log units and bits per spike.

    One window serves the baseline, so null scope values form a group of their own.
    """
    s = with_support(scores)
    w = Window.partitionBy(*scope)
    is_static = F.col("model").isin(*static)
    s = s.withColumn("best_static", F.max(F.when(is_static & F.col("evidence_comparable"), F.col("log_evidence"))).over(w))
    delta = F.col("log_evidence") - F.col("best_static")
    s = s.withColumn("delta_vs_best_static", F.when(F.col("evidence_comparable"), delta))
    s = s.withColumn("lower_bound_delta_vs_best_static", F.when(F.col("evidence_support") == ev.TRUNCATED, delta))
    spikes = F.greatest(F.col("test_spikes"), F.lit(1.0))
    return s.withColumn("bits_per_spike_vs_best_static", F.col("delta_vs_best_static") / F.lit(math.log(2)) / spikes)


def reliability(scores: DataFrame, min_spikes: float = 3, min_time: int = 2) -> DataFrame:
    """Flags of rows that should not be trusted, and their reasons joined by semicolons."""
    reasons = F.array(
        F.when(~ev.succeeded(F.col("status")), "score_failure"), F.when(F.col("test_spikes") < min_spikes, "low_spike_count"),
        F.when(F.col("n_time") < min_time, "too_few_time_bins"), F.when(F.coalesce(F.col("support_label"), F.lit("")) == ev.DEGENERATE, "degenerate_single_bin"),
    )
    s = scores.withColumn("event_reliability_reasons", F.concat_ws(";", reasons))
    return s.withColumn("event_reliable", F.col("event_reliability_reasons") == "")


def hierarchical_means(evidence: DataFrame, value: str = "relative_log_evidence") -> DataFrame:
    """Mean over rows, then mean and deviation of session means and of rat means."""
    ok = evidence.where(ev.succeeded(F.col("status")) & F.col(value).isNotNull())
    rows = ok.groupBy("model").agg(F.count(value).alias("event_rows"), F.avg(value).alias("event_mean"))
    out = rows
    for unit, short in (("session", "session"), ("rat", "rat")):
        means = ok.groupBy("model", unit).agg(F.avg(value).alias("m"))
        out = out.join(means.groupBy("model").agg(F.count(unit).alias(f"{short}s"), F.avg("m").alias(f"{short}_mean"), F.stddev_samp("m").alias(f"{short}_sd")), "model", "left")
    return out


def leave_one_group_out(evidence: DataFrame, group: str = "session", value: str = "relative_log_evidence") -> DataFrame:
    """How far each model's mean moves without one group: sums less that group's, with no second scan."""
    ok = evidence.where(ev.succeeded(F.col("status")) & F.col(value).isNotNull() & F.col(group).isNotNull())
    each = ok.groupBy("model", group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy("model")
    full, rest = F.sum("s").over(w) / F.sum("n").over(w), F.sum("n").over(w) - F.col("n")
    out = each.withColumn("full_mean", full).withColumn("leave_one_mean", F.when(rest > 0, (F.sum("s").over(w) - F.col("s")) / rest))
    return out.select("model", F.col(group).alias("left_out_group"), "full_mean", "leave_one_mean", (F.col("leave_one_mean") - F.col("full_mean")).alias("influence_delta"))


def rollups(evidence: DataFrame) -> DataFrame:
    """Events and mean evidence by session, by rat and by seed, each with the model, in one pass."""
    ok = evidence.where(ev.succeeded(F.col("status")))
    return ok.groupingSets([[F.col("session"), F.col("model")], [F.col("rat"), F.col("model")], [F.col("seed"), F.col("model")]], "session", "rat", "seed", "model").agg(
        F.count(F.lit(1)).alias("events"), F.avg("log_evidence").alias("mean_log_evidence"), F.grouping_id().cast("int").alias("level"))


def family_decision(scores: DataFrame, core: tuple[str, ...], threshold: float = 1.0, scope=EVENT) -> DataFrame:
    """Trajectory or not, from the best model of either family, where all core models were scored exactly."""
    s = one_per_model(with_support(scores).where("evidence_comparable"), scope)
    of = lambda f: F.max(F.when(F.col("model_family") == f, F.col("log_evidence")))
    out = s.groupBy(*scope).agg(of("trajectory").alias("trajectory"), of("nontrajectory").alias("nontrajectory"), F.size(F.array_intersect(F.collect_set("model"), F.array(*map(F.lit, core)))).alias("core_models"))
    delta = F.col("trajectory") - F.col("nontrajectory")
    decision = F.when(F.col("core_models") < len(core), "incomplete_core").when(delta >= threshold, "trajectory").when(delta <= -threshold, "nontrajectory").otherwise("ambiguous")
    return out.withColumn("delta", delta).withColumn("decision", decision)


def compare_runs(left: DataFrame, right: DataFrame, scope=EVENT) -> DataFrame:
    """Two runs side by side by event and canonical model name; rows of one run only are kept."""
    def name(df):
        return one_per_model(df.withColumn("model", F.regexp_replace(F.lower(F.trim("model")), "^(state-space|clusterless)-", "")), scope)
    a = name(left).select(*scope, "model", F.col("log_evidence").alias("left_log_evidence"))
    b = name(right).select(*scope, "model", F.col("log_evidence").alias("right_log_evidence"))
    return a.join(b, [*scope, "model"], "full").withColumn("delta", F.col("right_log_evidence") - F.col("left_log_evidence"))


def pareto_front(summary: DataFrame, objectives: dict[str, str], buckets: int = 64) -> DataFrame:
    """Rows that no other row beats: at least as good in all objectives and better in one.

    A missing value is the worst. Settings that agree in all objectives are compared once.
    They are dealt into buckets, and only those that their own bucket does not beat, its
    front, are held against all the other buckets' fronts; what beats a setting is itself
    beaten by a member of some front, so that none is lost.
    """
    value = {c: F.coalesce(F.col(c) if way == "max" else -F.col(c), F.lit(float("-inf"))) for c, way in objectives.items()}
    names = [f"_{c}" for c in objectives]
    points = summary.select(*[v.alias(f"_{c}") for c, v in value.items()]).distinct().withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))

    def unbeaten(rows: DataFrame, within: bool) -> DataFrame:
        a, b = rows.alias("a"), rows.alias("b")
        beats, better = F.lit(True), F.lit(False)
        for n in names:
            beats = beats & (F.col(f"b.{n}") >= F.col(f"a.{n}"))
            better = better | (F.col(f"b.{n}") > F.col(f"a.{n}"))
        on = beats & better & (F.col("a._bucket") == F.col("b._bucket") if within else F.col("a._bucket") != F.col("b._bucket"))
        return a.join(b, on, "left_anti")

    front = unbeaten(unbeaten(points, True), False).drop("_bucket")
    keyed = summary.select("*", *[v.alias(f"_{c}") for c, v in value.items()])
    alive = F.lit(False)
    for c in objectives:
        alive = alive | ev.finite(F.col(c))
    return keyed.where(alive).join(front, names, "left_semi").drop(*names)


def softmax_entropy(evidence: DataFrame, scope=EVENT) -> DataFrame:
    """Entropy of the exact models' probabilities, the best of them, and a low-margin flag."""
    p = F.col("model_probability")
    return evidence.where(p.isNotNull()).groupBy(*scope).agg(F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("entropy"), F.max(p).alias("best_probability"), F.countDistinct("model_family").alias("families")).withColumn("low_margin", F.col("best_probability") < 0.6)
