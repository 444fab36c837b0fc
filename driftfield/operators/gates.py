"""Calibration, recovery and quality gates: small reports from large result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as ev


def calibration(samples: DataFrame) -> DataFrame:
    """Mean negative log-likelihood, rank fraction and how often the true bin is in the top 50, 80 and 95 %."""
    covered = lambda p: F.avg((F.col("rank_fraction") <= p).cast("double"))
    return samples.groupBy("session").agg(
        F.avg(-F.log(F.greatest("true_probability", F.lit(1e-300)))).alias("mean_nll"), F.avg("rank_fraction").alias("mean_rank_fraction"),
        covered(0.5).alias("coverage_50"), covered(0.8).alias("coverage_80"), covered(0.95).alias("coverage_95"), F.count(F.lit(1)).alias("windows"),
    )


def confusion(pairs: DataFrame, models: list[str]) -> DataFrame:
    """Counts of true against best model; the list of models fixes the columns."""
    return pairs.groupBy("true_model").pivot("best_model", models).count().na.fill(0)


def recovery(pairs: DataFrame) -> DataFrame:
    """Recovered fraction by true model and overall."""
    return pairs.rollup("true_model").agg(F.count(F.lit(1)).alias("events"), F.avg((F.col("true_model") == F.col("best_model")).cast("double")).alias("recovered")).withColumn("true_model", F.coalesce("true_model", F.lit("overall")))


def certified_recovery(best: DataFrame) -> DataFrame:
    """Whether the expected model won among exact scores, or its lower bound beats the best exact score."""
    exact = F.coalesce(F.col("best_exact_model") == F.col("expected_model"), F.lit(False))
    bound = F.coalesce(F.col("expected_lower_bound") > F.col("best_exact_log_evidence"), F.lit(False))
    reason = F.when(exact, "exact_best").when(bound, "certified_lower_bound").when(F.col("best_exact_model").isNull() & F.col("expected_lower_bound").isNull(), "not_scored").when(F.col("expected_lower_bound").isNull(), "other_exact_best").otherwise("lower_bound_not_certified")
    return best.withColumn("recovered", exact | bound).withColumn("reason", reason)


def quality_gates(evidence: DataFrame, limits: dict[str, tuple]) -> DataFrame:
    """One row per gate: the value, the limit, and pass, warn or fail. A gate without a value gives info.

    limits: gate -> (min or max, limit) or (min or max, limit, a laxer limit up to which a miss only warns).
    """
    ok = ev.succeeded(F.col("status"))
    values = evidence.agg(
        F.avg(ok.cast("double")).alias("success_fraction"), F.avg(F.col("evidence_comparable").cast("double")).alias("comparable_fraction"),
        F.avg((F.col("n_time") < 2).cast("double")).alias("short_fraction"), F.avg("test_spikes").alias("mean_spikes"),
    )
    rows = values.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.lit(way).alias("direction"), F.lit(float(limit)).alias("limit"), F.lit(float(lax[0]) if lax else float(limit)).alias("_lax")) for g, (way, limit, *lax) in limits.items()])).alias("g")).select("g.*")
    meets = lambda c: F.when(F.col("direction") == "min", F.col("value") >= F.col(c)).otherwise(F.col("value") <= F.col(c))
    return rows.withColumn("result", F.when(F.col("value").isNull(), "info").when(meets("limit"), "pass").when(meets("_lax"), "warn").otherwise("fail")).drop("_lax")


def sweep_aggregate(rows: DataFrame, settings: list[str], metrics: list[str]) -> DataFrame:
    """Replicates, seeds, mean and deviation of each metric by setting; null settings stay groups."""
    each = [f(F.col(m)).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*settings).agg(F.countDistinct("seed").alias("random_seed_count"), F.concat_ws(",", F.sort_array(F.collect_set("seed")).cast("array<string>")).alias("random_seeds"), F.count(F.lit(1)).alias("sweep_replicates"), *each)


def window_sensitivity(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How much an event's value moves over its window variants."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.countDistinct("variant").alias("variants"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high")).withColumn("range", F.col("high") - F.col("low"))


def window_variants(events: DataFrame, pads: list[float], shortest: float) -> DataFrame:
    """Each event widened by each pad, not below 0, and its middle half."""
    padded = events.withColumn("pad", F.explode(F.array(*map(F.lit, pads)))).select("session", "event_index", F.concat(F.lit("pad_"), F.col("pad").cast("int").cast("string")).alias("variant"), F.greatest(F.lit(0.0), F.col("start") - F.col("pad")).alias("start"), (F.col("end") + F.col("pad")).alias("end"))
    middle, half = (F.col("start") + F.col("end")) / 2, F.greatest((F.col("end") - F.col("start")) * 0.25, F.lit(shortest * 0.5))
    return padded.unionByName(events.select("session", "event_index", F.lit("centre_half").alias("variant"), F.greatest(F.lit(0.0), middle - half).alias("start"), (middle + half).alias("end")))
