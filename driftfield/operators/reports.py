"""Further reports over score tables: paired decisions, map controls, influence, features and selection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..sources.rounds import written
from .evidence import EVENT, evidence_margins, one_per_model, with_support
from .models import deals
from .resampling import draw
from .tracks import numbered_islands, numbered_runs, time_cell

#: Quality of a candidate support, and the log masses from which it is good or a warning.
NOT_PRUNED, GOOD, WARNING, POOR, UNCLEAR = "exact_or_not_pruned", "conservative_good", "conservative_warning", "conservative_poor", "conservative_unknown"
GOOD_MASS, WARNING_MASS = -0.01, -0.10
#: Ranges of values that a median is looked for in; draws of a bootstrap that one row makes.
RANGES, DRAWS = 1024, 1 << 16


def last_per_model(scores: DataFrame, value: str = "log_evidence", scope=EVENT) -> DataFrame:
    """Of repeated rows of a model in a scope the last by row_key, among successful rows with a value."""
    ok = scores.where(ev.succeeded(F.col("status")) & F.col(value).isNotNull())
    return ok.groupBy(*scope, "model").agg(F.max(F.struct("row_key", value))[value].alias(value))


def candidate_quality(scores: DataFrame, mass: str = "candidate_log_mass") -> DataFrame:
    """Adds how well a pruned row's candidates cover the posterior; rows that were not pruned are exact."""
    support, m = F.col("evidence_support"), F.col(mass)
    label = (
        F.when(~ev.succeeded(F.col("status")) | support.isin(ev.DEGENERATE, ev.NOT_SCORED, ev.PARTICLE, ev.UNKNOWN), UNCLEAR)
        .when(support != ev.TRUNCATED, NOT_PRUNED).when(~ev.finite(m), UNCLEAR).when(m >= GOOD_MASS, GOOD).when(m >= WARNING_MASS, WARNING).otherwise(POOR)
    )
    return scores.withColumn("candidate_support_quality", label).withColumn("candidate_support_good", F.col("candidate_support_quality").isin(NOT_PRUNED, GOOD))


def grouped_metrics(scores: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Count, mean and median of each value and the share of good candidate supports, by group and model."""
    each = [f(F.col(v)).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("median", F.median))]
    return candidate_quality(scores).groupBy(*by, "model").agg(F.count(values[0]).alias("events"), *each, F.avg(F.col("candidate_support_good").cast("double")).alias("candidate_good_fraction"))


def paired_margin_decisions(scores: DataFrame, positive: str, reference: str, threshold: float = 0.0, scope=EVENT) -> DataFrame:
    """Whether an event's comparable evidence favours one model over another by a margin; events of one of them only are left out."""
    if threshold < 0:
        raise ValueError("a threshold may not be negative")
    s = last_per_model(with_support(scores).where("evidence_comparable"), scope=scope)
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("log_evidence")))
    g = s.where(F.col("model").isin(positive, reference)).groupBy(*scope).agg(pick(positive).alias("positive_log_evidence"), pick(reference).alias("reference_log_evidence")).dropna()
    d = F.col("positive_log_evidence") - F.col("reference_log_evidence")
    return g.withColumn("difference", d).withColumn("decision", F.when(d >= threshold, positive).when(d <= -threshold, reference).otherwise("ambiguous")).withColumn("positive_claimed", d >= threshold)


def common_support_audit(native: DataFrame, common: DataFrame, keys=(*EVENT, "model")) -> DataFrame:
    """Evidence on the native support beside that on a common one."""
    a = native.where(ev.succeeded(F.col("status"))).select(*keys, F.col("log_evidence").alias("native"))
    b = common.where(ev.succeeded(F.col("status"))).select(*keys, F.col("log_evidence").alias("common_support"))
    return a.join(b, list(keys)).withColumn("common_support_delta", F.col("common_support") - F.col("native"))


def map_deltas(real: DataFrame, wrong: DataFrame, fixed: tuple[str, ...], core: tuple[str, ...], trajectory: tuple[str, ...], scope=EVENT) -> DataFrame:
    """log Z under the real map less that under a wrong one: fixed models, and the winners chosen on the real map alone."""
    both = last_per_model(real, scope=scope).withColumnRenamed("log_evidence", "real").join(last_per_model(wrong, scope=scope).withColumnRenamed("log_evidence", "wrong"), [*scope, "model"])
    rows = both.where(F.col("model").isin(*fixed)).select(*scope, F.col("model").alias("statistic"), F.lit("fixed_model").alias("statistic_type"), "model", "real", "wrong")
    for name, models in (("best_exact_core_model_real_map", core), ("best_exact_trajectory_model_real_map", trajectory)):
        place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))  # ties go to the model listed first
        best = both.where(F.col("model").isin(*models)).groupBy(*scope).agg(F.max(F.struct("real", (-place).alias("p"), "model", "wrong")).alias("b"))
        rows = rows.unionByName(best.select(*scope, F.lit(name).alias("statistic"), F.lit("real_map_selected_model").alias("statistic_type"), "b.model", "b.real", "b.wrong"))
    return rows.withColumn("delta", F.col("real") - F.col("wrong"))


def _common_model(rows: DataFrame, by: list[str]) -> DataFrame:
    """The most common model of each group; ties go to the smaller name."""
    n = rows.groupBy(*by, "model").agg(F.count(F.lit(1)).alias("_k"))
    return n.groupBy(*by).agg(F.min(F.struct((-F.col("_k")).alias("k"), "model"))["model"].alias("most_common_model"))


def map_delta_summary(deltas: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Events, positive share, mean, median and range of the deltas of each statistic."""
    keys, d = [*by, "statistic"], F.col("delta")
    s = deltas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.sum((d > 0).cast("long")).alias("positive_events"), F.avg((d > 0).cast("double")).alias("positive_fraction"),
        F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"),
    )
    return s.join(_common_model(deltas, keys), keys)


def leave_one_rat_out(deltas: DataFrame) -> DataFrame:
    """The summary without each rat in turn: each row stands once for every rat but its own.

    The rats, a handful of animals, are listed by the driver.
    """
    rats = sorted(r.rat for r in deltas.select("rat").where("rat is not null").distinct().collect())
    kept = deltas.withColumn("held_out_rat", F.explode(F.array(*map(F.lit, rats)) if rats else F.array().cast("array<string>")))
    return map_delta_summary(kept.where(~F.col("rat").eqNullSafe(F.col("held_out_rat"))), ("held_out_rat",))


def rat_bootstrap(deltas: DataFrame, replicates: int = 200, seed: str = "rats") -> DataFrame:
    """Intervals of the positive share, mean and median over rats drawn with replacement.

    A replicate weighs each rat by how often it is drawn. The median of a replicate is that
    of its rows, each as often as its rat: by running weights over ranges of values, and over
    the values of the range that holds it, so that no replicate copies rows. Even counts take the mean of the two middle values.
    """
    rats = deltas.select("rat").where("rat is not null").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rat")) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    draws = rats.withColumn("n", n).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = draws.select("replicate", F.floor(draw(seed, F.col("replicate"), F.col("i")) * F.col("n")).cast("int").alias("i")).groupBy("replicate", "i").agg(F.count(F.lit(1)).alias("w"))
    weights = drawn.join(rats, "i").select("replicate", "rat", "w")
    # distinct deltas are counted once, and ranges of them by rat: a replicate weighs these counts, and looks into the one range that holds its middle
    counts = written(deltas.where("rat is not null and delta is not null").groupBy("statistic", "rat", "delta").agg(F.count(F.lit(1)).alias("k")), "deltas")
    spans = counts.groupBy("statistic").agg(F.min("delta").alias("_lo"), F.max("delta").alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("delta") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0).cast("long"))
    placed = counts.join(F.broadcast(spans), "statistic").withColumn("_at", at).drop("_lo", "_hi")
    d, k = F.col("delta"), F.col("k")
    ranges = placed.groupBy("statistic", "rat", "_at").agg(F.sum("k").alias("k"), F.sum(F.when(d > 0, k).otherwise(0)).alias("p"), F.sum(d * k).alias("s"))
    ranges = ranges.join(weights, "rat").groupBy("statistic", "replicate", "_at").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in "kps"])
    group = Window.partitionBy("statistic", "replicate")
    ranges = ranges.withColumn("_upto", F.sum("k").over(group.orderBy("_at"))).withColumn("_all", F.sum("k").over(group))
    sides = F.array(F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1)
    whole = ranges.groupBy("statistic", "replicate").agg((F.sum("p") / F.sum("k")).alias("share"), (F.sum("s") / F.sum("k")).alias("mean"))
    sought = ranges.select("statistic", "replicate", "_at", (F.col("_upto") - F.col("k")).alias("_before"), F.posexplode(sides).alias("_side", "_rank")).where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("k")))
    sought = written(sought, "sought")
    near = placed.join(sought, ["statistic", "_at"]).join(weights, ["rat", "replicate"]).groupBy("statistic", "replicate", "_side", "_rank", "_before", "delta").agg(F.sum(F.col("k") * F.col("w")).alias("k"))
    upto = F.col("_before") + F.sum("k").over(Window.partitionBy("statistic", "replicate", "_side").orderBy("delta"))
    middle = near.withColumn("_upto", upto).where("_upto >= _rank").groupBy("statistic", "replicate", "_side").agg(F.min("delta").alias("delta"))
    each = whole.join(middle.groupBy("statistic", "replicate").agg((F.sum("delta") / 2).alias("median")), ["statistic", "replicate"])
    ends = [F.percentile(c, F.lit(p)).alias(f"{c}_{n}") for c in ("share", "mean", "median") for n, p in (("low", 0.025), ("high", 0.975))]
    sure = [F.avg((F.col(c) > 0).cast("double")).alias(f"probability_{c}_positive") for c in ("mean", "median")]
    return each.groupBy("statistic").agg(*ends, *sure)


def cell_influence(scores: DataFrame, cells: str = "train_cell_ids") -> DataFrame:
    """Mean evidence of the rows that list a cell, less the mean of all rows; what is no number is no cell."""
    ok = scores.where(F.col("log_evidence").isNotNull())
    whole = ok.agg(F.avg("log_evidence")).first()[0]
    listed = ok.select("log_evidence", F.explode(F.split(F.col(cells), "[,;]")).alias("c")).withColumn("cell_id", F.trim("c").try_cast("int")).where("cell_id is not null")
    g = listed.groupBy("cell_id").agg(F.count(F.lit(1)).alias("rows_listed"), F.avg("log_evidence").alias("mean_log_evidence"))
    return g.withColumn("delta_vs_global_mean", F.col("mean_log_evidence") - F.lit(whole))


def nested_bootstrap(rows: DataFrame, group: str, unit: str, order: str, value: str, replicates: int = 100, seed: str = "nested") -> DataFrame:
    """Middle 95 % of means where units are drawn with replacement, and then rows within each drawn unit.

    Rows are numbered within their unit; a draw is an equi join on that number. Work is
    replicates x rows.
    """
    r = rows.where(F.col(value).isNotNull()).select(group, unit, F.col(value).alias("v"), F.col(order).alias("o"))
    # what units hold, and in which order, is worked out once and written
    r = written(r.withColumn("i", F.row_number().over(Window.partitionBy(group, unit).orderBy("o")) - 1).drop("o"), "units")
    units = r.groupBy(group, unit).agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy(group)
    units = units.withColumn("u", F.row_number().over(w.orderBy(unit)) - 1).withColumn("units", F.count(F.lit(1)).over(w))
    units = written(units.withColumn("_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(group, unit))), "sizes")
    slots = units.select(group, F.col("u").alias("slot"), "units").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    slots = slots.withColumn("u", F.floor(draw(seed, F.col("replicate"), F.col(group), F.col("slot")) * F.col("units")).cast("int"))
    chosen = slots.select(group, "replicate", "slot", "u").join(units.select(group, "u", "_id", "size"), [group, "u"])
    # a slot's draws are made some at a time over all tasks, and carry numbers alone
    blocks = chosen.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / DRAWS)))).repartition(deals(rows), "_id", "replicate", "slot", "_b")
    inner = blocks.withColumn("k", F.explode(F.sequence(F.col("_b") * DRAWS, F.least(F.col("size"), (F.col("_b") + 1) * DRAWS) - 1)))
    inner = inner.select("_id", "replicate", F.floor(draw(seed, F.col("replicate"), F.col(group), F.col("slot"), F.col("k")) * F.col("size")).cast("int").alias("i"))
    # what is exploded looks small and would be broadcast, so the kind of the join is said
    of = r.join(F.broadcast(units.select(group, unit, "_id")), [group, unit]).select(group, "_id", "i", "v")
    means = inner.join(of.hint("shuffle_hash"), ["_id", "i"]).groupBy(group, "replicate").agg(F.avg("v").alias("mean"))
    return means.groupBy(group).agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"))


def context_conditioning(labels: DataFrame, well: str = "true_well_id") -> DataFrame:
    """The next well as text, and a confidence that falls with the time to it."""
    t = F.greatest(F.col("time_to_arrival_s"), F.lit(0.0))
    return labels.select(*EVENT, F.coalesce(F.col(well).cast("string"), F.lit("unknown")).alias("next_well_context"), F.when(F.col("time_to_arrival_s").isNotNull(), 1 / (1 + t)).alias("context_confidence"))


def disagreement_events(evidence: DataFrame, scope=EVENT) -> DataFrame:
    """Entropy over successful models, which families were scored, and whether the lead is a tie or weak."""
    ok, p = evidence.where(ev.succeeded(F.col("status"))), F.col("model_probability")
    mass = F.when(p > 0, p)
    has = lambda cond: F.max(cond.cast("int")) == 1
    m = F.col("model")
    g = ok.groupBy(*scope).agg(
        F.min("best_model").alias("best_model"), has(m.startswith("sorted-spike")).alias("has_sorted_spike"), has(m.startswith("clusterless")).alias("has_clusterless"),
        has(m.contains("goal")).alias("has_goal"), has(m.contains("reverse")).alias("has_reverse"), F.countDistinct("model").alias("models_scored"),
        (F.log(F.sum(mass)) - F.sum(mass * F.log(mass)) / F.sum(mass)).alias("model_probability_entropy"),
    )
    margins = evidence_margins(evidence, scope).select(*scope, "evidence_margin_category")
    return g.join(margins, list(scope), "left").withColumn("is_low_margin", F.coalesce(F.col("evidence_margin_category").isin("tie", "weak"), F.lit(False)))


def normalised_evidence(scores: DataFrame, value: str = "log_evidence", bins: str = "n_time", spikes: str = "test_spikes") -> DataFrame:
    """Evidence per time bin and per spike; nothing where there are none."""
    return scores.withColumn("per_time_bin", F.when(F.col(bins) != 0, F.col(value) / F.col(bins))).withColumn("per_spike", F.when(F.col(spikes) != 0, F.col(value) / F.col(spikes)))


def evidence_features(scores: DataFrame, core: tuple[str, ...], trajectory: tuple[str, ...], first: str, second: str, scope=EVENT) -> DataFrame:
    """Probabilities over a core of models that must all be there, the trajectory share of them,
    P(first) - P(second), the best of either family and their margin."""
    s = last_per_model(scores, scope=scope).where(F.col("model").isin(*core))
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("log_evidence")))
    is_path = F.col("model").isin(*trajectory)
    best = lambda cond: F.min(F.when(cond, F.struct((-F.col("log_evidence")).alias("e"), "model")))
    g = s.groupBy(*scope).agg(*[pick(m).alias(f"_{i}") for i, m in enumerate(core)], best(is_path).alias("_t"), best(~is_path).alias("_n"))
    full, top = F.lit(True), F.greatest(*[F.col(f"_{i}") for i in range(len(core))])
    for i in range(len(core)):
        full = full & F.col(f"_{i}").isNotNull()
    total = sum((F.exp(F.col(f"_{i}") - top) for i in range(len(core))), F.lit(0.0))
    p = {m: F.when(full, F.exp(F.col(f"_{i}") - top) / total) for i, m in enumerate(core)}
    missing = F.concat_ws(" ", *[F.when(F.col(f"_{i}").isNull(), m) for i, m in enumerate(core)])
    return g.select(
        *scope, full.alias("core_complete"), missing.alias("missing_core_models"), *[c.alias(f"p_{i}") for i, c in enumerate(p.values())],
        sum((p[m] for m in core if m in trajectory), F.lit(0.0)).alias("trajectory_mass"), (p[first] - p[second]).alias("momentum_index"),
        F.col("_t.model").alias("best_trajectory_model"), F.col("_n.model").alias("best_nontrajectory_model"), (F.col("_n.e") - F.col("_t.e")).alias("trajectory_margin"),
    )


def parameter_selection(evidence: DataFrame, recovery: DataFrame, parameters: list[str], least_recovery: float, most_failures: int) -> DataFrame:
    """Every setting of either table: what is known of it, whether it passes the gates and its rank among those that do.

    evidence: parameters, mean_evidence, failures; recovery: parameters, recovery_accuracy.
    Null parameters match null.
    """
    e, r = evidence.withColumn("has_evidence", F.lit(True)).alias("e"), recovery.withColumn("has_recovery", F.lit(True)).alias("r")
    same = F.lit(True)
    for c in parameters:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = e.join(r, same, "full").select(*[F.coalesce(f"e.{c}", f"r.{c}").alias(c) for c in parameters], "mean_evidence", "failures", "recovery_accuracy", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_evidence", "has_recovery")])
    reasons = F.concat_ws(";", F.when(~F.col("has_evidence"), "no_evidence"), F.when(~F.col("has_recovery"), "no_recovery"), F.when(F.col("recovery_accuracy") < least_recovery, "low_recovery"), F.when(F.col("failures") > most_failures, "failures"))
    out = both.withColumn("gate_reasons", reasons).withColumn("passes", reasons == "")
    rank = F.row_number().over(Window.partitionBy("passes").orderBy(F.desc_nulls_last("mean_evidence"), *parameters))
    return out.withColumn("selection_rank", F.when(F.col("passes"), rank))


def source_groups(tables: dict[str, DataFrame], group: str, keys: list[str]) -> DataFrame:
    """Rows of each table by source group, for every group of any table; distinct keys of each count once."""
    rows = [t.where(F.col(group).isNotNull()).select(F.col(group).alias("source_group"), *keys).distinct().withColumn("_from", F.lit(n)) for n, t in tables.items()]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.groupBy("source_group").agg(*[F.sum((F.col("_from") == n).cast("long")).alias(n) for n in tables])


#: A window is named by its session, its event and its number among that event's windows.
WINDOW_KEY = ["session", "event_index", "null_index"]


def overlap_groups(tables: dict[str, DataFrame]) -> DataFrame:
    """WINDOW_KEY, start, end, source and overlap_group of the windows of several tables.

    Windows of a session that overlap or touch, whatever table they come from and directly
    or by way of others, have one group: the session and the group's number in time order.
    A window that a table holds twice is there twice.
    """
    rows = [t.select(*WINDOW_KEY, "start", "end").withColumn("source", F.lit(n)) for n, t in tables.items()]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return numbered_islands(every).withColumn("overlap_group", F.concat_ws("|", "session", F.col("_island").cast("string"))).drop("_island")


def one_per_overlap(tables: dict[str, DataFrame], value: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """One window of each overlap group: that of the largest value, ties by key; and how many windows of each table it stands for.

    value: WINDOW_KEY and value, of the windows that may be chosen. Windows whose key is
    among the `taken` ones are left out before they are grouped, by the whole key, so that an
    event number of another session takes nothing. Groups without a window that may be chosen have no row.
    """
    left = {n: t if taken is None else t.join(taken.select(*WINDOW_KEY).distinct(), WINDOW_KEY, "left_anti") for n, t in tables.items()}
    groups = overlap_groups(left)
    counts = groups.groupBy("overlap_group").agg(*[F.sum((F.col("source") == n).cast("long")).alias(n) for n in tables], F.min("start").alias("group_start"), F.max("end").alias("group_end"))
    windows = groups.dropDuplicates([*WINDOW_KEY, "overlap_group"]).join(value.select(*WINDOW_KEY, "value").where("value is not null"), WINDOW_KEY)
    chosen = strongest_of_group(windows, "overlap_group", "value", WINDOW_KEY).select(*WINDOW_KEY, "start", "end", "value", "overlap_group")
    return chosen.join(counts, "overlap_group")


def strongest_of_group(rows: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """One row of each group: that of the largest value, ties by the order columns; rows without a group all stay."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(value), *order)
    return rows.withColumn("_r", F.when(F.col(group).isNotNull(), F.row_number().over(w)).otherwise(1)).where("_r = 1").drop("_r")


def sweep_recovery(positions: DataFrame, recovery: DataFrame, keys: list[str]) -> DataFrame:
    """Decoding summaries beside the overall recovery of their sweep setting, best first by rank."""
    overall = recovery.where("true_model = 'overall'").select(*keys, F.col("recovered").alias("simulation_recovery"), F.col("events").alias("simulation_events"))
    both = positions.join(overall, keys, "left")
    w = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("median_error"), F.desc_nulls_last("simulation_recovery"), *keys)
    return both.withColumn("rank", F.row_number().over(w))


def null_calibration(windows: DataFrame, label: str, state: str, margin: str, threshold: float) -> DataFrame:
    """How many windows would pass if labels, states or both were shuffled among all windows.

    A window passes with its label, its state and enough margin. Shuffling makes the number
    that pass hypergeometric, so its whole law follows from four counts: nothing is
    shuffled, and the mean, the 95th and 99th percentile and the chance to reach what was
    seen are exact. The share of false passes is the mean over what was seen.
    """
    l, s, m = F.col(label), F.col(state), F.col(margin) >= threshold
    yes = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    c = windows.agg(F.count(F.lit(1)).alias("n"), yes(l).alias("l"), yes(s).alias("s"), yes(m).alias("m"), yes(s & m).alias("sm"), yes(l & m).alias("lm"), yes(l & s & m).alias("seen")).first().asDict()
    c = {k: int(v or 0) for k, v in c.items()}
    rows = []
    for name, law in (
        ("label_shuffle", hypergeometric(c["n"], c["l"], c["sm"])), ("state_shuffle", hypergeometric(c["n"], c["s"], c["lm"])),
        ("joint_shuffle", shuffled_twice(c["n"], c["l"], c["s"], c["m"])),
    ):
        low, p = law
        upto, at = np.cumsum(p), low + np.arange(len(p))
        mean = float((p * at).sum())
        rows.append((name, c["n"], c["seen"], mean, int(at[np.searchsorted(upto, 0.95 - 1e-12)]), int(at[np.searchsorted(upto, 0.99 - 1e-12)]), float(p[at >= c["seen"]].sum()), mean / c["seen"] if c["seen"] else None))
    return windows.sparkSession.createDataFrame(rows, "null string, windows long, passing long, mean_null double, p95_null long, p99_null long, p_value double, false_discovery_rate double")


def hypergeometric(n: int, marked: int, drawn: int) -> tuple[int, np.ndarray]:
    """The least number of marked ones among the drawn, and the probabilities from there on; far tails are left out."""
    low, high = max(0, drawn + marked - n), min(drawn, marked)
    if high > low:  # 40 deviations hold all that a double can tell from nothing
        mean = drawn * marked / n
        reach = 40 * math.sqrt(max(1.0, mean * (n - marked) / n * (n - drawn) / max(1, n - 1))) + 40
        low, high = max(low, int(mean - reach)), min(high, int(mean + reach) + 1)
    k = np.arange(low, high)
    step = np.log((marked - k) * (drawn - k) / ((k + 1.0) * (n - marked - drawn + k + 1.0)))
    log = np.concatenate(([0.0], np.cumsum(step)))
    p = np.exp(log - log.max())
    return low, p / p.sum()


def shuffled_twice(n: int, first: int, second: int, fixed: int) -> tuple[int, np.ndarray]:
    """The law of how many fixed ones get both marks, dealt apart from each other."""
    low, p = hypergeometric(n, first, fixed)
    out = np.zeros(min(first, second, fixed) + 1)
    for k, share in zip(range(low, low + len(p)), p):
        if share > 1e-15:
            start, q = hypergeometric(n, second, k)
            out[start : start + len(q)] += share * q
    return 0, out / out.sum()


def random_effects(evidence: DataFrame, models: list[str], prior: float = 10.0, steps: int = 200, tolerance: float = 1e-6, samples: int = 20_000, scope=EVENT) -> DataFrame:
    """Share of each model over events and how likely it is the largest, where models vary from event to event.

    The Dirichlet law of the shares is found by variational steps: each is one aggregation of
    the events' softmax weights, whose sums, one number a model, are all that the driver
    holds. Events without a finite value of every model take no part.
    """
    s = one_per_model(evidence.where(ev.finite(F.col("log_evidence")) & F.col("model").isin(*models)), scope)
    pick = [F.max(F.when(F.col("model") == m, F.col("log_evidence"))).alias(f"_{i}") for i, m in enumerate(models)]
    g = s.groupBy(*scope).agg(*pick).dropna().select(*[f"_{i}" for i in range(len(models))]).persist()
    try:
        alpha = np.full(len(models), prior)
        for _ in range(steps):
            logs = digamma(alpha) - digamma(alpha.sum())
            z = [F.col(f"_{i}") + float(v) for i, v in enumerate(logs)]
            top = F.greatest(*z) if len(z) > 1 else z[0]
            w = [F.exp(c - top) for c in z]
            total = sum(w[1:], w[0])
            counts = np.array([float(x or 0) for x in g.agg(*[F.sum(x / total) for x in w]).first()])
            moved, alpha = np.abs(prior + counts - alpha).max(), prior + counts
            if moved < tolerance * alpha.sum():
                break
    finally:
        g.unpersist()
    r = np.random.default_rng(0).dirichlet(alpha, samples)
    best = np.bincount(r.argmax(1), minlength=len(models)) / samples
    return evidence.sparkSession.createDataFrame([(m, float(a / alpha.sum()), float(b)) for m, a, b in zip(models, alpha, best)], "model string, p_model double, p_exceedance double")


def digamma(x) -> np.ndarray:
    """Derivative of ln gamma for x > 0: the asymptotic series at x + 6, brought back by the recurrence."""
    x = np.asarray(x, float)
    y = x + 6
    out = np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    return out - sum(1 / (x + k) for k in range(6))


def predictive_checks(counts: DataFrame, keys=EVENT) -> DataFrame:
    """Observed against expected spikes of each event: the total and its z, silent bins, and the mean and largest |z| of a cell's bin.

    counts: keys, t_idx, cell_id, observed, expected, all cells in every bin.
    """
    z = F.abs(F.col("observed") - F.col("expected")) / F.sqrt(F.greatest(F.col("expected"), F.lit(2.220446049250313e-16)))
    bins = counts.groupBy(*keys, "t_idx").agg(F.sum("observed").alias("o"), F.sum("expected").alias("e"), F.sum(z).alias("z"), F.max(z).alias("zm"), F.count(F.lit(1)).alias("k"))
    return bins.groupBy(*keys).agg(
        F.sum("o").alias("observed_total"), F.sum("e").alias("expected_total"), ((F.sum("o") - F.sum("e")) / F.sqrt(F.greatest(F.sum("e"), F.lit(2.220446049250313e-16)))).alias("total_z"),
        F.avg((F.col("o") == 0).cast("double")).alias("silent_fraction"), F.avg(F.exp(-F.col("e"))).alias("expected_silent_fraction"),
        (F.sum("z") / F.sum("k")).alias("mean_abs_z"), F.max("zm").alias("max_abs_z"),
    )


def drift_blocks(marks: DataFrame, features: list[str], blocks: int, by: str = "session", order=("t",)) -> DataFrame:
    """Blocks of equal numbers of marks in time order: size, span, mean and variance, and how far the mean lies from that of all marks and of the first block."""
    good = F.lit(True)
    for c in ("t", *features):
        good = good & ev.finite(F.col(c))
    # places through time cells; the first blocks have one mark more where the number does not divide
    m = numbered_runs(marks.where(good).withColumn("_cell", time_cell()), F.lit(1), "_place", by, list(order)).drop("_cell")
    m = m.join(m.groupBy(by).agg(F.count(F.lit(1)).alias("_all")), by)
    at, size, over = F.col("_place") - 1, F.floor(F.col("_all") / blocks), F.col("_all") % blocks
    long = over * (size + 1)
    m = m.withColumn("block", F.when(at < long, F.floor(at / (size + 1))).otherwise(over + F.floor((at - long) / F.greatest(size, F.lit(1)))).cast("int")).drop("_place", "_all")
    sums = [f(F.col(c)).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("var", F.var_pop))]
    b = m.groupBy(by, "block").agg(F.count(F.lit(1)).alias("marks"), F.min("t").alias("start"), F.max("t").alias("end"), *sums)
    w = Window.partitionBy(by)

    def far(of) -> Column:
        return F.sqrt(sum((F.pow(F.col(f"mean_{c}") - of(c), 2) for c in features), F.lit(0.0)))

    whole = lambda c: F.sum(F.col(f"mean_{c}") * F.col("marks")).over(w) / F.sum("marks").over(w)
    first = lambda c: F.max(F.when(F.col("block") == 0, F.col(f"mean_{c}"))).over(w)
    return b.withColumn("from_all", far(whole)).withColumn("from_first", far(first))
