"""Resampling and controls. Draws come from digests of names, so results repeat anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import finite


def draw(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of the parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 12), 16, 10).cast("double") / float(16**12)


def bootstrap_means(rows: DataFrame, group: str, unit: str, value: str, replicates: int, seed: str = "boot") -> DataFrame:
    """Mean of each group over units drawn with replacement, for each replicate.

    Rows are first summed by unit. Replicate r draws as many units as there are: draw i is
    the unit of number floor(u * n), so one equi join replaces any random access.
    """
    units = rows.groupBy(group, unit).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(group)
    numbered = units.withColumn("i", F.row_number().over(w.orderBy(unit)) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    draws = numbered.select(group, "i", "size").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.select(group, "replicate", F.floor(draw(seed, F.col("replicate"), F.col(group), F.col("i")) * F.col("size")).cast("int").alias("i"))
    return draws.join(numbered.select(group, "i", "s", "n"), [group, "i"]).groupBy(group, "replicate").agg((F.sum("s") / F.sum("n")).alias("mean"))


def bootstrap_interval(rows: DataFrame, group: str, unit: str, value: str, replicates: int = 200) -> DataFrame:
    """Observed mean and the middle 95 % of bootstrap means of each group."""
    means = bootstrap_means(rows, group, unit, value, replicates)
    ci = means.groupBy(group).agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"))
    return rows.groupBy(group).agg(F.avg(value).alias("mean"), F.countDistinct(unit).alias("units")).join(ci, group)


def sign_flip_exact(rows: DataFrame, group: str, unit: str, value: str, most: int = 20, draws: int = 10000) -> DataFrame:
    """Two-sided p of each group's mean over units: under all 2**n sign patterns where n is at most `most`, else sampled.

    Every group has one row, with the method. Units of mean zero are left out of the patterns,
    as no sign changes them; without any other unit p is 1, and null without a finite value. Patterns are the numbers below
    2**n, whose bits are the signs; no pattern is stored.
    """
    means = rows.groupBy(group, unit).agg(F.avg(value).alias("m")).withColumn("m", F.when(finite(F.col("m")), F.col("m")))
    size = means.groupBy(group).agg(F.count(F.when(F.col("m") != 0, 1)).alias("units"), F.count("m").alias("_any"))
    small, large = size.where(F.col("units").between(1, most)), size.where(F.col("units") > most)
    sides = means.where("m <> 0").join(small.select(group), group, "left_semi").groupBy(group).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    patterns = sides.withColumn("pattern", F.explode(F.expr("sequence(0L, shiftleft(1L, size(ms)) - 1)")))
    total = F.expr("aggregate(sequence(0, size(ms) - 1), 0D, (a, i) -> a + if(shiftright(pattern, i) & 1 = 1, -ms[i], ms[i]))")
    seen = F.aggregate("ms", F.lit(0.0), lambda a, x: a + x)
    n = patterns.withColumn("extreme", (F.abs(total) >= F.abs(seen) - 1e-12).cast("long"))
    exact = n.groupBy(group).agg(F.sum("extreme").alias("extreme"), F.count(F.lit(1)).alias("patterns")).withColumn("method", F.lit("exact")).withColumn("p_value", F.col("extreme") / F.col("patterns"))
    sampled = sign_flip_sampled(means.where("m <> 0").join(large.select(group), group, "left_semi"), group, unit, "m", draws)
    sampled = sampled.select(group, F.round(F.col("p_value") * (draws + 1) - 1).cast("long").alias("extreme"), F.lit(draws).cast("long").alias("patterns"), F.lit("monte_carlo").alias("method"), "p_value")
    some = F.col("_any") > 0
    one = some.cast("long")
    none = size.where("units = 0").select(group, one.alias("extreme"), one.alias("patterns"), F.when(some, "exact").otherwise("no_finite_value").alias("method"), F.when(some, 1.0).alias("p_value"))
    found = exact.select(sampled.columns).unionByName(sampled).unionByName(none)
    return size.select(group, F.col("units").cast("int").alias("units")).join(found, group)


def sign_flip_sampled(rows: DataFrame, group: str, unit: str, value: str, draws: int = 500) -> DataFrame:
    """p from sampled sign patterns, (1 + hits) / (draws + 1)."""
    means = rows.groupBy(group, unit).agg(F.avg(value).alias("m"))
    sign = F.when(draw("sign", F.col("draw"), F.col(unit)) < 0.5, -1.0).otherwise(1.0)
    null = means.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).groupBy(group, "draw").agg(F.sum(sign * F.col("m")).alias("null"))
    seen = means.groupBy(group).agg(F.sum("m").alias("seen"))
    return null.join(seen, group).groupBy(group).agg(((F.lit(1) + F.sum((F.abs("null") >= F.abs("seen") - 1e-12).cast("long"))) / F.lit(draws + 1)).alias("p_value"))


def control_p_values(observed: DataFrame, controls: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(1 + controls at least as large) / (controls + 1) for each key; 1 where there are none."""
    c = controls.select(*keys, F.col(value).alias("_c"))
    n = F.count("_c")
    return observed.join(c, keys, "left").groupBy(*keys, value).agg(n.alias("controls"), F.sum(F.coalesce((F.col("_c") >= F.col(value)).cast("long"), F.lit(0))).alias("at_least")).withColumn("p_value", (F.col("at_least") + 1) / (F.col("controls") + 1))


def circular_shift(spikes: DataFrame, seed: str = "shift") -> DataFrame:
    """Each cell's spike times moved round the session's span by an amount of its own."""
    spans = spikes.groupBy("session").agg(F.min("t").alias("_low"), (F.max("t") - F.min("t") + 1.0).alias("_span"))
    s = spikes.join(spans, "session")
    moved = F.col("t") - F.col("_low") + draw(seed, F.col("session"), F.col("cell_id")) * F.col("_span")
    return s.withColumn("t", F.col("_low") + moved - F.floor(moved / F.col("_span")) * F.col("_span")).drop("_low", "_span")


def permute_cells(cells: DataFrame, seed: str = "cells") -> DataFrame:
    """Each session's cell ids dealt anew: the next id in a hashed order, so that no id keeps its place."""
    w = Window.partitionBy("session").orderBy(draw(seed, F.col("session"), F.col("cell_id")), "cell_id")
    nxt = F.coalesce(F.lead("cell_id").over(w), F.first("cell_id").over(w))
    return cells.withColumn("new_cell_id", nxt)


def cell_split(cells: DataFrame, seeds: int, fraction: float, strata: int | None = None, rate: str | None = None) -> DataFrame:
    """Test or train for each cell and split seed, by a hashed order within each session or rate stratum."""
    c = cells.withColumn("split_seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    by = ["session", "split_seed"]
    if strata and rate:
        c = c.withColumn("stratum", F.ntile(strata).over(Window.partitionBy(*by).orderBy(rate, "cell_id")))
        by.append("stratum")
    w = Window.partitionBy(*by)
    order = w.orderBy(draw("split", F.col("split_seed"), F.col("session"), F.col("cell_id")), "cell_id")
    n = F.greatest(F.lit(1), F.round(F.count(F.lit(1)).over(w) * fraction).cast("int"))
    return c.withColumn("is_test", F.row_number().over(order) <= n)


def difference_in_differences(real: DataFrame, control: DataFrame, keys: list[str], value: str, positive: tuple[str, ...]) -> DataFrame:
    """Per unit: how much more the real map favours positive models than the control map does."""
    both = real.select(*keys, "model", F.col(value).alias("r")).join(control.select(*keys, "model", F.col(value).alias("c")), [*keys, "model"])
    is_pos = F.col("model").isin(*positive)
    best = lambda c, f: F.max(F.when(f, F.col(c)))
    g = both.groupBy(*keys).agg((best("r", is_pos) - best("r", ~is_pos)).alias("real_margin"), (best("c", is_pos) - best("c", ~is_pos)).alias("control_margin"))
    return g.withColumn("did", F.col("real_margin") - F.col("control_margin"))


def margin_threshold(pairs: DataFrame, thresholds: list[float], max_false: float, min_recall: float) -> DataFrame:
    """False-positive rate and recall at each threshold, and the smallest that meets both limits.

    Each row meets its few thresholds by an explode; without any that fits, none is selected.
    """
    t = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit = (F.col("margin") >= F.col("threshold")).cast("double")
    rates = t.groupBy("threshold").agg(F.avg(F.when(F.col("is_true"), hit)).alias("recall"), F.avg(F.when(~F.col("is_true"), hit)).alias("false_positive_rate"))
    ok = (F.coalesce("false_positive_rate", F.lit(0.0)) <= max_false) & (F.coalesce("recall", F.lit(0.0)) >= min_recall)
    first = F.min(F.when(ok, F.col("threshold"))).over(Window.partitionBy())
    return rates.withColumn("selected", F.coalesce(F.col("threshold") == first, F.lit(False)))


def chosen_threshold(rates: DataFrame) -> DataFrame:
    """One row from margin_threshold's: the selected threshold, or where none meets the limits that of the fewest false positives, and why."""
    rank = F.struct((~F.col("selected")).cast("int").alias("a"), F.coalesce("false_positive_rate", F.lit(0.0)).alias("b"), (-F.coalesce("recall", F.lit(0.0))).alias("c"), F.col("threshold"))
    best = rates.agg(F.min_by(F.struct("threshold", "recall", "false_positive_rate", "selected"), rank).alias("r")).select("r.*")
    return best.where("threshold is not null").withColumn("reason", F.when(F.col("selected"), "meets_limits").otherwise("no_threshold_meets_limits"))
