"""Priors over grids of settings, fitted to the settings that explain each event best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.likelihood import TINY

#: Best settings inside the grid that a fit needs, and Newton steps of the shape.
LEAST, STEPS = 3, 30


def _digamma(x: Column) -> Column:
    y = x + 6
    out = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y**4) - 1 / (252 * y**6)
    for k in range(6):
        out = out - 1 / (x + k)
    return out


def _trigamma(x: Column) -> Column:
    y = x + 6
    out = 1 / y + 1 / (2 * y * y) + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7)
    for k in range(6):
        out = out + 1 / (x + k) ** 2
    return out


def inverse_gamma_shape(mean_log: Column, mean_inverse: Column) -> Column:
    """The likeliest shape of inverse-gamma values from the means of their logarithms and inverses: log a - digamma(a) = log(mean 1/x) + mean log x."""
    s = F.log(mean_inverse) + mean_log

    def newton(a: Column, _: Column) -> Column:
        return 1 / (1 / a + (F.log(a) - _digamma(a) - s) / (a * a * (1 / a - _trigamma(a))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.when(s > 0, 0.5 / s), newton)


def best_settings(scores: DataFrame, event: list[str], settings: list[str], value: str) -> DataFrame:
    """The settings of the largest value of each event; ties go to the least settings. Rows without a value do not count."""
    order = F.struct(F.col(value), *[-F.col(c) for c in settings])
    return scores.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*event).agg(F.max_by(F.struct(*settings), order).alias("_b")).select(*event, "_b.*")


def fitted_priors(scores: DataFrame, event: list[str], by: list[str], settings: list[str], value: str) -> DataFrame:
    """by, settings and prior, which adds up to 1 over each group's grid of settings.

    scores: one row per event and setting; `by` are some of the columns of `event`. One
    setting is given an inverse-gamma law (without an offset), two a normal law of their
    logarithms, from sums over the events' best settings that lie inside the grid. With
    fewer than LEAST of those, or all alike, every setting has the same prior.
    """
    if len(settings) not in (1, 2):
        raise ValueError("priors are fitted to one or two settings")
    grid = scores.select(*by, *settings).distinct()
    edges = grid.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in settings for n, f in (("low", F.min), ("high", F.max))])
    inside = F.lit(True)
    for c in settings:
        inside = inside & (F.col(c) != F.col(f"_low_{c}")) & (F.col(c) != F.col(f"_high_{c}"))
    logs = [F.log(c) for c in settings]
    best = best_settings(scores, event, settings, value).join(edges, by).where(inside)
    of = best.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min(settings[0]).alias("_least"), F.max(settings[0]).alias("_most"), F.avg(1 / F.col(settings[0])).alias("_inverse"),
        *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(logs)], *[F.sum(x * y).alias(f"_s{i}{j}") for i, x in enumerate(logs) for j, y in enumerate(logs)])
    g = grid.join(of, by, "left")
    enough = F.coalesce(F.col("_n") >= LEAST, F.lit(False))
    if len(settings) == 1:
        x, a = F.col(settings[0]), inverse_gamma_shape(F.col("_m0"), F.col("_inverse"))
        enough = enough & (F.col("_most") - F.col("_least") > 1e-8 + 1e-5 * F.col("_least"))
        g = g.withColumn("_a", F.when(enough, a)).withColumn("_log", -(F.col("_a") + 1) * F.log(x) - F.col("_a") / F.col("_inverse") / x)
    else:
        n = F.col("_n")
        cov = lambda i, j: (F.col(f"_s{i}{j}") - n * F.col(f"_m{i}") * F.col(f"_m{j}")) / (n - 1) + (1e-9 if i == j else 0)
        g = g.withColumns({"_c00": cov(0, 0), "_c01": cov(0, 1), "_c11": cov(1, 1), "_d0": logs[0] - F.col("_m0"), "_d1": logs[1] - F.col("_m1")})
        det = F.col("_c00") * F.col("_c11") - F.col("_c01") * F.col("_c01")
        square = (F.col("_c11") * F.col("_d0") ** 2 - 2 * F.col("_c01") * F.col("_d0") * F.col("_d1") + F.col("_c00") * F.col("_d1") ** 2) / det
        g = g.withColumn("_log", F.when(enough & (det > 0), -0.5 * square))
    w = Window.partitionBy(*by)
    finite = F.col("_log").isNotNull() & ~F.isnan("_log") & (F.abs("_log") < float("inf"))
    g = g.withColumn("_w", F.when(F.min(finite).over(w), F.exp(F.col("_log") - F.max("_log").over(w))).otherwise(1.0))
    return g.select(*by, *settings, F.greatest(F.col("_w") / F.sum("_w").over(w), F.lit(TINY)).alias("prior"))
