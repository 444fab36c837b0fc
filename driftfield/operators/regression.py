"""Regression and marginalisation over result tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.likelihood import log_sum_exp


def cluster_robust(rows: DataFrame, response: str, terms: list[str], cluster: str) -> DataFrame:
    """Least squares with an intercept and cluster-robust standard errors: term, estimate, se, t.

    Two passes of sums: first X'X and X'y, then each cluster's score X'e, whose outer
    products are summed by Spark; the driver solves a system of as many rows as terms.
    """
    names = ["intercept", *terms]
    x = [F.lit(1.0), *[F.col(t).cast("double") for t in terms]]
    y = F.col(response).cast("double")
    data = rows.where(F.expr(" and ".join(f"`{c}` is not null" for c in [response, cluster, *terms])))
    k = len(x)
    sums = data.agg(F.count(F.lit(1)), F.count_distinct(cluster), *[F.sum(x[i] * x[j]) for i in range(k) for j in range(k)], *[F.sum(v * y) for v in x]).first()
    n, groups = sums[0], sums[1]
    xx, xy = np.array(sums[2 : 2 + k * k], float).reshape(k, k), np.array(sums[2 + k * k :], float)
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    fit = sum((F.lit(float(b)) * v for b, v in zip(beta, x)), F.lit(0.0))
    scores = data.groupBy(cluster).agg(*[F.sum(v * (y - fit)).alias(f"s{i}") for i, v in enumerate(x)])
    meat = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k)]).first()
    scale = groups / (groups - 1) * (n - 1) / (n - k) if groups > 1 and n > k else float("nan")
    se = np.sqrt(np.maximum(np.diag(inverse @ np.array(meat, float).reshape(k, k) @ inverse), 0) * scale)
    out = [(t, float(b), float(s), float(b / s) if s > 0 else None) for t, b, s in zip(names, beta, se)]
    return rows.sparkSession.createDataFrame(out, "term string, estimate double, se double, t double")


def marginal_evidence(scores: DataFrame, keys: list[str], value: str, prior: str | None = None) -> DataFrame:
    """Evidence marginalised over the settings of each group: log sum of evidence times prior, an even one by default."""
    log_prior = F.log(F.col(prior)) if prior else F.lit(0.0)
    g = scores.where(F.col(value).isNotNull()).groupBy(*keys).agg(log_sum_exp(F.collect_list(F.col(value) + log_prior)).alias("v"), F.count(F.lit(1)).alias("settings"))
    return g.withColumn("marginal_log_evidence", F.col("v") if prior else F.col("v") - F.log("settings")).drop("v")
