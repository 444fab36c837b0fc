"""Bootstraps whose draws and replicates must not be broadcast or copied row by row."""

import hashlib
import statistics

import numpy as np
import pytest

from driftfield.operators import reports


def test_draws_of_the_nested_bootstrap_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(reports, "DRAWS", 3)
    rows = spark.createDataFrame([("m", s, i, float(i * (1 + (s == "b")))) for s in "ab" for i in range(10)], "model string, session string, o long, v double")
    got = reports.nested_bootstrap(rows, "model", "session", "o", "v", 20)
    plan = got._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "strategy=shuffle_hash" in plan
    u = lambda *x: int(hashlib.md5("|".join(map(str, ("nested", *x))).encode()).hexdigest()[:12], 16) / 16**12
    means = []
    for r in range(20):
        drawn = []
        for slot in range(2):
            scale = 1 + (int(u(r, "m", slot) * 2) == 1)
            drawn += [scale * int(u(r, "m", slot, k) * 10) for k in range(10)]
        means.append(sum(drawn) / len(drawn))
    row = got.collect()[0]
    assert (row.ci_low, row.ci_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_medians_of_replicates_come_from_ranges(spark, monkeypatch):
    monkeypatch.setattr(reports, "RANGES", 4)
    rng = np.random.default_rng(0)
    rows = [("s", f"R{k}", float(np.round(v, 1))) for k in range(3) for v in rng.normal(k - 1, 1, 11 + k)] + [("one", "R1", 2.0)] * 3
    got = {r.statistic: r for r in reports.rat_bootstrap(spark.createDataFrame(rows, "statistic string, rat string, delta double"), 50).collect()}
    medians, shares = [], []
    for r in range(50):
        picks = [int(int(hashlib.md5(f"rats|{r}|{i}".encode()).hexdigest()[:12], 16) / 16**12 * 3) for i in range(3)]
        x = [d for p in picks for s, rat, d in rows if s == "s" and rat == f"R{p}"]
        medians.append(statistics.median(x))
        shares.append(np.mean(np.array(x) > 0))
    s = got["s"]
    assert (s.median_low, s.median_high) == pytest.approx(tuple(np.quantile(medians, [0.025, 0.975]))) and (s.share_low, s.share_high) == pytest.approx(tuple(np.quantile(shares, [0.025, 0.975])))
    assert (got["one"].median_low, got["one"].mean_high) == (2.0, 2.0)
