"""Reports that SQL cannot say, against brute force."""

import numpy as np
import pytest

from driftfield.operators import reports


def test_null_laws_match_shuffles(spark):
    rng = np.random.default_rng(0)
    n = 60
    label, state, margin = rng.random(n) < 0.4, rng.random(n) < 0.5, rng.random(n)
    df = spark.createDataFrame([(bool(a), bool(b), float(m)) for a, b, m in zip(label, state, margin)], "label boolean, state boolean, margin double")
    got = {r["null"]: r for r in reports.null_calibration(df, "label", "state", "margin", 0.3).collect()}
    fixed, seen = margin >= 0.3, int((label & state & (margin >= 0.3)).sum())
    draws = {"label_shuffle": [], "state_shuffle": [], "joint_shuffle": []}
    for _ in range(20000):
        a, b = rng.permutation(label), rng.permutation(state)
        draws["label_shuffle"].append((a & state & fixed).sum())
        draws["state_shuffle"].append((label & b & fixed).sum())
        draws["joint_shuffle"].append((a & b & fixed).sum())
    for k, d in draws.items():
        d = np.array(d)
        r = got[k]
        assert (r.windows, r.passing) == (n, seen)
        assert r.mean_null == pytest.approx(d.mean(), abs=0.05) and r.p_value == pytest.approx((d >= seen).mean(), abs=0.02)
        assert abs(r.p95_null - np.quantile(d, 0.95)) <= 1 and abs(r.p99_null - np.quantile(d, 0.99)) <= 1
        assert r.false_discovery_rate == pytest.approx(r.mean_null / seen)
    assert reports.null_calibration(df.where("false"), "label", "state", "margin", 0.3).where("p_value = 1 and false_discovery_rate is null").count() == 3


def test_hypergeometric_of_large_counts_sums_to_one():
    low, p = reports.hypergeometric(10**9, 3 * 10**8, 2 * 10**8)
    at = low + np.arange(len(p))
    assert p.sum() == pytest.approx(1) and (p * at).sum() == pytest.approx(6e7, rel=1e-9) and len(p) < 10**7


def test_random_effects_match_sampling(spark):
    rng = np.random.default_rng(3)
    kind = rng.choice(3, 150, p=[0.6, 0.3, 0.1])
    log = rng.normal(size=(150, 3)) + 3.0 * np.eye(3)[kind]
    rows = [("s", i, f"m{k}", None, float(log[i, k]), i * 3 + k) for i in range(150) for k in range(3)] + [("s", 999, "m0", None, 1.0, 9999)]
    df = spark.createDataFrame(rows, "session string, event_index long, model string, status string, log_evidence double, row_key long")
    got = {r.model: r for r in reports.random_effects(df, ["m0", "m1", "m2"]).collect()}
    alpha, kept = np.full(3, 10.0), []
    for step in range(3000):
        r = rng.dirichlet(alpha)
        w = np.exp(log - log.max(1, keepdims=True)) * r
        z = (w / w.sum(1, keepdims=True)).cumsum(1)
        alpha = 10.0 + np.bincount((rng.random((150, 1)) > z).sum(1).clip(0, 2), minlength=3)
        if step >= 100:
            kept.append(r)
    kept = np.array(kept)
    for k in range(3):
        assert got[f"m{k}"].p_model == pytest.approx(kept[:, k].mean(), abs=0.03)
    assert got["m0"].p_exceedance > 0.95 and sum(r.p_exceedance for r in got.values()) == pytest.approx(1)


def test_digamma():
    x = np.array([0.5, 1.0, 2.0, 10.0])
    assert np.allclose(reports.digamma(x), [-1.9635100260214235, -0.5772156649015329, 0.42278433509846713, 2.251752589066721], atol=1e-9)


def test_gates_warn_and_thresholds_fall_back(spark):
    from driftfield.operators import gates, resampling

    df = spark.createDataFrame([("success", True, 3, 5.0), ("success", False, 1, 4.0), ("failed", False, 3, None)], "status string, evidence_comparable boolean, n_time int, test_spikes double")
    got = {r.gate: r.result for r in gates.quality_gates(df, {"success_fraction": ("min", 0.9, 0.6), "comparable_fraction": ("min", 0.9, 0.5), "short_fraction": ("max", 0.5), "mean_spikes": ("min", 4.0)}).collect()}
    assert got == {"success_fraction": "warn", "comparable_fraction": "fail", "short_fraction": "pass", "mean_spikes": "pass"}
    pairs = spark.createDataFrame([(5.0, True), (1.0, True), (3.0, False), (0.5, False)], "margin double, is_true boolean")
    fits = resampling.chosen_threshold(resampling.margin_threshold(pairs, [0.0, 2.0, 4.0], 0.5, 0.5)).first()
    assert (fits.threshold, fits.reason) == (2.0, "meets_limits")
    none = resampling.chosen_threshold(resampling.margin_threshold(pairs, [0.0, 2.0], 0.1, 0.9)).first()
    assert (none.threshold, none.false_positive_rate, none.reason) == (2.0, 0.5, "no_threshold_meets_limits")


def test_calibration(spark):
    from driftfield.operators import gates

    rows = [("s", 0.5, 0.1), ("s", 0.25, 0.6), ("s", 0.0, 1.0), ("s", 1.0, 0.9)]
    r = gates.calibration(spark.createDataFrame(rows, "session string, true_probability double, rank_fraction double")).first()
    assert r.windows == 4 and r.mean_rank_fraction == pytest.approx(0.65) and (r.coverage_50, r.coverage_80, r.coverage_95) == (0.25, 0.5, 0.75)
    assert r.mean_nll == pytest.approx(-np.log([0.5, 0.25, 1e-300, 1.0]).mean())
