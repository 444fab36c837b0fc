"""Priors fitted to best settings, held against direct maximisation and numpy."""

import numpy as np
import pytest

from driftfield.operators import priors, regression

EVENT = ["session", "event_index", "model"]


def likeliest_inverse_gamma(x):
    """Shape and scale by a fine search of the profile likelihood."""
    a = np.exp(np.linspace(-4, 8, 400_001))
    b = a / np.mean(1 / x)
    from math import lgamma

    value = a * np.log(b) - np.vectorize(lgamma)(a) - (a + 1) * np.mean(np.log(x)) - b * np.mean(1 / x)
    return a[value.argmax()], b[value.argmax()]


def test_one_setting(spark):
    rng, grid = np.random.default_rng(0), np.array([0.5, 1.0, 2.0, 3.0, 5.0, 8.0])
    rows, best = [], {}
    for s, events in (("a", 40), ("b", 3), ("few", 2)):
        for e in range(events):
            value = rng.normal(size=6)
            value[rng.integers(1, 5)] += 5
            rows += [(s, e, "m", float(g), float(v)) for g, v in zip(grid, value)] + [(s, e, "m", 2.0, None)] * (e == 0)
            best.setdefault(s, []).append(grid[value.argmax()])
    rows += [("alike", e, "m", float(g), float(g == 2.0)) for e in range(5) for g in grid]
    rows += [("edge", e, "m", float(g), float(g == 8.0)) for e in range(5) for g in grid]
    df = spark.createDataFrame(rows, "session string, event_index long, model string, scale double, v double").repartition(4)
    got = {(r.session, r.scale): r.prior for r in priors.fitted_priors(df, EVENT, ["session", "model"], ["scale"], "v").collect()}
    for s in ("few", "alike", "edge"):
        assert [got[s, g] for g in grid] == pytest.approx([1 / 6] * 6)
    for s in ("a", "b"):
        x = np.array([v for v in best[s] if v not in (0.5, 8.0)])
        a, b = likeliest_inverse_gamma(x)
        w = np.exp(-(a + 1) * np.log(grid) - b / grid)
        assert [got[s, g] for g in grid] == pytest.approx((w / w.sum()).tolist(), rel=2e-3, abs=1e-9)


def test_two_settings_and_evidence_under_them(spark):
    rng, sd, decay = np.random.default_rng(1), np.array([1.0, 2.0, 4.0, 8.0, 16.0]), np.array([0.1, 0.3, 0.5, 0.9])
    rows, best, values = [], [], {}
    for e in range(30):
        v = rng.normal(size=(5, 4))
        v[rng.integers(1, 4), rng.integers(1, 3)] += 4
        values[e] = v
        best.append(np.unravel_index(v.argmax(), v.shape))
        rows += [("a", e, "m", float(x), float(d), float(v[i, j])) for i, x in enumerate(sd) for j, d in enumerate(decay)]
    df = spark.createDataFrame(rows, "session string, event_index long, model string, scale double, decay double, v double").repartition(4)
    fitted = priors.fitted_priors(df, EVENT, ["session", "model"], ["scale", "decay"], "v")
    got = {(r.scale, r.decay): r.prior for r in fitted.collect()}
    inside = [(sd[i], decay[j]) for i, j in best if 0 < i < 4 and 0 < j < 3]
    data = np.log(np.array(inside)).T
    inv, mean = np.linalg.inv(np.cov(data) + np.eye(2) * 1e-9), data.mean(1)
    w = np.array([[np.exp(-0.5 * (np.log([x, d]) - mean) @ inv @ (np.log([x, d]) - mean)) for d in decay] for x in sd])
    w /= w.sum()
    assert np.array([[got[x, d] for d in decay] for x in sd]) == pytest.approx(w)
    m = regression.marginal_evidence(df.join(fitted, ["session", "model", "scale", "decay"]), EVENT, "v", "prior")
    found = {r.event_index: r.marginal_log_evidence for r in m.collect()}
    assert all(found[e] == pytest.approx(float(np.log((np.exp(v) * w).sum()))) for e, v in values.items())


def test_empty_scores_and_too_many_settings(spark):
    df = spark.createDataFrame([], "session string, event_index long, model string, scale double, decay double, v double")
    assert priors.fitted_priors(df, EVENT, ["session"], ["scale"], "v").collect() == []
    with pytest.raises(ValueError):
        priors.fitted_priors(df, EVENT, ["session"], ["scale", "decay", "v"], "v")
