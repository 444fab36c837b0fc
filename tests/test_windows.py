"""Overlapping windows of several tables, summaries of decoding, and what events end in."""

import numpy as np
import pytest

from driftfield.operators import chains, decoding, reports
from driftfield.operators import models as m
from driftfield.operators.tracks import Grid

WINDOW = "session string, event_index long, null_index long, start double, end double"
GRID = Grid(0.0, 0.0, 10.0, 3, 2)


def linked(windows):
    """Groups of places in the list, by all pairs."""
    group = list(range(len(windows)))
    for i, a in enumerate(windows):
        for j, b in enumerate(windows[:i]):
            if a[0] == b[0] and a[3] <= b[4] and b[3] <= a[4] and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_one_window_of_each_overlap(spark):
    rng, tables, value = np.random.default_rng(0), {}, {}
    for name in ("a", "b", "c"):
        rows = []
        for s in ("s1", "s2"):
            for e in range(12):  # the same event numbers in both sessions and all tables
                for k in range(2):
                    start = float(rng.uniform(0, 3000))
                    rows.append((s, e + 100 * (name == "c"), k + 10 * (name == "b"), start, start + float(rng.choice([5, 60, 600], p=[0.6, 0.3, 0.1]))))
                    value[rows[-1][:3]] = None if rng.random() < 0.1 else float(rng.integers(0, 6))
        tables[name] = rows + rows[:1]
    taken = [("s1", 3, 0), ("s1", 4, 11), ("s2", 105, 1), ("other", 1, 0)]
    frames = {n: spark.createDataFrame(rows, WINDOW).repartition(3) for n, rows in tables.items()}
    values = spark.createDataFrame([(*k, v) for k, v in value.items()], "session string, event_index long, null_index long, value double")
    got = reports.one_per_overlap(frames, values, spark.createDataFrame(taken, "session string, event_index long, null_index long")).collect()
    left = [(*r, n) for n, rows in tables.items() for r in rows if r[:3] not in taken]
    group, want = linked(left), {}
    for g in set(group):
        mine = [w for w, h in zip(left, group) if h == g]
        best = sorted((-value[w[:3]], w[:3]) for w in mine if value[w[:3]] is not None)
        if best:
            want[best[0][1]] = (-best[0][0], *[sum(w[5] == n for w in mine) for n in tables], min(w[3] for w in mine), max(w[4] for w in mine))
    assert {(r.session, r.event_index, r.null_index): (r.value, r.a, r.b, r.c, r.group_start, r.group_end) for r in got} == want and len(want) > 10
    ids = {(r.session, r.event_index, r.null_index, r.source, r.start): r.overlap_group for r in reports.overlap_groups(frames).collect()}
    every = [(*r, n) for n, rows in tables.items() for r in rows]
    group = linked(every)
    pairs = {(g, ids[(*w[:3], w[5], w[3])]) for w, g in zip(every, group)}
    assert len(pairs) == len(set(group)) == len(set(ids.values()))


def test_decoding_summary(spark):
    rows = [("s", f, w, b, 0.1 * w, float(w), 2.0 * w, w, w % 3) for w, (f, b) in enumerate([(0, 1), (0, 2), (1, 3), (1, -1), (2, 0)])]
    df = spark.createDataFrame(rows, "session string, fold int, window_index int, true_bin int, true_probability double, mean_error double, map_error double, true_rank int, n_spikes int")
    r = decoding.decoding_summary(df).first()
    assert (r.windows, r.folds, r.median_mean_error, r.median_map_error, r.median_true_rank) == (4, 3, 1.5, 3.0, 1.5)
    assert r.mean_true_probability == pytest.approx(0.175) and r.mean_spikes == pytest.approx(1.0)
    assert decoding.decoding_summary(df, ("session", "fold")).count() == 3


def events(spark, n=5):
    rng = np.random.default_rng(1)
    lls = [rng.normal(size=(k % 4 + 1, 6)) * 2 for k in range(n)]
    lls[3][1] = -np.inf
    rows = [("s", e, t, 1.0, 1, [float(v) for v in ll[t]]) for e, ll in enumerate(lls) for t in range(len(ll))]
    return lls, spark.createDataFrame(rows, "session string, event_index long, t_idx int, bin_dur double, n_spikes long, ll array<double>").repartition(3)


def test_goals_and_modes_that_events_end_in(spark):
    lls, df = events(spark)
    centres, goals = m.centres_of(GRID), [(5.0, 5.0), (25.0, 15.0), (15.0, 5.0)]
    motion = m.Motion(diffusion=6.0, stationary=4.0)
    got = {(r.event_index, r.goal): r for r in m.goal_probabilities(df, GRID, goals, motion, 1.0).collect()}
    modes = {(r.event_index, r.mode): r.probability for r in chains.mode_probabilities(df, GRID, motion, 1.0).collect()}
    still, moves = (m.gaussian(centres, centres, v, motion.truncate) for v in (4.0, 6.0))
    for e, ll in enumerate(lls):
        logs = np.array([m.goal(m.Event(ll, centres, np.ones(len(ll) - 1), 1.0, motion, goals=np.array([g])))[0] for g in goals])
        p = np.exp(logs - m.lse(logs)) if np.isfinite(logs).any() else np.full(3, 1 / 3)
        assert [got[e, g].probability for g in range(3)] == pytest.approx(p.tolist())
        law = np.full((3, 6), 1 / 18) * np.exp(ll[0])
        for t in range(1, len(ll)):
            q = m.switching(3, 1.0, motion) @ law
            law = np.stack((still @ q[0], moves @ q[1], np.full(6, q[2].sum() / 6))) * np.exp(ll[t])
        want = law.sum(1) / law.sum() if law.sum() > 0 else np.full(3, 1 / 3)
        assert [modes[e, k] for k in chains.MODES] == pytest.approx(want.tolist())
    with pytest.raises(ValueError):
        m.goal_probabilities(df, GRID, [])
