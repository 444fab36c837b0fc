"""Whole batches of events are scored as one event at a time is."""

import numpy as np
import pytest

from driftfield.operators import batches, models as m, separable as sp
from driftfield.operators.tracks import Grid
from test_places import CENTRES, GRID, frame, made_events


@pytest.mark.parametrize("motion", [m.Motion(), m.Motion(diffusion=4.0, stationary=3.0, truncate=1.5, switch_tau=2.0)])
def test_batches_equal_the_kernels(spark, motion):
    events = made_events(1, 10)
    got = {(r.session, r.event_index, r.model): r for r in batches.score_batched(frame(spark, events), GRID, list(batches.BATCHED), motion, 1.0, extra=("terminal", "made")).collect()}
    assert len(got) == 40
    for s, i, ll, dur in events:
        case = m.Event(ll, CENTRES, (dur[1:] + dur[:-1]) / 2, 1.0, motion)
        for name in batches.BATCHED:
            r, (log, post) = got[s, i, name], m.REGISTRY[name][0](case)
            assert r.log_evidence == pytest.approx(log) and r.n_time == len(ll) and sum(r.terminal) == pytest.approx(1)
            if np.isfinite(log):
                assert r.terminal == pytest.approx(post[-1].tolist())
            assert list(r.made) == pytest.approx([m.REGISTRY[name][0](m.Event(ll[: k + 1], CENTRES, case.steps[:k], 1.0, motion))[0] for k in range(len(ll))])


def test_cuts_equal_the_segments_of_one_event():
    rng, g = np.random.default_rng(3), m.Grammar()
    for n in (1, 2, 5, 7):
        score = np.round(rng.normal(size=(40, n, n + 1, 3)), 1)  # rounded, so that there are ties
        score[rng.random(score.shape) < 0.2] = -np.inf
        for a in range(n):
            score[:, a, : a + 1] = -np.inf
        total, (event, index, start, end, mode) = batches.best_cuts(score, g)
        for e in range(len(score)):
            want, cuts = m.best_segments(score[e], g)
            assert total[e] == pytest.approx(want)
            assert [(a, z, k) for x, a, z, k in zip(event, start, end, mode) if x == e] == cuts


def test_segments_of_batches_equal_those_of_kernels(spark):
    df, rows = frame(spark, made_events(1, 10)), []
    for f in (m.segment_grammar, batches.segment_grammar):
        rows.append(sorted((r.session, r.event_index, r.segment_index, r.mode, r.start_bin, r.end_bin, round(r.duration_s, 6), round(r.grammar_score, 6)) for r in f(df, GRID, m.Grammar(), m.Motion(), 1.0).collect()))
    assert rows[0] == rows[1] and rows[0]


def test_emissions_of_events_equal_poisson_sums(spark):
    grid = Grid(0.0, 0.0, 1.0, 2, 1)
    spikes = spark.createDataFrame([("a", i * 0.1, i % 3) for i in range(3000)], "session string, t double, cell_id int")
    events = spark.createDataFrame([("a", 1, 0.0, 45.0), ("a", 2, 250.0, 260.0), ("a", 3, 900.0, 905.0), ("b", 1, 0.0, 9.0)], "session string, event_index long, start double, end double")
    rates = spark.createDataFrame([("a", c, b, 1.0 + c + b) for c in range(2) for b in range(2)] + [("a", 5, 0, 2.0)], "session string, cell_id int, bin_id int, rate_hz double")
    got = m.event_emissions(spikes, events, rates, 20.0)
    rows = {(r.session, r.event_index): r.bins for r in got.collect()}
    assert sorted(rows) == [("a", 1), ("a", 2), ("a", 3)] and [len(rows["a", i]) for i in (1, 2, 3)] == [3, 1, 1]
    t = np.arange(3000) * 0.1
    for (s, i), (start, end) in {("a", 1): (0.0, 45.0), ("a", 2): (250.0, 260.0), ("a", 3): (900.0, 905.0)}.items():
        for b in rows[s, i]:
            low = start + 20.0 * b.t_idx
            high = min(low + 20.0, end)
            n = [int(((t >= low) & (t < high) & (np.arange(3000) % 3 == c)).sum()) for c in range(2)]
            want = [sum(k * np.log((1.0 + c + p) * (high - low)) - np.log(np.arange(1, k + 1)).sum() for c, k in enumerate(n)) - (3.0 + 2 * p + 2.0 * (p == 0)) * (high - low) for p in range(2)]
            assert b.ll == pytest.approx(want) and b.n_spikes == sum(n)


def test_separable_settings_of_batches_equal_those_of_events(spark):
    settings = sp.Settings(still=(5.0, 20.0), diffusion=(4.0, 15.0), momentum=(2.0,), decay=(0.05, 0.5), initial=3.0)
    rng = np.random.default_rng(5)
    events = made_events(1, 10) + [("whole", i, rng.normal(size=(n, 12)) * 3, np.r_[np.ones(n - 1), 0.2 + i % 3 / 4]) for i, n in enumerate([1, 2, 2, 3, 5, 5, 5, 8] * 3)]
    lost = rng.normal(size=(3, 12))
    lost[1] = -np.inf  # no place is possible in one bin: no path has a probability
    got = {}
    for r in sp.score_settings(frame(spark, [*events, ("lost", 1, lost, np.ones(3))]), GRID, settings, 1.0).collect():
        got.setdefault((r.session, r.event_index), []).append((r.model, r.scale, r.decay, r.log_evidence))
    assert len(got) == len(events) + 1 and [r[3] for r in got["lost", 1]] == [-np.inf] * 8
    finite = 0
    for s, i, ll, dur in events:
        with np.errstate(all="ignore"):
            want = sp.suite(m.Event(ll, CENTRES, (dur[1:] + dur[:-1]) / 2, 1.0, None), settings)
        mine = {r[:3]: r[3] for r in got[s, i]}
        assert len(mine) == len(want) == 8
        for *key, value in want:
            finite += np.isfinite(value)
            assert mine[tuple(key)] == (pytest.approx(value, rel=1e-9) if np.isfinite(value) else -np.inf)
    assert finite > 200
