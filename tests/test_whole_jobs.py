"""Operators do the whole job: what was drawn, capped or left out before is there."""

import itertools
import re

import numpy as np
import pytest

from driftfield.operators import decoding, models, resampling, tracks
from driftfield.operators.tracks import Grid
from driftfield.sources import relations

SPIKE = "session string, spike_row long, t double, cell_id int"
EVENT = "session string, event_index long, start double, end double"


def test_null_windows_are_searched_in_all_free_time(spark):
    # free time is [0, 100), less than half a percent of the span: few of 32 draws would meet it
    spikes = [(float(t), t % 3) for t in range(0, 100)] + [(30000.0, 0)] + [(200.0 + k, k % 2) for k in range(7)]
    s = spark.createDataFrame([("s", i, t, c) for i, (t, c) in enumerate(spikes)] + [("full", 0, 0.0, 0), ("full", 1, 10.0, 0)], SPIKE)
    e = spark.createDataFrame([("s", 1, 200.0, 210.0), ("s", 2, 100.0, 30000.0), ("full", 3, 0.0, 10.0), ("full", 4, 5.0, 5.0)], EVENT)
    got = {(r.session, r.event_index, r.match): r for r in decoding.searched_null_windows(e, s, 3).collect()}
    assert len(got) == 6
    assert [got["s", 1, k].null_spikes for k in (1, 2, 3)] == [10, 10, 10] and got["s", 1, 1].candidates == 19
    assert all(0 <= got["s", 1, k].start <= 90 and got["s", 1, k].reason is None for k in (1, 2, 3))
    assert got["s", 2, None].reason == got["full", 3, None].reason == "no free window" and got["full", 4, None].reason == "no duration"


def test_null_windows_match_counts_then_cells(spark):
    # the event has 2 spikes of 2 cells; starts of steps of 2 s: 8 and 10 have 2 spikes of one cell, 18 and 20 of two
    spikes = [(0.0, 9), (10.0, 1), (11.0, 1), (20.0, 1), (21.0, 2), (51.0, 1), (52.0, 2), (60.0, 9)]
    s = spark.createDataFrame([("s", i, t, c) for i, (t, c) in enumerate(spikes)], SPIKE)
    e = spark.createDataFrame([("s", 1, 50.0, 54.0)], EVENT)
    got = decoding.searched_null_windows(e, s, 4).collect()
    assert {(r.match, r.start) for r in got if r.match > 2} <= {(k, a) for k in (3, 4) for a in (8.0, 10.0)} and len(got) == 4
    assert {r.start for r in got if r.match <= 2} == {18.0, 20.0} and all(r.null_spikes == 2 for r in got)


def test_empirical_transitions_follow_the_fitted_matrix(spark):
    grid, ll = Grid(0.0, 0.0, 10.0, 2, 2), np.random.default_rng(1).normal(size=(3, 4))
    rows = [(s, e, t, 1.0, 1, [float(x) for x in ll[t]]) for s in "ab" for e in range(20) for t in range(3)]
    df = spark.createDataFrame(rows, "session string, event_index long, t_idx int, bin_dur double, n_spikes long, ll array<double>")
    moves = [(0, 1, 0.75), (0, 0, 0.25), (1, 2, 1.0), (2, 2, 0.5), (2, 3, 0.5)]
    fitted = spark.createDataFrame([("a", *m) for m in moves], "session string, src int, dst int, probability double")
    p = np.eye(4)
    p[:, :3] = 0
    for src, dst, v in moves:
        p[dst, src] = v
    p = p * (1 - 1e-6) + 1e-6 / 4
    want = np.log(sum(p[c, b] * p[b, a] / 4 * np.exp(ll[0, a] + ll[1, b] + ll[2, c]) for a, b, c in itertools.product(range(4), repeat=3)))
    got = {(r.session, r.event_index, r.model): r for r in models.score_events(df, grid, ["empirical-transition", "state-space-diffusion"], transitions=fitted).collect()}
    assert len(got) == 80
    for e in range(20):
        r = got["a", e, "empirical-transition"]
        assert r.log_evidence == pytest.approx(want) and r.log_evidence != got["a", e, "state-space-diffusion"].log_evidence
        r = got["b", e, "empirical-transition"]
        assert r.log_evidence is None and r.evidence_support == "not_scored"


def test_sign_flips_keep_every_group(spark):
    rows = [("large", u, 1.0 + u % 3) for u in range(25)] + [("even", u, (-1.0) ** u) for u in range(24)] + [("small", u, 1.0) for u in range(4)] + [("small", 9, 0.0), ("zero", 0, 0.0), ("zero", 1, 0.0), ("void", 0, None)]
    df = spark.createDataFrame(rows, "g string, u int, v double")
    got = {r.g: r for r in resampling.sign_flip_exact(df, "g", "u", "v", draws=500).collect()}
    assert len(got) == 5 and got["void"].method == "no_finite_value" and got["void"].p_value is None
    assert (got["small"].units, got["small"].method, got["small"].extreme, got["small"].p_value) == (4, "exact", 2, 2 / 16)
    assert (got["large"].units, got["large"].method, got["large"].patterns, got["large"].p_value) == (25, "monte_carlo", 500, 1 / 501)
    assert got["even"].method == "monte_carlo" and got["even"].p_value == 1.0
    assert (got["zero"].units, got["zero"].method, got["zero"].p_value) == (0, "exact", 1.0)


def test_every_signup_is_an_epoch(spark):
    d = "/root/testdata/sf0.001"
    signups = relations.read(spark, d, "events").where("event_type = 'signup'").count()
    assert relations.every_epoch(spark, d).count() == signups > relations.epochs(spark, d).count()


def test_run_local_kinematics_follow_the_runs(spark):
    # two runs that share a sample at 10; a gap of six steps inside the second; a sample outside any run
    t = [0.0, 1.0, 2.0, 10.0, 11.0, 12.0, 18.5, 19.5, 40.0]
    x = [0.0, 1.0, 3.0, 3.0, 5.0, 8.0, 8.0, 9.0, 50.0]
    p = spark.createDataFrame([("s", i, a, b, 0.0) for i, (a, b) in enumerate(zip(t, x))], "session string, frame_idx long, t double, x double, y double")
    runs = spark.createDataFrame([("s", 0.0, 10.0), ("s", 10.0, 20.0), ("s", 1.5, 2.5)], "session string, start double, end double")
    got = {r.frame_idx: r for r in tracks.run_local(p, runs).collect()}
    assert sorted(got) == list(range(8))
    assert [round(got[i].speed, 6) for i in range(8)] == [1.0, 1.5, 2.0, 2.0, 2.5, 3.0, 1.0, 1.0]
    # the third is alone in the third run, and the last of its piece of the first: the shorter of 1/30 and 1
    assert [round(got[i].dt, 6) for i in range(8)] == [1.0, 1.0, 0.033333, 1.0, 1.0, 1.0, 1.0, 1.0]


def by_each_run(t, x, y, runs):
    """sample -> (speed, step), from the samples of each run one after the other."""
    gap, out = 5 * np.median(np.diff(t)), {}
    for a, b in set(runs):
        mine = np.flatnonzero((t >= a) & (t <= b))
        for piece in np.split(mine, np.flatnonzero(np.diff(t[mine]) > gap) + 1):
            steps = np.diff(t[piece])
            for k, i in enumerate(piece):
                v = 0.0
                if len(piece) > 1:
                    h, g = (t[i] - t[piece[k - 1]] if k else None), (t[piece[k + 1]] - t[i] if k + 1 < len(piece) else None)
                    if h is None:
                        d = [(z[piece[k + 1]] - z[i]) / g for z in (x, y)]
                    elif g is None:
                        d = [(z[i] - z[piece[k - 1]]) / h for z in (x, y)]
                    else:
                        d = [(h * h * z[piece[k + 1]] + (g * g - h * h) * z[i] - g * g * z[piece[k - 1]]) / (h * g * (g + h)) for z in (x, y)]
                    v = float(np.hypot(*d))
                e = out.setdefault(i, ([], [], []))
                e[0].append(v)
                e[1 if k < len(steps) else 2].append(steps[k] if k < len(steps) else np.median(steps) if len(steps) else 1 / 30)
    return {i: (max(v), min(step or middle)) for i, (v, step, middle) in out.items()}


@pytest.mark.parametrize("seed,per_run", [(0, 4.0), (1, 30.0), (2, 400.0), (3, 0.5)])
def test_run_local_kinematics_make_no_row_for_a_sample_and_a_run(spark, seed, per_run):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.exponential(1.5, 400) * np.where(rng.random(400) < 0.03, 20, 1))
    x, y = rng.normal(size=(2, 400))
    start = np.concatenate((rng.uniform(-10, t[-1], 50), rng.choice(t, 20), [300.0, 300.0, 700.0]))
    end = start + np.concatenate((rng.exponential(per_run, 50), np.zeros(10), rng.exponential(per_run, 10), [310.0, 310.0, 690.0]))
    end[60:65] = [t[t >= a][min(3, (t >= a).sum() - 1)] for a in start[60:65]]  # ends at samples
    p = spark.createDataFrame([("s", i, *map(float, r)) for i, r in enumerate(zip(t, x, y))], "session string, frame_idx long, t double, x double, y double")
    runs = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(start, end)], "session string, start double, end double")
    got = tracks.run_local(p, runs, cap=1e9)
    assert not re.search(r"Join .*\bt#\d+ >= ", got._jdf.queryExecution().optimizedPlan().toString())  # samples do not meet runs by their bounds
    found, want = {r.frame_idx: (r.speed, r.dt) for r in got.collect()}, by_each_run(t, x, y, list(zip(start.tolist(), end.tolist())))
    assert sorted(found) == sorted(want) and want
    for i, each in want.items():
        assert found[i] == pytest.approx(each, rel=1e-9), i


def test_long_tracks_have_the_least_median_of_suffixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50):
        steps, first = rng.random(n).round(1), rng.random(n) < 0.3
        assert tracks.least_median(steps.tolist(), first.tolist()) == pytest.approx(min([np.median(steps[k:]) for k in np.flatnonzero(first)], default=np.inf))


def test_training_map_leaves_events_out(spark):
    p = spark.createDataFrame([("s", i, i * 0.5, 2.0 * i, 0.0) for i in range(41)], "session string, frame_idx long, t double, x double, y double")
    spikes = spark.createDataFrame([("s", i, i * 0.25, 1) for i in range(100)], "session string, spike_row long, t double, cell_id int")
    runs = spark.createDataFrame([("s", 0.0, 15.0)], "session string, start double, end double")
    events = spark.createDataFrame([("s", 1, 5.0, 7.0), ("s", 2, 6.0, 8.0)], "session string, event_index long, start double, end double")
    got = tracks.training_rate_map(p, spikes, Grid(0.0, -5.0, 10.0, 9, 1), runs, events, least_speed=1.0, sigma=1e-9).collect()
    n = {r.bin_id: r.rate_hz * r.occupancy_s for r in got}
    assert {r.bin_id: round(r.occupancy_s, 6) for r in got} == {0: 2.5, 1: 2.5, 2: 0.0, 3: 2.0, 4: 2.5, 5: 2.5, 6: 0.5}
    # bin 2 is all event; spikes of [5, 8) are out, the one at 8.0 is in, and none after the run
    assert {b: round(v) for b, v in n.items()} == {0: 10, 1: 10, 2: 0, 3: 8, 4: 10, 5: 10, 6: 1}


def test_as_of_crosses_time_cells_and_gaps(spark):
    s = spark.createDataFrame([("s", 0.0, 0.0, 400.0), ("s", 1000.0, 10.0, 400.0), ("s", 1100.0, 20.0, 400.0)], "session string, t double, x double, gap double")
    q = spark.createDataFrame([("s", i, t) for i, t in enumerate([-5.0, 0.0, 500.0, 1000.0, 1050.0, 5000.0])], "session string, k long, t double")
    assert [r.x for r in tracks.as_of(q, s, ["x"]).orderBy("k").collect()] == [0.0, 0.0, 5.0, 10.0, 15.0, 20.0]
    assert [r.x for r in tracks.as_of(q, s, ["x"], gap="gap").orderBy("k").collect()] == [0.0, 0.0, None, 10.0, 15.0, 20.0]
    assert [r.x for r in tracks.backward(q, s.withColumnRenamed("t", "at"), "x", "at").orderBy("k").collect()] == [None, 0.0, 0.0, 10.0, 10.0, 20.0]
    merged = tracks.merge_intervals(spark.createDataFrame([("s", 0.0, 900.0), ("s", 300.0, 310.0), ("s", 700.0, 701.0), ("s", 900.0, 905.0), ("s", 906.0, 906.0), ("s", 2000.0, 2001.0)], "session string, start double, end double"))
    assert sorted((r.start, r.end) for r in merged.collect()) == [(0.0, 905.0), (2000.0, 2001.0)]


def test_labels_of_routes_are_not_shuffled_by_session(spark):
    from driftfield.operators import graph

    wells = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 10.0, 0.0)], "session string, well_id int, x double, y double")
    points = spark.range(10).selectExpr("'a' as session", "id", "double(id) as x", "1D as y")
    plan = graph.route_labels(points, graph.well_routes(wells, both_ways=False), ["id"])
    assert "strategy=broadcast" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.route, round(r.route_progress, 6)) for r in plan.collect()} == {(i, 0, i / 10) for i in range(10)}
