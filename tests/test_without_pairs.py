"""Paths, ends, visits and intervals between spikes are those of pairs of sample and event, which are not made."""

import math
import random

import pytest
from pyspark.sql import functions as F

from driftfield.operators import controls, labels, tracks

TRACK = "session string, frame_idx long, t double, x double, y double"
EVENTS = [("a", 1, 0.0, 45.0), ("a", 2, 200.0, 600.0), ("a", 3, 30.0, 30.0), ("b", 1, 10.0, 30.0), ("c", 1, 0.0, 5.0), ("a", 4, 256.0, 257.0), ("a", 5, 255.5, 1024.0), ("a", 6, 20.0, 24.0)]


def _track():
    draw = random.Random(4)
    rows = [("a", i, float(draw.randrange(0, 4400)) / 4, float(draw.randrange(0, 30)), float(draw.randrange(0, 10))) for i in range(2500)]
    return rows + [("a", 3000 + i, 21.0, 5.0, 5.0) for i in range(4)] + [("b", i, 10.0 + i % 3, 1.0, 2.0) for i in range(7)]


def _events(spark):
    return spark.createDataFrame(EVENTS, "session string, event_index long, start double, end double").withColumn("peak", F.col("start"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_are_those_of_pairs(spark):
    rows = sorted(_track(), key=lambda r: (r[0], r[2], r[1]))
    df = tracks.track_metrics(spark.createDataFrame(rows, TRACK), _events(spark))
    got = {(r.session, r.event_index): r for r in df.collect()}
    want = {}
    for s, i, a, b in EVENTS:
        path = [r[3:] for r in rows if r[0] == s and a <= r[2] < b]
        if path:
            want[s, i] = path
    assert set(got) == set(want) and len(got) == 6
    for k, path in want.items():
        steps = [math.dist(p, q) for p, q in zip(path, path[1:])]
        r, net = got[k], math.dist(path[0], path[-1])
        assert r.points == len(path) and math.isclose(r.net_displacement, net)
        if steps:
            assert math.isclose(r.path_length, sum(steps), abs_tol=1e-9) and math.isclose(r.mean_step, sum(steps) / len(steps), abs_tol=1e-9)
            assert (r.linearity is None) == (sum(steps) == 0)
        else:
            assert r.path_length is None and r.linearity is None
    assert got["b", 1].path_length == 0.0 and got["b", 1].linearity is None
    assert "(t#" not in "".join(x for x in _plan(df).splitlines() if "Join" in x)  # no join compares times with bounds


def test_ends_are_those_of_pairs(spark):
    rows = _track()
    got = {(r.session, r.event_index): (r.x, r.y) for r in tracks.last_inside(spark.createDataFrame(rows, TRACK), _events(spark)).collect()}
    want = {}
    for s, i, a, b in EVENTS:
        inside = [r[2:] for r in rows if r[0] == s and a <= r[2] < b]
        if inside:
            want[s, i] = max(inside)[1:]
    assert got == want


@pytest.mark.parametrize("longest", [40.0, 600.0])
def test_first_visits_are_those_of_pairs(spark, longest):
    rows, wells = _track(), [("a", 1, 3.0, 3.0), ("a", 2, 20.0, 5.0), ("a", 7, 28.0, 9.0), ("c", 1, 0.0, 0.0)]
    radii, dwells, horizons = (3.0, 9.0), (0.0, 0.5, 1.0), (7.0, longest)
    draw = random.Random(5)
    events = [("a", i, draw.randrange(0, 4600) / 4) for i in range(150)] + [("b", 1, 10.0), ("c", 2, 3.0), ("a", 200, None)]
    e, p, w = spark.createDataFrame(events, "session string, event_index long, peak double"), spark.createDataFrame(rows, TRACK), spark.createDataFrame(wells, "session string, well_id int, wx double, wy double")
    df = labels.sensitivity(e, p, w, radii, dwells, horizons)
    got = {(r.session, r.event_index, r.radius, r.min_dwell, r.horizon): r for r in df.collect()}
    assert len(got) == len(events) * 12
    line = sorted((r[2], r[3], r[4], r[0]) for r in rows)
    for s, i, at in events:
        for radius in radii:
            for h in horizons:
                runs = []
                for ws, well, wx, wy in wells:
                    run = None
                    for t, x, y, rs in line:
                        if at is None or rs != s or ws != s or not at <= t <= at + h:
                            continue
                        if math.sqrt((x - wx) ** 2 + (y - wy) ** 2) <= radius:
                            run = (run[0], t) if run else (t, t)
                        elif run:
                            runs.append((run[0], well, run[1] - run[0]))
                            run = None
                    if run:
                        runs.append((run[0], well, run[1] - run[0]))
                for dwell in dwells:
                    first = min((r for r in runs if r[2] >= dwell), default=None)
                    r = got[s, i, radius, dwell, h]
                    assert (r.arrival_time, r.true_well_id, r.dwell_s) == (first or (None, None, None)) and r.valid_label == (first is not None)
                    assert r.exclude_reason == ("" if first else "no_well_locations" if s == "b" else "no_visit_within_horizon")
    assert ">=" not in "".join(x for x in _plan(df).splitlines() if "Join" in x)


def test_intervals_are_those_of_pairs(spark):
    rows = [(r[0], r[2]) for r in _track()] + [("a", 45.0), ("a", 200.0), ("a", None)]
    df = controls.spike_intervals(spark.createDataFrame(rows, "session string, t double"), _events(spark))
    got = sorted((r.session, r.event_index, r.t_idx, r.t, r._last, r.bin_dur) for r in df.collect())
    want = []
    for s, i, a, b in EVENTS:
        times = sorted({t for q, t in rows if q == s and t is not None and a <= t < b})
        for k, t in enumerate([*times, b]):
            want.append((s, i, k, t, k == len(times), max(t - (times[k - 1] if k else a), 1e-6)))
    assert got == sorted(want)
    assert "Window" not in _plan(df).split("Generate", 1)[0]  # no window over the rows of pairs
