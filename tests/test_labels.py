"""Labels, wells and matched windows on small made tracks."""

import numpy as np
import pytest

from driftfield.operators import decoding, labels
from driftfield.operators.tracks import Grid

WELL = "session string, well_id int, wx double, wy double"


def test_visits_need_radius_dwell_and_horizon(spark):
    x = [50.0, 9.0, 50.0, 50.0, 9.0, 8.0, 9.0, 50.0, 91.0, 92.0, 93.0, 50.0]
    p = spark.createDataFrame([("s", i, 0.25 * i, v, 0.0) for i, v in enumerate(x)], "session string, frame_idx long, t double, x double, y double")
    w = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 100.0, 0.0)], WELL)
    e = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 1.1), ("s", 3, 50.0), ("none", 4, 0.0)], "session string, event_index long, peak double")
    got = {r.event_index: r for r in labels.visit_labels(e, p, w, 10.0, 0.5, 30.0).collect()}
    assert (got[1].true_well_id, got[1].time_to_arrival_s, got[1].dwell_s) == (1, 1.0, 0.5)  # the first touch is too short
    assert got[2].true_well_id == 2 and got[3].exclude_reason == "no_visit_within_horizon" and got[4].exclude_reason == "no_well_locations"
    grid = {(r.event_index, r.radius, r.min_dwell, r.horizon): r.true_well_id for r in labels.sensitivity(e, p, w, (7.5, 10.0), (0.0, 0.5), (1.25, 30.0)).collect()}
    assert len(grid) == 32 and grid[1, 10.0, 0.0, 1.25] == 1 and grid[1, 10.0, 0.5, 1.25] is None
    assert grid[1, 7.5, 0.0, 30.0] == 2 and grid[1, 7.5, 0.5, 30.0] is None


def test_places_and_masses_of_wells(spark):
    grid = Grid(0.0, 0.0, 10.0, 4, 1)
    w = spark.createDataFrame([("s", 1, 6.0, 5.0), ("s", 2, 14.0, 5.0), ("s", 3, 38.9, 40.0)], WELL)
    own = {}
    for r in labels.well_places(w, grid, 11.0).collect():
        own.setdefault(r.well_id, set()).add(r.bin_id)
    assert own == {1: {0}, 2: {1, 2}, 3: {3}}
    post = spark.createDataFrame([("s", 9, "m", [0.1, 0.5, 0.2, 0.2])], "session string, event_index long, model string, terminal array<double>")
    got = {r.well_id: (r.mass, r["rank"]) for r in labels.well_masses(post, w, grid, 11.0).collect()}
    assert got == {1: (0.1, 3), 2: (0.7, 1), 3: (0.2, 2)}


def test_lists_of_events():
    assert labels.event_ids("all") == (False, None) and labels.event_ids(" Run ") == (True, None)
    assert labels.event_ids("run:1-3, 7") == (True, [(1, 3), (7, 7)]) and labels.event_ids("4") == (False, [(4, 4)])
    for bad in ("", "3-1", "x", "1,,2", "-5"):
        with pytest.raises(ValueError):
            labels.event_ids(bad)


def test_events_by_number(spark):
    e = spark.createDataFrame([("s", 10 + i, 10.0 * i, 10.0 * i + 1, 10.0 * i + 0.5) for i in range(6)], "session string, event_index long, start double, end double, peak double")
    runs = spark.createDataFrame([("s", 15.0, 100.0)], "session string, start double, end double")
    ids = lambda *a: sorted(r.event_index for r in labels.select_events(e, runs, *a).collect())
    assert ids("run:0-1") == [12, 13] and ids("12-13,15") == [12, 13, 15] and ids("all", 2) == [10, 11] and len(ids("all", 4, "seed")) == 4 and ids("run") == [12, 13, 14, 15]


def test_missing_cells_are_an_error(spark):
    r = spark.createDataFrame([("s", 1, 0, 2.0)], "session string, cell_id int, bin_id int, rate_hz double")
    assert labels.select_cells(r, [1]).count() == 1
    with pytest.raises(ValueError, match="2"):
        labels.select_cells(r, [1, 2])


def test_centreline(spark):
    p = spark.createDataFrame([(5.0, 3.0), (12.0, 5.0), (-4.0, -3.0), (30.0, 10.0)], "x double, y double")
    got = [(r.along, r.off_line) for r in labels.centreline(p, [(0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (10.0, 10.0)]).collect()]
    assert np.allclose(got, [(5.0, 3.0), (15.0, 2.0), (0.0, 5.0), (20.0, 20.0)])


def test_matched_windows_and_their_p_values(spark):
    s = spark.createDataFrame([("s", i, float(i), i % 3) for i in range(100)], "session string, spike_row long, t double, cell_id int")
    e = spark.createDataFrame([("s", 1, 50.0, 54.0), ("s", 2, 90.0, 91.0)], "session string, event_index long, start double, end double")
    runs = spark.createDataFrame([("s", 40.0, 60.0), ("s", 55.0, 70.0)], "session string, start double, end double")
    got = decoding.matched_windows(e, s, 3, runs=runs, padding=1.0).collect()
    one = [r for r in got if r.event_index == 1]
    assert len(one) == 3 and all((40 <= r.start and r.end <= 49) or (55 <= r.start and r.end <= 70) for r in one)
    assert all(r.null_spikes == 4 and r.within_tolerance and r.candidates == 3 + 6 for r in one)  # steps of 2 s in [40, 45] and [55, 66]
    real = spark.createDataFrame([("s", 1, 2.0), ("s", 2, 9.0)], "session string, event_index long, v double")
    nulls = spark.createDataFrame([("s", 1, 1.0), ("s", 1, 3.0), ("s", 1, 2.0)], "session string, event_index long, v double")
    p = {r.event_index: r for r in decoding.window_p_values(real, nulls, "v").collect()}
    assert p[1].p_value == 0.75 and p[1].z == 0.0 and p[2].p_value == 1.0 and p[2].windows == 0
