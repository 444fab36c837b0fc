"""Mark emissions gathered by event, alone and beside those of cells, and their totals."""

import math

import pytest
from pyspark.sql import functions as F

from test_bin_sums import _tables

from driftfield.operators import batches, controls, marks, models
from driftfield.operators.tracks import Grid
from driftfield.plans import model_queries

DATA = "/root/testdata/sf0.001"


def test_both_experts_at_once_equal_their_product(spark):
    spikes, events = _tables(spark)
    marked = spikes.where("spike_row < 900").select("session", "t", (F.col("t") % 5).alias("f"))
    statistics = spark.createDataFrame([(s, b, 3.0, 1.0 + b, 2.0) for s in "ab" for b in (0, 1)], "session string, bin_id int, n double, f_mean double, f_var double")
    cells = spark.createDataFrame([(s, c, b, 0.1 + b + c / 10) for s in "ab" for c in (1, 2) for b in (0, 1)], "session string, cell_id int, bin_id int, rate_hz double")
    total = cells.groupBy("session", "bin_id").agg(F.sum("rate_hz").alias("rate_hz"))
    got = marks.mark_events(marked, events, statistics, total, ["f"], 20.0, 2, spikes=spikes, cell_rates=cells, alpha=0.25)
    alone = marks.clusterless_arrays(marked, events, statistics, total, ["f"], 20.0, 2)
    want = controls.ensemble(models.emissions(spikes, events, cells, Grid(0, 0, 1, 2, 1), 20.0), alone, 0.25)
    key = lambda r: (r.session, r.event_index, r.t_idx)
    seen, held = ({key(r): r for r in x.collect()} for x in (models.binned(got), want))
    assert set(seen) == set(held) and len(seen) > 20
    for k, r in held.items():
        assert seen[k].n_spikes == r.n_spikes and all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(seen[k].ll, r.ll))
    with pytest.raises(Exception, match="2 places beside marks at 3"):
        marks.mark_events(marked, events, statistics, total, ["f"], 20.0, 3, spikes=spikes, cell_rates=cells).collect()


def test_totals_leave_out_places_without_a_likelihood(spark):
    low = float("-inf")
    rows = [("s", 1, [(0, 1.0, 0, [-1.0, low]), (1, 1.0, 2, [-3.0, -0.5])]), ("s", 2, [(0, 1.0, 0, [low, low])])]
    df = spark.createDataFrame(rows, "session string, event_index long, bins array<struct<t_idx: int, bin_dur: double, n_spikes: bigint, ll: array<double>>>")
    assert {(r.event_index, r.cells, r.total, r.best) for r in batches.likelihood_totals(df).collect()} == {(1, 3, -4.5, -0.5), (2, 0, 0.0, None)}


def test_mark_queries_take_no_array_through_expressions_or_joins(spark):
    plan = model_queries._clusterless(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("MapInArrow", 1)[1]
    assert "zip_with" not in plan and "element_at(_f" not in plan
    assert not top.split("Union", 1)[0].count("Join")  # events, sums and laws meet by their order, once
