"""Counts and sums of points in the time bins of events, without a row for a pair of point and event."""

import math

from pyspark.sql import functions as F

from driftfield.operators import tracks

EVENTS = [("a", 1, 0.0, 45.0), ("a", 2, 250.0, 600.0), ("a", 3, 30.0, 30.0), ("b", 1, 10.0, 30.0), ("c", 1, 0.0, 5.0)]
SPIKES = [(s, i, i * 0.7, (i * i) % 3 or None) for s in "ab" for i in range(900)] + [("a", 900, None, 1), ("a", 901, float("nan"), 1), ("a", 902, 45.0, 2), ("a", 903, 20.0, 2)]


def _tables(spark):
    return spark.createDataFrame(SPIKES, "session string, spike_row long, t double, cell_id int"), spark.createDataFrame(EVENTS, "session string, event_index long, start double, end double")


def test_counts_are_those_of_pairs_and_no_pairs_are_made(spark):
    spikes, events = _tables(spark)
    counts = tracks.spike_counts(spikes, events, 20.0)
    want: dict = {}
    for s, _, t, cell in SPIKES:
        for session, index, a, b in EVENTS:
            if session == s and t is not None and a <= t < b:
                key = (s, index, math.floor((t - a) / 20.0), cell)
                want[key] = want.get(key, 0) + 1
    assert {(r.session, r.event_index, r.t_idx, r.cell_id): r.n for r in counts.collect()} == want
    assert "Join" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_sums_of_values_leave_out_nulls(spark):
    spikes, events = _tables(spark)
    marked = spikes.withColumn("f", F.when(F.col("spike_row") % 7 != 0, F.col("t") * 2))
    rows = tracks.sums_in_bins(marked, events, None, None, ("f",)).select("session", "event_index", F.inline("sums")).groupBy("session", "event_index").agg(*[F.sum(c).alias(c) for c in ("n", "known", "s_f", "q_f")]).collect()
    for r in rows:
        a, b = next((x[2], x[3]) for x in EVENTS if x[:2] == (r.session, r.event_index))
        inside = [(i, t) for s, i, t, _ in SPIKES if s == r.session and t is not None and a <= t < b]
        held = [2 * t for i, t in inside if i % 7]
        assert (r.n, r.known) == (len(inside), len(held))
        assert math.isclose(r.s_f, sum(held)) and math.isclose(r.q_f, sum(x * x for x in held))
    assert len(rows) == 3


def test_events_may_be_named_by_structs_without_nulls(spark):
    spikes, events = _tables(spark)
    named = events.select("session", F.struct("event_index", F.lit(3).alias("draw")).alias("event_index"), "start", "end")
    n = tracks.spikes_of(spikes, named).groupBy("session", "event_index").agg(F.sum("n").alias("n")).select("session", "event_index.*", "n")
    got = {(r.session, r.event_index): r.n for r in n.where("draw = 3").collect()}
    assert got == {(s, i): sum(x == s and t is not None and a <= t < b for x, _, t, _ in SPIKES) for s, i, a, b in EVENTS if s != "c" and b > a}
