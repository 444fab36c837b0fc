"""Likelihoods of marks from their sums alone."""

import math

from pyspark.sql import functions as F

from test_bin_sums import EVENTS, SPIKES, _tables


def test_mark_likelihoods_by_sums_equal_those_of_each_mark(spark):
    from driftfield.operators import marks as op

    spikes, events = _tables(spark)
    marked = spikes.where("spike_row < 900").select("session", "t", (F.col("t") % 5).alias("f"), (F.col("t") % 3).alias("g"))
    stats = [("a", 0, 3.0, 1.0, 2.0, 0.5, 1.5), ("a", 2, 4.0, 2.0, 1.0, 1.0, 3.0)]
    statistics = spark.createDataFrame(stats, "session string, bin_id int, n double, f_mean double, f_var double, g_mean double, g_var double")
    rates = spark.createDataFrame([("a", 0, 0.5), ("a", 2, 2.0), ("a", 3, 1.0)], "session string, bin_id int, rate_hz double")
    e = op.clusterless_arrays(marked, events, statistics, rates, ["f", "g"], 20.0, 4)
    seen = {(r.event_index, r.t_idx): r for r in e.where("session = 'a'").collect()}
    ts = [t for s, i, t, _ in SPIKES if s == "a" and i < 900]
    for (index, k), r in seen.items():
        a, b = next(x[2:] for x in EVENTS if x[:2] == ("a", index))
        inside = [t for t in ts if a <= t < b and math.floor((t - a) / 20.0) == k]
        assert r.n_spikes == len(inside) and r.ll[1] == r.ll[3] == -math.inf
        for (_, place, _, fm, fv, gm, gv), rate in zip(stats, (0.5, 2.0)):
            log = sum(math.log(rate) - 0.5 * ((t % 5 - fm) ** 2 / fv + math.log(fv) + (t % 3 - gm) ** 2 / gv + math.log(gv) + 2 * math.log(2 * math.pi)) for t in inside)
            want = log - rate * r.bin_dur + (len(inside) * math.log(r.bin_dur) if inside else 0) - math.lgamma(len(inside) + 1)
            assert math.isclose(r.ll[place], want, rel_tol=1e-9, abs_tol=1e-9)
    assert len(seen) == 3 + 18 + 1
