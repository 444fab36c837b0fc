"""Kernel densities of marks: a mark meets the support once, however many events hold it."""

import math

from driftfield.operators import marks


def test_events_of_any_block_hold_their_marks_and_no_mark_meets_an_event_in_a_join(spark):
    k = marks.Kernels(reach=3.0, hashed=1)
    spikes = [("a", i * 1.3, i % 2, float(i % 5)) for i in range(900)] + [("a", None, 0, 1.0), ("b", 3.0, 0, 1.0)]
    events = [("a", i, 0.7 * i, 0.7 * i + 90.0) for i in range(1200)] + [("a", 2000, 250.0, 250.0), ("b", 1, 0.0, 5.0)]
    s = spark.createDataFrame(spikes, "session string, t double, grp long, f double")
    e = spark.createDataFrame(events, "session string, event_index long, start double, end double")
    support = spark.createDataFrame([("a", g, 0, 2.0, 0.0) for g in (-1, 0)], "session string, grp long, bin_id int, f double, log_w double")
    widths = spark.createDataFrame([("a", g, 1.0) for g in (-1, 0)], "session string, grp long, var_f double")
    rates = spark.createDataFrame([("a", -1, 0, 0.5), ("a", 0, 0, 0.25), ("a", -1, 2, 0.5)], "session string, grp long, bin_id int, rate_hz double")
    df = marks.kernel_events(s, e, support, widths, rates, ["f"], "grp", 20.0, 3, k)
    got = {(r.session, r.event_index): r.bins for r in df.collect()}
    assert set(got) == {x[:2] for x in events if x[0] == "a"}  # the other session has no map
    for session, index, start, end in events[:1201]:
        bins = got[session, index]
        assert len(bins) == max(math.ceil((end - start) / 20.0 - 1e-9), 1)
        for b in bins:
            low = start + b.t_idx * 20.0
            held = [x for x in spikes if x[0] == "a" and x[1] is not None and low <= x[1] < min(end, low + 20.0)]
            want = sum(math.log(0.5 if g else 0.25) - 0.5 * min((f - 2.0) ** 2, 9.0) - 0.5 * math.log(2 * math.pi) for _, _, g, f in held)
            want += -0.5 * b.bin_dur + (len(held) * math.log(b.bin_dur) if held else 0.0) - math.lgamma(len(held) + 1)
            assert b.n_spikes == len(held) and math.isclose(b.ll[0], want, rel_tol=1e-9, abs_tol=1e-9) and b.ll[1] == -math.inf
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("event_index" in x or "start" in x for x in joins)
