"""Signals with planted bursts, and made events whose model is known."""

import numpy as np
import pytest

from driftfield.operators import signals, synthetic
from driftfield.operators.models import Motion, centres_of
from driftfield.operators.tracks import Grid


def test_bursts_are_found(spark):
    rng, rate, n = np.random.default_rng(0), 1000.0, 60_000
    x = rng.normal(size=(2, n))
    planted = [5.0, 20.02, 41.3, 55.0]
    for at in planted:
        k = np.arange(int(at * rate), int((at + 0.08) * rate))
        x[0, k] += 6 * np.sin(2 * np.pi * 200 * k / rate)
    rows = [("s", c, i, float(x[c, i])) for c in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "session string, channel int, sample long, value double")
    got = signals.signal_events(df, rate, signals.Band(peak=6.0, edge=3.0, shortest=0.05)).orderBy("start").collect()
    assert len(got) == 4 and all(abs(r.start - a) < 0.03 and abs(r.end - a - 0.08) < 0.03 and r.start <= r.peak <= r.end for r, a in zip(got, planted))
    # pieces with margins give what the whole channel gives
    whole = signals.envelope(x[0], rate, signals.Band())
    parts = {r["sample"]: r.envelope for r in signals.envelopes(df.where("channel = 0"), rate, length=8192, margin=4096).collect()}
    inner = np.arange(1000, n - 1000)
    assert len(parts) == n and np.allclose([parts[int(i)] for i in inner[::37]], whole[inner[::37]], atol=0.02)


def test_made_models_are_found_again(spark):
    grid = Grid(0.0, 0.0, 10.0, 6, 6)
    centres = centres_of(grid)
    rows = [("s", c, b, float(40 * np.exp(-((centres[b] - centres[c]) ** 2).sum() / 200) + 0.01)) for c in range(36) for b in range(36)]
    rates = spark.createDataFrame(rows, "session string, cell_id int, bin_id int, rate_hz double")
    motion = Motion(diffusion=12.0, momentum=5.0, decay=1.0)
    made = ("random", "stationary", "state-space-diffusion", "state-space-momentum-exact")
    got = synthetic.recovery(rates, grid, made, made, 25, 10, 1.0, motion).collect()
    assert len(got) == 100
    share = {m: np.mean([r.best_model == m for r in got if r.true_model == m]) for m in made}
    assert all(v >= 0.7 for v in share.values()), share
    again = synthetic.made_events(rates, grid, ("stationary",), 3, 4, 1.0, motion, overdispersion=0.5).collect()
    assert again == synthetic.made_events(rates.repartition(7), grid, ("stationary",), 3, 4, 1.0, motion, overdispersion=0.5).collect()
    with pytest.raises(ValueError):
        synthetic.made_events(rates, grid, ("goal",), 1, 2, 1.0)


def test_sweeps_cover_settings(spark):
    grid = Grid(0.0, 0.0, 10.0, 2, 2)
    rows = [("s", 1, t, 1.0, 1, [0.0, 1.0, 2.0, float(t)]) for t in range(3)]
    df = spark.createDataFrame(rows, "session string, event_index long, t_idx int, bin_dur double, n_spikes long, ll array<double>")
    got = {(r.sweep_id, r.model): r for r in synthetic.sweep(df, grid, ["random", "state-space-diffusion"], [{"diffusion": 3.0}, {"diffusion": 30.0, "decay": 0.5}]).collect()}
    assert len(got) == 4 and got[0, "random"].log_evidence == got[1, "random"].log_evidence
    assert (got[0, "random"].decay, got[1, "random"].decay, got[1, "random"].diffusion) == (0.9, 0.5, 30.0)
    assert got[0, "state-space-diffusion"].log_evidence != got[1, "state-space-diffusion"].log_evidence
