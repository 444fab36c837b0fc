"""Streams: event binning with watermarks, runs by session windows, and causal evidence of open events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.models import centres_of, gaussian
from ..operators.tracks import Grid


def binned_counts(spikes: DataFrame, width: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """Spikes by cell and tumbling window of a stream with columns session, ts and cell_id."""
    return spikes.withWatermark("ts", late).groupBy("session", "cell_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n")).select("session", "cell_id", F.col("window.start").alias("bin_start"), "n")


def sliding_counts(spikes: DataFrame, width: str = "40 seconds", step: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """As binned_counts, over overlapping windows."""
    return spikes.withWatermark("ts", late).groupBy("session", F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select("session", F.col("window.start").alias("bin_start"), "n")


def runs(position: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of samples without a gap, by session windows; a run is final once the watermark passes it."""
    return position.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("samples")).select("session", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "samples")


def event_spike_join(spikes: DataFrame, events: DataFrame, longest: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Spikes (session, ts, cell_id) with start <= ts < end of the short events of their session, both streams.

    Events are cut into pieces of at most `longest`, so that one of any length is met whole
    and the time that a piece spans bounds what either side must keep: a spike is dropped once
    no piece that may still come can hold it, a piece once no spike can. Rows later than
    `late` behind the newest one of their side do not count. Rows come as soon as both sides are there.
    """
    width = F.expr(f"cast(interval {longest} as interval day to second)")
    cut = events.where("end > start").select("session", "event_index", F.explode(F.sequence("start", "end", width)).alias("piece"), "end").where("piece < end")
    e = cut.withWatermark("piece", late).alias("e")
    s = spikes.withWatermark("ts", late).alias("s")
    met = F.expr(f"s.session = e.session and s.ts >= e.piece and s.ts < e.piece + interval {longest} and s.ts < e.end")
    return s.join(e, met).select("e.session", "e.event_index", "s.ts", *[f"s.{c}" for c in spikes.columns if c not in ("session", "ts")])


def causal_evidence(emissions: DataFrame, grid: Grid, sigma: float, dt: float, truncate: float = 5.0, idle_ms: int = 3_600_000) -> DataFrame:
    """Evidence of each event's bins so far, under diffusion and at random, as bins arrive.

    The state of an event is one distribution over places, two sums and the last bin; bins
    must arrive in order within an event. A bin at or before the last comes too late to
    count and is given without evidence. An event without new bins for `idle_ms` is over, and its state goes.
    """
    centres = centres_of(grid)
    move = gaussian(centres, centres, sigma * dt**0.5, truncate)
    b = len(centres)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        p, path, loose, last = state.get if state.exists else ([1.0 / b] * b, 0.0, 0.0, -1)
        p, out = np.array(p), []
        for rows in batches:
            for t, ll in rows.sort_values("t_idx")[["t_idx", "ll"]].itertuples(index=False):
                if t <= last:
                    out.append((*key, int(t), None, None))
                    continue
                ll = np.array(ll, float)
                top = ll.max() if np.isfinite(ll.max()) else 0.0
                seen = np.exp(ll - top)
                p = (move @ p if last >= 0 else p) * seen
                if p.sum() <= 0:  # no path from here on: minus infinity stays
                    path, p = -np.inf, np.full(b, 1.0 / b)
                else:
                    path += float(np.log(p.sum()) + top)
                loose += float(np.log(seen.sum()) + top - np.log(b)) if seen.any() else -np.inf
                p, last = p / p.sum(), int(t)
                out.append((*key, last, path, loose))
        state.update((p.tolist(), path, loose, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "event_index", "t_idx", "diffusion", "random"])

    return emissions.groupBy("session", "event_index").applyInPandasWithState(
        step, "session string, event_index long, t_idx int, diffusion double, random double", "p array<double>, path double, loose double, last int", "append", GroupStateTimeout.ProcessingTimeTimeout)
