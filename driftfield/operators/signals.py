"""Short events from recorded signals: band envelopes, robust scores, and runs above a threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tracks import numbered_runs, time_cell, with_neighbours


@dataclass(frozen=True)
class Band:
    """The band in hertz, the filter's order, the smoothing in seconds, thresholds of the score, and bounds of an event in seconds."""

    low: float = 150.0
    high: float = 250.0
    order: int = 3
    smooth: float = 0.0125
    edge: float = 2.0
    peak: float = 5.0
    gap: float = 0.03
    shortest: float = 0.02
    longest: float = 0.5


def envelope(x: np.ndarray, rate: float, band: Band) -> np.ndarray:
    """Size of the analytic signal in the band: both passes of the filter as one gain over frequencies, then a moving average."""
    n = len(x)
    f = np.fft.fftfreq(n, 1 / rate)
    a = np.abs(f)
    with np.errstate(divide="ignore", over="ignore"):
        width = band.high - band.low
        off = np.where(a > 0, (a * a - band.low * band.high) / (a * width), np.inf)
        gain = 1 / (1 + off ** (2 * band.order))
    analytic = np.fft.ifft(np.fft.fft(x - x.mean()) * np.where(f > 0, 2 * gain, 0.0))
    k = max(1, int(round(band.smooth * rate)))
    return np.convolve(np.abs(analytic), np.full(k, 1 / k), mode="same")


def envelopes(signal: DataFrame, rate: float, band: Band = Band(), length: int = 1 << 16, margin: int = 1 << 12) -> DataFrame:
    """The envelope of each channel's samples (session, channel, sample, value), in pieces that overlap.

    A piece is filtered with a margin of its neighbours' samples on both sides, far longer
    than the filter rings, so that no channel has to fit one task. Missing samples count as 0.
    """
    at = F.col("sample")
    piece = F.floor(at / length).cast("long")
    low, high = F.floor((at - margin) / length).cast("long"), F.floor((at + margin) / length).cast("long")
    rows = signal.where(F.col("value").isNotNull()).withColumn("piece", F.explode(F.array_distinct(F.array(low, piece, high)))).where("piece >= 0")

    def run(table: pa.Table) -> pa.Table:
        start = table["piece"][0].as_py() * length
        sample = table["sample"].to_numpy()
        x = np.zeros(length + 2 * margin)
        x[sample - start + margin] = table["value"].to_numpy()
        own = (sample >= start) & (sample < start + length)
        e = envelope(x, rate, band)[sample[own] - start + margin]
        n = len(e)
        return pa.table({"session": pa.array([table["session"][0].as_py()] * n, pa.string()), "channel": pa.array([table["channel"][0].as_py()] * n, pa.int32()), "sample": pa.array(sample[own]), "envelope": pa.array(e)})

    return rows.select("session", F.col("channel").cast("int").alias("channel"), F.col("sample").cast("long").alias("sample"), F.col("value").cast("double").alias("value"), "piece").groupBy("session", "channel", "piece").applyInArrow(run, "session string, channel int, sample long, envelope double")


def band_scores(signal: DataFrame, rate: float, band: Band = Band(), accuracy: int = 100_000) -> DataFrame:
    """The largest robust score over a session's channels at each sample: distance from the median in median deviations, scaled.

    Medians are those of Spark's quantile summary, exact to one part in `accuracy` of the ranks.
    """
    e = envelopes(signal, rate, band)
    middle = e.groupBy("session", "channel").agg(F.percentile_approx("envelope", 0.5, accuracy).alias("_m"))
    off = e.join(middle, ["session", "channel"]).withColumn("_d", F.abs(F.col("envelope") - F.col("_m")))
    spread = off.groupBy("session", "channel").agg(F.percentile_approx("_d", 0.5, accuracy).alias("_s"))
    z = (F.col("envelope") - F.col("_m")) / F.greatest(1.4826 * F.col("_s"), F.lit(1e-300))
    return off.join(spread, ["session", "channel"]).groupBy("session", "sample").agg(F.max(z).alias("z")).withColumn("t", F.col("sample") / rate)


def signal_events(signal: DataFrame, rate: float, band: Band = Band()) -> DataFrame:
    """Runs of scores above the edge, joined over short gaps, that reach the peak and last long enough: start, end, peak time and score."""
    above = band_scores(signal, rate, band).where(F.col("z") >= band.edge).select("session", "t", "z")
    rows = with_neighbours(above, []).withColumn("_cell", time_cell())
    new = F.coalesce((F.col("t") - F.col("prev.t") > band.gap).cast("int"), F.lit(1))
    runs = numbered_runs(rows, new, "run", "session", ["t"]).groupBy("session", "run").agg(F.min("t").alias("start"), (F.max("t") + 1 / rate).alias("end"), F.max(F.struct("z", "t")).alias("p"))
    long = F.col("end") - F.col("start")
    kept = runs.where((F.col("p.z") >= band.peak) & (long >= band.shortest) & (long <= band.longest))
    return kept.select("session", F.col("run").alias("event_index"), "start", "end", F.col("p.t").alias("peak"), F.col("p.z").alias("z_power"))
