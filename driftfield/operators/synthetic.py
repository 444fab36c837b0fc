"""Made events with a known model: paths, spikes, how often scoring finds the model again, and sweeps of settings."""

from __future__ import annotations

from dataclasses import asdict, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import Event, Motion, centres_of, gaussian, score_events
from .tracks import Grid

#: Models that paths can be drawn from.
PATHS = ("random", "stationary", "state-space-diffusion", "state-space-momentum-exact")


def draw_path(model: str, bins: int, centres: np.ndarray, dt: float, motion: Motion, rng: np.random.Generator) -> np.ndarray:
    """Places of a path under a model, each drawn from the law that scoring uses."""
    b = len(centres)
    path = [int(rng.integers(b))]
    e = Event(np.zeros((bins, b)), centres, np.full(max(0, bins - 1), dt), dt, motion)
    for t in range(1, bins):
        now = path[-1]
        if model == "random":
            path.append(int(rng.integers(b)))
            continue
        if model == "stationary":
            path.append(now)
            continue
        if model == "state-space-diffusion" or t == 1:
            sigma = motion.diffusion if model == "state-space-diffusion" else motion.momentum
            p = gaussian(centres, centres[now][None], sigma * dt**0.5, motion.truncate)[:, 0]
        else:
            d = np.exp(-dt / motion.decay_tau) if motion.decay_tau > 0 else min(motion.decay, 1.0)
            target = centres[now] + d * (centres[now] - centres[path[-2]])
            p = gaussian(centres, target[None], motion.momentum * dt**0.5, motion.truncate)[:, 0]
        path.append(int(rng.choice(b, p=p)))
    return np.array(path[: len(e.ll)])


def made_events(rates: DataFrame, grid: Grid, models: tuple[str, ...], each: int, bins: int, dt: float, motion: Motion = Motion(), overdispersion: float = 0.0, seed: int = 1) -> DataFrame:
    """Emissions of `each` made events of every model in every session, with the model that made them.

    rates: session, cell_id, bin_id, rate_hz. A session's map, cells x places, is gathered for
    the tasks that make its events; spikes are Poisson, or negative binomial with a variance of mean +
    overdispersion * mean**2. An event's draws depend on its session, model and number alone.
    """
    unknown = [m for m in models if m not in PATHS]
    if unknown:
        raise ValueError(f"no paths of: {unknown}")
    centres = centres_of(grid)
    maps = rates.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("cell_id", "bin_id", "rate_hz"))).alias("m"))
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("of")) for i, m in enumerate(models)]))
    todo = maps.select("session", "m", named.alias("x")).select("session", "m", "x.*")
    shape = "session string, event_index long, true_model string, t_idx int, bin_dur double, n_spikes long, ll array<double>"

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cells = {c: i for i, c in enumerate(sorted({x["cell_id"] for x in row["m"]}))}
                map_ = np.full((len(cells), len(centres)), 1e-4)
                for x in row["m"]:
                    map_[cells[x["cell_id"]], x["bin_id"]] = x["rate_hz"]
                logs, total = np.log(map_ * dt), map_.sum(0) * dt
                for k in range(each):
                    rng = np.random.default_rng([seed, row["of"], k, *row["session"].encode()])
                    path = draw_path(row["model"], bins, centres, dt, motion, rng)
                    mean = map_[:, path].T * dt
                    if overdispersion > 0:
                        mean = mean * rng.gamma(1 / overdispersion, overdispersion, mean.shape)
                    n = rng.poisson(mean)
                    ll = n @ logs - total[None, :]
                    out += [(row["session"], row["of"] * each + k, row["model"], t, dt, int(n[t].sum()), ll[t].tolist()) for t in range(bins)]
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in shape.split(", ")])

    return todo.mapInArrow(run, shape)


def recovery(rates: DataFrame, grid: Grid, made: tuple[str, ...], scored: tuple[str, ...], each: int, bins: int, dt: float, motion: Motion = Motion(), **options) -> DataFrame:
    """The true and the best model of every made event; ties go to the smaller name."""
    events = made_events(rates, grid, made, each, bins, dt, motion, **options)
    truth = events.where("t_idx = 0").select("session", "event_index", "true_model")
    scores = score_events(events.drop("true_model"), grid, list(scored), motion, dt)
    best = scores.groupBy("session", "event_index").agg(F.min(F.struct((-F.col("log_evidence")).alias("e"), "model"))["model"].alias("best_model"))
    return truth.join(best, ["session", "event_index"])


def sweep(emissions: DataFrame, grid: Grid, models: list[str], settings: list[dict], motion: Motion = Motion(), dt: float = 1.0) -> DataFrame:
    """Every event and model under each setting, a set of changes to the motion: scores with one column a changed scale."""
    names = sorted({k for s in settings for k in s})
    out = None
    for i, s in enumerate(settings):
        changed = replace(motion, **s)
        values = asdict(changed)
        one = score_events(emissions, grid, models, changed, dt).withColumn("sweep_id", F.lit(i))
        for k in names:
            one = one.withColumn(k, F.lit(float(values[k])))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a sweep needs a setting")
    return out
