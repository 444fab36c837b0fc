"""Events in Arrow batches: whole batches are scored at once, events of as many bins together, so that no step is taken event by event."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.evidence import EXACT
from .models import Grammar, Motion, by_event, centres_of
from .tracks import Grid

#: Numbers that one array made on the way may hold, so that a task's memory does not grow with its events.
NUMBERS = 1 << 21


def groups_of(batch: pa.RecordBatch, places: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Events of as many bins, some at a time: their rows, and by event and bin log likelihoods (event, bin, place), durations and spikes."""
    bins = batch.column("bins")
    ends = bins.offsets.to_numpy() - bins.offsets[0].as_py()
    flat = bins.flatten()
    ll = flat.field("ll").flatten().to_numpy(zero_copy_only=False)
    if len(ll) != len(flat) * places:
        raise ValueError(f"emissions of other than {places} places")
    ll, dur, n = ll.reshape(-1, places), flat.field("bin_dur").to_numpy(zero_copy_only=False), flat.field("n_spikes").to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for size in np.unique(sizes[sizes > 0]):
        rows, step = np.flatnonzero(sizes == size), max(1, NUMBERS // int(size * places))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            at = ends[some][:, None] + np.arange(size)
            yield some, ll[at], dur[at], n[at]


def steps_of(dur: np.ndarray) -> np.ndarray:
    """Seconds between the centres of bins in a row."""
    return (dur[:, 1:] + dur[:, :-1]) / 2


def in_slices(n: int, each: int) -> Iterator[slice]:
    """Slices of n rows of `each` numbers, of NUMBERS at most."""
    size = max(1, NUMBERS // max(each, 1))
    for k in range(0, n, size):
        yield slice(k, k + size)


class Moves:
    """Moves of the laws of many events over steps of a given scale: truncated normal laws round each place, as `models.gaussian` has them.

    Steps of the usual length share a table. Others have their own, made from the few
    distances that the places of a grid have.
    """

    def __init__(self, grid: Grid, sigma: float, truncate: float, dt: float):
        centres = centres_of(grid)
        d2 = ((centres[:, None] - centres[None]) ** 2).sum(-1)
        self.gaps, at = np.unique(d2, return_inverse=True)
        self.at, self.sigma, self.truncate, self.dt = at.reshape(d2.shape), sigma, truncate, dt
        self.usual = self.weights(np.array([dt]))[0][self.at]

    def weights(self, step: np.ndarray) -> np.ndarray:
        var = self.sigma**2 * np.maximum(step, 1e-12)[:, None]
        return np.where(self.gaps <= self.truncate**2 * var, np.exp(-0.5 * self.gaps / var), 0.0)

    def __call__(self, p: np.ndarray, step: np.ndarray) -> np.ndarray:
        out, usual = np.empty_like(p), np.abs(step - self.dt) < 1e-9
        out[usual] = (p[usual] / self.usual.sum(1)) @ self.usual
        rest = np.flatnonzero(~usual)
        for s in in_slices(len(rest), self.at.size):
            w = self.weights(step[rest[s]])[:, self.at]
            out[rest[s]] = np.matmul(w, (p[rest[s]] / w.sum(2))[..., None])[..., 0]
        return out


def forward(ll: np.ndarray, start: np.ndarray, move: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of the first 1, 2, ... bins of each event, and the laws (event, mode, place) after the last one.

    Where no path is possible the evidence is -inf from there on, and the laws are even.
    """
    p, made = np.broadcast_to(start, (len(ll), *start.shape)), np.full(ll.shape[:2], -np.inf)
    value, even = np.zeros(len(ll)), 1.0 / start.size
    for t in range(ll.shape[1]):
        if t:
            p = move(t - 1, p)
        top = ll[:, t].max(1)
        some = np.isfinite(top)
        with np.errstate(invalid="ignore"):
            seen = np.where(some[:, None], np.exp(ll[:, t] - top[:, None]), 0.0)
        p = p * seen[:, None, :]
        mass = p.sum((1, 2))
        on = some & (mass > 0) & (value > -np.inf)
        safe = np.where(on, mass, 1.0)
        value = np.where(on, value + np.log(safe) + np.where(some, top, 0.0), -np.inf)
        p = np.where(on[:, None, None], p / safe[:, None, None], even)
        made[:, t] = value
    return made, p


def _even(grid: Grid, modes: int) -> np.ndarray:
    b = grid.nx * grid.ny
    return np.full((modes, b), 1 / (modes * b))


def _random(grid: Grid, motion: Motion, dt: float):
    return lambda ll, dur: forward(ll, _even(grid, 1), lambda k, p: np.full_like(p, 1 / ll.shape[2]))


def _stationary(grid: Grid, motion: Motion, dt: float):
    return lambda ll, dur: forward(ll, _even(grid, 1), lambda k, p: p)


def _diffusion(grid: Grid, motion: Motion, dt: float):
    moves = Moves(grid, motion.diffusion, motion.truncate, dt)

    def run(ll, dur):
        steps = steps_of(dur)
        return forward(ll, _even(grid, 1), lambda k, p: moves(p[:, 0], steps[:, k])[:, None])

    return run


def _first_order_imm(grid: Grid, motion: Motion, dt: float):
    """Stationary, diffusing and fragmented modes that switch; evenly likely at the start."""
    still, moves = Moves(grid, motion.stationary, motion.truncate, dt), Moves(grid, motion.diffusion, motion.truncate, dt)

    def run(ll, dur):
        steps, b = steps_of(dur), ll.shape[2]

        def move(k, p):
            s = steps[:, k]
            stay = np.full(len(s), motion.stickiness) if motion.switch_tau <= 0 else 1 / 3 + (2 / 3) * np.exp(-s / motion.switch_tau * 1.5)
            stay = stay[:, None, None]
            q = stay * p + (1 - stay) / 2 * (p.sum(1, keepdims=True) - p)
            return np.stack((still(q[:, 0], s), moves(q[:, 1], s), np.repeat(q[:, 2].sum(1, keepdims=True) / b, b, 1)), 1)

        return forward(ll, _even(grid, 3), move)

    return run


#: Models that whole batches are scored under, by the names that they have in the registry.
BATCHED: dict[str, Callable] = {"random": _random, "stationary": _stationary, "state-space-diffusion": _diffusion, "state-space-first-order-imm": _first_order_imm}


def lists(values: np.ndarray) -> pa.ListArray:
    """A list of each row of an array; rows of rows become lists of lists."""
    if values.ndim == 1:
        return pa.array(values, pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), lists(values.reshape(-1, *values.shape[2:])))


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def score_batched(emissions: DataFrame, grid: Grid, models: list[str], motion: Motion = Motion(), dt: float = 1.0, prefix: str = "", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per event and model, as `chains.score_chains` gives them: the same chains by matrix products over whole batches.

    `extra` names what else is wanted of terminal, made (the evidence of the first 1, 2, ...
    bins), spikes (of each bin) and laws, which are large.
    """
    unknown = [m for m in models if m not in BATCHED]
    if unknown:
        raise ValueError(f"no batched form of: {unknown}")
    kinds = {"terminal": "array<double>", "made": "array<double>", "spikes": "array<double>", "laws": "array<array<double>>"}
    rows = by_event(emissions)
    shape = f"session string, event_index {kind_of(rows, 'event_index')}, model string, evidence_support string, log_evidence double, n_time int, n_spikes long" + "".join(f", {c} {kinds[c]}" for c in extra)
    names, places = [x.split()[0] for x in shape.split(", ")], grid.nx * grid.ny

    def run(batches):
        kernels = {m: BATCHED[m](grid, motion, dt) for m in models}
        for batch in batches:
            for at, ll, dur, n in groups_of(batch, places):
                own = batch.select(["session", "event_index"]).take(pa.array(at))
                for m, kernel in kernels.items():
                    made, laws = kernel(ll, dur)
                    size = len(at)
                    more = {"terminal": lambda: lists(laws.sum(1)), "made": lambda: lists(made), "spikes": lambda: lists(n.astype(float)), "laws": lambda: lists(laws)}
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([prefix + m] * size), pa.array([EXACT] * size), pa.array(made[:, -1]), pa.array(np.full(size, ll.shape[1], np.int32)), pa.array(n.sum(1).astype(np.int64)), *[more[c]() for c in extra]], names)

    return rows.mapInArrow(run, shape)


def likelihood_totals(rows: DataFrame) -> DataFrame:
    """session, event_index, cells (bins and places that have a likelihood), total and best of each event's log likelihoods."""
    shape = f"session string, event_index {kind_of(rows, 'event_index')}, cells long, total double, best double"

    def run(batches):
        for batch in batches:
            bins = batch.column("bins")
            places = bins.flatten().field("ll")
            flat, of_bin = places.flatten().to_numpy(zero_copy_only=False), places.offsets.to_numpy() - places.offsets[0].as_py()
            ends = of_bin[bins.offsets.to_numpy() - bins.offsets[0].as_py()]
            held, some = flat != -np.inf, np.flatnonzero(np.diff(ends))
            cells, total, best = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.full(len(batch), -np.inf)
            if len(some):
                low = ends[:-1][some]
                cells[some], total[some], best[some] = np.add.reduceat(held.astype(np.int64), low), np.add.reduceat(np.where(held, flat, 0.0), low), np.maximum.reduceat(flat, low)
            yield pa.RecordBatch.from_arrays([batch.column("session"), batch.column("event_index"), pa.array(cells), pa.array(total), pa.array(best, mask=cells == 0)], ["session", "event_index", "cells", "total", "best"])

    return rows.select("session", "event_index", "bins").mapInArrow(run, shape)


def cut_evidence(grid: Grid, modes: tuple[str, ...], motion: Motion, dt: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Evidence (event, start, end, mode) of every run of bins; runs that are empty have none."""
    kernels = [BATCHED["random" if m == "state-space-fragmented" else m](grid, motion, dt) for m in modes]

    def run(ll: np.ndarray, dur: np.ndarray) -> np.ndarray:
        size, n = ll.shape[:2]
        out = np.full((size, n, n + 1, len(modes)), -np.inf)
        for a in range(n):  # one pass from each start scores all its ends
            for i, kernel in enumerate(kernels):
                out[:, a, a + 1 :, i] = kernel(ll[:, a:], dur[:, a:])[0]
        return out

    return run


def best_cuts(score: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, list[np.ndarray]]:
    """The best cut of each event's bins, as `models.best_segments` finds it: totals, and rows (event, segment, start, end, mode) of all segments."""
    size, n, m = len(score), score.shape[2] - 1, score.shape[3]
    best = np.full((grammar.most_segments + 1, n + 1, m, size), -np.inf)
    back = np.full((grammar.most_segments + 1, n + 1, m, 2, size), -1, np.int16 if n < 30000 else np.int64)
    best[1], back[1, :, :, 0] = np.moveaxis(score[:, 0], 0, 2), 0
    total, last_k, last_mode = np.full(size, -np.inf), np.zeros(size, int), np.zeros(size, int)
    for k in range(1, grammar.most_segments + 1):
        if k > 1 and n > 1:
            for mode in range(m):
                others = best[k - 1].copy()
                others[:, mode] = -np.inf
                before, value = others.argmax(1), others.max(1)  # (end, event)
                for end in range(2, n + 1):
                    v = value[1:end] + score[:, 1:end, end, mode].T - grammar.penalty
                    start = v.argmax(0)
                    best[k, end, mode] = np.take_along_axis(v, start[None], 0)[0]
                    back[k, end, mode] = start + 1, np.take_along_axis(before[1:end], start[None], 0)[0]
        top = best[k, n].argmax(0)
        v = np.take_along_axis(best[k, n], top[None], 0)[0]
        more = v > total
        total, last_k, last_mode = np.where(more, v, total), np.where(more, k, last_k), np.where(more, top, last_mode)
    at = np.flatnonzero(last_k)
    k, end, mode, found = last_k[at], np.full(len(at), n), last_mode[at], []
    while len(at):
        start, before = back[k, end, mode, :, at].T.astype(int)
        found.append(np.stack((at, k - 1, start, end, mode)))
        on = k > 1
        at, k, end, mode = at[on], k[on] - 1, start[on], before[on]
    rows = np.concatenate(found, 1) if found else np.zeros((5, 0), int)
    return total, list(rows[:, np.lexsort((rows[1], rows[0]))])


def segment_grammar(emissions: DataFrame, grid: Grid, grammar: Grammar, motion: Motion, dt: float) -> DataFrame:
    """As `models.segment_grammar`, for modes that are scored by batches."""
    rows, places, means = by_event(emissions), grid.nx * grid.ny, np.log(grammar.mean_bins)
    shape = f"session string, event_index {kind_of(rows, 'event_index')}, segment_index int, mode string, start_bin int, end_bin int, duration_s double, grammar_score double"
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches):
        evidence, modes = cut_evidence(grid, grammar.modes, motion, dt), pa.array(grammar.modes)
        for batch in batches:
            for at, ll, dur, _ in groups_of(batch, places):
                n = ll.shape[1]
                long = np.arange(n + 1)[None, :] - np.arange(n)[:, None]
                prior = -0.5 * ((np.log(np.maximum(long, 1))[..., None] - means) / grammar.log_sd) ** 2
                prior[long < max(grammar.shortest, 1)] = -np.inf
                for s in in_slices(len(at), n * (n + 1) * len(modes)):
                    total, (event, index, start, end, mode) = best_cuts(evidence(ll[s], dur[s]) + prior, grammar)
                    upto = np.concatenate((np.zeros((len(total), 1)), np.cumsum(dur[s], 1)), 1)
                    own = batch.select(["session", "event_index"]).take(pa.array(at[s][event]))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(index, pa.int32()), modes.take(pa.array(mode)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(upto[event, end] - upto[event, start]), pa.array(total[event])], names)

    return rows.mapInArrow(run, shape)


def score_matrices(rows: DataFrame, places: int, model: str) -> DataFrame:
    """Evidence under a session's own steps: rows of `bins`, and before the events of a session one whose `matrix` is [to, from] by place.

    Only places that steps lead to are there, at even odds in the first bin. Events of
    sessions without steps have no row.
    """
    shape = f"session string, event_index {kind_of(rows, 'event_index')}, model string, evidence_support string, log_evidence double, n_time int, n_spikes long, valid_places int, terminal array<double>"
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches):
        held, steps = None, None
        for batch in batches:
            given = np.flatnonzero(batch.column("matrix").is_valid().to_numpy(zero_copy_only=False))
            sessions = np.array(batch.column("session").to_pylist(), object)
            for low, high in zip((-1, *given), (*given, len(batch))):
                if low >= 0:
                    held, steps = sessions[low], batch.column("matrix")[int(low)].values.flatten().to_numpy(zero_copy_only=False).reshape(places, places)
                mine = low + 1 + np.flatnonzero(sessions[low + 1 : high] == held)
                if held is None or not len(mine):
                    continue
                here = steps.any(1)
                start = (here / max(here.sum(), 1))[None]
                part = batch.select(["session", "event_index", "bins"]).take(pa.array(mine))
                for at, ll, _, n in groups_of(part, places):
                    made, laws = forward(np.where(here, ll, -np.inf), start, lambda k, p: p @ steps.T)
                    size, own = len(at), part.select(["session", "event_index"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([model] * size), pa.array([EXACT] * size), pa.array(made[:, -1]), pa.array(np.full(size, ll.shape[1], np.int32)), pa.array(n.sum(1).astype(np.int64)), pa.array(np.full(size, here.sum(), np.int32)), lists(laws[:, 0])], names)

    return rows.mapInArrow(run, shape)
