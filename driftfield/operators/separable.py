"""Models whose steps along the two axes are apart, each over a grid of parameters that is marginalised.

The models of one event say what is meant; `Whole` scores many events of as many bins at
once, with the events along the last axis of every array, so that a step is a few matrix
products over all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import groups_of, kind_of, steps_of
from .models import Event, by_event, centres_of, lse, random, stationary
from .tracks import Grid

#: Numbers that the pairs of places of the events of one go may hold: few enough to stay in a core's cache.
AT_ONCE = 1 << 17


@dataclass(frozen=True)
class Settings:
    """Scales in units of the grid (per square root of a second, or per second), and their even priors."""

    still: tuple[float, ...] = (5.0, 10.0, 20.0, 40.0)
    diffusion: tuple[float, ...] = (10.0, 20.0, 40.0, 80.0)
    momentum: tuple[float, ...] = (5.0, 20.0)
    decay: tuple[float, ...] = (0.05, 0.5)
    initial: float = 5.0


def line_law(n: int, variance: float) -> np.ndarray:
    """[to, from] on a line of n places: a normal law that is whole again at the ends, however narrow."""
    gap = np.arange(n)[:, None] - np.arange(n)[None, :]
    w = np.exp(-(gap**2) / (2 * max(variance, 1e-300)))
    return w / w.sum(0, keepdims=True)


def turning_law(n: int, sd: float, decay: float, dt: float) -> np.ndarray:
    """[next, now, before] on a line: speed decays at a rate, with the noise that it gathers over a step."""
    variance = max(sd * sd * dt * dt / (2 * decay) * (1 - np.exp(-2 * decay * dt)), 1e-300)
    keep = np.exp(-dt * decay)
    mean = (1 + keep) * np.arange(n)[:, None] - keep * np.arange(n)[None, :]
    w = np.exp(-((np.arange(n)[:, None, None] - mean[None]) ** 2) / (2 * variance))
    total = w.sum(0)
    for now, before in zip(*np.nonzero(total == 0)):  # all places are out of reach: the end on that side
        w[0 if mean[now, before] < 0 else n - 1, now, before] = 1.0
    return w / w.sum(0)[None]


def _shape(e: Event) -> tuple[int, int, float]:
    at, unit = e.places()
    nx, ny = at.max(0) + 1
    if nx * ny != len(at):
        raise ValueError("separable models need a whole rectangle of places")
    return int(nx), int(ny), unit


def _scaled(e: Event, t: int, nx: int, ny: int) -> tuple[np.ndarray, float]:
    top = e.ll[t].max()
    return np.exp(e.ll[t] - top).reshape(nx, ny), float(top)


def gathered_round_a_place(e: Event, sd: float) -> float:
    """One unknown centre throughout; each bin lies round it, apart from the others."""
    nx, ny, unit = _shape(e)
    lx, ly = line_law(nx, (sd / unit) ** 2), line_law(ny, (sd / unit) ** 2)
    logs = np.zeros((nx, ny))
    for t in range(len(e.ll)):
        seen, top = _scaled(e, t, nx, ny)
        logs += np.log(np.maximum(lx.T @ seen @ ly, 1e-300)) + top
    return float(lse(logs.ravel()) - np.log(nx * ny))


def diffusion(e: Event, sd: float) -> float:
    nx, ny, unit = _shape(e)
    p, total = np.full((nx, ny), 1 / (nx * ny)), 0.0
    for t in range(len(e.ll)):
        if t:
            v = (sd / unit) ** 2 * e.steps[t - 1]
            p = e.keep(("line", nx, round(v, 12)), lambda v=v: line_law(nx, v)) @ p @ e.keep(("line", ny, round(v, 12)), lambda v=v: line_law(ny, v)).T
        seen, top = _scaled(e, t, nx, ny)
        p = p * seen
        total += float(np.log(p.sum()) + top)
        p = p / p.sum()
    return total


def momentum(e: Event, sd: float, decay: float, initial: float) -> float:
    """A chain on pairs along each axis; the joint state is (x before, x, y before, y). One bin is random."""
    if len(e.ll) == 1:
        return random(e)[0]
    nx, ny, unit = _shape(e)
    p, total = np.full((nx, ny), 1 / (nx * ny)), 0.0
    for t in range(len(e.ll)):
        if t == 1:
            v = (initial * e.steps[0] / unit) ** 2
            p = np.einsum("ax,by,xy->xayb", line_law(nx, v), line_law(ny, v), p)
        elif t > 1:
            step = float(e.steps[t - 1])
            lx, ly = (e.keep(("turn", n, sd, decay, round(step, 9)), lambda n=n: turning_law(n, sd / unit, decay, step)) for n in (nx, ny))
            p = np.einsum("apq,qpyb->payb", lx, p)
            p = np.einsum("bsr,pars->pasb", ly, p)
        seen, top = _scaled(e, t, nx, ny)
        p = p * (seen if t == 0 else seen[None, :, None, :])
        total += float(np.log(p.sum()) + top)
        p = p / p.sum()
    return total


def suite(e: Event, s: Settings) -> list[tuple[str, float | None, float | None, float]]:
    """(model, scale, decay, log evidence) of every setting."""
    out = [("random", None, None, random(e)[0]), ("stationary", None, None, stationary(e)[0])]
    out += [("stationary-gaussian", v, None, gathered_round_a_place(e, v)) for v in s.still]
    out += [("diffusion", v, None, diffusion(e, v)) for v in s.diffusion]
    return out + [("momentum", v, d, momentum(e, v, d, s.initial)) for v in s.momentum for d in s.decay]


def alike(values: np.ndarray) -> Iterator[tuple[float, slice | np.ndarray]]:
    """The distinct values, to the ninth digit, and the places of each."""
    _, first, back = np.unique(np.round(values, 9), return_index=True, return_inverse=True)
    if len(first) == 1:
        yield float(values[0]), slice(None)
        return
    order = np.argsort(back, kind="stable")
    for k, some in zip(first, np.split(order, np.cumsum(np.bincount(back))[:-1])):
        run = some[-1] - some[0] + 1 == len(some)
        yield float(values[k]), slice(int(some[0]), int(some[-1]) + 1) if run else some


class Whole:
    """Events of as many bins, all at once: seen (bin, x, y, event), the tops (bin, event) that it was scaled by, and steps (event, step).

    Where a bin has no possible place, or no path is left, the evidence is -inf.
    """

    def __init__(self, ll: np.ndarray, dur: np.ndarray, nx: int, ny: int, unit: float, keep: Callable):
        self.steps, self.nx, self.ny, self.unit, self.keep = steps_of(dur), nx, ny, unit, keep
        self.top = np.ascontiguousarray(ll.max(2).T)
        self.possible = (self.top > -np.inf).all(0)
        with np.errstate(invalid="ignore"):
            seen = np.exp(ll - np.where(np.isfinite(self.top), self.top, 0.0).T[..., None])
        self.seen = np.ascontiguousarray(seen.transpose(1, 2, 0)).reshape(ll.shape[1], nx, ny, len(ll))
        self.ll = ll

    def _line(self, n: int, variance: float) -> np.ndarray:
        return self.keep(("line", n, round(variance, 12)), lambda: line_law(n, variance))

    def _logs(self, values: np.ndarray) -> np.ndarray:
        return np.where(self.possible, values, -np.inf)

    def random(self) -> np.ndarray:
        return self._logs((lse(self.ll, 2) - np.log(self.ll.shape[2])).sum(1))

    def stationary(self) -> np.ndarray:
        return lse(self.ll.sum(1), 1) - np.log(self.ll.shape[2])

    def gathered_round_a_place(self, sd: float) -> np.ndarray:
        v = (sd / self.unit) ** 2
        near = np.matmul(self._line(self.ny, v).T, _along_x(self._line(self.nx, v).T, self.seen))
        logs = np.log(np.maximum(near, 1e-300)).sum(0) + np.where(self.possible, self.top, 0.0).sum(0)
        return self._logs(lse(logs.reshape(-1, logs.shape[-1]), 0) - np.log(self.nx * self.ny))

    def _forward(self, first: np.ndarray, move: Callable[[int, np.ndarray], np.ndarray], spread: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sums of all paths: `spread` lays what is seen (x, y, event) beside the axes of the states, and `move` takes step k."""
        p, total, weight = first, np.zeros(self.seen.shape[-1]), np.ones(self.seen.shape[-1])
        for t in range(len(self.seen)):
            if t:
                p = move(t - 1, p)
            p = p * (self.seen[t] * weight if p.ndim == 3 else spread(self.seen[t] * weight))
            mass = p.reshape(-1, p.shape[-1]).sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                total = total + np.log(mass) + self.top[t]
                weight = np.where(mass > 0, 1 / mass, 0.0)
        return np.where(self.possible & ~np.isnan(total), total, -np.inf)

    def _even(self) -> np.ndarray:
        return np.full(self.seen.shape[1:], 1 / (self.nx * self.ny))

    def diffusion(self, sd: float) -> np.ndarray:
        def move(k: int, p: np.ndarray) -> np.ndarray:
            out = np.empty_like(p)
            for step, at in alike(self.steps[:, k]):
                v = (sd / self.unit) ** 2 * step
                out[..., at] = np.matmul(self._line(self.ny, v), _along_x(self._line(self.nx, v), p[None, ..., at])[0])
            return out

        return self._forward(self._even(), move, lambda s: s)

    def momentum(self, sd: float, decay: float, initial: float) -> np.ndarray:
        if len(self.seen) == 1:
            return self.random()

        def move(k: int, p: np.ndarray) -> np.ndarray:
            nx, ny = self.nx, self.ny
            out = np.empty((nx, nx, ny, ny, p.shape[-1]))  # x before, x, y before, y
            for step, at in alike(self.steps[:, k]):
                here = p[..., at]
                turned = out[..., at] if isinstance(at, slice) else np.empty((nx, nx, ny, ny, len(at)))
                if k == 0:
                    v = (initial * step / self.unit) ** 2
                    np.multiply((here[:, None] * line_law(nx, v).T[..., None, None])[:, :, :, None], line_law(ny, v).T[..., None], out=turned)
                else:
                    lx, ly = (self.keep(("turn", n, sd, decay, round(step, 9)), lambda n=n, step=step: turning_law(n, sd / self.unit, decay, step)) for n in (nx, ny))
                    for x in range(nx):  # each [next, before] by [before, the rest]
                        moved = np.matmul(lx[:, x, :], here[:, x].reshape(nx, -1)).reshape(nx, ny, ny, -1)
                        for y in range(ny):
                            turned[x, :, y] = np.matmul(ly[:, y, :], moved[:, :, y])
                if not isinstance(at, slice):
                    out[..., at] = turned
            return out

        return self._forward(self._even(), move, lambda s: s[None, :, None])


def _along_x(law: np.ndarray, p: np.ndarray) -> np.ndarray:
    """law [to, from] by p [bin, from, y, event]."""
    return np.matmul(law, p.reshape(*p.shape[:2], -1)).reshape(p.shape[0], len(law), *p.shape[2:])


def score_settings(emissions: DataFrame, grid: Grid, settings: Settings = Settings(), dt: float = 1.0) -> DataFrame:
    """One row per event, model and setting, as `suite` has them; `regression.marginal_evidence` makes one row a model of them."""
    rows, centres = by_event(emissions), centres_of(grid)
    shape = f"session string, event_index {kind_of(rows, 'event_index')}, model string, scale double, decay double, log_evidence double"
    names = [x.split()[0] for x in shape.split(", ")]
    at, unit = Event(np.zeros((1, len(centres))), centres, np.zeros(0), dt, None).places()
    nx, ny = (int(v) for v in at.max(0) + 1)

    def run(batches):
        made: dict = {}
        keep = Event(np.zeros((1, 1)), centres, np.zeros(0), dt, None, made=made).keep
        for batch in batches:
            for mine, ll, dur, _ in groups_of(batch, len(centres)):
                # events whose last step, the one that differs, is as long stand together
                order, size = np.lexsort(np.round(dur.T, 9)), max(1, AT_ONCE // (nx * ny) ** 2)
                for k in range(0, len(mine), size):
                    some = order[k : k + size]
                    w = Whole(ll[some], dur[some], nx, ny, unit, keep)
                    found = [("random", None, None, w.random()), ("stationary", None, None, w.stationary())]
                    found += [("stationary-gaussian", v, None, w.gathered_round_a_place(v)) for v in settings.still]
                    found += [("diffusion", v, None, w.diffusion(v)) for v in settings.diffusion]
                    found += [("momentum", v, d, w.momentum(v, d, settings.initial)) for v in settings.momentum for d in settings.decay]
                    own, n = batch.select(["session", "event_index"]).take(pa.array(np.tile(mine[some], len(found)))), len(some)
                    made_of = [pa.array(np.repeat(np.array([f[i] for f in found], object), n), kind) for i, kind in ((0, pa.string()), (1, pa.float64()), (2, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*own.columns, *made_of, pa.array(np.concatenate([f[3] for f in found]))], names)

    return rows.mapInArrow(run, shape)
