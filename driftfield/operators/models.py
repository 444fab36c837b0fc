"""Latent-motion models of an event: likelihoods of time by place in, evidence and posteriors out.

A kernel is a small numpy recursion over one event, which Spark gathers and hands over in
Arrow batches; one pass scores all models asked for, so emissions are shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import EXACT, NOT_SCORED, TRUNCATED
from ..functions.likelihood import log_factorial
from .tracks import Grid, event_bins, sums_in_bins


@dataclass(frozen=True)
class Motion:
    """Scales of movement, in units of the grid and seconds."""

    diffusion: float = 12.0
    stationary: float = 1.0
    momentum: float = 12.0
    decay: float = 0.9
    decay_tau: float = 0.0
    stickiness: float = 0.9
    switch_tau: float = 0.0
    truncate: float = 5.0
    goal_speed: float = 4.0
    #: Places of a bin that pruned models keep.
    top_k: int = 128
    #: Of candidate models: the likeliest places of a bin, widths by bin (whatever its length), decay and chance to stay in a mode.
    candidate_k: int = 64
    candidate_still: float = 2.0
    candidate_width: float = 12.0
    candidate_decay: float = 0.95
    candidate_stickiness: float = 0.94
    #: Speed along routes, and the width round their targets.
    route_speed: float = 400.0
    route_width: float = 85.0
    #: The longest displacement between bins that pair models hold, in places along an axis.
    reach: int = 10
    #: Chance of staying in a step of a walk on the grid.
    walk_stay: float = 0.5


@dataclass(frozen=True)
class Event:
    """ll: (time, place) log likelihoods; centres: (place, 2); steps: seconds between bin centres."""

    ll: np.ndarray
    centres: np.ndarray
    steps: np.ndarray
    dt: float
    motion: Motion
    goals: np.ndarray | None = None
    transitions: np.ndarray | None = None
    #: Matrices by what they depend on, shared by all events of a task; bins repeat few step lengths.
    made: dict | None = None
    #: What kernels found for this event, for those that are made of others.
    done: dict | None = None
    #: Places of each bin that pruned models keep, where they were chosen before.
    support: tuple | None = None

    def keep(self, key: tuple, make: Callable[[], np.ndarray]) -> np.ndarray:
        """Made once a task; all is dropped before the whole grows beyond MADE bytes."""
        if self.made is None:
            return make()
        if key not in self.made:
            new = make()
            size = sum(x.nbytes for x in (new if isinstance(new, tuple) else (new,)))
            if self.made.get("bytes", 0) + size > MADE:
                self.made.clear()
            self.made["bytes"] = self.made.get("bytes", 0) + size
            self.made[key] = new
        return self.made[key]

    def run(self, kernel: Callable) -> tuple[float, np.ndarray]:
        if self.done is None:
            return kernel(self)
        if kernel not in self.done:
            self.done[kernel] = kernel(self)
        return self.done[kernel]

    def reverse(self) -> Event:
        """The same bins the other way round; what kernels find there is kept too."""
        back = None if self.done is None else self.done.setdefault("reverse", {})
        return Event(self.ll[::-1], self.centres, self.steps[::-1], self.dt, self.motion, self.goals, self.transitions, self.made, back, self.support and self.support[::-1])

    def likeliest(self, k: int) -> list[np.ndarray]:
        """The places of each bin that are kept: those chosen before, or the k likeliest, ties to smaller ones; none where k is 0 means all."""
        if self.support is not None:
            return [np.asarray(x, np.int64) for x in self.support]
        k = min(k, self.ll.shape[1]) if k > 0 else self.ll.shape[1]
        return list(np.argsort(-self.ll, 1, kind="stable")[:, :k])

    def places(self) -> tuple[np.ndarray, float]:
        """Whole coordinates of the places on their lattice, and its unit."""
        low = self.centres.min(0)
        gaps = np.diff(np.unique(np.concatenate([np.round(np.unique(self.centres[:, k]) - low[k], 9) for k in (0, 1)])))
        unit = float(gaps[gaps > 0].min()) if (gaps > 0).any() else 1.0
        return np.round((self.centres - low) / unit).astype(np.int64), unit


#: Bytes of matrices that a task keeps, and entries of a table of triples of places, at most.
MADE, TRIPLES = 256 << 20, 1 << 21


def lse(x: np.ndarray, axis=None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return out.reshape(()) if axis is None else np.squeeze(out, axis)


def gaussian(centres: np.ndarray, targets: np.ndarray, sigma: float, truncate: float) -> np.ndarray:
    """Probability of each place (row) from a normal law round each target (column); beyond
    `truncate` deviations nothing, and if that leaves nothing, all on the nearest place."""
    d2 = ((centres[:, None, :] - targets[None, :, :]) ** 2).sum(-1)
    p = np.where(d2 <= (truncate * sigma) ** 2, np.exp(-0.5 * d2 / sigma**2), 0.0)
    none = p.sum(0) <= 0
    if none.any():
        p[np.argmin(d2[:, none], axis=0), np.flatnonzero(none)] = 1.0
    return p / p.sum(0, keepdims=True)


def forward(ll: np.ndarray, start: np.ndarray, step: Callable[[int, np.ndarray], np.ndarray]) -> tuple[float, np.ndarray]:
    """Log evidence and filtered posteriors; `step(k, p)` moves a distribution over step k."""
    total, p, out = 0.0, start, []
    for t in range(len(ll)):
        if t:
            p = step(t - 1, p)
        top = ll[t].max()
        if not np.isfinite(top):
            return float("-inf"), np.full_like(ll, 1 / ll.shape[1])
        p = p * np.exp(ll[t] - top).reshape((1,) * (p.ndim - 1) + (-1,))
        mass = p.sum()
        if mass <= 0:
            return float("-inf"), np.full_like(ll, 1 / ll.shape[1])
        total += float(np.log(mass) + top)
        p = p / mass
        out.append(p.reshape(-1, ll.shape[1]).sum(0))
    return total, np.array(out)


def law_of(logs: np.ndarray) -> np.ndarray:
    """Each row as a law of places, the even one where no place is possible."""
    whole = lse(logs, 1)[:, None]
    return np.exp(np.where(np.isfinite(whole), logs - np.where(np.isfinite(whole), whole, 0), -np.log(logs.shape[1])))


def random(e: Event):
    """Every bin anywhere, at even odds: no memory. A bin without a possible place leaves no evidence and the even law."""
    return float((lse(e.ll, 1) - np.log(e.ll.shape[1])).sum()), law_of(e.ll)


def stationary(e: Event):
    """One unknown place throughout; the even law from the bin on at which none is left."""
    s = np.cumsum(e.ll, 0)
    return float(lse(s[-1]) - np.log(e.ll.shape[1])), law_of(s)


def _even(e: Event) -> np.ndarray:
    return np.full(e.ll.shape[1], 1 / e.ll.shape[1])


def _steps(e: Event, sigma: float) -> list[np.ndarray]:
    return [e.keep(("step", sigma, round(float(s), 9)), lambda s=s: gaussian(e.centres, e.centres, sigma * max(s, 1e-12) ** 0.5, e.motion.truncate)) for s in e.steps]


def diffusion(e: Event):
    moves = _steps(e, e.motion.diffusion)
    return forward(e.ll, _even(e), lambda k, p: moves[k] @ p)


def empirical(e: Event):
    """Steps by a fitted transition matrix. Without one no path has a probability; a single bin needs none."""
    if e.transitions is None and len(e.ll) > 1:
        return float("-inf"), np.full_like(e.ll, 1 / e.ll.shape[1])
    return forward(e.ll, _even(e), lambda k, p: e.transitions @ p)


def switching(n: int, step: float, motion: Motion) -> np.ndarray:
    """Mode changes over a step: a fixed stickiness, or a continuous-time chain where a time constant is set."""
    if motion.switch_tau <= 0:
        stay = motion.stickiness
    else:  # the matrix exponential of an even exchange of n modes
        stay = 1 / n + (1 - 1 / n) * np.exp(-step / motion.switch_tau * n / (n - 1))
    out = np.full((n, n), (1 - stay) / (n - 1))
    np.fill_diagonal(out, stay)
    return out


def first_order_imm(e: Event):
    """Stationary, diffusing and fragmented modes that switch; evenly likely at the start."""
    b, still, moves = e.ll.shape[1], _steps(e, e.motion.stationary), _steps(e, e.motion.diffusion)

    def step(k, p):
        p = switching(3, e.steps[k], e.motion) @ p
        return np.stack((still[k] @ p[0], moves[k] @ p[1], np.full(b, p[2].sum() / b)))

    return forward(e.ll, np.full((3, b), 1 / (3 * b)), step)


def _decay(e: Event, k: int) -> float:
    m = e.motion
    d = np.exp(-e.steps[k] / m.decay_tau) if m.decay_tau > 0 else min(m.decay, 1.0) ** (e.steps[k] / e.dt)
    return d * (e.steps[k] / e.steps[k - 1] if k else 1.0)


class Pairs:
    """Pairs of places (now, how it was reached) within a reach: the state of second-order models.

    On a lattice a pair is a place and a displacement, and where the next displacement may
    fall depends on the last one alone, but for the borders. So a step is one product of
    (place, displacement) with (displacement, displacement), memory is places x
    displacements, and no law of triples is ever made. With a reach over the whole grid the
    model is the dense one.
    """

    def __init__(self, e: Event):
        at, self.unit = e.places()
        span = at.max(0)
        rx, ry = np.minimum(span, e.motion.reach)
        self.d = np.stack(np.meshgrid(np.arange(-rx, rx + 1), np.arange(-ry, ry + 1), indexing="ij"), -1).reshape(-1, 2)
        table = np.full((span[0] + 2 * rx + 1, span[1] + 2 * ry + 1), -1)
        table[at[:, 0] + rx, at[:, 1] + ry] = np.arange(len(at))
        self.to = table[at[:, None, 0] + rx + self.d[None, :, 0], at[:, None, 1] + ry + self.d[None, :, 1]]
        self.inside = self.to >= 0
        n = len(self.d)
        self.source = np.flatnonzero(self.inside)
        self.target = self.to.ravel()[self.source] * n + self.source % n
        self.still = int(np.flatnonzero((self.d == 0).all(1))[0])

    def law(self, drift: float, sigma: float, truncate: float) -> tuple[np.ndarray, np.ndarray]:
        """Weights (next, last displacement) of a truncated normal law round drift * last, and what they add up to from each pair."""
        gap = ((self.d[:, None, :] - drift * self.d[None, :, :]) ** 2).sum(-1) * self.unit**2
        w = np.where(gap <= (truncate * sigma) ** 2, np.exp(-0.5 * gap / sigma**2), 0.0)
        return w, self.inside.astype(float) @ w

    def nearest(self, drift: float, places: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The displacement nearest to drift * last that stays on the grid, for pairs from which the law leaves none."""
        gap = ((self.d[None, :, :] - drift * self.d[last][:, None, :]) ** 2).sum(-1).astype(float)
        gap[~self.inside[places]] = np.inf
        return gap.argmin(1)

    def move(self, p: np.ndarray, drift: float, law: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Pairs after a step, from pairs (place, displacement)."""
        w, total = law
        none = (total <= 0) & (p > 0)
        flow = np.divide(p, total, out=np.zeros_like(p), where=total > 0) @ w.T
        if none.any():
            at, last = np.nonzero(none)
            np.add.at(flow, (at, self.nearest(drift, at, last)), p[none])
        return self.land(flow)

    def land(self, flow: np.ndarray) -> np.ndarray:
        """From (place, displacement to come) to (place reached, displacement); what leaves the grid is not there."""
        out = np.zeros(flow.size)
        out[self.target] = flow.ravel()[self.source]
        return out.reshape(flow.shape)

    def enter(self, p: np.ndarray, law: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Pairs after a first step, drawn round each place."""
        w, total = law
        return self.land((p / total[:, self.still])[:, None] * w[None, :, self.still])


def _pairs(e: Event) -> Pairs:
    if e.made is None:
        return Pairs(e)
    if ("pairs", len(e.centres)) not in e.made:
        e.made["pairs", len(e.centres)] = Pairs(e)
    return e.made["pairs", len(e.centres)]


def _law(e: Event, pairs: Pairs, k: int, first: bool) -> tuple[float, tuple[np.ndarray, np.ndarray]]:
    drift, sigma = 1.0 if first else float(_decay(e, k)), e.motion.momentum * float(max(e.steps[k], 1e-12)) ** 0.5
    return drift, e.keep(("law", first, round(sigma, 9), round(drift, 9), len(e.centres)), lambda: pairs.law(drift, sigma, e.motion.truncate))


def momentum_exact(e: Event):
    """A second-order chain on pairs: the next place lies round now + decay * (now - before)."""
    if len(e.ll) == 1:
        return random(e)
    pairs = _pairs(e)
    total, p, out = 0.0, _even(e), []
    for t in range(len(e.ll)):
        if t:
            drift, law = _law(e, pairs, t - 1, t == 1)
            p = pairs.enter(p, law) if t == 1 else pairs.move(p, drift, law)
        top = e.ll[t].max()
        if not np.isfinite(top):
            return float("-inf"), np.full_like(e.ll, 1 / e.ll.shape[1])
        seen = np.exp(e.ll[t] - top)
        p = p * (seen if t == 0 else seen[:, None])
        mass = p.sum()
        if mass <= 0:
            return float("-inf"), np.full_like(e.ll, 1 / e.ll.shape[1])
        total += float(np.log(mass) + top)
        p = p / mass
        out.append(p if t == 0 else p.sum(1))
    return total, np.array(out)


def pruned(kernel):
    """A kernel on the likeliest places of each bin only: a lower bound of its evidence.

    Laws stay normalised over the whole grid. A bin alone has no path to prune.
    """
    def run(e: Event):
        if len(e.ll) == 1:
            return random(e)
        if e.support is None and not 0 < e.motion.top_k < e.ll.shape[1]:
            return e.run(kernel)  # nothing is pruned
        kept = np.full_like(e.ll, -np.inf)
        for t, places in enumerate(e.likeliest(e.motion.top_k)):
            kept[t, places] = e.ll[t, places]
        return kernel(Event(kept, e.centres, e.steps, e.dt, e.motion, e.goals, e.transitions, e.made))
    return run


momentum_pruned = pruned(momentum_exact)


def imm_pruned(e: Event):
    """All four modes on the likeliest places of each bin."""
    return pruned(trajectory_imm)(e)


def trajectory_imm(e: Event, stay: float | None = None, start: float = 0.25, enter: float | None = None):
    """Stationary, diffusing, fragmented and momentum modes that switch.

    The first three hold a distribution over places, momentum one over pairs of places.
    Entering momentum draws the next place by diffusion; leaving it forgets the place before.
    `start` is momentum's share at the outset, the other modes sharing the rest, and
    `enter` the chance of a switch into momentum, where other switches are split evenly.
    """
    b, n = e.ll.shape[1], 4
    still, moves, pairs = _steps(e, e.motion.stationary), _steps(e, e.motion.diffusion), _pairs(e)

    def changes(k):
        p = switching(n, e.steps[k], e.motion)
        if stay is not None:
            p = np.full((n, n), (1 - stay) / (n - 1))
            np.fill_diagonal(p, stay)
        if enter is not None:
            p[3, :3], p[:3, :3] = enter, p[:3, :3] * (1 - enter) / p[:3, :3].sum(0)
        return p

    share = np.array([(1 - start) / 3] * 3 + [start])
    total, flat, held, out = 0.0, share[:, None] * _even(e)[None, :], None, []
    for t in range(len(e.ll)):
        if t:
            k, p = t - 1, changes(t - 1)
            new = np.stack((still[k] @ (p[0] @ flat), moves[k] @ (p[1] @ flat), np.full(b, (p[2] @ flat).sum() / b)))
            # pairs entered from the first three modes (or at the outset), and pairs that go on
            fresh = (p[3, :3] @ flat[:3]) + (p[3, 3] * flat[3] if held is None else 0)
            now = pairs.enter(fresh, _law(e, pairs, k, True)[1])
            if held is not None:
                drift, law = _law(e, pairs, k, False)
                now = now + p[3, 3] * pairs.move(held, drift, law)
            held = now
            flat = np.concatenate((new, held.sum(1)[None, :]))
        top = e.ll[t].max()
        if not np.isfinite(top):
            return float("-inf"), np.full_like(e.ll, 1 / b)
        seen = np.exp(e.ll[t] - top)
        flat = flat * seen
        mass = flat.sum()
        if mass <= 0:
            return float("-inf"), np.full_like(e.ll, 1 / b)
        total += float(np.log(mass) + top)
        flat = flat / mass
        held = None if held is None else held * seen[:, None] / mass
        out.append(flat.sum(0))
    return total, np.array(out)


def candidate_pairs(modes: tuple[str, ...]):
    """A candidate model: pairs of the likeliest places of two bins in a row, under one kind of motion or several that switch.

    Laws are normalised over all places, so the evidence is a lower bound; widths are those
    of a bin, whatever its length. Every mode holds pairs, also those that forget the place before.
    """
    def run(e: Event):
        if len(e.ll) == 1:
            return random(e)
        m, b, n, at = e.motion, e.ll.shape[1], len(modes), e.likeliest(e.motion.candidate_k)
        change = np.full((n, n), (1 - m.candidate_stickiness) / max(n - 1, 1))
        np.fill_diagonal(change, m.candidate_stickiness if n > 1 else 1.0)
        width = {"stationary": m.candidate_still, "diffusion": m.candidate_width, "momentum": m.candidate_width}

        def law(points: np.ndarray, to: np.ndarray, sigma: float) -> np.ndarray:
            logs = -0.5 * ((points[..., None, :] - e.centres) ** 2).sum(-1) / sigma**2
            return np.exp(logs[..., to] - lse(logs, -1)[..., None])

        def step_law(t: int, sigma: float) -> np.ndarray:
            every = np.arange(b)
            return e.keep(("candidate", sigma, b), lambda: law(e.centres, every, sigma))[np.ix_(at[t - 1], at[t])]

        def turn_law(t: int, sigma: float) -> np.ndarray:
            """[before, last, now]; on small grids one table of all triples serves every bin."""
            if b**3 > TRIPLES:
                last = e.centres[at[t - 1]][None]
                return law(last + m.candidate_decay * (last - e.centres[at[t - 2]][:, None]), at[t], sigma)
            c = e.centres
            return e.keep(("turning", sigma, m.candidate_decay, b), lambda: law(c[None] + m.candidate_decay * (c[None] - c[:, None]), np.arange(b), sigma))[np.ix_(at[t - 2], at[t - 1], at[t])]

        def go(mode: str, p: np.ndarray | None, t: int) -> np.ndarray:
            """Pairs (bin t - 1, bin t) from pairs (bin t - 2, bin t - 1), or from even odds at the outset."""
            sums = np.exp(e.ll[0, at[0]] - tops[0]) / b if p is None else p.sum(0)
            if mode == "jump":
                return np.repeat(sums[:, None] / b, len(at[t]), 1)
            if mode != "momentum" or p is None:
                return sums[:, None] * step_law(t, width[mode])
            return np.einsum("ij,ijl->jl", p, turn_law(t, width[mode]))

        tops = np.array([e.ll[t, at[t]].max() if len(at[t]) else -np.inf for t in range(len(e.ll))])
        none = float("-inf"), np.full_like(e.ll, 1 / b)
        if not np.isfinite(tops).all():
            return none
        total, p, out = float(tops[0]), None, np.zeros_like(e.ll)
        for t in range(1, len(e.ll)):
            before = [None] * n if p is None else np.einsum("dm,mij->dij", change, p)
            p = np.stack([go(mode, before[i], t) for i, mode in enumerate(modes)]) * np.exp(e.ll[t, at[t]] - tops[t]) / (n if t == 1 else 1)
            mass = p.sum()
            if mass <= 0:
                return none
            total += float(np.log(mass) + tops[t])
            p = p / mass
            if t == 1:
                out[0, at[0]] = p.sum((0, 2))
            out[t, at[t]] = p.sum((0, 1))
        return total, out

    return run


def well_route(e: Event):
    """A mixture over the routes from each goal to each other one: drift towards a target that moves along the route as the event goes on.

    The place that all paths are drawn to lies on the route where the share of time that has passed puts it.
    """
    goals, m = e.centres[[0, -1]] if e.goals is None or len(e.goals) < 2 else e.goals, e.motion
    start, end = (np.array(x) for x in zip(*[(a, b) for i, a in enumerate(goals) for j, b in enumerate(goals) if i != j]))
    share = np.cumsum(e.steps) / e.steps.sum() if len(e.steps) else e.steps

    def step(k, p):  # p: (route, place)
        s = max(float(e.steps[k]), 1e-12)
        gap = (start + share[k] * (end - start))[:, None, :] - e.centres[None]
        far = np.sqrt((gap**2).sum(-1, keepdims=True))
        to = e.centres[None] + gap * np.minimum(1.0, m.route_speed * s / np.maximum(far, 1e-12))
        moves = gaussian(e.centres, to.reshape(-1, 2), m.route_width * s**0.5, 4.0).reshape(len(e.centres), *p.shape)
        return np.einsum("xry,ry->rx", moves, p)

    return forward(e.ll, np.full((len(start), e.ll.shape[1]), 1 / (len(start) * e.ll.shape[1])), step)


def mixed(found: list[tuple[float, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Evidence and posteriors of parts at even odds."""
    logs = np.array([f[0] for f in found])
    w = np.exp(logs - lse(logs)) if np.isfinite(logs).any() else np.full(len(logs), 1 / len(logs))
    return float(lse(logs) - np.log(len(logs))), np.tensordot(w, np.array([f[1] for f in found]), 1)


def lattice(grid_step: float, radius: int = 2) -> np.ndarray:
    """Displacements of up to `radius` steps along each axis."""
    k = np.arange(-radius, radius + 1) * grid_step
    return np.stack(np.meshgrid(k, k, indexing="ij"), -1).reshape(-1, 2)


def displacement_momentum(e: Event, radius: int = 2):
    """Places with a displacement of their own: d follows decay * d before, and the place lies round place + d."""
    gaps = np.abs(e.centres[:, None, :] - e.centres[None, :, :]).max(-1)
    unit = float(gaps[gaps > 0].min()) if (gaps > 0).any() else 1.0
    d, sigma = lattice(unit, radius), 0.5 * unit
    prior = gaussian(d, np.zeros((1, 2)), e.motion.momentum * max(e.dt, 1e-12) ** 0.5, np.inf)[:, 0]
    shifts = e.keep(("shift", unit, radius), lambda: np.stack([gaussian(e.centres, e.centres + v, sigma, e.motion.truncate) for v in d]))

    def step(k, p):
        if k:
            turn = e.keep(("turn", unit, radius, round(float(e.steps[k]), 9), round(float(_decay(e, k)), 9)), lambda: gaussian(d, _decay(e, k) * d, e.motion.momentum * e.steps[k] ** 0.5, np.inf))
            p = turn @ p
        else:
            p = prior[:, None] * p.sum(0)[None, :]
        return np.einsum("dxy,dy->dx", shifts, p)

    return forward(e.ll, prior[:, None] * _even(e)[None, :], step)


def goal(e: Event):
    """A mixture over goals: drift toward one, at most as far as it is, and diffusion round that."""
    goals = e.centres if e.goals is None or not len(e.goals) else e.goals
    found = []
    for g in goals:
        gap = g[None, :] - e.centres
        far = np.sqrt((gap**2).sum(1, keepdims=True))
        moves = [e.keep(("goal", *map(float, g), round(float(s), 9)), lambda s=s, gap=gap, far=far: gaussian(e.centres, e.centres + gap * np.minimum(1.0, e.motion.goal_speed * s / np.maximum(far, 1e-12)), e.motion.diffusion * max(s, 1e-12) ** 0.5, e.motion.truncate)) for s in e.steps]
        found.append(forward(e.ll, _even(e), lambda k, p, moves=moves: moves[k] @ p))
    return mixed(found)


def displacement_imm(e: Event, radius: int = 2):
    """Stationary, diffusing, displaced and fragmented modes that switch, all with a displacement of their own.

    Where the mode is displaced, d follows decay * d before and the place lies round place +
    d; in the others d is drawn anew from its prior, as nothing ties it to the path.
    """
    gaps = np.abs(e.centres[:, None, :] - e.centres[None, :, :]).max(-1)
    unit = float(gaps[gaps > 0].min()) if (gaps > 0).any() else 1.0
    d, sigma, b = lattice(unit, radius), 0.5 * unit, e.ll.shape[1]
    prior = gaussian(d, np.zeros((1, 2)), e.motion.momentum * max(e.dt, 1e-12) ** 0.5, np.inf)[:, 0]
    shifts = e.keep(("shift", unit, radius, b), lambda: np.stack([gaussian(e.centres, e.centres + v, sigma, e.motion.truncate) for v in d]))
    still, moves = _steps(e, e.motion.stationary), _steps(e, e.motion.diffusion)

    def step(k, p):  # p: (mode, displacement, place)
        q = np.einsum("ij,jdx->idx", switching(4, e.steps[k], e.motion), p)
        turn = e.keep(("turn", unit, radius, round(float(e.steps[k]), 9), round(float(_decay(e, k)), 9)), lambda: gaussian(d, _decay(e, k) * d, e.motion.momentum * e.steps[k] ** 0.5, np.inf))
        anew = [prior[:, None] * (m @ q[i].sum(0))[None, :] for i, m in ((0, still[k]), (1, moves[k]))]
        return np.stack((*anew, np.einsum("dxy,dy->dx", shifts, turn @ q[2]), np.full_like(q[3], 1 / b) * prior[:, None] * q[3].sum()))

    return forward(e.ll, np.broadcast_to(prior[None, :, None] * _even(e)[None, None, :] / 4, (4, len(d), b)), step)


def walk(e: Event):
    """A walk on the grid: each step stays or goes to one of the places beside, at even odds; `dt` is a step."""
    at, _ = e.places()

    def make():
        beside = (np.abs(at[:, None, :] - at[None, :, :]).sum(-1) == 1).astype(float)
        go = beside / np.maximum(beside.sum(0, keepdims=True), 1)
        return np.where(beside.sum(0)[None, :] > 0, e.motion.walk_stay * np.eye(len(at)) + (1 - e.motion.walk_stay) * go, np.eye(len(at)))

    moves = [e.keep(("walk", int(max(1, round(s / e.dt))), len(at)), lambda s=s: np.linalg.matrix_power(make(), int(max(1, round(s / e.dt))))) for s in e.steps]
    return forward(e.ll, _even(e), lambda k, p: moves[k] @ p)


def path_lengths(e: Event) -> np.ndarray:
    """The shortest way between places over the places beside them, corners too; without a way, infinite."""
    at, unit = e.places()
    near = np.abs(at[:, None, :] - at[None, :, :])
    out = np.where(near.max(-1) <= 1, np.sqrt((near**2).sum(-1)) * unit, np.inf)
    for k in range(len(at)):
        np.minimum(out, out[:, k, None] + out[None, k, :], out=out)
    return out


def geodesic(e: Event):
    """Diffusion along the places that are there: a normal law of the shortest way, not of the straight line."""
    far = e.keep(("ways", len(e.centres), float(e.centres.sum())), lambda: path_lengths(e))

    def make(s):
        sigma = e.motion.diffusion * max(s, 1e-12) ** 0.5
        p = np.where(far <= e.motion.truncate * sigma, np.exp(-0.5 * np.minimum(far / sigma, 1e3) ** 2), 0.0)
        return p / p.sum(0, keepdims=True)

    moves = [e.keep(("geodesic", len(e.centres), round(float(s), 9)), lambda s=s: make(s)) for s in e.steps]
    return forward(e.ll, _even(e), lambda k, p: moves[k] @ p)


def reversed_of(kernel):
    def run(e: Event):
        log, post = e.reverse().run(kernel)
        return log, post[::-1]
    return run


def bidirectional(kernel):
    """Forward and reversed runs at even odds."""
    def run(e: Event):
        (a, p), (b, q) = e.run(kernel), e.reverse().run(kernel)
        both = float(np.logaddexp(a, b) - np.log(2))
        w = np.exp(a - both - np.log(2)) if np.isfinite(both) else 0.5
        return both, w * p + (1 - w) * q[::-1]
    return run


def forward_backward(ll: np.ndarray, start: np.ndarray, moves: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Log evidence and smoothed posteriors (time, state) of a chain; moves[k] is [to, from] over step k.

    Where no path is possible the evidence is -inf and every law the even one.
    """
    top = ll.max(1, keepdims=True)
    seen = np.exp(ll - np.where(np.isfinite(top), top, 0))
    total, p, filtered = 0.0, start, []
    for t in range(len(ll)):
        p = (moves[t - 1] @ p if t else p) * seen[t]
        if not np.isfinite(top[t, 0]) or p.sum() <= 0:
            return float("-inf"), np.full_like(ll, 1 / ll.shape[1])
        total += float(np.log(p.sum()) + top[t, 0])
        p = p / p.sum()
        filtered.append(p)
    back, out = np.ones(ll.shape[1]), [filtered[-1]]
    for t in range(len(ll) - 2, -1, -1):
        back = moves[t].T @ (seen[t + 1] * back)
        back = back / back.max()
        out.append(filtered[t] * back / (filtered[t] * back).sum())
    return total, np.array(out[::-1])


def smoothed_diffusion(e: Event):
    return forward_backward(e.ll, _even(e), _steps(e, e.motion.diffusion))


def smoothed_first_order_imm(e: Event):
    """Places given the whole event; the three modes stand as one long state."""
    b, still, moves = e.ll.shape[1], _steps(e, e.motion.stationary), _steps(e, e.motion.diffusion)
    joint = []
    for k in range(len(e.ll) - 1):
        s = switching(3, e.steps[k], e.motion)
        joint.append(np.block([[s[i, j] * m for j in range(3)] for i, m in enumerate((still[k], moves[k], np.full((b, b), 1 / b)))]))
    total, p = forward_backward(np.tile(e.ll, (1, 3)), np.full(3 * b, 1 / (3 * b)), joint)
    return total, p.reshape(len(p), 3, b).sum(1)


def smoothed_stationary(e: Event):
    """One place throughout, so that every bin knows what the whole event says."""
    log, p = stationary(e)
    return log, np.repeat(p[-1:], len(p), 0)


#: Models whose posterior of every bin, given the whole event, can be had.
SMOOTHED = {"random": random, "stationary": smoothed_stationary, "state-space-diffusion": smoothed_diffusion, "state-space-first-order-imm": smoothed_first_order_imm}


#: name -> (kernel, support of its evidence)
REGISTRY: dict[str, tuple[Callable, str]] = {}


def register_model(name: str, kernel: Callable, support: str = EXACT) -> None:
    REGISTRY[name] = (kernel, support)


for _name, _kernel, _support in (
    ("random", random, EXACT), ("stationary", stationary, EXACT), ("state-space-diffusion", diffusion, EXACT),
    ("state-space-first-order-imm", first_order_imm, EXACT), ("state-space-momentum", momentum_pruned, TRUNCATED), ("state-space-momentum-exact", momentum_exact, EXACT),
    ("displacement-momentum", displacement_momentum, EXACT), ("trajectory-imm-exact", trajectory_imm, EXACT), ("trajectory-imm-persistent", lambda e: trajectory_imm(e, stay=0.985), EXACT),
    ("trajectory-imm-anchored", lambda e: trajectory_imm(e, start=0.05, enter=0.005), EXACT), ("trajectory-imm-low-leak", lambda e: trajectory_imm(e, start=0.01, enter=0.001), EXACT),
    ("goal", goal, EXACT), ("empirical-transition", empirical, EXACT), ("state-space-imm", imm_pruned, TRUNCATED), ("displacement-imm", displacement_imm, EXACT),
    *((f"candidate-{mode}", candidate_pairs((mode,)), TRUNCATED) for mode in ("stationary", "diffusion", "momentum", "jump")), ("candidate-imm", candidate_pairs(("stationary", "diffusion", "momentum", "jump")), TRUNCATED), ("well-route", well_route, EXACT),
    ("grid-walk", walk, EXACT), ("geodesic-diffusion", geodesic, EXACT), ("reverse-diffusion", reversed_of(diffusion), EXACT),
    ("reverse-momentum-exact", reversed_of(momentum_exact), EXACT), ("bidirectional-diffusion", bidirectional(diffusion), EXACT), ("bidirectional-momentum-exact", bidirectional(momentum_exact), EXACT),
):
    register_model(_name, _kernel, _support)

#: Other names of a model. They may be asked for, but the registry holds each model once, so that no report over it counts one twice.
ALIASES = {"state-space-fragmented": "random"}


def model_of(name: str) -> tuple[Callable, str]:
    return REGISTRY[ALIASES.get(name, name)]


#: Models that follow a fitted matrix; events whose session has none have no evidence under them and are not scored.
FITTED = ("empirical-transition",)

SCORE_SCHEMA = "session string, event_index long, model string, evidence_support string, log_evidence double, n_time int, n_spikes long, terminal array<double>"


@dataclass(frozen=True)
class Grammar:
    """Which kernels explain segments, how long those tend to be, and what a change costs."""

    modes: tuple[str, ...] = ("stationary", "state-space-diffusion", "state-space-fragmented")
    mean_bins: tuple[float, ...] = (4.0, 6.0, 3.0)
    log_sd: float = 0.75
    penalty: float = 1.0
    shortest: int = 1
    most_segments: int = 4


def prefixes_of(model: str, e: Event) -> np.ndarray | None:
    """The evidence of the first 1, 2, ... bins, by one pass; none for models that have no such pass here."""
    if model in ("random", "state-space-fragmented"):
        return np.cumsum(lse(e.ll, 1) - np.log(e.ll.shape[1]))
    if model == "stationary":
        return lse(np.cumsum(e.ll, 0), 1) - np.log(e.ll.shape[1])
    if model != "state-space-diffusion":
        return None
    moves, p, out, total = _steps(e, e.motion.diffusion), _even(e), np.full(len(e.ll), -np.inf), 0.0
    for t in range(len(e.ll)):
        top = e.ll[t].max()
        if not np.isfinite(top):
            break  # no path from here on
        p = (moves[t - 1] @ p if t else p) * np.exp(e.ll[t] - top)
        if p.sum() <= 0:
            break
        total += float(np.log(p.sum()) + top)
        p, out[t] = p / p.sum(), total
    return out


def causal_prefixes(emissions: DataFrame, grid: Grid, models: list[str], motion: Motion = Motion(), dt: float = 1.0, shortest: int = 1) -> DataFrame:
    """One row per event, model and number of first bins: the evidence so far. One pass an event and model."""
    unknown = [m for m in models if m not in ("random", "stationary", "state-space-fragmented", "state-space-diffusion")]
    if unknown:
        raise ValueError(f"no causal pass of: {unknown}")
    centres, shape = centres_of(grid), "session string, event_index long, model string, bins int, n_spikes long, log_evidence double"

    def run(batches):
        made: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                bins = row["bins"]
                dur, n = np.array([x["bin_dur"] for x in bins], float), np.cumsum([x["n_spikes"] for x in bins]).tolist()
                e = Event(np.array([x["ll"] for x in bins], float), centres, (dur[1:] + dur[:-1]) / 2, dt, motion, made=made)
                for m in models:
                    out += [(row["session"], row["event_index"], m, t + 1, n[t], float(v)) for t, v in enumerate(prefixes_of(m, e)) if t + 1 >= shortest]
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in shape.split(", ")])

    return by_event(emissions).mapInArrow(run, shape)


def best_segments(score: np.ndarray, grammar: Grammar) -> tuple[float, list[tuple[int, int, int]]]:
    """The best cut of all bins into segments (start, end, mode) without equal neighbours in mode.

    score[start, end, mode] holds evidence plus duration prior. Ties go to fewer segments,
    then to the earlier start and the earlier mode.
    """
    n, m = score.shape[1] - 1, score.shape[2]
    best = np.full((grammar.most_segments + 1, n + 1, m), -np.inf)
    back: dict[tuple[int, int, int], tuple[int, int]] = {}
    best[1], (best_total, at) = score[0], (-np.inf, None)
    for k in range(1, grammar.most_segments + 1):
        for end in range(1, n + 1) if k > 1 else ():
            for mode in range(m):
                for start in range(1, end):
                    others = best[k - 1, start].copy()
                    others[mode] = -np.inf
                    before = int(np.argmax(others))
                    v = others[before] + score[start, end, mode] - grammar.penalty
                    if v > best[k, end, mode]:
                        best[k, end, mode], back[k, end, mode] = v, (start, before)
        top = int(np.argmax(best[k, n]))
        if best[k, n, top] > best_total:
            best_total, at = float(best[k, n, top]), (k, n, top)
    out = []
    while at:
        k, end, mode = at
        start, before = back.get(at, (0, -1))
        out.append((start, end, mode))
        at = (k - 1, start, before) if k > 1 else None
    return best_total, out[::-1]


def segment_grammar(emissions: DataFrame, grid: Grid, grammar: Grammar = Grammar(), motion: Motion = Motion(), dt: float = 1.0) -> DataFrame:
    """One row per segment of each event's best mode sequence."""
    kernels, centres, means = [model_of(m)[0] for m in grammar.modes], centres_of(grid), np.log(grammar.mean_bins)

    def run(batches):
        made: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ll, dur = np.array([x["ll"] for x in row["bins"]], float), np.array([x["bin_dur"] for x in row["bins"]], float)
                n = len(ll)
                steps, score = (dur[1:] + dur[:-1]) / 2, np.full((n, n + 1, len(kernels)), -np.inf)
                for a in range(n):
                    whole = Event(ll[a:], centres, steps[a:], dt, motion, made=made)
                    got = [prefixes_of(m, whole) for m in grammar.modes]  # one pass from each start scores all its ends
                    for z in range(a + grammar.shortest, n + 1):
                        if all(g is not None for g in got):
                            found = [g[z - a - 1] for g in got]
                        else:
                            e = Event(ll[a:z], centres, steps[a : z - 1], dt, motion, made=made)
                            found = [k(e)[0] if g is None else g[z - a - 1] for k, g in zip(kernels, got)]
                        score[a, z] = found - 0.5 * ((np.log(z - a) - means) / grammar.log_sd) ** 2
                total, found = best_segments(score, grammar)
                out += [(row["session"], row["event_index"], i, grammar.modes[mode], a, z, float(dur[a:z].sum()), total) for i, (a, z, mode) in enumerate(found)]
            cols = list(zip(*out)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["session", "event_index", "segment_index", "mode", "start_bin", "end_bin", "duration_s", "grammar_score"])

    return by_event(emissions).mapInArrow(run, "session string, event_index long, segment_index int, mode string, start_bin int, end_bin int, duration_s double, grammar_score double")


def by_event(emissions: DataFrame, transitions: DataFrame | None = None) -> DataFrame:
    """One row per event with its few bins in order, over all tasks: small rows, much work, so not to be coalesced.

    With transitions, a session's events are dealt into as many parts as there are tasks, and
    a row without an event, which holds the session's matrix, stands before those of each part.
    Rows of `event_emissions` are what is wanted already.
    """
    if "bins" in emissions.columns:
        if transitions is None:
            return emissions
        emissions = binned(emissions)
    keys, of_bin = event_keys(emissions), ["t_idx", "bin_dur", "n_spikes", "ll", *(["support"] if "support" in emissions.columns else [])]
    tasks = deals(emissions)
    if transitions is not None:
        parts = F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))
        fitted = transitions.groupBy("session").agg(F.collect_list(F.struct("src", "dst", "probability")).alias("_m"))
        fitted = fitted.select("session", F.explode(parts).alias("_part"), F.struct(*[F.col(f"_m.{c}").alias(c) for c in ("src", "dst", "probability")]).alias("matrix"))
        both = emissions.withColumn("_part", F.pmod(F.xxhash64("event_index"), F.lit(tasks))).unionByName(fitted, allowMissingColumns=True)
        bins = F.collect_list(F.when(F.col("matrix").isNull(), F.struct(*of_bin)))
        rows = both.repartition(tasks, "session", "_part").groupBy("session", "_part", "event_index").agg(F.sort_array(bins).alias("bins"), F.first("matrix", ignorenulls=True).alias("matrix"))
        return rows.sortWithinPartitions("session", "_part", F.col("matrix").isNull()).drop("_part")
    rows = emissions if "part" in keys else emissions.repartition(tasks, "session", "event_index")
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*of_bin))).alias("bins"))


def centres_of(grid: Grid) -> np.ndarray:
    ix, iy = np.divmod(np.arange(grid.nx * grid.ny), grid.ny)
    return np.stack((grid.low_x + (ix + 0.5) * grid.size, grid.low_y + (iy + 0.5) * grid.size), 1)


def transition_matrix(src, dst, probability, n: int, teleport: float = 1e-6) -> np.ndarray:
    """[to, from]: places that were never left stay, and any step may jump anywhere with a small chance."""
    out = np.zeros((n, n))
    out[dst, src] = probability
    never = np.flatnonzero(out.sum(0) <= 0)
    out[never, never] = 1.0
    return (1 - teleport) * out + teleport / n


def score_events(emissions: DataFrame, grid: Grid, models: list[str], motion: Motion = Motion(), dt: float = 1.0, goals=None, transitions: DataFrame | None = None, valid: list[int] | None = None, prefix: str = "") -> DataFrame:
    """One row per event and model, from rows (session, event_index, t_idx, bin_dur, n_spikes, ll array).

    An event's few time bins are gathered into one row, and tasks score rows as they come:
    no cost per group, and no group larger than an event. Models made of others share what
    those found. transitions (session, src, dst, probability) are for the models that follow
    a fitted matrix; without one such a model's row has no evidence and says so. With valid,
    a list of places, all others are out of reach. A column `support` of the emissions names
    the places of each bin that pruned models keep. prefix goes before the models' names.
    """
    unknown = [m for m in models if ALIASES.get(m, m) not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    chosen, centres = [(m, *model_of(m)) for m in models], centres_of(grid)
    places = np.arange(len(centres)) if valid is None else np.array(sorted(valid))

    def terminal(p):
        out = np.zeros(len(centres))
        out[places] = p
        return out.tolist()

    within = {b: i for i, b in enumerate(places.tolist())}

    def chosen_places(bins):
        if bins[0].get("support") is None:
            return None
        return tuple([within[b] for b in x["support"] if b in within] for x in bins)

    def run(batches):
        made: dict = {}
        held, matrix = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                bins = row["bins"]
                if row.get("matrix"):
                    held, matrix = row["session"], transition_matrix(**row["matrix"], n=len(centres))[np.ix_(places, places)]
                    continue
                fit = matrix if row["session"] == held else None
                dur = np.array([x["bin_dur"] for x in bins], float)
                e = Event(np.array([x["ll"] for x in bins], float)[:, places], centres[places], (dur[1:] + dur[:-1]) / 2, dt, motion, None if goals is None else np.array(goals, float), fit, made, {}, chosen_places(bins))
                for name, kernel, label in chosen:
                    if name in FITTED and fit is None:
                        out.append((row["session"], row["event_index"], prefix + name, NOT_SCORED, None, len(bins), sum(x["n_spikes"] for x in bins), None))
                        continue
                    log, post = e.run(kernel)
                    if label == TRUNCATED and len(bins) == 1:
                        shown = "degenerate_single_bin"
                    else:  # candidates that cover all places prune nothing
                        whole = e.support is None and motion.top_k >= len(places) and not name.startswith("candidate-")
                        shown = EXACT if label == TRUNCATED and whole else label
                    out.append((row["session"], row["event_index"], prefix + name, shown, log, len(bins), sum(x["n_spikes"] for x in bins), terminal(post[-1])))
            cols = list(zip(*out)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in SCORE_SCHEMA.split(", ")])

    return by_event(emissions, transitions).mapInArrow(run, SCORE_SCHEMA)


def goal_probabilities(emissions: DataFrame, grid: Grid, goals, motion: Motion = Motion(), dt: float = 1.0) -> DataFrame:
    """session, event_index, goal, log_evidence and probability: which goal each event's path drifts to, all being as likely before.

    Goals are numbered as given. Where no goal has a path all stay as likely.
    """
    wanted, centres = np.array(goals, float).reshape(-1, 2), centres_of(grid)
    if not len(wanted):
        raise ValueError("there are no goals")
    shape = "session string, event_index long, goal int, log_evidence double, probability double"

    def run(batches):
        made: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                dur = np.array([x["bin_dur"] for x in row["bins"]], float)
                e = Event(np.array([x["ll"] for x in row["bins"]], float), centres, (dur[1:] + dur[:-1]) / 2, dt, motion, made=made)
                logs = np.array([goal(Event(e.ll, e.centres, e.steps, dt, motion, wanted[g : g + 1], made=made))[0] for g in range(len(wanted))])
                out += [(row["session"], row["event_index"], g, float(logs[g]), float(p)) for g, p in enumerate(law_of(logs[None])[0])]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in shape.split(", ")])

    return by_event(emissions).mapInArrow(run, shape)


def trajectories(emissions: DataFrame, grid: Grid, models: list[str], motion: Motion = Motion(), dt: float = 1.0) -> DataFrame:
    """One row per event, model and time bin: the posterior of places given the whole event, its mean, likeliest place, spread and entropy."""
    unknown = [m for m in models if m not in SMOOTHED]
    if unknown:
        raise ValueError(f"no smoothed posterior of: {unknown}")
    centres = centres_of(grid)
    shape = "session string, event_index long, model string, t_idx int, mean_x double, mean_y double, map_bin int, spread double, entropy double, posterior array<double>"

    def run(batches):
        made: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                bins = row["bins"]
                dur = np.array([x["bin_dur"] for x in bins], float)
                e = Event(np.array([x["ll"] for x in bins], float), centres, (dur[1:] + dur[:-1]) / 2, dt, motion, made=made)
                for name in models:
                    post = SMOOTHED[name](e)[1]
                    mean = post @ centres
                    spread = np.sqrt(np.maximum((post @ (centres**2)).sum(1) - (mean**2).sum(1), 0))
                    entropy = -(post * np.log(np.maximum(post, 1e-300))).sum(1)
                    out += [(row["session"], row["event_index"], name, bins[t]["t_idx"], *map(float, mean[t]), int(post[t].argmax()), float(spread[t]), float(entropy[t]), post[t].tolist()) for t in range(len(bins))]
            cols = list(zip(*out)) or [()] * 10
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in shape.split(", ")])

    return by_event(emissions).mapInArrow(run, shape)


def gathered(rows: DataFrame, places: int) -> DataFrame:
    """Arrays by time bin, as `score_events` takes them, from rows (session, event_index, t_idx, bin_id, bin_dur, n_spikes, ll).

    A place without a row has no likelihood.
    """
    held = F.map_from_entries(F.collect_list(F.struct("bin_id", "ll")))
    g = rows.groupBy("session", "event_index", "t_idx").agg(F.first("bin_dur").alias("bin_dur"), F.max("n_spikes").alias("n_spikes"), held.alias("_m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda b: F.coalesce(F.element_at("_m", b), F.lit(float("-inf"))))
    return g.withColumn("ll", each).drop("_m")


def deals(df: DataFrame) -> int:
    """Tasks that events are dealt over."""
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Adds `part`, so many of each session, and brings the rows of a session's part together.

    What a session has, such as its map, is dealt once to each of its parts, so that no task
    holds a session's events. Rows stay so dealt while they are scored: `event_keys` names the part.
    """
    return rows.withColumn("part", F.pmod(F.xxhash64("event_index"), F.lit(min(tasks, PARTS))).cast("int")).repartition(tasks, "session", "part")


def copied(of_session: DataFrame, tasks: int) -> DataFrame:
    """Rows of sessions, once for each part."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(min(tasks, PARTS) - 1)))
    return of_session.withColumn("part", parts).repartition(tasks, "session", "part")


#: Parts of a session's events, at most.
PARTS = 64


def event_keys(emissions: DataFrame) -> list[str]:
    """What events are grouped by: with the part, where they are dealt by it, so that arrays are not shuffled again."""
    return ["session", *(["part"] if "part" in emissions.columns else []), "event_index"]


def session_maps(rates: DataFrame) -> DataFrame:
    """One row per session: the places in order, the summed rate of each, and of each cell the log rates of these places."""
    places = rates.groupBy("session", "bin_id").agg(F.sum("rate_hz").alias("total")).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("bin_id", "total"))).alias("_p"))
    cells = rates.where("cell_id is not null").groupBy("session", "cell_id").agg(F.map_from_entries(F.collect_list(F.struct("bin_id", F.log("rate_hz").alias("v")))).alias("_r"))
    logs = cells.join(places, "session").select("session", "cell_id", F.transform("_p", lambda p: F.element_at("_r", p["bin_id"])).alias("_r"))
    maps = logs.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("cell_id", "_r"))).alias("_logs"))
    return places.join(maps, "session", "left").select("session", F.transform("_p", lambda p: p["total"]).alias("_total"), "_logs")


def emissions(spikes: DataFrame, events: DataFrame, rates: DataFrame, grid: Grid, dt: float) -> DataFrame:
    """Poisson log likelihood of each time bin's spikes at each place, as one array a bin."""
    return binned(event_emissions(spikes, events, rates, dt))


def binned(of_events: DataFrame) -> DataFrame:
    """Rows of time bins from rows of events."""
    return of_events.select("session", "event_index", F.inline("bins"))


#: Numbers of a table of bins by places that a task makes at once.
AT_ONCE = 1 << 21


def durations(events: DataFrame, dt: float) -> DataFrame:
    """session, event_index, _kind (1) and _dur, the durations of an event's time bins."""
    low = F.col("start")
    n = F.greatest(F.ceil((F.col("end") - low) / dt - 1e-9).cast("int"), F.lit(1))
    dur = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(F.col("end"), low + i * dt + dt) - (low + i * dt))
    return events.select("session", "event_index", F.lit(1).alias("_kind"), dur.alias("_dur"))


def event_emissions(spikes: DataFrame, events: DataFrame, rates: DataFrame, dt: float, beside: DataFrame | None = None) -> DataFrame:
    """The rows of `emissions` gathered by event: session, event_index and bins, an array of t_idx, bin_dur, n_spikes and ll.

    Durations and counts of a session's part come to one task behind the session's map, and
    batches of events are added up as arrays: a bin costs as much as it has cells that fired
    and places, however many spikes it holds, and is shuffled only afterwards, if at all.
    beside (session, matrix) is handed on: a row without an event, which holds the session's
    matrix, then stands before the events of each part.
    """
    tasks, of_event = deals(events), durations(events, dt)
    counts = sums_in_bins(spikes, events, dt, "cell_id").select("session", "event_index", F.lit(1).alias("_kind"), F.col("sums").alias("_f"))
    maps = session_maps(rates).select("session", F.lit(0).alias("_kind"), F.col("_total"), F.map_keys("_logs").alias("_cells"), F.map_values("_logs").alias("_logs"))
    if beside is not None:
        maps = maps.join(beside.select("session", "matrix"), "session", "left")
    maps = maps.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(min(tasks, PARTS) - 1))))
    both = of_event.unionByName(counts, allowMissingColumns=True).withColumn("part", F.pmod(F.xxhash64("event_index"), F.lit(min(tasks, PARTS))).cast("int"))
    both = both.unionByName(maps, allowMissingColumns=True).repartition(tasks, "session", "part")
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("_dur", "_total", "_cells", "_logs", *(["matrix"] if beside is not None else []))]
    rows = both.groupBy("session", "part", "_kind", "event_index").agg(F.flatten(F.collect_list("_f")).alias("_f"), *first).sortWithinPartitions("session", "part", "_kind").drop("part")
    shape = f"session string, event_index {events.schema['event_index'].dataType.simpleString()}, bins array<struct<t_idx: int, bin_dur: double, n_spikes: bigint, ll: array<double>>>"
    with_matrix = beside is not None
    if with_matrix:
        shape += f", matrix {beside.schema['matrix'].dataType.simpleString()}"

    def run(batches):
        held, total, cells, logs = None, None, None, None
        for batch in batches:
            kind, sessions = batch.column("_kind").to_numpy(), np.array(batch.column("session").to_pylist(), object)
            starts = np.flatnonzero(kind == 0)
            for a, b in zip((-1, *starts), (*starts, len(batch))):
                if a >= 0:
                    row = batch.slice(int(a), 1)
                    held, total = sessions[a], row.column("_total").flatten().to_numpy(zero_copy_only=False)
                    cells, logs = row.column("_cells").flatten(), row.column("_logs").flatten()
                    logs = logs.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), len(total))
                    if with_matrix and row.column("matrix").null_count == 0:
                        yield pa.RecordBatch.from_arrays([row.column("session"), row.column("event_index"), pa.nulls(1, BINS), row.column("matrix")], ["session", "event_index", "bins", "matrix"])
                mine = a + 1 + np.flatnonzero(sessions[a + 1 : b] == held) if held is not None else np.zeros(0, int)
                if len(mine):
                    mine = mine[batch.column("_dur").is_valid().to_numpy(zero_copy_only=False)[mine]]
                    yield from _arrays(batch, mine, total, cells, logs, batch.schema.field("matrix").type if with_matrix else None)

    return rows.mapInArrow(run, shape)


BINS = pa.list_(pa.struct([("t_idx", pa.int32()), ("bin_dur", pa.float64()), ("n_spikes", pa.int64()), ("ll", pa.list_(pa.float64()))]))


def _arrays(batch: pa.RecordBatch, rows: np.ndarray, total: np.ndarray, cells: pa.Array, logs: np.ndarray, beside):
    """Emissions of some events of a session, so many at once that their tables stay small."""
    sizes = pc.list_value_length(batch.column("_dur")).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes[rows]) // max(1, AT_ONCE // max(len(total), len(cells), 1))
    for some in np.split(rows, np.flatnonzero(np.diff(group)) + 1):
        part = batch.select(["session", "event_index", "_dur", "_f"]).take(pa.array(some))
        n, of = sizes[some].astype(np.int64), pc.list_value_length(part.column("_f")).to_numpy(zero_copy_only=False)
        dur, flat = part.column("_dur").flatten().to_numpy(zero_copy_only=False), part.column("_f").flatten()
        base = np.cumsum(n) - n
        event = np.repeat(np.arange(len(some)), of)
        cell = pc.index_in(flat.field("cell_id"), value_set=cells.cast(flat.field("cell_id").type))
        t, known = flat.field("t_idx").to_numpy(zero_copy_only=False), cell.is_valid().to_numpy(zero_copy_only=False)
        known &= (t < n[event]) & (len(cells) > 0)
        at = (base[event] + t)[known] * max(len(cells), 1) + cell.fill_null(0).to_numpy(zero_copy_only=False)[known]
        fired = np.bincount(at, weights=flat.field("n").to_numpy(zero_copy_only=False)[known], minlength=len(dur) * max(len(cells), 1)).reshape(len(dur), -1)
        ll, seen = -total * dur[:, None], fired.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            log_dur = np.log(dur)
        for c in range(len(cells)):
            where, has = np.flatnonzero(fired[:, c]), ~np.isnan(logs[c])
            k = fired[where, c]
            each, back = np.unique(k, return_inverse=True)
            less = np.array([math.lgamma(v + 1) for v in each])[back] if len(k) else k
            ll[where] += np.where(has, k[:, None] * (np.where(has, logs[c], 0.0) + log_dur[where, None]) - less[:, None], 0.0)
        if np.isnan(logs).any():  # places that a cell has no rate at do not see its spikes
            seen = (fired @ (~np.isnan(logs)).astype(float)).max(1)
        index = np.arange(len(dur)) - np.repeat(base, n)
        places = pa.ListArray.from_arrays(pa.array(np.arange(len(dur) + 1) * len(total), pa.int32()), pa.array(ll.ravel()))
        bins = pa.StructArray.from_arrays([pa.array(index, pa.int32()), pa.array(dur), pa.array(seen.astype(np.int64)), places], ["t_idx", "bin_dur", "n_spikes", "ll"])
        out = [part.column("session"), part.column("event_index"), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), bins)]
        yield pa.RecordBatch.from_arrays(out + ([pa.nulls(len(some), beside)] if beside else []), ["session", "event_index", "bins", "matrix"][: len(out) + bool(beside)])


def summed_emissions(bins: DataFrame, counts: DataFrame, rates: DataFrame) -> DataFrame:
    """Arrays of log likelihoods from bins (session, event_index, t_idx, bin_dur) and the counts of cells that fired in them.

    counts: rows with t_idx, cell_id and n, or with arrays `sums` of these. The silent part,
    minus the summed rates times the bin's length, needs no spikes, so only cells that fired
    meet the rate map. Bins, counts and maps of a session's part meet in one task, and a bin
    is one row with an array of places throughout.
    """
    tasks, keys = deals(bins), ["session", "part", "event_index"]
    if "sums" in counts.columns:
        counts = dealt(counts, tasks).select(*keys, F.inline(F.transform("sums", lambda s: F.struct(*[s[c].alias(c) for c in ("t_idx", "cell_id", "n")]))))
    else:
        counts = dealt(counts.select("session", "event_index", "t_idx", "cell_id", "n"), tasks)
    fired = counts.where("cell_id is not null").groupBy(*keys, "t_idx", "cell_id").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.collect_list(F.struct("t_idx", "cell_id", "n")).alias("_f"))
    of_event = dealt(bins, tasks).groupBy(*keys).agg(F.collect_list(F.struct("t_idx", "bin_dur")).alias("_b"))
    both = of_event.join(fired, keys, "left").join(copied(session_maps(rates), tasks), ["session", "part"])
    each = both.select(*keys, "_total", "_logs", "_f", F.inline("_b"))
    mine = F.transform(F.filter(F.coalesce("_f", F.array().cast("array<struct<t_idx:int,cell_id:int,n:bigint>>")), lambda f: f["t_idx"] == F.col("t_idx")), lambda f: F.struct(f["n"].alias("n"), log_factorial(f["n"]).alias("less"), F.element_at("_logs", f["cell_id"]).alias("at")))
    each = each.withColumn("_mine", F.filter(mine, lambda f: f["at"].isNotNull())).drop("_f", "_logs")
    silent, dur = F.transform("_total", lambda v: -v * F.col("bin_dur")), F.log("bin_dur")
    ll = F.aggregate("_mine", silent, lambda a, f: F.zip_with(a, f["at"], lambda v, r: v + F.coalesce(f["n"] * (r + dur) - f["less"], F.lit(0.0))))
    seen = F.aggregate("_mine", F.transform("_total", lambda v: F.lit(0).cast("long")), lambda a, f: F.zip_with(a, f["at"], lambda v, r: v + F.when(r.isNotNull(), f["n"]).otherwise(0)))
    gaps = F.exists("_mine", lambda f: F.exists(f["at"], lambda r: r.isNull()))
    n = F.when(gaps, F.array_max(seen)).otherwise(F.aggregate("_mine", F.lit(0).cast("long"), lambda a, f: a + f["n"]))
    return each.select(*keys, "t_idx", "bin_dur", n.alias("n_spikes"), ll.alias("ll"))
