"""Kernel densities of marks, chains as expressions, ways over places, routes and candidate supports, by brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.operators import candidates, chains, graph, marks
from driftfield.operators import models as m
from driftfield.operators.tracks import Grid

GRID = Grid(0.0, 0.0, 10.0, 4, 3)
CENTRES = m.centres_of(GRID)
EMISSIONS = "session string, event_index long, t_idx int, bin_dur double, n_spikes long, ll array<double>"


def made_marks(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i % 2}", float(rng.uniform(0, 39)), float(rng.uniform(0, 29)), int(rng.integers(0, 3)), i, float(rng.normal(10 * (i % 3), 4)), float(rng.normal(5, 3))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "session string, x double, y double, grp long, mark_id long, f1 double, f2 double").repartition(5)


def support_of(rows, k):
    """(session, group, place) -> marks and weights, from the definition."""
    out = {}
    for s, g in itertools.product(("s0", "s1"), (-1, 0, 1, 2)):
        mine = [r for r in rows if r[0] == s and (g < 0 or r[3] == g)]
        if not mine:
            continue
        size = min(k.neighbours, len(mine))
        for p in range(12):
            near = sorted(mine, key=lambda r: ((int(r[1] // 10) - p // 3) ** 2 + (int(r[2] // 10) - p % 3) ** 2, int(r[1] // 10) * 3 + int(r[2] // 10), r[4]))[:size]
            d2 = np.array([(int(r[1] // 10) - p // 3) ** 2 + (int(r[2] // 10) - p % 3) ** 2 for r in near], float)
            w = (np.exp(-0.5 * d2 / k.spatial_sigma**2) if k.spatial_sigma else (d2 == 0).astype(float)) + k.prior_count / size
            out[s, g, p] = [r[4] for r in near], (w / w.sum() if w.sum() > 1e-300 else np.full(size, 1 / size))
    return out


@pytest.mark.parametrize("kernels", [marks.Kernels(neighbours=20, near=1), marks.Kernels(neighbours=20), marks.Kernels(neighbours=1000), marks.Kernels(neighbours=15, spatial_sigma=0.0, near=2), marks.Kernels(neighbours=5, spatial_sigma=0.0, prior_count=0.0)])
def test_kernel_support_is_the_nearest_marks(spark, kernels):
    rows, df = made_marks(spark)
    both = marks.with_whole(df.select("*", F.col("mark_id").cast("double").alias("id")), "grp")
    got = {}
    for r in marks.kernel_support(both, GRID, ["id"], ["session", "grp"], kernels).collect():
        got.setdefault((r.session, r.grp, r.bin_id), {})[int(r.id)] = math.exp(r.log_w)
    want = support_of(rows, kernels)
    assert got.keys() == want.keys()
    for key, (ids, w) in want.items():
        assert sorted(got[key]) == sorted(ids) and [got[key][i] for i in ids] == pytest.approx(w.tolist())


@pytest.mark.parametrize("reach", [2.0, 25.0])
def test_kernel_emissions_by_group_and_for_groups_unseen(spark, reach):
    k = marks.Kernels(neighbours=30, reach=reach, hashed=1)
    rows, df = made_marks(spark, 300, 1)
    both = marks.with_whole(df, "grp")
    support, widths = marks.kernel_support(both, GRID, ["f1", "f2"], ["session", "grp"], k), marks.kernel_bandwidths(both, ["f1", "f2"], ["session", "grp"], k)
    rng = np.random.default_rng(2)
    spikes = [("s0", 0.1, 1000, 0, 3.0, 4.0), ("s0", 0.2, 1001, 7, 12.0, 5.0), ("s0", 1.4, 1002, 2, 80.0, 90.0), ("s1", 0.3, 1003, 1, 9.0, 2.0), ("s1", 0.4, 1004, None, 9.0, 2.0), ("s1", 0.4, 1005, 1, 9.5, 2.5)]
    events = [("s0", 1, 0.0, 2.0), ("s1", 1, 0.0, 1.5)]  # numbers repeat over sessions
    rates = {(s, g, p): float(rng.uniform(0.5, 3)) for s in ("s0", "s1") for g in (0, 1, 2) for p in range(12)}
    rates |= {(s, -1, p): sum(rates[s, g, p] for g in range(3)) for s in ("s0", "s1") for p in range(12)}
    got = marks.kernel_emissions(spark.createDataFrame(spikes, "session string, t double, mark_id long, grp long, f1 double, f2 double"), spark.createDataFrame(events, "session string, event_index long, start double, end double"), support, widths, spark.createDataFrame([(*a, v) for a, v in rates.items()], "session string, grp long, bin_id int, rate_hz double"), ["f1", "f2"], "grp", 1.0, k)
    got = {(r.session, r.t_idx, r.bin_id): (r.ll, r.n_spikes) for r in got.collect()}
    want, value = support_of(rows, k), {r[4]: r[5:] for r in rows}
    for s, start, end in (("s0", 0.0, 2.0), ("s1", 0.0, 1.5)):
        for t in range(2):
            dur, mine = min(t + 1, end) - t, [x for x in spikes if x[0] == s and t <= x[1] < min(t + 1, end)]
            for p in range(12):
                ll = -rates[s, -1, p] * dur + len(mine) * math.log(dur) - math.lgamma(len(mine) + 1)
                for _, _, _, g, *f in mine:
                    g = g if g in (0, 1, 2) else -1
                    of = np.array([value[r[4]] for r in rows if r[0] == s and (g < 0 or r[3] == g)])
                    var = np.maximum(np.maximum(of.var(0), 1.0) * len(of) ** (-2 / 6), 1.0)
                    ids, w = want[s, g, p]
                    q = ((np.array([value[i] for i in ids]) - f) ** 2 / var).sum(1)
                    density = (w * np.exp(-0.5 * np.minimum(q, reach**2))).sum()
                    ll += math.log(rates[s, g, p]) + math.log(density) - 0.5 * np.log(2 * np.pi * var).sum()
                assert got[s, t, p] == (pytest.approx(ll), len(mine))


def made_events(seed=0, n=6):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        ll = rng.normal(size=(i % 5 + 1, 12)) * 2
        if i == 3:
            ll[1] = -np.inf
        if i == 4:
            ll[:] = -np.inf
            ll[np.arange(len(ll)), np.arange(len(ll))] = 0.0
        out.append((f"s{i % 2}", i // 2, ll, np.array([1.0] * (len(ll) - 1) + [0.4])))
    return out


def frame(spark, events):
    return spark.createDataFrame([(s, e, t, float(dur[t]), t + 1, [float(v) for v in ll[t]]) for s, e, ll, dur in events for t in range(len(ll))], EMISSIONS).repartition(3)


@pytest.mark.parametrize("motion", [m.Motion(), m.Motion(diffusion=4.0, stationary=3.0, truncate=1.5, switch_tau=2.0)])
def test_chains_equal_the_kernels(spark, motion):
    events = made_events(1, 10)
    got = {(r.session, r.event_index, r.model): r for r in chains.score_chains(frame(spark, events), GRID, list(chains.CHAINS), motion, 1.0).collect()}
    assert len(got) == 40
    for s, i, ll, dur in events:
        case = m.Event(ll, CENTRES, (dur[1:] + dur[:-1]) / 2, 1.0, motion)
        for name in chains.CHAINS:
            r, (log, post) = got[s, i, name], m.REGISTRY[name][0](case)
            assert r.log_evidence == pytest.approx(log) and r.n_time == len(ll) and r.n_spikes == len(ll) * (len(ll) + 1) // 2
            assert np.isfinite(r.terminal).all() and sum(r.terminal) == pytest.approx(1)
            if np.isfinite(log):
                assert r.terminal == pytest.approx(post[-1].tolist())
            prefixes = [m.REGISTRY[name][0](m.Event(ll[: k + 1], CENTRES, case.steps[:k], 1.0, motion))[0] for k in range(len(ll))]
            assert list(r.made) == pytest.approx(prefixes)


def test_chains_refuse_what_they_cannot_say(spark):
    df = frame(spark, made_events())
    with pytest.raises(ValueError):
        chains.score_chains(df, GRID, ["goal"])
    with pytest.raises(ValueError):
        chains.score_chains(df, Grid(0.0, 0.0, 1.0, 40, 40), ["random"])
    assert chains.score_chains(df.where("false"), GRID, ["random"]).collect() == []


def test_plan_of_chains_has_no_python(spark):
    plan = chains.score_chains(frame(spark, made_events()), GRID, list(chains.CHAINS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shortest_ways_equal_all_pairs_relaxation(spark):
    rng = np.random.default_rng(0)
    held = {s: sorted(rng.choice(12, size, replace=False).tolist()) for s, size in (("a", 8), ("b", 12), ("c", 5), ("d", 1))}
    places = spark.createDataFrame([(s, b) for s, bs in held.items() for b in bs], "session string, bin_id int")
    for diagonal, longest in ((True, None), (False, None), (True, 25.0)):
        got = {(r.session, r.src, r.dst): r.distance for r in graph.shortest_ways(graph.place_edges(places, GRID, diagonal), places.select("session", F.col("bin_id").alias("src")), longest).collect()}
        want = {}
        for s, bs in held.items():
            d = {(a, b): math.inf for a in bs for b in bs}
            for a, b in d:
                dx, dy = abs(a // 3 - b // 3), abs(a % 3 - b % 3)
                if max(dx, dy) <= 1 and (diagonal or dx + dy <= 1):
                    d[a, b] = 10 * math.hypot(dx, dy)
            for k, a, b in itertools.product(bs, bs, bs):
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
            want |= {(s, a, b): v for (a, b), v in d.items() if v <= (longest or 1e9)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_geodesic_chain_sums_all_paths(spark):
    held = [0, 1, 2, 5, 9, 11]
    places = spark.createDataFrame([("s0", b) for b in held], "session string, bin_id int")
    ways = graph.shortest_ways(graph.place_edges(places, GRID), places.select("session", F.col("bin_id").alias("src")))
    steps = graph.way_steps(ways, 12.0, 2.0, stay=0.2)
    d = {(r.src, r.dst): r.distance for r in ways.collect()}
    w = {k: math.exp(-0.5 * (v / 12) ** 2) for k, v in d.items() if v <= 24}
    p = {(a, b): 0.8 * v / sum(x for (c, _), x in w.items() if c == a) + 0.2 * (a == b) for (a, b), v in w.items()}
    events = [e for e in made_events(3, 8) if e[0] == "s0"]
    got = {r.event_index: r for r in graph.score_ways(frame(spark, events + [("other", 0, np.zeros((1, 12)), np.ones(1))]), steps, 12, "g").collect()}
    assert len(got) == 4
    for _, i, ll, _ in events:
        if len(ll) > 4:
            continue
        total = sum(np.prod([p.get((a, b), 0.0) for a, b in zip(path, path[1:])]) / len(held) * np.exp(sum(ll[t, x] for t, x in enumerate(path))) for path in itertools.product(held, repeat=len(ll)))
        with np.errstate(divide="ignore"):
            assert got[i].log_evidence == pytest.approx(float(np.log(total)))
        assert got[i].valid_places == 6 and sum(got[i].terminal[b] for b in held) == pytest.approx(1) or not np.isfinite(got[i].log_evidence)


def test_routes_and_labels(spark):
    wells = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 10.0, 0.0), ("a", 5, 10.0, 10.0), ("b", 1, 0.0, 0.0)], "session string, well_id int, x double, y double")
    both, one = graph.well_routes(wells), graph.well_routes(wells, both_ways=False)
    assert both.select("session", "route").distinct().count() == 6 and [r.well_id for r in one.where("route = 1").orderBy("place_no").collect()] == [1, 5]
    points = spark.createDataFrame([("a", 1, 5.0, 1.0), ("a", 2, 10.0, 12.0), ("a", 3, 4.0, 4.0), ("b", 1, 1.0, 1.0)], "session string, id int, x double, y double")
    got = {(r.session, r.id): (r.route, r.route_distance, r.route_progress) for r in graph.route_labels(points, one, ["id"]).collect()}
    assert got["a", 1] == (0, 1.0, 0.5) and got["a", 2] == (1, 2.0, 1.0) and got["b", 1] == (None, None, None)
    assert got["a", 3][0] == 1 and got["a", 3][1:] == pytest.approx((0.0, 0.4))


def kept(ll, mass, top_k, min_k, max_k):
    order = sorted(range(len(ll)), key=lambda b: (-ll[b], b))
    if mass is None:
        return order[:top_k] if top_k else order
    order = [b for b in order if np.isfinite(ll[b])]
    if not order:
        return []
    least = min(len(order), max(1, top_k, min_k))
    most = len(order) if max_k <= 0 else min(len(order), max(least, max_k))
    share = np.cumsum(np.exp([ll[b] for b in order]) / np.exp([ll[b] for b in order]).sum())
    return order[: min(max(least, int((share + 16 * np.finfo(float).eps < mass).sum()) + 1), most)]


@pytest.mark.parametrize("mass,top_k,min_k,max_k,predicted,dt", [(0.8, 0, 1, 0, 0, None), (0.8, 2, 3, 5, 2, None), (None, 3, 1, 0, 3, 1.0), (None, 0, 1, 0, 1, None), (1.0, 0, 1, 4, 0, None)])
def test_candidate_supports(spark, mass, top_k, min_k, max_k, predicted, dt):
    events = made_events(5, 10)
    got = {(r.session, r.event_index, r.t_idx): r for r in candidates.candidate_supports(frame(spark, events), GRID, mass, top_k, min_k, max_k, predicted, 0.9, dt).collect()}
    for s, e, ll, dur in events:
        base, steps = [kept(x, mass, top_k, min_k, max_k) for x in ll], (dur[1:] + dur[:-1]) / 2
        factor = lambda k: 0.9 if dt is None else 0.9 ** (steps[k] / dt) * steps[k] / steps[k - 1]
        for t in range(len(ll)):
            want = set(base[t])
            if predicted and t >= 2:
                want |= {int(((CENTRES - (CENTRES[b] + factor(t - 1) * (CENTRES[b] - CENTRES[a]))) ** 2).sum(1).argmin()) for a in base[t - 2][:predicted] for b in base[t - 1][:predicted]}
            if predicted and t + 2 < len(ll):
                want |= {int(((CENTRES - (CENTRES[b] - (CENTRES[a] - CENTRES[b]) / factor(t + 1))) ** 2).sum(1).argmin()) for a in base[t + 2][:predicted] for b in base[t + 1][:predicted]}
            r = got[s, e, t]
            assert set(r.support) == want and len(r.support) == len(want) and r.base_size == len(base[t])
            if np.isfinite(ll[t]).any():
                part = m.lse(ll[t][sorted(want)]) if want else -np.inf
                assert r.log_mass == pytest.approx(float(part - m.lse(ll[t])), abs=1e-12)
            else:
                assert r.log_mass == -np.inf


def spread(points, sigma):
    """[to, from] law over all places, without a cut."""
    w = np.exp(-0.5 * ((CENTRES[:, None] - points[None]) ** 2).sum(-1) / sigma**2)
    return w / w.sum(0)


@pytest.mark.parametrize("modes", [("stationary",), ("diffusion",), ("momentum",), ("jump",), ("stationary", "diffusion", "momentum", "jump")])
def test_candidate_models_sum_all_paths(modes):
    rng, n = np.random.default_rng(7), 4
    ll = rng.normal(size=(n, 12)) * 2
    motion = m.Motion(candidate_k=3, candidate_still=6.0, candidate_width=9.0, candidate_decay=0.8, candidate_stickiness=0.7)
    places = [np.argsort(-x, kind="stable")[:3] for x in ll]
    law = {"stationary": spread(CENTRES, 6.0), "diffusion": spread(CENTRES, 9.0), "jump": np.full((12, 12), 1 / 12)}

    def step(mode, path, t):
        if mode == "momentum":
            before = CENTRES[path[t - 1]] - CENTRES[path[t - 2]] if t > 1 else np.zeros(2)
            return spread((CENTRES[path[t - 1]] + 0.8 * before)[None], 9.0)[path[t], 0]
        return law[mode][path[t], path[t - 1]]

    total = 0.0
    for path in itertools.product(*places):
        seen = np.exp(sum(ll[t, b] for t, b in enumerate(path))) / 12
        for way in itertools.product(modes, repeat=n - 1):
            change = np.prod([0.7 if a == b else 0.1 for a, b in zip(way, way[1:])]) if len(modes) > 1 else 1.0
            total += seen * change / len(modes) * np.prod([step(mode, path, t + 1) for t, mode in enumerate(way)])
    case = m.Event(ll, CENTRES, np.array([1.0, 1.0, 0.5]), 1.0, motion)
    log, post = m.candidate_pairs(modes)(case)
    assert log == pytest.approx(np.log(total)) and post.sum(1) == pytest.approx(1)
    given = m.Event(ll, CENTRES, case.steps, 1.0, m.Motion(**{**motion.__dict__, "candidate_k": 1}), support=tuple(x.tolist() for x in places))
    assert m.candidate_pairs(modes)(given)[0] == pytest.approx(log)


def test_routes_sum_all_paths():
    rng = np.random.default_rng(8)
    ll, steps = rng.normal(size=(3, 12)), np.array([1.0, 0.5])
    motion, goals = m.Motion(route_speed=8.0, route_width=9.0), CENTRES[[0, 5, 11]]
    total = 0.0
    for a, b in itertools.permutations(goals, 2):
        laws = []
        for s, u in zip(steps, np.cumsum(steps) / steps.sum()):
            gap = a + u * (b - a) - CENTRES
            far = np.sqrt((gap**2).sum(1, keepdims=True))
            laws.append(m.gaussian(CENTRES, CENTRES + gap * np.minimum(1, 8.0 * s / np.maximum(far, 1e-12)), 9.0 * s**0.5, 4.0))
        total += sum(laws[0][q, p] * laws[1][r, q] / 12 * np.exp(ll[0, p] + ll[1, q] + ll[2, r]) for p, q, r in itertools.product(range(12), repeat=3)) / 6
    assert m.well_route(m.Event(ll, CENTRES, steps, 1.0, motion, goals=goals))[0] == pytest.approx(np.log(total))


def test_registry_holds_each_model_once():
    kernels = [k for k, _ in m.REGISTRY.values()]
    assert len({id(k) for k in kernels}) == len(kernels) and m.model_of("state-space-fragmented") == m.REGISTRY["random"]
    case = m.Event(np.random.default_rng(0).normal(size=(5, 12)) * 3, CENTRES, np.ones(4), 1.0, m.Motion(top_k=4, candidate_k=4, diffusion=5.0, momentum=4.0), goals=CENTRES[[0, 7]], transitions=np.full((12, 12), 1 / 12))
    found = {name: round(k(case)[0], 9) for name, (k, _) in m.REGISTRY.items() if name not in ("empirical-transition",)}
    assert len(set(found.values())) == len(found)
