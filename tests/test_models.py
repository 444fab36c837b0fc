import itertools

import numpy as np
import pytest

from driftfield.operators import models as m
from driftfield.operators.tracks import Grid

GRID = Grid(0.0, 0.0, 10.0, 2, 2)
CENTRES = m.centres_of(GRID)


def event(seed=0, n=4, **motion):
    rng = np.random.default_rng(seed)
    return m.Event(rng.normal(size=(n, 4)) * 2, CENTRES, np.array([1.0, 1.0, 0.7])[: n - 1], 1.0, m.Motion(**motion), goals=CENTRES[:2])


def paths(e, weight):
    """Log of the summed probability of all paths of places."""
    n, b = e.ll.shape
    return float(np.log(sum(weight(p) * np.exp(sum(e.ll[t, p[t]] for t in range(n))) for p in itertools.product(range(b), repeat=n))))


@pytest.mark.parametrize("seed", range(4))
def test_first_order_models_sum_all_paths(seed):
    e, b = event(seed), 4
    moves = m._steps(e, e.motion.diffusion)
    chain = lambda p: np.prod([moves[k][p[k + 1], p[k]] for k in range(3)]) / b
    assert m.diffusion(e)[0] == pytest.approx(paths(e, chain))
    assert m.random(e)[0] == pytest.approx(paths(e, lambda p: b**-4))
    assert m.stationary(e)[0] == pytest.approx(paths(e, lambda p: (len(set(p)) == 1) / b))
    back = m.Event(e.ll[::-1], CENTRES, e.steps[::-1], 1.0, e.motion)
    assert m.reversed_of(m.diffusion)(e)[0] == pytest.approx(m.diffusion(back)[0])
    assert m.bidirectional(m.diffusion)(e)[0] == pytest.approx(np.logaddexp(m.diffusion(e)[0], m.diffusion(back)[0]) - np.log(2))


@pytest.mark.parametrize("seed", range(3))
def test_switching_model_sums_all_modes_and_paths(seed):
    e, b = event(seed), 4
    kernels = [m._steps(e, e.motion.stationary), m._steps(e, e.motion.diffusion), [np.full((b, b), 1 / b)] * 3]

    def weight(p):
        total = 0.0
        for modes in itertools.product(range(3), repeat=4):
            w = 1 / (3 * b)
            for k in range(3):
                w *= m.switching(3, e.steps[k], e.motion)[modes[k + 1], modes[k]] * kernels[modes[k + 1]][k][p[k + 1], p[k]]
            total += w
        return total

    assert m.first_order_imm(e)[0] == pytest.approx(paths(e, weight))


@pytest.mark.parametrize("seed,tau", [(0, 0.0), (1, 0.0), (2, 2.0)])
def test_momentum_sums_all_paths(seed, tau):
    e, b = event(seed, decay_tau=tau), 4
    first = m._steps(e, e.motion.momentum)[0]

    def weight(p):
        w = first[p[1], p[0]] / b
        for k in (1, 2):
            target = CENTRES[p[k]] + m._decay(e, k) * (CENTRES[p[k]] - CENTRES[p[k - 1]])
            w *= m.gaussian(CENTRES, target[None, :], e.motion.momentum * e.steps[k] ** 0.5, e.motion.truncate)[p[k + 1], 0]
        return w

    assert m.momentum_exact(e)[0] == pytest.approx(paths(e, weight))
    assert m.momentum_pruned(event(seed, decay_tau=tau, top_k=2))[0] <= m.momentum_exact(e)[0] + 1e-12
    assert m.momentum_pruned(event(seed, decay_tau=tau, top_k=4))[0] == pytest.approx(m.momentum_exact(e)[0])


@pytest.mark.parametrize("options", [{}, {"stay": 0.7}, {"start": 0.1, "enter": 0.05}])
def test_trajectory_switching_sums_all_modes_and_paths(options):
    e, b = event(6), 4
    e = m.Event(e.ll[:3], CENTRES, e.steps[:2], 1.0, e.motion)
    still, moves, laws = (m._steps(e, s) for s in (e.motion.stationary, e.motion.diffusion, e.motion.momentum))
    stay, start, enter = options.get("stay", e.motion.stickiness), options.get("start", 0.25), options.get("enter")
    change = np.full((4, 4), (1 - stay) / 3)
    np.fill_diagonal(change, stay)
    if enter is not None:
        change[3, :3] = enter
        change[:3, :3] *= (1 - enter) / change[:3, :3].sum(0)
    assert change.sum(0) == pytest.approx(np.ones(4))

    def weight(p):
        total = 0.0
        for modes in itertools.product(range(4), repeat=3):
            w = (start if modes[0] == 3 else (1 - start) / 3) / b
            for k in range(2):
                w *= change[modes[k + 1], modes[k]]
                if modes[k + 1] == 3 and modes[k] == 3 and k:
                    target = CENTRES[p[k]] + m._decay(e, k) * (CENTRES[p[k]] - CENTRES[p[k - 1]])
                    w *= m.gaussian(CENTRES, target[None, :], e.motion.momentum * e.steps[k] ** 0.5, e.motion.truncate)[p[k + 1], 0]
                else:
                    w *= (still[k], moves[k], [[1 / b] * b] * b, laws[k])[modes[k + 1]][p[k + 1]][p[k]]
            total += w
        return total

    assert m.trajectory_imm(e, **options)[0] == pytest.approx(paths(e, weight))


def dense_momentum(e):
    """The law of every triple of places, at full length."""
    b, total, pairs = len(e.centres), 0.0, None
    p = np.full(b, 1 / b) * np.exp(e.ll[0])
    total, p = np.log(p.sum()), p / p.sum()
    for t in range(1, len(e.ll)):
        if t == 1:
            pairs = (m._steps(e, e.motion.momentum)[0] * p[None, :]).T  # [before, now]
        else:
            new = np.zeros_like(pairs)
            for i in range(b):
                for j in range(b):
                    target = e.centres[j] + m._decay(e, t - 1) * (e.centres[j] - e.centres[i])
                    new[j] += pairs[i, j] * m.gaussian(e.centres, target[None, :], e.motion.momentum * e.steps[t - 1] ** 0.5, e.motion.truncate)[:, 0]
            pairs = new
        pairs = pairs * np.exp(e.ll[t])[None, :]
        total, pairs = total + np.log(pairs.sum()), pairs / pairs.sum()
    return total


@pytest.mark.parametrize("sigma", [12.0, 2.0])
def test_pairs_match_the_law_of_triples(sigma):
    rng = np.random.default_rng(2)
    centres = np.delete(m.centres_of(Grid(0.0, 0.0, 10.0, 5, 4)), [3, 11], 0)  # with holes; a narrow law leaves some pairs nowhere to go
    e = m.Event(rng.normal(size=(5, 18)), centres, np.array([1.0, 0.5, 1.0, 0.8]), 1.0, m.Motion(momentum=sigma))
    assert m.momentum_exact(e)[0] == pytest.approx(dense_momentum(e))


def test_pairs_of_a_fine_grid_fit():
    import tracemalloc

    rng = np.random.default_rng(2)
    centres = m.centres_of(Grid(0.0, 0.0, 4.0, 50, 25))
    e = m.Event(rng.normal(size=(6, 1250)), centres, np.full(5, 0.02), 0.02, m.Motion(diffusion=85.0, momentum=85.0, truncate=4.0, decay=0.95, top_k=128), made={}, done={})
    tracemalloc.start()
    for name in ("state-space-momentum", "state-space-momentum-exact", "trajectory-imm-exact", "state-space-imm", "bidirectional-momentum-exact", "displacement-imm"):
        log, post = e.run(m.REGISTRY[name][0])
        assert np.isfinite(log) and post.sum(1) == pytest.approx(np.ones(6)), name
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_walks_and_ways():
    centres = np.delete(m.centres_of(Grid(0.0, 0.0, 10.0, 3, 3)), [3, 4], 0)  # a wall between the first row and the last
    e = m.Event(np.random.default_rng(0).normal(size=(3, 7)), centres, np.array([1.0, 2.0]), 1.0, m.Motion())
    far = m.path_lengths(e)
    assert far[0, 2] == pytest.approx(20.0) and far[0, 5] == pytest.approx(10 + 2 * 10 * 2**0.5) and (far == far.T).all()
    at = centres // 10
    one = np.zeros((7, 7))
    for j in range(7):
        beside = [i for i in range(7) if np.abs(at[i] - at[j]).sum() == 1]
        one[j, j] = 0.5
        for i in beside:
            one[i, j] = 0.5 / len(beside)
    chain = lambda p: one[p[1], p[0]] * (one @ one)[p[2], p[1]] / 7
    assert m.walk(e)[0] == pytest.approx(paths(e, chain))
    law = [np.where(far <= 5 * 12 * s**0.5, np.exp(-0.5 * far**2 / (144 * s)), 0) for s in (1.0, 2.0)]
    law = [x / x.sum(0) for x in law]
    assert m.geodesic(e)[0] == pytest.approx(paths(e, lambda p: law[0][p[1], p[0]] * law[1][p[2], p[1]] / 7))


def test_smoothed_posteriors_sum_all_paths():
    e, b = event(3), 4
    moves = m._steps(e, e.motion.diffusion)
    want = np.zeros((4, b))
    for p in itertools.product(range(b), repeat=4):
        w = np.prod([moves[k][p[k + 1], p[k]] for k in range(3)]) * np.exp(sum(e.ll[t, p[t]] for t in range(4)))
        for t in range(4):
            want[t, p[t]] += w
    log, post = m.smoothed_diffusion(e)
    assert post == pytest.approx(want / want.sum(1, keepdims=True)) and log == pytest.approx(m.diffusion(e)[0])
    log, post = m.smoothed_first_order_imm(e)
    assert log == pytest.approx(m.first_order_imm(e)[0]) and post[-1] == pytest.approx(m.first_order_imm(e)[1][-1])


def test_displaced_modes_sum_all_paths():
    e, b = event(8, decay=0.8), 4
    e = m.Event(e.ll[:3], CENTRES, e.steps[:2], 1.0, e.motion)
    d = m.lattice(10.0, 1)
    prior = m.gaussian(d, np.zeros((1, 2)), 12.0, np.inf)[:, 0]
    shift = [m.gaussian(CENTRES, CENTRES + v, 5.0, e.motion.truncate) for v in d]
    turn = [m.gaussian(d, m._decay(e, k) * d, 12.0 * e.steps[k] ** 0.5, np.inf) for k in range(2)]
    still, moves = m._steps(e, e.motion.stationary), m._steps(e, e.motion.diffusion)

    def weight(p):
        total = 0.0
        for modes in itertools.product(range(4), repeat=3):
            w = np.full(9, 1 / 4 / b) * prior
            for k in range(2):
                w = w * m.switching(4, e.steps[k], e.motion)[modes[k + 1], modes[k]]
                if modes[k + 1] == 2:
                    w = turn[k] @ w * np.array([s[p[k + 1], p[k]] for s in shift])
                else:
                    w = prior * w.sum() * (still[k][p[k + 1], p[k]], moves[k][p[k + 1], p[k]], 0, 1 / b)[modes[k + 1]]
            total += w.sum()
        return total

    assert m.displacement_imm(e, 1)[0] == pytest.approx(paths(e, weight))


@pytest.mark.parametrize("model", ["random", "stationary", "state-space-diffusion", "state-space-fragmented"])
def test_prefixes_are_the_evidence_of_cut_events(model):
    e = event(4)
    for t, v in enumerate(m.prefixes_of(model, e)):
        assert v == pytest.approx(m.model_of(model)[0](m.Event(e.ll[: t + 1], CENTRES, e.steps[:t], 1.0, e.motion))[0])


def test_valid_places_only(spark):
    ll = event(3).ll
    df = spark.createDataFrame([("s", 1, t, 1.0, 2, [float(x) for x in ll[t]]) for t in range(3)], "session string, event_index long, t_idx int, bin_dur double, n_spikes long, ll array<double>")
    got = m.score_events(df, GRID, ["state-space-diffusion"], valid=[0, 1, 3]).collect()[0]
    keep = [0, 1, 3]
    assert got.log_evidence == pytest.approx(m.diffusion(m.Event(ll[:3][:, keep], CENTRES[keep], np.ones(2), 1.0, m.Motion()))[0]) and got.terminal[2] == 0
    rows = m.trajectories(df, GRID, ["stationary", "state-space-diffusion"]).collect()
    assert len(rows) == 6 and all(abs(sum(r.posterior) - 1) < 1e-9 for r in rows) and len({tuple(r.posterior) for r in rows if r.model == "stationary"}) == 1


def test_displacements_sum_all_paths():
    e, b = event(7, decay=0.8), 4
    e = m.Event(e.ll[:3], CENTRES, e.steps[:2], 1.0, e.motion)
    d = m.lattice(10.0, 1)
    prior = m.gaussian(d, np.zeros((1, 2)), 12.0, np.inf)[:, 0]
    shift = [m.gaussian(CENTRES, CENTRES + v, 5.0, e.motion.truncate) for v in d]
    turn = m.gaussian(d, m._decay(e, 1) * d, 12.0 * e.steps[1] ** 0.5, np.inf)
    weight = lambda p: sum(prior[i] * shift[i][p[1], p[0]] * turn[j, i] * shift[j][p[2], p[1]] for i in range(9) for j in range(9)) / b
    assert m.displacement_momentum(e, 1)[0] == pytest.approx(paths(e, weight))


@pytest.mark.parametrize("seed", range(5))
def test_grammar_finds_the_best_of_all_sequences(seed):
    n, g = 5, m.Grammar(most_segments=3)
    score = np.random.default_rng(seed).normal(size=(n, n + 1, 3))
    score[np.arange(n)[:, None] >= np.arange(n + 1)[None, :]] = -np.inf
    best = -np.inf
    for k in (1, 2, 3):
        for cuts in itertools.combinations(range(1, n), k - 1):
            edges = [0, *cuts, n]
            for modes in itertools.product(range(3), repeat=k):
                if all(a != b for a, b in zip(modes, modes[1:])):
                    best = max(best, sum(score[edges[i], edges[i + 1], modes[i]] for i in range(k)) - (k - 1) * g.penalty)
    total, found = m.best_segments(score, g)
    assert total == pytest.approx(best)
    assert total == pytest.approx(sum(score[a, z, k] for a, z, k in found) - (len(found) - 1) * g.penalty)
    assert found[0][0] == 0 and found[-1][1] == n and all(x[1] == y[0] and x[2] != y[2] for x, y in zip(found, found[1:]))


def test_matrices_kept_between_events_change_nothing():
    made = {}
    for seed in range(3):
        e = event(seed)
        shared = m.Event(e.ll, e.centres, e.steps, e.dt, e.motion, e.goals, made=made)
        for name, (kernel, _) in m.REGISTRY.items():
            assert kernel(e)[0] == pytest.approx(kernel(shared)[0]), name


def test_posteriors_sum_to_one_and_one_bin_is_even():
    for name, (kernel, _) in m.REGISTRY.items():
        assert kernel(event(5))[1].sum(1) == pytest.approx(np.ones(4)), name
        assert kernel(event(5, 1))[0] == pytest.approx(m.random(event(5, 1))[0]), name


def test_regression_matches_least_squares(spark):
    from driftfield.operators.regression import cluster_robust

    rng = np.random.default_rng(0)
    x, g = rng.normal(size=(200, 2)), np.repeat(np.arange(20), 10)
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=20)[g] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(c), float(d), int(k)) for a, (c, d), k in zip(y, x, g)], "y double, a double, b double, g int")
    got = {r.term: r for r in cluster_robust(df, "y", ["a", "b"], "g").collect()}
    full = np.column_stack((np.ones(200), x))
    beta, inv = np.linalg.lstsq(full, y, rcond=None)[0], np.linalg.inv(full.T @ full)
    e = y - full @ beta
    meat = sum(np.outer(s, s) for s in (full[g == k].T @ e[g == k] for k in range(20)))
    se = np.sqrt(np.diag(inv @ meat @ inv) * 20 / 19 * 199 / 197)
    for i, t in enumerate(("intercept", "a", "b")):
        assert got[t].estimate == pytest.approx(beta[i]) and got[t].se == pytest.approx(se[i]) and got[t].t == pytest.approx(beta[i] / se[i])


def test_impossible_bin():
    e = event(0)
    ll = e.ll.copy()
    ll[2] = -np.inf
    assert m.diffusion(m.Event(ll, CENTRES, e.steps, 1.0, e.motion))[0] == float("-inf")


def test_no_kernel_gives_nan_where_no_path_is_possible():
    e, none = event(0), float("-inf")
    whole, apart = e.ll.copy(), np.full_like(e.ll, none)
    whole[2] = none
    apart[np.arange(4), [0, 1, 2, 3]] = 0.0  # bins that share no place
    near = m.Motion(diffusion=0.1, stationary=0.1, truncate=1.0)
    for ll in (whole, apart):
        case = m.Event(ll, CENTRES, e.steps, 1.0, near, goals=CENTRES[:2])
        for name, (kernel, _) in m.REGISTRY.items():
            log, post = kernel(case)
            assert not np.isnan(log) and np.isfinite(post).all() and post.sum(1) == pytest.approx(1), name
        for name, kernel in m.SMOOTHED.items():
            log, post = kernel(case)
            assert not np.isnan(log) and post.sum(1) == pytest.approx(1), name
        for name in ("random", "stationary", "state-space-fragmented", "state-space-diffusion"):
            prefixes = m.prefixes_of(name, case)
            assert not np.isnan(prefixes).any() and len(prefixes) == 4
    assert m.stationary(m.Event(apart, CENTRES, e.steps, 1.0, near))[0] == none
    assert m.prefixes_of("state-space-diffusion", m.Event(whole, CENTRES, e.steps, 1.0, e.motion))[2:].tolist() == [none, none]


def test_switch_time_constant_is_a_matrix_exponential():
    g = np.full((3, 3), 1 / 2 / 4.0) - np.eye(3) * (1 / 2 / 4.0 + 1 / 4.0)
    p, term = np.eye(3), np.eye(3)
    for k in range(1, 40):
        term = term @ g * 1.3 / k
        p = p + term
    assert m.switching(3, 1.3, m.Motion(switch_tau=4.0)) == pytest.approx(p)


def test_score_events(spark):
    rows = [("s", 1, t, 1.0, 2, [float(x) for x in event(3).ll[t]]) for t in range(3)] + [("s", 2, 0, 1.0, 1, [0.0, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "session string, event_index long, t_idx int, bin_dur double, n_spikes long, ll array<double>")
    got = {(r.event_index, r.model): r for r in m.score_events(df, GRID, list(m.REGISTRY), m.Motion(), 1.0).collect()}
    assert len(got) == 2 * len(m.REGISTRY) and got[2, "state-space-momentum"].evidence_support == "degenerate_single_bin"
    assert got[1, "random"].log_evidence == pytest.approx(m.random(m.Event(event(3).ll[:3], CENTRES, np.ones(2), 1.0, m.Motion()))[0])
    with pytest.raises(ValueError):
        m.score_events(df, GRID, ["nothing"])


def test_decoding_finds_the_place(spark):
    from driftfield.operators.decoding import decode_positions

    t = np.arange(0, 600, 0.5)
    x = np.where((t // 10) % 2 == 0, 5.0, 15.0)
    pos = spark.createDataFrame([("s", i, float(a), float(b), 5.0) for i, (a, b) in enumerate(zip(t, x))], "session string, frame_idx long, t double, x double, y double")
    fired = [(float(a) + 0.1, 1 if b < 10 else 2) for a, b in zip(t, x)]
    spk = spark.createDataFrame([("s", i, a, c) for i, (a, c) in enumerate(fired)], "session string, spike_row long, t double, cell_id int")
    got = decode_positions(pos, spk, Grid(0.0, 0.0, 10.0, 2, 2), 10.0).collect()
    assert len(got) == 60 and {r.fold for r in got} == {0, 1, 2}
    assert np.mean([r.map_x == r.true_x for r in got]) > 0.9 and np.median([r.true_rank for r in got]) == 1


def test_separable_models_sum_all_paths():
    from driftfield.operators import separable as sp

    e = event(2)
    lx = [sp.line_law(2, (7.0 / 10) ** 2 * s) for s in e.steps]
    at, _ = e.places()
    chain = lambda p: np.prod([lx[k][at[p[k + 1], 0], at[p[k], 0]] * lx[k][at[p[k + 1], 1], at[p[k], 1]] for k in range(3)]) / 4
    assert sp.diffusion(e, 7.0) == pytest.approx(paths(e, chain))
    law = sp.line_law(2, (6.0 / 10) ** 2)
    around = np.log(np.mean([np.prod([sum(law[at[b, 0], at[c, 0]] * law[at[b, 1], at[c, 1]] * np.exp(e.ll[t, b]) for b in range(4)) for t in range(4)]) for c in range(4)]))
    assert sp.gathered_round_a_place(e, 6.0) == pytest.approx(around)
    first = sp.line_law(2, (3.0 * e.steps[0] / 10) ** 2)
    turn = [None] + [sp.turning_law(2, 9.0 / 10, 0.3, float(s)) for s in e.steps[1:]]

    def weight(p):
        w = first[at[p[1], 0], at[p[0], 0]] * first[at[p[1], 1], at[p[0], 1]] / 4
        for k in (1, 2):
            for axis in (0, 1):
                w *= turn[k][at[p[k + 1], axis], at[p[k], axis], at[p[k - 1], axis]]
        return w

    assert sp.momentum(e, 9.0, 0.3, 3.0) == pytest.approx(paths(e, weight))
    assert sp.turning_law(5, 1e-9, 1e-9, 1.0).sum(0) == pytest.approx(np.ones((5, 5)))
