import numpy as np
import pytest

from driftfield.llm import ann


def brute(ids, x, k=20, every=20):
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = x @ x[i]
            s[i] = -np.inf
            order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
            out[int(q)] = ids[order].tolist()
    return out


def sum_in_order(a, b):
    total = 0.0
    for p in (a * b).tolist():
        total += p
    return total


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, v int")
    got = ann.nearest(df).collect()
    want, x = brute(np.arange(1500), x.astype(float)), x.astype(float)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == sum_in_order(x[r.query_id], x[r.vec_id])
    assert all(len(v) == 20 for v in found.values()) and found.keys() == want.keys()
    assert sum(len({*found[q]} & {*want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_ties_nulls_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0]), (4, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (10, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).collect())
    # the repeated row of id 1 is two candidates
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert ann.nearest(df.where("false")).collect() == []


def test_repeated_rows_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 1.0]), (40, [0.0, 3.0]), (40, [3.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).collect())
    twin = [(20, 1, 40, 3.0), (20, 2, 3, 1.0), (20, 3, 20, 1.0), (20, 4, 4, 0.5), (20, 5, 40, 0.0)]
    up = [(40, 1, 4, 3.0), (40, 2, 3, 0.0), (40, 3, 20, 0.0), (40, 4, 20, 0.0), (40, 5, 40, 0.0)]
    out = [(40, 1, 3, 3.0), (40, 2, 20, 3.0), (40, 3, 20, 3.0), (40, 4, 4, 1.5), (40, 5, 40, 0.0)]
    assert got == sorted(twin * 2 + up + out)


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(i, [float(i), -1.0]) for i in range(300, 360)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    x = np.array([v for _, v in rows])
    assert got == brute(np.array([i for i, _ in rows]), x)


def test_best_of_blocks_with_ties():
    rng = np.random.default_rng(0)
    score, ids = rng.integers(0, 4, (30, 50)).astype(float), rng.permutation(50)
    row, col = ann.best(score, ids, 7)
    for i in range(30):
        want = np.lexsort((ids, -score[i]))[:7]
        assert sorted(ids[col[row == i]]) == sorted(ids[want])
    q, c = rng.integers(0, 5, 400), rng.integers(0, 60, 400)
    s = (c * 7 % 11).astype(float)
    got = list(zip(*ann.leaders(q, c, s, 9)))
    for i in range(5):
        mine = sorted({(-(x * 7 % 11), x) for x in c[q == i].tolist()})[:9]
        assert [(-b, int(a)) for k, a, b in got if k == i] == [(m, x) for m, x in mine]


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 3), (3, 2)])
def test_hilbert_is_a_continuous_bijection(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = ann.hilbert(cells, bits)
    assert sorted(place) == list(range(side**dims))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
