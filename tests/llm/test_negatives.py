import math

import numpy as np
import pytest

from driftfield.llm import negatives


def brute(rows):
    """Straight from the definition, on Python's whole numbers."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), o, b) for b, (o, _, w) in enumerate(kept) if b != a]
        for p, positive, _ in sorted(s for s in scores if kept[s[2]][1] == label)[:5]:
            worse = sorted(s for s in scores if kept[s[2]][1] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out += [(i, positive, r + 1, o, -p, -s) for r, (s, o, _) in enumerate(worse)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v") for r in rows], "vec_id long, embedding array<float>, label int, ids int, variant string").repartition(4)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(n, dim, spread, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dim))
    x = middle[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    return [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim,spread", [(6, 0.1), (16, 1.0)])
def test_equals_all_pairs_with_many_cells_groups_and_slices(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(negatives, "CELL", 40)
    rows = clustered(1300, dim, spread, dim)
    want = brute(rows)
    assert len(want) > 300 and got(negatives.hard_negatives(frame(spark, rows), group=3, slice_rows=150)) == want


def test_repeated_rows_ties_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, (i % 3) / 2], i % 2) for i in range(0, 60)] + [(100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (200, [1.0, 0.5], 0), (200, [0.5, 1.0], 1), (300, [-1.0, -1.0], 1), (400, [0.0, 0.0], 0)]
    rows += [(14, [1.0, 0.25], 9), (21, [1.0, 0.25], 9)] * 2 + [(5, [0.6, 0.3], 0)] * 15 + [(6, [1.0, 0.5], 1)] * 9
    bad = [(None, [1.0, 1.0], 1), (500, None, 1), (600, [1.0, 1.0], None), (700, [nan, 1.0], 1), (800, [inf, 1.0], 1), (900, [None, 1.0], 1), (1000, [], 1)]
    assert got(negatives.hard_negatives(frame(spark, rows + bad + [(1100, [1.0], 1)]))) == brute(rows)


def test_one_vector_holds_a_third_of_all_rows(spark):
    rows = clustered(400, 5, 0.3, 1) + [(i, [0.7, 0.1, 0.3, 0.2, 0.9], i % 3) for i in range(400, 600)]
    assert got(negatives.hard_negatives(frame(spark, rows))) == brute(rows)


def test_empty_and_lonely(spark):
    few = frame(spark, [(100, [1.0, 2.0], 1)])
    assert got(negatives.hard_negatives(few.where("false"))) == [] and got(negatives.hard_negatives(few)) == []
    assert got(negatives.hard_negatives(frame(spark, [(100, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]))) == []


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-50, 50, (40, 5)).astype(float), rng.integers(-50, 50, (300, 5)).astype(float)
    square = float((x**2).sum(1).max())
    pivots, full = negatives.augmented(x[:9], square, False), negatives.augmented(x, square, False)
    away = np.sqrt(((full[:, None] - pivots[None]) ** 2).sum(2))
    mine = np.sqrt(((negatives.augmented(q, square, True)[:, None] - pivots[None]) ** 2).sum(2))
    size = (q**2).sum(1)
    for i in range(40):
        cell = np.array([mine[i].argmin()])
        s = x @ q[i]
        low, high = np.quantile(s, [0.6, 0.8])
        inner, outer = negatives.reach(pivots, square, cell, mine[i].min(keepdims=True), size[i : i + 1], size[i : i + 1], np.array([low]), np.array([high]))
        of = away.argmin(1)
        served = (inner[0][of] <= away.min(1)) & (away.min(1) <= outer[0][of])
        assert served[(s >= low) & (s <= high)].all()


def test_sql_twin(spark):
    import duckdb

    from driftfield.llm import queries

    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view embeddings as select * from '{folder}/embeddings.parquet'")
    want = sorted(duckdb.sql(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({queries.oracle_sql()['op13_voronoi_negatives']})").fetchall())
    assert want and got(queries.op13_voronoi_negatives(spark, folder)) == want
