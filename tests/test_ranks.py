"""Order statistics, neighbours and numbers within sessions that no single task holds."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftfield.operators import decoding, ranks, reports, tracks


@pytest.mark.parametrize("small,count", [(1 << 20, None), (5, 64), (1, 1000)])
def test_medians_equal_those_of_numpy(spark, small, count):
    rng = np.random.default_rng(0)
    groups = {"even": rng.normal(size=200), "odd": rng.normal(size=151), "ties": rng.integers(0, 3, 120).astype(float), "one": [4.25], "two": [1.0, 2.0], "same": [7.5] * 90, "tail": np.concatenate((rng.uniform(0, 1e-6, 99), [1e12])), "wide": 10.0 ** rng.uniform(-4, 4, 77)}
    rows = [(g, 1, float(v)) for g, vs in groups.items() for v in vs] + [("even", 1, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "session string, n int, step double").repartition(6)
    got = {r.session: r.median for r in ranks.group_medians(df, ["session"], "step", small=small, ranges=count or 1024).collect()}
    assert got.pop("none", None) is None and got.keys() == groups.keys()
    assert all(got[g] == pytest.approx(float(np.median(v)), rel=1e-12) for g, v in groups.items())
    assert ranks.group_medians(df.where("false"), ["session"], "step", small=small).collect() == []


def test_no_buffer_holds_a_large_group(spark):
    df = spark.range(500).selectExpr("'a' as session", "cast(id as double) as step")
    plan = ranks.group_medians(df, ["session"], "step", small=10, ranges=8)._jdf.queryExecution().toString()
    assert "median(" not in plan and "percentile" not in plan


def samples(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(s, i, float(t), float(x), float(y)) for s in ("a", "b") for i, (t, x, y) in enumerate(zip(np.sort(rng.uniform(0, 3000, n)), rng.normal(size=n), rng.normal(size=n)))]
    return rows, spark.createDataFrame(rows, "session string, frame_idx long, t double, x double, y double").repartition(5)


@pytest.mark.parametrize("block,half", [(4096, 2), (7, 2), (5, 3), (4, 1)])
def test_filtered_positions_over_blocks(spark, monkeypatch, block, half):
    monkeypatch.setattr(tracks, "BLOCK", block)
    rows, df = samples(spark, 60)
    rows += [("c", 0, 5.0, 1.0, 2.0)]
    df = df.unionByName(spark.createDataFrame(rows[-1:], df.schema))
    got = {(r.session, r.frame_idx): (r.x_smooth, r.y_smooth) for r in tracks.robust_position(df, half).collect()}
    for s in "abc":
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[2])
        for k in (3, 4):
            v = np.pad([r[k] for r in mine], half, mode="edge")
            for i, r in enumerate(mine):
                assert got[s, r[1]][k - 3] == np.median(v[i : i + 2 * half + 1])
    assert len(got) == 121


@pytest.mark.parametrize("blocks", [1, 4, 7, 400])
def test_drift_blocks_are_tiles(spark, blocks):
    _, df = samples(spark, 150)
    w = Window.partitionBy("session").orderBy("t")
    want = {(r.session, r.block): (r.n, r.m) for r in df.withColumn("block", F.ntile(blocks).over(w) - 1).groupBy("session", "block").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m")).collect()}
    got = {(r.session, r.block): (r.marks, r.mean_x) for r in reports.drift_blocks(df, ["x"], blocks).collect()}
    assert got.keys() == want.keys() and all(got[k] == (n, pytest.approx(v)) for k, (n, v) in want.items())


def test_free_time_over_many_cells(spark):
    rng = np.random.default_rng(3)
    spikes = [(s, float(t), 0, i) for s in "ab" for i, t in enumerate((0.0, 20_000.0))]
    events = [(s, i, float(a), float(a + rng.uniform(1, 900))) for s in "ab" for i, a in enumerate(rng.uniform(0, 19_000, 25))]
    runs = [(s, float(a), float(a + rng.uniform(50, 4000))) for s in "ab" for a in rng.uniform(0, 19_000, 6)]
    sp = spark.createDataFrame(spikes, "session string, t double, cell_id int, spike_row long")
    ev = spark.createDataFrame(events, "session string, event_index long, start double, end double")
    ru = spark.createDataFrame(runs, "session string, start double, end double")

    def free(low, high, taken):
        out = []
        for a, b in sorted(taken):
            if a > low:
                out.append((low, min(a, high)))
            low = max(low, b)
        return [(a, b) for a, b in [*out, (low, high)] if b > a]

    got = decoding.free_intervals(ev, sp).orderBy("session", "low").collect()
    want = [(s, a, b) for s in "ab" for a, b in free(0.0, 20_000.0, [(x[2], x[3]) for x in events if x[0] == s])]
    assert [(r.session, r.low, r.high) for r in got] == want and len({(r.session, r.gap) for r in got}) == len(got)
    bits = lambda s: {k for k in range(240_000) if any(x[0] == s and x[1] <= k / 10 < x[2] for x in runs) and not any(x[0] == s and x[2] <= k / 10 < x[3] for x in events)}
    gaps = decoding.base_gaps(ru, ev.select("session", "start", "end")).collect()
    for s in "ab":
        assert {k for r in gaps if r.session == s for k in range(int(np.ceil(r.low * 10)), int(np.ceil(r.high * 10)))} == bits(s)
