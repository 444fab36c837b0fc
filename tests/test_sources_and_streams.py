import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield import streaming
from driftfield.functions import evidence as ev
from driftfield.operators import models as m
from driftfield.operators.tracks import Grid
from driftfield.sources import files


def pos_file(records):
    body = b"".join(np.array([(i, v)], files.POSITION_RECORD).tobytes() for i, v in records)
    return b"pixels_per_metre 200\r\nsample_rate 50.0 hz\r\nnum_pos_samples %d\r\ndata_start" % len(records) + body + b"\r\ndata_end\r\n"


def test_positions(spark, tmp_path):
    n = files.NO_LIGHT
    (tmp_path / "a.pos").write_bytes(pos_file([(0, [100, 200, 300, 400, 0, 0, 0, 0]), (1, [n, n, 300, 400, 0, 0, 0, 0]), (2, [n] * 8)]))
    rows = files.read_positions(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [(r.session, r.t, r.x, r.y) for r in rows] == [("a", 0.0, 100.0, 150.0), ("a", 0.02, 150.0, 200.0), ("a", 0.04, None, None)]
    with pytest.raises(ValueError):
        files.positions(pos_file([(0, [0] * 8)])[:-14])


def test_settings_cuts_signal_and_manifest(spark, tmp_path):
    (tmp_path / "a.set").write_text("timebase 96000 hz\r\ntrial_date Monday, 1 Jan\r\n")
    (tmp_path / "a_1.cut").write_text("n_clusters: 3\nExact_cut_for: a.1 spikes: 3\n 1 0 2\n")
    (tmp_path / "a.egf").write_bytes(b"sample_rate 4800 hz\r\ndata_start" + np.array([1, -2, 300], ">i2").tobytes() + b"\r\ndata_end\r\n")
    assert {(r.key, r.value) for r in files.read_settings(spark, str(tmp_path)).collect()} == {("timebase", "96000 hz"), ("trial_date", "Monday, 1 Jan")}
    assert [(r.session, r.tetrode, r.spike_row, r.cluster) for r in files.read_cuts(spark, str(tmp_path)).orderBy("spike_row").collect()] == [("a", 1, 0, 1), ("a", 1, 1, 0), ("a", 1, 2, 2)]
    assert [r.value for r in files.read_signal(spark, str(tmp_path)).orderBy("sample").collect()] == [1, -2, 300]
    assert files.manifest(spark, str(tmp_path)).count() == 3


def test_score_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("session,model,log_evidence,ok\nr1,random,-3.5,False\nr1,n/a,NaN,1\n,nan,,weird\n")
    rows = files.read_scores(spark, str(tmp_path / "s.csv"), "session string, model string, log_evidence double, ok string", ("ok",)).collect()
    assert [(r.session, r.model, r.log_evidence, r.ok) for r in rows] == [("r1", "random", -3.5, False), ("r1", None, None, True), (None, None, None, False)]
    a = spark.createDataFrame([(1, "x")], "v int, setting string")
    assert files.union_shards([a, a], ["setting"]).count() == 2
    with pytest.raises(ValueError):
        files.union_shards([a, a.withColumn("setting", F.lit("y"))], ["setting"])
    files.write_tables({"t": a.withColumn("l", F.array(F.lit(1), F.lit(2)))}, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out/t"), header=True).first().l == "1,2"


def test_support_labels(spark):
    rows = [(None, "x", "truncated_full_grid; "), ("success", "x", "truncated_full_grid"), ("failed", "random", None), ("", "random", None), ("success", "x", None), ("SUCCESS ", "stationary", "exact_full_grid")]
    df = spark.createDataFrame(rows, "status string, model string, label string")
    one = [r[0] for r in df.select(ev.support(F.col("status"), F.col("model"), [F.col("label")])).collect()]
    held = [r[0] for r in df.select(ev.support(F.col("status"), F.col("model"), [F.col("label")], heldout=True)).collect()]
    assert one == [ev.UNKNOWN, ev.TRUNCATED, ev.NOT_SCORED, ev.EXACT, ev.UNKNOWN, ev.EXACT] and held[1] == ev.RESTRICTED


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_windows(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}", s % 2) for s in (1, 5, 19, 21, 45)] + [("a", "2024-01-01 02:00:00", 0)]
    spark.createDataFrame(rows, "session string, ts string, cell_id int").selectExpr("session", "cast(ts as timestamp) as ts", "cell_id").write.parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema("session string, ts timestamp, cell_id int").parquet(str(tmp_path / "s"))
    got = {(r.cell_id, r.bin_start.second, r.n) for r in run_stream(streaming.binned_counts(stream()), "w1", "complete") if r.bin_start.hour == 0}
    assert got == {(1, 0, 3), (1, 20, 1), (1, 40, 1)}
    assert {r.samples for r in run_stream(streaming.runs(stream()), "w2", "complete")} == {5, 1}
    assert sum(r.n for r in run_stream(streaming.sliding_counts(stream()), "w3", "complete")) == 12


def test_causal_evidence_ends_at_the_whole_event(spark, tmp_path):
    grid, rng = Grid(0.0, 0.0, 10.0, 2, 2), np.random.default_rng(0)
    ll = rng.normal(size=(5, 4))
    spark.createDataFrame([("s", 1, t, ll[t].tolist()) for t in range(5)], "session string, event_index long, t_idx int, ll array<double>").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("session string, event_index long, t_idx int, ll array<double>").option("maxFilesPerTrigger", 1000).parquet(str(tmp_path / "e"))
    rows = sorted(run_stream(streaming.causal_evidence(stream, grid, 12.0, 1.0), "w4"), key=lambda r: r.t_idx)
    e = lambda n: m.Event(ll[:n], m.centres_of(grid), np.ones(n - 1), 1.0, m.Motion(diffusion=12.0))
    assert [r.diffusion for r in rows] == pytest.approx([m.diffusion(e(n))[0] for n in range(1, 6)])
    assert [r.random for r in rows] == pytest.approx([m.random(e(n))[0] for n in range(1, 6)])


def test_causal_evidence_of_an_impossible_bin(spark, tmp_path):
    grid = Grid(0.0, 0.0, 10.0, 2, 2)
    ll = [[0.0] * 4, [float("-inf")] * 4, [0.0] * 4]
    spark.createDataFrame([("s", 1, t, x) for t, x in enumerate(ll)], "session string, event_index long, t_idx int, ll array<double>").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("session string, event_index long, t_idx int, ll array<double>").option("maxFilesPerTrigger", 1000).parquet(str(tmp_path / "e"))
    rows = sorted(run_stream(streaming.causal_evidence(stream, grid, 12.0, 1.0), "w5"), key=lambda r: r.t_idx)
    assert [r.diffusion for r in rows] == [r.random for r in rows] == [0.0, float("-inf"), float("-inf")]


def test_spikes_meet_events_as_both_arrive(spark, tmp_path):
    import datetime as dt

    rng, base = np.random.default_rng(0), dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=float(s))
    spikes = [(f"s{i % 2}", at(round(t, 3)), i % 3, i) for i, t in enumerate(rng.uniform(0, 100, 400))]
    events = [(f"s{i % 2}", i // 2, at(a), at(a + d)) for i, (a, d) in enumerate([(3.0, 2.0), (1.5, 0.5), (50.0, 25.0), (60.0, 5.0), (80.0, 5.0), (80.0, 0.0)])]
    kinds = ("session string, ts timestamp, cell_id int, spike_row long", "session string, event_index long, start timestamp, end timestamp")
    for name, rows, kind in (("spikes", spikes, kinds[0]), ("events", events, kinds[1])):
        order = rng.permutation(len(rows))
        for k in range(4):  # arrival in another order than time
            spark.createDataFrame([rows[i] for i in order[k::4]], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    joined = streaming.event_spike_join(read("spikes", kinds[0]), read("events", kinds[1]), "5 seconds", "10 minutes")
    q = joined.writeStream.format("memory").queryName("w6").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.session, r.event_index, r.spike_row) for r in spark.table("w6").collect())
    want = sorted((s, e, row) for s, e, a, b in events for s2, t, _, row in spikes if s == s2 and a <= t < b)
    assert got == want and len(want) > 50


def test_state_of_the_join_is_dropped(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    for k in range(3):
        when = base + dt.timedelta(hours=k)
        spark.createDataFrame([("s", when, 1, k)], "session string, ts timestamp, cell_id int, spike_row long").coalesce(1).write.mode("append").parquet(str(tmp_path / "spikes"))
        spark.createDataFrame([("s", k, when, when + dt.timedelta(seconds=2))], "session string, event_index long, start timestamp, end timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    read = lambda name, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    joined = streaming.event_spike_join(read("spikes", "session string, ts timestamp, cell_id int, spike_row long"), read("events", "session string, event_index long, start timestamp, end timestamp"))
    q = joined.writeStream.format("memory").queryName("w7").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w7").count() == 3
    assert sum(x["numRowsTotal"] for x in q.lastProgress["stateOperators"]) < 6


def test_records_are_read_by_ranges(spark, tmp_path):
    from driftfield.sources import records

    rng = np.random.default_rng(1)
    n, samples = 1000, 50
    body = np.zeros(n, np.dtype([("c", [("t", ">u4"), ("v", "i1", (samples,))], (4,))]))
    body["c"]["t"] = (np.arange(n) * 960)[:, None]
    body["c"]["v"] = rng.integers(-128, 128, (n, 4, samples))
    head = b"timebase 96000 hz\r\nsamples_per_spike 50\r\nnum_spikes 990\r\n"
    (tmp_path / "day1").mkdir()
    (tmp_path / "day1" / "rat7.3").write_bytes(head + b"data_start" + body.tobytes() + b"\r\ndata_end\r\n")
    (tmp_path / "day1" / "rat7.eeg").write_bytes(b"no such records")
    df = records.read_records(spark, str(tmp_path), "tetrode", split_bytes=216 * 64)
    assert df.rdd.getNumPartitions() == 16  # a partition is a range of 64 records
    rows = sorted(df.collect(), key=lambda r: r.spike_row)
    assert len(rows) == 990 and {(r.session, r.tetrode) for r in rows} == {("rat7", 3)}
    assert [r.spike_row for r in rows] == list(range(990)) and rows[7].t == pytest.approx(0.07)
    assert rows[500].waveform == body["c"]["v"][500].ravel().tolist()
    marks = {r.mark_id: r for r in records.peak_marks(df).collect()}
    for i in (0, 989):
        v = body["c"]["v"][i].astype(int)
        m = marks[i * 1024 + 3]
        assert [m.f1, m.f2, m.f3, m.f4] == (v.max(1) - v.min(1)).tolist() and m.grp == 3
    pos = np.zeros(50, records.POSITION_RECORD)
    pos["frame"], pos["v"] = np.arange(50), rng.integers(0, 500, (50, 8))
    pos["v"][3, :2], pos["v"][4, :4] = 1023, 1023
    (tmp_path / "rat7.pos").write_bytes(b"pixels_per_metre 300\r\nsample_rate 50 hz\r\ndata_start" + pos.tobytes() + b"\r\ndata_end\r\n")
    key = lambda r: (r.session, r.frame_idx)
    assert sorted(records.read_records(spark, f"file://{tmp_path}", "position", split_bytes=100).collect(), key=key) == sorted(files.read_positions(spark, str(tmp_path)).collect(), key=key)
    egf = rng.integers(-999, 999, 333).astype(">i2")
    (tmp_path / "rat7.egf").write_bytes(b"sample_rate 4800 hz\r\ndata_start" + egf.tobytes() + b"\r\ndata_end\r\n")
    got = sorted(records.read_records(spark, str(tmp_path), "signal", split_bytes=64).collect(), key=lambda r: r.sample)
    assert [r.value for r in got] == egf.tolist() and got[-1].t == pytest.approx(332 / 4800)
    (tmp_path / "bad.egf").write_bytes(b"sample_rate 4800 hz\r\ndata_start123")
    with pytest.raises(Exception, match="no end mark"):
        records.read_records(spark, str(tmp_path), "signal").collect()
    (tmp_path / "none").mkdir()
    assert records.read_records(spark, str(tmp_path / "none"), "tetrode").collect() == []
    with pytest.raises(ValueError):
        records.read_records(spark, str(tmp_path), "music")


def test_sessions_are_found(spark, tmp_path):
    for name in ("Rat2/Open1/a.bin", "Rat1/Open2/a.bin", "Rat1/Open2/b.bin", "Rat9/Open1/a.bin", "Rat1/Linear/a.bin"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"12345")
    got = [(r.session, r.rat, r.files, r.bytes) for r in files.discover_sessions(spark, str(tmp_path)).collect()]
    assert got == [("Rat1/Open2", "Rat1", 2, 10), ("Rat2/Open1", "Rat2", 1, 5)]


def test_malformed_score_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text("session,event_index,log_evidence\na,1,-2.5\nb,x,nan\nc,3,\n")
    shape = "session string, event_index long, log_evidence double"
    assert len(files.read_scores(spark, str(tmp_path), shape, malformed="drop").collect()) == 2
    marked = {r.session: r for r in files.read_scores(spark, str(tmp_path), shape, malformed="mark").collect()}
    assert marked["b"].malformed_row and marked["a"].malformed_row is None and marked["c"].log_evidence is None
    with pytest.raises(Exception):
        files.read_scores(spark, str(tmp_path), shape).collect()


def test_settings_and_reports_as_text(spark):
    assert files.settings_text({"b": {"x": 1, "a": "é: #"}, "a": [True, None, 0.5], "c": {}}) == 'a: [true, null, 0.5]\nb:\n  a: "é: #"\n  x: 1\nc: {}\n'
    text = files.report_text("Run", {"t": spark.createDataFrame([("a|b", 0.123456789), (None, 2.0)], "n string, v double")}, 1)
    assert text.splitlines()[:6] == ["# Run", "", "## t", "", "| n | v |", "|---|---|"] and "a\\|b | 0.123457" in text and "First 1 rows." in text
