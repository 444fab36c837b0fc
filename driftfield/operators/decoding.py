"""Cross-validated position decoding, and null windows matched to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rounds import written
from .models import centres_of, emissions
from .resampling import draw
from .tracks import CELL, Grid, _cells, merge_intervals, numbered_runs, rate_map, spikes_of, time_cell, with_neighbours


def decode_positions(position: DataFrame, spikes: DataFrame, grid: Grid, width: float, folds: int = 3) -> DataFrame:
    """One row per window: true and decoded places, their distance, and the true place's probability and rank.

    Time is cut into as many blocks as folds; a window is decoded with the rate map of all
    other blocks' samples and spikes. A window that two blocks share is cut where they meet,
    so that none is decoded with a map of its own samples. Windows hold at least one sample;
    their number is that of the whole window times the folds, plus the fold.
    """
    ends = position.groupBy("session").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    block = F.least(F.lit(folds - 1), F.floor((F.col("t") - F.col("_a")) / (F.col("_b") - F.col("_a") + 1e-9) * folds).cast("int"))
    p = position.join(ends, "session").withColumn("fold", block).drop("_a", "_b")
    s = spikes.join(ends, "session").where((F.col("t") >= F.col("_a")) & (F.col("t") <= F.col("_b"))).withColumn("fold", block).drop("_a", "_b")
    windows = p.groupBy("session", F.floor(F.col("t") / width).cast("long").alias("_w"), "fold").agg(F.avg("x").alias("true_x"), F.avg("y").alias("true_y")).join(ends, "session")
    edge = lambda k: F.col("_a") + (F.col("_b") - F.col("_a") + 1e-9) / folds * k
    low, high = F.when(F.col("fold") > 0, edge(F.col("fold"))), F.when(F.col("fold") < folds - 1, edge(F.col("fold") + 1))
    windows = windows.withColumn("start", F.greatest(F.col("_w") * width, low)).withColumn("end", F.least((F.col("_w") + 1) * width, high))
    windows = windows.withColumn("event_index", F.col("_w") * folds + F.col("fold")).drop("_w", "_a", "_b")
    parts = []
    for f in range(folds):
        rates = rate_map(p.where(F.col("fold") != f).drop("fold"), s.where(F.col("fold") != f).drop("fold"), grid)
        parts.append(emissions(spikes, windows.where(F.col("fold") == f).select("session", "event_index", "start", "end"), rates, grid, width))
    ll = parts[0]
    for more in parts[1:]:
        ll = ll.unionByName(more)
    top = F.array_max("ll")
    post = ll.withColumn("_e", F.transform("ll", lambda v: F.exp(v - top))).withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, v: a + v))
    post = post.withColumn("p", F.transform("_e", lambda v: v / F.col("_z"))).join(windows, ["session", "event_index"])
    centres = centres_of(grid)
    for k, c in enumerate("xy"):
        at = F.array(*[F.lit(float(v)) for v in centres[:, k]])
        post = post.withColumn(f"mean_{c}", F.aggregate(F.zip_with("p", at, lambda a, v: a * v), F.lit(0.0), lambda a, v: a + v)).withColumn(f"map_{c}", at[(F.array_position("p", F.array_max("p")) - 1).cast("int")])
    post = post.withColumn("true_bin", grid.bin(F.col("true_x"), F.col("true_y"))).withColumn("true_probability", F.col("p")[F.col("true_bin")])
    rank = 1 + F.size(F.filter("p", lambda v: v > F.col("true_probability")))
    gap = lambda a: F.sqrt(F.pow(F.col(f"{a}_x") - F.col("true_x"), 2) + F.pow(F.col(f"{a}_y") - F.col("true_y"), 2))
    return post.select("session", "fold", F.col("event_index").alias("window_index"), "n_spikes", "true_x", "true_y", "mean_x", "mean_y", "map_x", "map_y", gap("mean").alias("mean_error"), gap("map").alias("map_error"), "true_bin", "true_probability", rank.alias("true_rank"), (rank / F.lit(grid.nx * grid.ny)).alias("rank_fraction"))


def decoding_summary(windows: DataFrame, by: tuple[str, ...] = ("session",)) -> DataFrame:
    """Windows, folds, median errors, the true place's mean probability and median rank, and spikes a window, of rows of `decode_positions`."""
    medians = {"mean_error": "median_mean_error", "map_error": "median_map_error", "true_rank": "median_true_rank"}
    return windows.where("true_bin >= 0").groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("fold").alias("folds"), *[F.median(c).alias(n) for c, n in medians.items()],
        F.avg("true_probability").alias("mean_true_probability"), F.avg("n_spikes").alias("mean_spikes"))


def matched_null_windows(events: DataFrame, spikes: DataFrame, keep: int, draws: int = 32) -> DataFrame:
    """For each event up to `keep` windows of its length elsewhere in its session, closest in spike count.

    Starts are drawn by digest over the session; those that touch any event are left out.
    Ties in the difference of counts go to the earlier draw. Work is `draws` windows an event.
    """
    span = spikes.groupBy("session").agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    own = events.join(span, "session").withColumn("_dur", F.col("end") - F.col("start"))
    drawn = own.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    start = F.col("_low") + draw("null", F.col("session"), F.col("event_index"), F.col("draw")) * F.greatest(F.lit(0.0), F.col("_high") - F.col("_low") - F.col("_dur"))
    drawn = drawn.select("session", "event_index", "draw", start.alias("start"), (start + F.col("_dur")).alias("end"))
    taken = events.select(F.col("session").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"), _cells(F.col("start"), F.col("end")).alias("_c"))
    touched = drawn.withColumn("_cell", _cells(F.col("start"), F.col("end"))).join(taken, (F.col("session") == F.col("_s")) & (F.col("_cell") == F.col("_c")) & (F.col("start") < F.col("_b")) & (F.col("end") > F.col("_a")), "left_semi").select("session", "event_index", "draw").distinct()
    free = drawn.join(touched, ["session", "event_index", "draw"], "left_anti")
    # events are numbered within their session
    named = free.withColumn("event_index", F.struct("event_index", "draw"))
    n = spikes_of(spikes, named.select("session", "event_index", "start", "end")).groupBy("session", "event_index").agg(F.sum("n").alias("null_spikes")).select("session", "event_index.*", "null_spikes")
    m = spikes_of(spikes, events).groupBy("session", "event_index").agg(F.sum("n").alias("n_spikes"))
    both = free.join(n, ["session", "event_index", "draw"], "left").select("session", "event_index", "draw", "start", "end", F.coalesce("null_spikes", F.lit(0)).alias("null_spikes"))
    both = both.join(m, ["session", "event_index"], "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))
    w = Window.partitionBy("session", "event_index").orderBy(F.abs(F.col("n_spikes") - F.col("null_spikes")), "draw")
    return both.withColumn("match", F.row_number().over(w)).where(F.col("match") <= keep)


def free_intervals(events: DataFrame, spikes: DataFrame) -> DataFrame:
    """The parts of each session's span of spikes that no event covers, numbered in time order."""
    span = spikes.groupBy("session").agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    merged = with_neighbours(merge_intervals(events.select("session", "start", "end")).withColumn("t", F.col("start")), []).withColumn("_next", F.col("next.t"))
    taken = numbered_runs(merged.withColumn("_cell", time_cell()), F.lit(1), "_n", "session", ["t"]).drop("_cell", "prev", "next", "t")
    after = taken.join(span, "session").select("session", F.col("_n").alias("gap"), F.greatest("end", "_low").alias("low"), F.least(F.coalesce("_next", "_high"), "_high").alias("high"))
    before = taken.where("_n = 1").join(span, "session").select("session", F.lit(0).alias("gap"), F.col("_low").alias("low"), F.least("start", "_high").alias("high"))
    return after.unionByName(before).where("high > low")


def count_spikes(windows: DataFrame, spikes: DataFrame, keys: list[str]) -> DataFrame:
    """Spikes with start <= t < end of each window, as the difference of two prefix counts.

    Bounds and spikes are merged in time order within a time cell, and a table of one row
    a cell adds what lies before it, so that no window meets its spikes.
    """
    ends = windows.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(-1).alias("_side")), F.struct(F.col("end").alias("t"), F.lit(1).alias("_side")))).alias("_e"))
    both = ends.select(*keys, "_e.t", "_e._side", F.lit(0).alias("_one")).unionByName(spikes.select("session", "t", F.lit(1).alias("_one")), allowMissingColumns=True)
    both = both.withColumn("_cell", F.floor(F.col("t") / CELL))
    order = Window.partitionBy("session").orderBy("_cell")
    cells = both.groupBy("session", "_cell").agg(F.sum("_one").alias("_in")).withColumn("_before", F.sum("_in").over(order) - F.col("_in")).drop("_in")
    # a spike at a bound comes after it
    at = both.withColumn("_at", F.sum("_one").over(Window.partitionBy("session", "_cell").orderBy("t", "_one").rowsBetween(Window.unboundedPreceding, 0)))
    at = at.where("_one = 0").join(cells, ["session", "_cell"])
    return at.groupBy(*keys).agg(F.sum(F.col("_side") * (F.col("_at") + F.col("_before"))).alias("spikes"))


def searched_null_windows(events: DataFrame, spikes: DataFrame, keep: int, deal: int = 32) -> DataFrame:
    """For each event the `keep` windows of its length that match it best, of all that touch no event.

    Starts go through every free interval of the session in steps of half the event's
    length. The order is the difference of spike counts, then of active cells, then a
    digest. Events without a match have one row that gives the reason. Work is a row
    for each event and start; `deal` only spreads a session's events over tasks.
    """
    long = events.withColumn("_dur", F.col("end") - F.col("start"))
    gaps = written(free_intervals(events, spikes), "gaps").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    own = long.where("_dur > 0").select("session", "event_index", "_dur", F.pmod(F.hash("event_index"), F.lit(deal)).alias("_deal"))
    step = F.greatest(F.col("_dur") / 2, F.lit(0.001))
    met = own.join(gaps, ["session", "_deal"]).where(F.col("high") - F.col("low") >= F.col("_dur"))
    met = met.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low") - F.col("_dur")) / step))))
    start = F.col("low") + F.col("k") * step
    windows = met.select("session", "event_index", "gap", "k", start.alias("start"), (start + F.col("_dur")).alias("end"))
    # the events' own windows are counted along, as gap -1
    real = events.select("session", "event_index", F.lit(-1).alias("gap"), F.lit(0).cast("long").alias("k"), "start", "end")
    keys = ["session", "event_index", "gap", "k"]
    counted = windows.unionByName(real).join(count_spikes(windows.unionByName(real), spikes, keys), keys)
    event = Window.partitionBy("session", "event_index")
    counted = counted.withColumn("n_spikes", F.max(F.when(F.col("gap") < 0, F.col("spikes"))).over(event)).withColumn("candidates", F.count(F.lit(1)).over(event) - 1)
    counted = counted.withColumn("_off", F.when(F.col("gap") >= 0, F.abs(F.col("n_spikes") - F.col("spikes"))))
    # ties at the last place stay until active cells are known; an event's own window, whose difference is null, stays too
    near = counted.withColumn("_rank", F.rank().over(event.orderBy(F.col("_off").asc_nulls_first()))).where(F.col("_rank") <= keep + 1).drop("_rank")
    named = near.select("session", "event_index", "gap", "k", "start", "end")
    fired = spikes_of(spikes, named.select("session", F.struct("event_index", "gap", "k").alias("event_index"), "start", "end"), "cell_id").groupBy("session", "event_index").agg(F.countDistinct("cell_id").alias("active"))
    fired = fired.select("session", "event_index.*", "active")
    near = near.join(fired, keys, "left").withColumn("active", F.coalesce("active", F.lit(0).cast("long")))
    near = near.withColumn("n_active", F.max(F.when(F.col("gap") < 0, F.col("active"))).over(event)).where("gap >= 0")
    w = event.orderBy("_off", F.abs(F.col("n_active") - F.col("active")), draw("null", F.col("session"), F.col("event_index"), F.col("gap"), F.col("k")), "gap", "k")
    best = near.withColumn("match", F.row_number().over(w)).where(F.col("match") <= keep)
    best = best.select("session", "event_index", "match", F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("spikes").alias("null_spikes"), F.col("active").alias("null_active"), "candidates")
    out = long.join(best, ["session", "event_index"], "left")
    reason = F.when(F.col("match").isNotNull(), None).when(F.col("_dur") > 0, "no free window").otherwise("no duration")
    return out.select("session", "event_index", "match", F.col("_start").alias("start"), F.col("_end").alias("end"), "null_spikes", "null_active", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), reason.alias("reason"))


def base_gaps(base: DataFrame, taken: DataFrame) -> DataFrame:
    """The parts of the merged base intervals that no merged taken interval covers: session, low, high.

    Edges of both are merged in time order, and a running count tells where a base interval
    is open and no taken one.
    """
    edge = lambda df, kind: df.select("session", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("e"), F.lit(kind).alias("k")).select("session", "e.t", F.when(F.col("k") == 0, F.col("e.d")).otherwise(0).alias("b"), F.when(F.col("k") == 1, F.col("e.d")).otherwise(0).alias("x"))
    edges = edge(merge_intervals(base.select("session", "start", "end")), 0).unionByName(edge(merge_intervals(taken.select("session", "start", "end")), 1))
    steps = edges.groupBy("session", "t").agg(F.sum("b").alias("b"), F.sum("x").alias("x"))
    s = with_neighbours(steps, []).withColumn("high", F.col("next.t")).drop("prev", "next").withColumn("_cell", time_cell())
    for change, out in (("b", "_open"), ("x", "_shut")):
        s = numbered_runs(s, F.col(change), out, "session", ["t"])
    s = s.withColumn("_free", (F.col("_open") > 0) & (F.col("_shut") == 0))
    # neighbouring free pieces, where one base interval ends as another begins, are merged already
    return s.where("_free and high > t").select("session", F.col("t").alias("low"), "high")


def matched_windows(events: DataFrame, spikes: DataFrame, keep: int, runs: DataFrame | None = None, padding: float = 0.0, tolerance: float = 0.1, cells: int | None = None, step: float | None = None, deal: int = 32) -> DataFrame:
    """For each event up to `keep` windows of its length, matched in spikes and active cells.

    Windows lie in the runs, or in the span of the session's spikes, and clear of all events
    widened by the padding; their starts go through every free interval by `step`, or half
    the event's length. Windows within max(1, tolerance * spikes) of the event's spikes,
    and within `cells` of its active cells, are taken; where fewer than `keep` are, all are
    candidates. The order is the difference of spikes, then of cells, then the start.
    Events without any free window have no row.
    """
    if runs is None:
        runs = spikes.groupBy("session").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    taken = events.select("session", (F.col("start") - padding).alias("start"), (F.col("end") + padding).alias("end"))
    gaps = written(base_gaps(runs, taken), "gaps").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    own = events.withColumn("_dur", F.col("end") - F.col("start")).where("_dur > 0").select("session", "event_index", "_dur", F.pmod(F.hash("event_index"), F.lit(deal)).alias("_deal"))
    by = F.lit(float(step)) if step else F.greatest(F.col("_dur") / 2, F.lit(0.001))
    met = own.join(gaps, ["session", "_deal"]).where(F.col("high") - F.col("low") >= F.col("_dur"))
    met = met.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low") - F.col("_dur")) / by))))
    start = F.col("low") + F.col("k") * by
    windows = met.select("session", "event_index", "low", "k", start.alias("start"), (start + F.col("_dur")).alias("end"))
    real = events.where("end > start").select("session", "event_index", F.lit(None).cast("double").alias("low"), F.lit(-1).cast("long").alias("k"), "start", "end")
    both = windows.unionByName(real).withColumn("low", F.coalesce("low", F.lit(0.0)))
    keys = ["session", "event_index", "low", "k"]
    # events of one length share most of their windows: spikes are counted once for each
    alone = both.select("session", "start", "end").distinct()
    n = alone.join(count_spikes(alone, spikes, ["session", "start", "end"]), ["session", "start", "end"])
    named = alone.select("session", F.struct("start", "end").alias("event_index"), "start", "end")
    fired = spikes_of(spikes, named, "cell_id").groupBy("session", "event_index").agg(F.countDistinct("cell_id").alias("active")).select("session", "event_index.*", "active")
    counted = both.join(n.join(fired, ["session", "start", "end"], "left").withColumn("active", F.coalesce("active", F.lit(0).cast("long"))), ["session", "start", "end"])
    event = Window.partitionBy("session", "event_index")
    own_n = lambda c: F.max(F.when(F.col("k") < 0, F.col(c))).over(event)
    c = counted.withColumn("n_spikes", own_n("spikes")).withColumn("n_active", own_n("active")).where("k >= 0")
    off, apart = F.abs(F.col("spikes") - F.col("n_spikes")), F.abs(F.col("active") - F.col("n_active"))
    ok = off <= F.greatest(F.lit(1.0), tolerance * F.greatest(F.col("n_spikes"), F.lit(1)))
    c = c.withColumn("_ok", ok if cells is None else ok & (apart <= cells)).withColumn("_fit", F.sum(F.col("_ok").cast("long")).over(event)).withColumn("candidates", F.count(F.lit(1)).over(event))
    best = c.where(F.col("_ok") | (F.col("_fit") < keep)).withColumn("match", F.row_number().over(event.orderBy(off, apart, "start"))).where(F.col("match") <= keep)
    return best.select("session", "event_index", "match", "start", "end", F.col("spikes").alias("null_spikes"), F.col("active").alias("null_active"), "n_spikes", "n_active", "candidates", (F.col("_fit") >= keep).alias("within_tolerance"))


def window_p_values(real: DataFrame, nulls: DataFrame, value: str, keys=("session", "event_index")) -> DataFrame:
    """How often an event's matched windows reach its own value: (1 + at least as large) / (windows + 1), and where it stands among them.

    Events without windows have p = 1 and no standing.
    """
    both = real.select(*keys, F.col(value).alias("_v")).join(nulls.select(*keys, F.col(value).alias("_n")), list(keys), "left")
    g = both.groupBy(*keys).agg(F.first("_v").alias(value), F.count("_n").alias("windows"), F.sum(F.coalesce((F.col("_n") >= F.col("_v")).cast("long"), F.lit(0))).alias("at_least"), F.avg("_n").alias("null_mean"), F.stddev_samp("_n").alias("null_sd"))
    return g.withColumn("p_value", (F.col("at_least") + 1) / (F.col("windows") + 1)).withColumn("z", F.when(F.col("null_sd") > 0, (F.col(value) - F.col("null_mean")) / F.col("null_sd")))
