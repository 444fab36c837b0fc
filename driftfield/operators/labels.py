"""Behavioural labels of events: which well was visited next, what was decoded, and how both agree."""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as ev
from .resampling import draw
from .tracks import CELL, Grid, as_of, backward, in_intervals, nearest_well

EVENT = ["session", "event_index"]
#: Settings of the sensitivity grid: radius, dwell and horizon.
RADII, DWELLS, HORIZONS = (7.5, 10.0, 12.5), (0.1, 0.2, 0.4), (15.0, 30.0, 60.0)


def first_visits(events: DataFrame, position: DataFrame, wells: DataFrame, radii: tuple[float, ...], dwells: tuple[float, ...], horizons: tuple[float, ...], at: str = "peak") -> DataFrame:
    """The first run of samples within a radius of a well after each event that is long enough, up to a horizon: one row per event
    and setting, with nulls where there is none, and whether the session has wells.

    Events, samples and the session's few wells meet by blocks of time, which hold the
    samples of the block after it too, so that each horizon ends inside. Runs are found once for each well and radius of
    a block, and events look up the run that they begin in and the next one that is long enough: no row is made for a pair of sample and event.
    """
    longest = float(max(horizons))
    span, own = max(CELL, longest * 17 / 16), events.schema["event_index"].dataType.simpleString()
    block = lambda c: F.floor(F.col(c) / span).cast("long")
    e = events.select("session", "event_index", F.col(at).cast("double").alias("at"), block(at).alias("_c"))
    p = position.where(ev.finite(F.col("t")) & ev.finite(F.col("x")) & ev.finite(F.col("y"))).select("session", *[F.col(c).cast("double").alias(c) for c in "txy"], F.explode(F.array(block("t"), block("t") - 1)).alias("_c"))
    w = e.select("session", "_c").distinct().join(wells.select("session", "well_id", F.col("wx").cast("double").alias("x"), F.col("wy").cast("double").alias("y"), F.lit(True).alias("_w")), "session")
    both = p.unionByName(w, allowMissingColumns=True)
    kind = pa.int64() if wells.schema["well_id"].dataType.simpleString() == "bigint" else pa.int32()
    names = ["session", "event_index", "radius", "min_dwell", "horizon", "true_well_id", "true_well_x", "true_well_y", "arrival_time", "time_to_arrival_s", "dwell_s", "known"]
    shape = f"session string, event_index {own}, radius double, min_dwell double, horizon double, true_well_id {'bigint' if kind == pa.int64() else 'int'}, true_well_x double, true_well_y double, arrival_time double, time_to_arrival_s double, dwell_s double, known boolean"

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        well = left.column("_w").is_valid().to_numpy()
        numbers = lambda c, of: left.column(c).to_numpy(zero_copy_only=False)[of]
        t, x, y = (numbers(c, ~well).astype(float) for c in "txy")
        order = np.lexsort((y, x, t))
        t, x, y = t[order], x[order], y[order]
        ids, wx, wy = (numbers(c, well) for c in ("well_id", "x", "y"))
        line = np.argsort(ids, kind="stable")
        ids, wx, wy = ids[line].astype(np.int64), wx[line].astype(float), wy[line].astype(float)
        start = right.column("at").to_numpy(zero_copy_only=False).astype(float)  # an event without a time begins after all samples
        size, low = len(start), np.searchsorted(t, start)
        highs = {h: np.searchsorted(t, start + h, "right") for h in horizons}
        best = {s: (np.full(size, np.inf), np.zeros(size), np.full(size, -1)) for s in product(radii, dwells, horizons)}
        for i, (cx, cy) in enumerate(zip(wx, wy)):
            gap = np.sqrt((x - cx) ** 2 + (y - cy) ** 2)
            for radius in radii:
                inside = gap <= radius
                edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                if not len(first):
                    continue
                held = np.minimum(low, len(t) - 1)
                here = (low < len(t)) & inside[held]
                mine = np.where(here, last[np.maximum(np.searchsorted(first, low, "right") - 1, 0)], 0)
                for dwell in dwells:
                    enough = np.flatnonzero(t[last] - t[first] >= dwell)
                    after = np.searchsorted(first[enough], low, "right")
                    some = after < len(enough)
                    run_of = enough[np.minimum(after, len(enough) - 1)] if len(enough) else np.zeros(size, np.int64)
                    for h in horizons:
                        high = highs[h]
                        arrive, stay, at_well = best[radius, dwell, h]
                        for can, a, b in ((some, first[run_of], last[run_of]), (here, held, mine)):  # the later one first, so that the earlier one stands
                            b = np.minimum(b, high - 1)
                            can = can & (a < high)
                            long = np.where(can, t[np.maximum(b, 0)] - t[a], -1.0)
                            can &= (long >= dwell) & (t[a] < np.where(at_well == i, np.inf, arrive))
                            arrive[can], stay[can], at_well[can] = t[a][can], long[can], i
        index = right.column("event_index").combine_chunks()
        if pa.types.is_struct(index.type):  # fields that are never null are declared so by Spark, and not in the result
            index = pa.StructArray.from_arrays(index.flatten(), fields=[f.with_nullable(True) for f in index.type])
        out = []
        for (radius, dwell, h), (arrive, stay, at_well) in best.items():
            none, of = at_well < 0, np.maximum(at_well, 0)
            take = lambda v: pa.array(v[of] if len(v) else np.zeros(size, v.dtype), mask=none)
            out.append(pa.table([pa.array([key[0].as_py()] * size, pa.string()), index, *[pa.array(np.full(size, v)) for v in (radius, dwell, h)], take(ids).cast(kind), take(wx), take(wy),
                                 pa.array(arrive, mask=none), pa.array(np.where(none, 0, arrive) - start, mask=none), pa.array(stay, mask=none), pa.array(np.full(size, len(ids) > 0))], names=names))
        return pa.concat_tables(out)

    return both.groupBy("session", "_c").cogroup(e.groupBy("session", "_c")).applyInArrow(run, shape)


def visit_labels(events: DataFrame, position: DataFrame, wells: DataFrame, radius: float = 10.0, dwell: float = 0.2, horizon: float = 30.0, at: str = "peak") -> DataFrame:
    """The first well that is visited long enough after each event, or why there is none. Ties in arrival go to the smaller well."""
    return sensitivity(events, position, wells, (radius,), (dwell,), (horizon,), at).drop("radius", "min_dwell", "horizon")


def sensitivity(events: DataFrame, position: DataFrame, wells: DataFrame, radii=RADII, dwells=DWELLS, horizons=HORIZONS, at: str = "peak") -> DataFrame:
    """The labels under each setting of radius, dwell and horizon: one row per event and setting."""
    found = first_visits(events, position, wells, radii, dwells, horizons, at)
    valid = F.col("arrival_time").isNotNull()
    reason = F.when(valid, "").when(~F.col("known"), "no_well_locations").otherwise("no_visit_within_horizon")
    return found.withColumn("valid_label", valid).withColumn("exclude_reason", reason).drop("known")


def well_places(wells: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """The places that belong to each well: those within the radius, or the nearest one if there are none; a place of several wells belongs to the nearest."""
    ix = F.floor(F.col("bin_id") / grid.ny)
    cx, cy = grid.low_x + (ix + 0.5) * grid.size, grid.low_y + (F.col("bin_id") % grid.ny + 0.5) * grid.size
    each = wells.select("session", "well_id", "wx", "wy", F.explode(F.sequence(F.lit(0), F.lit(grid.nx * grid.ny - 1))).alias("bin_id"))
    each = each.withColumn("gap", F.sqrt(F.pow(cx - F.col("wx"), 2) + F.pow(cy - F.col("wy"), 2)))
    well, place = Window.partitionBy("session", "well_id"), Window.partitionBy("session", "bin_id")
    each = each.withColumn("_any", F.min("gap").over(well) <= radius).withColumn("_r", F.row_number().over(well.orderBy("gap", "bin_id")))
    owned = each.where((F.col("gap") <= radius) | (~F.col("_any") & (F.col("_r") == 1)))
    return owned.withColumn("_o", F.row_number().over(place.orderBy("gap", "well_id"))).where("_o = 1").select("session", "well_id", "bin_id")


def well_masses(posteriors: DataFrame, wells: DataFrame, grid: Grid, radius: float, keys=(*EVENT, "model"), posterior: str = "terminal") -> DataFrame:
    """The posterior mass at each well of each row's session, and the well's rank by it; a well without places has none."""
    own = well_places(wells, grid, radius).groupBy("session", "well_id").agg(F.collect_list("bin_id").alias("_b"))
    listed = wells.select("session", "well_id").distinct().join(own, ["session", "well_id"], "left")
    met = posteriors.where(F.col(posterior).isNotNull()).join(listed, "session")
    mass = F.aggregate(F.coalesce("_b", F.array().cast("array<int>")), F.lit(0.0), lambda a, b: a + F.col(posterior)[b])
    out = met.select(*keys, "well_id", mass.alias("mass"))
    w = Window.partitionBy(*keys).orderBy(F.desc("mass"))
    return out.withColumn("rank", F.rank().over(w))


def label_metrics(decoded: DataFrame, labels: DataFrame, masses: DataFrame | None = None, keys=tuple(EVENT)) -> DataFrame:
    """Decoded rows beside their labels: whether the well and the active goal are right, and how far the endpoint lies from the true well.

    decoded: keys, decoded_well_id, endpoint_x, endpoint_y and, where known, active_goal_id. Rows without a valid
    label have no metric. With masses, the true well's mass and rank come along.
    """
    both = decoded.join(labels.select(*keys, "true_well_id", "true_well_x", "true_well_y", "valid_label"), list(keys), "left")
    valid = F.coalesce("valid_label", F.lit(False))
    both = both.withColumn("goal_correct", F.when(valid, F.coalesce(F.col("decoded_well_id") == F.col("true_well_id"), F.lit(False))))
    far = F.sqrt(F.pow(F.col("endpoint_x") - F.col("true_well_x"), 2) + F.pow(F.col("endpoint_y") - F.col("true_well_y"), 2))
    both = both.withColumn("endpoint_error", F.when(valid, far))
    if "active_goal_id" in decoded.columns:
        both = both.withColumn("active_goal_correct", F.when(valid & F.col("active_goal_id").isNotNull(), F.coalesce(F.col("decoded_well_id") == F.col("active_goal_id"), F.lit(False))))
    if masses is not None:
        m = masses.withColumnsRenamed({"well_id": "true_well_id", "mass": "true_well_posterior", "rank": "true_well_rank"})
        shared = [c for c in m.columns if c in both.columns]
        both = both.join(m, shared, "left")
    return both


def behaviour_context(events: DataFrame, position: DataFrame, goals: DataFrame, wells: DataFrame, horizon: float) -> DataFrame:
    """Where the animal was at each event's peak, a horizon before and after it, the goal that was active and the nearest well."""
    offsets = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    points = events.select(*EVENT, F.col("peak").alias("_peak"), offsets.alias("k")).withColumn("t", F.col("_peak") + F.col("k") * horizon)
    placed = as_of(points, position, ["x", "y"])
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = placed.groupBy(*EVENT).agg(*[at(c, k).alias(f"{c}_{n}") for c in ("x", "y") for k, n in ((-1, "before"), (0, "now"), (1, "after"))], F.first("_peak").alias("t"))
    wide = backward(wide, goals, "well_id", "fill_t").withColumnRenamed("well_id", "active_goal_id")
    near = nearest_well(wide.withColumnsRenamed({"x_now": "x", "y_now": "y"}), wells)
    moved = F.sqrt(F.pow(F.col("x_after") - F.col("x_before"), 2) + F.pow(F.col("y_after") - F.col("y_before"), 2))
    return near.withColumnsRenamed({"x": "x_now", "y": "y_now", "well_id": "nearest_well_id", "distance": "nearest_well_distance"}).withColumn("moved", moved)


def event_ids(spec: str) -> tuple[bool, list[tuple[int, int]] | None]:
    """Reads "all", "run", "run:1-3,7" or "4,6-9": whether only events in runs count, and closed ranges of numbers, or None for all."""
    text = spec.strip().lower()
    run = text == "run" or text.startswith("run:")
    rest = text.removeprefix("run").removeprefix(":") if run else text
    if rest in ("", "all") and (run or rest == "all"):
        return run, None
    ranges = []
    for part in rest.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m or (m[2] and int(m[2]) < int(m[1])):
            raise ValueError(f"not a list of events: {spec!r}")
        ranges.append((int(m[1]), int(m[2] or m[1])))
    return run, ranges


def select_events(events: DataFrame, runs: DataFrame, which: str = "run", most: int | None = None, seed: str | None = None) -> DataFrame:
    """Events whose peak lies in a run, or all; of each session the first `most`, or with a seed as many drawn by digest.

    Numbers in the list are event indices, and for "run:" the place among the session's events in runs.
    """
    only_run, ranges = event_ids(which)
    out = events
    if only_run:
        out = in_intervals(events.withColumn("t", F.col("peak")), runs).drop("t")
    if ranges is not None:
        number = F.row_number().over(Window.partitionBy("session").orderBy("start", "event_index")) - 1 if only_run else F.col("event_index")
        wanted = F.lit(False)
        for a, b in ranges:
            wanted = wanted | F.col("_number").between(a, b)
        out = out.withColumn("_number", number).where(wanted).drop("_number")
    if most is not None:
        order = [F.col("start"), F.col("event_index")] if seed is None else [draw(seed, F.col("session"), F.col("event_index")), F.col("event_index")]
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("session").orderBy(*order))).where(F.col("_r") <= most).drop("_r")
    return out


def excitatory(spikes: DataFrame, cells: DataFrame) -> DataFrame:
    """Spikes of excitatory cells; of all cells in sessions that name none."""
    exc = cells.where("cls = 'exc'").select("session", "cell_id").distinct()
    named = exc.select("session").distinct()
    return spikes.join(exc, ["session", "cell_id"], "left_semi").unionByName(spikes.join(named, "session", "left_anti").select(spikes.columns))


def select_cells(rates: DataFrame, wanted: list[int]) -> DataFrame:
    """The rates of the wanted cells, in each session that has any; a cell that no session has is an error."""
    missing = sorted(set(wanted) - {r.cell_id for r in rates.where(F.col("cell_id").isin(*wanted)).select("cell_id").distinct().collect()})
    if missing:
        raise ValueError(f"cells that are not there: {missing}")
    return rates.where(F.col("cell_id").isin(*wanted))


def valid_states(rates: DataFrame, least_occupancy: float, least_rate: float = 0.0) -> DataFrame:
    """The places of each session that were occupied long enough, and where all cells together fire often enough."""
    g = rates.groupBy("session", "bin_id").agg(F.first("occupancy_s").alias("occupancy_s"), F.sum("rate_hz").alias("total_hz"))
    return g.where((F.col("occupancy_s") > least_occupancy) & (F.col("total_hz") >= least_rate))


def centreline(points: DataFrame, line: list[tuple[float, float]]) -> DataFrame:
    """Adds how far along a line of corners each point's nearest place on it lies, and the distance to it; ties go to the earlier part."""
    start, best = 0.0, []
    for (ax, ay), (bx, by) in zip(line[:-1], line[1:]):
        size = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        if size == 0:
            continue
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - ax) * (bx - ax) + (F.col("y") - ay) * (by - ay)) / size**2))
        off = F.sqrt(F.pow(F.col("x") - ax - share * (bx - ax), 2) + F.pow(F.col("y") - ay - share * (by - ay), 2))
        best.append(F.struct(off.alias("off"), F.lit(len(best)).alias("part"), (F.lit(start) + share * size).alias("along")))
        start += size
    if not best:
        raise ValueError("a line has two corners at least")
    near = F.array_min(F.array(*best))
    return points.withColumn("_n", near).withColumn("along", F.col("_n.along")).withColumn("off_line", F.col("_n.off")).drop("_n")
