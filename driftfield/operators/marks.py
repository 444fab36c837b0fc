"""Clusterless emissions: spikes carry feature vectors (marks) instead of cell ids."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import finite
from ..functions.likelihood import TINY
from ..sources.rounds import written
from .models import AT_ONCE, PARTS, _arrays, binned, deals, durations, session_maps
from .tracks import CELL, Grid, sums_in_bins


def mark_sums(marks: DataFrame, grid: Grid, features: list[str], keys: list[str]) -> DataFrame:
    """Number of marks, and sum (`_s`) and sum of squares (`_q`) of each feature, by place. marks: rows with x, y and the features."""
    m = marks.withColumn("bin_id", grid.bin_once(F.col("x"), F.col("y"))).where("bin_id >= 0")
    sums = [F.count(F.lit(1)).cast("double").alias("n")] + [f(F.col(c)).alias(f"{c}_{k}") for c in features for k, f in (("s", F.sum), ("q", lambda c: F.sum(c * c)))]
    return m.groupBy(*keys, "bin_id").agg(*sums)


def statistics_of(by_bin: DataFrame, features: list[str], keys: list[str], prior_count: float = 1.0, floor: float = 1.0) -> DataFrame:
    """As `mark_statistics`, from the rows of `mark_sums`."""
    whole = by_bin.groupBy(*keys).agg(F.sum("n").alias("_n"), *[F.sum(f"{c}_{k}").alias(f"_{c}_{k}") for c in features for k in "sq"])
    out, n = by_bin.join(whole, keys), F.col("n") + prior_count
    for c in features:
        mean0 = F.col(f"_{c}_s") / F.col("_n")
        square0 = F.col(f"_{c}_q") / F.col("_n")
        mean = (F.col(f"{c}_s") + prior_count * mean0) / n
        out = out.withColumn(f"{c}_mean", mean).withColumn(f"{c}_var", F.greatest((F.col(f"{c}_q") + prior_count * square0) / n - mean * mean, F.lit(floor)))
    return out.select(*keys, "bin_id", "n", *[f"{c}_{k}" for c in features for k in ("mean", "var")])


def mark_statistics(marks: DataFrame, grid: Grid, features: list[str], keys: list[str], prior_count: float = 1.0, floor: float = 1.0) -> DataFrame:
    """Mean and variance of each feature by place, drawn towards the whole by a prior count.

    marks: rows with x, y and the features. keys: session, and the group of a mark where
    there are groups. One pass of sums by place serves the places and the whole.
    """
    return statistics_of(mark_sums(marks, grid, features, keys), features, keys, prior_count, floor)


def mark_likelihood(statistics: DataFrame, features: list[str]) -> Column:
    """Log density of a mark under a place's independent normal laws."""
    out = F.lit(0.0)
    for c in features:
        d = F.col(c) - F.col(f"{c}_mean")
        out = out - 0.5 * (d * d / F.col(f"{c}_var") + F.log(F.col(f"{c}_var")) + math.log(2 * math.pi))
    return out


def mark_events(marks: DataFrame, events: DataFrame, statistics: DataFrame, rates: DataFrame, features: list[str], dt: float, places: int, temperature: float = 1.0, spikes: DataFrame | None = None, cell_rates: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """Log likelihoods of marks gathered by event, as `models.event_emissions` gives those of cells: session, event_index and bins.

    In each time bin at each place: -rate * duration + sum over marks of (log rate + mark density) + n log duration - log n!
    A normal law's log is quadratic in the features, so a bin's marks enter by their number,
    sums and sums of squares alone, and no mark meets a place. rates: session, bin_id, rate_hz of all marks.
    Places without a rate or statistics have no likelihood. With spikes and cell_rates, these and the
    emissions of cells are experts of weight 1 - alpha and alpha; both are made in one task, and no array is shuffled.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    tasks, both, of_event = deals(events), cell_rates is not None, durations(events, dt)
    sums = sums_in_bins(marks, events, dt, values=tuple(features)).select("session", "event_index", F.lit(1).alias("_kind"), F.col("sums").alias("_g"))
    laws = rates.join(statistics.drop("n"), ["session", "bin_id"])
    each = F.log("rate_hz") - 0.5 * sum((F.log(f"{c}_var") + F.col(f"{c}_mean") * F.col(f"{c}_mean") / F.col(f"{c}_var") + math.log(2 * math.pi) for c in features), F.lit(0.0))
    coefs = [each.alias("known"), *[x for c in features for x in ((F.col(f"{c}_mean") / F.col(f"{c}_var")).alias(f"s_{c}"), (-0.5 / F.col(f"{c}_var")).alias(f"q_{c}"))]]
    maps = laws.select("session", F.struct("bin_id", "rate_hz", *coefs).alias("_law")).groupBy("session").agg(F.collect_list("_law").alias("_laws")).withColumn("_kind", F.lit(0))
    rows, names, cells = of_event.unionByName(sums, allowMissingColumns=True), ["known", *[f"{k}_{c}" for c in features for k in "sq"]], []
    if both:
        counts = sums_in_bins(spikes, events, dt, "cell_id").select("session", "event_index", F.lit(1).alias("_kind"), F.col("sums").alias("_f"))
        rows, cells = rows.unionByName(counts, allowMissingColumns=True), ["_total", "_cells", "_logs"]
        maps = maps.join(session_maps(cell_rates).select("session", "_total", F.map_keys("_logs").alias("_cells"), F.map_values("_logs").alias("_logs")), "session")
    parts = min(tasks, PARTS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("event_index"), F.lit(parts)).cast("int"))
    rows = rows.unionByName(maps.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), allowMissingColumns=True).repartition(tasks, "session", "part")
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("_dur", "_laws", *cells)]
    listed = [F.flatten(F.collect_list(c)).alias(c) for c in ("_g", *(["_f"] if both else []))]
    rows = rows.groupBy("session", "part", "_kind", "event_index").agg(*listed, *first).sortWithinPartitions("session", "part", "_kind").drop("part")

    def of_marks(part: pa.RecordBatch, coef: np.ndarray, rate: np.ndarray, has: np.ndarray):
        """Durations, counts and log likelihoods (bin, place) of all bins of some events."""
        n = pc.list_value_length(part.column("_dur")).to_numpy(zero_copy_only=False).astype(np.int64)
        of, dur, flat = pc.list_value_length(part.column("_g")).to_numpy(zero_copy_only=False), part.column("_dur").flatten().to_numpy(zero_copy_only=False), part.column("_g").flatten()
        base, event, t = np.cumsum(n) - n, np.repeat(np.arange(len(n)), of), flat.field("t_idx").to_numpy(zero_copy_only=False)
        ok = t < n[event]
        at = (base[event] + t)[ok]
        added = lambda c: np.bincount(at, weights=flat.field(c).to_numpy(zero_copy_only=False)[ok], minlength=len(dur))
        seen, values = added("n"), np.stack([added(c) for c in names], 1)
        some, own = np.flatnonzero(seen), np.zeros(len(dur))  # a bin of no length holds no mark
        counts, back = np.unique(seen[some], return_inverse=True)
        own[some] = seen[some] * np.log(dur[some]) - np.array([math.lgamma(v + 1) for v in counts])[back]
        ll = (values @ coef - dur[:, None] * rate + own[:, None]) / temperature
        ll[:, ~has] = -np.inf
        return n, dur, seen, ll

    def run(batches):
        held, law, cell = None, None, None
        for batch in batches:
            kind, sessions = batch.column("_kind").to_numpy(), np.array(batch.column("session").to_pylist(), object)
            starts = np.flatnonzero(kind == 0)
            for a, b in zip((-1, *starts), (*starts, len(batch))):
                if a >= 0:
                    row = batch.slice(int(a), 1)
                    held, flat = sessions[a], row.column("_laws").flatten()
                    at = flat.field("bin_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    coef, rate, has = np.zeros((len(names), places)), np.zeros(places), np.zeros(places, bool)
                    given = [flat.field(c) for c in names]
                    whole = ~np.any([c.is_null().to_numpy(zero_copy_only=False) for c in given], 0)  # a law that is not known says nothing
                    keep = at < places
                    for i, c in enumerate(given):
                        coef[i, at[keep]] = np.where(whole, c.to_numpy(zero_copy_only=False), 0.0)[keep]
                    rate[at[keep]], has[at[keep]] = flat.field("rate_hz").to_numpy(zero_copy_only=False)[keep], True
                    law = coef, rate, has
                    if both:
                        total, of_cells = row.column("_total").flatten().to_numpy(zero_copy_only=False), row.column("_cells").flatten()
                        if len(total) != places:
                            raise ValueError(f"a map of {len(total)} places beside marks at {places}")
                        cell = total, of_cells, row.column("_logs").flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(of_cells), len(total))
                mine = a + 1 + np.flatnonzero(sessions[a + 1 : b] == held) if held is not None else np.zeros(0, int)
                if not len(mine):
                    continue
                mine = mine[batch.column("_dur").is_valid().to_numpy(zero_copy_only=False)[mine]]
                sizes = pc.list_value_length(batch.column("_dur")).to_numpy(zero_copy_only=False)[mine]
                group = np.cumsum(sizes) // max(1, AT_ONCE // places)
                for some in np.split(mine, np.flatnonzero(np.diff(group)) + 1):
                    if not len(some):
                        continue
                    part = batch.select(["session", "event_index", "_dur", "_g"]).take(pa.array(some))
                    n, dur, seen, ll = of_marks(part, *law)
                    if both:
                        others = [x.column("bins").flatten() for x in _arrays(batch, some, *cell, None)]
                        ll = alpha * np.concatenate([x.field("ll").flatten().to_numpy(zero_copy_only=False) for x in others]).reshape(ll.shape) + (1 - alpha) * ll
                        seen = seen + np.concatenate([x.field("n_spikes").to_numpy(zero_copy_only=False) for x in others])
                    index = np.arange(len(dur)) - np.repeat(np.cumsum(n) - n, n)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dur) + 1) * places, pa.int32()), pa.array(ll.ravel()))
                    bins = pa.StructArray.from_arrays([pa.array(index, pa.int32()), pa.array(dur), pa.array(seen.astype(np.int64)), lists], ["t_idx", "bin_dur", "n_spikes", "ll"])
                    yield pa.RecordBatch.from_arrays([part.column("session"), part.column("event_index"), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), bins)], ["session", "event_index", "bins"])

    shape = f"session string, event_index {events.schema['event_index'].dataType.simpleString()}, bins array<struct<t_idx: int, bin_dur: double, n_spikes: bigint, ll: array<double>>>"
    return rows.mapInArrow(run, shape)


def clusterless_arrays(marks: DataFrame, events: DataFrame, statistics: DataFrame, rates: DataFrame, features: list[str], dt: float, places: int, temperature: float = 1.0) -> DataFrame:
    """The rows of `mark_events`, one of each time bin."""
    return binned(mark_events(marks, events, statistics, rates, features, dt, places, temperature))


def clusterless_emissions(marks: DataFrame, events: DataFrame, statistics: DataFrame, rates: DataFrame, features: list[str], dt: float, temperature: float = 1.0) -> DataFrame:
    """As `clusterless_arrays`, as rows of the places that have a rate: session, event_index, t_idx, bin_id, bin_dur, n_spikes, ll."""
    places = rates.join(statistics, ["session", "bin_id"]).select("session", "bin_id")
    most = places.agg(F.max("bin_id")).first()[0]
    rows = clusterless_arrays(marks, events, statistics, rates, features, dt, 1 if most is None else most + 1, temperature)
    listed = rows.select("session", "event_index", "t_idx", F.posexplode("ll").alias("bin_id", "ll"), "bin_dur", "n_spikes")
    return listed.join(places, ["session", "bin_id"], "left_semi").select("session", "event_index", "t_idx", "bin_id", "bin_dur", "n_spikes", "ll")


@dataclass(frozen=True)
class Kernels:
    """Kernel densities of marks: how many marks stand for a place, how they are weighed, and how wide kernels are."""

    #: Marks of a place, the nearest ones by places.
    neighbours: int = 256
    #: Width of the weights over places, in places; 0 takes the place's own marks.
    spatial_sigma: float = 1.0
    #: Weight that all of a place's marks share evenly.
    prior_count: float = 1.0
    variance_floor: float = 1.0
    #: Of every feature; otherwise by the number of marks and their spread.
    bandwidth: float | None = None
    #: Beyond so many bandwidths a kernel stays at the height that it has there.
    reach: float = 6.0
    #: Features by which marks meet in cells; the others only enter the distance.
    hashed: int = 3
    #: Places that are looked through around each one before all are.
    near: int = 6


#: The group that stands for all marks of a session; marks of groups unseen in training count there.
WHOLE = -1


def with_whole(rows: DataFrame, group: str) -> DataFrame:
    """Rows, and each again as one of the whole session."""
    return rows.withColumn(group, F.explode(F.array(F.col(group).cast("long"), F.lit(WHOLE).cast("long"))))


def kernel_bandwidths(marks: DataFrame, features: list[str], keys: list[str], kernels: Kernels = Kernels()) -> DataFrame:
    """The kernels' variance of each feature, from the marks' number and spread: keys, n and `var_` columns."""
    scale = F.pow(F.count(F.lit(1)).cast("double"), F.lit(-2.0 / (len(features) + 4)))
    spread = lambda c: F.lit(float(kernels.bandwidth or 0) ** 2) if kernels.bandwidth else F.greatest(F.var_pop(c), F.lit(kernels.variance_floor)) * scale
    return marks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.greatest(spread(c), F.lit(kernels.variance_floor)).alias(f"var_{c}") for c in features])


def kernel_support(marks: DataFrame, grid: Grid, features: list[str], keys: list[str], kernels: Kernels = Kernels()) -> DataFrame:
    """keys, bin_id, features and log_w: the marks that stand for each place, with weights that add up to 1.

    marks: rows with x, y, the features and mark_id. A place has the `neighbours` marks
    nearest to it by places; ties go to the smaller place, then to the smaller mark_id.
    Places meet the counts of marks by place, not the marks: of those within `near` places,
    and of all only where these do not hold enough. So a group of any size meets at most
    places x neighbours of its marks.
    """
    m = marks.withColumn("_at", grid.bin(F.col("x"), F.col("y"))).where("_at >= 0")
    own = Window.partitionBy(*keys, "_at").orderBy("mark_id")
    numbered = m.withColumn("_i", F.row_number().over(own)).where(F.col("_i") <= kernels.neighbours).select(*keys, "_at", "_i", *features)
    counts = m.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.least(F.sum("n"), F.lit(kernels.neighbours)).alias("_k"))
    ring = [(dx, dy) for dx in range(-kernels.near, kernels.near + 1) for dy in range(-kernels.near, kernels.near + 1) if dx * dx + dy * dy <= kernels.near**2]
    ix, iy = F.floor(F.col("_at") / grid.ny).cast("int"), F.col("_at") % grid.ny
    moves = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ring]))
    around = counts.withColumn("_m", moves).withColumn("_px", ix + F.col("_m.dx")).withColumn("_py", iy + F.col("_m.dy"))
    around = around.where(F.col("_px").between(0, grid.nx - 1) & F.col("_py").between(0, grid.ny - 1))
    around = around.select(*keys, (F.col("_px") * grid.ny + F.col("_py")).cast("int").alias("bin_id"), "_at", "n", (F.col("_m.dx") * F.col("_m.dx") + F.col("_m.dy") * F.col("_m.dy")).alias("_d2"))
    places = totals.withColumn("bin_id", F.explode(F.sequence(F.lit(0), F.lit(grid.nx * grid.ny - 1))))
    enough = around.groupBy(*keys, "bin_id").agg(F.sum("n").alias("_held"))
    places = places.join(enough, [*keys, "bin_id"], "left").withColumn("_whole", F.coalesce("_held", F.lit(0)) < F.col("_k"))
    dx, dy = ix - F.floor(F.col("bin_id") / grid.ny).cast("int"), iy - F.col("bin_id") % grid.ny
    far = places.where("_whole").select(*keys, "bin_id", "_k").join(counts, keys).withColumn("_d2", dx * dx + dy * dy)
    met = around.join(places.where("not _whole").select(*keys, "bin_id", "_k"), [*keys, "bin_id"]).unionByName(far)
    of = Window.partitionBy(*keys, "bin_id")
    before = F.coalesce(F.sum("n").over(of.orderBy("_d2", "_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = met.withColumn("_take", F.least(F.col("n"), F.col("_k") - before)).where("_take > 0")
    s2 = kernels.spatial_sigma**2
    height = F.exp(-0.5 * F.col("_d2") / s2) if s2 > 0 else (F.col("_d2") == 0).cast("double")
    taken = taken.withColumn("_w", height + F.lit(kernels.prior_count) / F.col("_k")).withColumn("_sum", F.sum(F.col("_take") * F.col("_w")).over(of))
    weight = F.when(F.col("_sum") > TINY, F.log(F.greatest(F.col("_w"), F.lit(TINY))) - F.log("_sum")).otherwise(-F.log(F.col("_k").cast("double")))
    taken = taken.withColumn("log_w", F.when((F.col("_w") <= 0) & (F.col("_sum") > TINY), float("-inf")).otherwise(weight))
    return taken.join(numbered, [*keys, "_at"]).where(F.col("_i") <= F.col("_take")).select(*keys, "bin_id", *features, "log_w")


def kernel_events(marks: DataFrame, events: DataFrame, support: DataFrame, bandwidths: DataFrame, rates: DataFrame, features: list[str], group: str, dt: float, places: int, kernels: Kernels = Kernels(), temperature: float = 1.0) -> DataFrame:
    """Log likelihoods gathered by event, as `mark_events` gives them, with kernel densities by group of marks.

    marks: session, t, the group and features. support, bandwidths and rates are of
    groups (long) and of the WHOLE session, which stands for groups that training never saw.
    Marks meet the support in cells of a kernel's reach in feature space and the cells beside them, never a whole group;
    what lies beyond the reach counts as if it lay there. What a mark says of the places does not depend on the event that
    holds it, so marks that are alike meet the support once. Events and marks meet by blocks
    of time as long as the longest event, where a bin's marks are a difference of two running sums.
    """
    hashed, kind = features[: kernels.hashed], ["session", group, *features]
    norms = written(bandwidths.select("session", F.col(group), *[f"var_{c}" for c in features]), "bandwidths")
    known = norms.select("session", group, F.lit(True).alias("_known"))
    spiking = marks.where(finite(F.col("t"))).select("session", F.col("t").cast("double").alias("t"), F.coalesce(F.col(group).cast("long"), F.lit(WHOLE)).alias(group), *features)
    spiking = spiking.join(F.broadcast(known), ["session", group], "left").withColumn(group, F.when(F.col("_known"), F.col(group)).otherwise(F.lit(WHOLE).cast("long"))).drop("_known")
    cell = lambda c: F.floor(F.col(c) / (F.sqrt(f"var_{c}") * kernels.reach)).cast("long")
    held = support.join(norms, ["session", group])
    for i, c in enumerate(hashed):
        held = held.withColumn(f"_c{i}", cell(c))
    held = held.select("session", group, "bin_id", "log_w", *[F.col(c).alias(f"_{c}") for c in features], *[f"_c{i}" for i in range(len(hashed))])
    asked = spiking.select(*kind).distinct().join(norms, ["session", group])
    for i, c in enumerate(hashed):
        asked = asked.withColumn(f"_c{i}", F.explode(F.array(*[cell(c) + k for k in (-1, 0, 1)])))
    quad = sum(((F.col(c) - F.col(f"_{c}")) ** 2 / F.col(f"var_{c}") for c in features), F.lit(0.0))
    near = asked.join(held, ["session", group, *[f"_c{i}" for i in range(len(hashed))]]).withColumn("_q", quad).where(F.col("_q") <= kernels.reach**2)
    low = -0.5 * kernels.reach**2
    each = near.groupBy(*kind, "bin_id").agg(F.sum(F.exp(F.col("log_w") - 0.5 * F.col("_q"))).alias("s"), F.sum(F.exp("log_w")).alias("w"))
    gain = F.log(F.col("s") + math.exp(low) * F.greatest(1 - F.col("w"), F.lit(0.0))) - low
    at = F.sequence(F.lit(0), F.lit(places - 1))
    gains = each.groupBy(*kind).agg(F.map_from_entries(F.collect_list(F.struct("bin_id", gain.alias("v")))).alias("_m"))
    gains = gains.select(*kind, F.transform(at, lambda b: F.coalesce(F.element_at("_m", b), F.lit(0.0))).alias("_gain"))
    norm = sum((F.log(F.col(f"var_{c}")) + math.log(2 * math.pi) for c in features), F.lit(0.0))
    of_group = rates.groupBy("session", F.col(group)).agg(F.map_from_entries(F.collect_list(F.struct("bin_id", "rate_hz"))).alias("_r"))
    base = norms.join(of_group, ["session", group], "left").select("session", group, F.transform(at, lambda b: low - 0.5 * norm + F.coalesce(F.log(F.element_at("_r", b)), F.lit(0.0))).alias("_base"))
    times = spiking.groupBy("t", *kind).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(base), ["session", group]).join(gains, kind, "left")
    times = times.select("session", "t", "n", F.when(F.col("_gain").isNull(), F.col("_base")).otherwise(F.zip_with("_base", "_gain", lambda x, y: x + y)).alias("v"))

    longest = events.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0.0
    span = max(CELL, longest * 17 / 16)  # so that an event ends in the block after its own, whatever the rounding
    block = lambda c: F.floor(F.col(c) / span).cast("long")
    e = events.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select("session", "event_index", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), block("start").alias("_c"))
    silent = of_group.where(F.col(group) == WHOLE).select("session", F.transform(at, lambda b: F.element_at("_r", b)).alias("v"))
    both = times.withColumn("_c", F.explode(F.array(block("t"), block("t") - 1))).unionByName(e.select("session", "_c").distinct().join(F.broadcast(silent), "session"), allowMissingColumns=True)
    shape = f"session string, event_index {events.schema['event_index'].dataType.simpleString()}, bins array<struct<t_idx: int, bin_dur: double, n_spikes: bigint, ll: array<double>>>"

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        t, n = (left.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("t", "n"))
        v = left.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, places) if len(left) else np.zeros((0, places))
        rate, seen = v[np.isnan(t)], np.flatnonzero(~np.isnan(t))
        start, end = (right.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        if not len(rate):  # a session without a map
            start, end = start[:0], end[:0]
        order = seen[np.argsort(t[seen], kind="stable")]
        t, n, v = t[order], n[order], v[order]
        sums, counts = np.zeros((len(t) + 1, places)), np.concatenate(([0.0], np.cumsum(n)))
        np.cumsum(v * n[:, None], 0, out=sums[1:])
        bins = np.maximum(np.ceil((end - start) / dt - 1e-9), 1).astype(np.int64)
        row = np.repeat(np.arange(len(start)), bins)
        k = np.arange(len(row)) - np.repeat(np.cumsum(bins) - bins, bins)
        begin = start[row] + k * dt
        until = np.minimum(end[row], begin + dt)
        a, b = np.searchsorted(t, begin), np.searchsorted(t, until)
        b, dur = np.maximum(a, b), until - begin
        held, of = counts[b] - counts[a], np.zeros(len(row))
        some = np.flatnonzero(held)  # a bin of no length holds no mark
        each, back = np.unique(held[some], return_inverse=True)
        of[some] = held[some] * np.log(dur[some]) - np.array([math.lgamma(x + 1) for x in each])[back]
        ll = sums[b] - sums[a]
        if len(rate):
            ll = (ll - dur[:, None] * rate[0] + of[:, None]) / temperature
            ll[:, np.isnan(rate[0])] = -np.inf  # places without a rate have no likelihood
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * places, pa.int32()), pa.array(ll.ravel()))
        of_bin = pa.StructArray.from_arrays([pa.array(k, pa.int32()), pa.array(dur), pa.array(np.round(held).astype(np.int64)), lists], ["t_idx", "bin_dur", "n_spikes", "ll"])
        index = right.column("event_index").combine_chunks().slice(0, len(start))
        if pa.types.is_struct(index.type):  # fields that are never null are declared so by Spark, and not in the result
            index = pa.StructArray.from_arrays(index.flatten(), fields=[f.with_nullable(True) for f in index.type])
        return pa.table([pa.array([key[0].as_py()] * len(start), pa.string()), index, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(bins))), pa.int32()), of_bin)], names=["session", "event_index", "bins"])

    return both.groupBy("session", "_c").cogroup(e.groupBy("session", "_c")).applyInArrow(run, shape)


def kernel_emissions(marks: DataFrame, events: DataFrame, support: DataFrame, bandwidths: DataFrame, rates: DataFrame, features: list[str], group: str, dt: float, kernels: Kernels = Kernels(), temperature: float = 1.0) -> DataFrame:
    """The likelihoods of `kernel_events` as rows, as `clusterless_emissions` gives them."""
    whole = rates.where(F.col(group) == WHOLE).select("session", "bin_id")
    most = rates.agg(F.max("bin_id")).first()[0]
    rows = binned(kernel_events(marks, events, support, bandwidths, rates, features, group, dt, 1 if most is None else most + 1, kernels, temperature))
    listed = rows.select("session", "event_index", "t_idx", F.posexplode("ll").alias("bin_id", "ll"), "bin_dur", "n_spikes")
    return listed.join(whole, ["session", "bin_id"], "left_semi").select("session", "event_index", "t_idx", "bin_id", "bin_dur", "n_spikes", "ll")
