"""Queries over tracks, spikes and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import likelihood as lk
from ..operators import gates
from ..operators import tracks as op
from ..sources import relations as rel

QUERIES: dict = {}
GRID = op.Grid(0.0, 0.0, 25.0, 8, 4)
#: Frames of the stream are minutes apart on its clock, so that their exposure is capped high.
CAP = 10.0

_P = f"with {rel.POSITION_SQL}, {rel.SPIKES_SQL}, {rel.SHORT_EVENTS_SQL}, {rel.EPOCHS_SQL}, {rel.WELLS_SQL}"
#: Bins, durations and occupancy in SQL.
_AXIS = "case when {v} < 0 or {v} > {top} then -1 when floor({v} / 25.0) >= {n} then {n} - 1 else floor({v} / 25.0)::int end"
_IX, _IY = _AXIS.format(v="x", top=200, n=8), _AXIS.format(v="y", top=100, n=4)
_BIN = f"case when ({_IX}) < 0 or ({_IY}) < 0 then -1 else ({_IX}) * 4 + ({_IY}) end"
_FRAMES = f"steps as (select *, lead(t) over (partition by session order by t) - t as step from position), frames as (select * exclude step, least(coalesce(step, median(step) over (partition by session), 1.0::double / 30), {{cap}}::double) as dt from steps)"
_OCC = _FRAMES.format(cap=1.0) + f", occ as (select session, bin_id, sum(dt) as occupancy_s from (select *, {_BIN} as bin_id from frames) where bin_id >= 0 group by 1, 2)"
_RAW = [2.718281828459045 ** (-0.5 * d * d) for d in range(-4, 5)]


def _smooth(name, source, value, keys):
    """Two passes of the discrete Gaussian over rows and columns, in SQL."""
    k = ", ".join(f"({d}, {w / sum(_RAW)!r}::double)" for d, w in zip(range(-4, 5), _RAW))
    return f"""{name}_x as (select {keys}, floor(bin_id / 4)::int + d as ix, bin_id % 4 as iy, sum({value} * w) as v from {source}, (values {k}) as kern(d, w) where floor(bin_id / 4)::int + d between 0 and 7 group by all),
{name} as (select {keys}, ix * 4 + iy + d as bin_id, sum(v * w) as {value} from {name}_x, (values {k}) as kern(d, w) where iy + d between 0 and 3 group by all)"""


_ASOF = """merged as (select session, t, spike_row, cell_id, null::double as px, null::double as py, null::double as pt, 1 as p from spikes union all select session, t, null, null, x, y, t, 0 from position),
near as (select *, last_value(case when p = 0 then {'t': pt, 'x': px, 'y': py} end ignore nulls) over (partition by session order by t, p rows between unbounded preceding and current row) as a,
 first_value(case when p = 0 then {'t': pt, 'x': px, 'y': py} end ignore nulls) over (partition by session order by t, p rows between current row and unbounded following) as b from merged),
located as (select session, spike_row, cell_id, t, case when a is null then b.x when b is null or t = a.t then a.x else a.x + (b.x - a.x) * ((t - a.t) / (b.t - a.t)) end as x,
 case when a is null then b.y when b is null or t = a.t then a.y else a.y + (b.y - a.y) * ((t - a.t) / (b.t - a.t)) end as y from near where p = 1)"""
RATES_SQL = f"""{_P}, {_OCC}, {_smooth('occ_s', 'occ', 'occupancy_s', 'session')}, {_ASOF},
spike_bins as (select session, cell_id, bin_id, count(*)::double as n from (select *, {_BIN} as bin_id from located) where bin_id >= 0 group by 1, 2, 3), {_smooth('cnt', 'spike_bins', 'n', 'session, cell_id')},
rates as (select o.session, c.cell_id, o.bin_id, o.occupancy_s, greatest(coalesce(k.n, 0) / greatest(o.occupancy_s, 0.05), 1e-4) as rate_hz from occ_s o join (select distinct session, cell_id from spikes) c on o.session = c.session
 left join cnt k on k.session = o.session and k.cell_id = c.cell_id and k.bin_id = o.bin_id)"""


def _r(c, name=None, digits=6):
    return ev.rounded(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)


def _s(c, name=None, digits=6):
    return f"round({c}, {digits}) + 0.0 as {name or c}"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f
    return add


def rates(spark, d):
    return op.rate_map(rel.position(spark, d), rel.spikes(spark, d), GRID)


@query(f"{_P} select session, frame_idx, x, y from (select *, row_number() over (partition by session, t order by frame_idx) as r from position where isfinite(x) and isfinite(y)) where r = 1")
def clean_position(spark, d):
    return op.clean_position(rel.position(spark, d)).select("session", "frame_idx", "x", "y")


@query(f"{_P} select session, {_BIN} as bin_id, count(*) as samples from position group by 1, 2")
def grid_binning(spark, d):
    return rel.position(spark, d).withColumn("bin_id", GRID.bin(F.col("x"), F.col("y"))).groupBy("session", "bin_id").agg(F.count(F.lit(1)).alias("samples"))


@query(f"{_P}, {_OCC} select session, bin_id, {_s('occupancy_s')} from occ")
def occupancy(spark, d):
    return op.occupancy(rel.position(spark, d), GRID).select("session", "bin_id", _r("occupancy_s"))


_GRAD = "case when a_{c} is null then (b_{c} - {c}) / g when b_{c} is null then ({c} - a_{c}) / h else (h * h * b_{c} + (g * g - h * h) * {c} - g * g * a_{c}) / (h * g * (g + h)) end"
_SPEED = f"""lagged as (select *, lag(x) over w as a_x, lead(x) over w as b_x, lag(y) over w as a_y, lead(y) over w as b_y, t - lag(t) over w as h, lead(t) over w - t as g from position window w as (partition by session order by t)),
speeds as (select *, sqrt(vx * vx + vy * vy) as speed from (select *, {_GRAD.format(c='x')} as vx, {_GRAD.format(c='y')} as vy from lagged))"""


@query(f"{_P}, {_SPEED} select session, frame_idx, {_s('speed', digits=5)} from speeds")
def speed(spark, d):
    return op.speed(rel.position(spark, d)).select("session", "frame_idx", _r("speed", digits=5))


@query(f"{_P}, {_SPEED} select session, frame_idx, {_s('speed', digits=5)} from speeds p where speed >= 5 and exists (select 1 from epochs e where e.session = p.session and p.t >= e.start and p.t <= e.end)")
def movement_filter(spark, d):
    return op.in_intervals(op.speed(rel.position(spark, d)).where("speed >= 5"), rel.epochs(spark, d)).select("session", "frame_idx", _r("speed", digits=5))


@query(f"{_P} select session, cell_id, count(*) as spikes from spikes s where exists (select 1 from epochs e where e.session = s.session and s.t >= e.start and s.t <= e.end) group by 1, 2")
def spikes_in_epochs(spark, d):
    return op.in_intervals(rel.spikes(spark, d), rel.epochs(spark, d)).groupBy("session", "cell_id").agg(F.count(F.lit(1)).alias("spikes"))


@query(f"{_P}, {rel.EVERY_EPOCH_SQL}, {_SPEED} select session, frame_idx, {_s('speed', digits=5)} from speeds p where speed >= 5 and exists (select 1 from every_epoch e where e.session = p.session and p.t >= e.start and p.t <= e.end)")
def movement_in_every_epoch(spark, d):
    return op.in_intervals(op.speed(rel.position(spark, d)).where("speed >= 5"), rel.every_epoch(spark, d)).select("session", "frame_idx", _r("speed", digits=5))


@query(f"{_P}, {rel.EVERY_EPOCH_SQL} select session, cell_id, count(*) as spikes from spikes s where exists (select 1 from every_epoch e where e.session = s.session and s.t >= e.start and s.t <= e.end) group by 1, 2")
def spikes_in_every_epoch(spark, d):
    return op.in_intervals(rel.spikes(spark, d), rel.every_epoch(spark, d)).groupBy("session", "cell_id").agg(F.count(F.lit(1)).alias("spikes"))


_MERGED = """mark as (select *, max("end") over (partition by session order by start, "end" rows between unbounded preceding and 1 preceding) as m from short_events),
isl as (select *, sum(case when m is null or start > m then 1 else 0 end) over (partition by session order by start, "end" rows unbounded preceding) as i from mark), merged_events as (select session, min(start) as start, max("end") as "end" from isl group by session, i)"""


@query(f"{_P}, {_MERGED} select session, {_s('start')}, {_s(chr(34) + 'end' + chr(34), 'stop')} from merged_events")
def merged_intervals(spark, d):
    return op.merge_intervals(rel.short_events(spark, d)).select("session", _r("start"), _r("end", "stop"))


@query(f"""{_P}, {_FRAMES.format(cap=CAP)}, {_MERGED} select session, frame_idx, {_s('dt')}, {_s('o', 'overlap')}, round(greatest(0, dt - o), 6) + 0.0 as exposure from (select f.session, f.frame_idx, f.dt, coalesce(sum(case when m.start is not null then greatest(0, least(f.t + f.dt, m.end) - greatest(f.t, m.start)) end), 0) as o
from frames f left join merged_events m on m.session = f.session and f.t < m.end and f.t + f.dt > m.start group by 1, 2, 3)""")
def exposure_outside_events(spark, d):
    e = op.exposure_outside(op.frame_durations(rel.position(spark, d), CAP), rel.short_events(spark, d))
    return e.select("session", "frame_idx", _r("dt"), _r("overlap"), _r("exposure"))


@query(f"{_P}, {_ASOF} select session, spike_row, {_s('x', digits=5)}, {_s('y', digits=5)} from located")
def spike_positions(spark, d):
    return op.as_of(rel.spikes(spark, d), rel.position(spark, d), ["x", "y"]).select("session", "spike_row", _r("x", digits=5), _r("y", digits=5))


@query(f"{_P} select s.session, s.spike_row, (select w.well_id from well_sequence w where w.session = s.session and w.fill_t <= s.t order by w.fill_t desc limit 1) as active_well from spikes s")
def active_goal(spark, d):
    b = op.backward(rel.spikes(spark, d), rel.well_sequence(spark, d), "well_id", "fill_t")
    return b.select("session", "spike_row", F.col("well_id").alias("active_well"))


@query(f"""{_P}, v as (select e.session, e.event_index, min({{'a': w.fill_t, 'w': w.well_id}}) as v, any_value(e.end) as stop from short_events e left join well_sequence w on w.session = e.session and w.fill_t > e.end and w.fill_t <= e.end + 300 group by 1, 2)
select session, event_index, v.w as true_well_id, round(v.a - stop, 5) + 0.0 as time_to_arrival_s, v.a is not null as valid_label, case when v.a is null then 'no_visit_within_horizon' else '' end as exclude_reason from v""")
def next_visit_labels(spark, d):
    h = op.horizon_visit(rel.short_events(spark, d), rel.well_sequence(spark, d).withColumnRenamed("fill_t", "t"), 300.0)
    return h.select("session", "event_index", "true_well_id", _r("time_to_arrival_s", digits=5), "valid_label", "exclude_reason")


_BINS = """eb as (select session, event_index, t_idx::int as t_idx, least("end", start + (t_idx + 1) * 20.0::double) - (start + t_idx * 20.0::double) as bin_dur from (select *, unnest(range(greatest(ceil(("end" - start) / 20.0 - 1e-9)::int, 1))) as t_idx from short_events))"""
_COUNTS = """ec as (select e.session, e.event_index, floor((s.t - e.start) / 20.0)::int as t_idx, s.cell_id, count(*) as n from spikes s join short_events e on e.session = s.session and s.t >= e.start and s.t < e.end group by 1, 2, 3, 4)"""


@query(f"{_P}, {_BINS} select session, event_index, t_idx, {_s('bin_dur', digits=5)} from eb")
def event_time_bins(spark, d):
    return op.event_bins(rel.short_events(spark, d), 20.0).select("session", "event_index", "t_idx", _r("bin_dur", digits=5))


@query(f"{_P}, {_COUNTS} select * from ec")
def spike_count_matrix(spark, d):
    return op.spike_counts(rel.spikes(spark, d), rel.short_events(spark, d), 20.0)


@query(f"{RATES_SQL} select session, cell_id, bin_id, {_s('occupancy_s', digits=5)}, {_s('rate_hz', digits=5)} from rates")
def rate_map(spark, d):
    return rates(spark, d).select("session", "cell_id", "bin_id", _r("occupancy_s", digits=5), _r("rate_hz", digits=5))


_Q = f"""{RATES_SQL}, pr as (select *, occupancy_s / sum(occupancy_s) over (partition by session, cell_id) as p from rates), pm as (select *, sum(p * rate_hz) over (partition by session, cell_id) as m from pr),
quality as (select session, cell_id, sum(p * (rate_hz / m) * log2(rate_hz / m)) as spatial_information, max(rate_hz) as peak_rate_hz, any_value(m) as mean_rate_hz, any_value(m) * any_value(m) / sum(p * rate_hz * rate_hz) as field_sparsity from pm group by 1, 2)"""


@query(f"{_Q} select session, cell_id, {_s('spatial_information', digits=5)}, {_s('peak_rate_hz', digits=5)}, {_s('mean_rate_hz', digits=5)}, {_s('field_sparsity', digits=5)} from quality")
def place_field_quality(spark, d):
    q = op.place_field_quality(rates(spark, d))
    return q.select("session", "cell_id", *[_r(c, digits=5) for c in ("spatial_information", "peak_rate_hz", "mean_rate_hz", "field_sparsity")])


@query(f"{_Q} select session, cell_id from quality where spatial_information >= 0.2 and peak_rate_hz >= 0.01 and field_sparsity <= 0.9")
def stable_cells(spark, d):
    """At limits that no cell of the derived tracks reaches; `informative_cells` has limits that some do."""
    return op.place_field_quality(rates(spark, d)).where("spatial_information >= 0.2 and peak_rate_hz >= 0.01 and field_sparsity <= 0.9").select("session", "cell_id")


@query(f"{_Q} select session, cell_id, {_s('spatial_information', digits=5)} from quality where spatial_information >= 0.006 and peak_rate_hz >= 0.001 and field_sparsity <= 0.993")
def informative_cells(spark, d):
    q = op.place_field_quality(rates(spark, d)).where("spatial_information >= 0.006 and peak_rate_hz >= 0.001 and field_sparsity <= 0.993")
    return q.select("session", "cell_id", _r("spatial_information", digits=5))


@query(f"""{_P}, b as (select *, lead(src) over (partition by session order by t) as dst from (select *, {_BIN} as src from position)), c as (select session, src, dst, count(*)::double as n from b where src >= 0 and dst >= 0 group by 1, 2, 3),
u as (select session, src, dst, sum(n) as n from (select * from c union all select distinct session, src, src, 1.0::double from c) group by 1, 2, 3) select session, src, dst, round(n / sum(n) over (partition by session, src), 6) + 0.0 as probability from u""")
def empirical_transitions(spark, d):
    return op.empirical_transitions(rel.position(spark, d), GRID).select("session", "src", "dst", _r("probability"))


@query(f"""{_P}, g as (select *, coalesce((t - lag(t) over (partition by session order by t) > 20)::int, 1) as n from position), i as (select *, sum(n) over (partition by session order by t rows unbounded preceding) as island from g)
select session, island::bigint as island, {_s('min(t)', 'start', 5)}, {_s('max(t)', 'stop', 5)}, count(*) as samples from i group by session, island""")
def run_islands(spark, d):
    return op.islands(rel.position(spark, d), 20.0).select("session", "island", _r("start", digits=5), _r("end", "stop", 5), "samples")



_MEDIAN = "list_sort([coalesce(lag({c}, 2) over w, first_value({c}) over w), coalesce(lag({c}, 1) over w, first_value({c}) over w), {c}, coalesce(lead({c}, 1) over w, {c}), coalesce(lead({c}, 2) over w, lead({c}, 1) over w, {c})])[3]"


@query(f"""{_P}, smooth as (select session, frame_idx, t, {_MEDIAN.format(c='x')} as x, {_MEDIAN.format(c='y')} as y from position window w as (partition by session order by t)), {_SPEED.replace('from position', 'from smooth')}
select session, frame_idx, {_s('x', 'x_smooth')}, {_s('y', 'y_smooth')}, {_s('speed', 'speed_smooth', 5)}, speed > 10 as outlier from speeds""")
def robust_position(spark, d):
    """The filtered track; samples are minutes apart, so that a speed of 10 is already too fast."""
    return op.robust_position(rel.position(spark, d), limit=10.0).select("session", "frame_idx", _r("x_smooth"), _r("y_smooth"), _r("speed_smooth", digits=5), "outlier")


def _ripples(spark, d):
    """Ten seconds of the clock from each event's peak: short, so that most of a session trains the map."""
    return rel.short_events(spark, d).select("session", "event_index", F.col("peak").alias("start"), (F.col("peak") + 10).alias("end"))


_NEAR = ", ".join(f"{f}({c}) over w as {n}_{c}" for c in "txy" for f, n in (("lag", "p"), ("lead", "n")))
_SLOPE = "case when p_t is null and n_t is null then 0 when p_t is null then (n_{c} - {c}) / (n_t - t) when n_t is null then ({c} - p_{c}) / (t - p_t) else ((t - p_t) * (t - p_t) * n_{c} + ((n_t - t) * (n_t - t) - (t - p_t) * (t - p_t)) * {c} - (n_t - t) * (n_t - t) * p_{c}) / ((t - p_t) * (n_t - t) * (n_t - p_t)) end"
_RUN_LOCAL = f"""cp as (select * from position), gp as (select session, 5 * median(step) as gap from (select session, lead(t) over (partition by session order by t) - t as step from cp) where step > 0 group by 1),
ins as (select distinct p.session, p.frame_idx, p.t, p.x, p.y, e.start as a, e.end as b, coalesce(gap, 'infinity'::double) as gap from cp p join every_epoch e on e.session = p.session and p.t >= e.start and p.t <= e.end left join gp on gp.session = p.session),
nb0 as (select *, {_NEAR} from ins window w as (partition by session, a, b order by t)), nb as (select * replace (case when t - p_t <= gap then p_t end as p_t, case when t - p_t <= gap then p_x end as p_x, case when t - p_t <= gap then p_y end as p_y, case when n_t - t <= gap then n_t end as n_t, case when n_t - t <= gap then n_x end as n_x, case when n_t - t <= gap then n_y end as n_y) from nb0),
pc as (select *, n_t - t as step, sum((p_t is null)::int) over (partition by session, a, b order by t rows unbounded preceding) as piece, sqrt(pow({_SLOPE.format(c='x')}, 2) + pow({_SLOPE.format(c='y')}, 2)) as v from nb),
md as (select *, median(step) over (partition by session, a, b, piece) as mid from pc), moving as (select session, frame_idx, t, x, y, max(v) as speed, least(coalesce(min(step), min(coalesce(mid, 1.0::double / 30))), 1.0) as dt from md group by 1, 2, 3, 4, 5)"""
_RIPPLES = """ripples as (select session, event_index, peak as start, peak + 10 as "end" from short_events)"""


@query(f"{_P}, {rel.EVERY_EPOCH_SQL}, {_RUN_LOCAL} select session, frame_idx, {_s('speed', digits=5)}, {_s('dt')} from moving")
def run_local_kinematics(spark, d):
    """Speed and duration of every sample in a run, from that run's samples alone."""
    return op.run_local(op.clean_position(rel.position(spark, d)), rel.every_epoch(spark, d)).select("session", "frame_idx", _r("speed", digits=5), _r("dt"))


def training_rates(spark, d):
    return op.training_rate_map(rel.position(spark, d), rel.spikes(spark, d), GRID, rel.every_epoch(spark, d), _ripples(spark, d), least_speed=0.5)


TRAINING_SQL = f"""{_P}, {rel.EVERY_EPOCH_SQL}, {_RUN_LOCAL}, {_RIPPLES}, {_MERGED.replace('short_events', 'ripples')},
kept as (select v.session, v.frame_idx, any_value(v.x) as x, any_value(v.y) as y, greatest(0, any_value(dt) - coalesce(sum(case when m.start is not null then greatest(0, least(v.t + v.dt, m.end) - greatest(v.t, m.start)) end), 0)) as dt from moving v left join merged_events m on m.session = v.session and v.t < m.end and v.t + v.dt > m.start where v.speed >= 0.5 group by 1, 2),
tocc as (select session, bin_id, sum(dt) as occupancy_s from (select *, {_BIN} as bin_id from kept) where bin_id >= 0 group by 1, 2), {_smooth('tocc_s', 'tocc', 'occupancy_s', 'session')},
track as (select p.session, p.t, p.x, p.y, coalesce(v.speed, 0) as speed, coalesce(gap, 'infinity'::double) as gap from cp p left join moving v on v.session = p.session and v.frame_idx = p.frame_idx left join gp on gp.session = p.session),
tspikes as (select * from spikes s where exists (select 1 from every_epoch e where e.session = s.session and s.t >= e.start and s.t <= e.end) and not exists (select 1 from merged_events m where m.session = s.session and s.t >= m.start and s.t < m.end)),
tmerged as (select session, t, spike_row, cell_id, null as k, 1 as p from tspikes union all select session, t, null, null, {{'t': t, 'x': x, 'y': y, 'v': speed, 'g': gap}}, 0 from track),
tnear as (select *, last_value(k ignore nulls) over (partition by session order by t, p rows between unbounded preceding and current row) as a, first_value(k ignore nulls) over (partition by session order by t, p rows between current row and unbounded following) as b from tmerged),
tat as (select session, spike_row, cell_id, {', '.join(f"case when a is null then b.{c} when b is null or t = a.t then a.{c} when b.t - a.t > a.g then null else a.{c} + (b.{c} - a.{c}) * ((t - a.t) / (b.t - a.t)) end as {n}" for c, n in (('x', 'x'), ('y', 'y'), ('v', 'speed')))} from tnear where p = 1),
tbins as (select session, cell_id, bin_id, count(*)::double as n from (select *, {_BIN} as bin_id from tat where speed >= 0.5) where bin_id >= 0 group by 1, 2, 3), {_smooth('tcnt', 'tbins', 'n', 'session, cell_id')},
rates as (select o.session, c.cell_id, o.bin_id, o.occupancy_s, greatest(coalesce(k.n, 0) / greatest(o.occupancy_s, 0.05), 1e-4) as rate_hz from tocc_s o join (select distinct session, cell_id from spikes) c on o.session = c.session left join tcnt k on k.session = o.session and k.cell_id = c.cell_id and k.bin_id = o.bin_id)"""


@query(f"{TRAINING_SQL} select session, cell_id, bin_id, {_s('occupancy_s', digits=5)}, {_s('rate_hz', digits=5)} from rates")
def training_rate_map(spark, d):
    """Rates of movement in runs alone, without the events."""
    return training_rates(spark, d).select("session", "cell_id", "bin_id", _r("occupancy_s", digits=5), _r("rate_hz", digits=5))


@query(f"""{_P}, e as (select p.session, e.event_index, p.t, p.x, p.y from position p join short_events e on p.session = e.session and p.t >= e.start and p.t < e.end), s as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as step from e window w as (partition by session, event_index order by t)),
m as (select session, event_index, sum(step) as path_length, count(*) as points, arg_min(x, t) as ax, arg_min(y, t) as ay, arg_max(x, t) as bx, arg_max(y, t) as b_y from s group by 1, 2)
select session, event_index, {_s('path_length', digits=5)}, points, round(sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)), 5) + 0.0 as net_displacement, case when path_length > 0 then round(sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)) / path_length, 5) + 0.0 end as linearity from m""")
def path_metrics(spark, d):
    m = op.track_metrics(rel.position(spark, d), rel.short_events(spark, d))
    return m.select("session", "event_index", _r("path_length", digits=5), "points", _r("net_displacement", digits=5), _r("linearity", digits=5))


_VISITS = """visits as (select p.session, p.x, p.y, p.t, (select w.well_id from well_sequence w where w.session = p.session and w.fill_t <= p.t order by w.fill_t desc limit 1) as well_id, (select w.seq_idx from well_sequence w where w.session = p.session and w.fill_t <= p.t order by w.fill_t desc limit 1) as visit from position p),
vm as (select session, well_id, visit, median(x) as mx, median(y) as my, count(*) as n from visits where well_id is not null group by 1, 2, 3), wells as (select session, well_id, median(mx) as wx, median(my) as wy, sum(n)::bigint as samples from vm group by 1, 2 having sum(n) >= 3)"""


def wells(spark, d):
    both = rel.well_sequence(spark, d).select("session", "fill_t", F.struct("well_id", "seq_idx").alias("w"))
    v = op.backward(rel.position(spark, d), both, "w", "fill_t").where("w is not null")
    return op.well_positions(v.select("session", "x", "y", F.col("w.well_id").alias("well_id"), F.col("w.seq_idx").alias("visit")))


@query(f"{_P}, {_VISITS} select session, well_id, {_s('wx')}, {_s('wy')}, samples from wells")
def well_positions(spark, d):
    return wells(spark, d).select("session", "well_id", _r("wx"), _r("wy"), "samples")


@query(f"""{_P}, {_VISITS}, dist as (select p.session, p.frame_idx, w.well_id, sqrt(pow(p.x - w.wx, 2) + pow(p.y - w.wy, 2)) as distance from position p join wells w on p.session = w.session)
select session, frame_idx, well_id, round(distance, 5) + 0.0 as distance from (select *, row_number() over (partition by session, frame_idx order by distance, well_id) as r from dist) where r = 1""")
def nearest_well(spark, d):
    return op.nearest_well(rel.position(spark, d), wells(spark, d)).select("session", "frame_idx", "well_id", _r("distance", digits=5))


@query(f"""with {rel.SCORES_SQL}, c as (select session, event_index, row_key, model, test_spikes::bigint as n, n_time * 1.5 as mu from scores)
select session, event_index, row_key, model, round(n * ln(mu) - mu - coalesce(list_sum(list_transform(range(2, n + 1), lambda x: ln(x::double))), 0), 5) + 0.0 as poisson,
round(coalesce(list_sum(list_transform(range(0, n), lambda x: ln(2.0::double + x))), 0) - coalesce(list_sum(list_transform(range(2, n + 1), lambda x: ln(x::double))), 0) + 2.0 * ln(2.0::double / (2.0 + mu)) + n * ln(1.0::double - 2.0::double / (2.0 + mu)), 5) + 0.0 as negative_binomial from c""")
def count_likelihoods(spark, d):
    s = rel.scores(spark, d).select("session", "event_index", "row_key", "model", F.col("test_spikes").cast("long").alias("n"), (F.col("n_time") * 1.5).alias("mu"))
    return s.select("session", "event_index", "row_key", "model", _r(lk.poisson(F.col("n"), F.col("mu")), "poisson", 5), _r(lk.negative_binomial(F.col("n"), F.col("mu"), F.lit(0.5)), "negative_binomial", 5))


@query(f"""{_P}, e as (select session, event_index, start, "end" from short_events) select session, event_index, variant, {_s('a', 'start', 5)}, {_s('b', 'stop', 5)} from (
select session, event_index, 'pad_' || p as variant, greatest(0, start - p) as a, "end" + p as b from e, (values (0), (10), (20)) as pads(p) union all
select session, event_index, 'centre_half', greatest(0, (start + "end") / 2 - greatest(("end" - start) * 0.25, 20)), (start + "end") / 2 + greatest(("end" - start) * 0.25, 20) from e)""")
def window_variants(spark, d):
    v = gates.window_variants(rel.short_events(spark, d), [0.0, 10.0, 20.0], 40.0)
    return v.select("session", "event_index", "variant", _r("start", digits=5), _r("end", "stop", 5))


@query(f"""{_P}, b as (select *, ntile(4) over (partition by session order by t, frame_idx) as block from position), m as (select session, block, avg(x) as mx, avg(y) as my from b group by 1, 2), g as (select session, avg(x) as gx, avg(y) as gy from position group by 1)
select session, block::int as block, round(sqrt(pow(mx - gx, 2) + pow(my - gy, 2)), 5) + 0.0 as drift from m join g using (session)""")
def mark_drift(spark, d):
    p = rel.position(spark, d).withColumn("block", F.ntile(4).over(Window.partitionBy("session").orderBy("t", "frame_idx")))
    m = p.groupBy("session", "block").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    g = p.groupBy("session").agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"))
    return m.join(g, "session").select("session", "block", _r(F.sqrt(F.pow(F.col("mx") - F.col("gx"), 2) + F.pow(F.col("my") - F.col("gy"), 2)), "drift", 5))
