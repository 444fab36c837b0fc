"""Queries of behavioural labels, events to take, and matched windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..operators import decoding
from ..operators import labels as op
from ..operators import tracks
from ..sources import relations as rel
from .resampling_queries import _draw
from .track_queries import _ASOF, _P, _VISITS, GRID, RATES_SQL, rates, wells

QUERIES: dict = {}
#: The derived clock has samples minutes apart, so that visits are long and wide.
RADII, DWELLS, HORIZONS = (20.0, 40.0), (0.0, 20.0), (150.0, 300.0)
LINE = [(0.0, 0.0), (100.0, 20.0), (100.0, 80.0), (200.0, 100.0)]


def _r(c, name=None, digits=6):
    return ev.rounded(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)


def _s(c, name=None, digits=6):
    return f"round({c}, {digits}) + 0.0 as {name or c}"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f
    return add


_LABELS = f"""{_P}, {_VISITS}, near as (select e.session, e.event_index, e.peak, w.well_id, w.wx, w.wy, p.t, sqrt(pow(p.x - w.wx, 2) + pow(p.y - w.wy, 2)) as gap from short_events e join position p on p.session = e.session and p.t >= e.peak and p.t <= e.peak + {max(HORIZONS)}::double join wells w on w.session = e.session),
cut as (select *, gap <= radius as inside from near, (values {', '.join(f'({r}::double)' for r in RADII)}) as r(radius), (values {', '.join(f'({h}::double)' for h in HORIZONS)}) as h(horizon) where t <= peak + horizon),
flag as (select *, (inside and not coalesce(lag(inside) over (partition by session, event_index, radius, horizon, well_id order by t), false))::int as b from cut),
numbered as (select *, sum(b) over (partition by session, event_index, radius, horizon, well_id order by t rows unbounded preceding) as run from flag),
stays as (select session, event_index, radius, horizon, well_id, run, min(t) as arrival, max(t) - min(t) as dwell_s, any_value(wx) as wx, any_value(wy) as wy from numbered where inside group by 1, 2, 3, 4, 5, 6),
firsts as (select session, event_index, radius, horizon, min_dwell, min({{'a': arrival, 'w': well_id, 'd': dwell_s, 'x': wx, 'y': wy}}) as v from stays, (values {', '.join(f'({d}::double)' for d in DWELLS)}) as d(min_dwell) where dwell_s >= min_dwell group by 1, 2, 3, 4, 5),
labels as (select e.session, e.event_index, e.peak, radius, min_dwell, horizon, v.w as true_well_id, v.x as true_well_x, v.y as true_well_y, v.a - e.peak as time_to_arrival_s, v.d as dwell_s, v is not null as valid_label, case when v is not null then '' when e.session not in (select session from wells) then 'no_well_locations' else 'no_visit_within_horizon' end as exclude_reason
 from short_events e cross join (values {', '.join(f'({r}::double)' for r in RADII)}) as r(radius) cross join (values {', '.join(f'({h}::double)' for h in HORIZONS)}) as h(horizon) cross join (values {', '.join(f'({d}::double)' for d in DWELLS)}) as d(min_dwell) left join firsts f using (session, event_index, radius, horizon, min_dwell))"""
_ONE = f"radius = {RADII[0]} and min_dwell = {DWELLS[1]} and horizon = {HORIZONS[1]}"


@query(f"{_LABELS} select session, event_index, true_well_id, {_s('time_to_arrival_s', digits=5)}, {_s('dwell_s', digits=5)}, valid_label, exclude_reason from labels where {_ONE}")
def visit_labels(spark, d):
    """The first well that is reached and stayed at after each event."""
    v = op.visit_labels(rel.short_events(spark, d), rel.position(spark, d), wells(spark, d), RADII[0], DWELLS[1], HORIZONS[1])
    return v.select("session", "event_index", "true_well_id", _r("time_to_arrival_s", digits=5), _r("dwell_s", digits=5), "valid_label", "exclude_reason")


@query(f"{_LABELS} select radius, min_dwell, horizon, count(*) as events, sum(valid_label::int)::bigint as labelled, {_s('avg(time_to_arrival_s)', 'mean_time', 5)}, count(distinct true_well_id) as wells_seen from labels group by 1, 2, 3")
def label_sensitivity(spark, d):
    s = op.sensitivity(rel.short_events(spark, d), rel.position(spark, d), wells(spark, d), RADII, DWELLS, HORIZONS)
    return s.groupBy("radius", "min_dwell", "horizon").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("valid_label").cast("long")).alias("labelled"), _r(F.avg("time_to_arrival_s"), "mean_time", 5), F.countDistinct("true_well_id").alias("wells_seen"))


_ENDS = """ends as (select session, event_index, arg_max(x, t) as ex, arg_max(y, t) as ey from (select e.session, e.event_index, p.t, p.x, p.y from position p join short_events e on e.session = p.session and p.t >= e.start and p.t < e.end) group by 1, 2),
dec as (select session, event_index, ex, ey, well_id as decoded_well_id from (select n.*, w.well_id, row_number() over (partition by n.session, n.event_index order by sqrt(pow(ex - wx, 2) + pow(ey - wy, 2)), w.well_id) as r from ends n join wells w using (session)) where r = 1)"""


@query(f"""{_LABELS}, {_ENDS} select d.session, d.event_index, decoded_well_id, l.true_well_id, g.active as active_goal_id, case when valid_label then decoded_well_id = l.true_well_id end as goal_correct, case when valid_label and g.active is not null then decoded_well_id = g.active end as active_goal_correct, case when valid_label then round(sqrt(pow(ex - true_well_x, 2) + pow(ey - true_well_y, 2)), 5) + 0.0 end as endpoint_error
from dec d left join (select * from labels where {_ONE}) l using (session, event_index) left join (select e.session, e.event_index, (select w.well_id from well_sequence w where w.session = e.session and w.fill_t <= e.peak order by w.fill_t desc limit 1) as active from short_events e) g using (session, event_index)""")
def label_metrics(spark, d):
    """The place where each event's track ends, as a decoded well, against the next visit and the active goal."""
    e, w = rel.short_events(spark, d), wells(spark, d)
    near = tracks.nearest_well(tracks.last_inside(rel.position(spark, d), e), w).select("session", "event_index", F.col("x").alias("endpoint_x"), F.col("y").alias("endpoint_y"), F.col("well_id").alias("decoded_well_id"))
    active = tracks.backward(e.select("session", "event_index", F.col("peak").alias("t")), rel.well_sequence(spark, d), "well_id", "fill_t").select("session", "event_index", F.col("well_id").alias("active_goal_id"))
    v = op.visit_labels(e, rel.position(spark, d), w, RADII[0], DWELLS[1], HORIZONS[1])
    m = op.label_metrics(near.join(active, ["session", "event_index"], "left"), v)
    return m.select("session", "event_index", "decoded_well_id", "true_well_id", "active_goal_id", "goal_correct", "active_goal_correct", _r("endpoint_error", digits=5))


_CENTRES = "places as (select b, 12.5::double + 25 * (b // 4) as cx, 12.5::double + 25 * (b % 4) as cy from range(32) as r(b))"


@query(f"""{_P}, {_VISITS}, {_CENTRES}, g as (select session, well_id, b, sqrt(pow(cx - wx, 2) + pow(cy - wy, 2)) as gap from wells, places), m as (select *, min(gap) over (partition by session, well_id) <= 30 as any_, row_number() over (partition by session, well_id order by gap, b) as r from g),
o as (select *, row_number() over (partition by session, b order by gap, well_id) as k from m where gap <= 30 or (not any_ and r = 1)) select session, well_id, b::int as bin_id from o where k = 1""")
def places_near_wells(spark, d):
    return op.well_places(wells(spark, d), GRID, 30.0)


_POINTS = "pts as (select session, peak + k * 60.0::double as t, event_index * 3 + k as spike_row, k as cell_id from short_events, (values (-1), (0), (1)) as o(k))"


@query(f"""{_P}, {_VISITS}, {_POINTS}, {_ASOF.replace('from spikes', 'from pts')}, w as (select session, (spike_row - cell_id) // 3 as event_index, max(case when cell_id = -1 then x end) as xb, max(case when cell_id = -1 then y end) as yb, max(case when cell_id = 0 then x end) as x, max(case when cell_id = 0 then y end) as y, max(case when cell_id = 1 then x end) as xa, max(case when cell_id = 1 then y end) as ya from located group by 1, 2),
n as (select w.*, well_id, sqrt(pow(x - wx, 2) + pow(y - wy, 2)) as dist, row_number() over (partition by w.session, event_index order by sqrt(pow(x - wx, 2) + pow(y - wy, 2)), well_id) as r from w join wells using (session))
select n.session, n.event_index, {_s('x', 'x_now', 4)}, {_s('y', 'y_now', 4)}, {_s('sqrt(pow(xa - xb, 2) + pow(ya - yb, 2))', 'moved', 4)}, (select s.well_id from well_sequence s where s.session = n.session and s.fill_t <= e.peak order by s.fill_t desc limit 1) as active_goal_id, n.well_id as nearest_well_id, {_s('dist', 'nearest_well_distance', 4)} from n join short_events e on e.session = n.session and e.event_index = n.event_index where r = 1""")
def behaviour_context(spark, d):
    """Place, movement, goal and nearest well at each event."""
    b = op.behaviour_context(rel.short_events(spark, d), rel.position(spark, d), rel.well_sequence(spark, d), wells(spark, d), 60.0)
    return b.select("session", "event_index", _r("x_now", digits=4), _r("y_now", digits=4), _r("moved", digits=4), "active_goal_id", "nearest_well_id", _r("nearest_well_distance", digits=4))


@query(f"""{_P}, {rel.EVERY_EPOCH_SQL} select session, event_index from (select session, event_index, row_number() over (partition by session order by start, event_index) as r from short_events s where exists (select 1 from every_epoch e where e.session = s.session and s.peak >= e.start and s.peak <= e.end)) where r <= 20""")
def events_in_runs(spark, d):
    """The feature is the limit: the first 20 events of each session whose peak lies in a run."""
    return op.select_events(rel.short_events(spark, d), rel.every_epoch(spark, d), "run", 20).select("session", "event_index")


@query(f"""{_P} select session, event_index from (select session, event_index, row_number() over (partition by session order by {_draw("'pick'", 'session', 'event_index')}, event_index) as r from short_events) where r <= 15""")
def drawn_events(spark, d):
    """The feature is the limit: 15 events of each session, drawn by digest."""
    return op.select_events(rel.short_events(spark, d), rel.every_epoch(spark, d), "all", 15, "pick").select("session", "event_index")


@query(f"{_P}, c as (select distinct session, cell_id, cell_id % 3 <> 0 and session not like '%Open2' as exc from spikes) select s.session, s.cell_id, count(*) as spikes from spikes s join c using (session, cell_id) where c.exc or s.session not in (select session from c where exc) group by 1, 2")
def excitatory_spikes(spark, d):
    """Sessions in which no cell is excitatory keep all spikes."""
    s = rel.spikes(spark, d)
    cells = s.select("session", "cell_id", F.when((F.col("cell_id") % 3 != 0) & ~F.col("session").endswith("Open2"), "exc").otherwise("inh").alias("cls")).distinct()
    return op.excitatory(s, cells).groupBy("session", "cell_id").agg(F.count(F.lit(1)).alias("spikes"))


@query(f"{RATES_SQL} select session, bin_id, {_s('any_value(occupancy_s)', 'occupancy_s', 5)}, {_s('sum(rate_hz)', 'total_hz', 4)} from rates group by 1, 2 having any_value(occupancy_s) > 2 and sum(rate_hz) >= 0.5")
def valid_states(spark, d):
    return op.valid_states(rates(spark, d), 2.0, 0.5).select("session", "bin_id", _r("occupancy_s", digits=5), _r("total_hz", digits=4))


def _line_sql():
    parts, start = [], 0.0
    for i, ((ax, ay), (bx, by)) in enumerate(zip(LINE[:-1], LINE[1:])):
        size = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        share = f"greatest(0, least(1, ((x - {ax}) * {bx - ax} + (y - {ay}) * {by - ay}) / {size**2!r}::double))"
        parts.append(f"{{'o': sqrt(pow(x - {ax} - {share} * {bx - ax}, 2) + pow(y - {ay} - {share} * {by - ay}, 2)), 'p': {i}, 'a': {start!r}::double + {share} * {size!r}::double}}")
        start += size
    return f"list_min([{', '.join(parts)}])"


@query(f"{_P}, l as (select session, frame_idx, {_line_sql()} as n from position) select session, frame_idx, {_s('n.a', 'along', 4)}, {_s('n.o', 'off_line', 4)} from l")
def centreline(spark, d):
    """Each sample's place along a line of three parts."""
    return op.centreline(rel.position(spark, d), LINE).select("session", "frame_idx", _r("along", digits=4), _r("off_line", digits=4))


_RULES = f"""{_P}, {rel.EVERY_EPOCH_SQL}, rr as (select session, start, "end", max("end") over (partition by session order by start, "end" rows between unbounded preceding and 1 preceding) as before from every_epoch),
base as (select session, min(start) as a, max("end") as b from (select *, sum(case when before is null or start > before then 1 else 0 end) over (partition by session order by start, "end" rows unbounded preceding) as i from rr) group by session, i),
rp as (select session, event_index, peak as start, peak + 10 as "end" from short_events), pd as (select session, start - 2 as start, "end" + 2 as "end", max("end" + 2) over (partition by session order by start, "end" rows between unbounded preceding and 1 preceding) as before from rp),
tk as (select session, min(start) as a, max("end") as b from (select *, sum(case when before is null or start > before then 1 else 0 end) over (partition by session order by start, "end" rows unbounded preceding) as i from pd) group by session, i),
ed as (select session, '-infinity'::double as a, min(a) as b from tk group by 1 union all select session, b, coalesce(lead(a) over (partition by session order by a), 'infinity'::double) from tk),
gp as (select base.session, greatest(base.a, ed.a) as low, least(base.b, ed.b) as high from base join ed on ed.session = base.session and greatest(base.a, ed.a) < least(base.b, ed.b)),
cand as (select r.session, r.event_index, low, low + k * 5.0::double as a from (select rp.session, rp.event_index, low, unnest(range(0, floor((high - low - 10) / 5.0)::bigint + 1)) as k from rp join gp on gp.session = rp.session and high - low >= 10) r),
cs as (select distinct session, a from cand), cn as (select c.session, c.a, count(s.t) as n, count(distinct s.cell_id) as k from cs c left join spikes s on s.session = c.session and s.t >= c.a and s.t < c.a + 10 group by 1, 2),
en as (select r.session, r.event_index, count(s.t) as n, count(distinct s.cell_id) as k from rp r left join spikes s on s.session = r.session and s.t >= r.start and s.t < r.end group by 1, 2),
sc as (select c.session, c.event_index, c.a, cn.n, cn.k, en.n as en, en.k as ek, abs(cn.n - en.n) <= greatest(1.0, 0.1 * greatest(en.n, 1)) as ok from cand c join cn using (session, a) join en using (session, event_index)),
el as (select *, sum(ok::int) over (partition by session, event_index) as fit, count(*) over (partition by session, event_index) as candidates from sc),
rk as (select *, row_number() over (partition by session, event_index order by abs(n - en), abs(k - ek), a) as match from el where ok or fit < 3)"""


@query(f"""{_RULES} select session, event_index, match, {_s('a', 'start', 4)}, n as null_spikes, k as null_active, en as n_spikes, ek as n_active, candidates, fit >= 3 as within_tolerance from rk where match <= 3""")
def matched_windows(spark, d):
    """Three windows a short event, in runs, clear of padded events and close in spikes and cells."""
    e = rel.short_events(spark, d).select("session", "event_index", F.col("peak").alias("start"), (F.col("peak") + 10).alias("end"))
    m = decoding.matched_windows(e, rel.spikes(spark, d), 3, runs=rel.every_epoch(spark, d), padding=2.0)
    return m.select("session", "event_index", "match", _r("start", digits=4), "null_spikes", "null_active", "n_spikes", "n_active", "candidates", "within_tolerance")
