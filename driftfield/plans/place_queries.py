"""Queries of kernel densities of marks, ways and routes over places, and candidate supports."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..operators import batches, candidates, chains, decoding, graph, marks, models, priors, regression, reports, separable, tracks
from ..sources import relations as rel
from ..sources.rounds import written
from .model_queries import _FORWARD, _LL, DT, GOALS, _decoded, _emissions, _featured, _marks
from .track_queries import _ASOF, _BIN, _BINS, _P, _VISITS, GRID, RATES_SQL, rates, wells

QUERIES: dict = {}
#: Kernels of a fixed width, so that a spike meets the marks about it only.
KERNELS = marks.Kernels(bandwidth=4.0, reach=3.0)
GROUPS = 4
SIGMA = 30.0


def _r(c, name=None, digits=6):
    return ev.rounded(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)


def _s(c, name=None, digits=6):
    return f"round({c}, {digits}) + 0.0 as {name or c}"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f
    return add


_KERNEL = f"""{RATES_SQL}, km0 as (select l.session, l.spike_row as id, l.cell_id % {GROUPS} as grp, l.t, l.x, l.y, s.value as f1, s.k as f2 from located l join stream s on s.event_id = l.spike_row),
km1 as (select session, id, grp, f1, f2, {_BIN} as pl from km0), km as (select * from km1 where pl >= 0 union all select session, id, -1, f1, f2, pl from km1 where pl >= 0),
kk as (select session, grp, least(count(*), {KERNELS.neighbours}) as kept from km group by 1, 2),
kn as (select km.*, b as bin_id, pow(pl // 4 - b // 4, 2) + pow(pl % 4 - b % 4, 2) as d2 from km, range(32) as p(b)),
kr as (select * from (select *, row_number() over (partition by session, grp, bin_id order by d2, pl, id) as r from kn) join kk using (session, grp) where r <= kept),
ksup as (select session, grp, bin_id, f1, f2, ln((exp(-0.5 * d2) + 1.0 / kept) / sum(exp(-0.5 * d2) + 1.0 / kept) over (partition by session, grp, bin_id)) as log_w from kr)"""


def _grouped(m):
    return m.withColumn("mark_id", F.col("spike_row")).withColumn("grp", (F.col("cell_id") % GROUPS).cast("long"))


def _training(spark, d):
    return _grouped(_marks(spark, d)).select("session", "t", "x", "y", "f1", "f2", "mark_id", "grp")


@query(f"{_KERNEL} select session, grp::bigint as grp, bin_id::int as bin_id, count(*) as marks, {_s('sum(exp(log_w) * f1)', 'f1_mean', 5)}, {_s('sum(exp(log_w) * f2)', 'f2_mean', 5)} from ksup group by 1, 2, 3")
def mark_kernel_support(spark, d):
    """The marks that stand for each place, by group and for the whole session, and their weighted means."""
    s = marks.kernel_support(marks.with_whole(_training(spark, d), "grp"), GRID, ["f1", "f2"], ["session", "grp"], KERNELS)
    return s.groupBy("session", "grp", "bin_id").agg(F.count(F.lit(1)).alias("marks"), *[_r(F.sum(F.exp("log_w") * F.col(c)), f"{c}_mean", 5) for c in ("f1", "f2")])


def kernel_emissions(spark, d):
    """Emissions by groups of marks; the last group is unseen in training, so its marks count as the session's."""
    seen = marks.with_whole(written(_training(spark, d).where(F.col("grp") < GROUPS - 1), "training"), "grp")
    support, widths = marks.kernel_support(seen, GRID, ["f1", "f2"], ["session", "grp"], KERNELS), marks.kernel_bandwidths(seen, ["f1", "f2"], ["session", "grp"], KERNELS)
    by_group = rates(spark, d).withColumn("grp", (F.col("cell_id") % GROUPS).cast("long")).where(F.col("grp") < GROUPS - 1)
    by_group = marks.with_whole(by_group, "grp").groupBy("session", "grp", "bin_id").agg(F.sum("rate_hz").alias("rate_hz"))
    return marks.kernel_events(_grouped(_featured(spark, d)), rel.short_events(spark, d), support, widths, by_group, ["f1", "f2"], "grp", DT, GRID.nx * GRID.ny, KERNELS)


_LOW = repr(-0.5 * KERNELS.reach**2)
_NORM = repr(2 * (math.log(KERNELS.bandwidth**2) + math.log(2 * math.pi)))
_KLL = f"""{_KERNEL.replace('from km0)', f'from km0 where grp < {GROUPS - 1})')}, {_BINS}, krate as (select session, g as grp, bin_id, sum(rate_hz) as rate_hz from (select session, unnest([cell_id % {GROUPS}, -1]) as g, bin_id, rate_hz from rates where cell_id % {GROUPS} < {GROUPS - 1}) group by 1, 2, 3),
ksp as (select e.session, e.event_index, floor((m.t - e.start) / 20.0)::int as t_idx, case when m.grp < {GROUPS - 1} then m.grp else -1 end as grp, m.id, m.f1, m.f2 from km0 m join short_events e on e.session = m.session and m.t >= e.start and m.t < e.end),
kq as (select k.session, event_index, t_idx, k.grp, id, bin_id, sum(exp(log_w - 0.5 * q)) as s, sum(exp(log_w)) as w from (select p.*, s.bin_id, s.log_w, (pow(p.f1 - s.f1, 2) + pow(p.f2 - s.f2, 2)) / {KERNELS.bandwidth**2}::double as q from ksp p join ksup s on s.session = p.session and s.grp = p.grp and abs(p.f1 - s.f1) <= {KERNELS.reach * KERNELS.bandwidth}::double and abs(p.f2 - s.f2) <= {KERNELS.reach * KERNELS.bandwidth}::double) k where q <= {KERNELS.reach**2}::double group by all),
kone as (select p.session, p.event_index, p.t_idx, r.bin_id, ln(r.rate_hz) + ln(coalesce(s, 0) + exp({_LOW}::double) * greatest(0, 1 - coalesce(w, 0))) - {_NORM}::double / 2 as v from ksp p join krate r on r.session = p.session and r.grp = p.grp left join kq on kq.session = p.session and kq.event_index = p.event_index and kq.t_idx = p.t_idx and kq.id = p.id and kq.bin_id = r.bin_id),
kbin as (select session, event_index, t_idx, bin_id, sum(v) as v, count(*) as n from kone group by 1, 2, 3, 4),
kll as (select b.session, b.event_index, b.t_idx, r.bin_id, coalesce(v, 0) - r.rate_hz * bin_dur + coalesce(n, 0) * ln(bin_dur) - coalesce(list_sum(list_transform(range(2, coalesce(n, 0) + 1), lambda x: ln(x::double))), 0) as ll from eb b join krate r on r.session = b.session and r.grp = -1 left join kbin k on k.session = b.session and k.event_index = b.event_index and k.t_idx = b.t_idx and k.bin_id = r.bin_id)"""


@query(f"""{_KLL}, rt as (select session, event_index, sum(mm + ln(e / 32)) as v from (select session, event_index, t_idx, any_value(mm) as mm, sum(exp(ll - mm)) as e from (select *, max(ll) over (partition by session, event_index, t_idx) as mm from kll) group by 1, 2, 3) group by 1, 2),
st as (select session, event_index, any_value(mm) + ln(sum(exp(s - mm)) / 32) as v from (select *, max(s) over (partition by session, event_index) as mm from (select session, event_index, bin_id, sum(ll) as s from kll group by 1, 2, 3)) group by 1, 2)
select session, event_index, 'clusterless-kde-random' as model, round(v, 3) + 0.0 as log_evidence from rt union all select session, event_index, 'clusterless-kde-stationary', round(v, 3) + 0.0 from st""")
def kernel_mark_evidence(spark, d):
    """Static models on kernel densities by group, with marks of a group that training never saw."""
    s = batches.score_batched(kernel_emissions(spark, d), GRID, ["random", "stationary"], models.Motion(), DT, prefix="clusterless-kde-")
    return s.select("session", "event_index", "model", _r("log_evidence", digits=3))


def _held(spark, d):
    """Places that a session held for at least as long as its places on average."""
    o = rates(spark, d).groupBy("session", "bin_id").agg(F.first("occupancy_s").alias("o"))
    return o.withColumn("m", F.avg("o").over(Window.partitionBy("session"))).where("o >= m").select("session", "bin_id")


_WAYS = f"""{{of}}, ho as (select distinct session, bin_id, occupancy_s from rates), hp as (select session, bin_id from (select *, avg(occupancy_s) over (partition by session) as m from ho) where occupancy_s >= m),
w0 as materialized (select a.session, a.bin_id as src, b.bin_id as dst, 25.0::double * sqrt((pow(a.bin_id // 4 - b.bin_id // 4, 2) + pow(a.bin_id % 4 - b.bin_id % 4, 2))::double) as d from hp a join hp b on b.session = a.session and abs(a.bin_id // 4 - b.bin_id // 4) <= 1 and abs(a.bin_id % 4 - b.bin_id % 4) <= 1),
""" + ",\n".join(f"w{k + 1} as materialized (select a.session, a.src, b.dst, min(a.d + b.d) as d from w{k} a join w{k} b on b.session = a.session and b.src = a.dst group by 1, 2, 3)" for k in range(5))


def _ways(spark, d, longest=None):
    held = written(_held(spark, d), "held")  # the rounds read it, not the maps that it comes from
    return graph.shortest_ways(graph.place_edges(held, GRID), held.select("session", F.col("bin_id").alias("src")), longest)


@query(f"{_WAYS.format(of=RATES_SQL)} select session, src::int as src, dst::int as dst, {_s('d', 'distance', 5)} from w5")
def shortest_ways(spark, d):
    """The shortest way between the places that a session held, over those beside each other."""
    return _ways(spark, d).select("session", "src", "dst", _r("distance", digits=5))


@query(f"{_WAYS.format(of=RATES_SQL)} select session, component::int as component, count(*) as places from (select session, src, min(dst) as component from w5 group by 1, 2) group by 1, 2")
def place_components(spark, d):
    return graph.way_components(_ways(spark, d)).groupBy("session", "component").agg(F.count(F.lit(1)).alias("places"))


_WAY_FORWARD = f"""{_WAYS.format(of=_LL)}, ws as (select session, src, dst, w / sum(w) over (partition by session, src) as p from (select *, exp(-0.5 * d * d / {SIGMA * SIGMA}::double) as w from w5 where d <= {4 * SIGMA}::double)),
hs as (select distinct session from hp), hx as (select session, b from hs, range(32) as r(b)), hl as (select hx.session, list(case when hp.bin_id is null then 0 else 1 end order by b) as here, count(hp.bin_id) as nv from hx left join hp on hp.session = hx.session and hp.bin_id = b group by 1),
wm as (select session, list(r order by x) as m from (select a.session, a.b as x, list(coalesce(p, 0) order by c.b) as r from hx a join hx c on c.session = a.session left join ws on ws.session = a.session and ws.dst = a.b and ws.src = c.b group by 1, 2) group by 1),
wa as (select session, event_index, t_idx, list_transform(list_zip(l, here), lambda k: exp(k[1] - list_max(l)) * k[2]) as e, list_max(l) as top, nv, n from (select session, event_index, t_idx, list(ll order by bin_id) as l, count(*) over (partition by session, event_index) as n from ll group by 1, 2, 3) join hl using (session)),
wf as (with recursive f as (select session, event_index, t_idx, n, list_transform(e, lambda v: v / list_sum(e)) as p, ln(list_sum(e) / nv) + top as v from wa where t_idx = 0
 union all select session, event_index, t_idx, n, list_transform(u, lambda x: x / list_sum(u)), v + ln(list_sum(u)) + top from (select a.session, a.event_index, a.t_idx, a.n, a.top, f.v, list_transform(list_zip(m, a.e), lambda k: list_dot_product(k[1], p) * k[2]) as u from f join wa a on a.session = f.session and a.event_index = f.event_index and a.t_idx = f.t_idx + 1 join wm on wm.session = a.session))
 select * from f where t_idx = n - 1)"""


@query(f"{_WAY_FORWARD} select session, event_index, 'topological-geodesic-diffusion' as model, round(v, 4) + 0.0 as log_evidence from wf")
def geodesic_evidence(spark, d):
    """Diffusion along the ways of the places that a session held; the SQL runs the recursion itself."""
    steps = graph.way_steps(_ways(spark, d, 4 * SIGMA), SIGMA)
    s = graph.score_ways(_emissions(spark, d, graph.way_matrices(steps, GRID.nx * GRID.ny)), None, GRID.nx * GRID.ny, "topological-geodesic-diffusion")
    return s.select("session", "event_index", "model", _r("log_evidence", digits=4))


_ROUTES = """rp as (select a.session, row_number() over (partition by a.session order by a.well_id, b.well_id) - 1 as route, a.wx as x1, a.wy as y1, b.wx - a.wx as dx, b.wy - a.wy as dy from wells a join wells b on b.session = a.session and a.well_id < b.well_id),
ru as (select l.session, l.spike_row, route, l.x - x1 as gx, l.y - y1 as gy, dx, dy, least(greatest(case when dx * dx + dy * dy > 0 then ((l.x - x1) * dx + (l.y - y1) * dy) / (dx * dx + dy * dy) else 0 end, 0), 1) as u from located l join rp using (session)),
rd as (select *, row_number() over (partition by session, spike_row order by d, route) as r from (select *, round(sqrt((gx - u * dx) * (gx - u * dx) + (gy - u * dy) * (gy - u * dy)), 9) as d from ru))"""


@query(f"{_P}, {_VISITS}, {_ASOF}, {_ROUTES} select l.session, l.spike_row, route::int as route, {_s('d', 'route_distance', 5)}, {_s('u', 'route_progress', 5)} from located l left join rd on rd.session = l.session and rd.spike_row = l.spike_row and r = 1")
def route_labels(spark, d):
    """The nearest route between wells of every spike's place, and how far along it that lies."""
    w = wells(spark, d).select("session", "well_id", F.col("wx").alias("x"), F.col("wy").alias("y"))
    at = tracks.as_of(rel.spikes(spark, d), rel.position(spark, d), ["x", "y"]).select("session", "spike_row", "x", "y")
    r = graph.route_labels(at, graph.well_routes(w, both_ways=False), ["spike_row"])
    return r.select("session", "spike_row", "route", _r("route_distance", digits=5), _r("route_progress", digits=5))


MASS, LEAST, MOST, PREDICTED, DECAY = 0.9, 4, 12, 3, 0.95
_AHEAD = "least(greatest(ceil((({b} // 4 + 0.5) * 25.0 + {f} * (({b} // 4 + 0.5) * 25.0 - ({a} // 4 + 0.5) * 25.0)) / 25.0 - 1), 0), 7)::int * 4 + least(greatest(ceil((({b} % 4 + 0.5) * 25.0 + {f} * (({b} % 4 + 0.5) * 25.0 - ({a} % 4 + 0.5) * 25.0)) / 25.0 - 1), 0), 3)::int"
_KEPT = f"""{_LL}, c0 as (select session, event_index, t_idx, bin_id, exp(ll - max(ll) over (partition by session, event_index, t_idx)) as e, row_number() over (partition by session, event_index, t_idx order by ll desc, bin_id) as r from ll),
c1 as (select *, sum(e) over (partition by session, event_index, t_idx order by r) / sum(e) over (partition by session, event_index, t_idx) as held from c0),
c2 as (select session, event_index, t_idx, greatest({LEAST}, least({MOST}, 1 + count(*) filter (held + {candidates._TOLERANCE!r} < {MASS}))) as base_size, sum(e) as whole from c1 group by 1, 2, 3),
top as (select session, event_index, t_idx, bin_id from c0 where r <= {PREDICTED}),
sup as (select session, event_index, t_idx, bin_id from c0 join c2 using (session, event_index, t_idx) where r <= base_size
 union select x.session, x.event_index, x.t_idx, {_AHEAD.format(a='a.bin_id', b='b.bin_id', f=f'{DECAY}::double')} from c2 x join top a on a.session = x.session and a.event_index = x.event_index and a.t_idx = x.t_idx - 2 join top b on b.session = x.session and b.event_index = x.event_index and b.t_idx = x.t_idx - 1
 union select x.session, x.event_index, x.t_idx, {_AHEAD.format(a='a.bin_id', b='b.bin_id', f=f'(1 / {DECAY}::double)')} from c2 x join top a on a.session = x.session and a.event_index = x.event_index and a.t_idx = x.t_idx + 2 join top b on b.session = x.session and b.event_index = x.event_index and b.t_idx = x.t_idx + 1),
kept as (select session, event_index, t_idx, any_value(base_size) as base_size, count(*) as support_size, ln(sum(e) / any_value(whole)) as log_mass from sup join c0 using (session, event_index, t_idx, bin_id) join c2 using (session, event_index, t_idx) group by 1, 2, 3)"""


def _supports(spark, d):
    return candidates.candidate_supports(_emissions(spark, d), GRID, MASS, top_k=LEAST, max_k=MOST, predicted=PREDICTED, decay=DECAY)


@query(f"{_KEPT} select session, event_index, t_idx, base_size, support_size, {_s('log_mass')} from kept")
def candidate_supports(spark, d):
    """How many places of each bin are kept, by mass and by predicted motion, and the log mass that they hold."""
    return _supports(spark, d).select("session", "event_index", "t_idx", F.col("base_size").cast("long").alias("base_size"), F.size("support").cast("long").alias("support_size"), _r("log_mass"))


@query(f"""{_KEPT}, em as (select session, event_index, avg(log_mass) as m from kept group by 1, 2)
select session, event_index, {_s('m', 'candidate_log_mass')}, case when m >= {reports.GOOD_MASS} then '{reports.GOOD}' when m >= {reports.WARNING_MASS} then '{reports.WARNING}' else '{reports.POOR}' end as candidate_support_quality from em""")
def measured_support_quality(spark, d):
    """The quality of pruned evidence by the mass that its supports were measured to hold."""
    m = candidates.support_masses(_supports(spark, d)).withColumn("evidence_support", F.lit(ev.TRUNCATED)).withColumn("status", F.lit("success"))
    return reports.candidate_quality(m).select("session", "event_index", _r("candidate_log_mass"), "candidate_support_quality")


@query()
def supported_evidence(spark, d):
    """Pruned and candidate models on supports chosen by mass and predicted motion, with the log mass that these hold."""
    s = _supports(spark, d)
    names = ["state-space-momentum", "state-space-imm", "candidate-stationary", "candidate-diffusion", "candidate-momentum", "candidate-imm", "candidate-jump"]
    scored = models.score_events(s, GRID, names, models.Motion(), DT).join(candidates.support_masses(s), ["session", "event_index"])
    return scored.select("session", "event_index", "model", "evidence_support", _r("log_evidence", digits=5), _r("candidate_log_mass"), _r("mean_support"))


@query(f"""{_FORWARD} select session, event_index, unnest(['stationary', 'diffusion', 'fragmented']) as mode, round(unnest([list_sum(p0), list_sum(p1), list_sum(p2)]), 5) + 0.0 as probability from fw""")
def mode_probabilities(spark, d):
    """Which mode of the switching model each event ends in."""
    return chains.mode_probabilities(_emissions(spark, d), GRID, models.Motion(), DT).select("session", "event_index", "mode", _r("probability", digits=5))


@query()
def goal_probabilities(spark, d):
    """Which of four goals each event's path drifts to."""
    g = models.goal_probabilities(_emissions(spark, d), GRID, GOALS, models.Motion(), DT)
    return g.select("session", "event_index", "goal", _r("log_evidence", digits=5), _r("probability"))


@query()
def position_decoding_summary(spark, d):
    """Errors, ranks and probabilities of decoded positions by session, over all folds."""
    s = decoding.decoding_summary(_decoded(spark, d))
    return s.select("session", "windows", "folds", *[_r(c, digits=5) for c in ("median_mean_error", "median_map_error", "median_true_rank", "mean_true_probability", "mean_spikes")])


@query()
def fitted_prior_evidence(spark, d):
    """Diffusion and momentum of the separable suite, marginalised under priors fitted to each session's best settings."""
    grid = separable.Settings(still=(25.0,), diffusion=(4.0, 8.0, 16.0, 32.0, 64.0), momentum=(1.0, 4.0, 16.0, 64.0), decay=(0.05, 0.2, 0.5, 1.0), initial=1.0)
    # priors and margins of both models read the scores, which are made once
    scored = written(separable.score_settings(_emissions(spark, d), GRID, grid, DT).select("session", "event_index", "model", "scale", "decay", "log_evidence"), "settings")
    event, out = ["session", "event_index", "model"], None
    for model, settings in (("diffusion", ["scale"]), ("momentum", ["scale", "decay"])):
        mine = scored.where(F.col("model") == model)
        prior = priors.fitted_priors(mine, event, ["session", "model"], settings, "log_evidence")
        m = regression.marginal_evidence(mine.join(prior, ["session", "model", *settings]), event, "log_evidence", "prior")
        out = m if out is None else out.unionByName(m)
    return out.select(*event, "settings", _r("marginal_log_evidence", digits=5))


_KINDS = {"errors": "error", "signups": "signup", "purchases": "purchase"}
_OVERLAPS = f"""{_P}, win as (select session, event_id as event_index, user_id % 3 as null_index, event_type, value, t as start, t + 5 + k / 20.0::double as "end" from stream where event_type in {tuple(_KINDS.values())}),
free as (select * from win w where not (event_type <> 'error' and exists (select 1 from win x where x.event_type = 'error' and x.session = w.session and x.event_index = w.event_index + 1 and x.null_index = w.null_index))),
om as (select *, max("end") over (partition by session order by start, "end" rows between unbounded preceding and 1 preceding) as reach from free),
og as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (partition by session order by start, "end" rows unbounded preceding) as g from om),
oc as (select session, g, {', '.join(f"sum((event_type = '{t}')::int)::bigint as {n}" for n, t in _KINDS.items())} from og group by 1, 2),
ob as (select *, row_number() over (partition by session, g order by value desc, event_index, null_index) as r from og where value is not null)"""


def _windows(spark, d, kind):
    s = rel._stream(spark, d).where(F.col("event_type") == kind)
    return s.select("session", F.col("event_id").alias("event_index"), (F.col("user_id") % 3).alias("null_index"), F.col("t").alias("start"), (F.col("t") + 5 + F.col("k") / 20).alias("end"), "value")


@query(f"{_OVERLAPS} select session, event_index, null_index, {_s('value', digits=5)}, errors, signups, purchases from ob join oc using (session, g) where r = 1")
def one_window_per_overlap(spark, d):
    """Of windows of three tables that overlap one another the strongest; those of the second and third whose successor is an error's window are taken before."""
    tables = {n: _windows(spark, d, kind) for n, kind in _KINDS.items()}
    every = tables["errors"].unionByName(tables["signups"]).unionByName(tables["purchases"])
    taken = tables["errors"].select("session", (F.col("event_index") - 1).alias("event_index"), "null_index").join(tables["errors"].select(*reports.WINDOW_KEY), reports.WINDOW_KEY, "left_anti")
    best = reports.one_per_overlap(tables, every, taken)
    return best.select(*reports.WINDOW_KEY, _r("value", digits=5), "errors", "signups", "purchases")
