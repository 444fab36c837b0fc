"""Queries of resampling, controls and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..operators import decoding
from ..operators import evidence as eop
from ..operators import resampling as op
from ..sources import relations as rel
from .evidence_queries import EVIDENCE_SQL

QUERIES: dict = {}


def _r(c, name=None, digits=6):
    return ev.rounded(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f
    return add


def _draw(*parts):
    """The engine's draw in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::bigint::double / {16**12}.0::double)"


def _evidence(spark, d):
    return eop.model_evidence(rel.scores(spark, d)).where("relative_log_evidence is not null")


_ROWS = f"{EVIDENCE_SQL}, rows_ as (select * from evidence where relative_log_evidence is not null)"
_BOOT = f"""units as (select model, session, sum(relative_log_evidence) as s, count(relative_log_evidence) as n from rows_ group by 1, 2),
num as (select *, row_number() over (partition by model order by session) - 1 as i, count(*) over (partition by model) as size from units),
drawn as (select model, replicate, floor({_draw("'boot'", 'replicate', 'model', 'i')} * size)::bigint as i from (select model, i, size, unnest(range(200)) as replicate from num)),
means as (select d.model, replicate, sum(s) / sum(n) as mean from drawn d join num using (model, i) group by 1, 2)"""


@query(f"""{_ROWS}, {_BOOT} select model, round(avg(relative_log_evidence), 6) + 0.0 as mean, count(distinct session) as units, round(any_value(lo), 5) + 0.0 as ci_low, round(any_value(hi), 5) + 0.0 as ci_high from rows_ join (select model, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from means group by 1) using (model) group by 1""")
def session_bootstrap(spark, d):
    b = op.bootstrap_interval(_evidence(spark, d), "model", "session", "relative_log_evidence")
    return b.select("model", _r("mean"), "units", _r("ci_low", digits=5), _r("ci_high", digits=5))


@query(f"""{_ROWS}, {_BOOT}, best as (select replicate, arg_max(model, mean) as model from means group by 1) select model, count(*) as wins, round(count(*) / 200, 6) + 0.0 as win_probability from best group by 1""")
def bootstrap_win_probability(spark, d):
    m = op.bootstrap_means(_evidence(spark, d), "model", "session", "relative_log_evidence", 200)
    best = m.groupBy("replicate").agg(F.max(F.struct("mean", "model"))["model"].alias("model"))
    return best.groupBy("model").agg(F.count(F.lit(1)).alias("wins"), _r(F.count(F.lit(1)) / 200, "win_probability"))


@query(f"""{_ROWS}, m as (select model, session, avg(relative_log_evidence) as m from rows_ group by 1, 2 having avg(relative_log_evidence) <> 0), ms as (select model, list_sort(list(m)) as ms from m group by 1),
p as (select model, ms, unnest(range((2 ** len(ms))::bigint)) as pattern from ms), t as (select model, len(ms) as units, abs(list_sum(list_transform(ms, lambda v, i: case when (pattern >> (i - 1)::int) & 1 = 1 then -v else v end))) as t, abs(list_sum(ms)) as seen from p)
select model, any_value(units)::int as units, sum((t >= seen - 1e-12)::int)::bigint as extreme, count(*) as patterns, round(avg((t >= seen - 1e-12)::int), 6) + 0.0 as p_value from t group by 1""")
def sign_flip_exact(spark, d):
    s = op.sign_flip_exact(_evidence(spark, d), "model", "session", "relative_log_evidence")
    return s.select("model", "units", "extreme", "patterns", _r("p_value"))


@query(f"""{_ROWS}, m as (select model, session, avg(relative_log_evidence) as m from rows_ group by 1, 2), n as (select model, draw, sum(case when {_draw("'sign'", 'draw', 'session')} < 0.5 then -m else m end) as null_ from (select *, unnest(range(500)) as draw from m) group by 1, 2),
s as (select model, sum(m) as seen from m group by 1) select model, round((1 + sum((abs(null_) >= abs(seen) - 1e-12)::int)) / 501, 6) + 0.0 as p_value from n join s using (model) group by 1""")
def sign_flip_sampled(spark, d):
    return op.sign_flip_sampled(_evidence(spark, d), "model", "session", "relative_log_evidence").select("model", _r("p_value"))


@query(f"""with {rel.STREAM_SQL}, {rel.SPIKES_SQL}, c as (select distinct session, cell_id from spikes), o as (select *, row_number() over (partition by session order by {_draw("'cells'", 'session', 'cell_id')}, cell_id) as r, count(*) over (partition by session) as n from c)
select a.session, a.cell_id, b.cell_id as new_cell_id from o a join o b on a.session = b.session and b.r = a.r % a.n + 1""")
def permuted_cells(spark, d):
    return op.permute_cells(rel.spikes(spark, d).select("session", "cell_id").distinct())


@query(f"""with {rel.STREAM_SQL}, {rel.SPIKES_SQL}, b as (select *, min(t) over (partition by session) as low, max(t) over (partition by session) - min(t) over (partition by session) + 1.0::double as span from spikes),
m as (select *, t - low + {_draw("'shift'", 'session', 'cell_id')} * span as moved from b) select session, spike_row, cell_id, round(low + moved - floor(moved / span) * span, 4) + 0.0 as t from m""")
def shifted_spikes(spark, d):
    return op.circular_shift(rel.spikes(spark, d)).select("session", "spike_row", "cell_id", _r("t", digits=4))


@query(f"""with {rel.STREAM_SQL}, {rel.SPIKES_SQL}, c as (select session, cell_id, count(*) as n from spikes group by 1, 2), s as (select *, unnest(range(3))::int as split_seed from c), k as (select *, ntile(2) over (partition by session, split_seed order by n, cell_id)::int as stratum from s),
o as (select *, row_number() over (partition by session, split_seed, stratum order by {_draw("'split'", 'split_seed', 'session', 'cell_id')}, cell_id) as r, greatest(1, round(count(*) over (partition by session, split_seed, stratum) * 0.25)) as m from k)
select session, cell_id, n, split_seed, stratum, r <= m as is_test from o""")
def stratified_cell_split(spark, d):
    cells = rel.spikes(spark, d).groupBy("session", "cell_id").agg(F.count(F.lit(1)).alias("n"))
    return op.cell_split(cells, 3, 0.25, 2, "n")



def _pair(spark, d):
    s = rel.scores(spark, d)
    return eop.one_per_model(s.where("seed < 3")), eop.one_per_model(s.where("seed >= 2"))


_DID = f"""with {rel.SCORES_SQL}, a as (select session, event_index, model, max(log_evidence) as r from scores where seed < 3 group by 1, 2, 3), b as (select session, event_index, model, max(log_evidence) as c from scores where seed >= 2 group by 1, 2, 3),
g as (select session, event_index, max(case when model in {rel.TRAJECTORY} then r end) - max(case when model not in {rel.TRAJECTORY} then r end) as real_margin, max(case when model in {rel.TRAJECTORY} then c end) - max(case when model not in {rel.TRAJECTORY} then c end) as control_margin from a join b using (session, event_index, model) group by 1, 2)"""


@query(f"{_DID} select session, event_index, round(real_margin, 6) + 0.0 as real_margin, round(control_margin, 6) + 0.0 as control_margin, round(real_margin - control_margin, 6) + 0.0 as did from g")
def wrong_map_difference(spark, d):
    real, control = _pair(spark, d)
    x = op.difference_in_differences(real, control, ["session", "event_index"], "log_evidence", rel.TRAJECTORY)
    return x.select("session", "event_index", _r("real_margin"), _r("control_margin"), _r("did"))


@query(f"""{_DID}, p as (select real_margin as margin, event_index % 2 = 0 as is_true from g where real_margin is not null), t as (select threshold, avg((margin >= threshold)::int) filter (is_true) as recall, avg((margin >= threshold)::int) filter (not is_true) as fp from p, (values (0.0::double), (1.0), (3.0), (10.0), (30.0)) as v(threshold) group by 1)
select threshold, round(recall, 6) + 0.0 as recall, round(fp, 6) + 0.0 as false_positive_rate, coalesce(threshold = (select min(threshold) from t where coalesce(fp, 0) <= 0.4 and coalesce(recall, 0) >= 0.2), false) as selected from t""")
def margin_threshold(spark, d):
    real, control = _pair(spark, d)
    x = op.difference_in_differences(real, control, ["session", "event_index"], "log_evidence", rel.TRAJECTORY).where("real_margin is not null")
    t = op.margin_threshold(x.select(F.col("real_margin").alias("margin"), (F.col("event_index") % 2 == 0).alias("is_true")), [0.0, 1.0, 3.0, 10.0, 30.0], 0.4, 0.2)
    return t.select("threshold", _r("recall"), _r("false_positive_rate"), "selected")


@query(f"""with {rel.SCORES_SQL}, o as (select session, model, round(avg(log_evidence), 6) as v from scores where seed = 0 group by 1, 2), c as (select session, model, seed, round(avg(log_evidence), 6) as w from scores where seed > 0 group by 1, 2, 3)
select session, model, v + 0.0 as v, count(w) as controls, coalesce(sum((w >= v)::int), 0)::bigint as at_least, round((coalesce(sum((w >= v)::int), 0) + 1) / (count(w) + 1), 6) + 0.0 as p_value from o left join c using (session, model) group by 1, 2, 3""")
def control_p_values(spark, d):
    s = rel.scores(spark, d)
    o = s.where("seed = 0").groupBy("session", "model").agg(F.round(F.avg("log_evidence"), 6).alias("v"))
    c = s.where("seed > 0").groupBy("session", "model", "seed").agg(F.round(F.avg("log_evidence"), 6).alias("v"))
    return op.control_p_values(o, c, ["session", "model"], "v").select("session", "model", (F.col("v") + 0.0).alias("v"), "controls", "at_least", _r("p_value"))


_NULLS = f"""with {rel.STREAM_SQL}, {rel.SPIKES_SQL}, {rel.SHORT_EVENTS_SQL}, span as (select session, min(t) as low, max(t) as high from spikes group by 1),
drawn0 as (select e.session, e.event_index, draw, low + {_draw("'null'", 'e.session', 'e.event_index', 'draw')} * greatest(0.0, high - low - (e.end - e.start)) as a, e.end - e.start as dur from (select *, unnest(range(32)) as draw from short_events) e join span using (session)),
drawn as (select *, a + dur as b from drawn0), free as (select * from drawn d where not exists (select 1 from short_events e where e.session = d.session and d.a < e.end and d.b > e.start)),
nn as (select f.session, f.event_index, f.draw, f.a, f.b, count(s.t) as null_spikes from free f left join spikes s on s.session = f.session and s.t >= f.a and s.t < f.b group by all),
mm as (select e.session, e.event_index, count(s.t) as n_spikes from short_events e left join spikes s on s.session = e.session and s.t >= e.start and s.t < e.end group by 1, 2)
select session, event_index, match, round(a, 3) + 0.0 as start, null_spikes, n_spikes from (select *, row_number() over (partition by session, event_index order by abs(n_spikes - null_spikes), draw) as match from nn join mm using (session, event_index)) where match <= 3"""


@query(_NULLS)
def matched_null_windows(spark, d):
    """The feature is the limit: three windows an event."""
    w = decoding.matched_null_windows(rel.short_events(spark, d), rel.spikes(spark, d), 3)
    return w.select("session", "event_index", "match", _r("start", digits=3), "null_spikes", "n_spikes")


_SEARCHED = f"""with {rel.STREAM_SQL}, {rel.SPIKES_SQL}, {rel.SHORT_EVENTS_SQL}, span as (select session, min(t) as low, max(t) as high from spikes group by 1),
reach as (select session, start, "end", max("end") over (partition by session order by start, "end" rows between unbounded preceding and 1 preceding) as before from short_events),
isle as (select session, start, "end", sum(case when before is null or start > before then 1 else 0 end) over (partition by session order by start, "end" rows unbounded preceding) as i from reach),
taken as (select session, i, min(start) as a, max("end") as b from isle group by 1, 2), after as (select session, i, b, lead(a) over (partition by session order by a) as nxt from taken),
gaps as (select * from (select session, i::int as gap, greatest(b, low) as g, least(coalesce(nxt, high), high) as h from after join span using (session) union all select session, 0, low, least(a, high) from taken join span using (session) where i = 1) where h > g),
met as (select e.session, event_index, gap, g, "end" - start as dur, greatest(("end" - start) / 2, 0.001::double) as step, h - g as room from short_events e join gaps using (session) where "end" > start and h - g >= "end" - start),
cand as (select session, event_index, gap, k, g + k * step as a, g + k * step + dur as b from (select *, unnest(range(0, floor((room - dur) / step)::bigint + 1)) as k from met)),
win as (select * from cand union all select session, event_index, -1, 0, start, "end" from short_events),
n as (select w.session, w.event_index, gap, k, a, count(s.t) as n, count(distinct s.cell_id) as c from win w left join spikes s on s.session = w.session and s.t >= w.a and s.t < w.b group by all),
best as (select c.session, c.event_index, c.a, c.n, c.c, count(*) over w as candidates, row_number() over (w order by abs(c.n - r.n), abs(c.c - r.c), {_draw("'null'", 'c.session', 'c.event_index', 'c.gap', 'c.k')}, c.gap, c.k) as match
  from n c join n r on r.session = c.session and r.event_index = c.event_index and r.gap = -1 and c.gap >= 0 window w as (partition by c.session, c.event_index))
select session, event_index, match, round(b.a, 3) + 0.0 as start, b.n as null_spikes, b.c as null_active, coalesce(candidates, 0) as candidates, case when match is null then case when "end" > e.start then 'no free window' else 'no duration' end end as reason
from short_events e left join (select * from best where match <= 3) b using (session, event_index)"""


@query(_SEARCHED)
def searched_null_windows(spark, d):
    """Three windows an event of all free ones; events without any give the reason."""
    w = decoding.searched_null_windows(rel.short_events(spark, d), rel.spikes(spark, d), 3)
    return w.select("session", "event_index", "match", _r("start", digits=3), "null_spikes", "null_active", "candidates", "reason")
