"""Queries of gains, intervals between spikes, ensembles, shuffled maps, held-out cells and separable models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import likelihood as lk
from ..operators import controls as op
from ..operators import batches, gates, models, regression, resampling, separable, synthetic
from ..sources import relations as rel
from .model_queries import _LL, DT, _clusterless, _emissions
from .resampling_queries import _draw
from .track_queries import _BINS, _COUNTS, _P, GRID, RATES_SQL, rates

QUERIES: dict = {}
SPLITS, FRACTION = 2, 0.5


def _r(c, name=None, digits=6):
    return ev.rounded(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)


def _s(c, name=None, digits=6):
    return f"round({c}, {digits}) + 0.0 as {name or c}"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f
    return add


_GAINS = f"""{RATES_SQL}, sp as (select session, sum("end" - start) as s from short_events group by 1), ob as (select s.session, s.cell_id, count(*) as n from spikes s join short_events e on e.session = s.session and s.t >= e.start and s.t < e.end group by 1, 2),
mr as (select session, cell_id, avg(rate_hz) as m from rates group by 1, 2), gains as (select mr.session, mr.cell_id, coalesce(ob.n, 0) as observed, m * coalesce(s, 0) as expected, greatest(0.05, least(20, (coalesce(ob.n, 0) + 5) / (m * coalesce(s, 0) + 5))) as gain from mr left join sp using (session) left join ob using (session, cell_id))"""


@query(f"{_GAINS} select session, cell_id, observed, {_s('expected', digits=4)}, {_s('gain')} from gains")
def cell_gains(spark, d):
    g = op.cell_gains(rel.spikes(spark, d), rel.short_events(spark, d), rates(spark, d))
    return g.select("session", "cell_id", "observed", _r("expected", digits=4), _r("gain"))


_INTERVALS = f"""{_P}, it as (select distinct s.session, e.event_index, s.t, false as z from spikes s join short_events e on e.session = s.session and s.t >= e.start and s.t < e.end union all select session, event_index, "end", true from short_events),
iv as (select it.session, it.event_index, it.t, z, row_number() over w - 1 as t_idx, greatest(it.t - coalesce(lag(it.t) over w, e.start), 1e-6::double) as bin_dur from it join short_events e using (session, event_index) window w as (partition by it.session, it.event_index order by it.t, z))"""


@query(f"{_INTERVALS} select session, event_index, t_idx::int as t_idx, {_s('bin_dur', digits=5)}, z as silent from iv")
def spike_intervals(spark, d):
    i = op.spike_intervals(rel.spikes(spark, d), rel.short_events(spark, d))
    return i.select("session", "event_index", "t_idx", _r("bin_dur", digits=5), F.col("_last").alias("silent"))


@query(f"""{RATES_SQL}, {_INTERVALS[len(_P) + 2:]}, ic as (select s.session, e.event_index, s.t, s.cell_id, count(*) as n from spikes s join short_events e on e.session = s.session and s.t >= e.start and s.t < e.end group by 1, 2, 3, 4),
silent as (select session, bin_id, sum(rate_hz) as total_hz from rates group by 1, 2), fired as (select c.session, c.event_index, iv.t_idx, r.bin_id, sum(n * ln(rate_hz * bin_dur) - coalesce(list_sum(list_transform(range(2, n + 1), lambda x: ln(x::double))), 0)) as f from ic c join iv on iv.session = c.session and iv.event_index = c.event_index and iv.t = c.t and not z join rates r on r.session = c.session and r.cell_id = c.cell_id group by 1, 2, 3, 4),
ll as (select iv.session, iv.event_index, iv.t_idx, s.bin_id, coalesce(f, 0) - total_hz * bin_dur as ll from iv join silent s on s.session = iv.session left join fired f on f.session = iv.session and f.event_index = iv.event_index and f.t_idx = iv.t_idx and f.bin_id = s.bin_id)
select session, event_index, count(*) as intervals, round(sum(m + ln(e / 32)), 3) + 0.0 as random_log_evidence from (select session, event_index, t_idx, any_value(mm) as m, sum(exp(ll - mm)) as e from (select *, max(ll) over (partition by session, event_index, t_idx) as mm from ll) group by 1, 2, 3) group by 1, 2""")
def continuous_time_evidence(spark, d):
    """Random evidence of each event, with an interval for each spike time."""
    e = op.continuous_random_evidence(rel.spikes(spark, d), rel.short_events(spark, d), rates(spark, d))
    return e.select("session", "event_index", "intervals", _r("log_evidence", "random_log_evidence", 3))


@query(f"{RATES_SQL}, sh as (select session, floor({_draw(chr(39) + 'roll' + chr(39), 'session')} * 31)::int + 1 as k from (select distinct session from rates)) select r.session, r.cell_id, ((bin_id // 4 + k // 4) % 8 * 4 + (bin_id % 4 + k % 4) % 4)::int as bin_id, {_s('rate_hz', digits=5)} from rates r join sh using (session)")
def rolled_rates(spark, d):
    return op.rolled_rates(rates(spark, d), GRID).select("session", "cell_id", "bin_id", _r("rate_hz", digits=5))


def _permuted(keys):
    k = ", ".join(keys)
    return f"""{RATES_SQL}, pl as (select distinct {k}, bin_id from rates), a as (select *, row_number() over (partition by {k} order by bin_id) as r from pl), b as (select *, row_number() over (partition by {k} order by {_draw("'places'", *keys, 'bin_id')}, bin_id) as r from pl)
select rates.session, rates.cell_id, b.bin_id, round(rate_hz, 5) + 0.0 as rate_hz from rates join a using ({k}, bin_id) join b on {' and '.join(f'b.{x} = a.{x}' for x in keys)} and b.r = a.r"""


@query(_permuted(["session"]))
def permuted_places(spark, d):
    return op.permuted_rates(rates(spark, d)).select("session", "cell_id", "bin_id", _r("rate_hz", digits=5))


@query(_permuted(["session", "cell_id"]))
def permuted_places_by_cell(spark, d):
    return op.permuted_rates(rates(spark, d), True).select("session", "cell_id", "bin_id", _r("rate_hz", digits=5))


@query(f"""{_P}, m as (select s.session, s.spike_row, s.t, p.value as f1, p.k as f2 from spikes s join stream p on p.event_id = s.spike_row), a as (select *, row_number() over (partition by session order by spike_row) as r from m), b as (select session, f1, f2, row_number() over (partition by session order by {_draw("'rows'", 'session', 'spike_row')}, spike_row) as r from m)
select a.session, a.spike_row, {_s('b.f1', 'f1')}, {_s('b.f2', 'f2')} from a join b using (session, r)""")
def shuffled_marks(spark, d):
    """The marks of each session dealt anew among its spikes."""
    features = rel._stream(spark, d).select(F.col("event_id").alias("spike_row"), F.col("value").alias("f1"), F.col("k").alias("f2"))
    m = op.permuted_rows(rel.spikes(spark, d).join(features, "spike_row"), "session", "spike_row", ["f1", "f2"])
    return m.select("session", "spike_row", _r("f1"), _r("f2"))


@query(f"with {rel.STREAM_SQL}, s as (select distinct session, split_part(session, '/', 1) as rat from stream) select h.rat as held_out, s.session, case when s.rat = h.rat then 'test' else 'train' end as role from s, (select distinct rat from s) h")
def leave_one_rat_splits(spark, d):
    return op.leave_one_splits(rel.spikes(spark, d), "rat")


_SPLITS_SQL = f"""cl as (select session, cell_id, unnest(range({SPLITS}))::int as seed from (select distinct session, cell_id from spikes)),
od as (select *, row_number() over (partition by session, seed order by {_draw("'split'", 'seed', 'session', 'cell_id')}, cell_id) as r, greatest(1, round(count(*) over (partition by session, seed) * {FRACTION})) as m from cl), tr as (select session, cell_id, seed from od where r > m),
t_spikes as (select s.session || '|' || seed as session, s.t, s.cell_id from spikes s join tr on tr.session = s.session and tr.cell_id = s.cell_id), t_events as (select e.session || '|' || seed as session, event_index, start, "end" from short_events e join (select distinct session, seed from cl) x on x.session = e.session),
t_rates as (select r.session || '|' || seed as session, r.cell_id, bin_id, rate_hz from rates r join tr on tr.session = r.session and tr.cell_id = r.cell_id)"""
_T = (_BINS + ", " + _COUNTS).replace("eb as", "t_eb as").replace("ec as", "t_ec as").replace("short_events", "t_events").replace("from spikes s", "from t_spikes s")
_T2 = _LL[_LL.index("silent as"):]
for _n in ("silent", "fired", "rt", "ps", "st"):
    _T2 = _T2.replace(f"{_n} as (", f"t_{_n} as (")
_T2 = _T2.replace("from ec c", "from t_ec c").replace("join eb b", "join t_eb b").replace("from eb b", "from t_eb b").replace("join rates r", "join t_rates r").replace("from rates", "from t_rates").replace("join silent s", "join t_silent s").replace("left join fired f", "left join t_fired f").replace("\nll as", "\nt_ll as").replace("from ll)", "from t_ll)").replace("from ll group", "from t_ll group").replace("from ps)", "from t_ps)")


@query(f"""{_LL}, {_SPLITS_SQL}, {_T}, {_T2},
j as (select session, event_index, 'random' as model, v from rt union all select session, event_index, 'stationary', v from st), t as (select split_part(session, '|', 1) as session, split_part(session, '|', 2)::int as split_seed, event_index, 'random' as model, v from t_rt union all select split_part(session, '|', 1), split_part(session, '|', 2)::int, event_index, 'stationary', v from t_st)
select session, split_seed, event_index, model, round(t.v, 4) + 0.0 as train_log_likelihood, round(j.v, 4) + 0.0 as joint_log_likelihood, round(j.v - t.v, 4) + 0.0 as heldout_log_likelihood from t join j using (session, event_index, model)""")
def heldout_evidence(spark, d):
    """What the test half of the cells adds to each event's evidence, for two splits."""
    spikes = rel.spikes(spark, d)
    splits = resampling.cell_split(spikes.select("session", "cell_id").distinct(), SPLITS, FRACTION)
    h = op.heldout_scores(spikes, rel.short_events(spark, d), rates(spark, d), splits, GRID, DT, ["random", "stationary"])
    return h.select("session", "split_seed", "event_index", "model", *[_r(f"{c}_log_likelihood", digits=4) for c in ("train", "joint", "heldout")])


@query()
def ensemble_evidence(spark, d):
    """Spikes and marks as experts of equal weight, under the switching model."""
    both = _clusterless(spark, d, cells=True)
    s = batches.score_batched(both, GRID, ["random", "state-space-first-order-imm"], models.Motion(), DT, prefix="ensemble-")
    return s.select("session", "event_index", "model", _r("log_evidence", digits=4))


@query()
def separable_evidence(spark, d):
    """The separable models, each marginalised over its settings."""
    s = separable.score_settings(_emissions(spark, d), GRID, separable.Settings(still=(25.0, 100.0), diffusion=(4.0, 12.0), momentum=(1.0,), decay=(0.05, 0.5), initial=1.0), DT)
    m = regression.marginal_evidence(s, ["session", "event_index", "model"], "log_evidence")
    return m.select("session", "event_index", "model", "settings", _r("marginal_log_evidence", digits=5))


@query()
def synthetic_recovery(spark, d):
    """How often events made from the derived maps are given back to the model that made them."""
    made = ("random", "stationary", "state-space-diffusion")
    pairs = synthetic.recovery(rates(spark, d), GRID, made, made, 50, 8, DT)
    return gates.recovery(pairs).select("true_model", "events", _r("recovered", digits=4))


@query()
def scale_sweep(spark, d):
    """Mean evidence of diffusion at three scales."""
    s = synthetic.sweep(_emissions(spark, d), GRID, ["state-space-diffusion"], [{"diffusion": v} for v in (3.0, 12.0, 48.0)], models.Motion(), DT)
    return s.groupBy("diffusion", "model").agg(F.count(F.lit(1)).alias("events"), _r(F.avg("log_evidence"), "mean_log_evidence", 4))


@query(f"""with {rel.SCORES_SQL}, c as (select session, event_index, row_key, model, test_spikes::bigint as n, n_time * 0.5::double as dur, seed + 1.5::double as shape from scores)
select session, event_index, row_key, model, round(coalesce(list_sum(list_transform(range(0, n), lambda x: ln(shape + x))), 0) - coalesce(list_sum(list_transform(range(2, n + 1), lambda x: ln(x::double))), 0) + shape * ln(0.7::double / (0.7::double + dur)) + n * ln(1.0::double - 0.7::double / (0.7::double + dur)), 5) + 0.0 as gamma_poisson from c""")
def gamma_poisson_likelihood(spark, d):
    """Counts under rates that are themselves drawn."""
    s = rel.scores(spark, d).select("session", "event_index", "row_key", "model", F.col("test_spikes").cast("long").alias("n"), (F.col("n_time") * 0.5).alias("dur"), (F.col("seed") + 1.5).alias("shape"))
    return s.select("session", "event_index", "row_key", "model", _r(lk.gamma_poisson(F.col("n"), F.col("shape"), F.lit(0.7), F.col("dur")), "gamma_poisson", 5))
