"""Queries of further reports: labels, paired decisions, map controls, influence, features and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..operators import evidence as eop
from ..operators import reports as op
from ..operators import tracks
from ..sources import relations as rel
from .evidence_queries import EVIDENCE_SQL, SUPPORT_SQL
from .resampling_queries import _draw
from .track_queries import _COUNTS, _P

QUERIES: dict = {}

#: Which of these stand in for the core, the paths of it and the fixed models of the map control.
CORE = ("random", "stationary", "state-space-diffusion", "state-space-momentum")
PATHS = ("state-space-diffusion", "state-space-momentum")


def _r(c, name=None, digits=6):
    return ev.rounded(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)


def _s(c, name=None, digits=6):
    return f"round({c}, {digits}) + 0.0 as {name or c}"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f
    return add


#: Every label and every mode, dealt over the rows of a score table, with two label columns.
_LABELS = [None, ev.EXACT, ev.PARTICLE, ev.DEGENERATE, ev.TRUNCATED, ev.RESTRICTED, "nan"]
_MODES = [None, "momentum", *ev.EXACT_MODES]


def _pick(values, of):
    return f"case {of} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values) if v is not None) + " end"


_ALGEBRA = f"""select {{status}} as status, case when l_linenumber = 1 then 'random' else 'named' end as model, {_pick(_LABELS, 'cast(l_suppkey % 7 as int)')} as support_label,
{_pick(_LABELS, 'cast(l_partkey % 7 as int)')} as second_label, {_pick(_MODES, f'cast(l_orderkey % {len(_MODES)} as int)')} as mode, -l_extendedprice as log_evidence from {{table}}"""
_STATUS = "case when l_returnflag = 'R' and l_linestatus = 'F' then 'failed' when l_returnflag = 'N' then null else 'success' end"
_EXACT_MODES_SQL = ", ".join(f"'{m}'" for m in ev.EXACT_MODES)


@query(f"""with t as ({_ALGEBRA.format(status=_STATUS, table='lineitem')}), h as (select *, unnest([false, true]) as heldout from t),
s as (select *, case when status = 'failed' then 'not_scored' when 'restricted_support_difference' in (coalesce(support_label, ''), coalesce(second_label, '')) then 'restricted_support_difference'
 when 'truncated_full_grid' in (coalesce(support_label, ''), coalesce(second_label, '')) then case when heldout then 'restricted_support_difference' else 'truncated_full_grid' end
 when 'degenerate_single_bin' in (coalesce(support_label, ''), coalesce(second_label, '')) then 'degenerate_single_bin' when 'particle_approximation' in (coalesce(support_label, ''), coalesce(second_label, '')) then 'particle_approximation'
 when 'exact_full_grid' in (coalesce(support_label, ''), coalesce(second_label, '')) then 'exact_full_grid' when model = 'random' or coalesce(mode, '') in ({_EXACT_MODES_SQL}) then 'exact_full_grid' else 'unknown_noncomparable' end as evidence_support from h)
select heldout, support_label, second_label, mode, model, evidence_support, case evidence_support when 'exact_full_grid' then 'exact_model_evidence' when 'truncated_full_grid' then 'truncated_lower_bound' else evidence_support end as evidence_comparison,
evidence_support = 'exact_full_grid' as evidence_comparable, count(*) as rows_scored from s group by all""")
def evidence_label_algebra(spark, d):
    """Labels of every kind in two columns, and modes, to supports and comparisons; held out or not."""
    rel.read(spark, d, "lineitem").createOrReplaceTempView("_label_rows")
    t = spark.sql(_ALGEBRA.format(status=_STATUS, table="_label_rows"))
    each = [eop.with_support(t, held, ("support_label", "second_label")).withColumn("heldout", F.lit(held)) for held in (False, True)]
    return each[0].unionByName(each[1]).groupBy("heldout", "support_label", "second_label", "mode", "model", "evidence_support", "evidence_comparison", "evidence_comparable").agg(F.count(F.lit(1)).alias("rows_scored"))


_QUALITY = f"""{SUPPORT_SQL}, q as (select *, case when not ok or evidence_support in ('degenerate_single_bin', 'not_scored', 'particle_approximation', 'unknown_noncomparable') then 'conservative_unknown' when evidence_support <> 'truncated_full_grid' then 'exact_or_not_pruned'
 when candidate_log_mass is null then 'conservative_unknown' when candidate_log_mass >= -0.01::double then 'conservative_good' when candidate_log_mass >= -0.1::double then 'conservative_warning' else 'conservative_poor' end as quality from supc)"""


@query(f"{_QUALITY} select session, event_index, model, row_key, quality as candidate_support_quality, quality in ('exact_or_not_pruned', 'conservative_good') as candidate_support_good from q")
def candidate_support_quality(spark, d):
    return op.candidate_quality(eop.with_support(rel.scores(spark, d))).select("session", "event_index", "model", "row_key", "candidate_support_quality", "candidate_support_good")


@query(f"""{_QUALITY} select session, model, count(log_evidence) as events, {_s('avg(log_evidence)', 'mean_log_evidence')}, {_s('median(log_evidence)', 'median_log_evidence')}, {_s('avg(runtime_s)', 'mean_runtime_s')}, {_s('median(runtime_s)', 'median_runtime_s')},
{_s("avg((quality in ('exact_or_not_pruned', 'conservative_good'))::int)", 'candidate_good_fraction')} from q group by 1, 2""")
def grouped_metrics(spark, d):
    g = op.grouped_metrics(eop.with_support(rel.scores(spark, d)), ["session"], ["log_evidence", "runtime_s"])
    return g.select("session", "model", "events", *[_r(c) for c in ("mean_log_evidence", "median_log_evidence", "mean_runtime_s", "median_runtime_s", "candidate_good_fraction")])


_LAST = "select session, event_index, model, arg_max(log_evidence, row_key) as e from {of} group by 1, 2, 3"


@query(f"""{SUPPORT_SQL}, l as ({_LAST.format(of='supc where evidence_comparable')}), g as (select session, event_index, max(case when model = 'state-space-diffusion' then e end) as p, max(case when model = 'random' then e end) as q from l group by 1, 2)
select session, event_index, {_s('p', 'positive_log_evidence')}, {_s('q', 'reference_log_evidence')}, {_s('p - q', 'difference')}, case when p - q >= 5 then 'state-space-diffusion' when p - q <= -5 then 'random' else 'ambiguous' end as decision, p - q >= 5 as positive_claimed from g where p is not null and q is not null""")
def paired_margin_decisions(spark, d):
    p = op.paired_margin_decisions(rel.scores(spark, d), "state-space-diffusion", "random", 5.0)
    return p.select("session", "event_index", _r("positive_log_evidence"), _r("reference_log_evidence"), _r("difference"), "decision", "positive_claimed")


@query(f"""{SUPPORT_SQL} select a.session, a.event_index, a.model, a.log_evidence as native, b.log_evidence as common_support, round(b.log_evidence - a.log_evidence, 6) + 0.0 as common_support_delta from supc a join supc b using (session, event_index, model) where a.ok and b.ok and a.seed < 2 and b.seed >= 2""")
def common_support_audit(spark, d):
    s = rel.scores(spark, d)
    return op.common_support_audit(s.where("seed < 2"), s.where("seed >= 2")).select("session", "event_index", "model", "native", "common_support", _r("common_support_delta"))


_PLACE = "case model " + " ".join(f"when '{m}' then {i}" for i, m in enumerate(CORE)) + " end"
_MAPS = f"""{SUPPORT_SQL}, a as ({_LAST.format(of='supc where ok and seed < 3')}), b as ({_LAST.format(of='supc where ok and seed >= 2')}), m as (select session, event_index, model, a.e as real, b.e as wrong from a join b using (session, event_index, model)),
w1 as (select *, row_number() over (partition by session, event_index order by real desc, {_PLACE}) as r from m where model in {CORE}), w2 as (select *, row_number() over (partition by session, event_index order by real desc, {_PLACE}) as r from m where model in {PATHS}),
deltas as (select session, split_part(session, '/', 1) as rat, event_index, statistic, statistic_type, model, real, wrong, real - wrong as delta from (select session, event_index, model as statistic, 'fixed_model' as statistic_type, model, real, wrong from m where model in {CORE}
 union all select session, event_index, 'best_exact_core_model_real_map', 'real_map_selected_model', model, real, wrong from w1 where r = 1 union all select session, event_index, 'best_exact_trajectory_model_real_map', 'real_map_selected_model', model, real, wrong from w2 where r = 1))"""


def _deltas(spark, d):
    s = rel.scores(spark, d)
    return op.map_deltas(s.where("seed < 3"), s.where("seed >= 2"), CORE, CORE, PATHS).withColumn("rat", ev.rat_of(F.col("session")))


@query(f"{_MAPS} select session, event_index, statistic, statistic_type, model, {_s('delta')} from deltas")
def map_sensitivity(spark, d):
    return _deltas(spark, d).select("session", "event_index", "statistic", "statistic_type", "model", _r("delta"))


def _summary_sql(of, keys):
    k = "".join(f"{x}, " for x in keys)
    return f"""select {k}statistic, count(*) as events, sum((delta > 0)::int)::bigint as positive_events, {_s('avg((delta > 0)::int)', 'positive_fraction')}, {_s('avg(delta)', 'mean_delta')}, {_s('median(delta)', 'median_delta')}, {_s('min(delta)', 'min_delta')}, {_s('max(delta)', 'max_delta')}, any_value(c.model) as most_common_model
from {of} left join (select {k}statistic, model, row_number() over (partition by {k}statistic order by count(*) desc, model) as r from {of} group by {k}statistic, model) c using ({k}statistic) where c.r = 1 group by {k}statistic"""


def _shown(s, *keys):
    return s.select(*keys, "statistic", "events", "positive_events", *[_r(c) for c in ("positive_fraction", "mean_delta", "median_delta", "min_delta", "max_delta")], "most_common_model")


@query(f"{_MAPS} {_summary_sql('deltas', ['rat'])}")
def map_sensitivity_by_rat(spark, d):
    return _shown(op.map_delta_summary(_deltas(spark, d), ("rat",)), "rat")


@query(f"{_MAPS}, kept as (select h.rat as held_out_rat, x.statistic, x.model, x.delta from deltas x, (select distinct rat from deltas) h where x.rat <> h.rat) {_summary_sql('kept', ['held_out_rat'])}")
def map_sensitivity_without_each_rat(spark, d):
    return _shown(op.leave_one_rat_out(_deltas(spark, d)), "held_out_rat")


@query(f"""{_MAPS}, rats as (select rat, row_number() over (order by rat) - 1 as i, count(*) over () as n from (select distinct rat from deltas)), dr as (select replicate, floor({_draw("'rats'", 'replicate', 'i')} * n)::bigint as i from (select *, unnest(range(200)) as replicate from rats)),
x as (select statistic, replicate, delta from dr join rats using (i) join deltas using (rat)), mb as (select statistic, replicate, avg((delta > 0)::int) as share, avg(delta) as mean, median(delta) as median from x group by 1, 2)
select statistic, {', '.join(f"round(quantile_cont({c}, {p}), 5) + 0.0 as {c}_{n}" for c in ('share', 'mean', 'median') for n, p in (('low', 0.025), ('high', 0.975)))}, {_s('avg((mean > 0)::int)', 'probability_mean_positive')}, {_s('avg((median > 0)::int)', 'probability_median_positive')} from mb group by 1""")
def map_sensitivity_bootstrap(spark, d):
    b = op.rat_bootstrap(_deltas(spark, d))
    return b.select("statistic", *[_r(f"{c}_{n}", digits=5) for c in ("share", "mean", "median") for n in ("low", "high")], _r("probability_mean_positive"), _r("probability_median_positive"))


@query(f"""with {rel.SCORES_SQL}, l as (select log_evidence, try_cast(trim(unnest(string_split(replace(train_cell_ids, ';', ','), ','))) as int) as cell_id from scores) select cell_id, count(*) as rows_listed, {_s('avg(log_evidence)', 'mean_log_evidence')}, round(avg(log_evidence) - (select avg(log_evidence) from scores), 6) + 0.0 as delta_vs_global_mean from l where cell_id is not null group by 1""")
def cell_influence(spark, d):
    return op.cell_influence(rel.scores(spark, d)).select("cell_id", "rows_listed", _r("mean_log_evidence"), _r("delta_vs_global_mean"))


@query(f"""{EVIDENCE_SQL}, r as (select model, session, relative_log_evidence as v, row_number() over (partition by model, session order by event_index) - 1 as i from evidence where relative_log_evidence is not null), u0 as (select model, session, count(*) as size from r group by 1, 2),
u as (select *, row_number() over (partition by model order by session) - 1 as u, count(*) over (partition by model) as units from u0), sl as (select model, u as slot, units, unnest(range(20)) as replicate from u), ch as (select model, replicate, slot, floor({_draw("'nested'", 'replicate', 'model', 'slot')} * units)::bigint as u from sl),
k as (select ch.model, replicate, slot, session, size, unnest(range(size)) as k from ch join u on u.model = ch.model and u.u = ch.u), dr as (select model, replicate, session, floor({_draw("'nested'", 'replicate', 'model', 'slot', 'k')} * size)::bigint as i from k),
m as (select dr.model, replicate, avg(v) as mean from dr join r on r.model = dr.model and r.session = dr.session and r.i = dr.i group by 1, 2) select model, round(quantile_cont(mean, 0.025), 5) + 0.0 as ci_low, round(quantile_cont(mean, 0.975), 5) + 0.0 as ci_high from m group by 1""")
def nested_bootstrap(spark, d):
    """Sessions with replacement, then events within each; 20 replicates."""
    e = eop.model_evidence(rel.scores(spark, d)).where("relative_log_evidence is not null")
    return op.nested_bootstrap(e, "model", "session", "event_index", "relative_log_evidence", 20).select("model", _r("ci_low", digits=5), _r("ci_high", digits=5))


@query(f"""{EVIDENCE_SQL}, mg as (select session, event_index, max(e) as b, max(case when k = 2 then e end) as s from (select session, event_index, e, row_number() over (partition by session, event_index order by e desc, model) as k from evidence where e is not null) group by 1, 2),
g as (select session, event_index, min(best_model) as best_model, bool_or(model like '%goal%') as has_goal, bool_or(model like '%reverse%') as has_reverse, bool_or(model like 'clusterless%') as has_clusterless, bool_or(model like 'sorted-spike%') as has_sorted_spike, count(distinct model) as models_scored, sum(model_probability) as z, sum(case when model_probability > 0 then model_probability * ln(model_probability) end) as pl from evidence where ok group by 1, 2)
select g.session, g.event_index, best_model, has_sorted_spike, has_clusterless, has_goal, has_reverse, models_scored, round(ln(z) - pl / z, 6) + 0.0 as model_probability_entropy, case when b is null then null when s is null then 'missing' when b - s <= 1 then 'tie' when b - s <= 3 then 'weak' when b - s <= 10 then 'strong' else 'decisive' end as evidence_margin_category, coalesce(b - s <= 3, false) as is_low_margin from g left join mg using (session, event_index)""")
def disagreement_events(spark, d):
    x = op.disagreement_events(eop.model_evidence(rel.scores(spark, d)))
    return x.select("session", "event_index", "best_model", "has_sorted_spike", "has_clusterless", "has_goal", "has_reverse", "models_scored", _r("model_probability_entropy"), "evidence_margin_category", "is_low_margin")


@query(f"with {rel.SCORES_SQL} select session, event_index, model, row_key, case when n_time <> 0 then log_evidence / n_time end as per_time_bin, case when test_spikes <> 0 then log_evidence / test_spikes end as per_spike from scores")
def normalised_evidence(spark, d):
    return op.normalised_evidence(rel.scores(spark, d)).select("session", "event_index", "model", "row_key", "per_time_bin", "per_spike")


_PICKS = ", ".join(f"max(case when model = '{m}' then e end) as e{i}" for i, m in enumerate(CORE))
_FULL = " and ".join(f"e{i} is not null" for i in range(len(CORE)))
_TOP = f"greatest({', '.join(f'e{i}' for i in range(len(CORE)))})"
_Z = " + ".join(f"exp(e{i} - {_TOP})" for i in range(len(CORE)))


@query(f"""{SUPPORT_SQL}, l as (select * from ({_LAST.format(of='supc where ok')}) where model in {CORE}), g as (select session, event_index, {_PICKS}, min(case when model in {PATHS} then {{'k': -e, 'm': model}} end) as t, min(case when model not in {PATHS} then {{'k': -e, 'm': model}} end) as n from l group by 1, 2),
p as (select *, {_FULL} as core_complete, {', '.join(f"case when {_FULL} then exp(e{i} - {_TOP}) / ({_Z}) end as p{i}" for i in range(len(CORE)))} from g)
select session, event_index, core_complete, concat_ws(' ', {', '.join(f"case when e{i} is null then '{m}' end" for i, m in enumerate(CORE))}) as missing_core_models, {', '.join(_s(f'p{i}', f'p_{i}') for i in range(len(CORE)))}, {_s('p2 + p3', 'trajectory_mass')}, {_s('p3 - p2', 'momentum_index')}, t.m as best_trajectory_model, n.m as best_nontrajectory_model, {_s('n.k - t.k', 'trajectory_margin')} from p""")
def evidence_features(spark, d):
    f = op.evidence_features(rel.scores(spark, d), CORE, PATHS, "state-space-momentum", "state-space-diffusion")
    return f.select("session", "event_index", "core_complete", "missing_core_models", *[_r(f"p_{i}") for i in range(len(CORE))], _r("trajectory_mass"), _r("momentum_index"), "best_trajectory_model", "best_nontrajectory_model", _r("trajectory_margin"))


@query(f"""{SUPPORT_SQL}, e as (select n_time, nullif(seed, 4) as seed, round(avg(log_evidence), 6) as mean_evidence, sum((not ok)::int)::bigint as failures from supc where n_time < 11 group by 1, 2), r as (select n_time, nullif(seed, 4) as seed, round(avg((support_label is null)::int), 6) as recovery_accuracy from supc where n_time > 2 group by 1, 2),
b as (select coalesce(e.n_time, r.n_time) as n_time, coalesce(e.seed, r.seed) as seed, mean_evidence, failures, recovery_accuracy, e.n_time is not null as has_evidence, r.n_time is not null as has_recovery from e full join r on e.n_time = r.n_time and e.seed is not distinct from r.seed),
g as (select *, concat_ws(';', case when not has_evidence then 'no_evidence' end, case when not has_recovery then 'no_recovery' end, case when recovery_accuracy < 0.5 then 'low_recovery' end, case when failures > (select count(*) / 240 from scores) then 'failures' end) as gate_reasons from b)
select n_time, seed, mean_evidence + 0.0 as mean_evidence, failures, recovery_accuracy + 0.0 as recovery_accuracy, has_evidence, has_recovery, gate_reasons, gate_reasons = '' as passes, case when gate_reasons = '' then row_number() over (partition by gate_reasons = '' order by mean_evidence desc nulls last, n_time nulls first, seed nulls first) end as selection_rank from g""")
def parameter_selection(spark, d):
    s = eop.with_support(rel.scores(spark, d)).withColumn("seed", F.when(F.col("seed") != 4, F.col("seed")))
    e = s.where("n_time < 11").groupBy("n_time", "seed").agg(F.round(F.avg("log_evidence"), 6).alias("mean_evidence"), F.sum((~ev.succeeded(F.col("status"))).cast("long")).alias("failures"))
    r = s.where("n_time > 2").groupBy("n_time", "seed").agg(F.round(F.avg(F.col("support_label").isNull().cast("double")), 6).alias("recovery_accuracy"))
    x = op.parameter_selection(e, r, ["n_time", "seed"], 0.5, s.count() / 240)
    return x.select("n_time", "seed", (F.col("mean_evidence") + 0.0).alias("mean_evidence"), "failures", (F.col("recovery_accuracy") + 0.0).alias("recovery_accuracy"), "has_evidence", "has_recovery", "gate_reasons", "passes", F.col("selection_rank").cast("long").alias("selection_rank"))


@query(f"""{SUPPORT_SQL}, t as (select distinct n_time, event_index, model, 'candidates' as f from supc where log_evidence > -50 union all select distinct n_time, event_index, model, 'ready' from supc where ok and log_evidence > -30 union all select distinct n_time, event_index, model, 'validated' from supc where evidence_comparable)
select n_time as source_group, count(*) filter (f = 'candidates') as candidates, count(*) filter (f = 'ready') as ready, count(*) filter (f = 'validated') as validated from t group by 1""")
def source_groups(spark, d):
    s = eop.with_support(rel.scores(spark, d))
    return op.source_groups({"candidates": s.where("log_evidence > -50"), "ready": s.where(ev.succeeded(F.col("status")) & (F.col("log_evidence") > -30)), "validated": s.where("evidence_comparable")}, "n_time", ["event_index", "model"])


@query(f"with {rel.SCORES_SQL} select session, event_index, model, row_key, g as source_group, log_evidence from (select *, nullif(event_index % 50, 0) as g, row_number() over (partition by nullif(event_index % 50, 0) order by log_evidence desc nulls last, session, event_index, model, row_key) as r from scores) where g is null or r = 1")
def strongest_of_source_group(spark, d):
    """One row of each source group, the strongest; rows without a group all stay."""
    s = rel.scores(spark, d).withColumn("source_group", F.when(F.col("event_index") % 50 != 0, F.col("event_index") % 50))
    return op.strongest_of_group(s, "source_group", "log_evidence", ["session", "event_index", "model", "row_key"]).select("session", "event_index", "model", "row_key", "source_group", "log_evidence")


@query(f"""{EVIDENCE_SQL}, p as (select distinct session, event_index, best_model, seed from evidence where best_model is not null), rc as (select session, avg((best_model = 'random')::int) as recovered, count(*) as events from p group by 1), pos as (select session, median(runtime_s) as median_error from supc group by 1)
select session, {_s('median_error')}, {_s('recovered', 'simulation_recovery')}, events as simulation_events, row_number() over (order by round(median_error, 6) nulls last, round(recovered, 6) desc nulls last, session) as rank from pos left join rc using (session)""")
def sweep_recovery(spark, d):
    p = eop.model_evidence(rel.scores(spark, d)).where("best_model is not null").select("session", "event_index", "best_model", "seed").distinct()
    r = p.groupBy("session").agg(F.round(F.avg((F.col("best_model") == "random").cast("double")), 6).alias("recovered"), F.count(F.lit(1)).alias("events")).withColumn("true_model", F.lit("overall"))
    pos = rel.scores(spark, d).groupBy("session").agg(F.round(F.median("runtime_s"), 6).alias("median_error"))
    return op.sweep_recovery(pos, r, ["session"]).select("session", _r("median_error"), _r("simulation_recovery"), "simulation_events", F.col("rank").cast("long").alias("rank"))


@query()
def null_calibration(spark, d):
    """Trajectory labels against long windows: exact laws of what shuffles would pass."""
    s = rel.scores(spark, d).select((F.col("model_family") == "trajectory").alias("label"), (F.col("n_time") > 6).alias("state"), F.col("test_spikes").alias("margin"))
    return op.null_calibration(s, "label", "state", "margin", 20.0)


@query()
def random_effects_selection(spark, d):
    s = eop.with_support(rel.scores(spark, d)).where("evidence_comparable")
    return op.random_effects(s, ["random", "stationary", "state-space-diffusion"]).select("model", _r("p_model", digits=4), _r("p_exceedance", digits=3))


_CHECKS = f"""{_P}, {_COUNTS}, eb as (select session, event_index, t_idx::int as t_idx, least("end", start + (t_idx + 1) * 20.0::double) - (start + t_idx * 20.0::double) as bin_dur from (select *, unnest(range(greatest(ceil(("end" - start) / 20.0 - 1e-9)::int, 1))) as t_idx from short_events)),
span as (select session, max(t) - min(t) as s from spikes group by 1), mr as (select session, cell_id, count(*) / any_value(s) as rate from spikes join span using (session) group by 1, 2),
full_ as (select eb.session, eb.event_index, eb.t_idx, mr.cell_id, coalesce(ec.n, 0) as o, rate * bin_dur as e from eb join mr using (session) left join ec on ec.session = eb.session and ec.event_index = eb.event_index and ec.t_idx = eb.t_idx and ec.cell_id = mr.cell_id),
bn as (select session, event_index, t_idx, sum(o) as o, sum(e) as e, sum(abs(o - e) / sqrt(greatest(e, 2.220446049250313e-16::double))) as z, max(abs(o - e) / sqrt(greatest(e, 2.220446049250313e-16::double))) as zm, count(*) as k from full_ group by 1, 2, 3)"""


@query(f"""{_CHECKS} select session, event_index, sum(o)::bigint as observed_total, {_s('sum(e)', 'expected_total', 5)}, {_s('(sum(o) - sum(e)) / sqrt(greatest(sum(e), 2.220446049250313e-16::double))', 'total_z', 5)}, {_s('avg((o = 0)::int)', 'silent_fraction')}, {_s('avg(exp(-e))', 'expected_silent_fraction', 5)}, {_s('sum(z) / sum(k)', 'mean_abs_z', 5)}, {_s('max(zm)', 'max_abs_z', 4)} from bn group by 1, 2""")
def predictive_checks(spark, d):
    """Counts of each event's bins, silent ones too, against each cell's mean rate."""
    spikes, events = rel.spikes(spark, d), rel.short_events(spark, d)
    span = spikes.groupBy("session").agg((F.max("t") - F.min("t")).alias("s"))
    rate = spikes.groupBy("session", "cell_id").agg(F.count(F.lit(1)).alias("k")).join(span, "session").select("session", "cell_id", (F.col("k") / F.col("s")).alias("rate"))
    full = tracks.dense_counts(spikes, events, rate.select("session", "cell_id"), 20.0).join(rate, ["session", "cell_id"])
    c = op.predictive_checks(full.select("session", "event_index", "t_idx", "cell_id", F.col("n").alias("observed"), (F.col("rate") * F.col("bin_dur")).alias("expected")))
    return c.select("session", "event_index", "observed_total", _r("expected_total", digits=5), _r("total_z", digits=5), _r("silent_fraction"), _r("expected_silent_fraction", digits=5), _r("mean_abs_z", digits=5), _r("max_abs_z", digits=4))


@query(f"""{_P}, v as (select e.session, e.event_index, min({{'a': w.fill_t, 'w': w.well_id}}) as v, any_value(e.end) as stop from short_events e left join well_sequence w on w.session = e.session and w.fill_t > e.end and w.fill_t <= e.end + 300 group by 1, 2)
select session, event_index, coalesce(v.w::varchar, 'unknown') as next_well_context, case when v.a is not null then round(1 / (1 + greatest(v.a - stop, 0)), 6) + 0.0 end as context_confidence from v""")
def context_conditioning(spark, d):
    h = tracks.horizon_visit(rel.short_events(spark, d), rel.well_sequence(spark, d).withColumnRenamed("fill_t", "t"), 300.0)
    return op.context_conditioning(h).select("session", "event_index", "next_well_context", _r("context_confidence"))


@query(f"""{_P}, b as (select s.*, p.value as f1, p.k as f2, ntile(5) over (partition by s.session order by s.t, s.spike_row) - 1 as block from spikes s join stream p on p.event_id = s.spike_row), m as (select session, block, count(*) as marks, min(t) as a, max(t) as z, avg(f1) as m1, avg(f2) as m2, var_pop(f1) as v1, var_pop(f2) as v2 from b group by 1, 2),
g as (select session, avg(f1) as g1, avg(f2) as g2 from b group by 1) select m.session, m.block::int as block, m.marks, {_s('m.a', 'start', 4)}, {_s('m.z', 'stop', 4)}, {_s('m.m1', 'mean_f1', 4)}, {_s('m.v1', 'var_f1', 3)}, {_s('sqrt(pow(m.m1 - g1, 2) + pow(m.m2 - g2, 2))', 'from_all', 4)}, {_s('sqrt(pow(m.m1 - f.m1, 2) + pow(m.m2 - f.m2, 2))', 'from_first', 4)} from m join g using (session) join m f on f.session = m.session and f.block = 0""")
def mark_drift_blocks(spark, d):
    """Marks of spikes in five blocks of time."""
    features = rel._stream(spark, d).select(F.col("event_id").alias("spike_row"), F.col("value").alias("f1"), F.col("k").alias("f2"))
    b = op.drift_blocks(rel.spikes(spark, d).join(features, "spike_row"), ["f1", "f2"], 5, order=("t", "spike_row"))
    return b.select("session", "block", "marks", _r("start", digits=4), _r("end", "stop", 4), _r("mean_f1", digits=4), _r("var_f1", digits=3), _r("from_all", digits=4), _r("from_first", digits=4))
