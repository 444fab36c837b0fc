"""Queries over score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..operators import evidence as op
from ..operators import gates
from ..sources import relations as rel

QUERIES: dict = {}

#: Scores with their support and one row per model, in SQL.
SUPPORT_SQL = f"""with {rel.SCORES_SQL}, sup0 as (select *, coalesce(lower(status), 'success') = 'success' as ok from scores),
sup as (select *, case when not ok then 'not_scored' when support_label is not null then support_label
  when model in ('random', 'stationary', 'state-space-fragmented') then 'exact_full_grid' else 'unknown_noncomparable' end as evidence_support from sup0),
supc as (select *, evidence_support = 'exact_full_grid' and ok as evidence_comparable,
  case evidence_support when 'exact_full_grid' then 'exact_model_evidence' when 'truncated_full_grid' then 'truncated_lower_bound' when 'not_scored' then 'not_scored' else 'unknown_noncomparable' end as evidence_comparison from sup),
one as (select * exclude r from (select *, row_number() over (partition by session, event_index, model order by log_evidence desc, row_key) as r from supc) where r = 1),
exact1 as (select * exclude r from (select *, row_number() over (partition by session, event_index, model order by log_evidence desc, row_key) as r from supc where evidence_comparable) where r = 1)"""

_W = "over (partition by session, event_index)"
EVIDENCE_SQL = f"""{SUPPORT_SQL}, ev1 as (select *, case when evidence_comparable then log_evidence end as e, case when ok and evidence_support = 'truncated_full_grid' then log_evidence end as c from one),
ev2 as (select *, e - max(e) {_W} as rel, c - max(c) {_W} as truncated_relative_log_evidence,
  min(case when e is not null then {{'k': -e, 'm': model}} end) {_W} as bm, min(case when c is not null then {{'k': -c, 'm': model}} end) {_W} as bt,
  min(case when e is not null and model_family = 'trajectory' then {{'k': -e, 'm': model}} end) {_W} as bj, min(case when e is not null and model_family = 'nontrajectory' then {{'k': -e, 'm': model}} end) {_W} as bn,
  e - max(case when model_family = 'trajectory' then e end) {_W} as delta_vs_trajectory_best, e - max(case when model_family = 'nontrajectory' then e end) {_W} as delta_vs_nontrajectory_best from ev1),
evidence as (select *, rel as relative_log_evidence, exp(rel) / sum(exp(rel)) {_W} as model_probability, bm.m as best_model, bj.m as best_trajectory_model, bn.m as best_nontrajectory_model, bt.m as best_truncated_model,
  coalesce(e is not null and model = bm.m, false) as is_best_model, coalesce(c is not null and model = bt.m, false) as is_best_truncated from ev2)"""


def _r(c, name=None, digits=6):
    return ev.rounded(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)


def _s(c, name=None, digits=6):
    return f"round({c}, {digits}) + 0.0 as {name or c}"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f
    return add


@query(f"{EVIDENCE_SQL} select session, event_index, model, evidence_support, {_s('relative_log_evidence')}, {_s('model_probability')}, is_best_model, best_model, best_trajectory_model, {_s('delta_vs_trajectory_best')}, best_nontrajectory_model, {_s('delta_vs_nontrajectory_best')}, {_s('truncated_relative_log_evidence')}, is_best_truncated from evidence")
def model_evidence(spark, d):
    e = op.model_evidence(rel.scores(spark, d))
    return e.select("session", "event_index", "model", "evidence_support", _r("relative_log_evidence"), _r("model_probability"), "is_best_model", "best_model", "best_trajectory_model", _r("delta_vs_trajectory_best"), "best_nontrajectory_model", _r("delta_vs_nontrajectory_best"), _r("truncated_relative_log_evidence"), "is_best_truncated")


@query(f"{EVIDENCE_SQL} select model, model_family, evidence_support, evidence_comparable, count(event_index) as events, sum(is_best_model::int)::bigint as wins, sum(is_best_truncated::int)::bigint as truncated_wins, {_s('avg(log_evidence)', 'mean_log_evidence')}, {_s('median(log_evidence)', 'median_log_evidence')}, {_s('avg(relative_log_evidence)', 'mean_relative_log_evidence')}, {_s('avg(model_probability)', 'mean_model_probability')}, {_s('avg(runtime_s)', 'mean_runtime_s')}, {_s('sum(is_best_model::int) / greatest(count(event_index), 1)', 'win_fraction')} from evidence where ok group by 1, 2, 3, 4")
def evidence_summary(spark, d):
    s = op.evidence_summary(op.model_evidence(rel.scores(spark, d)))
    return s.select("model", "model_family", "evidence_support", "evidence_comparable", "events", "wins", "truncated_wins", *[_r(c) for c in ("mean_log_evidence", "median_log_evidence", "mean_relative_log_evidence", "mean_model_probability", "mean_runtime_s", "win_fraction")])


@query(f"{SUPPORT_SQL} select evidence_support, evidence_comparison, evidence_comparable, model, count(*) as rows_scored from supc group by 1, 2, 3, 4")
def evidence_support_counts(spark, d):
    return op.with_support(rel.scores(spark, d)).groupBy("evidence_support", "evidence_comparison", "evidence_comparable", "model").agg(F.count(F.lit(1)).alias("rows_scored"))


@query(f"""{SUPPORT_SQL}, r as (select *, row_number() over (partition by session, event_index order by log_evidence desc, model) as k from exact1),
g as (select session, event_index, max(case when k = 1 then model end) as best_model_by_evidence, max(case when k = 2 then model end) as second_best_model_by_evidence, max(case when k = 1 then log_evidence end) as b, max(case when k = 2 then log_evidence end) as s, count(*) as models_compared from r group by 1, 2)
select session, event_index, best_model_by_evidence, second_best_model_by_evidence, models_compared, round(b - s, 6) + 0.0 as evidence_margin, case when s is null then 'missing' when b - s <= 1 then 'tie' when b - s <= 3 then 'weak' when b - s <= 10 then 'strong' else 'decisive' end as evidence_margin_category from g""")
def evidence_margins(spark, d):
    m = op.evidence_margins(rel.scores(spark, d))
    shown = F.when(F.col("models_compared") > 1, ev.rounded(F.col("evidence_margin")))
    return m.select("session", "event_index", "best_model_by_evidence", "second_best_model_by_evidence", "models_compared", shown.alias("evidence_margin"), "evidence_margin_category")


@query(f"""{SUPPORT_SQL}, x as (select *, case when evidence_comparable then 'exact_model' when ok and evidence_support = 'truncated_full_grid' then 'truncated_lower_bound' end as scope from supc),
y as (select *, row_number() over w as scope_rank, first_value(model) over w as scope_best_model, first_value(log_evidence) over w as b, nth_value(log_evidence, 2) over (partition by session, event_index, scope order by log_evidence desc, model, row_key rows between unbounded preceding and unbounded following) as s from x where scope is not null window w as (partition by session, event_index, scope order by log_evidence desc, model, row_key))
select session, event_index, model, row_key, scope, scope_rank, scope_best_model, round(log_evidence - b, 6) + 0.0 as scope_relative, case when s is null or b - s > 10 then 'decisive' when b - s <= 1 then 'tie' when b - s <= 3 then 'weak' else 'strong' end as scope_margin_label from y""")
def support_scope_margins(spark, d):
    return op.support_scope_margins(rel.scores(spark, d)).select("session", "event_index", "model", "row_key", "scope", F.col("scope_rank").cast("long").alias("scope_rank"), "scope_best_model", _r("scope_relative"), "scope_margin_label")


@query(f"""{SUPPORT_SQL}, b as (select *, max(case when evidence_comparable and model in {rel.STATIC} then log_evidence end) {_W} as best_static from supc)
select session, event_index, model, row_key, best_static, case when evidence_comparable then round(log_evidence - best_static, 6) + 0.0 end as delta_vs_best_static, case when evidence_support = 'truncated_full_grid' then round(log_evidence - best_static, 6) + 0.0 end as lower_bound_delta_vs_best_static,
case when evidence_comparable then round((log_evidence - best_static) / ln(2.0::double) / greatest(test_spikes, 1.0), 6) + 0.0 end as bits_per_spike_vs_best_static from b""")
def baseline_relative(spark, d):
    b = op.baseline_relative(rel.scores(spark, d), rel.STATIC)
    return b.select("session", "event_index", "model", "row_key", "best_static", _r("delta_vs_best_static"), _r("lower_bound_delta_vs_best_static"), _r("bits_per_spike_vs_best_static"))


@query(f"""with {rel.SCORES_SQL} select session, event_index, model, row_key, concat_ws(';', case when status = 'failed' then 'score_failure' end, case when test_spikes < 3 then 'low_spike_count' end, case when n_time < 2 then 'too_few_time_bins' end) as event_reliability_reasons,
not (coalesce(status = 'failed', false) or test_spikes < 3 or n_time < 2) as event_reliable from scores""")
def event_reliability(spark, d):
    return op.reliability(rel.scores(spark, d)).select("session", "event_index", "model", "row_key", "event_reliability_reasons", "event_reliable")


_HIER = f"""{EVIDENCE_SQL}, h as (select * from evidence where ok and relative_log_evidence is not null),
hs as (select model, session, avg(relative_log_evidence) as m from h group by 1, 2), hr as (select model, rat, avg(relative_log_evidence) as m from h group by 1, 2)"""


@query(f"""{_HIER} select model, event_rows, {_s('event_mean')}, sessions, {_s('session_mean')}, {_s('session_sd')}, rats, {_s('rat_mean')}, {_s('rat_sd')} from (select model, count(*) as event_rows, avg(relative_log_evidence) as event_mean from h group by 1)
left join (select model, count(*) as sessions, avg(m) as session_mean, stddev_samp(m) as session_sd from hs group by 1) using (model) left join (select model, count(*) as rats, avg(m) as rat_mean, stddev_samp(m) as rat_sd from hr group by 1) using (model)""")
def hierarchical_means(spark, d):
    h = op.hierarchical_means(op.model_evidence(rel.scores(spark, d)))
    return h.select("model", "event_rows", _r("event_mean"), "sessions", _r("session_mean"), _r("session_sd"), "rats", _r("rat_mean"), _r("rat_sd"))


@query(f"""{_HIER}, g as (select model, session, sum(relative_log_evidence) as s, count(*) as n from h group by 1, 2), t as (select *, sum(s) over (partition by model) as ts, sum(n) over (partition by model) as tn from g)
select model, session as left_out_group, round(ts / tn, 6) + 0.0 as full_mean, round((ts - s) / nullif(tn - n, 0), 6) + 0.0 as leave_one_mean, round((ts - s) / nullif(tn - n, 0) - ts / tn, 6) + 0.0 as influence_delta from t""")
def leave_one_session_out(spark, d):
    x = op.leave_one_group_out(op.model_evidence(rel.scores(spark, d)))
    return x.select("model", "left_out_group", _r("full_mean"), _r("leave_one_mean"), _r("influence_delta"))


@query(f"{EVIDENCE_SQL} select session, rat, seed, model, count(*) as events, {_s('avg(log_evidence)', 'mean_log_evidence')} from evidence where ok group by grouping sets ((session, model), (rat, model), (seed, model))")
def score_rollups(spark, d):
    return op.rollups(op.model_evidence(rel.scores(spark, d))).select("session", "rat", "seed", "model", "events", _r("mean_log_evidence"))


_CORE = ("random", "stationary", "state-space-diffusion")


@query(f"""{SUPPORT_SQL}, g as (select session, event_index, max(case when model_family = 'trajectory' then log_evidence end) as a, max(case when model_family = 'nontrajectory' then log_evidence end) as b, count(distinct case when model in {_CORE} then model end) as core_models from exact1 group by 1, 2)
select session, event_index, core_models::int as core_models, round(a - b, 6) + 0.0 as delta, case when core_models < {len(_CORE)} then 'incomplete_core' when a - b >= 1 then 'trajectory' when a - b <= -1 then 'nontrajectory' else 'ambiguous' end as decision from g""")
def family_decision(spark, d):
    return op.family_decision(rel.scores(spark, d), _CORE).select("session", "event_index", "core_models", _r("delta"), "decision")


def _named(where):
    return f"""select session, event_index, m as model, log_evidence from (select *, row_number() over (partition by session, event_index, m order by log_evidence desc, row_key) as r from (select *, regexp_replace(lower(trim(model)), '^(state-space|clusterless)-', '') as m from scores where {where})) where r = 1"""


@query(f"""with {rel.SCORES_SQL}, a as ({_named('seed < 3')}), b as ({_named('seed >= 2')}) select coalesce(a.session, b.session) as session, coalesce(a.event_index, b.event_index) as event_index, coalesce(a.model, b.model) as model, a.log_evidence as left_log_evidence, b.log_evidence as right_log_evidence, round(b.log_evidence - a.log_evidence, 6) + 0.0 as delta
from a full join b on a.session = b.session and a.event_index = b.event_index and a.model = b.model""")
def compare_runs(spark, d):
    s = rel.scores(spark, d)
    return op.compare_runs(s.where("seed < 3"), s.where("seed >= 2")).select("session", "event_index", "model", "left_log_evidence", "right_log_evidence", _r("delta"))


_SWEEP = "n_time, test_spikes, round(avg(log_evidence), 6) as score, round(avg(runtime_s), 6) as runtime, count(*) as n"


@query(f"""with {rel.SCORES_SQL}, s as (select {_SWEEP} from scores group by 1, 2) select n_time, test_spikes, score + 0.0 as score, runtime + 0.0 as runtime from s as a where not exists (select 1 from s as b where b.score >= a.score and b.runtime <= a.runtime and (b.score > a.score or b.runtime < a.runtime))""")
def pareto_front(spark, d):
    s = rel.scores(spark, d).groupBy("n_time", "test_spikes").agg(F.round(F.avg("log_evidence"), 6).alias("score"), F.round(F.avg("runtime_s"), 6).alias("runtime"))
    return op.pareto_front(s, {"score": "max", "runtime": "min"}).select("n_time", "test_spikes", (F.col("score") + 0.0).alias("score"), (F.col("runtime") + 0.0).alias("runtime"))


@query(f"""with {rel.SCORES_SQL} select model, n_time, count(distinct seed) as random_seed_count, array_to_string(list_sort(list(distinct seed)), ',') as random_seeds, count(*) as sweep_replicates, {_s('avg(log_evidence)', 'log_evidence_mean')}, {_s('stddev_samp(log_evidence)', 'log_evidence_std')}, min(log_evidence) as log_evidence_min, max(log_evidence) as log_evidence_max from scores group by 1, 2""")
def sweep_aggregate(spark, d):
    a = gates.sweep_aggregate(rel.scores(spark, d), ["model", "n_time"], ["log_evidence"])
    return a.select("model", "n_time", "random_seed_count", "random_seeds", "sweep_replicates", _r("log_evidence_mean"), _r("log_evidence_std"), "log_evidence_min", "log_evidence_max")


@query(f"""{EVIDENCE_SQL} select session, event_index, {_s("sum(case when model_probability > 0 then -model_probability * ln(model_probability) else 0 end)", 'entropy')}, {_s('max(model_probability)', 'best_probability')}, count(distinct model_family) as families from evidence where model_probability is not null group by 1, 2""")
def model_disagreement(spark, d):
    return op.softmax_entropy(op.model_evidence(rel.scores(spark, d))).select("session", "event_index", _r("entropy"), _r("best_probability"), "families")


_LIMITS = {"success_fraction": ("min", 0.5), "comparable_fraction": ("min", 0.95), "short_fraction": ("max", 0.2), "mean_spikes": ("min", 3.0)}


@query(f"""{SUPPORT_SQL}, v as (select avg(ok::int) as a, avg(evidence_comparable::int) as b, avg((n_time < 2)::int) as c, avg(test_spikes) as e from supc)
select gate, round(value, 6) + 0.0 as value, direction, gate_limit, case when direction = 'min' then case when value >= gate_limit then 'pass' else 'fail' end when value <= gate_limit then 'pass' else 'fail' end as result from (
select 'success_fraction' as gate, a as value, 'min' as direction, 0.5::double as gate_limit from v union all select 'comparable_fraction', b, 'min', 0.95 from v union all select 'short_fraction', c, 'max', 0.2 from v union all select 'mean_spikes', e, 'min', 3.0 from v)""")
def quality_gates(spark, d):
    g = gates.quality_gates(op.with_support(rel.scores(spark, d)), _LIMITS)
    return g.select("gate", _r("value"), "direction", F.col("limit").alias("gate_limit"), "result")


@query(f"""{EVIDENCE_SQL} select coalesce(x, 'overall') as true_model, events, {_s('recovered')} from (select x, count(*) as events, avg((x = best_model)::int) as recovered from (select distinct session, event_index, best_model, case event_index % 3 when 0 then 'random' when 1 then 'stationary' else 'state-space-diffusion' end as x from evidence where best_model is not null) group by rollup (x))""")
def recovery_summary(spark, d):
    return gates.recovery(_pairs(spark, d)).select("true_model", "events", _r("recovered"))


def _pairs(spark, d):
    true = F.when(F.col("event_index") % 3 == 0, "random").when(F.col("event_index") % 3 == 1, "stationary").otherwise("state-space-diffusion")
    e = op.model_evidence(rel.scores(spark, d)).where("best_model is not null")
    return e.select("session", "event_index", "best_model").distinct().withColumn("true_model", true)


@query(f"""{EVIDENCE_SQL}, p as (select distinct session, event_index, best_model, case event_index % 3 when 0 then 'random' when 1 then 'stationary' else 'state-space-diffusion' end as true_model from evidence where best_model is not null)
select true_model, count(*) filter (best_model = 'random') as "random", count(*) filter (best_model = 'stationary') as stationary, count(*) filter (best_model = 'state-space-fragmented') as fragmented, count(*) filter (best_model = 'state-space-diffusion') as diffusion from p group by 1""")
def confusion_matrix(spark, d):
    c = gates.confusion(_pairs(spark, d), ["random", "stationary", "state-space-fragmented", "state-space-diffusion"])
    return c.withColumnsRenamed({"state-space-fragmented": "fragmented", "state-space-diffusion": "diffusion"})


@query(f"""{EVIDENCE_SQL}, g as (select session, event_index, case event_index % 2 when 0 then 'state-space-momentum' else 'state-space-imm' end as expected_model, max(best_model) as best_exact_model, max(case when is_best_model then log_evidence end) as best_exact_log_evidence,
max(case when c is not null and model = case event_index % 2 when 0 then 'state-space-momentum' else 'state-space-imm' end then c end) as expected_lower_bound from evidence group by 1, 2, 3)
select session, event_index, expected_model, coalesce(best_exact_model = expected_model, false) or coalesce(expected_lower_bound > best_exact_log_evidence, false) as recovered, case when best_exact_model = expected_model then 'exact_best' when expected_lower_bound > best_exact_log_evidence then 'certified_lower_bound'
when best_exact_model is null and expected_lower_bound is null then 'not_scored' when expected_lower_bound is null then 'other_exact_best' else 'lower_bound_not_certified' end as reason from g""")
def certified_recovery(spark, d):
    e = op.model_evidence(rel.scores(spark, d)).withColumn("expected_model", F.when(F.col("event_index") % 2 == 0, "state-space-momentum").otherwise("state-space-imm"))
    g = e.groupBy("session", "event_index", "expected_model").agg(
        F.max("best_model").alias("best_exact_model"), F.max(F.when(F.col("is_best_model"), F.col("log_evidence"))).alias("best_exact_log_evidence"),
        F.max(F.when((F.col("model") == F.col("expected_model")) & F.col("truncated_relative_log_evidence").isNotNull(), F.col("log_evidence"))).alias("expected_lower_bound"))
    return gates.certified_recovery(g).select("session", "event_index", "expected_model", "recovered", "reason")


@query(f"""with {rel.SCORES_SQL} select session, event_index, count(distinct n_time) as variants, {_s('avg(log_evidence)', 'mean')}, {_s('stddev_samp(log_evidence)', 'sd')}, min(log_evidence) as low, max(log_evidence) as high, {_s('max(log_evidence) - min(log_evidence)', 'value_range')} from scores group by 1, 2""")
def window_sensitivity(spark, d):
    w = gates.window_sensitivity(rel.scores(spark, d).withColumn("variant", F.col("n_time")), ["session", "event_index"], "log_evidence")
    return w.select("session", "event_index", "variants", _r("mean"), _r("sd"), "low", "high", _r("range", "value_range"))


@query(f"with {rel.SCORES_SQL} select session, event_index, model, row_key, log_evidence from (select *, row_number() over (partition by session order by log_evidence desc nulls last, event_index, model, row_key) as r from scores) where r <= 10")
def top_scores(spark, d):
    """The feature is the limit: the ten best rows of each session."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy(F.desc_nulls_last("log_evidence"), "event_index", "model", "row_key")
    return rel.scores(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 10").select("session", "event_index", "model", "row_key", "log_evidence")
