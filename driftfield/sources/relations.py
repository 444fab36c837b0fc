"""The engine's relations, read from parquet: scores of events, tracks, spikes, events, epochs and wells.

A recording in the engine's own layout has one parquet file per relation; `recording`
reads those. The functions of one table below derive the same relations from the star
schema and event stream that the repository's queries run on. Each has an SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Model names by number, and the numbers of models that follow a trajectory.
MODELS = {
    1: "random", 2: "stationary", 3: "state-space-fragmented", 4: "state-space-diffusion",
    5: "state-space-momentum", 6: "state-space-imm", 7: "goal",
}
TRAJECTORY = ("state-space-diffusion", "state-space-momentum", "state-space-imm", "goal")
STATIC = ("random", "stationary", "state-space-fragmented")
#: Evidence-support labels that the score tables carry.
SUPPORT = {4: "exact_full_grid", 5: "truncated_full_grid", 6: "truncated_full_grid"}

SESSION = "concat('Rat', cast({k} % 4 + 1 as string), '/Open', cast(floor({k} / 4) % 2 + 1 as int))"
SESSION_SQL = "'Rat' || ({k} % 4 + 1) || '/Open' || ((({k}) // 4) % 2 + 1)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recording(spark: SparkSession, folder: str, names=("position", "spikes", "cells", "events", "epochs", "well_sequence", "marks")) -> dict[str, DataFrame]:
    """All relations of recordings kept in the engine's layout."""
    return {n: read(spark, folder, n) for n in names}


def _case(values: dict, of: str, other: str) -> str:
    return f"case {of} " + " ".join(f"when {k} then '{v}'" for k, v in values.items()) + f" else {other} end"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scored (event, model): a line of an order; lines of one number twice are repeats."""
    model = _case(MODELS, "l_linenumber", "'other'")
    return read(spark, sf_dir, "lineitem").selectExpr(
        SESSION.format(k="l_orderkey") + " as session",
        "concat('Rat', cast(l_orderkey % 4 + 1 as string)) as rat",
        "l_orderkey as event_index",
        f"{model} as model",
        f"case when {model} in {TRAJECTORY} then 'trajectory' else 'nontrajectory' end as model_family",
        "case when l_returnflag = 'R' and l_linestatus = 'F' then 'failed' when l_returnflag = 'N' then null else 'success' end as status",
        f"{_case(SUPPORT, 'l_linenumber', 'cast(null as string)')} as support_label",
        "-l_extendedprice / 1000D as log_evidence",
        "l_quantity as test_spikes",
        "cast(l_partkey % 12 + 1 as int) as n_time",
        "cast(l_suppkey % 5 as int) as seed",
        "l_tax * 100 as runtime_s",
        "l_partkey * 1000000 + l_suppkey * 1000 + cast(l_quantity as bigint) as row_key",
        f"case when {model} like 'state-space-%' then substr({model}, 13) end as mode",
        "concat(cast(l_partkey % 7 as string), ', ', cast(l_suppkey % 5 + 7 as string), ';', case when l_linenumber = 3 then 'none' else cast(l_linenumber + 12 as string) end) as train_cell_ids",
        "case when l_quantity < 45 then -l_discount * 2 end as candidate_log_mass",
    )


SCORES_SQL = f"""scores as (select {SESSION_SQL.format(k='l_orderkey')} as session, 'Rat' || (l_orderkey % 4 + 1) as rat, l_orderkey as event_index,
  {_case(MODELS, 'l_linenumber', "'other'")} as model,
  case when {_case(MODELS, 'l_linenumber', "'other'")} in {TRAJECTORY} then 'trajectory' else 'nontrajectory' end as model_family,
  case when l_returnflag = 'R' and l_linestatus = 'F' then 'failed' when l_returnflag = 'N' then null else 'success' end as status,
  {_case(SUPPORT, 'l_linenumber', 'null')} as support_label,
  -l_extendedprice / 1000.0::double as log_evidence, l_quantity as test_spikes, (l_partkey % 12 + 1)::int as n_time, (l_suppkey % 5)::int as seed,
  l_tax * 100 as runtime_s, l_partkey * 1000000 + l_suppkey * 1000 + l_quantity::bigint as row_key,
  case when {_case(MODELS, 'l_linenumber', "'other'")} like 'state-space-%' then substr({_case(MODELS, 'l_linenumber', "'other'")}, 13) end as mode,
  (l_partkey % 7) || ', ' || (l_suppkey % 5 + 7) || ';' || case when l_linenumber = 3 then 'none' else (l_linenumber + 12)::varchar end as train_cell_ids,
  case when l_quantity < 45 then -l_discount * 2 end as candidate_log_mass from lineitem)"""

#: Seconds of the stream's clock are shortened so that a month of rows spans hours of a recording.
CLOCK = 100


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return read(spark, sf_dir, "events").select(
        "event_id", F.expr(SESSION.format(k="user_id")).alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6 * CLOCK) - F.lit(1704067200.0 / CLOCK)).alias("t"),
        (F.col("user_id") % 16).cast("int").alias("cell_id"), F.col("user_id"), "event_type", "value", k.alias("k"),
    )


STREAM_SQL = f"""stream as (select event_id, {SESSION_SQL.format(k='user_id')} as session, epoch_us(ts) / (1e6 * {CLOCK})::double - 1704067200.0::double / {CLOCK} as t,
  (user_id % 16)::int as cell_id, user_id, event_type, value, (props::json ->> '$.k')::double as k from events)"""


def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, frame_idx, t, x, y: the stream's views, clicks and purchases as a track."""
    return _stream(spark, sf_dir).where("event_type in ('view', 'click', 'purchase')").select("session", F.col("event_id").alias("frame_idx"), "t", F.least("value", F.lit(200.0)).alias("x"), F.col("k").alias("y"))


POSITION_SQL = STREAM_SQL + ", position as (select session, event_id as frame_idx, t, least(value, 200.0::double) as x, k as y from stream where event_type in ('view', 'click', 'purchase'))"


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, spike_row, t, cell_id: every row of the stream is a spike of its user's cell."""
    return _stream(spark, sf_dir).select("session", F.col("event_id").alias("spike_row"), "t", "cell_id")


SPIKES_SQL = "spikes as (select session, event_id as spike_row, t, cell_id from stream)"


def short_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, event_index, start, end, peak: a window of 2 to 6 hours of the stream's clock at each error."""
    return _stream(spark, sf_dir).where("event_type = 'error'").select("session", F.col("event_id").alias("event_index"), F.col("t").alias("start"), (F.col("t") + 72 + F.col("k") * 1.44).alias("end"), (F.col("t") + 36).alias("peak"))


SHORT_EVENTS_SQL = "short_events as (select session, event_id as event_index, t as start, t + 72 + k * 1.44::double as \"end\", t + 36 as peak from stream where event_type = 'error')"


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, kind, start, end: a run of a day's half at each tenth signup, of which many overlap."""
    return _stream(spark, sf_dir).where("event_type = 'signup' and event_id % 10 = 0").select("session", F.lit("run").alias("kind"), F.col("t").alias("start"), (F.col("t") + 200).alias("end"))


EPOCHS_SQL = "epochs as (select session, 'run' as kind, t as start, t + 200 as \"end\" from stream where event_type = 'signup' and event_id % 10 = 0)"


def every_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, kind, start, end: as `epochs`, at every signup."""
    return _stream(spark, sf_dir).where("event_type = 'signup'").select("session", F.lit("run").alias("kind"), F.col("t").alias("start"), (F.col("t") + 200).alias("end"))


EVERY_EPOCH_SQL = "every_epoch as (select session, 'run' as kind, t as start, t + 200 as \"end\" from stream where event_type = 'signup')"


def well_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, fill_t, well_id: the well that is filled from each purchase above 100 on."""
    return _stream(spark, sf_dir).where("event_type = 'purchase' and value > 100").select("session", F.col("t").alias("fill_t"), (F.col("k") % 6).cast("int").alias("well_id"), F.col("event_id").alias("seq_idx"))


WELLS_SQL = "well_sequence as (select session, t as fill_t, (k::bigint % 6)::int as well_id, event_id as seq_idx from stream where event_type = 'purchase' and value > 100)"
