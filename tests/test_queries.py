"""Every registered query with SQL gives the SQL's rows."""

import math

import duckdb
import pytest

from driftfield import catalog
from driftfield.sources import relations as rel
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", [k for k, q in catalog.QUERIES.items() if q.sql])
def test_query_matches_sql(spark, duck, name):
    q = catalog.QUERIES[name]
    same(q.run(spark, DATA), duck.execute(q.sql))


def same(df, res):
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(cols, r))) for r in res.fetchall())
    got = sorted(tuple(plain(v) for _, v in sorted(zip(df.columns, r))) for r in df.collect())
    assert got == want


#: Event numbers that repeat over sessions, as recordings have them.
NUMBERED = "short_events as (select session, row_number() over (partition by session order by event_id) as event_index, t as start, t + 72 + k * 1.44::double as \"end\", t + 36 as peak from stream where event_type = 'error')"


@pytest.mark.parametrize("name", [k for k, q in catalog.QUERIES.items() if q.sql and "event_index" in q.sql.replace(rel.SHORT_EVENTS_SQL, "") and rel.SHORT_EVENTS_SQL in q.sql])
def test_query_matches_sql_with_event_numbers_that_repeat(spark, duck, monkeypatch, name):
    derived = rel.short_events
    monkeypatch.setattr(rel, "short_events", lambda s, d: derived(s, d).withColumn("event_index", F.expr("cast(row_number() over (partition by session order by event_index) as long)")))
    q = catalog.QUERIES[name]
    same(q.run(spark, DATA), duck.execute(q.sql.replace(rel.SHORT_EVENTS_SQL, NUMBERED)))


@pytest.mark.parametrize("name", [k for k, q in catalog.QUERIES.items() if not q.sql])
def test_query_runs(spark, name):
    assert catalog.QUERIES[name].run(spark, DATA).count() > 0
