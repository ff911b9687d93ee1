"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.operators import lookup
from lodestack.registry import query, table
from lodestack.streaming import folds


def _k(c: str = "props"):
    return F.get_json_object(c, "$.k").cast("long")


@query("""
select event_id, user_id, event_type from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and event_type in ('error', 'purchase') and user_id < 100
order by ts desc, event_id limit 20 offset 20""")
def audit_log_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-20' and event_type in ('error', 'purchase') and user_id < 100")
    return lookup.page(rows, [F.desc("ts"), F.col("event_id")], 2, 20).select("event_id", "user_id", "event_type")


@query("""
with r as (select user_id, event_type, event_id, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events)
select user_id, event_type, event_id, value from r where rn = 1""")
def upsert_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return lookup.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
with e as (select user_id, event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events),
r as (select *, row_number() over (partition by user_id order by event_id) as rn from e where k >= 50 and event_type is distinct from 'view')
select user_id, event_id, k from r where rn = 1""")
def jsonpath_filter_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first item of each user that passes the filter; != also holds where the field is missing."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", _k().alias("k")).where((F.col("k") >= 50) & ~F.col("event_type").eqNullSafe(F.lit("view")))
    return e.groupBy("user_id").agg(F.min(F.struct("event_id", "k")).alias("x")).select("user_id", "x.event_id", "x.k")


@query("""
with e as (select user_id, ts, event_id, event_type, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as seen from events)
select event_id, seen as view_id from e where event_type = 'purchase'""")
def asof_caption(spark: SparkSession, sf: str) -> DataFrame:
    """The last view before each purchase of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = table(spark, sf, "events").where("event_type in ('view', 'purchase')")
    return e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "view_id")


@query("""
select event_id, user_id from events where (event_type = 'signup' and ts <= timestamp '2024-01-15') or (event_type = 'error' and ts + interval 1 hour <= timestamp '2024-01-15') order by ts, event_id limit 25""")
def ready_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Queued and due, or running with a lease that has run out; the limit is the dispatcher's capacity."""
    due = table(spark, sf, "events").where("(event_type = 'signup' and ts <= timestamp_ntz '2024-01-15') or (event_type = 'error' and ts + interval 1 hour <= timestamp_ntz '2024-01-15')")
    return due.orderBy("ts", "event_id").limit(25).select("event_id", "user_id")


@query("""
select cast(time_bucket(interval 1 hour, ts) as timestamp) as hour, event_type, cast(count(*) as bigint) as n, cast(sum(cast(value as decimal(18,4))) as decimal(38,4)) as total from events group by 1, 2""")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling hours; the same transformation serves streams (lodestack.streaming.windows)."""
    e = table(spark, sf, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(38,4)").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query()
def lease_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Claims, heartbeats and reclaims per job, folded in event order (sequential state, no SQL form)."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), "ts", "event_id", F.col("event_type").alias("action"))
    return folds.leases(e, minutes=240)


CACHES_SQL = """
with e as (select user_id as cache, epoch_us(ts) as t, event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events),
l as (select cache, list({'k': k, 't': t, 'e': []::struct(k bigint, t bigint)[], 'h': 0::bigint, 'm': 0::bigint, 'v': 0::bigint} order by t, event_id) as l from e group by cache),
f as (select cache, list_reduce(list_concat([{'k': 0::bigint, 't': 0::bigint, 'e': []::struct(k bigint, t bigint)[], 'h': 0::bigint, 'm': 0::bigint, 'v': 0::bigint}], l), lambda s, x:
  case when len(list_filter(s.e, lambda y: y.k = x.k and x.t - y.t <= 86400000000)) > 0 then {'k': 0::bigint, 't': 0::bigint, 'e': s.e, 'h': s.h + 1, 'm': s.m, 'v': s.v}
    when len(list_filter(s.e, lambda y: y.k = x.k)) > 0 then {'k': 0::bigint, 't': 0::bigint, 'e': list_append(list_filter(s.e, lambda y: y.k <> x.k), {'k': x.k, 't': x.t}), 'h': s.h, 'm': s.m + 1, 'v': s.v}
    when len(s.e) >= 20 then {'k': 0::bigint, 't': 0::bigint, 'e': list_append(s.e[2:], {'k': x.k, 't': x.t}), 'h': s.h, 'm': s.m + 1, 'v': s.v + 1}
    else {'k': 0::bigint, 't': 0::bigint, 'e': list_append(s.e, {'k': x.k, 't': x.t}), 'h': s.h, 'm': s.m + 1, 'v': s.v} end) as s from l)
select cache, s.h as hits, s.m as misses, s.v as evictions from f"""


@query(CACHES_SQL)
def ttl_cache_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Hits, misses and evictions of a cache per user, folded in event order."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("cache"), "ts", "event_id", _k().alias("key"))
    return folds.ttl_caches(e, seconds=86_400, size=20)


@query("""
with s as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh from events),
g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as no from s)
select user_id, cast(no as bigint) as session_no, cast(count(*) as bigint) as n from g group by 1, 2""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "ts", "event_id").withColumn("fresh", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1))
    g = e.withColumn("session_no", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return g.groupBy("user_id", "session_no").agg(F.count("*").alias("n"))
