"""Queries on state that is kept by key: leases and caches on streams, and tables that are published whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import publications
from lodestack.operators.rounds import folder
from lodestack.plans.events import CACHES_SQL
from lodestack.registry import query, table
from lodestack.streaming import caches, leases


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


def _own_folder(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/lodestack/{name}-{uuid.uuid4().hex}"


TERMS = leases.Terms(lease=4 * 3_600_000_000, wait=600_000_000)


@query("""
with e as (select user_id * 10 + event_id % 4 as job, epoch_us(ts) as t, event_id, case event_type when 'click' then 'claim' when 'signup' then 'claim' when 'view' then 'heartbeat' when 'purchase' then 'complete' when 'error' then 'error' end as a, event_id % 3 = 0 and event_type = 'purchase' as skip from events),
l as (select job, list({'a': a, 't': t, 's': 'QUEUED', 'u': 0::bigint, 'c': 0::bigint, 'r': 0::bigint, 'n': 0::bigint, 'code': ''} order by t, event_id) as l from e where not skip group by job),
f as (select job, list_reduce(list_concat([{'a': '', 't': 0, 's': 'QUEUED', 'u': 0::bigint, 'c': 0::bigint, 'r': 0::bigint, 'n': 0::bigint, 'code': ''}], l), lambda s, x:
  case when x.a = 'claim' and s.u <= x.t and s.s = 'QUEUED' then {'a': '', 't': 0, 's': 'RUNNING', 'u': x.t + 14400000000, 'c': s.c + 1, 'r': s.r, 'n': s.n, 'code': ''}
    when x.a = 'claim' and s.u <= x.t and s.s = 'RUNNING' and s.r < 1 then {'a': '', 't': 0, 's': 'RUNNING', 'u': x.t + 14400000000, 'c': s.c + 1, 'r': s.r + 1, 'n': s.n, 'code': ''}
    when x.a = 'claim' and s.u <= x.t and s.s = 'RUNNING' then {'a': '', 't': 0, 's': 'FAILED', 'u': 0, 'c': s.c, 'r': s.r, 'n': s.n, 'code': 'STALE_LEASE_EXHAUSTED'}
    when s.s <> 'RUNNING' or x.a = 'claim' then s
    when x.a = 'heartbeat' then {'a': '', 't': 0, 's': 'RUNNING', 'u': x.t + 14400000000, 'c': s.c, 'r': s.r, 'n': s.n, 'code': ''}
    when x.a = 'complete' then {'a': '', 't': 0, 's': 'COMPLETED', 'u': 0, 'c': s.c, 'r': s.r, 'n': s.n, 'code': ''}
    when s.n < 3 then {'a': '', 't': 0, 's': 'QUEUED', 'u': x.t + 600000000, 'c': s.c, 'r': s.r, 'n': s.n + 1, 'code': ''}
    else {'a': '', 't': 0, 's': 'FAILED', 'u': 0, 'c': s.c, 'r': s.r, 'n': s.n, 'code': 'TRANSIENT_RETRIES_EXHAUSTED'} end) as s from l)
select job, s.s as status, s.u as until, s.c as claims, s.r as reclaims, s.n as retries, s.code as code from f""")
def lease_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each job after a stream of claims, heartbeats, errors and completions, kept as one small row a job."""
    kind = F.col("event_type")
    action = F.when(kind.isin("click", "signup"), "claim").when(kind == "view", "heartbeat").when(kind == "purchase", "complete").otherwise("error")
    job = F.col("user_id") * 10 + F.col("event_id") % 4
    events = _stream(spark, sf, "events").where(~((F.col("event_id") % 3 == 0) & (kind == "purchase")))
    where = _own_folder(spark, "leases")
    leases.run_available(events.select(job.alias("job"), F.col("ts").cast("timestamp").alias("ts"), "event_id", action.alias("action")), TERMS, where)
    return leases.states(spark, where)


@query(CACHES_SQL)
def cache_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Hits, misses and evictions of a cache per user after a stream of requests; entries are kept as keyed state."""
    key = F.get_json_object("props", "$.k").cast("long")
    where = _own_folder(spark, "caches")
    requests = _stream(spark, sf, "events").select(F.col("user_id").alias("cache"), F.col("ts").cast("timestamp").alias("ts"), "event_id", key.alias("key"))
    caches.run_available(requests, 86_400, 20, where)
    return caches.totals(spark, where)


@query("""
with e as (select c_nationkey as version, c_custkey, c_name, c_mktsegment from customer),
r as (select version, count(*) as n from e join orders on o_custkey = c_custkey group by version),
m as (select version, count(*) as n, arg_min(c_name, (length(c_name), c_name)) filter (where c_mktsegment = 'BUILDING') as main from e group by version)
select m.version, 'COMPLETED' as status, m.n as entities, coalesce(r.n, 0) as relations, main as main_subject, m.n as seen_entities, coalesce(r.n, 0) as seen_relations from m left join r using (version)""")
def published_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of a graph after an interrupted publication with other rows, a whole one, and one again that comes too late: each is there once, whole."""
    root = _own_folder(spark, "graph")
    entities = table(spark, sf, "customer").select(F.col("c_nationkey").alias("version"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "BASIN").otherwise("AREA").alias("kind"))
    relations = table(spark, sf, "orders").join(entities.select("version", "key"), F.col("o_custkey") == F.col("key")).select("version", F.col("o_orderkey").alias("relation"), "key")
    versions = entities.select("version").distinct()
    publications.stage(root, versions, {"entities": entities.where("key % 2 = 0"), "relations": relations})  # interrupted: no header follows
    for rows in (entities, entities.where("key % 3 = 0")):
        publications.publish(root, versions, {"entities": rows, "relations": relations})
    seen = versions
    for name in ("entities", "relations"):
        counts = publications.published(spark, root, name).groupBy("version").agg(F.count("*").alias(f"seen_{name}"))
        seen = seen.join(counts, "version", "left")
    return publications.headers(spark, root).select("version", "status", "entities", "relations", "main_subject").join(seen, "version").fillna(0, ["seen_entities", "seen_relations"])


@query("""
with a as (select doc_id, text, lang from documents where doc_id % 2 = 0 union all select doc_id, text || ' ', lang from documents where doc_id % 5 = 0)
select sha256(concat('{"content_sha256":"', sha256(text), '","doc_id":', doc_id, ',"lang":"', lang, '"}')) as artifact_id, doc_id, length(text) as n from a""")
def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that are stored once, under an id made of what they are, after the same batch has come twice and one that overlaps it."""
    root = _own_folder(spark, "artifacts")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    first, more = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 5 = 0").withColumn("content", F.concat("content", F.lit(" ")))
    for batch in (first, first, first.where("doc_id % 4 = 0").unionByName(more)):
        publications.write_once(batch, ["doc_id", "lang"], "content", root)
    return publications.stored(spark, root).select("artifact_id", "doc_id", F.length("content").cast("long").alias("n"))
