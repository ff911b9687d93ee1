"""Keyed state over restarts, and publications that break off or come twice."""

import random
from dataclasses import astuple

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestack.operators import publications
from lodestack.streaming import caches, folds, leases

TERMS = leases.Terms(lease=600_000_000, wait=60_000_000, retries=2)
EVENTS = "job long, ts timestamp, event_id long, action string"


def made_events(n, seed):
    made, now, rows = random.Random(seed), 1_700_000_000, []
    for i in range(n):
        now += made.choice([0, 1, 30, 60, 600])
        rows.append((made.randrange(12), now, i, made.choices(["claim", "heartbeat", "complete", "error", "other"], [6, 4, 0.4, 3, 1])[0]))
    return rows


def timed(spark, rows, schema):
    names = schema.split(", ")
    plain = ", ".join(c if not c.startswith("ts ") else "ts long" for c in names)
    return spark.createDataFrame(rows, plain).withColumn("ts", F.timestamp_seconds("ts"))


def test_leases_over_two_restarts_equal_one_fold(spark, tmp_path):
    rows = made_events(400, 31)
    for part in range(3):
        timed(spark, rows[part * 140 : (part + 1) * 140], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/events")
        leases.run_available(stream, TERMS, f"{tmp_path}/out")
    want = {}
    for job, now, _, action in sorted(rows, key=lambda r: (r[1], r[2])):
        want[job] = leases.step(want.get(job, leases.Job()), action, now * 1_000_000, TERMS)
    got = {r.job: tuple(r)[1:] for r in leases.states(spark, f"{tmp_path}/out").collect()}
    assert got == {k: astuple(v) for k, v in want.items()}
    assert {v.code for v in want.values()} >= {leases.STALE}
    # every lease that ran out before the last event of the batch before is told
    told = spark.read.parquet(f"{tmp_path}/out/states").where("claimable").count()
    assert told > 0


def test_steps_at_the_bounds():
    job = leases.step(leases.Job(), "claim", 5, TERMS)
    assert leases.step(job, "claim", job.until - 1, TERMS) == job
    again = leases.step(job, "claim", job.until, TERMS)
    assert (again.status, again.reclaims) == (leases.RUNNING, 1)
    lost = leases.step(again, "claim", again.until, TERMS)
    assert (lost.status, lost.code) == (leases.FAILED, leases.STALE) and leases.step(lost, "claim", 1 << 60, TERMS) == lost
    job = leases.Job()
    for k in range(3):
        job = leases.step(leases.step(job, "claim", job.until, TERMS), "error", job.until, TERMS)
        assert job.retries == min(k + 1, 2)
    assert job.code == leases.EXHAUSTED
    assert leases.step(leases.Job(), "heartbeat", 1, TERMS) == leases.Job() == leases.step(leases.Job(), "none", 1, TERMS)


def test_caches_over_two_restarts_equal_one_fold(spark, tmp_path):
    made, now, rows = random.Random(32), 1_700_000_000, []
    for i in range(600):
        now += made.choice([1, 5, 40])
        rows.append((made.randrange(3), now, i, made.randrange(9)))
    schema = "cache long, ts timestamp, event_id long, key long"
    for part in range(3):
        timed(spark, rows[part * 200 : (part + 1) * 200], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        caches.run_available(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), 300, 5, f"{tmp_path}/out")
    want = {}
    for cache, at, _, key in rows:
        held, counts = want.setdefault(cache, ({}, caches.Counts()))
        caches.look(held, counts, key, at, 300, 5)
    totals = {r.cache: tuple(r)[1:] for r in caches.totals(spark, f"{tmp_path}/out").collect()}
    assert totals == {k: astuple(v[1]) for k, v in want.items()} and all(min(t) > 0 for t in totals.values())
    folded = folds.ttl_caches(timed(spark, rows, schema), 300, 5)
    assert {r.cache: tuple(r)[1:] for r in folded.collect()} == totals


def test_a_publication_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    versions = spark.createDataFrame([(1,), (2,)], "version int")
    entities = spark.createDataFrame([(1, "bb", "BASIN"), (1, "ab", "BASIN"), (1, "a", "AREA")], "version int, name string, kind string")
    edges = spark.createDataFrame([(1, 7), (3, 8)], "version int, edge int")
    publications.stage(root, versions, {"entities": entities, "edges": edges})
    publications.publish(root, versions.where("version = 1"), {"entities": entities, "edges": edges})
    publications.stage(root, versions, {"entities": entities, "edges": edges})
    seen = publications.headers(spark, root).collect()
    assert [(r.version, r.status, r.entities, r.edges, r.main_subject) for r in seen] == [(1, "COMPLETED", 3, 1, "ab")]
    publications.publish(root, versions, {"entities": entities, "edges": edges.where("edge < 0")})
    publications.publish(root, versions, {"entities": entities, "edges": edges})
    seen = {r.version: (r.entities, r.edges, r.main_subject) for r in publications.headers(spark, root).collect()}
    assert seen == {1: (3, 1, "ab"), 2: (0, 0, None)}
    assert publications.published(spark, root, "entities").count() == 3
    assert [r.edge for r in publications.published(spark, root, "edges").collect()] == [7]


def test_artifacts_are_written_once(spark, tmp_path):
    root = f"{tmp_path}/store"
    rows = spark.createDataFrame([("a", 1, "text"), ("a", 1, "text"), ("a", None, "text"), ("b", 1, "é" * 10_000)], "task string, page int, content string")
    for _ in range(2):
        publications.write_once(rows, ["task", "page"], "content", root)
    assert publications.stored(spark, root).count() == 3
    assert publications.damaged(spark, root, ["task", "page"], "content").count() == 0
    publications.write_once(rows.withColumn("content", F.lit("other")), ["task", "page"], "content", root)
    assert publications.stored(spark, root).count() == 6
    bad = publications.stored(spark, root).withColumn("content", F.lit("bent")).withColumn("shelf", F.lit("zz"))
    bad.write.partitionBy("shelf").mode("overwrite").parquet(f"{tmp_path}/bent")
    assert publications.damaged(spark, f"{tmp_path}/bent", ["task", "page"], "content").count() == 6
    with pytest.raises(ValueError, match="content"):
        publications.write_once(rows.withColumn("content", F.lit(" ")), ["task", "page"], "content", root)


def test_a_job_of_a_batch_is_taken_as_rows_by_time():
    class Handle:
        known, timers = None, []

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.known

        def update(self, known):
            self.known = known

        def registerTimer(self, at):
            self.timers.append(at)

    processor = leases._Leases(TERMS)
    processor.init(Handle())
    rows = [Row(job=5, at=20, event_id=1, action="heartbeat"), Row(job=5, at=10, event_id=3, action="heartbeat"), Row(job=5, at=10, event_id=2, action="claim")]
    (out,) = processor.handleInputRows((5,), iter(rows), None)
    assert isinstance(out, Row) and (out.job, out.status, out.until, out.claims, out.claimable) == (5, "RUNNING", 20 + TERMS.lease, 1, False)
