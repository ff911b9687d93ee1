"""Jobs under leases as keyed state: the same transitions on streams, with timers, and on what a stream has left behind.

A job is queued, claimed for the time of a lease, kept by heartbeats, and completed, retried or failed. A job whose lease has run
out may be claimed once more; the next time it fails. What is kept of a job is one small row, however long its history is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

QUEUED, RUNNING, COMPLETED, FAILED = "QUEUED", "RUNNING", "COMPLETED", "FAILED"
STALE, EXHAUSTED = "STALE_LEASE_EXHAUSTED", "TRANSIENT_RETRIES_EXHAUSTED"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Terms:
    """Of a lease: its length, reclaims and retries that are allowed, and the wait before a retry; times in microseconds."""

    lease: int
    wait: int
    reclaims: int = 1
    retries: int = 3


@dataclass
class Job:
    status: str = QUEUED
    until: int = 0  # of the lease, while running; the next attempt, while queued
    claims: int = 0
    reclaims: int = 0
    retries: int = 0
    code: str = ""


STATE = "status string, until long, claims long, reclaims long, retries long, code string"


def step(job: Job, action: str, now: int, terms: Terms) -> Job:
    """The job after an event; what does not fit its status changes nothing. A bound that is reached exactly has run out."""
    if action == "claim" and job.until <= now:
        if job.status == QUEUED:
            return Job(RUNNING, now + terms.lease, job.claims + 1, job.reclaims, job.retries, "")
        if job.status == RUNNING and job.reclaims < terms.reclaims:
            return Job(RUNNING, now + terms.lease, job.claims + 1, job.reclaims + 1, job.retries, "")
        if job.status == RUNNING:
            return Job(FAILED, 0, job.claims, job.reclaims, job.retries, STALE)
    if job.status != RUNNING:
        return job
    if action == "heartbeat":
        return Job(RUNNING, now + terms.lease, job.claims, job.reclaims, job.retries, "")
    if action == "complete":
        return Job(COMPLETED, 0, job.claims, job.reclaims, job.retries, "")
    if action == "error" and job.retries < terms.retries:
        return Job(QUEUED, now + terms.wait, job.claims, job.reclaims, job.retries + 1, "")
    if action == "error":
        return Job(FAILED, 0, job.claims, job.reclaims, job.retries, EXHAUSTED)
    return job


class _Leases(StatefulProcessor):
    def __init__(self, terms: Terms):
        self.terms = terms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.get()
        job = Job(*known) if known else Job()
        before = job.until
        for new in sorted(rows, key=lambda r: (r["at"], r["event_id"] is None, r["event_id"] or 0)):  # of one micro-batch
            job = step(job, new["action"], new["at"], self.terms)
        self.state.update(tuple(asdict(job).values()))
        if before != job.until:
            if before:
                self.handle.deleteTimer(before // 1000)
            if job.until:
                self.handle.registerTimer(job.until // 1000)
        yield self._row(key, job, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A lease that has run out, or a wait that is over: the job can be claimed."""
        known = self.state.get()
        if known:
            yield self._row(key, Job(*known), True)

    def close(self) -> None:
        return

    @staticmethod
    def _row(key, job: Job, claimable: bool) -> Row:
        return Row(job=key[0], **asdict(job), claimable=claimable)


def lease_updates(events: DataFrame, terms: Terms, delay: str = "1 minute") -> DataFrame:
    """(job, STATE, claimable) of a stream of (job long, ts timestamp, event_id long, action string).

    A row for each job of a micro-batch with its state after it, and one, claimable, when the watermark passes the end of a
    lease or of a wait. Events that are later than ``delay`` are dropped by the watermark. Needs the state store PROVIDER.
    """
    timed = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    return timed.groupBy("job").transformWithState(_Leases(terms), f"job long, {STATE}, claimable boolean", "Update", "EventTime")


def run_available(events: DataFrame, terms: Terms, folder: str, delay: str = "1 minute") -> None:
    """Takes what is there of a stream into the table of states in ``folder`` and ends; called again, it goes on from there.

    Each micro-batch is a folder of its own, which a repeated batch overwrites, so that no state is written twice.
    """
    spark = events.sparkSession
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        write = lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/states/batch={batch}")
        lease_updates(events, terms, delay).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def states(spark, folder: str) -> DataFrame:
    """(job, STATE): the last state of each job."""
    updates = spark.read.parquet(f"{folder}/states").where("not claimable")
    return updates.groupBy("job").agg(F.max_by(F.struct(*[c.split()[0] for c in STATE.split(", ")]), "batch").alias("s")).select("job", "s.*")
