"""Sequential state machines over ordered events, a key at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def lease_states(events: list[tuple[pd.Timestamp, str]], lease: pd.Timedelta) -> tuple[str, int, int]:
    """(status, claims, reclaims): a claim by an event when queued or after its lease ran out (at or before now); one
    reclaim is allowed, the next one exhausts the job. ``view`` is a heartbeat, ``purchase`` completes, ``error`` fails
    the attempt and queues again."""
    status, until, claims, reclaims = "QUEUED", None, 0, 0
    for now, action in events:
        if status in ("COMPLETED", "EXHAUSTED"):
            break
        if status == "RUNNING" and until <= now:
            if reclaims:
                status = "EXHAUSTED"
                continue
            reclaims, until = 1, now + lease
        elif status == "QUEUED":
            status, claims, until = "RUNNING", claims + 1, now + lease
        elif action == "view":
            until = now + lease
        elif action == "purchase":
            status = "COMPLETED"
        elif action == "error":
            status = "QUEUED"
    return status, claims, reclaims


def leases(events: DataFrame, minutes: int) -> DataFrame:
    """(job, ts, event_id, action) to the final state of each job. A job's own events are one group."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        status, claims, reclaims = lease_states(list(zip(pdf["ts"], pdf["action"], strict=True)), pd.Timedelta(minutes=minutes))
        return pd.DataFrame({"job": pdf["job"].iloc[:1], "status": [status], "claims": [claims], "reclaims": [reclaims]})

    return events.groupBy("job").applyInPandas(fold, "job long, status string, claims long, reclaims long")


def cache_counts(events: list[tuple[pd.Timestamp, int]], ttl: pd.Timedelta, size: int) -> tuple[int, int, int]:
    """(hits, misses, evictions): the entry written first goes when the cache is full; expired ones stay until rewritten."""
    held: dict[int, pd.Timestamp] = {}
    hits = misses = gone = 0
    for now, key in events:
        if key in held and now - held[key] <= ttl:
            hits += 1
            continue
        misses += 1
        if key not in held and len(held) >= size:
            del held[min(held, key=held.get)]
            gone += 1
        held[key] = now
    return hits, misses, gone


def ttl_caches(events: DataFrame, seconds: int, size: int) -> DataFrame:
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        hits, misses, gone = cache_counts(list(zip(pdf["ts"], pdf["key"], strict=True)), pd.Timedelta(seconds=seconds), size)
        return pd.DataFrame({"cache": pdf["cache"].iloc[:1], "hits": [hits], "misses": [misses], "evictions": [gone]})

    return events.groupBy("cache").applyInPandas(fold, "cache long, hits long, misses long, evictions long")
