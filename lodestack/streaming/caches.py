"""Caches with a time to live as keyed state: bounded entries, the one written first goes when a cache is full."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestack.streaming.leases import PROVIDER

COUNTS = "hits long, misses long, evictions long"


@dataclass
class Counts:
    hits: int = 0
    misses: int = 0
    evictions: int = 0


def look(held: dict[int, int], counts: Counts, key: int, now: int, ttl: int, size: int) -> None:
    """One request: a hit if the key was written at most ``ttl`` ago; else it is written now, and the oldest entry goes if there
    is no room. Entries that have run out stay until they are written again or go."""
    if key in held and now - held[key] <= ttl:
        counts.hits += 1
        return
    counts.misses += 1
    if key not in held and len(held) >= size:
        del held[min(held, key=held.get)]
        counts.evictions += 1
    held[key] = now


class _Caches(StatefulProcessor):
    def __init__(self, ttl: int, size: int):
        self.ttl, self.size = ttl, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key long", "at long")
        self.counts = handle.getValueState("counts", COUNTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.entries.iterator()}  # ``size`` at most
        held, known = dict(before), self.counts.get()
        counts = Counts(*known) if known else Counts()
        new = pd.concat(list(rows)).sort_values(["at", "event_id"])  # of one micro-batch
        for wanted, now in zip(new["key"], new["at"], strict=True):
            look(held, counts, int(wanted), int(now), self.ttl, self.size)
        for k in before.keys() - held.keys():
            self.entries.removeKey((k,))
        for k in held:
            if before.get(k) != held[k]:
                self.entries.updateValue((k,), (held[k],))
        self.counts.update(tuple(asdict(counts).values()))
        yield pd.DataFrame([{"cache": key[0], **asdict(counts)}])

    def close(self) -> None:
        return


def cache_updates(requests: DataFrame, ttl_seconds: int, size: int) -> DataFrame:
    """(cache, COUNTS) after each micro-batch of (cache long, ts timestamp, event_id long, key long). Needs the state store PROVIDER."""
    timed = requests.select("cache", "event_id", "key", F.unix_micros("ts").alias("at"))
    return timed.groupBy("cache").transformWithStateInPandas(_Caches(ttl_seconds * 1_000_000, size), f"cache long, {COUNTS}", "Update", "None")


def run_available(requests: DataFrame, ttl_seconds: int, size: int, folder: str) -> None:
    """As ``leases.run_available``."""
    spark = requests.sparkSession
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        write = lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch}")
        cache_updates(requests, ttl_seconds, size).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def totals(spark, folder: str) -> DataFrame:
    """(cache, COUNTS): the last counts of each cache."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    last = spark.read.parquet(f"{folder}/counts").groupBy("cache").agg(F.max_by(F.struct(*names), "batch").alias("c"))
    return last.select("cache", "c.*")
