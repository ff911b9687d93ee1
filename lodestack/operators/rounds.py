"""Tables that jobs of several rounds leave behind, so that a round's plan does not hold those before it."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, as in tests, a temporary one. A cluster has to set it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = Path(tempfile.mkdtemp(prefix="lodestack-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Rows of a task where rows of a group are sorted: some ten of MB for each of its sorts, at any size of the input.
TASK_ROWS = 250_000


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by its key to as many tasks as Spark shuffles to, or more, so that none gets more than about TASK_ROWS of ``rows``.

    For small files with much work on each row, which are read in one task, and for sorts within groups. AQE keeps the number.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-(rows or 0) // TASK_ROWS)), key)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again: a lost executor costs one round."""
    path = f"{folder(df.sparkSession)}/lodestack/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
