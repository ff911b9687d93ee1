"""Tables that are written once, and versions of several tables that become visible whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMPLETED = "COMPLETED"
# Fixed value: the kind of entity that a version is named after.
MAIN_KIND = "BASIN"


def _read(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame | None:
    """A table, or None if nothing was written there yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


# ---- contents under ids made of what they are ----


def artifact_id(identity: list[str], content: str) -> Column:
    """SHA-256 of the identity's columns and the content's hash, as JSON with sorted keys; nulls are left out."""
    fields = {c: F.col(c) for c in identity} | {"content_sha256": F.sha2(F.col(content).cast("binary"), 256)}
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])).cast("binary"), 256)


def write_once(rows: DataFrame, identity: list[str], content: str, root: str) -> None:
    """Adds the rows that are not stored yet, each once: a batch that is written again, wholly or in part, adds nothing.

    Rows without content are refused with ValueError. ``root`` is a Parquet table by the first two digits of the id; only ids are read of
    it, and only of the digits that the batch has.
    """
    made = rows.withColumn("artifact_id", artifact_id(identity, content)).dropDuplicates(["artifact_id"]).withColumn("shelf", F.substring("artifact_id", 1, 2))
    if not rows.where(F.col(content).isNull() | (F.trim(F.col(content)) == "")).isEmpty():
        raise ValueError("artifacts need a content")
    old = _read(rows.sparkSession, root, StructType(made.schema.fields))
    if old is not None:
        made = made.join(old.select("shelf", "artifact_id"), ["shelf", "artifact_id"], "left_anti")
    made.write.mode("append").partitionBy("shelf").parquet(root)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The artifacts, each once even if two writers have stored it at the same time."""
    return spark.read.option("basePath", root).parquet(root).drop("shelf").dropDuplicates(["artifact_id"])


def damaged(spark: SparkSession, root: str, identity: list[str], content: str) -> DataFrame:
    """Artifacts whose id is not that of what is stored under it."""
    return stored(spark, root).where(F.col("artifact_id") != artifact_id(identity, content))


# ---- versions ----


def headers(spark: SparkSession, root: str) -> DataFrame:
    """One header a version: status, attempt, rows of each table, main_subject. Of two that were published at once the smaller attempt counts."""
    found = spark.read.parquet(f"{root}/headers")
    rest = [c for c in found.columns if c != "version"]
    return found.groupBy("version").agg(F.min_by(F.struct(*rest), "attempt").alias("h")).select("version", "h.*")


def stage(root: str, versions: DataFrame, tables: dict[str, DataFrame]) -> str:
    """Writes the rows of the versions' tables under a new attempt, which no reader sees; returns the attempt."""
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.join(versions, "version", "left_semi").write.partitionBy("version").parquet(f"{root}/{name}/attempt={attempt}")
    return attempt


def publish(root: str, versions: DataFrame, tables: dict[str, DataFrame], main: str | None = "entities") -> None:
    """Publishes the versions (column version) that are not published yet, with their rows of all tables (column version each).

    Rows are staged under an attempt of their own; headers, which name the attempt, are written last and in one commit, so a
    publication that breaks off leaves nothing that can be seen, and one that is repeated (as in foreachBatch) changes
    nothing. A version without rows is a version. The table ``main`` (with name and kind) gives main_subject: of its names of
    MAIN_KIND the shortest, of those the least; null if there is none.
    """
    spark = versions.sparkSession
    versions = versions.select("version").distinct()
    done = _read(spark, f"{root}/headers")
    if done is not None:
        versions = versions.join(done.select("version"), "version", "left_anti")
    if versions.isEmpty():
        return
    attempt = stage(root, versions, tables)
    header = versions
    for name, rows in tables.items():
        staged = spark.read.option("basePath", f"{root}/{name}/attempt={attempt}").schema(rows.schema).parquet(f"{root}/{name}/attempt={attempt}")
        more = [F.min_by("name", F.when(F.col("kind") == MAIN_KIND, F.struct(F.length("name"), "name"))).alias("main_subject")] if name == main else []
        header = header.join(staged.groupBy("version").agg(F.count("*").alias(name), *more), "version", "left")
    header.fillna(0, list(tables)).withColumns({"attempt": F.lit(attempt), "status": F.lit(COMPLETED)}).coalesce(1).write.mode("append").parquet(f"{root}/headers")


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a table of all published versions; staged ones are not among them."""
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    return rows.join(headers(spark, root).select("version", "attempt"), ["version", "attempt"], "left_semi").drop("attempt")
