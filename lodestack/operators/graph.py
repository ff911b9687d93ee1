"""Versioned property graphs in tables: neighbourhoods and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.lookup import few


def one_hop(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Edges at a node with this name or alias, case folded, in either direction, with both ends' names."""
    said = name.lower()
    hit = nodes.where((F.lower("name") == said) | F.exists("aliases", lambda a: F.lower(a) == said)).select("key")
    at = edges.join(hit, (F.col("key") == F.col("source")) | (F.col("key") == F.col("target")), "left_semi")
    ends = lambda c: nodes.select(F.col("key").alias(c), F.col("name").alias(f"{c}_name"), F.col("kind").alias(f"{c}_kind"))
    return at.join(ends("source"), "source").join(ends("target"), "target")


def violations(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(code, subject): nodes that share a key, edges without an end, edges whose kinds no rule allows."""
    twice = nodes.groupBy("key").count().where("count > 1").select(F.lit("duplicate_node").alias("code"), F.col("key").alias("subject"))
    kinds = nodes.groupBy("key").agg(F.max("kind").alias("kind"))
    s = kinds.select(F.col("key").alias("source"), F.col("kind").alias("source_kind"))
    t = kinds.select(F.col("key").alias("target"), F.col("kind").alias("target_kind"))
    ends = edges.join(s, "source", "left").join(t, "target", "left")
    lost = ends.where("source_kind is null or target_kind is null").select(F.lit("missing_end").alias("code"), F.col("edge").alias("subject"))
    wrong = ends.where("source_kind is not null and target_kind is not null").join(few(rules), ["relation", "source_kind", "target_kind"], "left_anti")
    return twice.unionByName(lost).unionByName(wrong.select(F.lit("kind_not_allowed").alias("code"), F.col("edge").alias("subject")))


def attached(subjects: DataFrame, evidence: DataFrame, key: str, id_col: str) -> DataFrame:
    """``subjects`` with the ids of their evidence as rows: ``id_col``, its ``place`` (from 1) and ``n_evidence``, the number of them all.

    A subject without evidence has one row with a null id, place 1 and number 0. Ids that repeat are attached as often. No list is built, so a
    subject may have any number. Subjects with a null key have no evidence.
    """
    counts = evidence.groupBy(key).agg(F.count(id_col).alias("n_evidence"))
    joined = subjects.join(counts, key, "left").join(evidence.where(F.col(id_col).isNotNull()), key, "left")
    place = F.row_number().over(Window.partitionBy(*subjects.columns).orderBy(id_col)).cast("long")
    return joined.select(*subjects.columns, id_col, F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"), place.alias("place"))
