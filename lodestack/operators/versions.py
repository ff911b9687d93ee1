"""Versions of published records: the latest, stale ones, conflicts, and recovery of lost references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_completed(versions: DataFrame, key: str, version: str, at: Column, completed: Column) -> DataFrame:
    """The completed version of each key that was published last, ties to the greater id; uncompleted ones are invisible."""
    return versions.where(completed).groupBy(key).agg(F.max(F.struct(at.alias("at"), F.col(version))).alias("v")).select(key, F.col(f"v.{version}").alias(version), "v.at")


def conflicts(records: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that were published with more than one value, nulls counting as a value."""
    value = F.struct(*values)
    return records.groupBy(*keys).agg(F.count("*").alias("records"), F.min(value).alias("lo"), F.max(value).alias("hi")).where(~F.col("lo").eqNullSafe(F.col("hi"))).select(*keys, "records")


def matched(payloads: DataFrame, entries: DataFrame, payload_id: str, entry_id: str, tiers: list[tuple[list[str], Column | None]]) -> DataFrame:
    """(payload, entry, tier): the first tier of equal columns that gives a payload an entry; each entry is used once.

    Tiers run in order, on what the ones before have left of both sides. Within a tier and key the payloads, by id, take the
    entries, by id, one each, so as many match as the smaller side has. With a condition on the pair, a key gives one match at most.
    """
    out = None
    for n, (columns, also) in enumerate(tiers, 1):
        left, right = payloads.select(payload_id, *columns), entries.select(entry_id, *columns)
        if also is None:
            at = lambda i: F.row_number().over(Window.partitionBy(*columns).orderBy(i))  # noqa: B023, E731
            first = left.withColumn("_at", at(payload_id)).join(right.withColumn("_at", at(entry_id)), [*columns, "_at"])
        else:
            first = left.join(right, columns).where(also).groupBy(payload_id).agg(F.min(entry_id).alias(entry_id)).groupBy(entry_id).agg(F.min(payload_id).alias(payload_id))
        hit = first.select(payload_id, entry_id, F.lit(n).alias("tier"))
        out = hit if out is None else out.unionByName(hit)
        payloads, entries = payloads.join(hit, payload_id, "left_anti"), entries.join(hit, entry_id, "left_anti")
    return out


def merged_header(upper: Column, lower: Column) -> Column:
    """Two header rows as one: blank upper cells take the one before, equal or blank lower ones add nothing."""
    carried = F.aggregate(upper, F.array().cast("array<string>"), lambda acc, c: F.array_append(acc, F.when(F.trim(c) != "", F.trim(c)).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")))))
    return F.zip_with(carried, lower, lambda a, b: F.when((F.trim(b) == "") | (F.trim(b) == a), a).when(a == "", F.trim(b)).otherwise(F.concat(a, F.lit(" "), F.trim(b))))


def filled(cells: Column) -> Column:
    """Blank cells take the value before them, leading ones the first value after."""
    first = F.coalesce(F.try_element_at(F.filter(cells, lambda c: F.trim(c) != ""), F.lit(1)), F.lit(""))
    step = lambda acc, c: F.array_append(acc, F.when(F.trim(c) != "", c).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), first)))
    return F.aggregate(cells, F.array().cast("array<string>"), step)


def schema_fields(schema: Column) -> Column:
    """The properties of a JSON schema text as rows: name, type, title, whether required; keys in order of the text."""
    parsed = F.from_json(schema, "properties map<string,struct<type:string,title:string>>, required array<string>")
    return F.transform(F.map_entries(parsed["properties"]), lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"]["type"], F.lit("string")).alias("type"), F.coalesce(e["value"]["title"], e["key"]).alias("title"), F.coalesce(F.array_contains(parsed["required"], e["key"]), F.lit(False)).alias("required")))
