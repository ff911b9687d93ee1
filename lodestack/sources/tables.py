"""Sources and sinks beyond Spark's own: complete paged reads, upserts, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(pages: DataFrame, id_col: str, total_col: str) -> DataFrame:
    """The distinct rows of a paged read; fails unless all pages say one total and that many ids came."""
    seen = pages.agg(F.countDistinct(id_col).alias("n"), F.min(total_col).alias("lo"), F.max(total_col).alias("hi")).first()
    if seen["lo"] is None or seen["lo"] != seen["hi"] or seen["lo"] < 0 or seen["n"] != seen["hi"]:
        raise ValueError(f"incomplete read: {seen['n']} ids of {seen['lo']} to {seen['hi']}")
    return pages.dropDuplicates([id_col])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both by key; the newest of ``new`` by ``order`` replaces an old one."""
    from lodestack.operators.lookup import latest

    fresh = latest(new, keys, order).select(*old.columns)
    return old.join(fresh, keys, "left_anti").select(*old.columns).unionByName(fresh)


def update(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Sets exactly the supplied fields, nulls included: ``changes`` holds a map ``fields`` of strings by column name."""
    joined = old.join(changes, keys, "left")
    named = lambda c: F.coalesce(F.map_contains_key("fields", c), F.lit(False))
    return joined.select(*[F.col(c) if c in keys else F.when(named(c), F.try_element_at("fields", F.lit(c)).cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in old.columns])


def delete(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids, keys, "left_anti")


def delimited(cells: Column, delimiter: str = ",") -> Column:
    """One row of a delimited export; quotes only for commas, quotes and line breaks, only with a comma."""
    quoted = lambda c: F.when(F.regexp_like(c, F.lit('[,"\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, quoted) if delimiter == "," else cells, delimiter)


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
