"""Who carries out a task: configurations checked against what there is, and patterns suggested by words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns with the keys that each needs, and what a group, a type or an automation may be.
PATTERNS = ["static", "form_driven", "dynamic", "queue_claim", "automation"]
STATIC_TYPES, GROUPS, AUTOMATIONS = ["role", "department", "member"], ["role", "department"], ["mcp_tool", "virtual_member"]
# Words that suggest a pattern, and how sure that is.
SUGGESTIONS = [
    ("form_driven", 0.8, ["select", "choose", "user", "decide"]),
    ("dynamic", 0.85, ["route", "based on", "if", "condition"]),
    ("queue_claim", 0.75, ["team", "any", "available", "first"]),
    ("automation", 0.7, ["automatic", "check", "validate", "compute"]),
    ("static", 0.5, []),
]


def _needs(config: Column, pattern: Column) -> Column:
    """struct(problem, kind, name): what a configuration asks to be there; or why it asks for nothing, ``valid`` if nothing is needed."""
    value = lambda k: F.nullif(F.try_element_at(config, F.lit(k)), F.lit(""))
    ask = lambda kind, name: F.struct(F.lit(None).cast("string").alias("problem"), kind.alias("kind"), name.alias("name"))
    say = lambda problem: F.struct(F.lit(problem).alias("problem"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"))

    def given(*keys: str):
        missing = F.lit(None).cast("string")
        for k in reversed(keys):
            missing = F.when(value(k).isNull(), f"missing_{k}").otherwise(missing)
        return missing

    def when_given(keys: list[str], then: Column) -> Column:
        lacks = given(*keys)
        return F.when(lacks.isNotNull(), F.struct(lacks.alias("problem"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"))).otherwise(then)

    static = when_given(["type", "value"], F.when(value("type").isin(STATIC_TYPES), ask(value("type"), value("value"))).otherwise(say("unknown_type")))
    queue = when_given(["claim_group", "group_name"], F.when(value("claim_group").isin(GROUPS), ask(value("claim_group"), value("group_name"))).otherwise(say("unknown_claim_group")))
    tool = when_given(["mcp_tool_name"], ask(F.lit("tool"), value("mcp_tool_name")))
    virtual = when_given(["virtual_member_name"], say("valid"))
    automation = when_given(["automation_type"], F.when(value("automation_type") == AUTOMATIONS[0], tool).when(value("automation_type") == AUTOMATIONS[1], virtual).otherwise(say("unknown_automation_type")))
    rules = dict(zip(PATTERNS, [static, when_given(["form_field"], ask(F.lit("form_field"), value("form_field"))), when_given(["mcp_tool"], ask(F.lit("tool"), value("mcp_tool"))), queue, automation], strict=True))
    return reduce(lambda other, p: F.when(pattern == p, rules[p]).otherwise(other), reversed(PATTERNS), say("unknown_pattern"))


def checked(tasks: DataFrame, there: DataFrame, scope: str) -> DataFrame:
    """``tasks`` (scope, pattern, config map<string,string> and others) with ``verdict``.

    ``valid``; or why not: unknown_pattern, missing_<key> (the first), unknown_type, unknown_claim_group, unknown_automation_type,
    none_given if the scope has nothing of the kind that is asked for, not_found if it has others. ``there`` has (scope, kind, name), a member
    under id and name; repeated rows are no matter. Nulls and empty values count as missing.
    """
    asked = tasks.withColumn("_need", _needs(F.col("config"), F.coalesce("pattern", F.lit(""))))
    names = there.select(F.col(scope).alias("_scope"), F.col("kind").alias("_kind"), F.col("name").alias("_name")).where("_name is not null").distinct()
    kinds = names.select(F.col("_scope").alias("_in"), F.col("_kind").alias("_of")).distinct()
    met = asked.join(names, (F.col(scope) == F.col("_scope")) & (F.col("_need.kind") == F.col("_kind")) & (F.col("_need.name") == F.col("_name")), "left")
    met = met.join(kinds, (F.col(scope) == F.col("_in")) & (F.col("_need.kind") == F.col("_of")), "left")
    verdict = F.when(F.col("_need.problem").isNotNull(), F.col("_need.problem")).when(F.col("_name").isNotNull(), "valid").when(F.col("_of").isNotNull(), "not_found").otherwise("none_given")
    return met.withColumn("verdict", verdict).drop("_need", "_scope", "_kind", "_name", "_in", "_of")


def suggested(description: Column) -> Column:
    """array of (pattern, confidence): those of which a word is in the description, in the order of SUGGESTIONS; the last one always."""
    low = F.lower(F.coalesce(description, F.lit("")))
    holds = lambda words: reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words]) if words else F.lit(True)
    return F.array_compact(F.array(*[F.when(holds(words), F.struct(F.lit(p).alias("pattern"), F.lit(c).alias("confidence"))) for p, c, words in SUGGESTIONS]))
