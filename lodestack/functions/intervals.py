"""Intervals and scalars written as text, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of comparisons, besides < and >.
AT_MOST = ["≤", "<=", r"\le", r"\leq", r"\leqslant"]
AT_LEAST = ["≥", ">=", r"\ge", r"\geq", r"\geqslant"]
LESS, MORE = ["＜"], ["＞"]
_NUMBER = r"-?\d+(?:\.\d+)?"
_NAME = "[A-Za-z_][A-Za-z_0-9]*"
INTERVAL = "struct<variable:string,lower:decimal(38,18),upper:decimal(38,18),lower_inclusive:boolean,upper_inclusive:boolean>"


def _any(spellings: list[str]) -> str:
    """A pattern of the spellings, the longest first, as one may begin with another."""
    return "|".join(r"\s*".join(re.escape(c) for c in x) if x.endswith("=") else re.escape(x) for x in sorted(spellings, key=len, reverse=True))


def _plain(text: Column) -> Column:
    """One sign for each comparison, names out of font commands, no spaces and no dollar signs at the ends."""
    out = text
    for sign, spellings in (("≤", AT_MOST), ("≥", AT_LEAST), ("<", LESS), (">", MORE)):
        out = F.regexp_replace(out, _any(spellings), sign)
    return F.regexp_replace(F.regexp_replace(out, r"\\(?:mathrm|text)\{(\w+)\}", "$1"), r"\s+|^\s*\$+|\$+\s*$", "")


def parse_interval(text: Column) -> Column:
    """struct of variable, bounds and inclusiveness; null for what is no explicit comparison.

    ``a<x<=b``, ``x>a``, ``a>x`` and ``>a`` (no variable) parse. ``a~b``, two lower or two upper bounds, and bounds that do
    not leave a gap are null.
    """
    return F.transform(F.array(_plain(text)), _parsed)[0]  # binds the plain text to a name, so that it is made once


_GRAMMAR = f"^(?:({_NUMBER})([<≤>≥]))?({_NAME})?(?:([<≤>≥])({_NUMBER}))?$"


def _parsed(t: Column) -> Column:
    """An interval is a bound, a name and a bound, each of which may be missing; a name alone is none, and so is a bound before no name."""
    part = lambda i: F.nullif(F.regexp_extract(t, _GRAMMAR, i), F.lit(""))
    before, name, after = part(2), part(3), part(4)
    # what stands before the name bounds it from below when it is the smaller side
    ends = [(before, part(1), before.isin("<", "≤")), (after, part(5), after.isin(">", "≥"))]
    lower = F.coalesce(*[F.when(low, F.struct(number.cast("decimal(38,18)").alias("at"), sign.isin("≤", "≥").alias("closed"))) for sign, number, low in ends])
    upper = F.coalesce(*[F.when(~low, F.struct(number.cast("decimal(38,18)").alias("at"), sign.isin("≤", "≥").alias("closed"))) for sign, number, low in ends])
    two = before.isNotNull() & after.isNotNull()
    good = F.when(two, lower.isNotNull() & upper.isNotNull() & (lower["at"] < upper["at"])).otherwise(before.isNotNull() | after.isNotNull()) & (before.isNull() | name.isNotNull())
    closed = lambda end: F.coalesce(end["closed"], F.lit(False))
    made = F.struct(name.alias("variable"), lower["at"].alias("lower"), upper["at"].alias("upper"), closed(lower).alias("lower_inclusive"), closed(upper).alias("upper_inclusive"))
    return F.when(good, made)


def interval_contains(interval: Column, value: Column) -> Column:
    """Containment with open and closed bounds; false for values that are no finite number, or without an interval."""
    v = value.try_cast("decimal(38,18)")
    lower = interval["lower"].isNull() | (v > interval["lower"]) | (interval["lower_inclusive"] & (v == interval["lower"]))
    upper = interval["upper"].isNull() | (v < interval["upper"]) | (interval["upper_inclusive"] & (v == interval["upper"]))
    return F.coalesce(interval.isNotNull() & v.isNotNull() & lower & upper, F.lit(False))


def scalar_kind(raw: Column) -> Column:
    """blank, interval, percent, number, fraction or text. Numbers with a leading zero stay text."""
    return F.transform(F.array(F.struct(raw.alias("raw"), F.trim(raw).alias("t"), parse_interval(raw).isNotNull().alias("i"))), _kind)[0]


def _kind(x: Column) -> Column:
    t = x["t"]
    numeric = F.regexp_like(t, F.lit(f"^{_NUMBER}[%％]?$")) & ~F.regexp_like(t, F.lit(r"^-?0\d"))
    return (
        F.when(F.coalesce(x["raw"], F.lit("")) == "", "blank")
        .when(x["i"], "interval")
        .when(numeric & F.regexp_like(t, F.lit("[%％]$")), "percent")
        .when(numeric, "number")
        .when(F.regexp_like(t, F.lit(r"^-?\d+ \d+/[1-9]\d*$")), "fraction")
        .otherwise("text")
    )
