"""Names, labels, formulas and payloads written as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.spans import balanced_object


def role_code(c: Column) -> Column:
    """Upper case, runs of anything but letters and digits one underscore, none at the ends; ``ROLE`` if nothing is left."""
    code = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "_"), "^_|_$", "")
    return F.when(code == "", "ROLE").otherwise(code)


def chart_label(c: Column) -> Column:
    """One line for a chart's node: double quotes become single ones, white space one space."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit('"'), F.lit("'")), r"\s+", " "))


def lookup_key(c: Column) -> Column:
    """Trimmed and lower case; null is empty."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def is_number_only(c: Column) -> Column:
    """Whether there are digits, and nothing else but the signs that numbers come with."""
    return F.regexp_like(c, F.lit("[0-9]")) & F.regexp_like(c, F.lit(r"^[0-9 .,;:%()+-]+$"))


def table_number(c: Column) -> Column:
    """The number of the one table that a text names; null if it names none or several."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"Table ([0-9]+(?:[.-][0-9]+)*)"), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def formulas(c: Column) -> Column:
    """Bodies of display formulas: those between double dollars, then those between bracket commands."""
    return F.concat(F.regexp_extract_all(c, F.lit(r"\$\$([^$]+)\$\$"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"\\\[(.+?)\\\]"), F.lit(1)))


_TAG, _NUMBERED = r"\\tag\{([^{}]+)\}\s*$", r"[^\s=+*/-]\s*\(([0-9.]+)\)\s*$"


def formula_label(c: Column) -> Column:
    """The number at the end of a formula, in a tag, or in brackets that no operator stands before; null if there is none."""
    tag, number = F.regexp_extract(c, _TAG, 1), F.regexp_extract(c, _NUMBERED, 1)
    return F.nullif(F.when(tag != "", tag).otherwise(number), F.lit(""))


def formula_key(c: Column) -> Column:
    """A formula without its label and without white space: equal for equal formulas."""
    bare = F.when(F.regexp_like(c, F.lit(_TAG)), F.regexp_replace(c, _TAG, "")).when(formula_label(c).isNotNull(), F.regexp_replace(c, r"\([0-9.]+\)\s*$", "")).otherwise(c)
    return F.regexp_replace(bare, r"\s+", "")


def json_payload(c: Column) -> Column:
    """The JSON object in a text: all of it, what a fence holds, or from the first brace to the one that closes it; null if none parses."""
    whole = F.trim(c)
    fenced = F.trim(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1))
    first = balanced_object(c)
    good = lambda x: F.when(F.startswith(x, F.lit("{")) & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(good(whole), good(fenced), good(first))


def flat_params(*maps: Column) -> Column:
    """One map of several, the later ones first; keys in order of the first map that has them."""
    keys = F.array_distinct(F.concat(*[F.map_keys(m) for m in maps]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(*[F.try_element_at(m, k) for m in reversed(maps)])))


def has_identifier(text: Column, identifier: Column) -> Column:
    """Whether a text holds an identifier that is no part of a longer one."""
    at = F.concat(F.lit(r"(^|[^A-Za-z0-9_#])\Q"), identifier, F.lit(r"\E($|[^A-Za-z0-9_#])"))
    return F.regexp_like(text, at)
