"""Numbers and boxes written in many ways, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of materials and of states in table cells.
MATERIALS = ["steel", "copper", "nickel", "brass", "tin"]
STATES = ["anodized", "burnished", "plated", "polished", "brushed"]


def parse_number(c: Column) -> Column:
    """A number behind an optional comparator, with a decimal comma or point; null for anything else."""
    t = F.regexp_replace(F.trim(c), r"^[<>≤≥=~]+\s*", "")
    return F.replace(t, F.lit(","), F.lit(".")).try_cast("double")


def cell_category(c: Column) -> Column:
    """blank, percent, temperature, range, ratio, integer, decimal, model, material, status or text; the first rule that holds."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    like = lambda p: F.regexp_like(t, F.lit(p))
    return (
        F.when(t == "", "blank").when(like(r"^-?[0-9]+([.,][0-9]+)?\s*%$"), "percent").when(like(r"^-?[0-9]+([.,][0-9]+)?\s*°\s*[cf]$"), "temperature").when(like(r"^-?[0-9]+([.,][0-9]+)?\s*[~-]\s*[0-9]+([.,][0-9]+)?$"), "range")
        .when(like(r"^[0-9]+\s*[:/]\s*[0-9]+$"), "ratio").when(like(r"^-?[0-9]+$"), "integer").when(like(r"^-?[0-9]+[.,][0-9]+$"), "decimal").when(like(r"^[a-z]+#[0-9]+$"), "model")
        .when(like(rf"\b({'|'.join(MATERIALS)})\b"), "material").when(like(rf"\b({'|'.join(STATES)})\b"), "status").otherwise("text")
    )


def retry_delay(attempt: Column, cap: int = 60) -> Column:
    """Seconds before the next attempt: doubled each time, up to ``cap``."""
    return F.least(F.lit(cap), F.pow(F.lit(2.0), attempt - 1)).cast("long")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def normalised_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Corners as shares of the page, 6 places; kept as they are if all lie within 0 and 1; null unless ordered and inside."""
    unit = (x0 <= 1) & (y0 <= 1) & (x1 <= 1) & (y1 <= 1)
    part = lambda v, size: F.round(F.when(unit, v).otherwise(v / size), 6)
    a, b, c, d = part(x0, width), part(y0, height), part(x1, width), part(y1, height)
    return F.when((a >= 0) & (b >= 0) & (c <= 1) & (d <= 1) & (a < c) & (b < d), F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of box a that box b covers."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h / ((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]))
