"""Operator 1: allow and block rules on hosts and path prefixes, by a sort-merge range join.

A rule is (host, path): it fits the host, all its subdomains, and every path that starts with the rule's. Each url emits
one probe per suffix of its host; probe and rule share the canonical key reversed-host + path, on which a rule is the
interval of keys it prefixes. Keys of one host form a contiguous block, so the key space is swept block by block, in
sorted order. Nested intervals are kept as a stack: the last rule that started carries its enclosing rules, and those that
ended before the probe are popped. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import ascii_lower, partitions

#: Copies of the rules that the salted sweeps may hold between them.
MAX_RULE_COPIES = 50_000_000


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 2)


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _with_stacks(rules: DataFrame) -> DataFrame:
    """(block, path, stack): the rules of one host that enclose each rule, outermost first, itself last."""
    own = rules.select(_reversed(F.split("host", r"\.")).alias("block"), "path", F.concat("host", "path").alias("rule"), "verdict")
    own = own.groupBy("block", "path").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"))
    prefixes = own.select("block", F.col("path").alias("inner"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring(F.col("path"), F.lit(1), i))).alias("path"))
    entry = F.struct(F.length("path").alias("size"), "path", "rule", "verdict")
    return prefixes.join(own, ["block", "path"]).groupBy("block", F.col("inner").alias("path")).agg(F.array_sort(F.collect_list(entry)).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (host and path joined, or null) and verdict.

    ``rules`` has host, path, verdict (allow or block). The longest rule string wins, then the one with the longer host;
    of equal rules with both verdicts, block. A page without a fitting rule gets ``default``. A null url, or one without
    ``://``, has empty host and path, which no rule fits. Rules with a null or an empty host are void, a null path is
    empty. Repeated pages each get their row; other columns are not carried. Empty tables give empty results.

    Equal (host, path) pairs are judged once. The sweep of a host is split over ``splits`` salts of the path, so that one
    host with a third of all urls is many tasks; each salt holds a copy of that host's rules.
    """
    spark = pages.sparkSession
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null")
    about = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("depth")).first()
    splits = max(1, min(partitions(spark), MAX_RULE_COPIES // max(1, about["n"])))

    keyed = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.")
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(about["depth"] or 1)))
    blocks = F.transform(depths, lambda d: _reversed(F.slice(labels, F.size(labels) - d + 1, d)))
    probes = keyed.groupBy("host", "path").agg(F.lit(1).alias("probe")).select("host", F.explode(blocks).alias("block"), "path", "probe", F.pmod(F.xxhash64("path"), F.lit(splits)).alias("salt"))
    starts = _with_stacks(rules).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))))

    sweep = Window.partitionBy("block", "salt").orderBy("path", "is_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = starts.withColumn("is_probe", F.lit(0)).unionByName(probes.withColumn("is_probe", F.lit(1)), allowMissingColumns=True)
    swept = events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("is_probe = 1")
    top = F.try_element_at(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(-1))
    fits = swept.select("host", "path", top.alias("top")).where("top is not null")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("top.rule").alias("size"), (-F.col("top.size")).alias("host_first"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("best"))
    return keyed.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
