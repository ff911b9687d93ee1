"""Rows of a table with missing cells, put under the columns that their cells fit best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import marks as M
from lodestack.functions import numbers as N

#: Rows of a table that are looked at together; what the last complete row was is carried from block to block.
BLOCK = 4096
# Words by which a header tells what its column holds.
HEADER_WORDS = {"material": ["材料", "型号", "类别", "等级", "代号", "名称"], "status": ["状态", "条件", "处理", "工艺", "方式"], "range": ["直径", "尺寸", "厚度", "长度", "宽度", "mm", "公称", "范围"], "ratio": ["系数", "比值", "比例"], "numeric": ["mpa", "能量", "强度", "压力", "数值", "质量", "重量", "硬度", "伸长", "冲击"]}
# Fixed values, in hundredths: what a cell's kind scores in a column, what inherited cells score, what a choice needs.
SEEN, EACH, EACH_MOST, NUMERIC, BLANK, STRANGE, RELATED = 300, 40, 200, 150, -50, -100, 100
RATIO_AMONG_NUMBERS, INTEGER_AMONG_RATIOS, DECIMAL_AMONG_RATIOS = 100, 150, 75
INHERITED, LEAST, MARGIN = 35, 100, 200
NUMBERS = ["numeric", "integer", "decimal", "ratio", "range"]


def cell_kind(c: Column) -> Column:
    return F.when(M.is_unreadable(c) & (F.trim(F.coalesce(c, F.lit(""))) != ""), "unreadable").otherwise(N.cell_category(c))


def header_kind(c: Column) -> Column:
    """As ``cell_kind``, but columns say what they hold by certain words, too."""
    t = F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")))
    said = F.lit(None).cast("string")
    for kind, words in reversed(HEADER_WORDS.items()):
        said = F.when(F.regexp_like(t, F.lit("|".join(words))), kind).otherwise(said)
    plain = cell_kind(c)
    return F.when(plain.isin("blank", "unreadable", "percent", "temperature"), plain).otherwise(F.coalesce(said, plain))


def cell_score(kind: Column, counts: Column) -> Column:
    """How well a cell fits a column, in hundredths; ``counts`` maps the kinds of the column's cells to their numbers."""
    n = lambda k: F.coalesce(F.try_element_at(counts, k), F.lit(0))
    has = lambda *ks: F.greatest(*[n(F.lit(k)) for k in ks], F.lit(0)) > 0
    score = F.when(n(kind) > 0, SEEN + F.least(F.lit(EACH_MOST), n(kind) * EACH)).otherwise(0)
    score += F.when(kind.isin(NUMBERS) & has(*NUMBERS), NUMERIC).otherwise(0)
    score -= F.when((kind == "ratio") & has("integer", "temperature"), RATIO_AMONG_NUMBERS).when((kind == "integer") & has("ratio"), INTEGER_AMONG_RATIOS).when((kind == "decimal") & has("ratio"), DECIMAL_AMONG_RATIOS).otherwise(0)
    score += F.when(kind.isin("material", "model", "text") & has("material", "model"), RELATED).when((kind == "status") & has("status"), RELATED).otherwise(0)
    strange = (score == 0) & (F.size(counts) > 0)
    return F.when(kind == "blank", BLANK).when(kind == "unreadable", 0).when(strange, STRANGE).otherwise(score).cast("int")


def profiles(rows: DataFrame, key: str) -> DataFrame:
    """(key, profile): for each column a map of kinds to numbers, from the header and all complete rows; blanks do not count."""
    kinds = F.when(F.col("row") == 0, F.transform("cells", header_kind)).otherwise(F.transform("cells", cell_kind))
    each = rows.where((F.col("row") == 0) | (F.size("cells") == F.col("width"))).select(key, "width", F.posexplode(kinds).alias("col", "kind")).where("kind <> 'blank'")
    counts = each.groupBy(key, "width", "col", "kind").agg(F.count("*").cast("int").alias("n")).groupBy(key, "width", "col").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("counts"))  # an entry a kind
    by_col = counts.groupBy(key, "width").agg(F.map_from_entries(F.collect_list(F.struct("col", "counts"))).alias("of"))  # an entry a column
    none = F.create_map().cast("map<string,int>")
    return by_col.select(key, F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda j: F.coalesce(F.try_element_at("of", j), none)).alias("profile"))


def carried(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the last ``value`` that is not null before each row, in ``order`` (whole numbers from 0).

    Rows are looked at in blocks; only one value a block is sorted for a whole key, so no key is sorted in one task.
    """
    placed = rows.withColumns({"_value": value, "_block": F.floor(F.col(order) / BLOCK)})
    lasts = placed.where("_value is not null").groupBy(key, "_block").agg(F.max_by("_value", order).alias("_last"))
    blocks = placed.select(key, "_block").distinct().join(lasts, [key, "_block"], "left")
    before = blocks.select(key, "_block", F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    within = F.last("_value", ignorenulls=True).over(Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_within", within).join(before, [key, "_block"]).withColumn(name, F.coalesce("_within", "_carry")).drop("_value", "_block", "_within", "_carry")


def aligned(rows: DataFrame, key: str) -> DataFrame:
    """(key, row, state, skipped, cells, source_row) of rows (key, row from 0, cells array<string>); row 0 is the header.

    A row as wide as the header is ``complete``, a wider one is ``cut``. For a shorter one every way is tried to leave columns
    out at its left and right end; those take the cells of the last complete row before it. The way whose cells fit their
    columns best is taken if it is good enough and far better than the next (``repaired``, with the columns skipped at the
    left and the row inherited from); else, and where no complete row came before, the row is filled up with blanks (``padded``).
    Equal scores count as no margin. Tables without a header row have no rows here.
    """
    heads = rows.where("row = 0").select(key, F.size("cells").alias("width"))
    sized = rows.join(heads, key)
    whole = F.when((F.size("cells") == F.col("width")) & (F.col("row") > 0), F.struct("row", "cells"))
    known = carried(sized, key, "row", whole, "before").join(profiles(sized, key), key, "left")
    n, width = F.size("cells"), F.col("width")
    missing = width - n

    def score(left: Column) -> Column:
        def add(acc: Column, j: Column) -> Column:
            i = j - left
            out = (i < 0) | (i >= n)
            inherited = F.when(F.get(F.col("before.cells"), j) != "", INHERITED).otherwise(0)
            return acc + F.when(out, inherited).otherwise(cell_score(F.get(F.col("kinds"), i), F.get(F.col("profile"), j)))

        return F.aggregate(F.sequence(F.lit(0), width - 1), F.lit(0), add)

    short = (missing > 0) & (F.col("row") > 0) & F.col("before").isNotNull()
    ways = F.when(short, F.array_sort(F.transform(F.sequence(F.lit(0), missing), lambda left: F.struct((-score(left)).alias("loss"), left.alias("left")))))
    tried = known.withColumn("kinds", F.when(missing > 0, F.transform("cells", cell_kind))).withColumn("ways", ways)
    best, second = F.get("ways", F.lit(0)), F.get("ways", F.lit(1))
    fits = F.coalesce((-best["loss"] >= LEAST) & (second["loss"] - best["loss"] >= MARGIN), F.lit(False))
    state = F.when(missing == 0, "complete").when(missing < 0, "cut").when(fits, "repaired").otherwise("padded")
    left = best["left"]
    restored = F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.when((j < left) | (j >= left + n), F.get(F.col("before.cells"), j)).otherwise(F.get("cells", j - left)))
    cells = F.when(missing <= 0, F.slice("cells", F.lit(1), width)).when(F.col("state") == "repaired", restored).otherwise(F.concat("cells", F.array_repeat(F.lit(""), missing)))
    done = tried.withColumn("state", state)
    mended = F.col("state") == "repaired"
    return done.select(key, "row", "state", F.when(mended, left).alias("skipped"), cells.alias("cells"), F.when(mended, F.col("before.row")).alias("source_row"))
