"""Tables as records: the cells of an HTML table, its projection by the run of header rows, and what speaks against it.

Cells come from one parse of each table. All rules after that are joins and groups over a long table of cells, so that large
numbers of tables, and tables of very different sizes, are handled alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.intervals import scalar_kind
from lodestack.functions.labels import formula_label
from lodestack.functions.spans import math_spans
from lodestack.operators.rounds import spread
from lodestack.operators.tables import MAX_CELLS, MAX_CHARS, MAX_SPAN, ROWS

# Words that make a table's values depend on something that its cells do not say.
CONDITIONAL = r"(?i)\b(if|except|unless|only|note|see|interpolat\w*)\b|仅|除外|条件|插值|注[:：]|续表"
# Fixed value: a comparison or a span in a cell that is no interval.
LOOSE_CONDITION = r"[<>≤≥~～]\s*-?\d|\d\s*[~～]"

CELLS = "kind string, ref string, row int, col int, down int, across int, head boolean, foot boolean, text string"


class _Table(HTMLParser):
    """Cells of a single table, each at the first column that is free in its row; and its captions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.row, self.group, self.cells, self.captions, self.into = -1, "", [], [], None

    def handle_starttag(self, tag, attrs):
        said = dict(attrs)
        if tag in ("thead", "tbody", "tfoot"):
            self.group = tag
        elif tag == "tr":
            self.row += 1
        elif tag in ("td", "th"):
            down, across = (int(v) if (v := said.get(k) or "").isdigit() and int(v) else 1 for k in ("rowspan", "colspan"))
            self.into = {"row": max(self.row, 0), "down": down, "across": across, "head": tag == "th" or self.group == "thead", "foot": self.group == "tfoot", "text": ""}
            self.cells.append(self.into)
        elif tag == "caption":
            self.into = {"text": ""}
            self.captions.append(self.into)
        elif tag == "br" and self.into is not None:
            self.into["text"] += "\n"

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "caption", "table"):
            self.into = None
        if tag in ("thead", "tbody", "tfoot"):
            self.group = ""

    def handle_data(self, data):
        if self.into is not None:
            self.into["text"] += data


def parse(source: str | None) -> list[tuple]:
    """Rows of CELLS; or one row of kind ``refused`` whose text is the reason."""
    refused = lambda why: [("refused", None, None, None, None, None, None, None, why)]
    if not source or not source.strip():
        return refused("source_html_required")
    if len(re.findall(r"(?i)<table\b", source)) != 1 or len(re.findall(r"(?i)</table\s*>", source)) != 1:
        return refused("single_table_required")
    if len(source) > MAX_CHARS or len(re.findall(r"(?i)<t[dh]\b", source)) > MAX_CELLS:
        return refused("input_budget_exceeded")
    table = _Table()
    table.feed(source)
    cells = table.cells
    if any(c["down"] > MAX_SPAN or c["across"] > MAX_SPAN for c in cells):
        return refused("input_budget_exceeded")
    if not cells or max(c["row"] + c["down"] for c in cells) > max(c["row"] for c in cells) + 1:
        return refused("table_structure_unavailable")
    taken, out = set(), []
    for c in cells:
        col = 0
        while (c["row"], col) in taken:
            col += 1
        taken |= {(c["row"] + i, col + j) for i in range(c["down"]) for j in range(c["across"])}
        text = re.sub(r"[ \t]+", " ", c["text"]).strip()
        out.append(("cell", f"r{c['row']}c{col}", c["row"], col, c["down"], c["across"], c["head"], c["foot"], text))
    return out + [("caption", f"caption{i}", None, None, None, None, None, None, c["text"].strip()) for i, c in enumerate(table.captions)]


def source_cells(tables: DataFrame, key: str, html: str) -> DataFrame:
    """The key with the cells and captions (CELLS) of each table; tables are independent and dealt to all tasks, as parsing is the work."""
    names = [key, *[c.split()[0] for c in CELLS.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):  # few tables at once, as each may be many cells
                part = pdf.iloc[at : at + ROWS]
                rows = [(k, *cell) for k, source in zip(part[key], part[html], strict=True) for cell in parse(source)]
                yield pd.DataFrame(rows, columns=names).astype(object)

    return spread(tables.select(key, html), key).mapInPandas(run, f"{key} {tables.schema[key].dataType.simpleString()}, {CELLS}")


def places(cells: DataFrame, key: str) -> DataFrame:
    """(key, r, c, ref, row, col, across, head, text): every place of the grids, with the cell that fills it."""
    spread = cells.where("kind = 'cell'").withColumn("r", F.explode(F.sequence("row", F.col("row") + F.col("down") - 1)))
    return spread.withColumn("c", F.explode(F.sequence("col", F.col("col") + F.col("across") - 1))).select(key, "r", "c", "ref", "row", "col", "across", "head", "text")


def _shapes(cells: DataFrame, key: str) -> DataFrame:
    """Per table: n_rows, width, n_head (rows from the top in which cells begin, all of them heads) and whether cells overlap."""
    grid = places(cells, key)
    by_place = grid.groupBy(key, "r", "c").count().groupBy(key).agg(F.max("r").alias("last"), F.max("c").alias("wide"), F.count("*").alias("n_places"), (F.max("count") > 1).alias("overlap"))
    rows = cells.where("kind = 'cell'").groupBy(key, "row").agg(F.bool_and("head").alias("heads"))
    # the k-th row of heads is part of the run if it is row k - 1
    place = F.row_number().over(Window.partitionBy(key).orderBy("row")) - 1
    run = rows.where("heads").withColumn("place", place).where("row = place").groupBy(key).agg(F.count("*").cast("int").alias("n_head"))
    shape = by_place.join(run, key, "left").withColumn("n_head", F.coalesce("n_head", F.lit(0)))
    return shape.select(key, (F.col("last") + 1).alias("n_rows"), (F.col("wide") + 1).alias("width"), "n_places", "overlap", "n_head")


def fields(cells: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """(key, c, path, named): the distinct texts of the head cells above each column, from the top."""
    heads = places(cells, key).join(shapes.select(key, "n_head"), key).where("r < n_head")
    once = heads.groupBy(key, "c", "ref").agg(F.min("r").alias("r"), F.first("text").alias("text"))
    return once.groupBy(key, "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ref", "text"))), lambda x: x["text"]).alias("path")).withColumn("named", F.exists("path", lambda t: t != ""))


def project(cells: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(verdicts, records) of tables.

    Verdicts have the key, status (complete or unavailable), reasons (array, empty if complete), n_head, n_fields and
    n_records. Tables that cannot be projected have one reason, in this order: what the parse refused, overlapping cells,
    words that set conditions, a footer, spanning cells in the body, ragged rows, no clear header. Those that can be may
    still hold cells with loose conditions; then their records are candidates, not published.

    Records have the key, row, col, path, value, kind, source (the cell's place), status (source, blank_in_source or
    merged_fill) and published. Values are read from cells alone.
    """
    cells = cells.withColumn("loose", F.regexp_like("text", F.lit(LOOSE_CONDITION)) & (scalar_kind(F.col("text")) == "text") & (F.col("kind") != "refused"))
    shapes = _shapes(cells, key)
    found = cells.groupBy(key).agg(
        F.max(F.when(F.col("kind") == "refused", F.col("text"))).alias("refused"), F.bool_or((F.col("kind") != "refused") & F.regexp_like("text", F.lit(CONDITIONAL))).alias("conditional"),
        F.bool_or(F.coalesce("foot", F.lit(False))).alias("footer"), F.bool_or(F.coalesce((F.col("across") > 1) & (F.col("row") > 0), F.lit(False))).alias("spanning"), F.bool_or("loose").alias("loose"),
    )
    columns = fields(cells, shapes, key)
    named = columns.groupBy(key).agg(F.count_if("named").alias("n_named"))
    grid = places(cells, key).join(shapes, key)
    across = grid.where("r >= n_head and across > 1").groupBy(key).agg(F.lit(True).alias("wide_body"))
    t = found.join(shapes, key, "left").join(named, key, "left").join(across, key, "left")
    ragged = F.col("n_places") != F.col("n_rows") * F.col("width")
    bodied = (F.col("n_head") > 0) & (F.col("n_head") < F.col("n_rows"))
    possible = bodied & ~ragged & ~F.col("conditional") & ~F.col("footer") & F.col("wide_body").isNull() & (F.coalesce("n_named", F.lit(0)) == F.col("width"))
    reason = (
        F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("overlap"), "overlapping_source_cells").when(possible, None)
        .when(F.col("conditional"), "conditional_source_requires_review").when(F.col("footer"), "footer_requires_review").when(F.col("spanning"), "body_spanning_cells")
        .when(ragged, "ragged_table_rows").otherwise("ambiguous_header")
    )
    judged = t.withColumn("reason", reason)
    valid = F.col("refused").isNull() & ~F.coalesce("overlap", F.lit(False))
    reasons = F.array_compact(F.array("reason", F.when(valid & F.col("loose"), "unsupported_condition")))
    judged = judged.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "complete").otherwise("unavailable"))
    kept = F.col("reason").isNull()
    verdicts = judged.select(key, "status", "reasons", F.coalesce("n_head", F.lit(0)).alias("n_head"), F.when(kept, F.col("width")).otherwise(0).alias("n_fields"), F.when(kept, F.col("n_rows") - F.col("n_head")).otherwise(0).alias("n_records"))
    body = grid.where("r >= n_head").join(judged.where(kept).select(key, "status"), key).join(columns.select(key, "c", "path"), [key, "c"])
    state = F.when(F.col("ref") != F.concat(F.lit("r"), F.col("r"), F.lit("c"), F.col("c")), "merged_fill").when(F.col("text") == "", "blank_in_source").otherwise("source")
    records = body.select(key, F.col("r").alias("row"), F.col("c").alias("col"), "path", F.col("text").alias("value"), scalar_kind(F.col("text")).alias("kind"), F.col("ref").alias("source"), state.alias("status"), (F.col("status") == "complete").alias("published"))
    return verdicts, records


def html_of(rows: Column, caption: Column) -> Column:
    """An HTML table of an array of row texts (each ``<tr>...</tr>``) and a caption, which may be null."""
    return F.concat(F.lit("<table>"), F.coalesce(F.concat(F.lit("<caption>"), caption, F.lit("</caption>")), F.lit("")), F.array_join(rows, ""), F.lit("</table>"))


def cell_formulas(cells: DataFrame, key: str) -> DataFrame:
    """(key, source, start, end, latex, label, source_ref): the formulas within each cell, never across cells, with the offsets that cut them from its text."""
    found = cells.where("kind = 'cell'").select(key, F.col("ref").alias("source"), "text", F.inline(math_spans(F.col("text")))).where("complete")
    latex = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    ref = F.concat_ws(":", F.col(key).cast("string"), "source", F.col("start").cast("string"), F.col("end").cast("string"))
    inner = F.regexp_replace(latex, r"^(?:\$\$?|\\[\[(])|(?:\$\$?|\\[\])])$", "")
    return found.select(key, "source", "start", "end", latex.alias("latex"), formula_label(inner).alias("label"), ref.alias("source_ref"))


def bound(formulas: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """``named`` (key, source, latex, and others) with ``source_ref``, the one formula of that cell that is written so, ``label``, theirs, and ``verdict``: found, none, several.

    Both sides may be large, and Spark takes what is parsed from a small file for small; so they are merged, never broadcast.
    """
    counts = formulas.groupBy(key, "source", "latex").agg(F.count("*").alias("_n"), F.min("source_ref").alias("source_ref"), F.first("label").alias("label"))
    met = named.join(counts.hint("merge"), [key, "source", "latex"], "left")
    verdict = F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "several").otherwise("found")
    return met.withColumn("verdict", verdict).withColumn("source_ref", F.when(F.col("verdict") == "found", F.col("source_ref"))).drop("_n")
