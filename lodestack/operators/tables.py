"""HTML and markdown tables to long tables of cells."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.rounds import spread

# Budgets of a source table.
MAX_CHARS, MAX_CELLS, MAX_SPAN = 200_000, 2_000, 100
#: Tables whose cells are held at once in a Python task.
ROWS = 256


class _Cells(HTMLParser):
    """Origin cells of the first table: (row, tag, rowspan, colspan, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.cells: list[list] = []
        self.row, self.open, self.done = -1, None, False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "tr":
            self.row += 1
        elif tag in ("td", "th"):
            said = dict(attrs)
            span = [int(said[k]) if (said.get(k) or "").isdigit() else 1 for k in ("rowspan", "colspan")]
            self.open = [max(self.row, 0), tag, *span, ""]
            self.cells.append(self.open)
        elif tag == "br" and self.open:
            self.open[-1] += "\n"

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.open = None
        self.done |= tag == "table"

    def handle_data(self, data):
        if self.open and not self.done:
            self.open[-1] += data

    def handle_entityref(self, name):
        self.handle_data(entities.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(entities.unescape(f"&#{name};"))


def grid(source: str | None) -> list[tuple[int, int, int, int, str, str]]:
    """(row, col, source_row, source_col, status, text) of each position, spans expanded; a table beyond the budgets, or
    with overlapping cells, is one row with status ``rejected`` and the reason."""
    reject = lambda why: [(-1, -1, -1, -1, "rejected", why)]
    if not source or "<td" not in source.lower() and "<th" not in source.lower():
        return []
    if len(source) > MAX_CHARS:
        return reject("too_long")
    parser = _Cells()
    parser.feed(source)
    taken: dict[tuple[int, int], tuple] = {}
    for row, _, down, across, text in parser.cells:
        if not (1 <= down <= MAX_SPAN and 1 <= across <= MAX_SPAN):
            return reject("span")
        col = 0
        while (row, col) in taken:
            col += 1
        text = re.sub(r"[ \t]+", " ", text).strip()
        for i in range(row, row + down):
            for j in range(col, col + across):
                if (i, j) in taken:
                    return reject("overlap")
                taken[i, j] = (i, j, row, col, ("recognized" if text else "blank") if (i, j) == (row, col) else "spanned", text)
        if len(taken) > MAX_CELLS:
            return reject("too_many_cells")
    return [taken[k] for k in sorted(taken)]


def html_cells(documents: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The grid of each document's first table, a row per position. Documents are independent; they are dealt to all tasks, as parsing is the work."""
    kind = documents.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_col, "row", "col", "source_row", "source_col", "status", "text"]
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):  # few tables at once, as each may be many cells
                part = pdf.iloc[at : at + ROWS]
                yield pd.DataFrame([(i, *cell) for i, source in zip(part[id_col], part[html_col], strict=True) for cell in grid(source)], columns=names)

    return spread(documents.select(id_col, html_col), id_col).mapInPandas(parse, f"{id_col} {kind}, row int, col int, source_row int, source_col int, status string, text string")


def markdown_cells(line: Column) -> Column:
    """The cells of a markdown row; null for separator rows and lines without a pipe."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    return F.when(F.contains(line, F.lit("|")) & ~F.regexp_like(line, F.lit(r"^[\s|:-]+$")), cells)


def rendered(grid: DataFrame, key: str) -> DataFrame:
    """(key, markdown, csv, tsv, json) of grids (key, row, col, text), each place once.

    Short rows are filled up with blanks, line breaks in cells are spaces in all but json. Markdown escapes bars, and has the first row as its
    head; csv quotes commas, quotes and breaks. json is an array of objects by the head's names: blank ones are Col and their number, a name that
    comes again has its number behind it, so no cell is lost; a grid of a head alone is an empty array.
    """
    from lodestack.sources.tables import delimited, markdown_row

    width = grid.groupBy(key).agg((F.max("col") + 1).alias("width"))
    places = F.map_from_entries(F.collect_list(F.struct("col", "text")))
    rows = grid.groupBy(key, "row").agg(places.alias("at")).join(width, key)
    cells = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda j: F.coalesce(F.try_element_at("at", j), F.lit("")))
    tables = rows.select(key, "width", "row", cells.alias("cells")).groupBy(key).agg(F.first("width").alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("rows"))
    flat = F.transform("rows", lambda r: F.transform(r, lambda c: F.regexp_replace(c, r"\s*\n\s*", " ")))
    head = F.get("rows", F.lit(0))
    named = F.transform(head, lambda c, i: F.when(c == "", F.concat(F.lit("Col"), (i + 1).cast("string"))).otherwise(c))
    unique = F.transform(F.col("named"), lambda c, i: F.when(F.array_position(F.col("named"), c) == i + 1, c).otherwise(F.concat(c, F.lit("_"), (i + 1).cast("string"))))
    made = tables.withColumns({"flat": flat, "named": named}).withColumn("names", unique)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    body = F.slice("flat", F.lit(2), F.greatest(F.size("flat") - 1, F.lit(0)))
    markdown = F.array_join(F.concat(F.array(markdown_row(F.get("flat", F.lit(0))), rule), F.transform(body, markdown_row)), "\n")
    lines = lambda d: F.array_join(F.transform("flat", lambda r: delimited(r, d)), "\n")
    records = F.transform(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: F.map_from_arrays("names", r))
    return made.select(key, markdown.alias("markdown"), lines(",").alias("csv"), lines("\t").alias("tsv"), F.to_json(records).alias("json"))
