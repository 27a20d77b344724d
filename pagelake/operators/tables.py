"""Table grids: from HTML and pipe tables, validity, rendering, stitching across pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Limits of a grid.
MOST_SPAN, MOST_CELLS = 100, 10_000
CELLS = "row int, col int, rows int, cols int, text string, header boolean"


class _Grid(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None
        self.head = False

    def handle_starttag(self, tag, attrs):
        if tag == "thead":
            self.head = True
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            spans = {k: int(v) if v and v.isdigit() and int(v) > 0 else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            if max(spans.values(), default=1) > MOST_SPAN:
                raise ValueError("span too large")
            self.cell = {"text": "", "header": tag == "th" or self.head, "rows": spans.get("rowspan", 1), "cols": spans.get("colspan", 1)}
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "thead":
            self.head = False
        elif tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data


def grid_of_html(html: str) -> list[tuple]:
    """Cells (row, col, rows, cols, text, header): the next free column of each row; an unclosed last row is kept."""
    parser = _Grid()
    parser.feed(html)
    parser.close()
    taken: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(parser.rows):
        c = 0
        for cell in row:
            while (r, c) in taken:
                c += 1
            places = {(r + i, c + j) for i in range(cell["rows"]) for j in range(cell["cols"])}
            taken |= places
            if len(taken) > MOST_CELLS:
                raise ValueError("grid too large")
            out.append((r, c, cell["rows"], cell["cols"], " ".join(cell["text"].split()), cell["header"]))
    return out


def grid_of_pipes(text: str) -> list[tuple]:
    """A Markdown pipe table: escaped bars stay in their cell, the rule under the header is dropped."""
    rows = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))] for line in text.splitlines() if "|" in line]
    ruled = len(rows) > 1 and all(re.fullmatch(r":?-+:?", c) for c in rows[1])
    body = [rows[0], *rows[2:]] if ruled else rows
    return [(r, c, 1, 1, t, ruled and r == 0) for r, row in enumerate(body) for c, t in enumerate(row)]


def cells_of(tables: DataFrame, key: str, column: str, parse=grid_of_html) -> DataFrame:
    """One row a cell; tables that cannot be read give none."""
    kind = tables.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for k, text in zip(b[key], b[column]):
                try:
                    rows += [(k, *cell) for cell in parse(text or "")]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=[key, "row", "col", "rows", "cols", "text", "header"])

    return tables.select(key, column).mapInPandas(run, f"{key} {kind}, {CELLS}")


def topology(cells: DataFrame, key: str) -> DataFrame:
    """key, row_count, column_count, overlaps, gaps, valid: every place of the grid is covered exactly once."""
    places = cells.withColumn("r", F.explode(F.expr("sequence(row, row + rows - 1)"))).withColumn("c", F.explode(F.expr("sequence(col, col + cols - 1)")))
    per = places.groupBy(key, "r", "c").agg(F.count("*").alias("n"))
    out = per.groupBy(key).agg((F.max("r") + 1).alias("row_count"), (F.max("c") + 1).alias("column_count"), F.sum((F.col("n") > 1).cast("long")).alias("overlaps"), F.count("*").alias("covered"))
    gaps = F.col("row_count") * F.col("column_count") - F.col("covered")
    return out.select(key, "row_count", "column_count", "overlaps", gaps.cast("long").alias("gaps"), ((F.col("overlaps") == 0) & (gaps == 0)).alias("valid"))


def as_pipes(cells: DataFrame, key: str) -> DataFrame:
    """key, markdown: the first row is the header."""
    row = cells.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("cs"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("cs", lambda c: F.replace(c["text"], F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("cs")))
    lines = row.select(key, "row", F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def stitched(tables: DataFrame) -> DataFrame:
    """tables: document_id, page_number, table_id, top, left, column_count, signature?. The last table of a page goes on in the
    first of the next if columns agree and a marked header of the second equals the first's; chains get the first's id."""
    page = ["document_id", "page_number"]
    first = Window.partitionBy(*page).orderBy("top", "left", "table_id")
    last = Window.partitionBy(*page).orderBy(F.desc("top"), F.desc("left"), F.desc("table_id"))
    ends = tables.withColumn("f", F.row_number().over(first)).withColumn("l", F.row_number().over(last))
    b = ends.filter("f = 1").select("document_id", (F.col("page_number") - 1).alias("page_number"), F.col("table_id").alias("next_id"), F.col("column_count").alias("next_columns"), F.col("signature").alias("next_signature"))
    ok = (F.col("column_count") == F.col("next_columns")) & (F.col("next_signature").isNull() | F.col("signature").eqNullSafe(F.col("next_signature")))
    edges = ends.filter("l = 1").join(b, page).filter(ok).select("document_id", "page_number", "table_id", "next_id")
    w = Window.partitionBy("document_id").orderBy("page_number")
    new = F.coalesce((F.lag("next_id").over(w) != F.col("table_id")) | (F.lag("page_number").over(w) != F.col("page_number") - 1), F.lit(True))
    chain = edges.withColumn("chain", F.sum(new.cast("int")).over(w))
    return chain.withColumn("head", F.first("table_id").over(Window.partitionBy("document_id", "chain").orderBy("page_number")))
