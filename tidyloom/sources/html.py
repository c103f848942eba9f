"""Tables out of HTML pages: one row per table row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_ROWS = "array<struct<table_no:int,row_no:int,cells:array<string>>>"

#: The most columns that a cell may span; browsers stop at a thousand.
MOST_SPAN = 10_000

# Fixed value: blanks that read as one blank.
_BLANKS = re.compile(r"[\r\n]+|\s{2,}")


class _Tables(HTMLParser):
    """Collects the rows of every table of a page.

    A cell that spans columns or rows is repeated in each of them, up to the end of its table.  The
    text of a nested table belongs to its own rows and to the cell around it.
    """

    def __init__(self, tables: int, most_span: int):
        super().__init__(convert_charrefs=True)
        self.most_span = most_span
        self.rows: list[dict] = []
        self.tables = tables
        self.open: list[dict] = []  # the tables around the current position, innermost last

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            table = {"number": self.tables, "rows": 0, "cells": None, "text": None, "below": {}}
            self.open.append(table)
            self.tables += 1
        elif self.open and tag == "tr":
            self._end_row()
            self.open[-1]["cells"] = []
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            if self.open[-1]["cells"] is None:
                self.open[-1]["cells"] = []
            self.open[-1]["text"] = []
            self.open[-1]["span"] = _span(attrs, "colspan"), _span(attrs, "rowspan")

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table":
            self._end_row()
            self.open.pop()

    def handle_data(self, data):
        if self.cdata_elem:  # script or style
            return
        for table in self.open:
            if table["text"] is not None:
                table["text"].append(data)

    def _end_cell(self):
        table = self.open[-1]
        if table["text"] is not None:
            text = _BLANKS.sub(" ", "".join(table["text"]).strip())
            columns, rows = table["span"]
            if columns > self.most_span:
                raise ValueError(f"a cell spans {columns} columns, more than {self.most_span}")
            for _ in range(columns):
                self._cells_from_above()
                if rows > 1:
                    table["below"][len(table["cells"])] = [text, rows]
                table["cells"].append(text)
            table["text"] = None

    def _cells_from_above(self):
        """Fill the next positions that cells of earlier rows reach down to.

        ``below`` holds, by position, a cell's text and its rows left, the current one included.
        """
        table = self.open[-1]
        while len(table["cells"]) in table["below"]:
            table["cells"].append(table["below"][len(table["cells"])][0])

    def _end_row(self):
        self._end_cell()
        table = self.open[-1]
        if table["cells"]:
            self._cells_from_above()
            table["below"] = {
                position: [text, rows - 1]
                for position, (text, rows) in table["below"].items()
                if rows > 1
            }
            row = {"table_no": table["number"], "row_no": table["rows"], "cells": table["cells"]}
            self.rows.append(row)
            table["rows"] += 1
        table["cells"] = None

    def close(self):
        super().close()
        while self.open:
            self._end_row()
            self.open.pop()


def _span(attrs: list[tuple[str, str | None]], name: str) -> int:
    """A span attribute; what is not a positive number counts as 1."""
    value = (dict(attrs).get(name) or "").strip()
    return int(value) if re.fullmatch("[0-9]+", value) and int(value) else 1


# What decides where a table begins and ends: its tags, and text that only looks like tags.
_MARKS = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<(/?)table(?=[\s/>])", re.I | re.S
)


def _outer_tables(page: str) -> Iterator[str]:
    """The parts of a page that hold its tables, each with the tables inside it."""
    depth, start = 0, 0
    for mark in _MARKS.finditer(page):
        if mark.group(2) == "":
            if depth == 0:
                start = mark.start()
            depth += 1
        elif mark.group(2) == "/" and depth:
            depth -= 1
            if depth == 0:
                yield page[start : mark.end()] + ">"
    if depth:
        yield page[start:]


def _page_rows(page: str | None, most_span: int) -> list[dict]:
    rows: list[dict] = []
    tables = 0
    for part in _outer_tables(page or ""):
        parser = _Tables(tables, most_span)
        parser.feed(part)
        parser.close()
        rows += parser.rows
        tables = parser.tables
    return rows


def html_table_rows(html: Column | str, most_span: int = MOST_SPAN) -> Column:
    """All table rows of a page, as an array of ``(table_no, row_no, cells)``.

    A cell that spans more than ``most_span`` columns stops the query: a short page could ask for any number of cells.
    """

    @F.pandas_udf(TABLE_ROWS)
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: _page_rows(page, most_span))

    return parse(html)


def html_tables(df: DataFrame, html: str, *keep: str, most_span: int = MOST_SPAN) -> DataFrame:
    """One row per table row: the ``keep`` columns, then ``table_no, row_no, cells``.

    Pages without a table never leave the JVM, and of the others only the page text does.
    """
    with_tables = df.filter(F.col(html).rlike("(?i)<table"))
    return with_tables.select(*keep, F.inline(html_table_rows(html, most_span)))
