"""Tables and cards in HTML pages as rows of cells, with the standard parser, a batch of pages at a time."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, block int, row int, cells array<string>"
TABLES = "array<struct<block: int, rows: array<array<string>>>>"
_CELLS, _ROWS, _BLOCKS = {"td", "th", "li", "p", "h1", "h2", "h3"}, {"tr", "ul", "ol", "article"}, {"table", "nav", "article"}


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.block, self.row, self.cell, self.cells, self.skip = [], 0, 0, None, [], 0

    def _end_row(self) -> None:
        if self.cells:
            self.rows.append((self.block, self.row, self.cells))
            self.row, self.cells = self.row + 1, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in _BLOCKS:
            self._end_row()
            self.block, self.row = self.block + 1, 0
        elif tag in _ROWS:
            self._end_row()
        if tag in _CELLS:
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append("\0")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in _CELLS and self.cell is not None:
            self.cells.append("\n".join(" ".join(line.split()) for line in "".join(self.cell).split("\0")))  # a line for each br
            self.cell = None
        if tag in _ROWS | _BLOCKS:
            self._end_row()

    def handle_data(self, data):
        if self.cell is not None and not self.skip:
            self.cell.append(data)


def cells_of(html: str) -> list[tuple[int, int, list[str]]]:
    parser = _Cells()
    parser.feed(html)
    parser.close()
    parser._end_row()
    return parser.rows


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(p, *r) for p, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for r in cells_of(h.as_py() or "")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], ["page_id", "block", "row", "cells"])


def table_cells(pages: DataFrame) -> DataFrame:
    """page_id, block, row, cells of every page (page_id, html); null html has none."""
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_parse, SCHEMA)


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("block", pa.int32()), ("rows", pa.list_(pa.list_(pa.string())))]))
    for batch in batches:
        found = []
        for html in batch.column(batch.num_columns - 1):
            tables: dict[int, list] = {}
            for block, _, cells in cells_of(html.as_py() or ""):
                tables.setdefault(block, []).append(cells)
            found.append([{"block": b, "rows": rows} for b, rows in tables.items()])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], [*batch.schema.names[:-1], "tables"])


def page_tables(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with tables (each block's rows of cells, in order) in place of html; nothing is shuffled. Null html has none."""
    kept = [f for f in pages.schema.fields if f.name != html_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"tables {TABLES}"])
    return pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col(html_col)).mapInArrow(_nested, schema)
