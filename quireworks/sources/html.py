"""Tables of web pages as grids: cells with their row and column, spans and nesting kept."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows or columns that one cell may span, at most; larger numbers are held at it.
SPAN = 1000


class Grids(HTMLParser):
    """Collects (table, parent, row, col, rowspan, colspan, header, text) of all cells of a page; a nested table is one of its own, its text no part of the outer cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple] = []
        self.open: list[dict] = []  # tables that are not closed, the innermost last
        self.tables = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append({"no": self.tables, "parent": self.open[-1]["no"] if self.open else None, "row": -1, "busy": set(), "col": 0, "cell": None})
            self.tables += 1
        elif self.open and tag == "tr":
            self._end_cell()
            self._next_row()
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            t = self.open[-1]
            if t["row"] < 0:
                self._next_row()
            while (t["row"], t["col"]) in t["busy"]:
                t["col"] += 1
            spans = dict(attrs)
            rows, cols = (self._span(spans.get(k)) for k in ("rowspan", "colspan"))
            t["busy"] |= {(t["row"] + i, t["col"] + j) for i in range(rows) for j in range(cols)}
            t["cell"] = [t["row"], t["col"], rows, cols, tag == "th", []]
            t["col"] += cols

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table":
            self._end_cell()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][5].append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._end_cell()
            self.open.pop()

    @staticmethod
    def _span(value: str | None) -> int:
        return max(1, min(SPAN, int(value))) if value and value.strip().isdecimal() else 1

    def _next_row(self) -> None:
        t = self.open[-1]
        t["row"], t["col"] = t["row"] + 1, 0

    def _end_cell(self) -> None:
        t = self.open[-1]
        if t["cell"]:
            *place, text = t["cell"]
            self.cells.append((t["no"], t["parent"], *place, " ".join("".join(text).split())))
            t["cell"] = None


def html_grid(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, parent_no (of the table that a nested one stands in, else null), row_no, col_no, rowspan, colspan, header, text of every cell.

    A cell takes the next column of its row that no span from above or before covers. Tables are numbered by where
    they open. Cells, rows and tables that are not closed end with the next of their kind, or the page. Null pages have none.
    """
    kind = pages.schema[key].dataType.simpleString()
    names = ["table_no", "parent_no", "row_no", "col_no", "rowspan", "colspan", "header", "text"]
    kinds = [pa.int32()] * 6 + [pa.bool_(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            for k, page in enumerate(batch.column(1).to_pylist()):
                grids = Grids()
                grids.feed(page or "")
                grids.close()
                rows += [k] * len(grids.cells)
                cells += grids.cells
            columns = list(zip(*cells)) if cells else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], [key, *names])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, table_no int, parent_no int, row_no int, col_no int, rowspan int, colspan int, header boolean, text string")
