"""Boxes in order: column clusters, reading order, reassembly and table grids.

These follow a state from box to box (a running mean, a group's head), which columns cannot state; each page
is a group of its own in applyInPandas, and a page holds a bounded number of lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

_BOX = "line_id long, x1 double, y1 double, x2 double, y2 double"


def _clusters(centres: list[float], tolerance: float) -> list[int]:
    """Nearest running mean within the tolerance, else a new cluster."""
    means, sizes, out = [], [], []
    for c in centres:
        near = min(range(len(means)), key=lambda k: abs(means[k] - c), default=None)
        if near is None or abs(means[near] - c) > tolerance:
            means.append(c)
            sizes.append(1)
            out.append(len(means) - 1)
        else:
            sizes[near] += 1
            means[near] += (c - means[near]) / sizes[near]
            out.append(near)
    return out


def column_clusters(boxes: DataFrame, page: str = "stem", tolerance: float = 30.0) -> DataFrame:
    """page, line_id, col_index: columns by x centre, numbered from the right; rows without a box have -1."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line_id")
        good = frame.dropna(subset=["x1", "x2"])
        centre = (good["x1"] + good["x2"]) / 2
        found = pd.Series(_clusters(centre.tolist(), tolerance), index=good.index, dtype="int64")
        rank = centre.groupby(found).mean().rank(ascending=False, method="first").astype(int) - 1
        return pd.DataFrame({page: frame[page], "line_id": frame["line_id"], "col_index": found.map(rank).reindex(frame.index).fillna(-1).astype(int)})

    kind = boxes.schema[page].dataType.simpleString()
    return boxes.select(page, "line_id", "x1", "y1", "x2", "y2").groupBy(page).applyInPandas(run, f"{page} {kind}, line_id long, col_index int")


# Least overlap of a box with a column by the narrower of both, least ratio of a box's width to the column's first one, and by how much a column may be wider than its first box.
OVERLAP, ALIKE, SPREAD = 0.5, 0.5, 1.6


def _guarded(boxes: list[tuple[float, float, float, float] | None]) -> list[list[int]]:
    """Columns of boxes by overlap in x, left to right as they begin; a box joins the first column that its guards let it into. A box without corners is a column of its own."""
    middle = lambda b: (b[0] + b[2], b[1]) if b else (0.0, 0.0)
    columns: list[dict] = []
    for k in sorted(range(len(boxes)), key=lambda k: middle(boxes[k])):
        b = boxes[k]
        home = next((c for c in columns if b and c["first"] and _fits(b, c)), None)
        if home is None:
            columns.append({"first": b, "lo": b and b[0], "hi": b and b[2], "rows": [k]})
        else:
            home["lo"], home["hi"] = min(home["lo"], b[0]), max(home["hi"], b[2])
            home["rows"].append(k)
    return [c["rows"] for c in columns]


def _fits(b: tuple[float, float, float, float], column: dict) -> bool:
    first = column["first"]
    width, base = b[2] - b[0], first[2] - first[0]
    alike = min(width, base) >= ALIKE * max(1e-6, width, base)
    narrow = max(b[2], first[2]) - min(b[0], first[0]) <= SPREAD * base
    shared = min(b[2], column["hi"]) - max(b[0], column["lo"])
    return alike and narrow and shared > 0 and shared >= OVERLAP * max(1e-6, min(width, column["hi"] - column["lo"]))


def guarded_order(boxes: DataFrame, page: str = "stem") -> DataFrame:
    """page, line_id, column, pos of boxes(page, line_id, x1, y1, x2, y2): columns by overlap under guards on width and spread, numbered from the right by their rightmost middle, and read down each; rows without a whole box come last, each a column of its own."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line_id")
        rows = [None if any(v != v for v in r) else r for r in frame[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)]
        middle = lambda k: (rows[k][0] + rows[k][2]) / 2 if rows[k] else float("-inf")
        columns = sorted(_guarded(rows), key=lambda c: -max(map(middle, c)))
        order = [(k, n) for n, c in enumerate(columns) for k in sorted(c, key=lambda k: rows[k][1] if rows[k] else 0.0)]
        at = [k for k, _ in order]
        return pd.DataFrame({page: frame[page].to_numpy()[at], "line_id": frame["line_id"].to_numpy()[at], "column": [n for _, n in order], "pos": range(len(at))})

    kind = boxes.schema[page].dataType.simpleString()
    return boxes.select(page, "line_id", "x1", "y1", "x2", "y2").groupBy(page).applyInPandas(run, f"{page} {kind}, line_id long, column int, pos int")


def reading_order(boxes: DataFrame, page: str = "stem", tolerance: float = 30.0, upright: bool = True) -> DataFrame:
    """page, line_id, pos: columns from right to left, top to bottom inside (upright), or row bands from top, left to right; rows without a box come last."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line_id")
        good = frame.dropna(subset=["x1", "y1", "x2", "y2"])
        cx, cy = (good["x1"] + good["x2"]) / 2, (good["y1"] + good["y2"]) / 2
        first = (-cx).sort_values(kind="stable") if upright else cy.sort_values(kind="stable")
        limit = tolerance if upright else 0.6 * (good["y2"] - good["y1"]).mean() if len(good) else tolerance
        band, head, k = {}, None, -1
        for at, value in first.items():
            if head is None or abs(value - head) > limit:
                k, head = k + 1, value
            band[at] = k
        inner = cy if upright else cx
        order = sorted(good.index, key=lambda i: (band[i], inner[i])) + [i for i in frame.index if i not in band]
        return pd.DataFrame({page: frame.loc[order, page].to_numpy(), "line_id": frame.loc[order, "line_id"].to_numpy(), "pos": range(len(order))})

    kind = boxes.schema[page].dataType.simpleString()
    return boxes.select(page, "line_id", "x1", "y1", "x2", "y2").groupBy(page).applyInPandas(run, f"{page} {kind}, line_id long, pos int")


def table_grid(cells: DataFrame, page: str = "stem", tolerance: float = 30.0) -> DataFrame:
    """page, row, col, text: rows by overlap in y with the row's span, columns by x clusters from the left; texts of one cell are joined."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=["x1", "y1", "x2", "y2"]).sort_values(["y1", "x1"], kind="stable")
        if frame.empty:
            return pd.DataFrame({page: frame[page], "row": frame["x1"].astype(int), "col": frame["x1"].astype(int), "text": frame["text"]})
        rows, spans = [], []
        for y1, y2 in zip(frame["y1"], frame["y2"]):
            hit = next((k for k, (a, b) in enumerate(spans) if min(b, y2) - max(a, y1) > 0.5 * min(b - a, y2 - y1)), None)
            if hit is None:
                spans.append((y1, y2))
                hit = len(spans) - 1
            else:
                spans[hit] = (min(spans[hit][0], y1), max(spans[hit][1], y2))
            rows.append(hit)
        centre = (frame["x1"] + frame["x2"]) / 2
        cols = pd.Series(_clusters(centre.tolist(), tolerance), index=frame.index, dtype="int64")
        left = centre.groupby(cols).mean().rank(method="first").astype(int) - 1
        out = pd.DataFrame({page: frame[page], "row": rows, "col": cols.map(left), "text": frame["text"], "x1": frame["x1"]})
        return out.sort_values("x1", kind="stable").groupby([page, "row", "col"], as_index=False)["text"].agg("".join)

    kind = cells.schema[page].dataType.simpleString()
    return cells.select(page, "x1", "y1", "x2", "y2", "text").groupBy(page).applyInPandas(run, f"{page} {kind}, row int, col int, text string")
