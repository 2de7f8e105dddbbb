"""Cells on a sheet: used range, regions of touching cells, and their merging into tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def used_range(cells: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """(sheet, min_row, min_col, max_row, max_col, left_out) of the filled cells. Cells beyond a limit, where one is given, are
    counted in left_out."""
    inside = F.lit(True)
    if max_rows is not None:
        inside = inside & (F.col("row") <= max_rows)
    if max_columns is not None:
        inside = inside & (F.col("col") <= max_columns)
    filled = cells.filter(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("__in", inside)
    ends = [F.min(F.when(F.col("__in"), F.col(c))).alias("min_" + c) for c in ("row", "col")] + [F.max(F.when(F.col("__in"), F.col(c))).alias("max_" + c) for c in ("row", "col")]
    return filled.groupBy("sheet").agg(*ends, F.count(F.when(~F.col("__in"), 1)).alias("left_out"))


def components(points: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (r0, c0, r1, c1) of the groups of cells that touch by a side, in reading order."""
    left, out = set(points), []
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            r, c = todo.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
                    group.append(p)
        rows, cols = [p[0] for p in group], [p[1] for p in group]
        out.append((min(rows), min(cols), max(rows), max(cols)))
    return sorted(out)


def merge_boxes(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes that overlap or touch become one, until none do."""
    out, before = sorted(set(boxes)), -1
    while len(out) != before:
        before = len(out)
        out = _touching(out)
    return out


def _touching(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """One sweep by rows: each group of boxes that touch becomes the box around it. A column remembers the box that reaches
    furthest down in it; any other that a new box could touch there touches that one too."""
    parent = list(range(len(boxes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    deepest: dict[int, int] = {}
    for i, (r0, c0, r1, c1) in enumerate(boxes):
        for c in range(c0 - 1, c1 + 2):
            j = deepest.get(c)
            if j is not None and boxes[j][2] + 1 >= r0:
                parent[root(j)] = root(i)
        for c in range(c0, c1 + 1):
            j = deepest.get(c)
            if j is None or boxes[j][2] < r1:
                deepest[c] = i
    around: dict[int, tuple[int, int, int, int]] = {}
    for i, b in enumerate(boxes):
        a = around.get(root(i), b)
        around[root(i)] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
    return sorted(around.values())


REGIONS = "sheet long, region int, min_row int, min_col int, max_row int, max_col int"


def table_regions(cells: DataFrame) -> DataFrame:
    """(sheet, region, box) of the tables of each sheet: bordered and filled cells by components, then merged. One sheet is
    one group and is read whole; the time is linear in its cells and the widths of their boxes."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        filled = pdf[pdf["value"].fillna("").str.strip() != ""]
        bordered = pdf[pdf["bordered"].eq(True)]
        boxes = components(set(zip(bordered["row"], bordered["col"]))) + components(set(zip(filled["row"], filled["col"])))
        merged = merge_boxes(boxes)
        return pd.DataFrame([(pdf["sheet"].iloc[0], i, *b) for i, b in enumerate(merged)], columns=["sheet", "region", "min_row", "min_col", "max_row", "max_col"])

    return cells.groupBy("sheet").applyInPandas(one, REGIONS)
