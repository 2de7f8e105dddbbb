"""Page layout beyond single elements: columns of text, blocks, their order, and repair of detected table grids.

Columns and order are windows within a page. Blocks are connected components, so they are found page by page in one Arrow group
each; a page is bounded by what fits on paper."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.geometry import PAGE

# fixed values: distances in points
EDGE_GAP, MEMBERS, CENTRES_APART, ROW_GAP, SIDE_GAP, LEAST_WIDTH, LEAST_HEIGHT = 30, 3, 20, 40, 15, 80, 60


def text_columns(texts: DataFrame) -> DataFrame:
    """(doc_id, page_no, column, left, boundary): left edges of longer texts in clusters of at least three, the boundary
    to the next column halfway between their centres, where these are far enough apart."""
    w = W.partitionBy(*PAGE).orderBy("x0")
    long = texts.filter(F.length("content") > 20)
    opened = long.withColumn("__new", (F.coalesce(F.col("x0") - F.lag("x0").over(w), F.lit(1e9)) > EDGE_GAP).cast("int"))
    clusters = opened.withColumn("__c", F.sum("__new").over(w)).groupBy(*PAGE, "__c").agg(F.avg("x0").alias("left"), F.count("*").alias("n")).filter(F.col("n") >= MEMBERS)
    by_left = W.partitionBy(*PAGE).orderBy("left")
    apart = clusters.withColumn("__before", F.lag("left").over(by_left)).filter(F.col("__before").isNull() | (F.col("left") - F.col("__before") >= CENTRES_APART))
    return apart.select(*PAGE, F.row_number().over(by_left).alias("column"), "left", ((F.col("left") + F.lead("left").over(by_left)) / 2).alias("boundary"))


def _adjacent(a, b) -> bool:
    over_x, over_y = a.x0 < b.x1 and b.x0 < a.x1, a.y0 < b.y1 and b.y0 < a.y1
    gap_y, gap_x = max(a.y0, b.y0) - min(a.y1, b.y1), max(a.x0, b.x0) - min(a.x1, b.x1)
    return (over_x and gap_y <= ROW_GAP) or (over_y and gap_x <= SIDE_GAP)


BLOCKS = "doc_id long, page_no int, block int, x0 double, y0 double, x1 double, y1 double, elements int"


def blocks(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, block, box, elements): groups of neighbouring elements of a column; small ones are dropped.
    Elements have a `column` (null: one column)."""

    def one(page: pd.DataFrame) -> pd.DataFrame:
        rows = list(page.sort_values(["y0", "x0"]).itertuples(index=False))
        group = list(range(len(rows)))

        def root(i: int) -> int:
            while group[i] != i:
                group[i] = group[group[i]]
                i = group[i]
            return i

        for i, a in enumerate(rows):
            for j in range(i + 1, len(rows)):
                if rows[j].y0 - a.y1 > ROW_GAP and rows[j].y0 >= a.y1:
                    break  # rows come by their tops, so nothing further down touches this one
                if (pd.isna(a.column) or a.column == rows[j].column) and _adjacent(a, rows[j]):
                    group[root(j)] = root(i)
        found: dict[int, list] = {}
        for i, r in enumerate(rows):
            found.setdefault(root(i), []).append(r)
        out = []
        for members in found.values():
            x0, y0, x1, y1 = min(m.x0 for m in members), min(m.y0 for m in members), max(m.x1 for m in members), max(m.y1 for m in members)
            if x1 - x0 >= LEAST_WIDTH and y1 - y0 >= LEAST_HEIGHT:
                out.append((rows[0].doc_id, rows[0].page_no, len(out), x0, y0, x1, y1, len(members)))
        return pd.DataFrame(out, columns=["doc_id", "page_no", "block", "x0", "y0", "x1", "y1", "elements"])

    columns = ["doc_id", "page_no", "column", "x0", "y0", "x1", "y1"]
    ready = elements if "column" in elements.columns else elements.withColumn("column", F.lit(None).cast("int"))
    return ready.select(*columns).groupBy(*PAGE).applyInPandas(one, BLOCKS)


def block_order(found: DataFrame) -> DataFrame:
    """Blocks with `place`: header, then the columns from left to right, each from the top down, then footer."""
    zone = F.when(F.col("zone") == "header", 0).when(F.col("zone") == "footer", 2).otherwise(1)
    return found.withColumn("place", F.row_number().over(W.partitionBy(*PAGE).orderBy(zone, F.coalesce("column", F.lit(0)), "y0", "x0")))


def merge_narrow_columns(rows: Column, widths: Column, least: float = 15.0) -> Column:
    """array<array<string>>: columns are put together until each is wide enough; what is left at the end joins the last."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("group"), F.lit(0.0).alias("width"))

    def step(acc: Column, w: Column) -> Column:
        wide = acc["width"] + w >= least
        return F.struct(F.array_append(acc["ids"], acc["group"]).alias("ids"), (acc["group"] + F.when(wide, 1).otherwise(0)).alias("group"), F.when(wide, F.lit(0.0)).otherwise(acc["width"] + w).alias("width"))

    ids = F.aggregate(widths, start, step, lambda acc: F.transform(acc["ids"], lambda g: F.when((acc["width"] > 0) & (acc["group"] > 0), F.least(g, acc["group"] - 1)).otherwise(g)))

    def merged(r: Column) -> Column:
        cells = F.arrays_zip(r.alias("text"), ids.alias("id"))
        return F.transform(F.array_sort(F.array_distinct(ids)), lambda g: F.trim(F.array_join(F.transform(F.filter(cells, lambda c: c["id"] == g), lambda c: F.coalesce(c["text"], F.lit(""))), "")))

    return F.transform(rows, merged)


def spans_from_blanks(rows: list[list[str | None]]) -> list[tuple[int, int, int, int]]:
    """(row, col, row span, col span) of the filled cells: over the blanks to the right, and down over blank rows of the same
    columns as long as those rows hold something elsewhere."""
    grid = [[(c or "").strip() for c in r] for r in rows]
    out = []
    for i, row in enumerate(grid):
        for j, c in enumerate(row):
            if not c:
                continue
            across = 1
            while j + across < len(row) and not row[j + across]:
                across += 1
            down = 1
            while i + down < len(grid) and any(grid[i + down]) and all(k < len(grid[i + down]) and not grid[i + down][k] for k in range(j, j + across)):
                down += 1
            out.append((i, j, down, across))
    return out


def header_over_data(tables: DataFrame) -> DataFrame:
    """Tables with `header_id`: the table of at most two rows right above (-5 to 40 points) that overlaps in x by 70 % of the
    narrower one and has no more columns."""
    w = W.partitionBy(*PAGE).orderBy("y0", "x0")
    above = {c: F.lag(c).over(w) for c in ("table_id", "x0", "x1", "y1", "rows", "columns")}
    inter = F.least(F.col("x1"), above["x1"]) - F.greatest(F.col("x0"), above["x0"])
    fits = (F.col("y0") - above["y1"]).between(-5, 40) & (inter >= 0.7 * F.least(F.col("x1") - F.col("x0"), above["x1"] - above["x0"])) & (above["rows"] <= 2) & (above["columns"] <= F.col("columns"))
    return tables.withColumn("header_id", F.when(fits, above["table_id"]))


def subheaders(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, text_id) of short texts such as (A) or (B) between a header table and the data table under it."""
    t = tables.filter(F.col("header_id").isNotNull()).select(*[F.col(c).alias("t_" + c) for c in ("doc_id", "page_no", "x0", "x1", "y0", "table_id")])
    marked = texts.filter(F.col("content").rlike(r"^\s*\([A-Z가-힣0-9]{1,3}\)"))
    near = (F.col("t_y0") - F.col("y1")).between(-5, 40) & (F.col("x0") < F.col("t_x1")) & (F.col("x1") > F.col("t_x0"))
    return marked.join(t, (F.col("doc_id") == F.col("t_doc_id")) & (F.col("page_no") == F.col("t_page_no")) & near).select(F.col("t_table_id").alias("table_id"), "text_id")


def join_rows(above: Column, below: Column) -> Column:
    """Rows of two tables as one, all of the width of the wider."""
    both = F.concat(above, below)
    width = F.array_max(F.transform(both, lambda r: F.size(r)))
    return F.transform(both, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def last_category(rows: Column) -> Column:
    """The last filled cell of the first column."""
    return F.element_at(F.filter(F.transform(rows, lambda r: F.trim(F.coalesce(F.get(r, 0), F.lit("")))), lambda c: c != ""), -1)
