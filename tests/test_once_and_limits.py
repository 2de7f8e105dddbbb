"""One row a key; and what used to stop at a limit goes on beyond it."""

import random

from pyspark.sql import functions as F

from textloom.functions.once import once
from textloom.operators import csv_tables, grids, timestamps
from textloom.operators.record_grammar import FITS


def test_once_keeps_one_row_a_key(spark):
    rng = random.Random(3)
    rows = [(k, f"t{k}", "x") for k in (rng.randrange(400) for _ in range(900))] + [(None, "n", "y")] * 3
    df = spark.createDataFrame(rows, "k long, __c string, count string")
    got = sorted(map(tuple, once(df, ["k"]).collect()), key=str)
    assert got == sorted(set(rows), key=str)
    assert once(df.limit(0), ["k"]).count() == 0
    assert once(df, ["k", "__c"]).count() == len(set(rows))


def test_rows_of_lone_keys_do_not_move(spark):
    df = spark.range(1000).withColumn("text", F.lit("x" * 100))
    assert once(df, ["id"]).count() == 1000
    plan = once(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_integers_with_many_zeros():
    assert FITS["integer"]("0" * 401 + "7") and FITS["integer"]("-" + "0" * 500 + str(2**63)) and not FITS["integer"](str(2**63)) and FITS["integer"](str(2**63 - 1))
    assert not FITS["integer"]("9" * 5000) and FITS["integer"]("+0")


def test_padded_time_is_read(spark):
    df = spark.createDataFrame([(1, " " * 300 + "2024-03-01T10:00:00Z" + "\n" * 50), (2, "9" * 10_000), (3, " " * 200)], "k long, t string").withColumns({"locale": F.lit("en_US"), "source_zone": F.lit("UTC")})
    got = {r.k: r.at for r in timestamps.normalise_times(df, ["t"]).select("k", F.date_format("t_utc", "yyyy-MM-dd HH:mm").alias("at")).collect()}
    assert got == {1: "2024-03-01 10:00", 2: None, 3: None}


def test_tables_are_whole():
    rows = csv_tables.parse("\n".join(["a,b"] * 100_050), ",")
    assert len(rows) == 100_050 and len(csv_tables.parse(",".join(["x"] * 1200), ",")[0]) == 1200
    assert len(csv_tables.parse("\n".join(["a,b"] * 50), ",", max_rows=10)) == 10


def test_used_range_says_what_a_limit_left_out(spark):
    cells = spark.createDataFrame([(1, 1, 1, "a"), (1, 1500, 2, "b"), (1, 2, 150, "c"), (1, 9, 9, " ")], "sheet long, row int, col int, value string")
    assert tuple(grids.used_range(cells).first()) == (1, 1, 1, 1500, 150, 0)
    assert tuple(grids.used_range(cells, 1000, 100).first()) == (1, 1, 1, 1, 1, 2)


def _merged_slowly(boxes):
    out = list(boxes)
    changed = True
    while changed:
        changed = False
        for i in range(len(out)):
            for j in range(len(out) - 1, i, -1):
                a, b = out[i], out[j]
                if a[0] <= b[2] + 1 and b[0] <= a[2] + 1 and a[1] <= b[3] + 1 and b[1] <= a[3] + 1:
                    out[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    del out[j]
                    changed = True
    return sorted(out)


def test_boxes_merge_as_pairwise_merging_does():
    rng = random.Random(5)
    for _ in range(300):
        boxes = [(r, c, r + rng.randrange(4), c + rng.randrange(4)) for r, c in ((rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(1, 25)))]
        assert grids.merge_boxes(boxes) == _merged_slowly(boxes)


def test_chequered_sheet_ends():
    points = {(r, c) for r in range(400) for c in range(400) if (r + c) % 2 == 0}
    assert grids.merge_boxes(grids.components(points)) == [(0, 0, 399, 399)]
