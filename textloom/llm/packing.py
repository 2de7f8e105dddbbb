"""Filling fixed-capacity containers with items: best-two-fit over the histogram of sizes.

Items of equal size are interchangeable, so the packing is computed on the histogram of sizes, whose rows are bounded by the
capacity however many items there are. A container is filled greedily with the largest items that fit; then its smallest
item is replaced with the two unpacked items that fit the expanded gap more tightly, if there are such. The filled
container is a pattern that is repeated as often as the histogram allows. The patterns give each size's items, by their
rank, a container number; ranks are counted in salted groups, so that a size that a third of all items share is no
single task. What is shuffled are keys and sizes, never texts.

Defined cases
    * an item above the capacity is split into pieces of the capacity and a rest; others are never split;
    * items of size 0 (empty or null texts) need no room: they are listed once with a null container;
    * ties are broken by key and piece number; repeated keys are counted as separate items;
    * an empty table gives no rows; capacities below 1 or null are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.functions.checkpoints import checkpointed

SALTED_ROWS = 250_000  # aim for at most so many items in one ranking group
BROADCAST_ROWS = 400_000  # interval rows up to which the plan may be broadcast


def best_pair(sizes: np.ndarray, counts: np.ndarray, gap: int) -> tuple[int, int]:
    """The two available sizes whose sum is largest without exceeding the gap, (0, 0) if no two fit."""
    small = sizes[: np.searchsorted(sizes, gap, side="right")]
    if len(small) == 0:
        return 0, 0
    at = np.searchsorted(small, gap - small, side="right") - 1
    index = np.arange(len(small))
    single = (at == index) & (counts[index] < 2)
    at = np.where(single, at - 1, at)
    total = np.where(at >= 0, small + small[at], 0)
    best = int(total.argmax())
    return (int(small[best]), int(small[at[best]])) if total[best] > 0 else (0, 0)


def fill_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(sizes and how many of each, how many containers) of each pattern, in order. Sizes are 1..capacity."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        count[size] += n
    out = []
    sizes = np.flatnonzero(count)
    while len(sizes):
        room, inside = capacity, {}
        k = len(sizes) - 1
        while k >= 0 and room > 0:
            size = int(sizes[k])
            if size > room:
                k = int(np.searchsorted(sizes[: k + 1], room, side="right")) - 1
                continue
            take = min(room // size, int(count[size]))
            inside[size] = take
            room -= take * size
            k -= 1
        if room > 0:
            least = min(inside)
            left = count[sizes].copy()
            for size, n in inside.items():
                left[np.searchsorted(sizes, size)] -= n
            free = left > 0
            a, b = best_pair(sizes[free], left[free], room + least)
            if a + b > least:
                inside[least] -= 1
                for size in (a, b):
                    inside[size] = inside.get(size, 0) + 1
                inside = {s: n for s, n in inside.items() if n}
        times = min(int(count[s]) // n for s, n in inside.items())
        for s, n in inside.items():
            count[s] -= n * times
        out.append((inside, times))
        sizes = sizes[count[sizes] > 0]
    return out


def intervals(patterns: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[int, int, int, int]], int]:
    """((size, first rank, first container, items a container) of each run, containers in all)."""
    used: dict[int, int] = {}
    out, container = [], 0
    for inside, times in patterns:
        for size, n in inside.items():
            out.append((size, used.get(size, 0), container, n))
            used[size] = used.get(size, 0) + n * times
        container += times
    return out, container


def pieces_of_items(sizes: DataFrame, packs: list[tuple[str, int]], key: str, tokens: str) -> DataFrame:
    """(pack, capacity, key, piece_no, start, size): each item once a pack, cut at multiples of the capacity."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pack"), F.lit(c).cast("bigint").alias("capacity")) for p, c in packs]))
    wide = sizes.filter(F.col(tokens) > 0).select(key, F.col(tokens).alias("__n"), each.alias("__p")).select(key, "__n", "__p.pack", "__p.capacity")
    last = F.floor((F.col("__n") - 1) / F.col("capacity"))
    cut = wide.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("piece_no") * F.col("capacity")
    return cut.select("pack", "capacity", key, F.col("piece_no").cast("int").alias("piece_no"), start.alias("start"), F.least(F.col("capacity"), F.col("__n") - start).alias("size"))


def pack_items(sizes: DataFrame, pack_sizes: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(pack, container, key, piece_no, start, size) of every piece of every item."""
    spark = sizes.sparkSession
    sizes = checkpointed(sizes.select(key, F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias(tokens)))
    packs = [(r[0], r[1]) for r in pack_sizes.select("pack", "capacity").filter("capacity > 0").distinct().orderBy("pack").collect()]  # a fixed table of a few rows
    nothing = sizes.filter(F.col(tokens) == 0)
    schema = "pack string, size bigint, runs array<struct<rank: bigint, container: bigint, n: bigint>>"
    if not packs:
        return spark.createDataFrame([], f"pack string, container bigint, {key} {dict(sizes.dtypes)[key]}, piece_no int, start bigint, size bigint")
    pieces = pieces_of_items(sizes, packs, key, tokens)
    histogram = pieces.groupBy("pack", "size").count().collect()  # at most one row for each size up to each capacity
    rows, total = [], 0
    for pack, capacity in packs:
        own = {r["size"]: r["count"] for r in histogram if r["pack"] == pack}
        total += sum(own.values())
        runs: dict[int, list] = {}
        for size, rank, container, n in intervals(fill_patterns(own, capacity))[0]:
            runs.setdefault(size, []).append((rank, container, n))
        rows += [(pack, size, run) for size, run in runs.items()]
    plan = spark.createDataFrame(rows, schema)
    if sum(len(r[2]) for r in rows) <= BROADCAST_ROWS:
        plan = F.broadcast(plan)

    salts = max(1, -(-total // SALTED_ROWS))
    group = ["pack", "size", "__salt"]
    salted = pieces.drop("capacity").withColumn("__salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)))
    before = W.partitionBy("pack", "size").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy(*group).count().withColumn("__offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = salted.withColumn("__rank", F.row_number().over(W.partitionBy(*group).orderBy(key, "piece_no")) - 1)
    placed = ranked.join(offsets, group).withColumn("__rank", F.col("__rank") + F.col("__offset")).join(plan, ["pack", "size"])
    run = F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("__rank")), -1)
    out = placed.withColumn("__run", run).select("pack", (F.col("__run.container") + F.floor((F.col("__rank") - F.col("__run.rank")) / F.col("__run.n"))).alias("container"), key, "piece_no", "start", "size")
    empty = nothing.select(F.explode(F.array(*[F.lit(p) for p, _ in packs])).alias("pack"), F.lit(None).cast("bigint").alias("container"), key, F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("size"))
    return out.unionByName(empty)
