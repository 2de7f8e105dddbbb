from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import packing as P


def fewest(sizes, capacity):
    """The least number of containers, by trying every assignment."""
    best = len(sizes)
    for assignment in product(range(len(sizes)), repeat=len(sizes)):
        load = {}
        for s, b in zip(sizes, assignment):
            load[b] = load.get(b, 0) + s
        if max(load.values()) <= capacity:
            best = min(best, len(load))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=6))
def test_near_the_optimum(sizes):
    patterns = P.fill_patterns({s: sizes.count(s) for s in set(sizes)}, 10)
    assert sum(n for _, n in patterns) <= fewest(sizes, 10) + 1


def first_fit_decreasing(histogram, capacity):
    rooms = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        i = next((i for i, r in enumerate(rooms) if r >= size), None)
        if i is None:
            rooms.append(capacity - size)
        else:
            rooms[i] -= size
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=20))
def test_every_item_has_its_place(histogram):
    patterns = P.fill_patterns(histogram, 60)
    used = {}
    for inside, times in patterns:
        assert sum(s * n for s, n in inside.items()) <= 60 and times > 0
        for s, n in inside.items():
            used[s] = used.get(s, 0) + n * times
    assert used == histogram
    assert sum(n for _, n in patterns) <= 1.1 * first_fit_decreasing(histogram, 60) + 1


def test_two_fit_better_than_one():
    # 6 leaves 4 open; with the 6 replaced, 5 + 5 fill the container
    assert P.fill_patterns({6: 1, 5: 2}, 10)[0] == ({5: 2}, 1)


def test_pieces_and_containers(spark):
    sizes = spark.createDataFrame([(1, 25, "x"), (2, 7, "x"), (3, 3, "x"), (4, 0, "x"), (5, None, "x"), (6, 10, "x"), (7, 5, "x"), (8, 5, "x")], "doc_id bigint, tokens bigint, size string")
    packs = spark.createDataFrame([("a", 10), ("b", 30), ("c", None)], "pack string, capacity int")
    rows = P.pack_items(sizes, packs).collect()
    for pack, capacity in (("a", 10), ("b", 30)):
        mine = [r for r in rows if r["pack"] == pack]
        load = {}
        for r in mine:
            if r["container"] is not None:
                load[r["container"]] = load.get(r["container"], 0) + r["size"]
        assert max(load.values()) <= capacity and sum(load.values()) == 55 and len(load) == -(-55 // capacity)
        assert sorted((r["doc_id"], r["piece_no"], r["start"], r["size"]) for r in mine if r["doc_id"] == 1) == ([(1, 0, 0, 10), (1, 1, 10, 10), (1, 2, 20, 5)] if pack == "a" else [(1, 0, 0, 25)])
        assert {r["doc_id"] for r in mine if r["container"] is None} == {4, 5}
    assert P.pack_items(sizes.limit(0), packs).count() == 0 and P.pack_items(sizes, packs.limit(0)).count() == 0


def test_salted_ranks(spark, monkeypatch):
    monkeypatch.setattr(P, "SALTED_ROWS", 50)
    sizes = spark.range(1000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 4, id % 10 + 1) AS tokens")
    rows = P.pack_items(sizes, spark.createDataFrame([("a", 10)], "pack string, capacity int")).collect()
    load = {}
    for r in rows:
        load[r["container"]] = load.get(r["container"], 0) + r["size"]
    assert len(rows) == 1000 and max(load.values()) <= 10 and len({r["doc_id"] for r in rows}) == 1000
