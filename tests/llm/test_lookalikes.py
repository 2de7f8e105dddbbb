from textloom.llm import lookalikes as L


def test_skeletons():
    same = ["Net profit", "Ｎｅｔ　ｐｒｏｆｉｔ", "Net\u00a0profit", "N\u200bet pro\ufb01t", "\u039det pr\u043efit", "Net\u2007pr\u03bffit\ufeff"]
    assert {L.skeleton_of(s) for s in same} == {"Net profit"}
    assert L.skeleton_of("월별 수량") == L.skeleton_of("월별 수량".encode().decode()) and L.skeleton_of("Größe") == L.skeleton_of("Gro\u0308ße")
    for other in ("NET PROFIT", "Net profit.", "Netprofit", "Nét profit", "Net  profit", "Net profi1"):
        assert L.skeleton_of(other) != "Net profit"
    assert L.skeleton_of("x²") != L.skeleton_of("x2") and L.skeleton_of("") == ""


def test_matches(spark):
    terms = spark.createDataFrame([(1, "Net profit", "en"), (2, "총 수량", "ko"), (3, None, None)], "term_id int, term string, lang string")
    rows = [(1, "Ｎet profit", 5), (1, "Ｎet profit", 5), (2, "Net profit", 5), (3, None, 5), (4, "", 5), (5, "총\u00a0수량", 5), (6, "x" * 300_000 + "ｙ", 5)]
    items = spark.createDataFrame(rows, "item_id bigint, text string, term int")
    assert sorted(map(tuple, L.matches(items, terms).collect())) == [(1, 1), (5, 2)]
    assert sorted(map(tuple, L.matches(items, terms, term_table_rows=0).collect())) == [(1, 1), (5, 2)]
    assert L.matches(items.limit(0), terms).count() == 0 and L.matches(items, terms.limit(0)).count() == 0
    assert items.select(L.consistent_form(items.text).alias("f")).filter("f = 'Net profit'").count() == 3
