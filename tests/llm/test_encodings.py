import random

from textloom.llm import encodings as E

SOUND = ["Der Türsteher öffnete das Löschblatt während der Überfahrt", "La fille au béret a oublié la lanterne fêlée à l'étage", "El niño del puerto pidió la canción en el jardín", "O capitão não pagou o cartão da estação atrás do portão", "Старый пекарь спрятал сломанное радио после ужина", "늙은 제빵사가 어젯밤에 부서진 라디오를 고쳤다 선장님이 말없이"]


def corpus(spark, extra):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        words = rng.choice(SOUND).split()
        rng.shuffle(words)
        rows.append((i, "a/b/f.rtf", " ".join(words[: rng.randint(4, 8)]), "utf-8", 1))
    rows += [(1000 + i, "a/b/g.rtf", t, "cp1252", 1) for i, t in enumerate(extra)]
    return spark.createDataFrame(rows, "source_id bigint, file_path string, content string, encoding string, mark int")


def test_round_trips(spark):
    wrong = [SOUND[0].encode().decode("cp1252"), SOUND[1].encode().decode("latin-1"), SOUND[4].encode("cp1251").decode("cp1252"), SOUND[4].encode("koi8-r").decode("cp1251"), SOUND[5].encode("cp949").decode("latin-1"), SOUND[2].encode("cp850").decode("cp1252"), SOUND[3].encode().decode("mac-roman"), SOUND[4].encode("utf-16-le").decode("utf-16-be"), "La canción y " + "el niño".encode().decode("cp1252")]
    meant = [SOUND[0], SOUND[1], SOUND[4], SOUND[4], SOUND[5], SOUND[2], SOUND[3], SOUND[4], "La canción y el niño"]
    sound = ["20°C ± 2", "『뷁』", "«OÙ ?»", r"F\'e4hre \u233?t\u233?", "plain ascii?", "", "РСФСР", "£4 — 5µm"]
    lossy = ["O escriv\ufffdo", "Jo?o e a irm?zinha"]
    csv = spark.createDataFrame([(1, "a/b/c.csv", [["la señal", None], None, ["el niño".encode().decode("cp1252")]]), (2, "a/b/c.csv", [["la señal"]]), (3, None, None)], "csv_id bigint, file_path string, parsed_rows array<array<string>>")
    rtf = corpus(spark, wrong + sound + lossy + [None])
    got = {(r["item_table"], r["item_id"]): r for r in E.repaired(rtf, csv).collect()}
    for i, text in enumerate(meant):
        r = got["rtf_source_info", 1000 + i]
        assert r["mark"] == "repaired" and r["parts"] == [text], (wrong[i], r)
    n = len(wrong)
    for i, text in enumerate(sound):
        r = got["rtf_source_info", 1000 + n + i]
        assert r["mark"] is None and r["parts"] == [text], r
    for i in range(len(lossy)):
        assert got["rtf_source_info", 1000 + n + len(sound) + i]["mark"] == "lossy"
    assert all(got["rtf_source_info", i]["mark"] is None for i in range(240))
    assert got["csv_source_info", 1]["mark"] == "repaired" and got["csv_source_info", 1]["parts"] == ["la señal", None, "el niño"] and got["csv_source_info", 2]["mark"] is None
    assert E.affected(rtf.limit(0), csv.limit(0)).count() == 0


def test_every_chain_of_a_record_is_undone():
    import numpy as np

    r = E.Repairer(np.zeros(E.SIZE, dtype=np.float32))
    r.kept = {f"{c}ä": {i: (c, 14.0)} for i, c in enumerate("abcde")}
    assert r.record(["aä bä cä", None, "dä eä"], 0) == (["a b c", None, "d e"], "repaired")


def test_posterior_is_normalised_and_pools_evidence():
    import numpy as np

    flat = np.zeros(E.SIZE, dtype=np.float32)
    r = E.Repairer(flat)
    r.kept = {"a": {0: ("x", 2.0), 1: ("y", -3.0)}, "b": {0: ("z", 3.0)}, "c": {}}
    p = r.posterior({"a", "b", "c"}, 0)
    assert abs(sum(p.values()) - 1) < 1e-9 and p[0] > p[-1] and 1 not in p
    counts = flat[2 * E.WORDS + E.PAIRS + E.SINGLES :].reshape(E.POOLS, E.N_CHAINS + 1)
    counts[7, 0], counts[7, 1] = 10, 90  # a pool in which the first chain is common
    assert E.Repairer(flat).shares[7, 1] > E.Repairer(flat).shares[8, 1]


def test_pairs_and_model_of_batches():
    import numpy as np

    first, second, of = E.pairs_of(["ab", "", "ж"])
    assert [chr(x) for x in first] == ["^", "a", "b", "^", "^", "ж"] and [chr(x) for x in second] == ["a", "b", "$", "$", "ж", "$"] and of.tolist() == [0, 0, 0, 1, 2, 2]
    model = E.SoundModel(np.zeros(E.SIZE, dtype=np.float32))
    both = model.log_p(["one", "two"])
    assert np.allclose(both, [model.log_p(["one"])[0], model.log_p(["two"])[0]])
