"""Residue: what the classifier decides, without its patterns, without whole families of them, and on lines it never saw."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from textloom.llm import residue

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def texts():
    return [t for t in pq.read_table(SF, columns=["text"]).column(0).to_pylist() if t]


@pytest.fixture(scope="module")
def found(texts):
    judge = residue.Judge(residue.fit(texts))
    return [t for t in texts if judge.is_residue(t)]


def test_finds_residue_and_spares_dialogue(texts, found):
    assert 0.02 * len(texts) < len(found) < 0.15 * len(texts)
    judge = residue.Judge(residue.fit(texts))
    assert judge.is_residue("{{title}}") and judge.is_residue("404 Not Found")
    assert not judge.is_residue("1\n00:00:01,000 --> 00:00:02,000\nWait for me at the gate.\n\n2\n00:00:03,000 --> 00:00:04,000\n404 Not Found")


def test_without_the_model_nothing_is_found(texts):
    blind = residue.Judge(np.zeros((2, residue.BUCKETS), dtype=np.float32))
    assert not any(blind.is_residue(t) for t in texts)


def test_most_of_what_is_found_shows_no_trusted_pattern_throughout(found):
    plain = [t for t in found if not all(residue.trusted(p) for p in residue.passages(t) if not residue.is_neutral(p))]
    assert len(plain) > 0.5 * len(found)


@pytest.fixture(scope="module")
def more():
    """(sample to fit on, what is found) at sf0.1"""
    every = [t for t in pq.read_table(SF.replace("sf0.01", "sf0.1"), columns=["text"]).column(0).to_pylist() if t]
    judge = residue.Judge(residue.fit(every[::2]))
    return every[::2], [t for t in every if judge.is_residue(t)]


@pytest.mark.parametrize("family", sorted(residue.TRUSTED))
def test_a_family_that_is_held_out_is_still_found(more, family):
    """Recall of at least 0.9 on the records of a family whose patterns took no part in fitting."""
    texts, found = more
    own = [t for t in found if (m := [p for p in residue.passages(t) if residue.trusted(p)]) and all(residue.TRUSTED[family].search(p) for p in m)]
    rest = {f: p for f, p in residue.TRUSTED.items() if f != family}
    judge = residue.Judge(residue.fit(texts, families=rest), rest)
    assert sum(judge.is_residue(t) for t in own) >= 0.9 * len(own)


UNSEEN = ["Bandwidth exceeded for this resource.", "Zugriff verweigert.", "Pagina non trovata", "[%title%]", "{0} {1}", "Kein Zugriff auf diesen Server", "Esta cuenta ha sido suspendida", "[[[speaker_name]]]",
          "Errore interno del server", "<<SUBTITLE_LINE>>", "Limite de connexions atteinte", "Quota used up, retry tomorrow"]


def test_residue_of_kinds_that_no_pattern_and_no_list_knows(texts):
    """Twelve unseen lines, three records each in the unlabelled part of the sample."""
    sample = texts + [f"{line}\n" for line in UNSEEN for _ in range(3)]
    judge = residue.Judge(residue.fit(sample))
    assert not any(residue.trusted(line) for line in UNSEEN)
    assert sum(judge.is_residue(line) for line in UNSEEN) >= 0.9 * len(UNSEEN)


def test_defined_cases():
    judge = residue.Judge(residue.fit([]))
    assert not any(judge.is_residue(t) for t in (None, "", "  \n", "[rain falling]", "Lorem ipsum"))
    many = "\n".join(["lorem ipsum dolor"] * 200_000)
    fitted = residue.Judge(residue.fit(["lorem ipsum dolor", "TODO"] * 20 + ["Where did you put it?\nWe should go inside now.\nNo.\nIs anyone there?"] * 50))
    assert fitted.is_residue(many) and not fitted.is_residue(many + "\nWe should go inside now.\nWhere did you put it?")


def test_operator_takes_nulls_repeats_and_no_rows(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "TODO", "{{a}}", "lorem ipsum dolor", "We should go inside now.\nWhere are you going?\nNo idea.\nWait here."] * 12)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    got = {r.doc_id: r.residue for r in residue.judged(df).collect()}
    assert got[0] is False and got[1] is False and got[3] is True and got[4] is True and got[5] is False
    assert residue.judged(df.limit(0)).count() == 0


R = residue
TALK = ["The old baker counted the ferry tickets.", "Where did you put it?", "Keep the lights low, all right?", "My sister sold a box of letters.", "Nobody here found the broken radio.", "Das weiß ich natürlich.", "Ya te lo dije, mañana."]


def srt(*lines):
    return "\n\n".join(f"{i + 1}\n00:00:0{i % 10},000 --> 00:00:0{i % 10},900\n{x}" for i, x in enumerate(lines))


CASES = ["404 Not Found", "Please turn on cookies and scripts to continue.", "{{title}} ${line}\n%(speaker)s", "Lorem ipsum dolum elum sed.\n[to be filled]\nTODO translate", srt("You need to enable JavaScript to run this app."), srt("[sighs]", "Page introuvable"), "HTTP/1.1 503 Service Unavailable\nServer: x-front\nContent-Length: 0", "Seite nicht gefunden\nDie angeforderte Datei a.srt existiert nicht mehr."]
NO_CASES = [None, "", " \n", "\ufeff", srt(*TALK), srt("[sighs]", "♪ la la ♪"), srt("Advertise your product here: a@b.example"), srt(TALK[0], "Access denied."), srt('He printed "access denied" on a T-shirt.', TALK[1]), srt("Blah, blah, blah. You always say that.")]


def model():
    texts = [srt(*(TALK[(i + k) % len(TALK)] for k in range(5))) for i in range(60)] + [c for c in CASES for _ in range(3)]
    return R.Judge(R.fit(texts))


def test_decisions():
    judge = model()
    assert [judge.is_residue(c) for c in CASES] == [True] * len(CASES)
    assert [judge.is_residue(c) for c in NO_CASES] == [False] * len(NO_CASES)


def test_frames(spark):
    texts = CASES * 3 + NO_CASES + [srt(*TALK)] * 40
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id bigint, text string, residue boolean")
    found = {r["doc_id"] for r in R.judged(df).filter("residue").collect()}
    assert found == set(range(len(CASES) * 3))
    assert R.judged(df.limit(0)).count() == 0
