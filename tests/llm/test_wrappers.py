from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import wrappers as W


def test_streams_and_folding():
    text = "plain\n\n<ul><li>a</li></ul>\n\n**x** y z, w"
    assert W.streams_of(text) == [["#T"], ["<", "ul", ">", "<", "li", ">", "#T", "<", "/", "li", ">", "<", "/", "ul", ">"], ["**", "#T", "**", " ", "#P"]]
    assert W.streams_of("[Page Number: 3]\nWhere was it? Not here.\nx < 5") == [["#T"], ["#P"], ["#P"], ["#T", " ", "<", " ", "#N"]]
    assert W.streams_of("See C:\\one\\two, \\emph{a} &amp; b") == [["#P", ":", "\\", "#T", "\\", "#T", " ", "\\", "emph", "{", "#T", "}", " ", "&", "amp", ";", " ", "#T"]]
    assert W.shown(W.folded(["<ul>", "<li>", "#T", "</li>", "<li>", "#T", "</li>", "</ul>"])) == "<ul> ( <li> #T </li> )+ </ul>"
    assert W.streams_of("") == []


def test_alignment_makes_options():
    wrappers = W.infer([["<p>", "#T", "</p>"], ["<p>", "#T", "<br>", "</p>"], ["task", "#T", "task", "#T"], ["#T"]])
    assert [W.shown(w) for w in wrappers] == ["<p> #T ( <br> )? </p>", "( task #T )+", "#T"]


TOKEN = st.sampled_from(["<p>", "</p>", "#T", "<b>", "task"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(TOKEN, min_size=1, max_size=12), min_size=1, max_size=12))
def test_every_fitted_stream_has_a_wrapper(streams):
    matchers = [W.Matcher(w) for w in W.infer(streams)]
    assert all(any(m.fits(s, frozenset(s)) for m in matchers) for s in streams)


def test_matcher_is_exact_and_fast():
    import re

    wrapper = [["?", ["+", ["a", "b"]]], "c", ["?", "a"], ["+", "b"]]
    pattern = re.compile(r"(?:(?:ab)+)?ca?b+")
    for n in range(3**6):
        s = [("a", "b", "c")[n // 3**k % 3] for k in range(6)]
        assert W.Matcher(wrapper).fits(s, frozenset(s)) == bool(pattern.fullmatch("".join(s)))
    many = [["?", "a"] for _ in range(60)] + ["c"]
    assert not W.Matcher(many).fits(["a"] * 59 + ["b", "c"], frozenset("abc")) and W.Matcher(many).fits(["a"] * 59 + ["c"], frozenset("ac"))


def test_all_streams_of_a_host_are_aligned():
    plain = [[f"<a{i}>", f"<b{i}>"] for i in range(450)]
    rare = [["<p>", "#T", "</p>"], ["<p>", "#T", "<br>", "</p>"]]
    wrappers = W.infer(plain + rare)
    assert len(wrappers) == 451 and W.shown(wrappers[-1]) == "<p> #T ( <br> )? </p>"


def test_long_blocks_are_whole():
    assert W.streams_of("<b>x</b>" * 50) == [["<", "b", ">", "#T", "<", "/", "b", ">"] * 50]
    assert W.streams_of("$$\na\n$$\nb") == [["$$", "\n", "#T", "\n", "$$"], ["#T"]]


@settings(max_examples=200, deadline=None)
@given(st.lists(TOKEN, min_size=1, max_size=12), st.lists(TOKEN, min_size=1, max_size=12))
def test_no_pair_that_aligns_is_turned_away(one, two):
    a, b = W.folded(one), W.folded(two)
    if W.aligned(a, b) is not None:
        x, y = W.constants_of(W.parts_of(a)), W.constants_of(W.parts_of(b))
        assert W.may_align(x, x.total(), y, y.total()) and W.balance(a) == W.balance(b)


def streams(*texts):
    return [s for t in texts for s in W.streams_of(t)]


def test_markup_is_decided_on_the_wrapper():
    given_ = streams("See [a](b) now", "See [a](b) now [^1]", "It is [a] now", "x < 5", "x < 5 > 4", "- [ ] a", "- [x] a")
    got = {s: m for s, _, m in W.assigned(given_)}
    assert [got[W.JOIN.join(s)] for s in given_] == [True, True, False, False, False, True, True]


def test_without_inference_the_result_fails(monkeypatch):
    """Ablation: a wrapper that was not inferred, of all tokens in any order, tells nothing."""
    given_ = streams("**a** b", "<p>x</p>", "It is [a] now", "plain words here", "x < 5")
    right = [m for _, _, m in W.assigned(given_)]
    assert right == [True, True, False, False, False]
    every = sorted({t for s in given_ for t in s})
    monkeypatch.setattr(W, "infer", lambda streams: [[["+", [["?", t] for t in every]]]])
    assert [m for _, _, m in W.assigned(given_)] != right


def test_the_grammar_reads_wrappers_not_texts(monkeypatch):
    calls = []
    grammar = W.tokens
    monkeypatch.setattr(W, "tokens", lambda t: calls.append(t) or grammar(t))
    texts = [f"See [word{i}](place{i}) and [^{i}] here" for i in range(500)]
    every = [tuple(s) for t in texts for s in W.streams_of(t)]
    assert not calls and len(set(every)) == 1
    assert [m for _, _, m in W.assigned([list(s) for s in set(every)])] == [True]
    assert len(calls) == 5 and all("word" not in t for t in calls)  # the five samples of the one wrapper


def test_options_are_well_formed_and_no_unions():
    a, b = (W.folded(s) for s in streams("a <b>x</b> c", "a <i>x</i> c"))
    assert W.aligned(a, b) is None
    a, b = (W.folded(s) for s in streams("a <b>x</b> (c) <b>y</b>", "a <b>x</b> <b>y</b>"))
    assert W.shown(W.aligned(a, b)).count("( ( #T ) ␣ )?") + W.shown(W.aligned(a, b)).count("( ␣ ( #T ) )?") == 1


def test_items_are_found_by_their_wrappers(spark):
    from textloom.llm.markup import with_markup

    converted = spark.createDataFrame([(1, "notes", "a <b>b</b>"), (2, "notes", "plain"), (3, None, "**x** y"), (4, "notes", None)], "convert_id long, profile string, content string")
    elements = spark.createDataFrame([(7, "text", "<p>x</p>"), (8, "table", "<p>x</p>"), (9, "text", "x < y")], "element_id long, element_type string, content string")
    found = with_markup(converted, elements)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "RLIKE" not in plan  # the wrappers decide, not a pattern on the stream
    assert {tuple(r) for r in found.collect()} == {("rtf_converted_data", 1), ("rtf_converted_data", 3), ("docx_elements", 7)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 .?!…,\n'’é가", max_size=30))
def test_plain_units_are_read_alike_on_both_ways(text):
    for unit in text.split("\n"):
        if not W._MARK.search("\n" + unit):
            assert {tuple(s) for s in W.plain_streams(unit)} == {tuple(s) for s in W.streams_of_unit(unit)}
