import pytest

from textloom.llm import markup as M

MARKED = ["<b>x</b>", "a<br/>b", "<!-- c -->", "x &amp; y", "&eacute;a", "# Head", "Head\n====", "**bold**", "~~gone~~", "- [x] done", "[a](http://b)", "![a](b.png)", "text[^1]", "[^1]: note", "```py\nx\n```", "Use `f()` here", "| a | b |\n|---|:---:|\n| 1 | 2 |", "== Head ==", "* item", "** item", "[[A|b]]", "{{cite|x}}", "{{Infobox x\n| name = y\n}}", "''i''", "[https://a.example B]", '{| class="wikitable"\n|-\n| 1 || 2\n|}', "<ref name=\"a\">B</ref>", r"\section{A}", r"\textbf{x}", r"\begin{itemize}", r"\item x", r"x~\cite{a}", r"$\frac{a}{b}$", r"$$a^2$$", r"\[ a \]"]
PLAIN = ["", "Cost rose from $26 to $35 per unit.", r"Saved to C:\bemdo\dowen\v41.", "8 * 9 * 3 gives the total*", "A --> B, ratio 26%", "5 <= x <= 84; y >= 2; a == b", "Ticket #23 and #24 are open.", "Mail a@b.example (R&D, Q&A).", r"path\to\x | y | 2", "'a' and \"b\" {draft 70}", "if a < 67 and m > 71.", "~38 km, 38^2 m, ~/a/b", "[a] text (b)", "[see note 33]", "_13 and velka_ remain", "64) item", "[Page Number: 3]", "[Image:images/a_1.png]", "Field a_b_id is empty.", "<3 you & me"]


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found_and_gone_after_cleaning(text):
    assert M.has_markup(text)
    cleaned = M.clean_text(text)
    assert cleaned != text


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_left_alone(text):
    assert not M.has_markup(text) and M.clean_text(text) == text


def test_structure_is_kept():
    assert M.clean_text("# Top\n\n* a\n** b") == "■ Top\n\n• a\n  • b"
    assert M.clean_text("| a | b |\n|---|---|\n| 1 | 2 |") == "a │ b\n\n1 │ 2"
    assert M.clean_text("```py\ndef f(x):\n    return x < 3\n```") == "    def f(x):\n        return x < 3"
    assert M.clean_text("<p>A &lt; B</p><ul><li>x</li><li>y</li></ul>") == "A < B\n\n• x\n• y"
    assert M.clean_text(r"\begin{equation}\label{e}a_1\end{equation} and $b^2$") == "⟦a_1⟧ and ⟦b^2⟧"
    assert M.clean_text("[Page Number: 1]\n<b>x</b> [Image:a.png]") == "[Page Number: 1]\nx [Image:a.png]"
    assert M.clean_text(None) is None and M.clean_text("") == ""


def test_frames(spark):
    converted = spark.createDataFrame([(1, "<b>x</b>", "p", 1), (1, "<b>x</b>", "p", 1), (2, "x", "p", 1), (3, None, "p", 1), (4, "y" * 200_000 + "<i>z</i>", None, None)], "convert_id bigint, content string, profile string, item_id int")
    elements = spark.createDataFrame([(1, "text", "**a**"), (2, "table", "**a**"), (3, None, "**a**"), (4, "text", None)], "element_id bigint, element_type string, content string")
    assert sorted(map(tuple, M.with_markup(converted, elements).collect())) == [("docx_elements", 1), ("rtf_converted_data", 1), ("rtf_converted_data", 4)]
    assert M.clean_items(converted, elements).count() == 4
    assert M.with_markup(converted.limit(0), elements.limit(0)).count() == 0
