"""Scalar functions against stated values."""

import pytest
from pyspark.sql import functions as F

from citeloom.functions import bbl, text
from citeloom.operators import bibliography

CLEAN = [
    ("-380", "380"),
    ("Hello, World!", "hello_world"),
    ("  Test   String  with spaces ", "test_string_with_spaces"),
    ("Another-Test_String.123", "another_test_string_123"),
    ("UPPERCASE", "uppercase"),
    ("mixedCase", "mixedcase"),
    ("12345", "12345"),
    (" ", ""),
    ("", ""),
    (None, ""),
    ("a\u00a0b é-ț", "a_b_é_ț"),
]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_clean_text(spark):
    assert column(spark, [a for a, _ in CLEAN], text.clean_text("x")) == [b for _, b in CLEAN]


@pytest.mark.parametrize("value", [b for _, b in CLEAN])
def test_clean_text_keeps_its_output(spark, value):
    assert column(spark, [value], text.clean_text("x")) == [value]


def test_trim_knows_unicode_space(spark):
    assert column(spark, ["\u00a0 a b\u2003\n"], text.trim_ws("x")) == ["a b"]


KEYS = [
    ("Plato", "The Republic", "-380", "plato_republic_380"),
    ("John Doe", "A Test Paper on Something", "2023", "doe_test_paper_something_2023"),
    ("Jane A. Smith and Bob Johnson", "Another Study", None, "smith_another_study"),
    ("John et al.", "Short", None, "john_short"),
    (None, "Training Generalized Models", "2023", "unknown_training_generalized_models_2023"),
    ("Víctor Gayoso", "é ț aé", "2018", "gayoso_2018"),
    ("", "Title Words Here", None, "_title_words_here"),
    (None, None, None, "unknown"),
]


def test_normalized_keys(spark):
    rows = spark.createDataFrame([(i, *k[:3]) for i, k in enumerate(KEYS)], "i int, a string, t string, y string")
    found = [r[0] for r in rows.orderBy("i").select(text.normalize_citation_key("a", "t", "y")).collect()]
    assert found == [k[3] for k in KEYS]


def test_arxiv_ids(spark):
    rows = [
        ("k", {"title": "See arXiv:2305.15030"}, "2305.15030"),
        ("k", {"journal": "arXiv:2305.15030v1"}, "2305.15030"),
        ("k", {"note": "arXiv: 2305.15030"}, "2305.15030"),
        ("k", {"raw": "x arXiv 2305.15030"}, "2305.15030"),
        ("2305.15030", {}, "2305.15030"),
        ("k", {"raw": "hep-th/9901001", "title": None}, None),
    ]
    df = spark.createDataFrame([(i, k, f) for i, (k, f, _) in enumerate(rows)], "i int, key string, fields map<string,string>")
    assert [r[0] for r in df.orderBy("i").select(bibliography.arxiv_id()).collect()] == [r[2] for r in rows]


def test_cite_keys(spark):
    texts = [r"\cite{b, a} and \cite{c}\cite{a}", r"\citep[x]{no} \parencite{p}", "", None, r"\citet{ , a}"]
    assert column(spark, texts, text.cite_keys("x")) == [["a", "b", "c"], [], [], None, ["", "a"]]
    assert column(spark, texts[1:2], text.cite_keys("x", extended=True)) == [["p"]]


def test_related_titles(spark):
    titles = [p.title() for p in text.RELATED_PHRASES] + ["Introduction", "Conclusion", "", None]
    assert column(spark, titles, text.is_related_title("x")) == [True] * 14 + [False] * 4


def test_truncate_bytes_cuts_no_character(spark):
    assert column(spark, ["é" * 60, "a" * 100, "a" * 101], text.truncate_bytes("x")) == [
        "é" * 48 + "...",
        "a" * 100,
        "a" * 97 + "...",
    ]


def test_dblp_query_and_authors(spark):
    assert column(spark, ["{A} *b c"], text.dblp_query("x")) == ["A+b+c"]
    df = spark.createDataFrame([(["Ann  B. Lee 0002", "Bo", "7"],)], "x array<string>")
    assert df.select(text.dblp_authors("x")).first()[0] == "Ann B. Lee and Bo and 7"


ITEMS = [
    # named style
    ("\\bibitem[\\protect\\citeauthoryear{Doe et al.}{Doe}{2022}]{vpt}\nJohn Doe, Ann Lee.\n\\newblock Video  pretraining.\n\\newblock 2022.",
     "vpt", "John Doe, Ann Lee.", "2022", "Video pretraining"),
    # et al. and et~al.
    ("\\bibitem{a}\nAngela Fan, et~al.\n\\newblock Herd of models, 2024.", "a", "Angela Fan,", "2024", "Herd of models, 2024"),
    # quoted style
    ("\\bibitem{q}\nJ. Wei, ``Chain of thought,'' in NeurIPS, 2022.", "q", "J. Wei, ``Chain of thought,'' in NeurIPS, 2022.", "2022", "Chain of thought"),
    # tagged style with nested braces and other scripts
    ("\\bibitem[Ț(2018)]{8363455}\n\\bibfield{author}{\\bibinfo{person}{Țoni B}, \\bibinfo{person}{Víctor~G}.} \\bibinfo{year}{2018}\n"
     "\\newblock \\showarticletitle{Analysis of feedback}.\n\\newblock", "8363455", "Țoni B, Víctor~G", "2018", "Analysis of feedback"),
    # one line only, one block only
    ("\\bibitem{z} \\newblock lonely", "z", None, None, "lonely"),
]


def test_items(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ITEMS)], "i int, x string").orderBy("i")
    got = [tuple(r) for r in df.select(bbl.item_key("x"), bbl.item_author("x"), bbl.item_year("x"), bbl.item_title("x")).collect()]
    assert got == [r[1:] for r in ITEMS]


def test_parse_bbl(spark):
    body = "\n".join(r[0].replace("]{8363455}", "]%\n        {8363455}") for r in ITEMS)
    doc = "junk \\bibitem{no}\n\\begin{thebibliography}{9}\npreamble\n" + body + "\n\\end{thebibliography}\\bibitem{after}\nX"
    files = spark.createDataFrame([(0, 0, doc), (1, 0, "no environment"), (2, 0, None)], "ord int, file_ord int, content string")
    got = bibliography.parse_bbl(files).orderBy("pos").collect()
    assert [r["key"] for r in got] == [r[1] for r in ITEMS]
    assert got[3]["fields"]["author"] == ITEMS[3][2]
    assert "raw" in got[0]["fields"] and {r["entry_type"] for r in got} == {"article"}


def test_renders_entry(spark):
    fields = {"title": "Test Title", "author": "Test Author", "raw": "x", "year": None}
    df = spark.createDataFrame([("testkey", "article", fields)], "key string, entry_type string, fields map<string,string>")
    out = bibliography.bibtex_text(df).first()[0]
    assert out == "@article{author_test_title,\n  author = {Test Author},\n  title = {Test Title},\n}\n\n"
    assert bibliography.bibtex_text(df.filter("false")).first()[0] == ""


def test_consolidation_is_last_wins_in_any_row_order(spark):
    rows = [(0, 0, 0, "k", "article", {"t": "a"}), (1, 0, 0, "k", "article", {"t": "c"}), (0, 1, 3, "k", None, {"t": "b"}), (0, 0, 1, "m", None, None)]
    schema = "ord int, file_ord int, pos int, key string, entry_type string, fields map<string,string>"
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema)
        assert {(r["key"], (r["fields"] or {}).get("t")) for r in bibliography.consolidate(df).collect()} == {("k", "c"), ("m", None)}
        per_paper = bibliography.consolidate(df, "paper").filter("key = 'k'").collect()
        assert {(r["ord"], r["fields"]["t"]) for r in per_paper} == {(0, "b"), (1, "c")}
    assert bibliography.consolidate(spark.createDataFrame([], schema)).count() == 0


def test_dedup_normalized(spark):
    rows = [("b", "article", {"author": "A", "title": "Word"}), ("a", "article", {"author": "A", "title": "Word"})]
    df = spark.createDataFrame(rows, "key string, entry_type string, fields map<string,string>")
    assert bibliography.rendered(df).count() == 2
    assert [r["key"] for r in bibliography.rendered(df, True).collect()] == ["a"]


def test_plain_expressions_only(spark):
    df = spark.createDataFrame([("k", {"title": "t"})], "key string, fields map<string,string>")
    plan = df.select(bibliography.normalized_key(), bibliography.arxiv_id())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert F is not None


def test_braced_arguments(spark):
    texts = ["a{b}c}d", "}", "a{b{c{d{e{f{g}}}}}}h}i", "never{closes}", "é\\{x}", None]
    assert column(spark, texts, bbl.braced_argument(F.col("x"))) == ["a{b}c", "", "a{b{c{d{e{f{g}}}}}}h", None, None, None]
    tagged = ["\\bibfield{author} {\\bibinfo{person}{A}}", "\\bibfield{author}{\\bibinfo{person}{A} \\bibinfo{person}{B}}"]
    assert column(spark, tagged, bbl.item_author("x")) == [None, "A, B"]


def test_fields(spark):
    df = spark.createDataFrame([("k", {"a": "1"}, "2"), ("k", None, "2"), ("m", {"a": "1"}, None)], "key string, fields map<string,string>, v string")
    got = [r[0] for r in df.select(bibliography.set_field("fields", "a", F.col("v"))).collect()]
    assert got == [{"a": "2"}, {"a": "2"}, {"a": "1"}]
    assert bibliography.get(df, "k").count() == 2
    assert bibliography.promoted(df, ("a",)).columns == ["key", "v", "a", "other_fields"]


def test_labels_over_several_lines(spark):
    from citeloom.config import Options

    doc = "\\begin{thebibliography}{9}\n\\bibitem[Cojocaru(2023)Cojocaru,\n  and Sanghai]{falcon40b}\nRuxandra Cojocaru, Ann Lee.\n\\newblock Falcon.\n\\end{thebibliography}"
    files = spark.createDataFrame([(0, 0, doc)], "ord int, file_ord int, content string")
    plain = bibliography.parse_bbl(files).first()
    fixed = bibliography.parse_bbl(files, Options(fix_label_lines=True)).first()
    assert plain["fields"]["author"] == "and Sanghai]{falcon40b}"  # the second physical line
    assert fixed["fields"]["author"] == "Ruxandra Cojocaru, Ann Lee." and fixed["key"] == "falcon40b"
    assert fixed["fields"]["title"] == plain["fields"]["title"] == "Falcon"
