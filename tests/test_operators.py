"""Sections, citations, verification, sources and the whole pipeline."""

import io
import json
import sys
import tarfile
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from citeloom import errors
from citeloom.cli import parser, write_outputs
from citeloom.config import Options
from citeloom.operators import citations, sections, skew, verification
from citeloom.plans import pipeline
from citeloom.sources import archive, fetch, latex_source
from citeloom.sources.bibtex import parse_entry
from citeloom.sources.dblp import read_hits
from citeloom.tool import survey_message

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stand-ins for services run in tasks

DOC = r"""\documentclass{article}
\section{Introduction} hello \cite{x}
\section{Related Work}
Prior \cite{lecun2015, goodfellow2016} and \citep{unknown,  lecun2015}.
\subsection{Background}
More \cite{vaswani2017}.
\section*{Previous Work} starred
\end{document}"""

BBL = r"""\begin{thebibliography}{9}
\bibitem{lecun2015}
Yann LeCun, Yoshua Bengio.
\newblock Deep learning.
\newblock Nature, 2015.

\bibitem{goodfellow2016}
Ian Goodfellow.
\newblock Deep learning book.
\newblock MIT Press, 2016. arXiv:1606.00001

\bibitem{vaswani2017}
Ashish Vaswani et al.
\newblock Attention is all you need.
\newblock 2017.
\end{thebibliography}"""


def latex(spark, text):
    return spark.createDataFrame([(0, "p", text)], "ord int, paper_id string, latex string")


def test_extract_sections(spark):
    got = sections.extract_sections(latex(spark, DOC)).orderBy("kind").collect()
    assert [(r["kind"], r["pos"], r["title"]) for r in got] == [("section", 1, "Related Work"), ("subsection", 0, "Background")]
    assert got[0]["citations"] == ["goodfellow2016", "lecun2015", "unknown", "vaswani2017"]
    assert "Previous Work" in got[1]["content"]  # a subsection runs on across sections
    assert len(sections.extract_sections(latex(spark, DOC), starred=True).collect()) == 3
    assert sections.extract_sections(latex(spark, None)).count() == 0
    assert sections.extract_sections(latex(spark, "")).count() == 0


def test_rewrite_folds_in_text_order(spark):
    rows = [(1, r"\cite{a} \cite{b,zz} \cite{a}"), (2, None), (3, "none"), (4, r"\citet{b}")]
    df = spark.createDataFrame(rows, "id long, content string")
    keys = spark.createDataFrame([("a", "b"), ("b", "c")], "key string, new string")
    got = {r["id"]: r["normalized"] for r in citations.rewrite(df, keys, "id").collect()}
    assert got == {1: r"\cite{b} \cite{c, zz} \cite{b}", 2: None, 3: "none", 4: r"\citet{c}"}
    cascade = spark.createDataFrame([(1, r"\cite{a} \cite{b}")], "id long, content string")
    assert citations.rewrite(cascade, keys, "id").first()["normalized"] == r"\cite{c} \cite{c}"
    mapping = F.create_map(F.lit("a"), F.lit("b"), F.lit("b"), F.lit("c"))
    assert cascade.select(citations.rewrite_with_map("content", mapping)).first()[0] == r"\cite{c} \cite{c}"


def test_missing(spark):
    s = spark.createDataFrame([(["a", "b", "", "b"],), (["b"],), (None,)], "citations array<string>")
    bib = spark.createDataFrame([("a",)], "key string")
    assert [tuple(r) for r in citations.missing(s, bib).collect()] == [("b", 2)]


def test_hot_keys_join_like_all_others(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    big = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2), ("x", 3)], "k string, v int")
    small = spark.createDataFrame([("h", "H", 50), ("c", "C", 1)], "k string, w string, n long")
    inner = skew.hot_first_join(big, small, "k", "n", 53)
    assert inner.count() == 51
    left = skew.hot_first_join(big, small, "k", "n", 53, "left")
    assert left.count() == 53 and left.filter("w IS NULL").count() == 2


def hit(title, year, authors=()):
    return {"info": {"title": title, "year": year, "authors": {"author": [{"text": a} for a in authors]}}}


def best(spark, fields, hits, total=None):
    doc = json.dumps({"result": {"hits": {"@total": str(len(hits) if total is None else total), "hit": hits}}})
    found = read_hits(spark.createDataFrame([("k", doc)], "key string, json string"))
    entries = spark.createDataFrame([("k", fields)], "key string, fields map<string,string>")
    row = verification.best_matches(entries, found).first()
    return row and (row["info"]["title"], row["score"])


ENTRY = {"author": "Garcia, Maria", "title": "Artificial {I}ntelligence Applications", "year": "2023"}


def test_best_match(spark):
    assert best(spark, ENTRY, [hit("AI Applications", "2023"), hit("artificial intelligence applications", "2023")]) == (
        "artificial intelligence applications", 4)
    # the first of equal scores wins; a substring scores two
    assert best(spark, ENTRY, [hit("Artificial Intelligence Applications!", "1"), hit("Intelligence", "1")])[0].endswith("!")
    assert best(spark, ENTRY, [hit("Something else", "2023")]) is None
    assert best(spark, ENTRY, []) is None
    assert best(spark, ENTRY, [hit("Artificial Intelligence Applications", "2023")], total=0) is None
    # one hit without a year voids all
    assert best(spark, ENTRY, [hit("Artificial Intelligence Applications", "2023"), {"info": {"title": "x"}}]) is None
    words = {"author": "John Michael Smith and Mary Elizabeth Johnson", "title": "Research Study", "year": "2023"}
    assert best(spark, words, [hit("Different Study", "2023", ["John Smith", "Mary Johnson"])]) == ("Different Study", 3)
    assert best(spark, {"title": "t", "year": "1"}, [hit("t", "1")]) is None
    assert read_hits(spark.createDataFrame([("k", "{broken"), ("m", None)], "key string, json string")).count() == 0


def test_verify_prefers_arxiv_and_keeps_raw(spark):
    schema = "key string, arxiv_id string, fields map<string,string>"
    rows = [("a", "1", {**ENTRY, "raw": "r"}), ("b", None, dict(ENTRY)), ("c", None, {"raw": "only"})]
    arxiv = spark.createDataFrame([("1", "@misc{z, title={New}, author={A B}, raw={no}}"), ("9", None)], "arxiv_id string, bibtex string")
    doc = json.dumps({"result": {"hits": {"@total": "1", "hit": [hit("Artificial Intelligence Applications", "2023", ["Maria Garcia 0001"])]}}})
    hits = read_hits(spark.createDataFrame([("a", doc), ("b", doc)], "key string, json string"))
    got = {r["key"]: r for r in verification.verify(spark.createDataFrame(rows, schema), arxiv, hits).collect()}
    assert got["a"]["fields"]["title"] == "New" and got["a"]["fields"]["raw"] == "r"
    assert got["a"]["fields"]["verified_source"] == "arXiv"
    assert got["b"]["fields"]["author"] == "Maria Garcia" and got["b"]["fields"]["verified_source"] == "DBLP"
    assert not got["c"]["verified"] and got["c"]["fields"] == {"raw": "only"}
    stats = verification.stats(verification.verify(spark.createDataFrame(rows, schema), None, None)).first()
    assert tuple(stats) == (3, 0, 0, 0)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("@inproceedings{t, title = {Topics in {M L}}, year = 2023}", ("t", "inproceedings", {"title": "Topics in {M L}", "year": "2023"})),
        ('@article{e, author = "", note = {}, title = "Valid @#$"}', ("e", "article", {"author": "", "note": "", "title": "Valid @#$"})),
        ("@article{m,\n title={A\n  B},\n}", ("m", "article", {"title": "A\n  B"})),
        ('@string{x = "J"} @misc{k, journal = x # " of" # { Y}}', ("k", "misc", {"journal": "J of Y"})),
        ("not bibtex", None),
        ("@article", None),
        ("@article{open, title = {never", None),
        (None, None),
    ],
)
def test_bibtex(text, expected):
    assert parse_entry(text) == expected


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    files = {"main.tex": b"x", "sub/a.bbl": "é".encode(), "fig.png": b"\xff", "../up.tex": b"no"}
    for pack in (tar, zipped):
        df = spark.createDataFrame([("p", bytearray(pack(files)))], "paper_id string, content binary")
        assert {(r["path"], r["content"]) for r in archive.read_files(df).collect()} == {("main.tex", "x"), ("sub/a.bbl", "é")}
    bad = spark.createDataFrame([("p", bytearray(b"junk")), ("q", bytearray(tar({"m.tex": b"\xff"}))), ("r", None)], "paper_id string, content binary")
    assert archive.read_files(bad, permissive=True).filter("error IS NOT NULL").count() == 3
    with pytest.raises(Exception):
        archive.read_files(bad).collect()


def test_root_choice_and_includes(spark):
    schema = "ord int, paper_id string, path string, content string"
    rows = [
        (0, "a", "z.tex", "x"), (0, "a", "article.tex", "y"), (0, "a", "main.tex", "z"),
        (1, "b", "b.tex", "plain"), (1, "b", "c/d.tex", "\\documentclass"), (1, "b", "c/d/e.tex", "\\documentclass"),
        (2, "c", "sub/main.tex", "q"), (3, "d", "x.bbl", "none"),
    ]
    got = {r["ord"]: r["path"] for r in latex_source.main_files(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: "main.tex", 1: "c/d.tex", 2: "sub/main.tex"}
    texts = {"main.tex": "A\\input{i}B\\include{i.tex}C\\input{gone}D\\input{/etc/x}", "i.tex": "<\\input{main}\\input{s/j}>", "s/j.tex": "j"}
    assert latex_source.expand(texts, "main.tex") == "A<j>BCD"
    deep = {f"{i}.tex": f"{i % 10}\\input{{{i + 1}}}" for i in range(3000)}
    assert len(latex_source.expand(deep, "0.tex")) == 3000


def arxiv_table(spark):
    return spark.createDataFrame([
        ("p1", "@misc{a, title={Paper One}, author={Ann Lee}}"),
        ("1606.00001", "@book{g, title={Deep Learning}, author={Goodfellow, Ian}, year={2016}}"),
    ], "arxiv_id string, bibtex string")


def test_pipeline(spark):
    archives = spark.createDataFrame(
        [("p1", bytearray(tar({"main.tex": DOC.encode(), "main.bbl": BBL.encode()})))], "paper_id string, content binary"
    )
    out = pipeline.extract_survey(spark, ["p1"], archives, arxiv_table(spark))
    assert out["survey_text"].startswith("% Paper ID: p1\n% Title: Paper One\n% Authors: Ann Lee\n\n\\section{Related Work}\n\n")
    assert r"\cite{lecun_deep_learning_2015, goodfellow_deep_learning_2016}" in out["survey_text"]
    assert r"\citep{unknown, lecun_deep_learning_2015}" in out["survey_text"]
    assert "  verified_source = {arXiv},\n" in out["bibtex"] and out["bibtex"].count("@article{") == 3
    scoped = pipeline.extract_survey(spark, ["p1", "p1"], archives, arxiv_table(spark), options=Options(scope="paper"))
    assert scoped["survey_text"] == out["survey_text"] * 2


def test_pipeline_errors(spark):
    archives = spark.createDataFrame([("p1", bytearray(tar({"x.bbl": b"y"})))], "paper_id string, content binary")
    with pytest.raises(errors.NoPaperIdsProvided, match="^No paper IDs provided$"):
        pipeline.extract_survey(spark, [], archives, arxiv_table(spark))
    with pytest.raises(errors.ApiError, match="No source for q"):
        pipeline.extract_survey(spark, ["q"], archives, arxiv_table(spark))
    with pytest.raises(errors.ApiError, match="No LaTeX main file"):
        pipeline.extract_survey(spark, ["p1"], archives, arxiv_table(spark))
    out = pipeline.extract_survey(spark, ["q"], archives, arxiv_table(spark), options=Options(permissive=True))
    assert out == {"survey_text": "% Paper ID: q\n% Title: Unknown Title\n% Authors: Unknown Authors\n\n", "bibtex": ""}


SHARED = r"""\documentclass{article}
\section{Related Work} See \cite{b1}. \input{rel.txt}
\input{figure.png}"""


def shared_bbl(author, title):
    return "\\begin{thebibliography}{9}\n\\bibitem{b1}\n" + author + ".\n\\newblock " + title + ".\n\\newblock 2016.\n\\end{thebibliography}"


WORKS = {  # an answer of arXiv that cannot be read leaves the entry to the search
    "p1": ("Ann Lee, Bo Ek. arXiv:1606.00009", "Streams of Many Rivers"),
    "p2": ("Cy Dor, Di Fenn", "Lattices in Deep Water"),
    "p3": ("Ann Lee, Bo Ek", "Streams of Many Rivers"),
}


def web(url):
    """A stand-in for both services."""
    name = url.rsplit("/", 1)[-1]
    if "/e-print/" in url:
        author, title = WORKS[name]
        return tar({"main.tex": SHARED.replace("\\input{figure.png}", "").encode(), "rel.txt": b"As \\citet{b1} say.", "m.bbl": shared_bbl(author, title).encode()})
    if "/bibtex/1606" in url:
        return b"@misc{x, title = {never ends, author"
    if "/bibtex/" in url:
        return f"@misc{{x, title={{Paper {name}}}, author={{A B}}}}".encode()
    title = url.split("q=")[1].split("&")[0].replace("+", " ")
    return json.dumps({"result": {"hits": {"@total": "2", "hit": [hit("Another thing", "2016"), hit(title, "2016", ["From Web 0001"])]}}}).encode()


def test_verification_end_to_end(spark, tmp_path):
    """Papers that share a cite key for different works get the answers of their own works, each asked for once."""
    online = pipeline.Sources(get=web)
    out = pipeline.extract_survey(spark, list(WORKS), sources=online, options=Options(scope="paper", api_timeout_secs=0.0))
    assert out["survey_text"].count("\\cite{web_streams_many_rivers_2016}") == 2
    assert out["survey_text"].count("\\cite{web_lattices_deep_water_2016}") == 1
    assert out["survey_text"].count("As \\citet{web_") == 3 and "% Title: Paper p2" in out["survey_text"]
    assert out["bibtex"].count("verified_source = {DBLP}") == 3
    # The same from tables: answers by search, then records to search in.
    archives = spark.createDataFrame([(p, bytearray(web(f"x/e-print/{p}"))) for p in WORKS], "paper_id string, content binary")
    arxiv = spark.createDataFrame([(p, web(f"x/bibtex/{p}").decode()) for p in (*WORKS, "1606.00009")], "arxiv_id string, bibtex string")
    queries = sorted({t.replace(" ", "+") for _, t in WORKS.values()})
    answers = spark.createDataFrame([(q, web(f"x?q={q}&").decode()) for q in queries], "query string, json string")
    options = Options(scope="paper")
    assert pipeline.extract_survey(spark, list(WORKS), archives, arxiv, answers, options) == out
    from citeloom.schemas import DBLP_INFO

    hits = [(i, (t, "2016", None, None, None, None, ([("From Web 0001",)],))) for i, (_, t) in enumerate(dict.fromkeys(WORKS.values()))]
    records = spark.createDataFrame(hits, f"hit_id long, info {DBLP_INFO}")
    found = pipeline.extract_survey(spark, list(WORKS), options=options, sources=pipeline.Sources(archives, arxiv, records=records, offline=True))
    assert found == out
    from citeloom import extract_survey

    mirror = tmp_path / "mirror"
    mirror.mkdir()
    for p in WORKS:
        (mirror / f"{p}.tar.gz").write_bytes(web(f"x/e-print/{p}"))
    arxiv.write.parquet(str(tmp_path / "arxiv"))
    records.write.parquet(str(tmp_path / "dblp"))
    given = {"mirror": str(mirror), "arxiv_table": str(tmp_path / "arxiv"), "dblp_table": str(tmp_path / "dblp"), "offline": True}
    assert extract_survey(list(WORKS), Options(scope="paper", **given), spark) == out


def test_failures_of_tasks_keep_their_kind(spark):
    def broken(url):
        if "/e-print/" in url:
            return b"junk"
        return web(url)

    with pytest.raises(errors.ArchiveError):
        pipeline.extract_survey(spark, ["p1"], sources=pipeline.Sources(get=broken))
    with pytest.raises(errors.ApiError, match="Empty response for p1"):
        pipeline.extract_survey(spark, ["p1"], sources=pipeline.Sources(get=lambda u: b""))

    def silent(url):
        raise OSError("no route")

    with pytest.raises(errors.NetworkError, match="no route"):
        pipeline.extract_survey(spark, ["p1"], sources=pipeline.Sources(get=silent))
    archives = spark.createDataFrame([("p1", bytearray(web("x/e-print/p1")))], "paper_id string, content binary")
    with pytest.raises(errors.ApiError, match="BibTeX of p1"):  # a paper that arXiv does not describe
        pipeline.extract_survey(spark, ["p1"], archives, arxiv_table(spark).filter("arxiv_id <> 'p1'"))


def test_files_of_any_name_are_included(spark):
    files = {"main.tex": SHARED.encode(), "rel.txt": b"rest \\input{more.inc}", "more.inc": b"end", "other.txt": b"no", "figure.png": b"png"}
    assert dict(archive.text_members(zipped(files))).keys() == {"main.tex", "rel.txt", "more.inc", "figure.png"}
    text, included = latex_source.expand_listed({p: t.decode() for p, t in files.items()}, "main.tex")
    assert text.endswith("rest end\npng") and included == ["rel.txt", "more.inc", "figure.png"]
    df = spark.createDataFrame([(0, "p", "main.tex", "\\documentclass\\input{a}"), (0, "p", "a.tex", "A")], "ord int, paper_id string, path string, content string")
    assert latex_source.expand_includes(df).first()["included"] == ["a.tex"]


def test_of_several_archives_of_a_paper_one_is_read(spark):
    both = [("p", bytearray(tar({"main.tex": b"one", "x.tex": b"x"}))), ("p", bytearray(zipped({"main.tex": b"two"}))), ("p", bytearray(b"junk"))]
    df = spark.createDataFrame(both, "paper_id string, content binary")
    got = archive.one_archive(archive.read_files(df, permissive=True)).collect()
    assert {(r["path"], r["content"]) for r in got} in ({("main.tex", "one"), ("x.tex", "x")}, {("main.tex", "two")})


def test_unicode_white_space(spark):
    doc = "\\section\u00a0{Related Work} x \\cite{a}"
    assert sections.extract_sections(latex(spark, doc)).first()["title"] == "Related Work"
    from citeloom.operators import bibliography

    df = spark.createDataFrame([("k", {"raw": "see arXiv:\u00a02305.15030"})], "key string, fields map<string,string>")
    assert df.select(bibliography.arxiv_id()).first()[0] == "2305.15030"


def test_word_sets_meet_like_brute_force(spark, monkeypatch):
    import itertools
    import random

    from citeloom.operators import similarity

    r = random.Random(6)
    vocabulary = [f"{a}{b}" for a in "abcdef" for b in ("x", "yy", "zzz", "wwww")]
    left, right = ([r.sample(vocabulary, r.randint(0, 9)) for _ in range(150)] for _ in range(2))
    a, b = (spark.createDataFrame([(" ".join(w),) for w in side] + [(None,)], "t string").select(similarity.word_set("t").alias("words")) for side in (left, right))
    sets = [{frozenset(w) for w in side if w} for side in (left, right)]
    for least, side in ((0.5, 10**6), (0.5, 3), (0.6, 10**6), (1.0, 10**6)):
        monkeypatch.setattr(skew, "SIDE", side)
        expected = {(x, y) for x, y in itertools.product(*sets) if len(x & y) >= least * len(x | y)}
        got = [(frozenset(x["a"]), frozenset(x["b"])) for x in similarity.similar_sets(a, b, least).collect()]
        assert set(got) == expected and len(got) == len(expected) and expected


def test_large_blocks_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(skew, "SIDE", 10)
    monkeypatch.setattr(skew, "HOT_ROWS", 30)
    a = spark.createDataFrame([("h", i) for i in range(95)] + [("c", 1), (None, 2)], "k string, x int")
    b = spark.createDataFrame([("h", i) for i in range(42)] + [("c", 7), (None, 3)], "k string, y int")
    got = [(x["k"], x["x"], x["y"]) for x in skew.split_join(a, b, "k").collect()]
    assert len(got) == len(set(got)) == 95 * 42 + 1


def test_small_keys_are_not_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(skew, "SIDE", 20)
    written = []
    write = skew.materialise
    monkeypatch.setattr(skew, "materialise", lambda df, name: written.append((name, t := write(df, name))) or t)
    small = [(f"k{i % 300}", i) for i in range(600)] + [(None, i) for i in range(50)]  # NULL joins nothing and fills no bucket
    large = [("h", i) for i in range(45)]
    b = spark.createDataFrame([(f"k{i}", -i) for i in range(200)] + [("h", 1), ("h", 2), (None, 3)], "k string, y int")
    got = [tuple(x) for x in skew.split_join(spark.createDataFrame(small, "k string, x int"), b, "k").collect()]
    assert sorted(got) == sorted((k, x, -int(k[1:])) for k, x in small if k and int(k[1:]) < 200)
    assert [name for name, _ in written] == ["buckets"]
    got = [tuple(x) for x in skew.split_join(spark.createDataFrame(small + large, "k string, x int"), b, "k").collect()]
    assert len(got) == len(set(got)) == 400 + 2 * 45
    assert [x["k"] for x in written[-1][1].collect()] == ["h"]


def test_hot_rows_too_large_to_broadcast_are_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "HOT_BYTES", 10)
    big = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2), ("x", 3)], "k string, v int")
    small = spark.createDataFrame([("h", "H" * 99, 50), ("c", "C", 1)], "k string, w string, n long")
    assert skew.hot_first_join(big, small, "k", "n", 53).count() == 51
    left = skew.hot_first_join(big, small, "k", "n", 53, "left")
    assert left.count() == 53 and left.filter("w IS NULL").count() == 2
    with pytest.raises(ValueError):
        monkeypatch.setattr(skew, "HOT_SHARE", 0)
        monkeypatch.setattr(skew, "hot_threshold", lambda rows: 1)
        skew.hot_first_join(big, small, "k", "n", 53)


def test_records_answer_searches(spark):
    """A typing error or another article in front loses no record, and equal scores go to the smaller id."""
    from citeloom.schemas import DBLP_INFO

    rec = lambda i, t, y="2016": (i, (t, y, None, f"u{i}", None, None, None))
    records = spark.createDataFrame([rec(1, "The deep parsing of many rivers"), rec(2, "Deep parsing of many rivers"), rec(3, "Deep parsing of many rivers"), rec(4, None), rec(5, "Other things"), rec(6, "Void of year entirely", None)], f"hit_id long, info {DBLP_INFO}")
    rows = [(1, "Depe parsing of many rivers"), (2, "Deep Parsing of Many Rivers"), (3, "nothing"), (4, "..."), (5, "Void of year entirely")]
    entries = spark.createDataFrame([(i, {"title": t, "year": "2016", "author": "A"}) for i, t in rows] + [(9, {"title": "Other things"}), (10, None)], "key long, fields map<string,string>")
    got = {r["key"]: (r["info"]["url"], r["score"]) for r in verification.search_matches(entries, records).collect()}
    assert got == {1: ("u1", 2), 2: ("u2", 4)}


def test_tool_server():
    from citeloom import tool

    class Library:
        def __init__(self, name):
            self.tools = {}
            Library.last = self

        def tool(self, name, description):
            return lambda f: self.tools.setdefault(name, f)

        def run(self):
            self.ran = True

    tool.serve(lambda ids: {"survey_text": ids[0], "bibtex": "b"}, Library)
    assert Library.last.ran and Library.last.tools["arvix_survey"]("7") == "Related work:\n7\n\nBibliography:\nb"


def test_error_messages():
    assert str(errors.InvalidArxivId("123")) == "Invalid arXiv ID: 123"
    assert str(errors.BibtexParsingError()) == "Failed to parse BibTeX entry"
    assert str(errors.ApiError("x")) == "API error: x"
    assert str(errors.wrapped(ValueError("odd"))) == "Unknown error"
    assert str(errors.wrapped(FileNotFoundError("file not found"))) == "I/O error: file not found"
    assert isinstance(errors.wrapped(zipfile.BadZipFile("x")), errors.ArchiveError)
    assert str(errors.NetworkError("x")).startswith("Network request failed")


def test_fetchers_retry_within_their_budget():
    waits, calls = [], []

    def get(url):
        calls.append(url)
        raise OSError("no answer")

    options = Options(api_timeout_secs=3.0)
    assert fetch.fetch_bibtex("1", options, get, waits.append) is None
    assert len(calls) > 3 and sum(waits) <= 3.0 and max(waits) <= 7.5
    good = json.dumps({"result": {"hits": {"@total": "1", "hit": [{}]}}}).encode()
    assert fetch.fetch_dblp("A+B", options, lambda u: good if "q=A+B&" in u else b"", waits.append)
    assert fetch.fetch_dblp(None, options, get) is None
    n = len(waits)  # an answer that is of no use is not asked for again, one that cannot be read is
    assert fetch.fetch_bibtex("1", options, lambda u: b"nothing", waits.append) is None
    assert fetch.fetch_dblp("A", options, lambda u: b'{"result": {"hits": {"@total": "0"}}}', waits.append) is None
    assert len(waits) == n and fetch.fetch_dblp("A", options, lambda u: b"{", waits.append) is None and len(waits) > n
    with pytest.raises(errors.ApiError):
        fetch.fetch_archive("1", options, lambda u: b"")


def test_cli_and_tool(tmp_path, capsys):
    a = parser().parse_args(["-p", "1", "2", "-p", "3", "-o", str(tmp_path / "out.old")])
    assert a.paper_ids == ["1", "2", "3"]
    write_outputs({"survey_text": "s", "bibtex": "b"}, a.output)
    assert (tmp_path / "out.tex").read_text() == "s" and (tmp_path / "out.bib").read_text() == "b"
    write_outputs({"survey_text": "s", "bibtex": "b"}, None)
    assert capsys.readouterr().out == "--- survey.tex ---\ns\n--- bibliography.bib ---\nb\n"
    assert survey_message("1", lambda ids: {"survey_text": "s", "bibtex": "b"}) == "Related work:\ns\n\nBibliography:\nb"
    assert survey_message("1", lambda ids: 1 / 0).startswith("Error processing arXiv paper 1: division")


def test_streaming_ingest(spark, tmp_path):
    from citeloom.streaming import ingest

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "p1.tar.gz").write_bytes(tar({"main.tex": DOC.encode(), "main.bbl": BBL.encode()}))
    (inbox / "bad.zip").write_bytes(b"junk")
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.watch(spark, str(inbox)), out, str(tmp_path / "state"), once=True).awaitTermination()
    assert spark.read.parquet(f"{out}/sections").count() == 2
    assert spark.read.parquet(f"{out}/bib").filter("paper_id = 'p1'").count() == 3
    assert [r["paper_id"] for r in spark.read.parquet(f"{out}/errors").collect()] == ["bad"]


def test_fetchers_in_tasks(spark):
    options = Options(api_timeout_secs=0.0)
    papers = archive.paper_list(spark, ["a", "b", "a"])
    got = fetch.archives(papers, options, lambda u: u.rsplit("/", 1)[-1].encode()).collect()
    assert sorted((r["paper_id"], bytes(r["content"])) for r in got) == [("a", b"a"), ("b", b"b")]
    ids = papers.selectExpr("paper_id AS arxiv_id")
    answers = fetch.bibtex(ids, options, lambda u: b"@x{author title}" if u.endswith("a") else b"").collect()
    assert {r["arxiv_id"]: r["bibtex"] for r in answers} == {"a": "@x{author title}", "b": None}
    queries = spark.createDataFrame([("T 1",), (None,)], "query string")
    found = {r["query"]: r["json"] for r in fetch.dblp(queries, options, lambda u: b'{"result": {"hits": {"@total": "0"}}}').collect()}
    assert found == {"T 1": None, None: None}


def test_windowed_citation_counts(spark, data, tmp_path):
    import shutil

    from citeloom.streaming import ingest

    shutil.copy(f"{data}/sections.parquet", tmp_path / "part-0.parquet")
    batch = spark.read.parquet(str(tmp_path))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path))
    query = (
        ingest.citation_counts(stream, "1 day", "30 days").writeStream.format("memory").queryName("counts").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    total = batch.select(F.explode("citations")).count()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == total
