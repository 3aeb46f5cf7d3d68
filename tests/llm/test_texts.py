"""Operators on texts: problems 3, 7, 8 and 9."""

import random
import time
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import leakage, packing, pii, splitting

DOCS = "doc_id long, text string, words int, tokens int, pii_text string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0, "clash") for i, t in rows], DOCS)


# ---------------------------------------------------------------- problem 3


def whole(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, _, _) in zip(pieces, pieces[1:]):
        assert c == max(0, b - overlap)
    assert all(b - a <= limit for a, b, _ in pieces)
    ends = [p[1] for p in pieces]
    assert ends == sorted(set(ends))
    assert "".join(text[(ends[i - 1] if i else 0) : e] for i, e in enumerate(ends)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n\té。\\{}", max_size=400), st.integers(12, 60))
def test_split_round_trip(text, limit):
    pieces = splitting.split_text(text, limit, 5)
    whole(text, pieces, limit, 5)
    longest = splitting.longest_run(text)
    if longest <= limit - 5:  # no word needs cutting
        assert all(kind != "word part" for _, _, kind in pieces)


def test_split_prefers_strong_boundaries():
    para = "One two three four. " * 10
    text = (para + "\n\n") * 6
    pieces = splitting.split_text(text, 500, 50)
    whole(text, pieces, 500, 50)
    assert {k for _, _, k in pieces[:-1]} == {"paragraph"}
    for n in (500, 501, 20_000):
        whole("x" * n, splitting.split_text("x" * n, 500, 50), 500, 50)
    with pytest.raises(ValueError):
        splitting.split_text("x", 10, 10)


def test_pieces(spark):
    rows = [(1, "a" * 30), (2, "word " * 20), (3, ""), (4, None), (5, "short"), (5, "short"), (None, "b" * 30), (1 << 60, "word " * 20)]
    got = splitting.pieces(documents(spark, rows), "doc_id", "text", 25, 5).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        by.setdefault(r["doc_id"], []).append(r)
    assert {k: v[0]["cut"] for k, v in by.items()} == {1: "forced", 2: "clean", 3: "clean", 5: "clean", None: "forced", 1 << 60: "clean"}
    assert [r["text"] for r in by[3]] == [""] and len(by[5]) == 2
    assert all(r["text"] == (dict(rows)[r["doc_id"]])[r["start"] : r["start"] + r["size"]] for r in got)
    assert splitting.pieces(documents(spark, []), "doc_id", "text").count() == 0


# ---------------------------------------------------------------- problem 7


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_plan_uses_every_length_once(histogram):
    used = Counter()
    for times, pattern in packing.plan(histogram, 64):
        assert times > 0 and sum(s * k for s, k in pattern) <= 64
        for s, k in pattern:
            used[s] += times * k
    assert used == Counter(histogram)


def test_plan_fills_well():
    r = random.Random(1)
    histogram = Counter(min(2048, max(1, int(r.lognormvariate(5.3, 1)))) for _ in range(20_000))
    plan = packing.plan(histogram)
    opened = sum(t for t, _ in plan)
    assert sum(s * n for s, n in histogram.items()) / (2048 * opened) > 0.999
    assert packing.plan({60: 1, 40: 3, 25: 2, 35: 2}, 100)[0] == (1, ((60, 1), (40, 1)))
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


@pytest.mark.skipif(not Path(packing.TOKENIZER).exists(), reason="no tokenizer file")
def test_containers(spark):
    r = random.Random(4)
    rows = [(i, " ".join("token" for _ in range(r.randint(0, 90)))) for i in range(200)] + [(900, "long word " * 150), (901, None), (902, ""), (7, "twice"), (None, "no id")]
    got = packing.containers(documents(spark, rows).repartition(5), capacity=64).collect()
    encode = packing.encoder(Path(packing.TOKENIZER).read_bytes()).encode
    size, load = Counter(), Counter()
    for x in got:
        size[x["doc_id"]] += x["tokens"]
        load[x["container"]] += x["tokens"]
    assert max(load.values()) <= 64
    assert set(load) == set(range(max(load) + 1))
    expected = Counter()
    for i, t in rows:
        expected[i] += len(encode(t or ""))
    assert size == expected
    for i, t in rows:
        if i != 7 and len(encode(t or "")) <= 64:
            assert sum(x["doc_id"] == i for x in got) == 1
    assert sum(load.values()) / (64 * len(load)) > 0.97
    assert packing.containers(documents(spark, []), capacity=64).count() == 0
    full = packing.fill(documents(spark, rows), capacity=64).collect()
    assert sum(x["used"] for x in full) == sum(load.values())


# ---------------------------------------------------------------- problem 8

WORDS = [f"w{i}" for i in range(400)]


def brute_longest(doc, item, apart=10):
    """Longest window of equal length on any diagonal, first and last words equal, misses at least ``apart`` apart."""
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        hits = [0 <= j + shift < len(doc) and doc[j + shift] == item[j] for j in range(len(item))]
        for a in range(len(item)):
            if not hits[a] or not 0 <= a + shift < len(doc):
                continue
            last = None
            for b in range(a, len(item)):
                if not 0 <= b + shift < len(doc):
                    break
                if hits[b]:
                    best = max(best, b - a + 1)
                else:
                    if last is not None and b - last < apart:
                        break
                    last = b
    return best


def test_leaks_like_brute_force():
    r = random.Random(8)
    items = [(i, " ".join(r.choices(WORDS, k=r.randint(15, 60)))) for i in range(25)]
    tables = leakage.WuManber(items)
    seen = Counter()
    for _ in range(250):
        name, text = r.choice(items)
        w = text.split()
        k = r.randint(10, len(w))
        at = r.randint(0, len(w) - k)
        part = w[at : at + k]
        for j in range(r.randint(0, 3), k, r.choice([8, 9, 10, 11, 100])):
            part[j] = "other"
        doc = r.choices(WORDS, k=r.randint(0, 15)) + part + r.choices(WORDS, k=r.randint(0, 15))
        got = tables.leaks(" ".join(doc))
        expected = {i: n for i, t in items if (n := brute_longest(doc, t.split())) >= 20}
        assert got == expected
        seen[bool(expected)] += 1
    assert min(seen.values()) > 40


def test_leaked(spark):
    item = "The Quick brown fox jumps over a lazy dog while seven planners count eleven marbles beside the old river and then leave quietly"
    w = item.split()
    lines = "\n".join("+ # " + " ".join(w[i : i + 4]).upper() for i in range(0, len(w), 4))
    hunk = "\n".join(["-// " + " ".join(w[:9]) + ",", "@@ -1,2 +3,4 @@", " * " + " ".join(w[9:])])
    rows = [(1, "x\n" + lines), (1, "x\n" + lines), (2, hunk), (3, " ".join(w[:19])), (4, None), (5, ""), ((1 << 60) + 1, item), (None, item), (6, " ".join(["swap" if i == 10 else x for i, x in enumerate(w)]))]
    items = spark.createDataFrame([(10, item, "s"), (10, item, "s"), (11, None, "s"), (12, "", "s"), (None, "x", "s")], "item_id long, item_text string, words string")
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in leakage.leaked(documents(spark, rows), items).collect()}
    assert got == {(1, 10): len(w), (2, 10): len(w), (6, 10): len(w), ((1 << 60) + 1, 10): len(w), (None, 10): len(w)}
    assert leakage.leaked(documents(spark, rows), items.filter("false")).count() == 0
    assert leakage.leaked(documents(spark, []), items).count() == 0


@pytest.mark.parametrize("side", [10**6, 20])
def test_many_items_leak_like_few(spark, monkeypatch, side):
    """Over 5,000 items, whose buckets stay distributed, against one table of all; a stock phrase stands in a third of both."""
    from citeloom.operators import skew

    monkeypatch.setattr(skew, "SIDE", side)
    r = random.Random(18)
    stock = " ".join(r.choices(WORDS, k=12))
    texts = [" ".join(r.choices(WORDS, k=r.randint(18, 30))) + (f" {stock}" if i % 3 == 0 else "") for i in range(5200)]
    items = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, "")]
    rows = []
    for i in range(120):
        w = r.choice(texts).split()
        at = r.randint(0, 3)
        part = w[at : at + r.randint(15, 30)]
        if len(part) > 14:
            part[r.randint(0, len(part) - 1)] = "other"
        rows.append((i // 2 if i % 7 else None, " ".join(r.choices(WORDS, k=8) + part + r.choices(WORDS, k=8)) + (f" {stock}" if i % 3 else "")))
    table = spark.createDataFrame(items, "item_id long, item_text string")
    got = [tuple(x) for x in leakage.leaked_from_many(documents(spark, rows), table.filter("item_text IS NOT NULL")).collect()]
    tables = leakage.WuManber(items)
    expected = {}
    for d, t in rows:
        for i, n in tables.leaks(t).items():
            expected[d, i] = max(n, expected.get((d, i), 0))
    assert {(d, i): n for d, i, n in got} == expected and len(got) == len(expected) > 40
    monkeypatch.setattr(leakage, "TABLE_BYTES", 10)
    small = leakage.leaked(documents(spark, rows[:10]), table)
    assert {(x["doc_id"], x["item_id"]) for x in small.collect()} == {(d, i) for d, t in rows[:10] for i in tables.leaks(t)}


# ---------------------------------------------------------------- problem 9

TEXT = """commit 497eb66076f8abb1e71ac11ace88d8c3d63993fb
Author: Jean-Luc O'Rumelustath <jean-luc+git@alumni.oxbow.example>
Reporter: Klurep, Margaret, (617) 555-0162, klurep80@inbox.example; lives at Apt 2C, 155 Pellingham Ave, Lower Tindle 40707
Co-authored-by: lintbot <no-reply@bots.example>
Based on an idea by dimitra jopogrupan.
questions -> yoce-druyuzidar (at) staff.harbor.test
Geocoder failed for 9 Kosizowood St., Gitusville again.
index 9fe1445..f97fde7 100644
@@ -652,7 +652,7 @@
+Dejay B. Docolesun|dejay@post.test|+44 20 7946 0428|165 bis, rue de Dunleary, 52833 Montbriel
+NASTABRO+GIT@POST.TEST;2021;active
-# SSN = 961-33-3791
+INSERT INTO staff VALUES ('Steuer-ID', '00778002267');
-DB_URL=postgres://svc:6KUrwjgccNA6hsNF@db.internal.invalid/main
 @oxbow/core@4.1.0 replaces icon@2x.png
 git@code.quill.invalid:core/web.git was moved
 Listed on dev-list@lists.example as usual
 epoch 1699912345, checksum 4155-9021-7733
 uuid 7f3a0c11-2021-4d55-9b01-0a55501423ff
 build 20231187 took 5550142 ms on 192.0.2.14
 the Street Lane module moved to 12 shards
 Copper Finch is the name of the next release
 pager 0012025550119\r
 odette [at] mail [dot] quill [dot] example
"""
FOUND = {
    ("name", "Jean-Luc O'Rumelustath"), ("email", "jean-luc+git@alumni.oxbow.example"), ("name", "Klurep, Margaret"),
    ("phone", "(617) 555-0162"), ("email", "klurep80@inbox.example"), ("address", "Apt 2C, 155 Pellingham Ave, Lower Tindle 40707"),
    ("name", "dimitra jopogrupan"), ("email", "yoce-druyuzidar (at) staff.harbor.test"), ("address", "9 Kosizowood St., Gitusville"),
    ("name", "Dejay B. Docolesun"), ("email", "dejay@post.test"), ("phone", "+44 20 7946 0428"),
    ("address", "165 bis, rue de Dunleary, 52833 Montbriel"), ("email", "NASTABRO+GIT@POST.TEST"), ("id_number", "961-33-3791"),
    ("id_number", "00778002267"), ("phone", "0012025550119"), ("email", "odette [at] mail [dot] quill [dot] example"),
}


def test_finds_and_redacts(spark):
    rows = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (4, "nothing here\n" * 5000), (5, "a@b.test" * 3000), (None, "nothing")]
    got = [tuple(r) for r in pii.found(documents(spark, rows)).filter("doc_id < 5 OR doc_id IS NULL").collect()]
    assert len(got) == len(set(got))
    assert {(k, x) for d, k, x in got if d == 1} == FOUND and all(d == 1 for d, _, _ in got)
    out = {r["doc_id"]: r for r in pii.redacted(documents(spark, rows[1:])).collect()}
    assert out[2]["text"] is None and out[3]["text"] == "" and out[4]["text"] == rows[4][1]
    red = out[1]["text"]
    assert out[1]["n_replaced"] == len(FOUND) and not any(x in red for _, x in FOUND)
    assert "+[NAME]|[EMAIL]|[PHONE]|[ADDRESS]\n" in red and "Author: [NAME] <[EMAIL]>" in red
    assert "icon@2x.png" in red and red.count("\n") == TEXT.count("\n")
    assert pii.found(documents(spark, [])).count() == 0 and pii.redacted(documents(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab@.(at)[]+- \n0123456789|:", max_size=200))
def test_spans_never_overlap(text):
    spans = pii.Finder().spans(text)
    assert all(a < b for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert pii.redact_text(pii.Finder(), text).count("\n") == text.count("\n")


@pytest.mark.parametrize("text", ["a" * 200_000 + " x@y.com", "a." * 100_000 + "@", "a@b.cc " * 20_000, "A-" * 100_000 + "straße 1", "Ann Lee|" * 20_000 + "a@b.cc"])
def test_very_long_lines_take_linear_time(text):
    began = time.perf_counter()
    pii.Finder().spans(text)
    assert time.perf_counter() - began < 20


def test_lines_without_spaces_and_with_git_words_are_searched():
    finder = pii.Finder()
    kinds = lambda t: {(k, t[a:b]) for a, b, k in finder.spans(t)}
    assert kinds('{"id":17,"city":"Oslo","phone":"+4915112345678","note":null,"x":[]}') == {("phone", "+4915112345678")}
    assert kinds('{"id":17,"city":"Oslo","ssn":"123-45-6789","note":null,"x":[1,2]}') == {("id_number", "123-45-6789")}
    assert kinds("17\tOslo\tNorway\tactive\t(212)555-0147\t2020-01-01\tnone\tnone") == {("phone", "(212)555-0147")}
    assert kinds("17,Oslo,Norway,active,anna.lee(at)mailhaus.org,2020-01-01,none") == {("email", "anna.lee(at)mailhaus.org")}
    assert kinds("index of people: call +49 151 1234 5678") == {("phone", "+49 151 1234 5678")}
    assert kinds("Binary files are sent by anna.lee@mailhaus.org") == {("email", "anna.lee@mailhaus.org")}
    assert kinds("@@ -1,2 +1,3 @@ call('+49 151 1234 5678')") == {("phone", "+49 151 1234 5678")}
    assert not kinds("index 9fe1445..f97fde7 100644\n@@ -652,7 +652,7 @@\nBinary files a/x and b/y differ\n")
    assert not kinds("zcmV+b0" + "Qr7+4915112345678Zk/0049123456789012x" * 3)


def test_schemes_accounts_and_checks():
    finder = pii.Finder()
    spans = lambda t: [(k, t[a:b]) for a, b, k in finder.spans(t)]
    assert spans("tel:4155550123 mailto:ann@mailhaus.org") == [("phone", "4155550123"), ("email", "ann@mailhaus.org")]
    assert spans("IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432") == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "GB82WEST12345698765432")]
    assert not {k for k, _ in spans("IBAN DE88 3704 0044 0532 0130 00")} & {"account"}  # wrong check digits
    assert spans("card 4111 1111 1111 1111, not 4111 1111 1111 1112") == [("account", "4111 1111 1111 1111")]
    assert spans("SSN: 000-12-3456, SSN: 123-00-4567") == [] and spans("SSN: 123-45-6789") == [("id_number", "123-45-6789")]
    assert spans("write to ann.miller@mailhaus.org:thanks") == [("email", "ann.miller@mailhaus.org")]
    assert spans("git@mailhaus.org:core/web.git ann@mailhaus.org:~/x") == []
    assert spans("--- a/x\n+++ b/ann@mailhaus.org\n") == [("email", "ann@mailhaus.org")]
    assert spans("postgres://" + "u" * 300 + ":pw@db.mailhaus.org/main") == []
    text = "Thanks to Maria Lopez for this\nMaria Lopez knows Maria Lopezs"
    assert pii.redact_text(finder, text) == "Thanks to [NAME] for this\n[NAME] knows Maria Lopezs"


def test_account_numbers_are_redacted_but_not_listed(spark):
    df = documents(spark, [(1, "IBAN DE89 3704 0044 0532 0130 00")])
    assert pii.found(df).count() == 0 and pii.redacted(df).first()["text"] == "IBAN [ACCOUNT]"


PHRASINGS = (  # those with a cue, a title or a trailer in front are met, the others are not
    ("Author: {} <x@mailhaus.org>", True), ("Tested-by: {} <x@mailhaus.org>", True), ("Dr. {} agreed.", True), ("I spoke with {} yesterday.", True),
    ("As requested by {} last week", True), ("Please contact {} first", True), ("Best regards, {}", True), ("TODO({}): fix", True),
    ("{} broke the build again", False), ("Ask {} about it", False), ("This is {}'s work", False), ("In memory of {}.", False),
)


def test_names_in_running_text_need_a_cue():
    finder = pii.Finder()
    for phrase, expected in PHRASINGS:
        text = phrase.format("Ilse Marvoken")
        assert (("name", "Ilse Marvoken") in {(k, text[a:b]) for a, b, k in finder.spans(text)}) == expected, phrase
