"""Properties of the queries that have no SQL, over the smallest tables."""

import pytest

from citeloom.llm import packing
from citeloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def rows(spark, data):
    held = {}

    def of(name):
        if name not in held:
            held[name] = [tuple(r) for r in QUERIES[name](spark, data).collect()]
        return held[name]

    return of


def column(spark, data, table, name):
    return {r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(name).collect()}


def test_every_entry_has_one_record(spark, data, rows):
    matched = rows("p1_matches")
    assert matched and len({e for e, _, _ in matched}) == len(matched) and all(0.5 <= c <= 1 for _, _, c in matched)
    assert {e for e, _, _ in matched} <= column(spark, data, "bib", "entry_id")
    assert {h for _, h, _ in matched} <= column(spark, data, "dblp", "hit_id")
    assert sorted(rows("p1_found")) == sorted((e, h) for e, h, _ in matched)


def test_spellings_fall_into_classes(spark, data, rows):
    clusters = dict(rows("p4_clusters"))
    assert clusters.keys() == column(spark, data, "author_names", "name_id")
    groups = {}
    for name, cluster in clusters.items():
        groups.setdefault(cluster, set()).add(name)
    assert all(min(g) == c for c, g in groups.items())
    assert sorted(rows("p4_found")) == sorted((a, b) for g in groups.values() for a in g for b in g if a < b)


def test_containers_hold_every_text(spark, data, rows):
    placed, fill = rows("p7_containers"), rows("p7_fill")
    assert {p[0] for p in placed} == column(spark, data, "documents", "doc_id")
    assert all(used <= packing.CAPACITY for _, _, used in fill) and sum(n for _, n, _ in fill) == len(placed)
    assert sum(used for _, _, used in fill) == sum(p[3] for p in placed)
    assert sum(used for _, _, used in fill) > 0.97 * packing.CAPACITY * len(fill)


def test_redacted_texts_lack_what_was_found(spark, data, rows):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    redacted = {d: (t, n) for d, t, n in rows("p9_redacted")}
    found = {}
    for d, kind, text in rows("p9_found"):
        found.setdefault(d, set()).add(text)
        assert text in texts[d] and kind in ("email", "phone", "id_number", "address", "name")
    assert redacted.keys() == texts.keys() and found
    for d, (text, n) in redacted.items():
        assert (text == texts[d]) == (n == 0) and n >= len(found.get(d, ()))
        assert text is None or text.count("\n") == texts[d].count("\n")


def test_pieces_fit(rows):
    pieces = rows("p3_pieces")
    assert pieces and all(size <= 4000 and len(text) == size for _, _, _, _, size, _, _, text in pieces)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith("_found") or n == "p7_containers"))
def test_plans_have_no_cross_join(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
