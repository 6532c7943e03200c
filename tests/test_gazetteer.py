from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.operators import gazetteer
from fathomline.plans import catalog, names

NAMES = [
    # term, alias, exact, not_after, not_before
    ("SQL", "sql", False, ["/", "my"], [" server"]),
    ("SQL Server", "sql server", False, [], []),
    ("Go", "Go", True, [], []),
    ("Azure", "azure", False, [], []),
    ("Azure Data Factory", "azure data factory", False, [], []),
    ("ADF", "azure data factory", False, [], []),
    ("C++", "c++", False, [], []),
    ("C", "c", False, [], []),
    ("Köln", "KÖLN", False, [], []),
    ("Data", "data", False, [], []),
]


def plain(text, names=NAMES, longest=True):
    """All names at all places, one pattern for each, and each hit held against all others."""
    text = text or ""
    fold = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    hits = set()
    for term, alias, exact, not_after, not_before in names:
        for k in range(len(text)):
            part = text[k : k + len(alias)]
            if (part == alias if exact else fold(part) == fold(alias)) and not (k and re.match(r"[-A-Za-z0-9+#]", text[k - 1])) and not re.match(r"[A-Za-z0-9+#]", text[k + len(alias) :]):
                if not any(fold(text[:k]).endswith(x) for x in not_after) and not any(fold(text[k + len(alias) :]).startswith(x) for x in not_before):
                    hits.add((k, k + len(alias), term))
    kept = [h for h in hits if not longest or not any(s <= h[0] and h[1] <= e and (s, e) != h[:2] for s, e, _ in hits)]
    firsts = {}
    for start, end, term in sorted(kept):
        firsts.setdefault(term, [start + 1, term, text[start:end], 0])[3] += 1
    return sorted(tuple(f) for f in firsts.values())


def found(df):
    return {r[0]: [tuple(t) for t in r.terms] for r in df.collect()}


PIECES = st.lists(st.sampled_from(["sql", "SQL", " server", "/", "my", " ", "-", "Go", "go", "Azure", " data", " factory", "c++", "C", "#", "Köln", "KÖLN", "ß", "İ", ",", "1"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.booleans())
def test_one_pass_equals_a_search_for_each_name(text, longest):
    hits = gazetteer.Names(NAMES).hits(text)
    kept = gazetteer.unshadowed(hits) if longest else hits
    assert [tuple(t.values()) for t in gazetteer.first_of_each(text, kept)] == plain(text, longest=longest)


@pytest.mark.parametrize("most", [gazetteer.NAMES_BYTES, 20])
def test_one_automaton_or_several(spark, most):
    texts = [(1, "Azure Data Factory and azure, c++ or C"), (2, None), (3, ""), (4, "sql server/sql t sql"), (5, "sql " * 20_000), (6, "nothing")]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "k long, body string, id string")
    aliases = spark.createDataFrame([*NAMES, NAMES[0], (None, "x", None, None, None), ("Empty", "", None, None, None), ("Null", None, None, None, None)], "term string, alias string, exact boolean, not_after array<string>, not_before array<string>")
    got = found(gazetteer.find_names(docs, "k", "body", aliases, most=most))
    assert got == {k: plain(t) if k != 5 else [(1, "SQL", "sql", 20_000)] for k, t in texts}


def test_no_names_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "text")], "k long, body string")
    none = spark.createDataFrame([], "term string, alias string")
    assert found(gazetteer.find_names(docs, "k", "body", none)) == {1: []}
    assert found(gazetteer.find_names(docs.where("k = 0"), "k", "body", none)) == {}


def test_query_equals_a_search_for_each_name(spark):
    folder = "/root/testdata/sf0.001"
    aliases = [(r.term, r.alias, r.exact, r.not_after, r.not_before) for r in gazetteer.as_names(names.benchmark_names(names.Tables(spark, folder))).collect()]
    assert len(aliases) > 1000
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {}
    for r in catalog.QUERIES["benchmark_terms"](spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.term, r.n))
    for k in sorted(docs)[:25]:
        few = [n for n in aliases if n[1].lower() in docs[k].lower()]
        assert sorted(got.get(k, [])) == sorted((s, t, n) for s, t, _, n in plain(docs[k][:3000], few)) if len(docs[k]) <= 3000 else True
