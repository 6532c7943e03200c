from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomline.llm import packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@given(st.integers(0, 20_000))
def test_cuts_cover_and_fill(n):
    parts = packing.cuts(n)
    assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
    assert all(2048 - 2048 // p * p <= max(0.02 * 2048, 2048 // p) for p in parts)


def test_ids_equal_the_tokenizers_library(own):
    for text in ("", " a  b\n\n c", "don't 12 3'S", "x\u00a0y\u3000z", "<|endoftext|> q", "日本語 😀 ﬁ", "a" * 5000, "\r\n\t "):
        assert packing.encode(text, PATH, PATTERN).tolist() == own.encode(text, add_special_tokens=False).ids + [1]


def check(rows, texts, own):
    sequences, by = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        by.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    for i, text in texts.items():
        ids, at = np.array(own.encode(text, add_special_tokens=False).ids + [1], "<u4"), 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    return sequences


def test_all_ids_are_packed_once(spark, own, monkeypatch):
    monkeypatch.setattr(packing, "PER_WORKER", 300)
    texts = {i: "lorem ipsum " * (i * i % 1700) for i in range(250)}
    rows = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH, PATTERN, with_ids=True).collect()
    sequences = check(rows, texts, own)
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * total / 2048 + 4
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_odd_rows(docs, nothing, own):
    rows = packing.pack_documents(docs, PATH, PATTERN, with_ids=False).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in (None, 13)}
    check(rows, texts, own)
    assert sum(r.length for r in rows if r.doc_id == 4) == 1 and len([r for r in rows if r.doc_id == 13]) == 2
    assert len([r for r in rows if r.doc_id is None]) == 2
    assert packing.pack_documents(nothing, PATH, PATTERN).count() == 0


def test_copies_of_a_document_come_apart(spark, own, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20 + i * 7))) for i in range(40)] * 3
    for per_worker in (20_000, 40):
        monkeypatch.setattr(packing, "PER_WORKER", per_worker)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = packing.pack_documents(docs, PATH, PATTERN, with_ids=False).collect()
        assert sum(r.length for r in found) == 3 * sum({r.doc_id: r.doc_tokens for r in found}.values())
        held = {}
        for r in found:
            held.setdefault(r.sequence_id, []).append(r)
        for parts in held.values():
            at = 0
            for r in sorted(parts, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048 and len({r.doc_id for r in parts}) == len(parts)
        assert len(held) <= 1.35 * sum(r.length for r in found) / 2048 + 2


def test_a_document_that_is_most_rows(spark, own, monkeypatch):
    monkeypatch.setattr(packing, "PER_WORKER", 300)
    docs = spark.createDataFrame([(7, "the same")] * 2000 + [(None, "none")] * 500 + [(i, "others " * (i % 300)) for i in range(500)], "doc_id long, text string")
    found = packing.pack_documents(docs, PATH, PATTERN, with_ids=False).collect()
    assert len([r for r in found if r.doc_id == 7 and r.length == r.doc_tokens]) == 2000 + 1
    sizes = {}
    for r in found:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048 and len(sizes) <= 1.1 * sum(sizes.values()) / 2048 + 10


def test_first_fit():
    lengths = [5, 4, 3, 2, 2]
    for owners in (list("abcde"), list("aabbc"), [None] * 5):
        placed = packing._first_fit(lengths, 8, owners)
        ends, held = {}, {}
        for (k, at), n, own in zip(placed, lengths, owners):
            ends.setdefault(k, []).append((at, at + n))
            held.setdefault(k, []).append(own)
        assert all(sorted(v)[-1][1] <= 8 for v in ends.values()) and len(ends) <= 3
        assert owners[0] is None or all(len(set(v)) == len(v) for v in held.values())
