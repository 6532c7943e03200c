from __future__ import annotations

import hashlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers as files
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomline.llm import alignment
from fathomline.llm.common import read

PATHS = (files.path("byte_bpe_50k.tiktoken"), files.PATTERN, files.path("piece_bpe_32k.model"))


def byte_alphabet():
    """The characters that stand for bytes in the vocabulary's JSON form."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@cache
def libraries():
    own = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=PATHS[2]), byte_alphabet()


def plain(text):
    """Groups and links by a comparison of all tokens, with the libraries that the files are for."""
    own, pieces, alphabet = libraries()
    if not text:
        return None
    a = own.encode(f" {text}", add_special_tokens=False)
    b = pieces.encode(text)
    a_bytes = [bytes(alphabet[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, b)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
        return None
    a_at, b_at = (np.cumsum([0, *map(len, x)]).tolist() for x in (a_bytes, b_bytes))
    groups, done = [], (0, 0)
    for end in sorted(set(a_at[1:]) & set(b_at[1:])):
        now = a_at.index(end), b_at.index(end)
        groups.append((a.ids[done[0] : now[0]], b[done[1] : now[1]]))
        done = now
    links = [(a.ids[i], b[j]) for i in range(len(a.ids)) for j in range(len(b)) if a_at[i] < b_at[j + 1] and b_at[j] < a_at[i + 1]]
    return a.ids, b, groups, links


def expected(texts):
    found = [plain(t) for t in texts]
    count = Counter(link for f in found if f for link in f[3])
    highest: dict[int, int] = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    for f in found:
        if not f:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        a, b, groups, links = f
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield len(a), len(b), len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(written.encode()).hexdigest()


def digested(spark, docs, **more):
    aligned = alignment.align(docs, *PATHS)
    found = alignment.best_links(aligned, alignment.pair_counts(aligned), **more).collect()
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "")) for r in found]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["hello", " ", "  ", "Grüße", "日本語", "😀", "\n", "<|endoftext|>", "<s>", "<unk>", "123", "don't", "▁", "é", "\x00", "ab" * 9, "．"]), max_size=12).map("".join))
def test_groups_and_links_of_any_text(text):
    pair = alignment.pair(*PATHS)
    want, got = plain(text), pair.align(text, pair.b.encode(text) if text else [])
    assert (want is None) == (got is None)
    if want:
        a, b, groups, links = want
        assert got["groups"] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert (got["n_a"], got["n_b"], got["n_groups"], got["n_links"]) == (len(a), len(b), len(groups), len(links))
        assert dict(zip(got["linked"].tolist(), got["n"].tolist(), strict=True)) == {x * len(pair.b_sizes) + y: n for (x, y), n in Counter(links).items()}


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_all_documents_by_both_joins(spark, docs, broadcast_pairs):
    rows = [(r.doc_id, (r.text or "")[:2000]) for r in docs.select("doc_id", "text").collect()]
    want = [(i, x) for (i, _), x in zip(rows, expected([t for _, t in rows]), strict=True)]
    got = digested(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), broadcast_pairs=broadcast_pairs)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_long_texts_and_clashing_columns(spark, docs, nothing):
    got = dict(digested(spark, docs))
    assert len(got) == len({r.doc_id for r in docs.select("doc_id").collect()})
    assert got[3] == got[4] == (0, 0, 0, 0, 0, 0, "")
    assert got[6][0] > 50_000 and got[6][3] == got[6][0] + got[6][1] - got[6][2]
    assert digested(spark, nothing) == []


def test_query_equals_plain_search(spark):
    folder = "/root/testdata/sf0.001"
    rows = read(spark, folder, "documents").select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 4000]
    pair = alignment.pair(*PATHS)
    count: Counter = Counter()
    aligned = {r.doc_id: pair.align(r.text, pair.b.encode(r.text or "")) for r in rows}
    for x in aligned.values():
        if x:
            count.update(dict(zip(x["linked"].tolist(), x["n"].tolist(), strict=True)))
    got = {r.doc_id: r for r in alignment.query(spark, folder).collect()}
    assert len(got) == len(rows)
    for r in short:
        a, b, groups, links = plain(r.text) or ([], [], [], [])
        row = got[r.doc_id]
        assert (row.n_a, row.n_b, row.n_groups, row.n_links) == (len(a), len(b), len(groups), len(links))
        assert row.count_sum == sum(count[x * len(pair.b_sizes) + y] for x, y in links)
