from __future__ import annotations

import collections
import hashlib
import random

import pytest

from fathomline.llm import common, passages


def brute(texts):
    count = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages_ = [prose(k) for k in (70, 90, 150, 300)]
    texts = []
    for _ in range(30):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            parts += [prose(rnd.randrange(0, 60)), rnd.choice([*passages_, "", ""])]
        texts.append("".join(parts))
    exact = passages_[0].encode()[:400].decode(errors="ignore")
    short = " ".join(rnd.choice("abcdefghijkl") + str(rnd.randrange(9)) for _ in range(51))
    own = " ".join(f"own{i}" for i in range(60))
    fifty = [f"{prose(9)} {short} {prose(5)}", f"{short.upper()} {prose(7)}", f"z {short.rsplit(' ', 1)[0]}", f"y {short.rsplit(' ', 2)[0]}", f"{own} {own}"]
    return [*texts, *fifty, texts[0], texts[1] + "x", "z" * 399, "z" * 399, "q" * 400, "q" * 401, "ab" * 500, exact + "!" * 30, "", None]


def brute_words(texts, n=50):
    """How many words of each text are in runs of n words that another row has."""
    words = [t.lower().split() for t in texts]
    has = collections.defaultdict(set)
    for i, w in enumerate(words):
        for at in range(len(w) - n + 1):
            has[tuple(w[at : at + n])].add(i)
    out = []
    for w in words:
        shared = set()
        for at in range(len(w) - n + 1):
            if len(has[tuple(w[at : at + n])]) > 1:
                shared |= set(range(at, at + n))
        out.append(len(shared))
    return out


def result(df):
    size = lambda spans: sum(x.b - x.a for x in spans)
    return {r.doc_id: (r.n_bytes, size(r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest(), size(r.passages)) for r in passages.remove_repeats(df).collect()}


@pytest.mark.parametrize("block", [4096, 1])
@pytest.mark.parametrize("share", [4096, 20])
def test_against_all_strings(spark, monkeypatch, block, share):
    monkeypatch.setattr(common, "SHARE", share)  # with few keys that may be heavy, most are joined by a shuffle
    monkeypatch.setattr(passages, "BLOCK", block)  # 1: every block with differing members goes the way of large ones
    texts = corpus(block)
    data = [(t or "").encode() for t in texts]
    want = [(*w, n) for w, n in zip(brute(data), brute_words(data))]
    got = result(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 5000
    assert [w[4] for w in want[30:35]] == [51, 51, 50, 0, 0]  # the last repeats only itself


def test_texts_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 1000)
    rnd = random.Random(1)
    text = bytes(rnd.randrange(256) for _ in range(5000))
    starts = []
    for base, part in passages._pieces(text):
        _, place, low, high, gram = passages.sample([part])
        starts += [base + s for a, b in zip(low, high) for s in range(a, b + 1)]
    assert starts == list(range(len(text) - 399))


def test_odd_rows_and_empty_table(docs, nothing):
    rows = passages.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[4].n_bytes == 0 and by[4].kept == b""
    assert by[6].kept == b""  # a phrase over and over is all repeats
    assert len(by[12].kept) == len("Grüße aus Köln – 日本語 😀 café".encode())
    assert passages.remove_repeats(nothing).count() == 0


def test_rows_repeated_with_their_id_are_solved_once(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(7, text)] * 40 + [(None, text)] * 3 + [(8, text[:900] + "!"), (9, text[:600] + "?")]
    out = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and all(len(r.removed) == 1 and len(r.passages) == 1 for r in out)
    assert {len(r.kept) for r in out if r.doc_id == 7} == {0}


def test_padding_takes_few_places(spark):
    """A run of one byte, of spaces or of a short period: places are few, and all results as before."""
    long = {1: "a" * 1_000_000, 2: " " * 1_000_000, 3: "abcd " * 200_000}
    keyed = passages._keyed(spark.createDataFrame(list(long.items()), "doc_id long, text string"), "doc_id", "text")
    n = {r.doc: r.n for r in passages.cover_sample(keyed).groupBy("doc").count().withColumnRenamed("count", "n").collect()}
    assert all(50 * n[k] < len(t) for k, t in long.items()) and n[1] < 20
    rnd = random.Random(3)
    noise = lambda k: "".join(rnd.choice("bcdefg ") for _ in range(k))
    texts = [noise(300) + "a" * 950 + noise(500), noise(100) + "a" * 400 + noise(40), "a" * 399 + noise(900), noise(30) + "xy " * 170 + noise(300) + "xy " * 300, "xy " * 134, "q " * 60 + noise(50), noise(20) + " q" * 51, "r " * 70, " ".join(["s"] * 49), " ".join(["s"] * 50) + noise(10)]
    data = [t.encode() for t in texts]
    want = [(*w, n) for w, n in zip(brute(data), brute_words(data))]
    got = result(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert [got[i] for i in range(len(texts))] == want
    whole = result(spark.createDataFrame(list(long.items()), "doc_id long, text string"))
    assert all(whole[k][:3] == (len(t), len(t), 1) for k, t in long.items())
