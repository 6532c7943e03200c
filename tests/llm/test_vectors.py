from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import negatives, pivots, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, far string"


def whole(vector, scale):
    if vector is None or any(x is None or not math.isfinite(float(np.float32(x))) for x in vector):
        return None
    return [math.floor(float(np.float32(x)) * scale) for x in vector]


def inner(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def plain_top(rows, scale, k, every):
    kept = [(i, v) for i, x, *_ in rows if i is not None and (v := whole(x, scale)) is not None]
    out = []
    for i, q in {(i, tuple(v)) for i, v in kept if i % every == 0}:
        best = sorted(((-inner(q, v), j) for j, v in kept if j != i))[:k]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def plain_negatives(rows, scale, every, positives=5, most=3):
    kept = [(i, v, label) for i, x, label, *_ in rows if i is not None and label is not None and (v := whole(x, scale)) is not None]
    out = []
    for i, q, label in {(i, tuple(v), label) for i, v, label in kept if i % every == 0}:
        scored = sorted((-inner(q, v), j, other) for j, v, other in kept)
        for p, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            fit = [(s, n) for s, n, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p][:most]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def made(kind):
    random = np.random.default_rng(5)
    centres = random.normal(size=(6, 8))
    x = centres[random.integers(0, 6, 400)] + random.normal(size=(400, 8)) * {"groups": 0.05, "spread": 1.0, "ties": 0.0}[kind]
    x = np.round(x, 1) if kind == "ties" else x
    rows = [(i, [float(np.float32(c)) for c in v], int(random.integers(0, 3))) for i, v in enumerate(x)]
    rows += [(400, None, 1), (401, [None] * 8, 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] + [0.0] * 7, 1), (404, [0.0] * 8, 1), (None, [1.0] * 8, 1), (405, [1.0] * 8, None)]
    rows += [rows[20], rows[20], rows[33], (33, rows[34][1], 2), (40, rows[41][1], 0), (406, [], 1), (407, [2.0, 1.0], 1)]
    return [(*r, "x", 1, "y") for r in rows]


def vectors(df, scale, **more):
    return pivots.whole_vectors(df, scale, **more)


@pytest.mark.parametrize(("kind", "most"), [("groups", 4096), ("spread", 12), ("ties", 4096)])
def test_top_k_equals_plain_search(spark, kind, most):
    rows = made(kind)
    all_rows = vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), 1024)
    got = topk.top_k(all_rows, all_rows.where(F.col("id") % 20 == 0), 7, sample=64, pivots=8, most=most)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 1024, 7, 20)


@pytest.mark.parametrize(("kind", "most"), [("groups", 4096), ("spread", 12), ("ties", 4096)])
def test_negatives_equal_plain_search(spark, kind, most):
    rows = made(kind)
    all_rows = vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), 256, label=F.col("label"))
    got = negatives.hard_negatives(all_rows, all_rows.where(F.col("id") % 10 == 0), sample=64, pivots=8, most=most)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, 256, 10)


def test_few_rows_and_none(spark):
    few = vectors(spark.createDataFrame(made("ties")[:3], SCHEMA), 1024)
    assert sorted(tuple(r)[:3] for r in topk.top_k(few, few.where("id = 0")).collect()) == sorted((0, r, j) for _, r, j, _ in plain_top(made("ties")[:3], 1024, 10, 100))
    none = vectors(spark.createDataFrame([], SCHEMA), 1024, label=F.col("label"))
    assert topk.top_k(none, none).collect() == [] and negatives.hard_negatives(none, none).collect() == []
    assert topk.top_k(few, few.where("id = 9")).collect() == []


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**40
    rows = [(0, [1.0, big]), (1, [3.0, big]), (2, [2.0, big]), (3, [2.0, big]), (4, [-5.0, -big])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(vectors(df, 1.0), vectors(df, 1.0).where("id = 0"), 4).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1, 2, 3, 4]  # 2^80 + 3, + 2, + 2 don't fit doubles, and a long holds none of them
    assert found[0].score == 2**63 - 1


def test_near_rows_are_found_with_few_looks():
    """Groups that lie apart: the bounds spare nearly all evaluations, and none where they are wrong."""
    random = np.random.default_rng(1)
    centres = random.normal(size=(40, 16))
    centres *= 2000 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.floor(centres[np.repeat(np.arange(40), 50)] + random.normal(size=(2000, 16)) * 5)
    known = pivots.Pivots(x[::100], np.arange(0, 2000, 100), float((x * x).sum(1).max()), 16, True)
    chunk = pivots.Chunk(np.arange(2000), x, known.of_rows(x).astype("float32"), {})
    looked = 0

    def scores(some, q):
        nonlocal looked
        looked += len(some)
        return known.scores(some, q)

    for k in range(0, 2000, 50):
        q = x[k : k + 1]
        query = pivots.Query(0, None, q[0], known.of_queries(q).astype("float32")[0], float(known.reach(q)[0]), pivots.SLACK * 2 * known.top**0.5)
        exact = np.sqrt(np.maximum(0, query.reach - 2 * (x @ q[0])))
        assert (query.nearest(chunk) <= exact).all() and (query.farthest(chunk) >= exact).all()
        best = pivots.Best(10)
        pivots.eliminate(query, chunk, np.ones(2000, bool), best, scores)
        want = sorted(zip((-(x @ q[0])).astype(int).tolist(), range(2000), strict=True))[:10]
        assert best.ids.tolist() == [j for _, j in want]
    assert looked < 0.5 * 40 * 2000
