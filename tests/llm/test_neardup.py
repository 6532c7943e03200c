from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathomline.llm import neardup
from fathomline.llm.common import Shelf
from fathomline.llm.components import components


def brute(rows, percent):
    """Components by comparing all pairs of sets of word tuples."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = sorted((find(a), find(b)))
                root[j] = i
    return {i: (len(sets[i]), find(i)) for i in ids}


def planted(seed, n=60):
    """Bases with copies at many distances, some near the threshold, and a chain of near copies."""
    rnd, rows = random.Random(seed), []
    for b in range(n // 6):
        words = [f"b{b}w{k}" for k in range(rnd.choice([6, 40, 300]))]
        for c in range(5):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 2, 4, 8])):
                copy[rnd.randrange(len(copy))] = f"e{rnd.random()}"
            rows.append((len(rows), " ".join(copy)))
    words = [f"chain{k}" for k in range(120)]
    for c in range(12):
        words[c * 9] = f"link{c}"
        rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_against_all_pairs(spark, percent):
    rows = planted(percent)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    want = brute(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_nodes_above_the_limit_lose_nothing(spark):
    words = [f"g{k}" for k in range(400)]
    rows = []
    for i in range(80):
        copy = list(words)
        copy[(i * 7) % 400] = f"own{i}"
        rows.append((i, " ".join(copy)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, small=8).collect()
    assert {r.component_id for r in out} == {0}


def test_a_crowd_of_one_component_costs_rows_in_proportion(spark):
    def rows(n, strangers):
        crowd = spark.range(n).select(F.lit(1).cast("long").alias("path"), F.col("id").alias("rep"))
        of = spark.range(strangers, n).select(F.col("id").alias("rep"), F.lit(strangers).cast("long").alias("component"))
        of = of.unionByName(spark.range(min(1, strangers)).select(F.col("id").alias("rep"), F.lit(strangers).cast("long").alias("component")))
        return neardup.crowd_nodes(crowd, of, 64)

    assert rows(50_000, 0).count() == 0
    found = rows(3000, 21)  # the first of all is in the component, the next 20 are not
    assert found.count() <= 3000 + 21 * (2 + 3000 // 32)
    seen = {}
    for r in found.collect():
        seen.setdefault(r.node, set()).add(r.rep)
    assert max(map(len, seen.values())) <= 3 * 64  # hashed blocks vary in size
    met = {(a, b) for reps in seen.values() for a in reps if 0 < a < 21 for b in reps}
    assert all((a, b) in met for a in range(1, 21) for b in [0, *range(21, 3000)])


def test_strangers_in_a_crowd_are_found(spark):
    base = [f"c{k}" for k in range(900)]
    rows = []
    for i in range(60):  # near copies of each other
        rows.append((i, " ".join([*base[:-2], f"a{i}", f"b{i}"])))
    for i in range(60, 70):  # pairs at the end of a chain that leaves the group
        at = (i - 59) * 40
        rows.append((i, " ".join([*base[:-at], *(f"d{i // 2}x{k}" for k in range(at))])))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, small=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 85)


def family(n=60, pairs=90):
    """Texts at 0.77 to each other, and pairs of them at 0.80 that are linked with nothing else."""
    block = lambda name, size: " ".join(f"{name}x{k}" for k in range(size))
    shared = block("shared", 180)
    rows = [f"{shared} {block(f'own{i}', 26)}" for i in range(n)]
    for i in range(pairs):
        rows += [f"{shared} {block(f'pair{i}', 4)} {block(f'side{i}and{side}', 22)}" for side in (0, 1)]
    return list(enumerate(rows))


def test_isolated_pairs_at_the_threshold_in_a_large_family(spark):
    rows = family()
    want = {i: i if i < 60 else i - i % 2 for i, _ in rows}
    assert {i: c for i, (_, c) in brute(rows[50:80], 80).items()} == {i: want[i] for i in range(50, 80)}
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, small=16).collect()
    assert {r.doc_id: r.component_id for r in out} == want


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_reach_the_target_at_every_depth(percent):
    for depth in neardup.DEPTHS:
        trees = neardup.trees_for(percent, depth)
        assert (1 - (percent / 100) ** depth) ** trees <= neardup.MISS < (1 - (percent / 100) ** depth) ** (trees - 1)
    assert neardup.trees_for(percent, neardup.DEPTHS[0]) <= neardup.TREES


def test_odd_rows(docs):
    out = {}
    for r in neardup.near_duplicates(docs, 85).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert len(out[13]) == 2 and len(out[None]) == 2
    at = lambda i: (out[i][0].n_shingles, out[i][0].component_id)
    assert at(1) == (8, 1) and at(2) == (8, 1)
    assert at(3) == (0, 3) and at(4) == (0, 4) and at(5) == (0, 5)
    assert at(8)[1] == 7 and at(9)[1] == 9
    assert at(10) == (1, 10) and at(11) == (1, 10)
    assert all(r.component_id is None and r.kept for r in out[None])


def test_keep_one_keeps_columns_and_unlinked_rows(docs):
    kept = neardup.keep_one(docs, 80)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 9, 10, 12, 13, 15]
    assert kept.where("doc_id is null").count() == 2


def test_empty(nothing):
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.keep_one(nothing).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (5, 6)]
    out = components(spark.createDataFrame(links, "a long, b long"), Shelf(spark, "test"), "c").collect()
    assert {r.node: r.component for r in out} == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}}
    assert len(out) == 51
