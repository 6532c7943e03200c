from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomline.operators import evidence, funnel, listing, postings, ranked


def greedy(rows, size):
    """One choice after another: the class, then how often its company was chosen, then the score."""
    left, chosen, used, seen = list(rows), [], Counter(), set()
    while left and len(chosen) < size:
        best = min(left, key=lambda r: (r[3], used[r[1]], -r[4]))
        left.remove(best)
        if (best[1], best[2]) not in seen:
            seen.add((best[1], best[2]))
            used[best[1]] += 1
            chosen.append(best[0])
    return chosen


def test_plan_equals_greedy_choice(spark):
    rnd = random.Random(3)
    for _ in range(12):
        scores = rnd.sample(range(1000), 25)
        rows = [(i, f"c{rnd.randrange(4)}", f"p{rnd.randrange(6)}", rnd.randrange(3), float(s)) for i, s in enumerate(scores)]
        df = spark.createDataFrame(rows, "id long, company string, posting string, ordinal int, score double")
        assert [r.id for r in ranked.plan(df, "company", "posting", "ordinal", "score", "id", 6).collect()] == greedy(rows, 6)


def test_budget_takes_the_first_and_what_still_fits(spark):
    df = spark.createDataFrame([(1, 200), (2, 10), (3, 5)], "place int, minutes int")
    assert [r.place for r in ranked.within_budget(df, ["place"], "minutes", 3, 135).collect()] == [1]
    df = spark.createDataFrame([(1, 60), (2, 100), (3, 70), (4, None)], "place int, minutes int")
    assert [r.place for r in ranked.within_budget(df, ["place"], "minutes", 3, 135).collect()] == [1, 3]


def test_union_length(spark):
    rows = [("a", 0, 10), ("a", 5, 12), ("a", 12, 13), ("a", 20, 25), ("a", 9, 3), ("b", 1, None)]
    out = ranked.union_length(spark.createDataFrame(rows, "k string, s int, e int"), ["k"], "s", "e").collect()
    assert [(r.k, r.covered, r.islands) for r in out] == [("a", 18, 2)]


def test_closure(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0), (20, 21)], "a int, b int")
    out = {(r.source, r.target) for r in ranked.closure(edges, "a", "b").collect()}
    assert out == {(i, j) for i in range(13) for j in range(13) if i != j} | {(20, 21)}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 125)] + [(7, 7), (None, 3)]
    label = {n: n for e in edges if None not in e for n in e}
    for _ in label:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    out = ranked.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert sorted((r.node, r.component) for r in out.collect()) == sorted(label.items())
    assert ranked.components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


def test_runs_and_headings(spark):
    rows = [("u", i, k) for i, k in enumerate("eeoeoeee")]
    df = spark.createDataFrame(rows, "u string, t int, k string")
    out = ranked.runs_of(df, ["u"], ["t"], F.col("k") == "e").orderBy("run").collect()
    assert [(r.length, r.first_at) for r in out] == [(2, 0), (1, 3), (3, 5)]
    carried = ranked.carried(df, ["u"], ["t"], F.when(F.col("k") == "o", F.col("t")), "h").orderBy("t").collect()
    assert [r.h for r in carried] == [None, None, 2, 2, 4, 4, 4, 4]


def test_noisy_or_floor_and_cap(spark):
    rows = [("a", "x", 0.5, False), ("a", "x", 0.2, False), ("a", "y", 0.5, False), ("b", "x", 0.1, True), ("c", "x", 1.5, False), ("d", "x", -1.0, False)]
    out = evidence.noisy_or(spark.createDataFrame(rows, "k string, s string, c double, v boolean"), "k", ["s"], "c", F.col("v")).collect()
    assert {r.k: round(r.joint_confidence, 6) for r in out} == {"a": 0.75, "b": 0.95, "c": 0.99, "d": 0.0}


def test_merging_evidence_twice_equals_merging_once(spark):
    rnd = random.Random(8)
    rows = [(f"f{rnd.randrange(5)}", 1, rnd.random(), rnd.randrange(100), t, t) for t in range(80)]
    df = spark.createDataFrame(rows, "fingerprint string, observations long, confidence double, evidence int, first_seen int, last_seen int")
    key = lambda d: sorted(map(tuple, d.collect()))
    parts = evidence.merge_evidence(evidence.merge_evidence(None, df.where("first_seen < 30")), df.where("first_seen >= 30"))
    assert key(parts.select(*evidence.EVIDENCE)) == key(evidence.merge_evidence(None, df).select(*evidence.EVIDENCE))


def test_flags_names_and_first_match(spark):
    df = spark.createDataFrame([("TRUE",), ("0",), ("maybe",), (None,)], "v string")
    assert [r.x for r in df.select(listing.parse_flag(F.col("v")).alias("x")).collect()] == [True, False, None, None]
    rows = spark.createDataFrame([(1, "a", None), (2, None, "d"), (3, "zz", "d"), (4, None, None)], "id int, name string, domain string")
    targets = spark.createDataFrame([(10, "a", "q"), (11, "a", "d"), (12, None, "d")], "tid int, tname string, tdomain string")
    out = listing.first_match(rows, targets, "tid", [("name", "tname"), ("domain", "tdomain")]).collect()
    assert {r.id: r.matched_id for r in out} == {1: 10, 2: 11, 3: 11, 4: None}


def test_approval_needs_the_last_word(spark):
    rows = [("a", 1, "ok"), ("a", 2, "back"), ("b", 1, "back"), ("b", 2, "ok"), ("c", 1, "other")]
    df = spark.createDataFrame(rows, "k string, t int, e string")
    out = funnel.approved(df, "k", ["t"], F.col("e") == "ok", F.col("e") == "back").collect()
    assert {r.k: r.approved for r in out} == {"a": False, "b": True, "c": False}


NOW = "2026-10-07 12:00:00"
COLUMNS = "company string, title string, location string, application_url string, source string, external_id string, posted_at timestamp, posted_at_precision string, description string"
STATE = "job_id string, source string, external_id string, application_url string, company string, normalized_title string, title string, location string, description string, status string"
BODY = "Build data pipelines with Spark and Kafka for the lake. " * 6


def batch(spark, *rows):
    full = [("Acme", r.get("title", "Data Engineer"), r.get("place", "Pune"), r.get("url", f"u{r['id']}"), r.get("source", "greenhouse"), str(r["id"]), None, None, r.get("text", BODY)) for r in rows]
    df = spark.createDataFrame(full, COLUMNS)
    age = {str(r["id"]): r["age"] for r in rows if "age" in r}
    for i, hours in age.items():
        at = F.expr(f"TIMESTAMP '{NOW}' - INTERVAL {hours} HOUR")
        df = df.withColumn("posted_at", F.when(F.col("external_id") == i, at).otherwise(F.col("posted_at"))).withColumn("posted_at_precision", F.when(F.col("external_id") == i, "datetime").otherwise(F.col("posted_at_precision")))
    return df


def outcomes(df):
    return {r.external_id: r.outcome for r in df.collect()}


def test_ingest_is_idempotent_and_resolves_duplicates(spark):
    none = spark.createDataFrame([], STATE)
    first = postings.ingest(batch(spark, {"id": 1, "url": "x"}, {"id": 2, "url": "x", "source": "lever"}, {"id": 3, "title": "Chef"}, {"id": 4, "age": 800}, {"id": 5, "age": 100, "title": "Platform Engineer"}), none, NOW)
    assert outcomes(first) == {"1": "created", "2": "deduplicated", "3": "irrelevant_skipped", "4": "stale_skipped", "5": "created"}
    state = postings.apply_ingest(none, first)
    assert state.count() == 3 and state.select("job_id").distinct().count() == 2
    again = postings.ingest(batch(spark, {"id": 1, "url": "x"}, {"id": 2, "url": "x", "source": "lever"}), state, NOW)
    assert outcomes(again) == {"1": "unchanged", "2": "unchanged"}
    like = postings.ingest(batch(spark, {"id": 7, "text": BODY + "Join us."}, {"id": 8, "text": "Something else entirely about a data lake. " * 9}), state, NOW)
    assert outcomes(like) == {"7": "deduplicated", "8": "created"}
    assert like.where("external_id = '7'").first().matched_by == "likeness"


def test_alike_rows_of_one_batch_are_one_job(spark):
    """Rows 1 to 6 are joined by likeness, by a URL, and by a chain of both; a row that is skipped joins nothing."""
    none, other = spark.createDataFrame([], STATE), "Something else entirely about a data lake. " * 9
    rows = [{"id": 1}, {"id": 2, "text": BODY + "Join us."}, {"id": 3, "text": BODY}, {"id": 4, "url": "u3", "text": other}, {"id": 5, "text": other + "Now."}, {"id": 6, "place": "Oslo", "url": "u5"}]
    apart = [{"id": 7, "place": "Bergen"}, {"id": 8, "place": None}, {"id": 9, "place": None}, {"id": 0, "title": "Chef", "url": "u7"}]
    out = postings.ingest(batch(spark, *rows, *apart), none, NOW)
    assert outcomes(out) == dict.fromkeys("1789", "created") | dict.fromkeys("23456", "deduplicated") | {"0": "irrelevant_skipped"}
    job = {r.external_id: r.job_id for r in out.collect()}
    assert len({job[i] for i in "123456"}) == 1 and len({job[i] for i in "1789"}) == 4 and job["0"] is None
    state = postings.apply_ingest(none, out)
    assert state.count() == 9 and set(outcomes(postings.ingest(batch(spark, *rows), state, NOW)).values()) == {"unchanged"}


def test_only_complete_scans_close(spark):
    none = spark.createDataFrame([], STATE)
    state = postings.apply_ingest(none, postings.ingest(batch(spark, {"id": 1}, {"id": 2, "title": "Platform Engineer"}), none, NOW))
    seen = spark.createDataFrame([("greenhouse", "1")], "source string, external_id string")
    partial = spark.createDataFrame([], "source string")
    complete = spark.createDataFrame([("greenhouse",)], "source string")
    status = lambda s: {r.external_id: r.status for r in s.collect()}
    assert status(postings.close_unseen(state, seen, partial)) == {"1": "OPEN", "2": "OPEN"}
    closed = postings.close_unseen(state, seen, complete)
    assert status(closed) == {"1": "OPEN", "2": "CLOSED"}
    assert sorted(r.listing_status for r in postings.job_status(closed).collect()) == ["CLOSED", "OPEN"]
    back = postings.ingest(batch(spark, {"id": 2, "title": "Platform Engineer"}), closed, NOW)
    assert outcomes(back) == {"2": "updated"} and status(postings.apply_ingest(closed, back))["2"] == "OPEN"


def test_only_changed_texts_need_analysis(spark):
    rows = spark.createDataFrame([(1, "A  b"), (2, "c"), (3, "d")], "id int, description string")
    done = spark.createDataFrame([(1, "a b", 2), (2, "changed", 2), (3, "d", 1)], "id int, t string, version int").select("id", "version", F.sha2("t", 256).alias("description_hash"))
    assert sorted(r.id for r in postings.stale_analyses(rows, done, "id", 2).collect()) == [2, 3]


def test_gram_overlap(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "short"), (3, None)], "doc_id int, text string")
    other = spark.createDataFrame([(9, "x b c d e f g h i y")], "item_id int, text string")
    assert [tuple(r) for r in postings.gram_overlap(docs, "doc_id", "text", other, "item_id", "text").collect()] == [(1, 9, 1)]


def plain_ingest(rows):
    """One row after another against all others, with the sequence matcher itself; chains are followed."""
    from difflib import SequenceMatcher


    norm = lambda s: re.sub("[^a-z0-9]+", " ", (s or "").lower()).strip()[:5000]
    open_ = sorted(((r["source"], r["external_id"]), r) for r in rows if r["title"] != "Chef")
    lead = {k: k for k, _ in open_}

    def find(k):
        while lead[k] != k:
            k = lead[k]
        return k

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        lead[b] = a

    by_url: dict = {}
    for k, r in open_:
        join(by_url.setdefault(r["application_url"], k), k)
    firsts: dict = {}
    for k, r in open_:
        first = next(x for x, y in open_ if y["application_url"] == r["application_url"])
        firsts.setdefault((r["company"], r["title"], r["location"]), {}).setdefault(norm(r["description"]), []).append(first)
    for texts in firsts.values():
        for ks in texts.values():
            for k in ks:
                join(ks[0], k)
        low = sorted((min(ks), t) for t, ks in texts.items())
        for i, (a, x) in enumerate(low):
            for b, y in low[i + 1 :]:
                if a != b and 2 * min(len(x), len(y)) >= postings.LIKENESS * (len(x) + len(y)) and SequenceMatcher(None, x, y).ratio() >= postings.LIKENESS:
                    join(a, b)
    out = {(r["source"], r["external_id"]): "irrelevant_skipped" for r in rows if r["title"] == "Chef"}
    return out | {k: "created" if find(k) == k else "deduplicated" for k, _ in open_}


@pytest.mark.parametrize("slice_", [1024, 3])
def test_ingest_of_real_texts_equals_comparing_all(spark, monkeypatch, slice_):
    from fathomline.plans import scoring
    from fathomline.plans.registry import Tables

    monkeypatch.setattr(postings, "SLICE", slice_)
    batch = scoring.document_postings(Tables(spark, "/root/testdata/sf0.001")).where("length(description) < 4000")
    batch = batch.withColumn("title", F.when(F.col("title") == "Chef", "Chef").otherwise(F.concat(F.lit("Data Engineer "), (F.col("external_id").cast("long") % 3).cast("string"))))
    near = batch.where("cast(external_id as long) % 4 = 1").withColumns({"external_id": F.concat("external_id", F.lit("n")), "application_url": F.concat("application_url", F.lit("n"), F.col("external_id")), "description": F.concat("description", F.lit(" and some more words"))})
    rows = batch.unionByName(near)
    state = spark.createDataFrame([], scoring.STATE)
    got = {(r.source, r.external_id): r.outcome for r in postings.ingest(rows, state, scoring.EVENTS_NOW).collect()}
    want = plain_ingest([r.asDict() for r in rows.collect()])
    assert got == want and sum(v == "deduplicated" for v in want.values()) > 30


def test_bound_of_likeness_is_the_longest_common_subsequence():
    import random


    rnd = random.Random(4)
    for _ in range(60):
        new = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(40)))
        known = ["".join(rnd.choice("abc d") for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(5))]
        want = []
        for k in known:
            row = [0] * (len(new) + 1)
            for x in k:
                now = [0]
                for j, y in enumerate(new):
                    now.append(row[j] + 1 if x == y else max(now[j], row[j + 1]))
                row = now
            want.append(row[-1])
        assert postings.common_lengths(known, [postings._letters(k) for k in known], new) == want


def test_likeness_of_long_texts_by_common_grams_equals_comparing_all():
    """Filters may not lose a pair: long texts, copies with changed letters, with moved and doubled parts, and texts without rare letters."""
    import random
    from difflib import SequenceMatcher

    rnd = random.Random(8)
    vowels, others = "aeiou", "bcdfghjklmnpqrstvwxyz"
    word = lambda: "".join(rnd.choice(others[: rnd.choice([4, 9, 21])]) + rnd.choice(vowels) for _ in range(rnd.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(rnd.choice([10, 40, 60, 90]))) for _ in range(14)] + ["ab" * 150, "ab" * 140 + "c", "a" * 250, ""]
    for x in texts[:14]:
        letters = list(x)
        for _ in range(int(len(x) * rnd.choice([0.01, 0.04, 0.08, 0.13]))):
            letters[rnd.randrange(len(x))] = rnd.choice("etaoinshr ")
        cut = rnd.randrange(len(x))
        texts += ["".join(letters), x[:cut] + x[cut : cut + len(x) // 9] + x[cut:], x[cut:] + x[:cut]]
    texts = sorted(set(texts))
    like = lambda a, b: 2 * min(len(a), len(b)) >= postings.LIKENESS * (len(a) + len(b)) and SequenceMatcher(None, a, b).ratio() >= postings.LIKENESS
    table = postings.Known(texts)
    spared = 0
    for j, b in enumerate(texts):
        possible = table.possible(b, len(texts)).tolist()
        assert list(table.alike(b, possible)) == [i for i, a in enumerate(texts) if like(a, b)]
        spared += len(texts) - len(possible)
    assert spared > len(texts) ** 2 / 2


def test_tasks_and_computed_columns_do_not_grow_with_the_table(spark, monkeypatch):
    from fathomline.operators import ranked

    monkeypatch.setattr(ranked, "TASK_ROWS", 10)
    rows = spark.range(500).withColumn("k", F.col("id") % 100)
    assert ranked.spread(rows, 500, "k").rdd.getNumPartitions() == 50
    got = ranked.once(rows, ["id"], twice=F.col("id") * 2, half=F.col("id") / 2).where("twice > 994 and half > 0")
    assert sorted(map(tuple, got.collect())) == [(498, 996, 249.0), (499, 998, 249.5)]


def test_ingest_compares_whole_texts(spark, monkeypatch):
    """Texts that are alike up to their first 5,000 letters alone, or beyond them alone, over parts of a block."""
    import random

    from fathomline.plans import scoring

    rnd = random.Random(2)
    prose = lambda n: " ".join("".join(rnd.choice("etaoinsh" * 25 + "zqxj") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    head, tail = prose(1000), prose(9000)
    texts = [f"{head} {prose(900)}", f"{head} {prose(900)}", f"{prose(1000)} {tail}", f"{prose(1000)} {tail}", prose(1000), "short", "short one", None]
    rows = [("Acme", "Data Engineer", "P", f"u{i}", "s", str(i), None, None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "company string, title string, location string, application_url string, source string, external_id string, posted_at timestamp, posted_at_precision string, description string")
    for letters in (10_000_000, 30_000):
        monkeypatch.setattr(postings, "SLICE_LETTERS", letters, raising=False)
        got = {r.external_id: r.outcome for r in postings.ingest(df, spark.createDataFrame([], scoring.STATE), NOW).collect()}
        assert [k for k, v in sorted(got.items()) if v == "deduplicated"] == ["3"]


def test_ingest_keeps_each_description_once(spark):
    """What is kept on the way through an ingest holds the texts of the batch once."""
    import os
    import random

    from fathomline.operators.ranked import checkpointed
    from fathomline.plans import scoring

    checkpointed(spark.range(1))  # the folder exists
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("etaoinshrdlu zqxj0123456789") for _ in range(200_000)) for _ in range(6)]
    rows = [("Acme", f"Data Engineer {i % 2}", "P", f"u{i}", "s", str(i), None, None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "company string, title string, location string, application_url string, source string, external_id string, posted_at timestamp, posted_at_precision string, description string")
    before = size()
    out = postings.ingest(df, spark.createDataFrame([], scoring.STATE), NOW)
    assert sorted((r.external_id, r.outcome, r.description == texts[int(r.external_id)]) for r in out.collect()) == [(str(i), "created", True) for i in range(6)]
    assert size() - before < 1.5 * sum(map(len, texts))
