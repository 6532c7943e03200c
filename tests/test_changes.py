from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.operators import derived, versions
from fathomline.plans import changes
from fathomline.plans.registry import Tables
from fathomline.streaming import ledger
from fathomline.streaming.events import upsert_batches

FOLDER = "/root/testdata/sf0.001"


def ratio(a, b):
    return SequenceMatcher(None, (a or "").split(), (b or "").split(), autojunk=False).ratio()


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


WORDS = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, st.sampled_from([0.3, 0.6, 0.9]))
def test_bounds_never_lose_a_pair(a, b, least):
    assert versions.common_length(a, b) == plain_common(a, b)
    decided, found = versions.likeness(" ".join(a), " ".join(b), least)
    assert (found is not None and found >= least) == (ratio(" ".join(a), " ".join(b)) >= least)
    assert found is None or found == ratio(" ".join(a), " ".join(b))


def test_versions_of_documents(spark):
    t = Tables(spark, FOLDER)
    short = t.documents.where(F.length("text") < 6000)
    near = short.withColumns({"doc_id": F.col("doc_id") * 2 + 1, "text": F.concat("text", F.lit(" a few words more"))})
    rows = short.withColumn("doc_id", F.col("doc_id") * 2).unionByName(near)
    texts = {r.doc_id: (r.source, r.text) for r in rows.collect()}
    got = versions.compare_versions(versions.consecutive(rows, "source", "doc_id", "text"), "old", "new").collect()
    by: dict = {}
    for k in sorted(texts):
        by.setdefault(texts[k][0], []).append(k)
    want = {(a, b) for ids in by.values() for a, b in zip(ids, ids[1:])}
    assert {(r.doc_id, r.next) for r in got} == want
    assert all(r.same == (ratio(texts[r.doc_id][1], texts[r.next][1]) >= 0.9) for r in got)
    kinds = {r.decided for r in got}
    assert {"matched"} <= kinds and kinds & {"words", "order"} and any(r.same for r in got)


@pytest.mark.parametrize("span", [1, 4, 4096])
def test_following(spark, span):
    rows = [("a", i) for i in (5, 1, 9, 9, -3, 100)] + [(None, 7), (None, 2), ("b", 4), ("c", None)]
    got = {(r.source, r.i): r.next for r in versions.following(spark.createDataFrame(rows, "source string, i long"), "source", "i", span).collect()}
    assert got == {("a", -3): 1, ("a", 1): 5, ("a", 5): 9, ("a", 9): 100, ("a", 100): None, (None, 2): 7, (None, 7): None, ("b", 4): None}


def same(a, b):
    return sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.select(a.columns).collect())))


def test_batches_equal_a_full_recomputation(spark):
    t = Tables(spark, FOLDER)
    sources, jobs = changes.listings(t)
    state = derived.initial(sources, jobs)
    all_jobs = jobs.count()
    for k in (1, 2, 3):
        state, touched = derived.reconcile_batch(state, *changes.batch(sources, jobs, k))
        full = derived.score_jobs(state.jobs, state.sources)
        assert same(full, state.job_scores) and same(derived.score_companies(full), state.company_scores)
        n = {r.table: r.n for r in touched.collect()}
        assert 0 < n["jobs_changed"] <= n["jobs"] < all_jobs / 10 and n["companies_changed"] <= n["companies"] <= 2 * n["jobs_changed"]


def test_changes_that_change_nothing_stop(spark):
    sources = spark.createDataFrame([(1, 1, "OPEN", 2.0), (2, 1, "CLOSED", 3.0), (None, 1, "OPEN", 1.0)], "job_id long, source_id long, status string, value double")
    jobs = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "job_id long, company_id long")
    state = derived.initial(sources, jobs)
    none = jobs.limit(0).withColumn("deleted", F.lit(False))
    again = sources.where("job_id is not null").withColumns({"value": F.when(F.col("status") == "CLOSED", 9.0).otherwise(F.col("value")), "deleted": F.lit(None).cast("boolean")})
    after, touched = derived.reconcile_batch(state, again, none)
    assert {r.table: r.n for r in touched.collect()} == {"jobs": 2, "jobs_changed": 0, "companies": 0, "companies_changed": 0}
    gone = jobs.where("job_id = 1").withColumn("deleted", F.lit(True))
    after, touched = derived.reconcile_batch(after, again.limit(0), gone)
    assert [r.company_id for r in after.company_scores.collect()] == [20]
    moved = spark.createDataFrame([(2, 10, False)], "job_id long, company_id long, deleted boolean")
    after, touched = derived.reconcile_batch(after, again.limit(0), moved)
    assert [r.company_id for r in after.company_scores.collect()] == [10] and {r.table: r.n for r in touched.collect()}["companies"] == 2


def added(state, batch):
    """Counts by key: not the same if a batch is applied twice."""
    return state.unionByName(batch.groupBy("k").agg(F.sum("n").alias("n"))).groupBy("k").agg(F.sum("n").alias("n"))


def opened(spark, root, merge=added):
    return ledger.Ledger(spark, root, "k long, n long", ["k"], merge, buckets=8)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    sink = opened(spark, str(tmp_path))
    assert sink.state().collect() == []
    batches = [spark.createDataFrame([(i % 20 + b, 1) for i in range(50)], "k long, n long") for b in range(3)]
    for b, batch in enumerate(batches):
        assert sink.write(batch, b) and not sink.write(batch, b)
    assert not sink.write(batches[0], 0)
    want = {}
    for batch in batches:
        for r in batch.collect():
            want[r.k] = want.get(r.k, 0) + 1
    assert {r.k: r.n for r in opened(spark, str(tmp_path)).state().collect()} == want
    assert sink.write(batches[0].limit(0), 3) and {r.k: r.n for r in sink.state().collect()} == want
    one = spark.createDataFrame([(0, 5)], "k long, n long")
    assert sink.write(one, 4)
    entries = sink.entries()
    assert sum(v == 4 for v in entries[4].values()) == 1  # one bucket was written anew
    assert sink.clean(keep=1) and {r.k: r.n for r in sink.state().collect()} == want | {0: want[0] + 5}


def test_a_stop_between_data_and_ledger(spark, tmp_path, monkeypatch):
    sink = opened(spark, str(tmp_path))
    first, second = (spark.createDataFrame([(k, n) for k in range(30)], "k long, n long") for n in (1, 10))
    sink.write(first, 0)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "_commit", stop)
        with pytest.raises(RuntimeError):
            sink.write(second, 1)
    assert {r.n for r in sink.state().collect()} == {1}  # what was written is not seen
    assert sink.write(second, 1) and not sink.write(second, 1)
    assert {r.n for r in sink.state().collect()} == {11}

    def half(state, batch):
        raise ValueError("in the midst of a batch")

    with pytest.raises(ValueError):
        opened(spark, str(tmp_path), half).write(second, 2)
    assert {r.n for r in sink.state().collect()} == {11} and sink.write(second, 2) and {r.n for r in sink.state().collect()} == {21}


def test_a_stream_into_the_ledger(spark, tmp_path):
    folder = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([(k, n + 1) for k in range(10)], "k long, n long").coalesce(1).write.mode("append").parquet(folder)
    sink = opened(spark, str(tmp_path / "out"))
    for attempt in range(2):  # the second stream has lost its own checkpoint and delivers all batches again
        stream = spark.readStream.schema("k long, n long").option("maxFilesPerTrigger", 1).parquet(folder)
        upsert_batches(stream, sink.write, str(tmp_path / f"checkpoint-{attempt}")).awaitTermination()
    assert {r.k: r.n for r in sink.state().collect()} == {k: 6 for k in range(10)}
