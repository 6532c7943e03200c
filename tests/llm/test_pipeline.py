from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline


def corpus(spark, folder):
    rnd, docs, labels = random.Random(9), [], []
    for i in range(160):
        good = i % 4 != 0
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(30, 120))]
        text = ". ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(1000 + i, docs[i][1], "en", "s0", docs[i][4]) for i in range(1, 9)]  # exact copies
    docs.append((2000, docs[1][1] + " token = abcdefgh12345678", "en", "s1", 0))
    docs.append((2001, None, "en", None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, step, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        if name != "packing":
            assert step.columns == columns
        step.write.parquet(f"{tmp_path}/out-{name}")
        step = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = step
    good = {r.doc_id for r in seen["quality"].collect()}
    assert {i for i, *_ in rows[:160] if i % 4} <= good and not {i for i, *_ in rows[:160] if i % 4 == 0} & good
    one = {r.doc_id for r in seen["near_dedup"].collect()}
    assert one == {i for i in good if not 1000 <= i < 2001} | (good & {2001})
    redacted = seen["secrets"].where(F.col("text").contains("token = "))
    assert redacted.count() == 0 and seen["secrets"].count() == len(one)
    mixed = {r.doc_id for r in seen["mixing"].collect()}
    packed = seen["packing"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == mixed
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    copies = packed.groupBy("doc_id", "start").count().where("count > 1")
    assert copies.count() > 0 and packed.groupBy("doc_id", "sequence_id").count().where("count > 1").count() == 0


def test_stages_on_an_empty_table(spark, tmp_path):
    corpus(spark, tmp_path)
    step = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        step = spark.read.parquet(f"{tmp_path}/out-{name}")
        assert step.count() == 0
