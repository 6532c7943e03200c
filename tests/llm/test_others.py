from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import fingerprints, mixing, quality, urls

# Mixing


def test_poisson_draws_invert_the_distribution(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(3000)]
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    out = mixing.poisson_mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, total=6000).groupBy("doc_id").count().collect()
    got = {r.doc_id: r["count"] for r in out}
    for i, s in rows:
        rate = 6000 * (0.25 if s == "a" else 0.75) / (2000 if s == "a" else 1000)
        u = (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, below = 0, math.exp(-rate)
        while below <= u:
            k += 1
            below += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        assert got.get(i, 0) == k
    share = sum(n for i, n in got.items() if i % 3 == 0) / sum(got.values())
    assert abs(share - 0.75) < 0.02 and abs(sum(got.values()) - 6000) < 300


def test_many_sources_give_the_same_copies(spark, docs, monkeypatch):
    few = sorted(map(str, mixing.poisson_mix(docs, total=400).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.poisson_mix(docs, total=400).collect())) == few


def test_large_rates_keep_their_mean(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    n = mixing.poisson_mix(rows, total=200 * 900.0).count()
    assert abs(n / 200 - 900) < 10


def test_mixing_odd_rows(docs, nothing, spark):
    out = mixing.poisson_mix(docs, total=400)
    assert [c for c in out.columns if c not in ("copy", "shuffle_key")] == [c for c in docs.columns if c != "copy"]
    rows = out.collect()
    assert any(r.source is None for r in rows)
    twice = [r.copy for r in rows if r.doc_id == 13]
    assert sorted(twice) == sorted(2 * list(range(1, len(twice) // 2 + 1)))
    assert mixing.poisson_mix(nothing).count() == 0
    none = spark.createDataFrame([], "source string, weight double")
    assert mixing.poisson_mix(docs, none).count() == 0


# URL filters


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


URLS = [None, "", "no scheme", "http://", "http://com/", "http://com", "HTTP://WWW.Example.COM/en/x?y#z", "http://m.example.com/en/", "https://example.com/english", "http://a.net/es/1", "http://net/fr/", "http://anet/fr/", "http://x.org/com/", "http://b.com/?u=http://c.net/es/", "http://user@d.com:80/", "http://..com//", "ftp://e.com/a/b/c/d#f", "http://ünï.com/é/\n/x", "x://y://z.com/", "http://" + "a." * 300 + "com/" + "p/" * 300]


def test_urls_against_plain_rules(spark, monkeypatch):
    rules = [*urls.RULES, ("block", "com", "/a"), ("allow", "e.com", "/a/b/c"), ("block", "y:", ""), ("block", "d.com:80", "/"), ("allow", "com", "/a")]
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for bound in (100_000, 0):  # broadcast, then salted
        monkeypatch.setattr(urls, "BROADCAST_RULES", bound)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, table).collect()}
        assert got == {i: plain_verdict(u, rules) for i, u in enumerate(URLS)}


def test_urls_odd_tables(spark):
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(none, rules).count() == 0
    twice = spark.createDataFrame([(1, "http://a.com/", "z", 2)] * 2 + [(None, "http://a.net/es/", "z", 2)], "page_id long, url string, host string, _row int")
    rows = urls.judge_urls(twice, rules.limit(0)).collect()
    assert len(rows) == 3 and all(r.rule is None and r.verdict == "allow" for r in rows)
    assert sorted(str(r.rule) for r in urls.judge_urls(twice, rules).collect()) == ["com/", "com/", "net/es/"]


# Quality


def labelled(spark, n=900):
    rnd, texts, labels = random.Random(4), [], []
    for i in range(n):
        good = rnd.random() < 0.6
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(5, 90))]
        texts.append((i, ". ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ranking_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    scores = quality.quality_scores(docs, quality.fit(docs, labels))
    rows = scores.join(labels, "doc_id").withColumn("held", quality.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held]
    assert len(held) > 200 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, flipped), quality.fit(docs, labels)  # held-out labels are not looked at
    assert np.allclose(a.weights, b.weights, rtol=1e-3) and np.isclose(a.threshold, b.threshold, rtol=1e-3)


def test_quality_fit_takes_few_jobs(spark):
    # The driver keeps a record of each job and stage, and makes code for each kind of them.
    docs, labels = labelled(spark)
    spark.sparkContext.setJobGroup("quality-fit", "")
    try:
        quality.fit(docs, labels)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("quality-fit")
    assert 0 < len(jobs) <= 45


def test_least_loss_is_the_least(spark):
    rng = np.random.default_rng(5)
    for far in (0.2, 3.0, 500.0):  # the last one: all pairs can be told apart, and full steps overshoot
        d = rng.normal(far * np.array([0.1, 1, 0.5, 0]), [1, 1, 30, 0], (500, 4))
        w = quality.least_loss(spark.createDataFrame([(x.tolist(),) for x in d], "_d array<double>").repartition(3), 4)
        slope = -(d / (1 + np.exp(np.clip(d @ w, -700, 700)))[:, None]).mean(axis=0) + quality.PENALTY * w
        assert np.abs(slope).max() < 1e-6 and w[3] == 0 and np.abs(w[:3]).min() > 0


def test_quality_odd_rows(docs, nothing, spark):
    train, labels = labelled(spark, 300)
    ranking = quality.fit(train, labels)
    rows = quality.quality_scores(docs, ranking).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.keep_good(docs, ranking).columns == docs.columns
    assert quality.quality_scores(nothing, ranking).count() == quality.keep_good(nothing, ranking).count() == 0
    blank = quality.fit(nothing, labels)
    assert {r.score for r in quality.quality_scores(docs, blank).collect()} == {0.5}


def test_the_fit_reads_every_label(spark):
    n = 30_000  # more than the 8,000 that an earlier fit was bounded to
    base = [1.0] * (len(quality.FEATURES) - 1)
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.array(*map(F.lit, base), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("v")).alias("x"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) > 300).cast("int").alias("quality"))
    known = [r.x[-1] for r in rows.where(~quality.held_out()).collect()]
    ranking = quality.fit_features(rows, labels)
    assert np.isclose(ranking.centre[-1], np.mean(known), rtol=1e-9)
    strength = (np.array(known) - ranking.centre[-1]) * ranking.weights[-1]
    share = np.mean([v * 1000 < 300.5 for v in known])
    assert np.isclose(ranking.threshold, np.quantile(strength, share), rtol=1e-6, atol=1e-9) and np.isclose(ranking.spread, strength.std() / 4, rtol=1e-6)
    table = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("_label"), "x")
    numbers = quality._numbered(table).groupBy("_label").agg(F.sort_array(F.collect_list("_i")).alias("i")).collect()
    assert all(r.i == list(range(n // 2)) for r in numbers)


def test_exact_quantile(spark):
    for values in ([3.0], [1.0, 1.0, 1.0], [0.0, 1e-300, 5.0, 5.0, 5.0, 1e9], [float(i * i % 1009) for i in range(500)], [1.0, 1.0 + 2**-52, 1.0 + 2**-51]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        for share in (0.0, 0.3, 0.5, 1.0):
            assert np.isclose(quality.exact_quantile(df, "v", share, bins=4), np.quantile(values, share), rtol=1e-15, atol=0)


# Fingerprints


def lanes_of(spark, texts):
    """The lanes of each text, by the operator."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.lanes for r in fingerprints.lane_sums(df, ["i"], "text").collect()}
    return [got[i] for i in range(len(texts))]


def plain_lanes(spark, text):
    """The lanes by adding up the bytes of each unit's hashes one by one."""
    units = []
    for line in (text or "").split("\n"):
        words = line.split(" ")
        units += [line, *(u for k in range(0, len(words), 4) if (u := " ".join(words[k : k + 4]) + (" " if k + 4 < len(words) else "")))]
    hashes = spark.createDataFrame([(u,) for u in units], "u string").select(*(F.xxhash64(F.lit(s), "u") for s in range(8))).collect()
    return [(sum((r[i // 8] >> i % 8 * 8 & 255) - 128 for r in hashes) + 2**31) % 2**32 - 2**31 for i in range(64)]


def test_fingerprints_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PART_BITS", 3)  # the longer text is summed in parts
    texts = ["v w x y z " * 40, "a b c\nd e f\ng h", "one line only", "", None, "1 2 3 4 5 6 7 8 9\n\n\n x  y ", "Grüße\naus Köln 😀"]
    assert lanes_of(spark, texts) == [plain_lanes(spark, t) for t in texts]


def test_fingerprints_are_homomorphic(spark):
    texts = ["a b c\nd e f\ng h", "d e f\na b c\ng h", "a b c\nd e f", "", "one line only"]
    lanes = lanes_of(spark, texts)
    assert lanes[0] == lanes[1] and len({tuple(x) for x in lanes}) == 4
    both = spark.createDataFrame([(lanes[0], lanes[4])], "a array<bigint>, b array<bigint>")
    back = both.select(fingerprints.combine(fingerprints.combine(F.col("a"), F.col("b")), F.col("b"), -1).alias("x"), fingerprints.from_text(fingerprints.as_text(F.col("a"))).alias("y")).first()
    assert back.x == lanes[0] and back.y == lanes[0]
    together = spark.createDataFrame([(1, t) for t in ("a b c", "d e f", "g h")], "i int, text string")
    assert fingerprints.lane_sums(together, ["i"], "text").first().lanes == lanes[0]


def test_fingerprints_depend_on_paragraphs_alone(spark):
    parts = ["a b", "c d e f g", "", "h  i ", "j"]
    moved = [parts, [*parts[1:], parts[0]], [parts[0], parts[3], parts[1], parts[4], parts[2]], [parts[4], *parts[:4]]]
    assert len({tuple(x) for x in lanes_of(spark, ["\n".join(m) for m in moved])}) == 1
    whole = lanes_of(spark, ["\n".join(parts)])[0]
    for k in range(1, 5):
        a, b = lanes_of(spark, ["\n".join(parts[:k]), "\n".join(parts[k:])])
        df = spark.createDataFrame([(a, b, whole)], "a array<bigint>, b array<bigint>, c array<bigint>")
        r = df.select(fingerprints.combine(F.col("a"), F.col("b")).alias("sum"), fingerprints.combine(F.col("c"), F.col("b"), -1).alias("rest")).first()
        assert r.sum == whole and r.rest == a
    units = spark.createDataFrame([("a b\nc d\n\n1 2 3 4 5",)], "t string").select(fingerprints.units(F.col("t")).alias("u")).first().u
    assert units == ["a b", "c d", "", "1 2 3 4 5", "a b", "c d", "1 2 3 4 ", "5"]


def test_edited_texts_and_next_documents(spark, docs, tmp_path):
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(fingerprints.query(spark, str(tmp_path)).collect(), key=lambda r: -r.doc_id)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for k, r in enumerate(rows):
        text, after = texts[r.doc_id], texts[rows[(k + 1) % len(rows)].doc_id]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == text:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    assert len({r.fingerprint for r in rows}) == len({texts[r.doc_id] for r in rows})


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PER_RANGE", 7)
    ids = random.Random(5).sample(range(-(10**12), 10**12), 500)
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(6)
    got = {r.doc_id: r.next_me for r in fingerprints.with_next(df, "doc_id", {"me": F.col("doc_id")}).collect()}
    down = sorted(ids, reverse=True)
    assert got == dict(zip(down, down[1:] + down[:1]))


def test_next_replaces_clashing_columns(spark):
    rows = [(i, f"t{i}", 1, "x", 2) for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __fp_range int, next_text string, __fp_place int")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, "doc_id", {"text": F.col("text")}).collect()}
    assert got == {3: "t2", 2: "t1", 1: "t3"}


def test_fingerprints_odd_tables(spark, nothing, docs, tmp_path):
    nothing.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert fingerprints.query(spark, f"{tmp_path}/a").count() == 0
    docs.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert fingerprints.query(spark, f"{tmp_path}/b").count() == docs.count()
