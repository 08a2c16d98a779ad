"""Quality rules, line removal, mixing and the quality classifier against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gritstone.llm import mixing
from gritstone.llm import quality_rules as rules
from gritstone.llm.line_dedup import site_line_dedup
from gritstone.llm.mixing import label_domains, soft_mixing
from gritstone.llm.quality_model import N_STATISTICS, isotonic, quality_scores, statistics

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def buckets_of(words, size):
    codes = []
    for w in words:
        codes.append(xxhash.xxh64_intdigest(w.encode(), 42))
    for a, b in zip(words, words[1:]):
        codes.append(xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)))
    return [(c - 2**64 if c >= 2**63 else c) % size for c in codes]


def base_of(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def brute_rules(texts, trusted, buckets=rules.BUCKETS):
    corpus, target = [1] * buckets, [1] * buckets
    grams = [buckets_of(WORD.findall(t or ""), buckets) for t in texts]
    for g, good in zip(grams, trusted):
        for b in g:
            corpus[b] += 1
            target[b] += good
    c, t = sum(corpus), sum(target)
    weight = [math.log(y / t) - math.log(x / c) for x, y in zip(corpus, target)]
    return [sum(weight[b] for b in g) / len(g) if g else 0.0 for g in grams]


def check_rules(found, ids, texts, trusted):
    scores = brute_rules(texts, trusted)
    got = sorted((str(r.doc_id), tuple(r)[1:]) for r in found)
    want = []
    for d, t, s in zip(ids, texts, scores):
        base = base_of(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        want.append((str(d), (*base, s, failed, not failed and s >= rules.THRESHOLD)))
    for (a, x), (b, y) in zip(got, sorted(want), strict=True):
        assert a == b and x[:5] == y[:5] and x[6:] == y[6:]
        assert x[5] == pytest.approx(y[5], abs=1e-9)


def test_quality_rules_on_edges(spark, edge_docs, no_docs):
    trusted = edge_docs.where("doc_id between 20 and 40").select("doc_id")
    found = rules.quality_rules(edge_docs, trusted).select("row.doc_id", "quality_rules.*").collect()
    rows = edge_docs.collect()
    check_rules(found, [r.doc_id for r in rows], [r.text for r in rows], [r.doc_id is not None and 20 <= r.doc_id <= 40 for r in rows])
    kept = rules.quality_rules(edge_docs, trusted).where("quality_rules.kept").select("row.*")
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.kept for r in found)
    assert rules.quality_rules(no_docs, trusted).count() == 0
    none = rules.quality_rules(edge_docs, trusted.where("false")).select("quality_rules.score").collect()
    assert {r.score for r in none} == {0.0}


def test_quality_rules_query_matches_brute_force(spark):
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    found = entry.queries()["op3_quality_rules"](spark, SF).collect()
    check_rules(found, [r.doc_id for r in docs], [r.text for r in docs], [r.doc_id in good for r in docs])


def test_site_lines(spark, no_docs):
    rows = [(i, f"h{i % 2}", f"menu\n  shared {i % 2}  \nown {i}\n\nmenu") for i in range(10)]
    rows += [(100, None, "menu\nx"), (101, "h0", None), (102, "h1", ""), (103, "rare", "menu"), (104, "rare", "menu")]
    pages = spark.createDataFrame(rows, "doc_id long, host string, text string").withColumn("lines", F.lit(1))
    found = site_line_dedup(pages, F.col("host"), F.col("text")).select("row.doc_id", "lines.*").collect()
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in found}
    for i in range(10):
        assert got[i] == (f"own {i}\n", 5, 3)
    assert got[100] == ("menu\nx", 2, 0) and got[101] == (None, 0, 0) and got[102] == ("", 1, 0)
    assert got[103] == got[104] == ("menu", 1, 0)
    assert site_line_dedup(no_docs, F.col("source"), F.col("text")).count() == 0


def test_mixing_meets_targets(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = label_domains(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    goal = {"clean": 0.8, "low": 0.15, "toxic": 0.05}
    rows = soft_mixing(docs, labels, goal).select("row.doc_id", "tokens", "posteriors", "rate", "copies").collect()
    total = sum(r.tokens for r in rows)
    assert len(rows) == docs.count()
    for name, share in goal.items():
        assert sum(r.tokens * r.posteriors[name] * r.rate for r in rows) / total == pytest.approx(share, abs=2e-3)
    assert all(r.rate >= 0 and math.isclose(sum(r.posteriors.values()), 1) for r in rows)
    assert all(math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1 for r in rows)
    truth = {r.doc_id: r.domain for r in labels.collect()}
    known = [r for r in rows if r.doc_id in truth]
    assert sum(max(r.posteriors, key=r.posteriors.get) == truth[r.doc_id] for r in known) / len(known) > 0.85
    # Null ids and texts, repeated rows, clashing names; disagreeing labels; empty tables.
    some = spark.createDataFrame([(1, "clean"), (1, "low"), (20, "clean"), (40, "low"), (None, "low")], "doc_id long, domain string")
    edge = soft_mixing(edge_docs, some, {"clean": 1.0, "low": 1.0}, max_rate=1.0)
    assert edge.count() == edge_docs.count() and edge.where("rate > 1 or rate < 0 or rate is null").count() == 0
    assert edge.where("copies > 0").select("row.*").columns == edge_docs.columns
    assert soft_mixing(no_docs, some, {"clean": 1.0}).count() == 0
    unlabelled = soft_mixing(edge_docs, some.where("false"), {"clean": 0.5, "low": 0.5}).select("posteriors").collect()
    assert all(r.posteriors["clean"] == pytest.approx(0.5) for r in unlabelled)


def test_quality_scores(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.label for r in rows) / len(rows) > 0.95
    edge = quality_scores(edge_docs, labels).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert quality_scores(no_docs, labels).count() == 0
    assert {r.score for r in quality_scores(edge_docs, labels.where("false")).collect()} == {0.5}


def test_statistics_and_isotonic():
    assert statistics(None) == statistics("") == [0.0] * N_STATISTICS
    assert len(statistics("A b, c! 1")) == N_STATISTICS
    at, value = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.2, 0.8, 0.4, 1.0]), np.array([1.0, 1, 1, 2]))
    assert at.tolist() == pytest.approx([0, 1.5, 3]) and value.tolist() == pytest.approx([0.2, 0.6, 1.0])


def test_all_trusted_texts_count(spark, edge_docs, monkeypatch):
    """More trusted documents than are broadcast give the same weights: none is left out."""
    trusted = edge_docs.where("doc_id between 20 and 40").select("doc_id")
    known = label_domains(spark.createDataFrame([(i, i % 2, 0) for i in range(20, 44)], "doc_id long, quality int, toxic int"))
    docs = edge_docs.select("doc_id", "text")
    goal = {"clean": 0.8, "low": 0.2}
    some = rules.bucket_weights(docs, trusted)
    mixed = {r.number: r.posteriors for r in soft_mixing(docs, known, goal).selectExpr("xxhash64(row.doc_id, row.text) as number", "posteriors").collect()}
    monkeypatch.setattr(rules, "BROADCAST_IDS", 3)
    monkeypatch.setattr(mixing, "BROADCAST_IDS", 3)
    assert rules.bucket_weights(docs, trusted) == some
    for r in soft_mixing(docs, known, goal).selectExpr("xxhash64(row.doc_id, row.text) as number", "posteriors").collect():
        assert all(r.posteriors[d] == pytest.approx(mixed[r.number][d], abs=1e-9) for d in goal)
