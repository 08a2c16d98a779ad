"""The mixing stage keeps clean documents, whatever their language."""

import math

import corpus_pipeline as pipeline
from gritstone.llm.mixing import DomainClassifier, _texts, label_domains, numbered, soft_mixing
from gritstone.runtime import materialize

SF = "/root/testdata/sf0.1"


def test_mixing_stage_keeps_clean_documents_of_every_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    domains = {r.doc_id: r.domain for r in label_domains(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    before = materialize(pipeline.apply_quality_rules(spark, docs, SF).dropDuplicates(["text"]))
    after = {r.doc_id for r in pipeline.mix_domains(spark, before, SF).select("doc_id").collect()}
    clean = [(r.lang, r.doc_id) for r in before.select("lang", "doc_id").collect() if domains.get(r.doc_id) == "clean"]
    for lang in {x for x, _ in clean}:
        ids = [d for x, d in clean if x == lang]
        assert len(ids) > 100 and sum(d not in after for d in ids) <= 0.02 * len(ids), lang
    toxic = [r.doc_id for r in before.select("doc_id").collect() if domains.get(r.doc_id) == "toxic"]
    assert sum(d in after for d in toxic) < 0.3 * len(toxic)


def test_a_group_is_no_sign_of_a_domain(spark, prose):
    """One language is mostly toxic by its labels, but no word of it is; only the bad word tells."""
    rows = []
    for i in range(200):
        lang, bad = ("x", i % 10 < 8) if i < 100 else ("y", i % 10 < 1)
        words = [f"{lang}{w[0]}" for w in prose(i, 40)] + (["bad"] * 3 if bad else [])
        rows.append((i, " ".join(words), lang, "toxic" if bad else "clean"))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, domain string")
    found, scores = DomainClassifier.fit(_texts(numbered(docs, docs.lang), docs.columns), labels, ["clean", "toxic"])
    assert scores.count() == 200
    assert 0 < found.words <= 400
    mixed = soft_mixing(docs, labels, {"clean": 1.0, "toxic": 1.0}, group=docs.lang).select("row.doc_id", "posteriors")
    truth = {r[0]: r[3] for r in rows}
    got = mixed.collect()
    assert all(max(r.posteriors, key=r.posteriors.get) == truth[r.doc_id] for r in got)
    assert all(math.isfinite(v) for r in got for v in r.posteriors.values())
