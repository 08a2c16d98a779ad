"""The pipeline: each stage keeps what it should of its own input."""

import corpus_pipeline as pipeline
from gritstone.llm.fit import bins_needed

from .test_near_duplicates import shingle_set


def test_stages_on_edges(spark, edge_docs, tmp_path):
    labels = [(20 + i, 1, 0) for i in range(10)] + [(40 + i, 0, 0) for i in range(4)] + [(30, 1, 1), (None, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = edge_docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == edge_docs.columns
        docs = out
    assert docs.count() > 0


def test_stages_on_an_empty_table(spark, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0


def test_pipeline_keeps_clean_documents_and_one_of_each_group(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pipeline.run(spark, sf).collect()
    left = {r.doc_id for r in rows}
    sets = {d: shingle_set(texts[d]) for d in left}
    owners = {}
    for d, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(d)
    for d, s in sets.items():
        shared = {}
        for x in s:
            for e in owners[x]:
                if e < d:
                    shared[e] = shared.get(e, 0) + 1
        # Lines may have been dropped before the join, so texts just under the similarity are let pass.
        assert all(100 * n < 90 * (len(s) + len(sets[e]) - n) for e, n in shared.items())
    assert not [d for d in left if labels.get(d, (1, 0))[0] == 0]
    long_clean = [d for d, k in labels.items() if k == (1, 0) and len(texts[d].split()) >= 60]
    assert sum(d in left for d in long_clean) / len(long_clean) > 0.85  # the rest are copies
    toxic = [d for d, k in labels.items() if k[1] == 1]
    assert sum(d in left for d in toxic) / len(toxic) < 0.4
    sequences = {r.sequence_id for r in rows}
    import numpy as np

    assert len(sequences) <= bins_needed(np.array([r.length for r in rows]), 1024) + 5


def test_near_duplicates_reads_rows_in_parts(spark, monkeypatch, tmp_path):
    """The rows of one file are written in many before the passes over them."""
    from pyspark.sql import functions as F

    files = []
    real = pipeline.ngram_components

    def seen(docs):
        files.append(docs.select(F.input_file_name().alias("f")).distinct().count())
        return real(docs)

    monkeypatch.setattr(pipeline, "ngram_components", seen)
    rows = [(i, f"text of its own {i} with word{i} and more{i}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "one"))
    found = pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "one")), str(tmp_path))
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == list(range(200))
    assert files[0] >= spark.sparkContext.defaultParallelism // 2
