"""The pipeline's near-duplicate stage keeps one row of each group, whatever the rows' ids."""

import corpus_pipeline as pipeline


def test_one_row_of_each_group_stays(spark, prose):
    a, b, c, d = (" ".join(prose(900 + i, 60)) for i in range(4))
    rows = [(1, a), (1, a), (None, a), (2, b), (None, c), (None, c), (3, d), (3, c + " x"), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()))
    assert got == sorted([(False, 1, a), (False, 2, b), (False, 3, c + " x"), (False, 3, d), (False, 4, ""), (False, 5, "")])
