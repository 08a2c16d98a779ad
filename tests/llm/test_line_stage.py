"""The pipeline's line stage takes boilerplate of sources and leaves copies to the next stage."""

import corpus_pipeline as pipeline


def test_shared_lines_of_a_source_go_and_copies_stay_whole(spark):
    own = [(i, f"own {i} a\nown {i} b\nfooter of the source", "big") for i in range(90)]
    own += [(100 + i, f"own {100 + i} a\nown {100 + i} b", "big") for i in range(300)]
    copies = [(500 + i, f"first\nsecond\nthird\nend {i}", "big") for i in range(20)]
    pairs = [(600 + i, f"said twice\nown {i}\nown {i} c", "big") for i in range(2)]
    small = [(700 + i, f"small {i}\nshared here\nsmall {i} c", "little") for i in range(4)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in own + copies + pairs + small], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in pipeline.drop_boilerplate_lines(spark, docs, "").collect()}
    assert len(got) == docs.count()
    for i in range(90):
        assert got[i].text == f"own {i} a\nown {i} b" and got[i].n_chars == len(got[i].text)
    assert got[100].text == "own 100 a\nown 100 b"
    assert got[500].text == "first\nsecond\nthird\nend 0"
    assert got[600].text == "said twice\nown 0\nown 0 c"
    assert got[700].text == "small 0\nshared here\nsmall 0 c"


def test_the_stage_takes_effect_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.selectExpr("sum(n_chars)").first()[0]
    out = pipeline.drop_boilerplate_lines(spark, docs, sf)
    changed = out.join(docs.selectExpr("doc_id", "n_chars as n"), "doc_id").where("n_chars < n")
    row = changed.selectExpr("count(*) as docs", "sum(n - n_chars) as chars", "sum(cast(n_chars = 0 as int)) as emptied").first()
    assert row.docs > 500 and row.chars < 0.05 * before and row.emptied == 0
