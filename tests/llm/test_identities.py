"""Null and repeated ids in the operators on pairs, and shards of near equal size."""

import pytest

import gritstone.llm.sharding as sharding
from gritstone.llm.epsilon_join import epsilon_join
from gritstone.llm.ngram_join import ngram_components

VECTORS = "vec_id long, embedding array<double>"


def test_vectors_with_repeated_ids_are_judged_each_for_itself(spark):
    rows = epsilon_join(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01])], VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_vectors_without_id_link(spark):
    rows = [(None, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.01, 1.0]), (5, None)]
    found = epsilon_join(spark.createDataFrame(rows, VECTORS)).collect()
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in found)
    assert got == [("2", 1, "2", True), ("5", 0, "5", True), ("None", 1, "2", False), ("None", 1, "None", True), ("None", 1, "None", True)]


@pytest.mark.parametrize("first", [None, 5])
def test_documents_without_id_link(spark, prose, first):
    words = prose(11, 60)
    rows = [(first, " ".join(words)), (7, " ".join([*words[:-1], "other"])), (None, " ".join(prose(12, 60))), (9, " ".join(prose(13, 60)))]
    found = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    least = 7 if first is None else 5
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)
    assert got == sorted([(str(first), 56, str(least)), ("7", 56, str(least)), ("None", 56, "None"), ("9", 56, "9")])


def test_shards_are_near_equal(spark):
    found = sharding.minimax_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    sizes = [0] * 24
    for r in found:
        sizes[r.shard] += r.size
    largest = max(r.size for r in found)
    mean = sum(sizes) / 24
    assert max(sizes) - min(sizes) <= 2 * largest and min(sizes) > 0.7 * mean, sizes


def test_even_cuts_keep_the_least_capacity(spark):
    """Sizes in order, a few large: no shard is above the least capacity, found by trying all."""
    from itertools import combinations

    sizes = [9, 1, 1, 1, 8, 2, 2, 7, 1, 1, 6, 3]
    rows = [(i, chr(97 + i) * (n * 10)) for i, n in enumerate(sizes)]
    found = sharding.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    weights = [n * 10 + sharding.ROW_BYTES for n in sizes]
    made = [sum(r.size for r in found if r.shard == s) for s in range(4)]
    least = min(max(sum(weights[a:b]) for a, b in zip((0, *c), (*c, 12))) for c in combinations(range(1, 12), 3))
    assert max(made) == least and sum(made) == sum(weights) and min(made) > 0
