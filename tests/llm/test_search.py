"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import pytest

import gritstone.llm.max_sketch as search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda c: c.group().lower(), t) for t in TERM.findall(text or "")]


def brute_force(docs, items, k=50):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in items:
        scored = []
        for place, (d, c) in enumerate(counts):
            n, score = sum(c.values()), 0
            for t in set(terms_of(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * n * n_docs) // total
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, place))
        for rank, (s, null, d, _) in enumerate(sorted(scored)[:k], 1):
            rows.append((item, rank, None if null else d, -s))
    return sorted(rows, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def pairs(df, key):
    return [(r[key], r.text) for r in df.select(key, "text").collect()]


def test_terms():
    for text in ["", "Ab1 cD-É é_x\x7f{z}", "ÀÉ漢字 x y", "a\x00b", "ſK"]:
        assert [t.decode() for t in search.terms(text.encode())] == terms_of(text)
    assert search.terms(None) == []


def test_bound_is_never_below_the_score(prose):
    import numpy as np
    import pyarrow as pa

    words = [w.encode() for w in prose(1, 3000)]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(words[:400]))}
    items = [np.arange(0, 200), np.arange(150, len(vocabulary)), np.arange(0)]
    block = search.Block(vocabulary, items, np.arange(len(vocabulary)) % 90 + 1, 10, 20_000, 256)
    texts = [b" ".join(words[i : i + 900] + words[:i]) for i in range(0, 2000, 100)] + [b""]
    counts = [Counter(search.terms(t)) for t in texts]
    made = [search.sketch(c, search.Places(256)) for c in counts]
    n = [sum(c.values()) for c in counts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(n))), pa.array(range(len(n))), pa.array(n), pa.array([a.tobytes() for a, _ in made]), pa.array([b.tobytes() for _, b in made])],
        ["number", "doc_id", "n_terms", "coordinates", "peaks"],
    )
    for rows, bounds in block.bounds(batch):
        for r, row in zip(rows, bounds):
            for q, bound in enumerate(row):
                assert bound >= block.score(counts[r], n[r], [q])[0]


def test_query_equals_brute_force(spark):
    import __spark_entry__ as entry

    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert got(entry.queries()["op11_max_sketch_search"](spark, SF)) == brute_force(pairs(docs, "doc_id"), pairs(items, "item_id"))


@pytest.mark.parametrize("coordinates", [1 << 16, 4])
def test_edges_collisions_and_blocks(spark, edge_docs, no_docs, prose, coordinates):
    """With four coordinates every bound is far too high: several portions are rescored, and the ranking stays exact."""
    base = prose(1, 120)
    rows = [(1, " ".join(base)), (2, None), (3, ""), (4, "one TWO été"), (4, "one TWO été"), (None, "end漢字 漢字 " + " ".join(prose(103, 60))), (7, "nowhereatall"), (8, "a")]
    items = spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, score string")
    docs = pairs(edge_docs, "doc_id")
    for k, options in [(50, {"block_items": 4}), (2, {"first_portion": 1})]:
        assert got(search.ranked_search(edge_docs, items, k, coordinates, **options)) == brute_force(docs, rows, k)
    assert got(search.ranked_search(no_docs, items)) == [] and got(search.ranked_search(edge_docs, items.limit(0))) == []
    assert got(search.ranked_search(edge_docs.where("text is null or text = ''"), items)) == []


def test_many_copies(spark, prose):
    """Hundreds of equal scores: the smallest ids win, and texts joined by a shuffle give the same."""
    docs = [(i, " ".join(prose(1, 40))) for i in range(300, 0, -1)] + [(1000 + i, " ".join(prose(i, 30))) for i in range(2, 20)]
    items = [(1, " ".join(prose(1, 20))), (2, " ".join(prose(5, 9)))]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    wanted = brute_force(docs, items, 7)
    questions = spark.createDataFrame(items, "item_id long, text string")
    assert got(search.ranked_search(table, questions, 7, first_portion=3)) == wanted
