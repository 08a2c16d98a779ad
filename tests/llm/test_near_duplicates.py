"""Byte removal, shingle components and embedding links against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.llm import components as comp
from gritstone.llm import epsilon_join, ngram_join
from gritstone.llm import suffix_dedup as suffix
from gritstone.llm.anchors import anchors, sliding_argmin
from gritstone.llm.log_index import LogIndex
from gritstone.llm.ngram_join import ngram_components
from gritstone.llm.suffix_dedup import suffix_dedup

SF = "/root/testdata/sf0.001"


def least_labels(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    """``rows`` sorted by id, null first."""
    sets = [shingle_set(t) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    return [(d, len(s), rows[c][0]) for (d, _), s, c in zip(rows, sets, least_labels(len(rows), links))]


def brute_removal(rows):
    seen, out = set(), []
    for _, group in sorted(rows.items(), key=lambda x: (x[0] is not None, x[0])):
        fresh = set()
        for d, text in group:
            data = (text or "").encode()
            gone = np.zeros(len(data) + 1, bool)
            for i in range(len(data) - 49):
                if data[i : i + 50] in seen:
                    gone[i : i + 50] = True
                fresh.add(data[i : i + 50])
            gone = gone[: len(data)]
            rest = bytes(np.frombuffer(data, np.uint8)[~gone])
            runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
            out.append((d, len(data), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
        seen |= fresh
    return sorted(out, key=str)


def grouped(df):
    rows = {}
    for r in df.select("doc_id", "text").collect():
        rows.setdefault(r.doc_id, []).append((r.doc_id, r.text))
    return rows


def test_suffix_dedup_on_edges(spark, edge_docs, no_docs):
    found = suffix_dedup(edge_docs).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute_removal(grouped(edge_docs))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    assert suffix_dedup(no_docs).count() == 0


def test_suffix_dedup_query(spark):
    import __spark_entry__ as entry

    found = entry.queries()["op4_suffix_dedup"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted((tuple(r) for r in found), key=str) == brute_removal(grouped(docs))


def test_every_window_holds_its_anchor():
    data = np.random.default_rng(0).integers(97, 101, 3000).astype(np.uint8).tobytes() + b"z" * 200
    hashes, at, first, last = anchors(data, 50, 16)
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert (windows == np.arange(len(data) - 49)).all()
    assert ((first <= at) & (at + 16 <= first + 50) & (at >= last)).all() and len(at) < len(data) / 10
    values = np.random.default_rng(1).integers(0, 9, 100).astype(np.uint64)
    assert sliding_argmin(values, 7).tolist() == [i + int(values[i : i + 7].argmin()) for i in range(94)]


def test_log_index():
    index, truth, r = LogIndex(), {}, np.random.default_rng(2)
    for _ in range(40):
        keys, docs = r.integers(0, 500, 30).astype(np.uint64), r.integers(0, 1000, 30)
        index.add(keys, docs)
        for k, d in zip(keys.tolist(), docs.tolist()):
            truth[k] = min(d, truth.get(k, d))
        sizes = [len(k) for k, _ in index.levels]
        assert all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
    probe = np.arange(500, dtype=np.uint64)
    assert index.find(probe).tolist() == [truth.get(int(k), np.iinfo(np.int64).max) for k in probe]


def test_ngram_components_on_edges(spark, edge_docs, no_docs):
    found = [tuple(r) for r in ngram_components(edge_docs).collect()]
    rows = sorted(((r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0]))
    # A null id belongs to a text of its own here, so its component is null as well.
    assert sorted(found, key=str) == sorted(brute_components(rows), key=str)
    assert ngram_components(no_docs).count() == 0


def test_ngram_components_query(spark):
    import __spark_entry__ as entry

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    found = sorted(tuple(r) for r in entry.queries()["op6_ngram_join"](spark, SF).collect())
    assert found == brute_components(docs)


def test_ngram_components_of_long_lists(spark, prose, monkeypatch):
    """A chain of near copies: neighbours link, far ones do not; one frequent passage links nobody."""
    words, rows, passage = prose(7, 200), [], " ".join(prose(8, 30))
    for i in range(40):
        words = words[:]
        words[(i * 5) % 200] = f"new{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(i, passage + " " + " ".join(prose(500 + i, 40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_components(docs).collect()) == brute_components(sorted(rows))


def test_prefixes_lose_no_similar_pair():
    r = np.random.default_rng(3)
    ranks = r.integers(0, 5, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(r.integers(5, 60))
        base = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        other = np.unique(np.concatenate([base[int(r.integers(0, 5)) :], r.integers(0, 2**63, int(r.integers(0, 5))).astype(np.uint64)]))
        common = len(np.intersect1d(base, other))
        if 100 * common >= 80 * (len(base) + len(other) - common):
            for order in range(3):
                a, b = (set(ngram_join.prefix(x, ranks, order, 80).tolist()) for x in (base, other))
                assert a & b


def test_components(spark):
    r = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 450)]
    found = {x.node: x.component for x in comp.components(spark.createDataFrame(links, "x long, y long")).collect()}
    labels = least_labels(451, links)
    linked = {v for a, b in links if a != b for v in (a, b)}
    assert found == {v: labels[v] for v in linked}


def brute_links(vectors, least=0.95):
    ids = [v for v, _ in vectors]
    good = [x is not None and all(c is not None and np.isfinite(c) for c in x) and any(x) for _, x in vectors]
    units = [np.array(x, float) / np.linalg.norm(np.array(x, float)) if g else None for (_, x), g in zip(vectors, good)]
    links = [(i, j) for i in range(len(ids)) for j in range(i) if good[i] and good[j] and units[i] @ units[j] >= least]
    counts = [0] * len(ids)
    for i, j in links:
        counts[i] += 1
        counts[j] += 1
    return sorted((ids[i], counts[i], ids[c], c == i) for i, c in enumerate(least_labels(len(ids), links)))


@pytest.mark.parametrize("block", [2048, 40])
def test_epsilon_join(spark, block, monkeypatch):
    monkeypatch.setattr(epsilon_join, "BASE", 16)
    r = np.random.default_rng(5)
    centres = r.normal(0, 1, (20, 8))
    rows = [(i, (centres[i % 20] + r.normal(0, 0.12, 8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]
    rows += [(500, None), (501, [0.0] * 8), (502, [float("nan")] + [1.0] * 7), (503, [None] + [1.0] * 7), (504, []), (505, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("class_id", F.lit("x"))
    found = epsilon_join.epsilon_join(df, block_vectors=block).collect()
    assert sorted(tuple(x) for x in found) == brute_links(rows)
    assert epsilon_join.epsilon_join(df.where("false")).count() == 0


def test_epsilon_join_query(spark):
    import __spark_entry__ as entry

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = entry.queries()["op5_epsilon_join"](spark, SF).collect()
    assert sorted(tuple(x) for x in found) == brute_links([(r.vec_id, r.embedding) for r in sorted(rows)])


def test_a_hub_is_sent_once_for_its_pairs(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, i) for i in range(2, 12)] + [(20, 21), (11, 30)], "a long, b long")
    rows = ngram_join._by_hub(pairs).collect()
    assert sum(r.place for r in rows) == 12 and len(rows) == 12 + 3
    assert {frozenset((r.hub, r.cls)) for r in rows if r.place} == {frozenset(tuple(r)) for r in pairs.collect()}
    monkeypatch.setattr(ngram_join, "HUB_PAIRS", 2)
    many = ngram_join._by_hub(pairs).collect()
    places = {(r.hub, r.bucket) for r in many}
    assert places == {(r.hub, r.bucket) for r in many if r.place == 0} and len([p for p in places if p[0] == 1]) > 1


@pytest.mark.parametrize("buckets", [1, 64])
def test_components_by_hubs_equal_brute_force(spark, edge_docs, monkeypatch, buckets):
    monkeypatch.setattr(ngram_join, "HUB_PAIRS", buckets)
    rows = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    found = ngram_components(edge_docs).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute_components(rows), key=str)


@pytest.mark.parametrize("repeated", [False, True])
def test_texts_are_hashed_for_repeated_ids_alone(spark, edge_docs, monkeypatch, repeated):
    marks = []
    plain = suffix.suffix_dedup.__globals__["_suffixes"]
    monkeypatch.setattr(suffix, "_suffixes", lambda docs, *rest: marks.append(docs.select("text_id").distinct().count()) or plain(docs, *rest))
    docs = edge_docs if repeated else edge_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = suffix_dedup(docs).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute_removal(grouped(docs))
    assert (marks[0] > 1) == repeated


def test_ngram_pairs_of_a_large_group(spark, prose, monkeypatch):
    """Copies that all miss the similarity narrowly share frequent tokens; their pairs do not leave the lists."""
    base, rows, made = prose(11, 100), [], []
    for i in range(120):
        words = base[:]
        for at in ((7 * i) % 90, (7 * i + 45) % 90):
            words[at : at + 3] = [f"own{i}x{at + k}" for k in range(3)]
        rows.append((i, " ".join(words)))
    real = ngram_join._pairs

    def counted(*args):
        found = real(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_components(docs).collect()) == brute_components(rows)
    assert made and max(made) < 10 * len(rows)


def test_bounds_lose_no_similar_pair():
    """Of a pair that links, the first shared token allows it, and so do the marks."""
    r, linked = np.random.default_rng(5), 0
    ranks = r.integers(0, 2, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
    for _ in range(300):
        base = np.unique(r.integers(0, 2**63, int(r.integers(5, 400))).astype(np.uint64))
        other = np.unique(np.concatenate([base[int(r.integers(0, len(base) // 4 + 1)) :], r.integers(0, 2**63, int(r.integers(0, 20))).astype(np.uint64)]))
        common = len(np.intersect1d(base, other))
        if 100 * common < 80 * (len(base) + len(other) - common):
            continue
        linked += 1
        least = ngram_join._least_common(np.array([len(base)]), np.array([len(other)]), 80)[0]
        assert common >= least
        apart = np.bitwise_count((ngram_join._mark(base) ^ ngram_join._mark(other)).view(np.uint64)).sum()
        assert apart <= len(base) + len(other) - 2 * least
        for order in range(2):
            a, b = (ngram_join.prefix(x, ranks, order, 80).tolist() for x in (base, other))
            allowed = []
            for token in set(a) & set(b):
                sizes = [len(x) * ngram_join.PLACES + p.index(token) * ngram_join.PLACES // len(p) for x, p in ((base, a), (other, b))]
                n, left = ngram_join._left(np.array(sizes), 80)
                assert n.tolist() == [len(base), len(other)]
                allowed.append(left.min() >= least)
            assert any(allowed)
    assert linked > 100


def test_log_index_scan():
    """One pass over a batch gives what adding and finding give, and keeps no key twice for one document."""
    from gritstone.llm.bytehash import Ranges

    scanned, plain, r = LogIndex(), LogIndex(), np.random.default_rng(6)
    for _ in range(40):
        keys, docs = r.integers(0, 500, 200).astype(np.uint64), r.integers(-1000, 1000, 200)
        plain.add(keys, docs)
        assert scanned.scan(keys, docs).tolist() == plain.find(keys).tolist()
    probe = np.arange(500, dtype=np.uint64)
    assert scanned.find(probe).tolist() == plain.find(probe).tolist()
    assert not len(scanned.scan(probe[:0], np.empty(0, np.int64)))
    before = [len(k) for k, _ in scanned.levels]
    scanned.scan(probe, np.full(500, 1000))
    assert [len(k) for k, _ in scanned.levels] == before
    data = r.integers(0, 256, 300).astype(np.uint8).tobytes()
    starts = np.arange(285)
    assert Ranges(data).windows(16).tolist() == Ranges(data).hash(starts, starts + 16).tolist()


def test_a_pair_leaves_its_lists_about_once(spark):
    """Two sets share 200 tokens; all their lists have one home, where the pair is counted."""
    rows = [(4 * t, 500 * ngram_join.PLACES, c, 7, c, *[0] * ngram_join.MARK_WORDS) for t in range(200) for c in (1, 2)]
    schema = "token long, size int, cls long, home int, comp long, " + ", ".join(f"{m} long" for m in ngram_join.MARK)
    for turn in (0, None):
        found = ngram_join._pairs(spark.createDataFrame(rows, schema), 16, 80, turn).collect()
        assert [(r.a, r.b, r.order, r.votes) for r in found] == [(1, 2, 0, 200)]


def test_lists_of_one_least_class_have_one_home():
    token = np.repeat(np.arange(300) * 4, 3)
    homes = ngram_join._homes(token, np.tile([5, -9, 70], 300))
    assert len(set(homes.tolist())) == 1 and ngram_join._homes(token[:3], np.array([5, 6, 70]))[0] != homes[0]
    many = 8 * ngram_join.HOME_ROWS
    long = ngram_join._homes(np.repeat(np.arange(300) * 4, many), np.tile(np.arange(many), 300)).reshape(300, many)
    assert (long == long[:, :1]).all() and len(set(long[:, 0].tolist())) == 9


def test_components_end_when_settled(spark, monkeypatch):
    """A star needs one round; no second one shows that nothing changes."""
    steps, real = [], comp._hook
    monkeypatch.setattr(comp, "_hook", lambda *a: steps.append(1) or real(*a))
    found = comp.components(spark.createDataFrame([(9, i) for i in (3, 5, 7, 20)], "x long, y long"))
    assert {r.node: r.component for r in found.collect()} == dict.fromkeys((3, 5, 7, 9, 20), 3) and len(steps) == 2
    assert comp.components(spark.createDataFrame([(1, 1)], "x long, y long")).count() == 0
