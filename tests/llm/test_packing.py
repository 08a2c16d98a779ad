"""Sharding, packing, token matrices and the pipeline."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gritstone.llm.certified_packing import certified_packing
from gritstone.llm.fit import CapacityTree, best_fit_decreasing, bins_needed
from gritstone.llm.packed_matrix import packed_matrix, positions, write_packed_matrix
from gritstone.llm.sharding import minimax_shards
from gritstone.llm.tokens import END, cut, encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]


def test_encoder_gives_the_ids_of_the_tokenizer(reference_ids, prose):
    texts = [
        "", " ", "a", " a", "a ", "\n\n a\t\tb  ", "it's we'll I'D", "x" * 5000, "été ñandú 漢字    end", "12 345,6!!  ",
        "<|endoftext|> in text", "\u0000\u0085\u001c x", "🙂🙂 ok", " ".join(prose(1, 300)), "\r\n\r\n a \r b",
    ]
    for t in texts:
        assert encoder().document(t).tolist() == reference_ids(t), repr(t[:20])


def test_cut():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)] and cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_capacity_tree():
    tree, free, r = CapacityTree(100), [], np.random.default_rng(0)
    for _ in range(300):
        size = int(r.integers(1, 101))
        assert tree.best(size) == min((f for f in free if f >= size), default=None)
        f = int(r.integers(0, 101))
        free.append(f)
        tree.add(f, 1)
        if len(free) > 20:
            tree.add(free.pop(0), -1)


def test_best_fit_and_bounds():
    r = np.random.default_rng(1)
    for _ in range(50):
        sizes = r.integers(1, 101, int(r.integers(0, 80)))
        bins, offsets, count = best_fit_decreasing(sizes, 100)
        for b in range(count):
            inside = sorted((o, s) for o, s, x in zip(offsets, sizes, bins) if x == b)
            assert [o for o, _ in inside] == [sum(s for _, s in inside[:i]) for i in range(len(inside))]
            assert sum(s for _, s in inside) <= 100
        assert bins_needed(sizes, 100) <= count
    assert bins_needed(np.array([51] * 7), 100) == 7 and bins_needed(np.array([34] * 9), 100) == 5
    assert bins_needed(np.array([], int), 100) == 0


def check_sequences(rows):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def check_pieces(rows, docs, reference_ids):
    want = sorted((str(d), s, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))
                  for d, t in docs for ids in [reference_ids(t)] for s, n in cut(len(ids), 1024))
    assert sorted((str(r.doc_id), r.start, r.ids_crc32) for r in rows) == want


def test_certified_packing(spark, edge_docs, no_docs, reference_ids, monkeypatch):
    import gritstone.llm.certified_packing as packing

    rows = certified_packing(edge_docs).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in edge_docs.collect()], reference_ids)
    assert check_sequences(rows) >= bins_needed(np.array([r.length for r in rows]), 1024)
    assert certified_packing(no_docs).count() == 0
    monkeypatch.setattr(packing, "PARTITION_PIECES", 250)  # several partitions and rounds
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = certified_packing(docs).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], reference_ids)
    assert check_sequences(rows) <= 1.01 * bins_needed(np.array([r.length for r in rows]), 1024) + 1


def test_packing_query_is_near_the_bound(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["op8_certified_packing"](spark, SF).collect()
    assert check_sequences(rows) <= bins_needed(np.array([r.length for r in rows]), 1024) + 2


def check_matrix(rows, docs, reference_ids, width=1024):
    found = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        place = positions(r.cu_seqlens, width)
        for k, key in enumerate(zip(r.doc_ids, r.pieces, r.starts)):
            a, b = r.cu_seqlens[k : k + 2]
            assert place[a:b].tolist() == list(range(b - a))
            found.setdefault(str(key[0]), []).append((key[2], ids[a:b].tolist()))
    want = {}
    for d, t in docs:
        ids = reference_ids(t)
        want.setdefault(str(d), []).extend((s, ids[s : s + n]) for s, n in cut(len(ids), width))
    assert {d: sorted(v) for d, v in found.items()} == {d: sorted(v) for d, v in want.items()}


def test_packed_matrix_round_trip(spark, edge_docs, no_docs, reference_ids, tmp_path):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check_matrix(packed_matrix(edge_docs).collect(), docs, reference_ids)
    write_packed_matrix(edge_docs, str(tmp_path / "matrix"), width=64, buffer_tokens=500)
    written = spark.read.parquet(str(tmp_path / "matrix")).collect()
    check_matrix(written, docs, reference_ids, 64)
    assert len({r.sequence_id for r in written}) == len(written)
    assert packed_matrix(no_docs).count() == 0


def test_packed_matrix_query(spark, reference_ids):
    import __spark_entry__ as entry

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = entry.queries()["op1_packed_matrix"](spark, SF).collect()
    check_matrix(rows, docs, reference_ids)
    assert len(rows) <= 1.05 * bins_needed(np.array([n for r in rows for n in np.diff(r.cu_seqlens)]), 1024) + 1


def check_shards(rows, docs, shards):
    texts = {}
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    for shard in sizes:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    by_crc = {}
    for r in rows:
        assert by_crc.setdefault((r.text_crc32, r.size), r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    for d, t in docs:
        texts.setdefault(t or "", []).append((d is not None, d or 0))
    groups = sorted((min(v), len(v) * (len(t.encode()) + 8)) for t, v in texts.items())

    def fits(capacity):
        count, used = 1, 0
        for _, n in groups:
            if used + n > capacity:
                count, used = count + 1, 0
            used += n
        return count <= shards

    capacity = max((n for _, n in groups), default=0)
    low, high = capacity, sum(n for _, n in groups)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    assert max(sizes.values()) == low
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_minimax_shards(spark, edge_docs, no_docs, shards, monkeypatch):
    import gritstone.llm.sharding as sharding

    monkeypatch.setattr(sharding, "BLOCKS", 4)  # cuts fall inside blocks
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check_shards(minimax_shards(edge_docs, shards).collect(), docs, shards)
    assert minimax_shards(no_docs, shards).count() == 0


def test_sharding_query(spark):
    import __spark_entry__ as entry

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_shards(entry.queries()["op7_minimax_sharding"](spark, SF).collect(), docs, 24)
