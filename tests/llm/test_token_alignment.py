"""Alignment of two tokenizers against brute force over all pairs of token ends."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from gritstone.llm.token_alignment import RESULT, align_tokens, aligned_documents, aligner

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute_force():
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    decode = decoders.ByteLevel()

    def tokens(text):
        if not text:
            return None
        target = (" " + text).encode()
        encoded = a_model.encode(" " + text, add_special_tokens=False)
        a, at = [], 0
        # Lengths of A's entries are their numbers of signs: one sign is one byte.
        for i, entry in zip(encoded.ids, encoded.tokens):
            at += len(entry)
            a.append((i, at))
        assert at == len(target) and decode.decode(encoded.tokens) == " " + text
        b, at, joined = [], 0, b""
        for i in b_model.encode(text):
            piece = b_model.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()
            joined += raw
            at += len(raw)
            b.append((i, at))
        return (a, b) if joined == target else None

    def run(docs):
        made = [(d, tokens(t)) for d, t in docs]
        linked = [[] if m is None else [(x, y) for x, ex in m[0] for y, ey in m[1] if ex == ey] for _, m in made]
        counts = Counter(p for one in linked for p in one)
        top = Counter()
        for (_, y), n in counts.items():
            top[y] = max(top[y], n)
        rows = []
        for (d, m), links in zip(made, linked):
            if m is None:
                rows.append((d, 0, 0, 0, 0, 0, 0, ""))
                continue
            shared = sorted({e for _, e in m[0]} & {e for _, e in m[1]})
            groups, low = [], 0
            for e in shared:
                groups.append("|".join(",".join(str(i) for i, x in side if low < x <= e) for side in m))
                low = e
            best = sum(counts[p] == top[p[1]] for p in links)
            rows.append((d, len(m[0]), len(m[1]), len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        return sorted(rows, key=str)

    return run


def got(df):
    assert df.columns == RESULT
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_query_equals_brute_force(spark, brute_force):
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got(entry.queries()["op13_token_alignment"](spark, SF)) == brute_force([tuple(r) for r in docs])


@pytest.mark.parametrize("common_pairs", [1_000_000, 40, 1])
def test_edges_and_rare_pairs(spark, edge_docs, no_docs, brute_force, common_pairs):
    odd = ["<|endoftext|> in <s>text</s>", "a▁b", "▁", " lead  and  trail  ", "\x00\x01\x7f", "tab\there\r\n\n", "🙂🙂 é漢字 Ａ ﬁ 　x﻿", "<0x41>", "'s 'll I'D 12 345"]
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = edge_docs.where("coalesce(length(text), 0) < 5000").select("doc_id", "text").unionByName(more)
    assert got(align_tokens(docs, common_pairs=common_pairs)) == brute_force([tuple(r) for r in docs.collect()])
    assert got(align_tokens(no_docs, common_pairs=common_pairs)) == []


def test_long_texts_and_clashing_names(spark, edge_docs, prose):
    rows = align_tokens(edge_docs).collect()
    assert len(rows) == edge_docs.count() and sum(r.n_groups for r in rows if r.doc_id == 10) > 6000
    both = aligner("byte_bpe_50k", "piece_bpe_32k.model")
    n_a, n_b, groups, links = both.document("x" * 60_000)
    assert len(links) == len(groups.split(";")) and n_a and n_b


def test_windows_end_together_and_are_remembered(spark, prose):
    both = aligner("byte_bpe_50k", "piece_bpe_32k.model")
    text = "\n".join(" ".join(prose(i, 40)) for i in range(5))
    a, b = both.a.ids(" " + text), both.b.ids(text)
    cuts_a, cuts_b = both.cuts(a, b)
    assert len(cuts_a) == len(cuts_b) > 150
    for i, k in zip(cuts_a[1:-1].tolist(), cuts_b[1:-1].tolist()):
        assert both.length_a[a[:i]].sum() == both.length_b[b[:k]].sum() and both.marked_a[a[i]] and both.marked_b[b[k]]
    assert (both.groups(a, b) == both.aligned(a, b)).all()
    both.aligned = None  # now all windows are known
    assert len(both.groups(a, b)) > 150
    del both.aligned
    first, kept = both.document(text), len(both.windows)
    again = both.document(text)
    assert again[:3] == first[:3] and (again[3] == first[3]).all() and len(both.windows) == kept > 0


def test_groups_on_request(spark, edge_docs):
    rows = aligned_documents(edge_docs, with_groups=True).collect()
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in rows if r.n_a)
