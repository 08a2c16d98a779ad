"""Alignment of the tokens of two tokenizers over the same texts.

Tokenizer A is a byte-level BPE, B a sentence-piece BPE with byte fallback. Both
encode a whole text (A with the space in front that B adds itself). Where tokens
of both end at the same byte, the text is cut into groups; the two tokens that end
there are linked; no token is empty, so every group has one link.

After the full tokenisation, the bytes at which a token marked with a space begins
in both are anchors, once the tokens before them are verified to end there. Anchors
split a document into windows of token ids. Ids determine bytes, so a window's
alignment follows from its two tuples of ids: it is worked out once and remembered by
these tuples (a bounded number in each worker; very long windows are not kept).

Tasks tokenise and align where they read and write one row per document: its counts
and digest, and the distinct linked pairs of ids with their numbers. Pairs are summed
in tasks, then in a shuffle. For the lookup of the sums, the most frequent pairs (a
bounded table) go to every task; what is left of a document's pairs, if any, is joined
by a shuffle. No document's text or token list is shuffled.

Null and empty texts, and texts whose tokens do not spell the text (such as those that
hold U+2581 itself), have no tokens: all numbers are 0 and the digest is empty. Strings
of special tokens are plain text. Repeated documents, and rows without id, are rows of
their own. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.tokens import VOCABULARY, Encoder
from gritstone.runtime import batch_rows, materialize, share_package

PIECES = "piece_bpe_32k.model"
#: Windows remembered at once (some 220 bytes each), and the ids of the longest that is.
KEPT_WINDOWS = 100_000
KEPT_TOKENS = 32
#: Pairs that every task holds for the lookup (17 bytes each).
COMMON_PAIRS = 1_000_000
#: Distinct pairs that a counting task sums before it passes them on.
SUMMED_PAIRS = 500_000
BATCH = 512

DOCUMENT_SCHEMA = "number long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
B_BITS = 32
#: Where one of two equal patterns is faster, and pieces whose tokenisation is left to the slower encoder; see ``tokens``.
LONG_SPACE = re.compile(r"\s\s|\s$")
LONG_PIECE = 2000
#: Stands between the ids of A and B of a window; no id is that large.
MARK = 0xFFFFFFFF


def _byte_of_sign() -> dict[str, int]:
    """Bytes by the signs that a byte-level vocabulary writes them with: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PlainEncoder(Encoder):
    """Ids of tokenizer A where strings of special tokens are plain text."""

    def __init__(self, vocabulary: str = VOCABULARY):
        super().__init__(vocabulary)
        self._slow.encode_special_tokens = True
        self._special = None

    def ids(self, text: str) -> np.ndarray:
        if self._fast is None or max(map(len, text.split()), default=0) >= LONG_PIECE:
            return super().ids(text)
        chosen = self._fast if LONG_SPACE.search(text) else self._plain
        return np.array(chosen.encode_ordinary(text), "<u4")

    def joined(self, ids: list[int]) -> bytes:
        """What the tokens spell."""
        return self._plain.decode_bytes(ids) if self._plain else b"".join([self._spelled[i] for i in ids])

    def spelled(self) -> list[bytes]:
        signs = _byte_of_sign()
        size = self._slow.get_vocab_size()
        entries = [self._slow.id_to_token(i) for i in range(size)]
        self._spelled = [bytes(signs[c] for c in e) if e is not None and all(c in signs for c in e) else b"" for e in entries]
        return self._spelled


class PieceEncoder:
    """Ids of tokenizer B, which puts a space before the text."""

    def __init__(self, model: str = PIECES):
        import public_tokenizers
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text, num_threads=1), "<u4")

    def spelled(self) -> list[bytes]:
        m = self._model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the windows aligned so far."""

    def __init__(self, vocabulary: str, pieces: str):
        self.a, self.b = PlainEncoder(vocabulary), PieceEncoder(pieces)
        self.bytes_a, self.bytes_b = self.a.spelled(), self.b.spelled()
        self.length_a, self.length_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.marked_a, self.marked_b = (np.array([t[:1] == b" " for t in side]) for side in (self.bytes_a, self.bytes_b))
        # The digits of every id, filled up with zero bytes that leave room for a mark.
        names = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        width = len(names[-1]) + 1
        self.digits = np.frombuffer(b"".join(n.ljust(width, b"\0") for n in names), np.uint8).reshape(-1, width)
        self.n_digits = np.array([len(n) for n in names], np.int64)
        self.windows: dict[bytes, bytes] = {}
        self.asked = self.missed = 0

    def start(self) -> None:
        """At the start of a task: forget the windows if they are full and of little use."""
        if len(self.windows) >= KEPT_WINDOWS and 2 * self.missed > self.asked:
            self.windows.clear()
        self.asked = self.missed = 0

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers in A and B at which windows begin, the end included: where tokens that both mark with a space
        begin at one byte, at which the tokens before them end."""
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at_a, at_b = np.flatnonzero(self.marked_a[a[1:]]) + 1, np.flatnonzero(self.marked_b[b[1:]]) + 1
        before_a, before_b = ends_a[at_a - 1], ends_b[at_b - 1]
        ended = np.zeros((2, ends_a[-1] + 1), bool)
        ended[0, before_a] = True
        ended[1, before_b] = True
        return np.concatenate(([0], at_a[ended[1, before_a]], [len(a)])), np.concatenate(([0], at_b[ended[0, before_b]], [len(b)]))

    def aligned(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of A and B tokens of every group: a group ends where tokens of both do."""
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ended = np.zeros((2, ends_a[-1] + 1), bool)
        ended[0, ends_a] = True
        ended[1, ends_b] = True
        at_a, at_b = np.flatnonzero(ended[1, ends_a]) + 1, np.flatnonzero(ended[0, ends_b]) + 1
        return np.stack([np.diff(at_a, prepend=0), np.diff(at_b, prepend=0)], axis=1).astype("<u4")

    def groups(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same from windows: known ones are found by their ids, A's and B's with a mark between; if there are
        others, the document is aligned and theirs are remembered."""
        cut_a, cut_b = self.cuts(a, b)
        size_a, size_b = np.diff(cut_a), np.diff(cut_b)
        size = size_a + size_b + 1
        start = np.cumsum(size) - size
        ids = np.full(start[-1] + size[-1], MARK, "<u4")
        ids[np.arange(len(a)) + np.repeat(start - cut_a[:-1], size_a)] = a
        ids[np.arange(len(b)) + np.repeat(start + size_a + 1 - cut_b[:-1], size_b)] = b
        packed = ids.tobytes()
        edges = [*(4 * start).tolist(), len(packed)]
        keys = [packed[i:j] for i, j in zip(edges, edges[1:], strict=False)]
        found = list(map(self.windows.get, keys))
        new = [w for w, known in enumerate(found) if known is None]
        self.asked += len(keys)
        self.missed += len(new)
        if not new:
            return np.frombuffer(b"".join(found), "<u4").reshape(-1, 2)
        whole = self.aligned(a, b)
        if len(self.windows) < KEPT_WINDOWS:
            # The most frequent windows come early.
            bounds = (8 * np.searchsorted(np.cumsum(whole[:, 0]), cut_a, side="right")).tolist()
            data = whole.tobytes()
            for w in new:
                if len(keys[w]) <= 4 * KEPT_TOKENS:
                    self.windows[keys[w]] = data[bounds[w] : bounds[w + 1]]
        return whole

    def document(self, text: str | None) -> tuple[int, int, str, np.ndarray]:
        """Numbers of A and B tokens, the groups as text, and the linked pair of each group."""
        none = np.empty(0, "<i8")
        if not text:
            return 0, 0, "", none
        spaced = " " + text
        target = spaced.encode("utf-8", "surrogatepass")
        a, b = self.a.ids(spaced), self.b.ids(text)
        spelled_b = self.bytes_b
        if b"".join([spelled_b[i] for i in b.tolist()]) != target or self.a.joined(a.tolist()) != target:
            return 0, 0, "", none
        groups = self.groups(a, b)
        ends = np.cumsum(groups, axis=0, dtype=np.int64)
        last_a, last_b = ends[:, 0] - 1, ends[:, 1] - 1
        # A's ids of a group stand before B's; commas follow them, a bar A's last and a semicolon B's last.
        at_a = np.arange(len(a)) + np.repeat(ends[:, 1] - groups[:, 1], groups[:, 0])
        at_b = np.arange(len(b)) + np.repeat(ends[:, 0], groups[:, 1])
        ids = np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        marks = np.full(len(ids), ord(","), np.uint8)
        marks[at_a[last_a]], marks[at_b[last_b]] = ord("|"), ord(";")
        shown = self.digits[ids]
        shown[np.arange(len(ids)), self.n_digits[ids]] = marks
        written = shown[shown != 0].tobytes()[:-1].decode("ascii")
        return len(a), len(b), written, a[last_a].astype("<i8") << B_BITS | b[last_b]


@lru_cache(maxsize=1)
def aligner(vocabulary: str, pieces: str) -> Aligner:
    """One per worker process."""
    return Aligner(vocabulary, pieces)


def aligned_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES, with_groups: bool = False) -> DataFrame:
    """One written row per document of ``docs`` (``doc_id, text``) with its distinct linked pairs; on request with its groups as text."""
    spark = docs.sparkSession
    share_package(spark)
    names = [f.split()[0] for f in DOCUMENT_SCHEMA.split(", ")] + ["groups"] * with_groups
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()] + [pa.string()] * with_groups

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(vocabulary, pieces)
        both.start()
        for batch in batches:
            out = []
            for number, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n_a, n_b, groups, links = both.document(text)
                pairs, times = np.unique(links, return_counts=True)
                digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                out.append((number, doc, n_a, n_b, len(links), len(links), digest, pairs.tobytes(), times.astype("<i4").tobytes(), groups)[: len(names)])
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long"), "text")
    with batch_rows(spark, BATCH):
        return materialize(rows.mapInArrow(align, DOCUMENT_SCHEMA + ", groups string" * with_groups))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links of each pair of ids over all documents: ``pair, count, best`` (whether no other pair of its B id has more)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            more = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            times = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").astype(np.int64)
            codes, place = np.unique(np.concatenate([codes, more]), return_inverse=True)
            # Whole numbers below 2^53 are exact in doubles.
            sums = np.bincount(place, np.concatenate([sums, times]), len(codes)).astype(np.int64)
            if len(codes) >= SUMMED_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["pair", "n"])
                codes, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["pair", "n"])

    sums = aligned.select("pairs", "times").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    counts = materialize(sums.withColumn("b", b_id))
    # One row for each id of B: the vocabulary bounds it.
    tops = counts.groupBy("b").agg(F.max("count").alias("top"))
    return materialize(counts.join(F.broadcast(tops), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best")))


def _looked_up(aligned: DataFrame, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Sums over the pairs of the common table; the other pairs stay as arrays."""
    shared = aligned.sparkSession.sparkContext.broadcast(common)
    passed = ["number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = (
        "number long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        " n_best long, count_sum long, rest array<struct<pair:long,times:long>>"
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in batches:
            coded = batch.column(len(passed)).to_pylist()
            code = np.frombuffer(b"".join(coded), "<i8")
            times = np.frombuffer(b"".join(batch.column(len(passed) + 1).to_pylist()), "<i4").astype(np.int64)
            edges = np.concatenate(([0], np.cumsum([len(c) // 8 for c in coded]))).astype(np.int64)
            place = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
            hit = pairs[place] == code if len(pairs) else np.zeros(len(code), bool)
            found = np.where(hit, counts[place], 0) * times if len(pairs) else np.zeros(len(code), np.int64)
            top = np.where(hit & best[place], times, 0) if len(pairs) else found
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[edges]) for x in (top, found)]
            lost = ~hit
            offsets = np.concatenate(([0], np.cumsum(lost)))[edges]
            rest = pa.StructArray.from_arrays([pa.array(code[lost]), pa.array(times[lost])], ["pair", "times"])
            arrays = [*batch.columns[: len(passed)], *[pa.array(s) for s in sums], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest)]
            yield pa.RecordBatch.from_arrays(arrays, [*passed, "n_best", "count_sum", "rest"])

    return aligned.select(*passed, "pairs", "times").mapInArrow(look_up, schema)


def link_counts(aligned: DataFrame, counts: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """Per document ``n_best`` and ``count_sum`` beside its own numbers."""
    n_pairs = counts.count()
    common = counts if n_pairs <= common_pairs else counts.orderBy(F.col("count").desc(), "pair").limit(common_pairs)
    held = common.toArrow().sort_by("pair")
    arrays = tuple(held.column(c).to_numpy() for c in ("pair", "count", "best"))
    with batch_rows(aligned.sparkSession, BATCH):
        found = materialize(_looked_up(aligned, arrays))
    if n_pairs <= common_pairs:
        return found.select(*RESULT)
    rest = found.select("number", F.explode("rest").alias("r")).select("number", "r.pair", "r.times").join(counts, "pair")
    more = rest.groupBy("number").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("count") * F.col("times")).alias("more_count")
    )
    both = found.join(more, "number", "left")
    added = {n: (F.col(n) + F.coalesce(m, F.lit(0))).alias(n) for n, m in (("n_best", "more_best"), ("count_sum", "more_count"))}
    return both.select(*[added.get(c, F.col(c)) for c in RESULT])


def align_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """The numbers of every document of ``docs`` (``doc_id, text``)."""
    aligned = aligned_documents(docs, vocabulary, pieces)
    return link_counts(aligned, pair_counts(aligned), common_pairs)
