"""Ranked lexical search by hashed max-sketches.

The index holds, for every document, a sketch: each term falls on one of 65,536
coordinates, and a coordinate keeps the greatest frequency of the terms on it. A
term's impact grows with its frequency, so the impact of a coordinate is the
maximum of the impacts folded into it. Sketches are stored sparsely (about two
bytes of coordinate and four of maximum for each different term), beside the
text they were made from.

A search looks the terms of a block of items up in every sketch: the weighted sum
is an upper bound of the score, equal to it unless terms collide. Per item, the
best bounds of every task are rescored exactly; the k-th best exact score is then
a threshold. A second pass over the sketches finds the documents whose bound still
beats it; they are rescored in descending order of bounds, in growing portions,
each raising the threshold, until no bound is left above it. No document is
dropped that could rank, whatever collides, so the answer is exact.

Scores (all but the logarithm in 64-bit integers): weight ``w`` of a term is
``floor(1000 ln((2N+2)/(2df+1)))``; with ``m = 50 + 50 n N div L`` a document's score
is the sum of ``w * (10^9 tf div (1000 tf + 20 m))`` over the item's different terms.

Null or empty text has no term: such a document is never found and such an item
finds nothing. Repeated documents are ranked each for itself; equal scores are
ordered by id, null ids last, then by place in the table. Repeated items are
answered each for itself. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.runtime import batch_rows, materialize, share_package, small_frame

COORDINATES = 1 << 16
#: Items of a block, and different terms of a block unless a single item has more.
BLOCK_ITEMS = 256
BLOCK_TERMS = 100_000
#: Documents of an item that every task proposes for the first threshold, and those rescored first.
TASK_PROPOSALS = 16
FIRST_PORTION = 100
#: Pairs of item and document up to which they are broadcast to the texts (16 bytes each).
BROADCAST_PAIRS = 500_000
#: Products of one multiplication of sketches and items inside a task.
PRODUCTS = 2_000_000
KEPT_PLACES = 500_000
BATCH = 512

_OTHERS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
#: Bytes of terms as they are, A-Z lower-cased, all others as a space; bytes from 0x80 belong to letters of UTF-8.
_FOLD = bytes(0x20 if b in _OTHERS else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))

INDEX_SCHEMA = "number long, doc_id long, n_terms long, coordinates binary, peaks binary, text binary"
PAIR_SCHEMA = "item int, number long, doc_id long, bound double"
SCORE_SCHEMA = "item int, number long, doc_id long, score long"


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text given in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split() if text else []


class Places(dict):
    """Coordinates of terms met before, out of a power of two up to 65,536."""

    def __init__(self, coordinates: int):
        super().__init__()
        self.mask = coordinates - 1

    def __missing__(self, term: bytes) -> int:
        self[term] = place = zlib.crc32(term) & self.mask
        return place


def sketch(counts: dict[bytes, int], places: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in ascending order and the greatest frequency on each."""
    if not counts:
        return np.empty(0, "<u2"), np.empty(0, "<u4")
    at = np.array([places[t] for t in counts], np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    peaks = np.maximum.reduceat(np.fromiter(counts.values(), np.int64, len(counts))[order], first)
    return at[first].astype("<u2"), np.minimum(peaks, 2**32 - 1).astype("<u4")


def build_index(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """Sketches and texts of ``docs`` (``doc_id, text``), written once."""
    spark = docs.sparkSession
    share_package(spark)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(coordinates)
        for batch in batches:
            n, at, peaks = [], [], []
            for text in batch.column(2).to_pylist():
                found = terms(text)
                counts = Counter(found)
                where, most = sketch(counts, places)
                n.append(len(found))
                at.append(where.tobytes())
                peaks.append(most.tobytes())
                if len(places) > KEPT_PLACES:
                    places.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(peaks, pa.binary()), batch.column(2)],
                ["number", "doc_id", "n_terms", "coordinates", "peaks", "text"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    with batch_rows(spark, BATCH):
        return materialize(rows.mapInArrow(fold, INDEX_SCHEMA))


@dataclass
class Block:
    """Items searched together: their terms numbered, each item's terms, weights, and postings by coordinate."""

    vocabulary: dict[bytes, int]
    item_terms: list[np.ndarray]
    weights: np.ndarray
    documents: int
    total: int
    coordinates: int = COORDINATES

    def __post_init__(self) -> None:
        places = Places(self.coordinates)
        spots = np.array([places[t] for t in self.vocabulary], np.int64)
        item = np.repeat(np.arange(len(self.item_terms)), [len(t) for t in self.item_terms])
        term = np.concatenate([np.empty(0, np.int64), *self.item_terms]).astype(np.int64)
        told = self.weights[term] > 0
        item, term = item[told], term[told]
        order = np.argsort(spots[term], kind="stable")
        self.posting_item = item[order]
        self.posting_weight = self.weights[term[order]].astype(np.float64)
        self.degree = np.bincount(spots[term], minlength=self.coordinates)
        self.start = np.concatenate(([0], np.cumsum(self.degree)[:-1]))

    def impact(self, frequency: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n_terms * self.documents) // self.total
        return (1_000_000_000 * frequency) // (1000 * frequency + 20 * m)

    def bounds(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Portions of a batch of sketches: its rows, and a bound for each of them and each item."""
        items = len(self.item_terms)
        n_terms = batch.column(2).to_numpy()
        at = batch.column(3).to_pylist()
        sizes = np.array([len(a) // 2 for a in at], np.int64)
        row = np.repeat(np.arange(len(at)), sizes)
        spot = np.frombuffer(b"".join(at), "<u2").astype(np.int64)
        told = self.degree[spot] > 0
        row, spot = row[told], spot[told]
        peak = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u4").astype(np.int64)[told]
        impact = self.impact(peak, n_terms[row]).astype(np.float64)
        degree = self.degree[spot]
        ends = np.cumsum(np.bincount(row, degree, len(at)))
        begin = 0
        while begin < len(at):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + PRODUCTS, side="right")))
            end = min(end, begin + max(1, PRODUCTS // items))
            lo, hi = np.searchsorted(row, [begin, end])
            d = degree[lo:hi]
            offset = np.repeat(self.start[spot[lo:hi]] - (np.cumsum(d) - d), d) + np.arange(d.sum())
            cell = np.repeat((row[lo:hi] - begin) * items, d) + self.posting_item[offset]
            # Sums of integers below 2^53 are exact in doubles.
            product = np.repeat(impact[lo:hi], d) * self.posting_weight[offset]
            yield np.arange(begin, end), np.bincount(cell, product, (end - begin) * items).reshape(end - begin, items)
            begin = end

    def score(self, counts: dict[bytes, int], n_terms: int, items: list[int]) -> list[int]:
        found = np.zeros(len(self.vocabulary), np.int64)
        for term in counts.keys() & self.vocabulary.keys():
            found[self.vocabulary[term]] = counts[term]
        gain = self.weights * self.impact(found, np.int64(n_terms))
        return [int(gain[self.item_terms[q]].sum()) for q in items]


def _blocks(items: DataFrame, block_items: int, block_terms: int) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    """Item ids and different terms of one block after the other; the driver holds one at a time."""
    ids: list[int | None] = []
    found: list[list[bytes]] = []
    held: set[bytes] = set()
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).orderBy("item_id")
    for item, text in rows.toLocalIterator():
        new = list(dict.fromkeys(terms(bytes(text) if text is not None else None)))
        if ids and (len(ids) >= block_items or len(held | set(new)) > block_terms):
            yield ids, found
            ids, found, held = [], [], set()
        ids.append(item)
        found.append(new)
        held.update(new)
    if ids:
        yield ids, found


def _document_counts(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Documents that hold each term of a block; tasks count, only sums leave them."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        held = np.zeros(len(numbers), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for term in numbers.keys() & set(terms(text)):
                    held[numbers[term]] += 1
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(held[term])], ["term", "held"])

    df = np.zeros(len(vocabulary), np.int64)
    sums = index.select("text").mapInArrow(count, "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
    for term, held in sums.collect():
        df[term] = held
    return df


def _ranked(score: str) -> list[Column]:
    return [F.col(score).desc(), F.col("doc_id").asc_nulls_last(), F.col("number")]


def _best(rows: DataFrame, score: str, n: int) -> DataFrame:
    """The first ``n`` rows of every item."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(*_ranked(score)))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def _proposals(index: DataFrame, shared, n: int) -> DataFrame:
    """The ``n`` best bounds of every item in every task."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = np.zeros(len(block.item_terms))
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool), np.empty(0, np.int64)]

        def pruned(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            item, number, bound, null, doc = [np.concatenate(p) for p in zip(*parts, strict=True)]
            order = np.lexsort((number, doc, null, -bound, item))
            item, number, bound, null, doc = [x[order] for x in (item, number, bound, null, doc)]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            last = place == n - 1
            best[item[last]] = bound[last]
            return [x[place < n] for x in (item, number, bound, null, doc)]

        for batch in batches:
            number = batch.column(0).to_numpy()
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            doc = batch.column(1).fill_null(0).to_numpy()
            for rows, bounds in block.bounds(batch):
                at, item = np.nonzero(bounds > best)
                if len(at):
                    r = rows[at]
                    held = pruned([held, [item, number[r], bounds[at, item], null[r], doc[r]]])
        item, number, bound, null, doc = held
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(number), pa.array(doc, mask=null), pa.array(bound)], ["item", "number", "doc_id", "bound"])

    return index.select("number", "doc_id", "n_terms", "coordinates", "peaks").mapInArrow(propose, PAIR_SCHEMA)


def _contenders(index: DataFrame, shared, limits: dict[int, tuple]) -> DataFrame:
    """Pairs whose bound may still enter an item's list: above its last score, or equal to it with a smaller id."""

    def contend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        score = np.zeros(len(block.item_terms))
        for item, limit in limits.items():
            score[item] = limit[0]
        for batch in batches:
            number, doc = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for rows, bounds in block.bounds(batch):
                at, item = np.nonzero((bounds >= score) & (bounds > 0))
                bound = bounds[at, item]
                take = bound > score[item]
                for i in np.flatnonzero(~take):
                    r = rows[at[i]]
                    _, last, place = limits[int(item[i])]
                    take[i] = (doc[r] is None, doc[r] or 0, number[r]) < (last is None, last or 0, place)
                r = rows[at[take]]
                ids = pa.array([doc[i] for i in r], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(item[take], pa.int32()), pa.array(number[r]), ids, pa.array(bound[take])], ["item", "number", "doc_id", "bound"])

    return index.select("number", "doc_id", "n_terms", "coordinates", "peaks").mapInArrow(contend, PAIR_SCHEMA)


def _rescored(index: DataFrame, shared, pairs: DataFrame, n_pairs: int) -> DataFrame:
    """Exact scores of pairs, from the whole texts."""

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            out: list[tuple] = []
            for number, doc, n, text, items in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                scores = block.score(Counter(terms(text)), n, items)
                out += [(q, number, doc, s) for q, s in zip(items, scores, strict=True) if s > 0]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "number", "doc_id", "score"])

    wanted = pairs.groupBy("number").agg(F.collect_list("item").alias("items"))
    texts = index.select("number", "doc_id", "n_terms", "text")
    joined = texts.join(F.broadcast(wanted) if n_pairs <= BROADCAST_PAIRS else wanted, "number")
    return joined.select("number", "doc_id", "n_terms", "text", "items").mapInArrow(rescore, SCORE_SCHEMA)


def _limits(best: DataFrame, k: int) -> dict[int, tuple]:
    """Last score, id and place of the items that have ``k`` results; one row per item reaches the driver."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(*_ranked("score")))
    last = best.withColumn("place", place).where(F.col("place") == k)
    return {r.item: (r.score, r.doc_id, r.number) for r in last.select("item", "score", "doc_id", "number").collect()}


def _can_enter() -> Column:
    """Whether the bound of a pair beats the last result of its item, given as columns ``l_*``."""
    id_first = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "number") < F.struct(
        F.col("l_doc_id").isNull(), F.coalesce("l_doc_id", F.lit(0)), "l_number"
    )
    return F.col("l_score").isNull() | (F.col("bound") > F.col("l_score")) | ((F.col("bound") == F.col("l_score")) & id_first)


def _limit_frame(spark: SparkSession, limits: dict[int, tuple]) -> DataFrame:
    return small_frame(spark, [(q, *v) for q, v in limits.items()], "item int, l_score long, l_doc_id long, l_number long")


def _search_block(index: DataFrame, shared, k: int, first_portion: int) -> DataFrame:
    spark = index.sparkSession
    with batch_rows(spark, BATCH):
        portion = materialize(_best(_proposals(index, shared, TASK_PROPOSALS), "bound", first_portion))
        best = materialize(_best(_rescored(index, shared, portion, portion.count()), "score", k))
        limits = _limits(best, k)
        left = materialize(_contenders(index, shared, limits).join(portion.select("item", "number"), ["item", "number"], "left_anti"))
        size = first_portion
        while (n_left := left.count()) > 0:
            size *= 4
            portion = materialize(_best(left, "bound", size))
            scored = _rescored(index, shared, portion, min(n_left, portion.count()))
            best = materialize(_best(best.unionByName(scored), "score", k))
            limits = _limits(best, k)
            open_pairs = left.join(portion.select("item", "number"), ["item", "number"], "left_anti")
            open_pairs = open_pairs.join(F.broadcast(_limit_frame(spark, limits)), "item", "left")
            left = materialize(open_pairs.where(_can_enter()).select("item", "number", "doc_id", "bound"))
    return best


def search(
    index: DataFrame,
    items: DataFrame,
    k: int = 50,
    block_items: int = BLOCK_ITEMS,
    block_terms: int = BLOCK_TERMS,
    first_portion: int = FIRST_PORTION,
    coordinates: int = COORDINATES,
) -> DataFrame:
    """The ``k`` best documents of an index for each of ``items`` (``item_id, text``): ``item_id, rank, doc_id, score``.

    ``coordinates`` is that of the index.
    """
    spark = index.sparkSession
    total, documents = index.agg(F.coalesce(F.sum("n_terms"), F.lit(0)), F.count_if(F.col("n_terms") > 0)).first()
    answers = []
    for ids, found in _blocks(items, block_items, block_terms) if total else ():
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for one in found for t in one))}
        if not vocabulary:
            continue
        df = _document_counts(index, vocabulary)
        # A term of no document adds nothing to any score.
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
        numbered = [np.array([vocabulary[t] for t in one], np.int64) for one in found]
        shared = spark.sparkContext.broadcast(Block(vocabulary, numbered, weights, documents, total, coordinates))
        best = _search_block(index, shared, k, first_portion)
        names = small_frame(spark, list(enumerate(ids)), "item int, item_id long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(*_ranked("score")))
        answers.append(best.join(F.broadcast(names), "item").select("item_id", rank.alias("rank"), "doc_id", "score"))
    if not answers:
        return small_frame(spark, [], "item_id long, rank int, doc_id long, score long")
    result = answers[0]
    for more in answers[1:]:
        result = result.unionByName(more)
    return result


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, coordinates: int = COORDINATES, **options: int) -> DataFrame:
    """Build the index of ``docs`` and search it once."""
    return search(build_index(docs, coordinates), items, k, coordinates=coordinates, **options)
