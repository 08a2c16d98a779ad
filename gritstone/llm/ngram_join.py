"""N-gram Jaccard join by prefixes under several global token orders.

A document is the set of its distinct word shingles. Two sets that reach the
similarity share, under any one order of all tokens, a token among the first few
of both, so a pair is a candidate only if that holds under every one of several
orders; candidates are then verified on the whole sets. All orders put frequent
tokens last: a sketch of a fixed number of counters, filled from all documents,
tells which tokens may be frequent; among the others each order follows its own
hash. Whatever the order, no pair is lost; a bad one only costs time.

Documents with equal sets form a class, which is compared once. Components do
not need all pairs of a group of near copies: rounds first compare every class
with a leader of the posting lists that it shares with others, at first of its
first tokens alone, and contract what is linked; then only pairs from different components are left in all the lists, and
all of them are compared.

Near copies share most of their prefixes, so a pair stands in many lists. Lists
with the same least class go to one task, long ones in parts, where their pairs
are counted before they leave: about once for a pair, not once for a token.

A pair leaves its list only if three bounds allow the similarity: the sizes, the
places of the shared token in both prefixes (a pair's first shared token leaves
enough tokens behind it on both sides), and the bits in which two marks differ. A
mark has the parity of the number of tokens of every bit, so two sets differ in as
many tokens at least as their marks in bits.

A set is empty for null text and text without words, and one shingle of all
words when there are fewer than ``width``; empty sets link with nothing. Equal
texts link, repeated rows too. A row without id links like any other; its component
is the smallest id there is in it, null if there is none. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.bytehash import mix, shingles
from gritstone.llm.components import components
from gritstone.runtime import batch_rows, discard, materialize, share_package, written

WIDTH = 5
PERCENT = 80
ORDERS = 2
SKETCH_BITS = 20
SKETCH_BLOCKS = 64
BLOOM_BITS = 25
#: 64-bit words of a set's mark.
MARK_WORDS = 8
#: Steps into which a token's place in its prefix is rounded down.
PLACES = 16
#: Rows of a posting list, in order of size, that a row is compared with before a list is kept.
NEAR = 8
#: Distinct sets that a task remembers so that copies are not sent twice.
REMEMBERED = 200_000
LIST_ROWS = 200_000
#: Rows of a list, about, for which the lists of one least class go to one more place.
HOME_ROWS = 64
#: Pairs of rows that are looked at in one go, and those held in a task until they are counted.
PAIR_ROWS = 1_000_000
HELD_PAIRS = 500_000
#: For each round with leaders, the steps of the prefixes whose lists it reads; in a list every row meets so many leaders.
ROUND_PLACES = (2, PLACES, PLACES)
LEADERS = 2
#: Rows that workers get at once where a row holds a text or a whole set.
BATCH_TEXTS = 1_000
#: Ends of pairs up to which they are broadcast to the sets (32 bytes each), and those compared in one task.
BROADCAST_ENDS = 1_000_000
PART_ENDS = 4_000
#: Pairs of one set, about, that are compared in one place; the set is sent there once.
HUB_PAIRS = 64
U64 = np.uint64


def _digest(tokens: np.ndarray) -> int:
    """Signed 64-bit digest of a set given as sorted hashes."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([(mix(tokens) * (tokens | U64(1))).sum() ^ U64(len(tokens))], U64)).view(np.int64)[0])


def _mark(tokens: np.ndarray) -> np.ndarray:
    """The words of a set's mark."""
    odd = np.bincount((tokens & U64(64 * MARK_WORDS - 1)).astype(np.int64), minlength=64 * MARK_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


MARK = [f"m{k}" for k in range(MARK_WORDS)]


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """One row per document (``doc_id, n, cls`` and its mark) and sketch rows (``part, block, counts``) of each task."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[int] = set()
        for batch in batches:
            rows, marks, fresh = [], [], [np.empty(0, U64)]
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                tokens = shingles(text, width)
                digest = _digest(tokens) if len(tokens) else None
                rows.append((doc, len(tokens), digest))
                marks.append(_mark(tokens))
                if digest is not None and digest not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(digest)
                    fresh.append(tokens)
            spots = (np.concatenate(fresh) >> U64(64 - SKETCH_BITS)).astype(np.int64)
            counts += np.bincount(spots, minlength=len(counts)).astype(np.uint32)
            yield pd.DataFrame({
                "doc_id": pd.array([r[0] for r in rows], "Int64"), "n": [r[1] for r in rows],
                "cls": pd.array([r[2] for r in rows], "Int64"), "part": 0, "block": -1, "counts": None,
                **dict(zip(MARK, np.reshape(marks, (-1, MARK_WORDS)).T, strict=True)),
            })
        if seen:
            part = TaskContext.get().partitionId()
            pieces = np.split(counts, SKETCH_BLOCKS)
            yield pd.DataFrame({
                "doc_id": pd.array([None] * SKETCH_BLOCKS, "Int64"), "n": 0, "cls": pd.array([None] * SKETCH_BLOCKS, "Int64"),
                "part": part, "block": range(SKETCH_BLOCKS), "counts": [p.tobytes() for p in pieces],
                **dict.fromkeys(MARK, 0),
            })

    schema = "doc_id long, n long, cls long, part int, block int, counts binary, " + ", ".join(f"{m} long" for m in MARK)
    return docs.mapInPandas(summarise, schema)


def _sketch(summaries: DataFrame) -> np.ndarray:
    """The tasks' counters added up, first in groups of tasks and then over the groups."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, np.uint64)
        for counts in group.counts:
            total += np.frombuffer(counts, np.uint32)
        capped = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
        return pd.DataFrame({"part": group.part.iloc[:1], "block": group.block.iloc[:1], "counts": [capped.tobytes()]})

    schema = "part int, block int, counts binary"
    rows = summaries.where("block >= 0").select((F.col("part") % 32).alias("part"), "block", "counts")
    rows = rows.groupBy("part", "block").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    whole = np.zeros(1 << SKETCH_BITS, np.uint32)
    step = len(whole) // SKETCH_BLOCKS
    for row in rows.collect():
        whole[row.block * step : (row.block + 1) * step] = np.frombuffer(row.counts, np.uint32)
    return whole


def _ranks(sketch: np.ndarray) -> np.ndarray:
    """Frequency class of each counter: 0 while it is no larger than chance allows, then rising with its logarithm."""
    mean = float(sketch.mean())
    usual = mean + 4 * np.sqrt(mean) + 8
    return np.where(sketch <= usual, 0, np.floor(2 * np.log2(np.maximum(sketch, 1)))).astype(np.uint8)


def prefix(tokens: np.ndarray, ranks: np.ndarray, order: int, percent: int) -> np.ndarray:
    """Tokens of one order's prefix as signed keys; the two lowest bits tell the order."""
    keys = mix(tokens ^ U64(0x9E3779B97F4A7C15 * (order + 1) % 2**64))
    length = int(_prefix_length(len(tokens), percent))
    rank = ranks[(tokens >> U64(64 - SKETCH_BITS)).astype(np.int64)]
    usual = keys[rank == 0]
    first = np.sort(usual)[:length] if len(usual) >= length else keys[np.lexsort((keys, rank))[:length]]
    return ((first & ~U64(3)) | U64(order)).view(np.int64)


def _prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _least_common(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that two sets of these sizes share at least if they link."""
    return -(-percent * (na + nb) // (100 + percent))


def _left(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of sets, and how many tokens there are at most from a token's place on, from what postings hold as ``size``."""
    n, place = size.astype(np.int64) // PLACES, size % PLACES
    return n, n - -(-place * _prefix_length(n, percent) // PLACES)


def _postings(docs: DataFrame, ranks, width: int, percent: int, orders: int) -> DataFrame:
    """``token, size, cls`` for every prefix token of every class; a task sends a class once.

    ``size`` is the number of the set's tokens times ``PLACES``, plus the step of the token's place in the prefix.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = ranks.value, set()
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, int]] = []
            held = 0
            for text in batch.column(0):
                tokens = shingles(text.as_py(), width)
                if not len(tokens):
                    continue
                digest = _digest(tokens)
                if digest in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(digest)
                found = np.concatenate([prefix(tokens, table, r, percent) for r in range(orders)])
                length = len(found) // orders
                places = np.tile(np.arange(length) * PLACES // length, orders)
                out.append((found, len(tokens) * PLACES + places, digest))
                held += len(found)
                if held > 200_000:
                    yield _posting_batch(out)
                    out, held = [], 0
            if out:
                yield _posting_batch(out)

    return docs.select("text").mapInArrow(emit, "token long, size int, cls long")


def _posting_batch(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    lengths = [len(r[0]) for r in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([r[0] for r in rows])),
            pa.array(np.concatenate([r[1] for r in rows]).astype(np.int32)),
            pa.array(np.repeat(np.array([r[2] for r in rows], np.int64), lengths)),
        ],
        ["token", "size", "cls"],
    )


def _sorted_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Whole posting lists from a stream sorted by token; a list that goes on is carried over."""
    carried: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        last = frame.token.iloc[-1]
        begin = int(frame.token.searchsorted(last))
        if begin or (carried and carried[0].token.iloc[0] != last):
            yield pd.concat([*carried, frame.iloc[:begin]]) if carried else frame.iloc[:begin]
            carried = []
        carried.append(frame.iloc[begin:])
    if carried:
        yield pd.concat(carried)


def _homes(token: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The place of every row's list, rows sorted by token: that of its least class, one of several for long lists."""
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    lengths = np.diff(np.append(start, len(token)))
    spread = mix(token[start].view(U64)) % (lengths // HOME_ROWS + 1).astype(U64)
    homes = mix(np.minimum.reduceat(cls, start).view(U64) ^ mix(spread + U64(1)))
    return np.repeat(homes.view(np.int64) >> 32, lengths).astype(np.int32)


def _lists(rows: DataFrame, parts: int, percent: int) -> DataFrame:
    """Rows of posting lists that may have a partner there, equal rows once, and the ``home`` of their list.

    A row stays if the sizes and places of it and of one of its neighbours, in order of size, allow a link, and in any
    list with more rows than these.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _sorted_lists(batches):
            frame = frame.sort_values(["token", "size", "cls"], kind="stable").drop_duplicates(["token", "cls"])
            token = frame.token.to_numpy()
            n, left = _left(frame["size"].to_numpy(), percent)
            good = np.zeros(len(frame), bool)
            for step in range(1, min(NEAR, len(frame) - 1) + 1):
                fits = (token[step:] == token[:-step]) & (np.minimum(left[step:], left[:-step]) >= _least_common(n[step:], n[:-step], percent))
                good[step:] |= fits
                good[:-step] |= fits
            start = np.searchsorted(token, token)
            good |= np.searchsorted(token, token, "right") - start > NEAR + 1
            if good.any():
                frame = frame[good]
                frame = frame.assign(home=_homes(frame.token.to_numpy(), frame.cls.to_numpy()))
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return rows.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(keep, "token long, size int, cls long, home int")


def _pairs(lists: DataFrame, parts: int, percent: int, turn: int | None) -> DataFrame:
    """Candidate pairs of classes from different components: ``a, b, order, votes``.

    With a ``turn`` every member is paired with the ``LEADERS`` members of the list that a hash of the turn puts first;
    without, all members of different components are paired. Pairs whose sizes, places or marks rule a link out
    stay in the list.
    """

    def leaders(tokens: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every row with the first rows of its list, in the order of the turn's hash."""
        order = np.lexsort((mix(cls.view(U64) ^ U64(turn * 2 + 1)), tokens))
        new = np.append(True, tokens[order][1:] != tokens[order][:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        longest = int(np.diff(np.append(np.flatnonzero(new), len(order))).max())
        for k in range(min(LEADERS, longest - 1)):
            after = np.flatnonzero(np.arange(len(order)) > start + k)
            yield order[start[after] + k], order[after]

    def everything(tokens: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every row with the rows of its list that come after its component; rows are sorted by token and component."""
        new_list = np.append(True, tokens[1:] != tokens[:-1])
        new_comp = new_list | np.append(True, comp[1:] != comp[:-1])
        end = np.append(np.flatnonzero(new_list)[1:], len(tokens))[np.cumsum(new_list) - 1]
        begin = np.append(np.flatnonzero(new_comp)[1:], len(tokens))[np.cumsum(new_comp) - 1]
        total = np.cumsum(end - begin)
        at = 0
        while at < len(tokens):
            done = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, done + PAIR_ROWS, "right")))
            counts = (end - begin)[at:stop]
            i = np.repeat(np.arange(at, stop), counts)
            yield i, begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = stop

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for frame in _sorted_lists(batches):
            if turn is None:
                frame = frame.sort_values(["token", "comp"], kind="stable")
            tokens, cls, comp = (frame[c].to_numpy() for c in ("token", "cls", "comp"))
            n, left = _left(frame["size"].to_numpy(), percent)
            marks = frame[MARK].to_numpy().view(U64)
            for i, j in everything(tokens, comp) if turn is None else leaders(tokens, cls):
                least = _least_common(n[i], n[j], percent)
                good = (comp[i] != comp[j]) & (np.minimum(left[i], left[j]) >= least)
                i, j, least = i[good], j[good], least[good]
                apart = np.zeros(len(i), np.int64)
                for k in range(MARK_WORDS):
                    apart += np.bitwise_count(marks[i, k] ^ marks[j, k])
                good = apart <= n[i] + n[j] - 2 * least
                i, j = i[good], j[good]
                out.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), tokens[i] & 3], axis=1))
                held += len(i)
                if held > HELD_PAIRS:
                    yield _pair_batch(out)
                    out, held = [], 0
        if held:
            yield _pair_batch(out)

    rows = lists.repartition(parts, "home").sortWithinPartitions("token")
    return rows.mapInArrow(make, "a long, b long, order int, votes long")


def _pair_batch(out: list[np.ndarray]) -> pa.RecordBatch:
    frame = pd.DataFrame(np.concatenate(out), columns=["a", "b", "order"])
    found = frame.groupby(["a", "b", "order"], sort=False).size().reset_index(name="votes").astype({"order": np.int32})
    return pa.RecordBatch.from_pandas(found, preserve_index=False)


def _under_all_orders(pairs: DataFrame, orders: int) -> DataFrame:
    """Pairs that share a prefix token under every order, with the number of tokens shared."""
    seen = F.bit_or(F.expr("shiftleft(1, `order`)")).alias("orders")
    return pairs.groupBy("a", "b").agg(seen, F.sum("votes").alias("votes")).where(F.col("orders") == (1 << orders) - 1)


def _best_leaders(pairs: DataFrame) -> DataFrame:
    """For each class the partner with the most shared tokens."""
    pairs = pairs.groupBy("a", "b").agg(F.sum("votes").alias("votes"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "votes"))
    best = both.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bits of the ids' hashes, in a table of fixed size."""
    spots = ids.select(F.explode(F.array(*[F.shiftrightunsigned(F.xxhash64(F.lit(i), "doc_id"), 64 - BLOOM_BITS) for i in (0, 1)])).alias("h"))
    words = spots.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    found = words.toArrow()
    table[found["w"].to_numpy()] = found["bits"].to_numpy()
    return table


def _sets(docs: DataFrame, needed: DataFrame, n_needed: int, width: int) -> DataFrame:
    """``hub, bucket, place, cls, tokens`` of every set in ``needed`` (``cls, doc_id, hub, bucket, place``).

    A Bloom filter spares most other texts the work. Few pairs are broadcast to the sets, so that a set is sent only
    where it is compared; several rows of one id and text may send it twice.
    """
    table = docs.sparkSession.sparkContext.broadcast(_bloom(needed))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = table.value, set()
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for name in ("h0", "h1"):
                h = batch.column(name).to_numpy()
                hit &= (bits[h >> 6] >> (h & 63)) & 1 == 1
            at = np.flatnonzero(hit)
            for s in range(0, len(at), 200):
                part = batch.take(pa.array(at[s : s + 200]))
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    tokens = shingles(text, width)
                    cls = _digest(tokens) if len(tokens) else None
                    if cls is None or (doc, cls) in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add((doc, cls))
                    rows.append((doc, cls, tokens.tobytes()))
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                kinds = (pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "cls", "tokens"])

    spots = [F.shiftrightunsigned(F.xxhash64(F.lit(i), "doc_id"), 64 - BLOOM_BITS).alias(f"h{i}") for i in (0, 1)]
    found = docs.select("doc_id", "text", *spots).mapInArrow(compute, "doc_id long, cls long, tokens binary")
    # Several rows may carry one id; the digest tells which of them the class is.
    named = needed.select(F.col("cls").alias("wanted_cls"), F.col("doc_id").alias("wanted_id"), "hub", "bucket", "place")
    same = (F.col("cls") == F.col("wanted_cls")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    return found.join(F.broadcast(named) if n_needed <= BROADCAST_ENDS else named, same).select("hub", "bucket", "place", "cls", "tokens")


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The similar pairs of a stream of ``hub, bucket, place, cls, tokens`` sorted by these: each set that comes after its
    hub's is compared with it; two sets are held at a time."""
    group, first, last = None, None, None
    for batch in batches:
        out = []
        for hub, bucket, cls, tokens in zip(*[batch.column(c).to_pylist() for c in ("hub", "bucket", "cls", "tokens")], strict=True):
            if (hub, bucket) != group:
                group, first, last = (hub, bucket), np.frombuffer(tokens, U64) if cls == hub else None, cls
            elif cls != last and first is not None:
                last, other = cls, np.frombuffer(tokens, U64)
                common = len(np.intersect1d(first, other, assume_unique=True))
                if 100 * common >= percent * (len(first) + len(other) - common):
                    out.append((min(hub, cls), max(hub, cls)))
        columns = list(zip(*out, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _by_hub(pairs: DataFrame) -> DataFrame:
    """``hub, bucket, place, cls``: the sets to compare. The end of a pair that more pairs have is its hub (place 0), which
    meets the other ends (place 1) in buckets of about ``HUB_PAIRS``."""
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("pairs"))
    both = pairs.join(degrees.toDF("a", "of_a"), "a").join(degrees.toDF("b", "of_b"), "b")
    first = F.col("of_a") >= F.col("of_b")
    buckets = F.floor(F.greatest("of_a", "of_b") / HUB_PAIRS) + 1
    ends = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("cls"), buckets.alias("buckets"))
    ends = ends.select("hub", F.pmod(F.xxhash64("cls"), F.col("buckets")).alias("bucket"), F.lit(1).alias("place"), "cls")
    return ends.unionByName(ends.select("hub", "bucket", F.lit(0).alias("place"), F.col("hub").alias("cls")).distinct())


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a, b``) whose whole sets reach the similarity."""
    pairs, pairs_path = written(pairs.select("a", "b"))
    needed, needed_path = written(_by_hub(pairs).join(classes, "cls").select("cls", "doc_id", "hub", "bucket", "place"))
    n = needed.count()
    with batch_rows(docs.sparkSession, BATCH_TEXTS):
        sets = _sets(docs, needed, n, width).repartition(n // PART_ENDS + 1, "hub", "bucket").sortWithinPartitions("hub", "bucket", "place", "cls")
        found = materialize(sets.mapInArrow(lambda batches: _compared(batches, percent), "a long, b long"))
    discard(docs.sparkSession, pairs_path, needed_path)
    return found


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``)."""
    spark = docs.sparkSession
    share_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with batch_rows(spark, BATCH_TEXTS):
        summaries = materialize(_summaries(docs, width))
    rows = summaries.where("block < 0").select("doc_id", "n", "cls")
    classes = materialize(
        summaries.where("block < 0 and cls is not null").groupBy("cls").agg(*[F.min(c).alias(c) for c in ("doc_id", *MARK)])
    )
    ranks = spark.sparkContext.broadcast(_ranks(_sketch(summaries)))
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), total * orders * (100 - percent) // 100 // LIST_ROWS + 1)
    postings = _postings(docs, ranks, width, percent, orders)
    with batch_rows(spark, 5 * BATCH_TEXTS):
        lists, lists_path = written(_lists(postings, parts, percent))  # tokens that several classes share
    labels = spark.createDataFrame([], "node long, component long")
    small = max(1, parts // 4)
    for turn in [*range(len(ROUND_PLACES)), None]:
        named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        named = named.select("cls", F.coalesce("component", "cls").alias("comp"), *MARK)
        places = PLACES if turn is None else ROUND_PLACES[turn]
        pairs = _pairs(lists.where(F.col("size") % PLACES < places).join(named, "cls"), small, percent, turn)
        if places == PLACES:  # near copies may share their first tokens under one order alone
            pairs = _under_all_orders(pairs, orders)
        if turn is not None:
            pairs = _best_leaders(pairs)
        found = _verified(pairs, docs, classes.select("cls", "doc_id"), width, percent)
        if not found.isEmpty():
            labels = components(labels.toDF("a", "b").unionByName(found))
    discard(spark, lists_path)
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = named.join(least, "component").select("cls", "component_id")
    return rows.join(found, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
