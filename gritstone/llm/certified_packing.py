"""Bound-certified best-fit packing of documents into token sequences.

Documents are tokenised where they are read; only piece lengths move. Pieces
that fill a sequence need no partner. The others are dealt to partitions by a
hash and packed best-fit-decreasing; a lower bound from dual feasible functions
certifies a partition whose bin count meets it. The pieces of the partitions
with a gap are dealt anew, into fewer and larger partitions, and packed again; a
round counts only if it saves bins.

Null or empty text is a document of the end mark alone. Repeated rows are packed
as documents of their own. Documents longer than a sequence, however long, are
cut into whole sequences but for the first piece. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.fit import best_fit_decreasing, bins_needed
from gritstone.llm.tokens import VOCABULARY, cut, encoder
from gritstone.runtime import materialize, share_package

WIDTH = 1024
#: Pieces in a partition of the first round; every further round has twice as many.
PARTITION_PIECES = 20_000
ROUNDS = 3


def pieces_of(docs: DataFrame, width: int = WIDTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document (``doc_id, text``)."""

    share_package(docs.sparkSession)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode.document(text.as_py())
                for i, (start, n) in enumerate(cut(len(ids), width)):
                    rows.append((doc.as_py(), i, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenise, schema)


def _packed(pieces: DataFrame, width: int, n_parts: int, turn: int) -> DataFrame:
    """Pieces (``uid, length``) packed in ``n_parts`` partitions: ``uid, length, turn, part, bin, offset, gap``."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid")
        sizes = group.length.to_numpy()
        bins, offsets, count = best_fit_decreasing(sizes, width)
        return group.assign(turn=turn, bin=bins, offset=offsets, gap=count - bins_needed(sizes, width))

    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(n_parts)).cast("int").alias("part"))
    schema = "uid long, length long, part int, turn int, bin long, offset long, gap long"
    return dealt.groupBy("part").applyInPandas(pack, schema)


def _bins(packed: DataFrame) -> DataFrame:
    return packed.groupBy("turn", "part").agg(F.max("bin").alias("last"), F.first("gap").alias("gap"))


def certified_packing(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``; sequences hold at most ``width`` tokens."""
    pieces = materialize(pieces_of(docs, width, vocabulary).withColumn("uid", F.monotonically_increasing_id()))
    open_pieces = pieces.where(F.col("length") < width).select("uid", "length")
    n = open_pieces.count()
    done: list[DataFrame] = []
    size = PARTITION_PIECES
    packed = materialize(_packed(open_pieces, width, max(1, round(n / size)), 0))
    for turn in range(1, rounds):
        bins = _bins(packed).agg(
            F.sum(F.when(F.col("gap") > 0, F.col("last") + 1)).alias("bins"), F.sum(F.when(F.col("gap") > 0, 1)).alias("parts")
        ).first()
        if not bins.parts:
            break
        done.append(packed.where("gap = 0"))
        gap = packed.where("gap > 0")
        size *= 2
        again = materialize(_packed(gap, width, max(1, round(gap.count() / size)), turn))
        after = _bins(again).agg(F.sum(F.col("last") + 1)).first()[0]
        if after >= bins.bins:
            packed = gap
            break
        packed = again
    done.append(packed)
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    # Numbers of open sequences: turn, partition, bin. Full pieces use the negative numbers.
    number = F.shiftleft(F.col("turn").cast("long"), 58) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin")
    placed = placed.select("uid", number.alias("sequence_id"), "offset")
    full = pieces.where(F.col("length") >= width).withColumn("sequence_id", -F.col("uid") - 1).withColumn("offset", F.lit(0).cast("long"))
    return pieces.where(F.col("length") < width).join(placed, "uid").unionByName(full).drop("uid")
