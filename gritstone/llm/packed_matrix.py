"""Packed id matrices for training: token ids, segment starts and position resets.

Each task tokenises its documents, cuts overlong ones losslessly into whole rows
(the first piece may be shorter) and packs the pieces best-fit-decreasing into
rows of a fixed width; a segment tree over free capacities finds the fullest row
that still takes a piece. Pieces are buffered up to a number of tokens, so a
task's memory does not depend on its input, and nothing is shuffled.

A result row is one row of a matrix: its ids (little-endian, padded), where its
segments begin and end, and which piece of which document each segment is.
Positions start again at 0 at every segment.

Null or empty text is a document of the end mark alone. Repeated rows are
documents of their own. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.fit import best_fit_decreasing
from gritstone.llm.tokens import END, VOCABULARY, cut, encoder
from gritstone.runtime import share_package

WIDTH = 1024
#: Tokens that a task buffers before it packs them.
BUFFER_TOKENS = 2_000_000
SCHEMA = (
    "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>,"
    " doc_ids array<long>, pieces array<int>, starts array<long>"
)
_ARROW = pa.schema([
    ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
    ("starts", pa.list_(pa.int64())),
])


def _rows(pieces: list[tuple], width: int, first_id: int) -> Iterator[dict]:
    """Matrix rows of buffered ``(doc_id, piece, start, ids)``."""
    bins, offsets, count = best_fit_decreasing(np.array([len(p[3]) for p in pieces], np.int64), width)
    order = np.lexsort((offsets, bins))
    ends = np.searchsorted(bins[order], np.arange(count), side="right")
    begin = 0
    for b in range(count):
        members = [pieces[i] for i in order[begin : ends[b]]]
        begin = ends[b]
        ids = np.full(width, END, members[0][3].dtype)
        edges = np.concatenate(([0], np.cumsum([len(m[3]) for m in members])))
        ids[: edges[-1]] = np.concatenate([m[3] for m in members])
        yield {
            "sequence_id": first_id + b, "n_tokens": int(edges[-1]), "ids": ids.tobytes(),
            "cu_seqlens": edges.tolist(), "position_resets": edges[:-1].tolist(), "doc_ids": [m[0] for m in members],
            "pieces": [m[1] for m in members], "starts": [m[2] for m in members],
        }


def packed_matrix(docs: DataFrame, width: int = WIDTH, buffer_tokens: int = BUFFER_TOKENS, id_bytes: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """Matrix rows of ``docs`` (``doc_id, text``); ids take ``id_bytes`` (2 or 4) bytes each."""
    share_package(docs.sparkSession)
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        next_id = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held
            rows = list(_rows(waiting, width, next_id))
            next_id += len(rows)
            waiting.clear()
            held = 0
            for i in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 1000], _ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode.document(text.as_py())
                if ids.max() >= 1 << (8 * id_bytes):
                    raise ValueError(f"token ids need more than {id_bytes} bytes")
                ids = ids.astype(kind)
                for i, (start, n) in enumerate(cut(len(ids), width)):
                    waiting.append((doc.as_py(), i, start, ids[start : start + n]))
                    held += n
                    if held >= buffer_tokens:
                        yield from flush()
        if waiting:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, SCHEMA)


def write_packed_matrix(docs: DataFrame, path: str, **options) -> None:
    """Write the matrix rows below ``path`` as Parquet; ids are fixed-width binary, ready to be mapped as a matrix."""
    packed_matrix(docs, **options).write.parquet(path)


def positions(cu_seqlens: list[int], width: int) -> np.ndarray:
    """Position of every token of a row, from 0 at each segment; padding counts from 0 as well."""
    edges = np.array([*cu_seqlens, width] if cu_seqlens[-1] < width else cu_seqlens)
    return np.arange(width) - np.repeat(edges[:-1], np.diff(edges))
