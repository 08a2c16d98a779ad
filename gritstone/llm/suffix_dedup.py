"""Removal of byte strings that occur in an earlier document, with a logarithmic index of sparse suffix arrays.

A byte goes if a window of 50 bytes that covers it also starts in a document with
a smaller id. The suffixes indexed are the ones that start at anchors (see
``anchors``): every window holds one, chosen by the window's content alone.
Arrays hold fingerprints of the suffixes' first bytes, in fingerprint order.

1. Tasks that read documents index each batch: its array is scanned against the
   levels before it, and equal-sized levels merge. A suffix whose whole context
   (all windows of its anchor) was seen in a smaller document is settled there.
2. The rest meet by fingerprint. Equal contexts settle each other; suffixes with
   one fingerprint but several contexts may still share single windows.
3. Only for these the bytes around the anchor are fetched from the texts, and a
   second index of all their windows, fed in the order of ids, tells which ones
   a smaller document has.
4. The spans of a document are merged and cut out of its bytes.

Text is read as UTF-8 bytes; null text is empty. Matches never cross documents.
Texts shorter than a window lose nothing. Rows that share an id do not count as
smaller than each other. A null id sorts before all others. Long texts are
whole, in one task each. An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.anchors import anchors
from gritstone.llm.bytehash import Ranges, mix
from gritstone.llm.log_index import LogIndex
from gritstone.runtime import materialize, share_package

WINDOW = 50
KEY = 16
#: Entries of the index that a reading task keeps.
TASK_ENTRIES = 3_000_000
#: Suffixes in a partition of the later steps.
PARTITION_ROWS = 1_000_000
#: Bytes of text that a reading task handles at once.
BATCH_BYTES = 4_000_000
NULL_ID = -(2**63)
U64 = np.uint64

#: What a row says of a suffix: windows ``first`` to ``last`` are to be compared, or bytes ``first`` to ``last`` go.
OPEN, SPAN = 0, 1
#: ``doc`` and ``text_id`` name a row even if ids are repeated; ``text_id`` is then a hash of the text, else 0, which
#: takes no room in the shuffles.
SUFFIXES = "kind int, key long, context long, doc long, text_id long, at int, first int, last int"


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _text_batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    docs, marks, texts, held = [], [], [], 0
    for frame in frames:
        for doc, mark, text in zip(frame.doc, frame.text_id, frame.text, strict=True):
            docs.append(doc)
            marks.append(mark)
            texts.append(_encoded(text))
            held += len(texts[-1])
            if held >= BATCH_BYTES:
                yield docs, marks, texts
                docs, marks, texts, held = [], [], [], 0
    if docs:
        yield docs, marks, texts


def _suffixes_of(data: bytes, window: int, key: int) -> tuple[np.ndarray, ...]:
    """Fingerprint, context fingerprint, position and window range of a text's sampled suffixes."""
    hashes, at, first, last = anchors(data, window, key)
    if not len(at):
        return hashes, hashes, at, first, last
    with np.errstate(over="ignore"):
        # The place of the anchor is part of its context: equal contexts then have equal windows.
        context = mix(Ranges(data).hash(first, last + window) + (at - first).astype(U64))
    return hashes, context, at, first, last


def _suffixes(docs: DataFrame, window: int, key: int) -> DataFrame:
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = LogIndex(TASK_ENTRIES)
        for ids, marks, texts in _text_batches(frames):
            parts = [_suffixes_of(t, window, key) for t in texts]
            lengths = [len(p[0]) for p in parts]
            if not sum(lengths):
                continue
            hashes, context, at, first, last = (np.concatenate([p[i] for p in parts]) for i in range(5))
            doc = np.repeat(np.array(ids, np.int64), lengths)
            with np.errstate(over="ignore"):
                both = mix(hashes * U64(3) + context)
            settled = index.scan(both, doc) < doc
            frame = pd.DataFrame({
                "kind": np.where(settled, SPAN, OPEN).astype(np.int32), "key": hashes.view(np.int64), "context": context.view(np.int64),
                "doc": doc, "text_id": np.repeat(np.array(marks, np.int64), lengths), "at": at.astype(np.int32),
                "first": first.astype(np.int32), "last": np.where(settled, last + window, last).astype(np.int32),
            })
            yield pd.concat([frame[~settled], _merged(frame[settled])])

    return docs.mapInPandas(read, SUFFIXES)


def _merged(spans: pd.DataFrame) -> pd.DataFrame:
    """Spans of bytes joined where they touch. Starts and ends rise together within a text."""
    spans = spans.sort_values(["doc", "text_id", "first", "last"])
    doc, mark, start, end = (spans[c].to_numpy() for c in ("doc", "text_id", "first", "last"))
    apart = np.ones(len(spans), bool)
    apart[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > end[:-1])
    joined = spans[apart].copy()
    joined["last"] = end[np.append(np.flatnonzero(apart)[1:], len(spans)) - 1] if len(spans) else end
    return joined


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Frames that hold all rows of their fingerprints, from a stream sorted by fingerprint."""
    carried: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        begin = int(frame.key.searchsorted(frame.key.iloc[-1]))
        if begin:
            yield pd.concat([*carried, frame.iloc[:begin]]) if carried else frame.iloc[:begin]
            carried = []
        elif carried and carried[-1].key.iloc[0] != frame.key.iloc[0]:
            yield pd.concat(carried)
            carried = []
        carried.append(frame.iloc[begin:])
    if carried:
        yield pd.concat(carried)


def _settle(suffixes: DataFrame, parts: int, window: int) -> DataFrame:
    """Spans of suffixes whose context a smaller document has; where a fingerprint has several contexts, the rest stays open."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _sorted_groups(batches):
            done, frame = frame[frame.kind == SPAN], frame[frame.kind == OPEN].sort_values(["key", "context", "doc"])
            if len(frame):
                key, context, doc = (frame[c].to_numpy() for c in ("key", "context", "doc"))
                new_key = np.append(True, key[1:] != key[:-1])
                new_context = new_key | np.append(True, context[1:] != context[:-1])
                settled = doc > doc[np.maximum.accumulate(np.where(new_context, np.arange(len(doc)), 0))]
                group = np.cumsum(new_key) - 1
                contexts = np.bincount(group, weights=new_context)[group]
                low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
                np.minimum.at(low, group, doc)
                np.maximum.at(high, group, doc)
                spans = frame[settled].assign(kind=SPAN)
                spans["last"] += window
                done = pd.concat([done, spans, frame[~settled & (contexts > 1) & (low < high)[group]]])
            if len(done):
                yield pa.RecordBatch.from_pandas(done.astype({"kind": np.int32, "last": np.int32}), preserve_index=False)

    return suffixes.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(settle, SUFFIXES)


def _surroundings(docs: DataFrame, wanted: DataFrame, window: int, key: int) -> DataFrame:
    """The bytes before and after the anchors of ``wanted`` suffixes that their windows reach."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, mark, text, points in zip(frame.doc, frame.text_id, frame.text, frame.points, strict=True):
                data = _encoded(text)
                for p in points:
                    left, right = data[p["first"] : p["at"]], data[p["at"] + key : p["last"] + window]
                    out.append((p["key"], doc, mark, p["first"], p["last"], left, right))
            yield pd.DataFrame(out, columns=["key", "doc", "text_id", "first", "last", "before", "after"])

    points = wanted.groupBy("doc", "text_id").agg(F.collect_list(F.struct("key", "at", "first", "last")).alias("points"))
    return docs.join(points, ["doc", "text_id"]).mapInPandas(cut, "key long, doc long, text_id long, first int, last int, before binary, after binary")


def _windows(frame: pd.DataFrame, window: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and fingerprint of every window of the rows' anchors."""
    counts = (frame["last"] - frame["first"]).to_numpy().astype(np.int64) + 1
    row = np.repeat(np.arange(len(frame)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)  # from the first window
    before, after = list(frame.before), list(frame.after)
    joined = Ranges(b"".join(x + y for x, y in zip(before, after, strict=True)))
    left, right = np.array([len(x) for x in before], np.int64), np.array([len(x) for x in after], np.int64)
    begin = np.cumsum(left + right) - (left + right)
    middle = begin + left
    start = begin[row] + offset
    taken = left[row] - offset  # bytes of the window before the anchor
    with np.errstate(over="ignore"):
        codes = mix(
            joined.hash(start, middle[row]) * U64(5)
            + joined.hash(middle[row], middle[row] + window - key - taken) * U64(7)
            + frame.key.to_numpy().view(U64)[row]
            + taken.astype(U64) * U64(0x9E3779B97F4A7C15)
        )
    return row, frame["first"].to_numpy()[row] + offset, codes


def _shared_windows(surroundings: DataFrame, parts: int, window: int, key: int) -> DataFrame:
    """Spans of windows that a smaller document has; documents arrive in order of id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LogIndex()
        for batch in batches:
            frame = batch.to_pandas()
            if not len(frame):
                continue
            row, start, codes = _windows(frame, window, key)
            doc = frame.doc.to_numpy()[row]
            gone = index.scan(codes, doc) < doc
            if gone.any():
                spans = pd.DataFrame({"doc": doc[gone], "text_id": frame.text_id.to_numpy()[row[gone]], "first": start[gone]})
                spans = _merged(spans.assign(last=spans["first"] + window)).astype({"first": np.int32, "last": np.int32})
                yield pa.RecordBatch.from_pandas(spans, preserve_index=False)

    rows = surroundings.repartition(parts, "key").sortWithinPartitions("doc")
    return rows.mapInArrow(scan, "doc long, text_id long, first int, last int")


def _cut_out(docs: DataFrame, spans: DataFrame, with_bytes: bool) -> DataFrame:
    """Documents with the merged spans removed; spans are ``doc, text_id, first, last`` in bytes."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, found in zip(frame.doc, frame.text, frame.spans, strict=True):
                data = _encoded(text)
                kept, at, runs = [], 0, []
                for first, last in sorted((s["first"], s["last"]) for s in found) if found is not None else []:
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], last)
                    else:
                        runs.append([first, last])
                for first, last in runs:
                    kept.append(data[at:first])
                    at = last
                rest = b"".join([*kept, data[at:]])
                out.append((None if doc == NULL_ID else doc, len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if with_bytes else None))
            result = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield result.astype({"doc_id": "Int64"})

    gathered = spans.groupBy("doc", "text_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return docs.join(gathered, ["doc", "text_id"], "left").select("doc", "text", "spans").mapInPandas(cut, schema)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, key: int = KEY, with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs`` (``doc_id, text``).

    ``kept`` has the remaining bytes; it is null without ``with_bytes``.
    """
    spark = docs.sparkSession
    share_package(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")
    repeated = not docs.groupBy("doc").count().where("count > 1").isEmpty()
    docs = docs.select("doc", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("text_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size // (window - key + 2) // PARTITION_ROWS + 1)
    met = materialize(_settle(_suffixes(docs, window, key), parts, window))
    surroundings = _surroundings(docs, met.where(F.col("kind") == OPEN), window, key)
    shared = _shared_windows(surroundings, parts, window, key)
    spans = met.where(F.col("kind") == SPAN).select("doc", "text_id", "first", "last").unionByName(shared)
    return _cut_out(docs, spans, with_bytes)
