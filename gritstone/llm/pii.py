"""Personal data by candidate gradient boosting.

Generators with a high recall propose overlapping spans of four kinds: e-mail and IP
addresses, card and phone numbers, also spelled otherwise (``name [at] host [dot]
org``, defanged IP addresses, numbers without ``+`` or in unusual groups). Spans of the
exact base patterns are always found. All other candidates are judged by boosted trees
on features of their format and of the text around them; of overlapping ones the more
probable stays.

No table holds labels for personal data, so the trees learn from the base spans of the
corpus: as they are, respelled, and with invented data in their place they are
positive; failing candidates of the corpus and things of like form put in their place
(broken check digits, dates, parts above 255) are negative. All spans of the corpus are used, those of equal content and surroundings
once. A fifth of them is held out, and each kind gets the lowest threshold that
reaches the wanted precision there; a kind that never reaches it adds nothing.

Texts are scanned whole, where they are read, twice: for the spans and for the result.
Only spans, their examples' scores and what fitting trees needs are shuffled.

Offsets are code points. Null text is an empty one, without spans. Repeated documents
are rows of their own with the same spans. Where the corpus holds no base span (or no
document) nothing can be learned, and only base spans are found. Extra columns are not
read; null ids stay null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritstone.llm.boosted_trees import Trees, fit_trees
from gritstone.llm.pii_candidates import CONTEXT, KINDS, Span, digest, features, scan, views, written
from gritstone.runtime import batch_rows, materialize, share_package

#: Spans that one task spells out and fits, about.
SPANS_AT_ONCE = 5_000
PRECISION = 0.995
SCORED_AT_ONCE = 10_000
BATCH = 512


def _around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + CONTEXT]


def _spans(docs: DataFrame) -> DataFrame:
    """All base spans and other candidates of the corpus with their surroundings, equal ones once."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base, others = scan(text)
                for is_base, spans in ((True, base), (False, others)):
                    for kind, start, end in spans:
                        found = _around(text, start, end)
                        key = int.from_bytes(hashlib.blake2b("|".join(found).encode("utf-8", "surrogatepass"), digest_size=7).digest())
                        rows.append((kind, is_base, key, *found))
            columns = list(zip(*dict.fromkeys(rows), strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "base", "key", "before", "span", "after"])

    found = docs.select("text").mapInArrow(collect, "kind int, base boolean, key long, before string, span string, after string")
    return found.dropDuplicates(["kind", "base", "key"])


def _examples(spans: DataFrame) -> DataFrame:
    """Features and labels of the spans in all their spellings; spans of one content share a fold."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, base, key, before, span, after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                made = [(kind, before, span, after, int(base))] + (list(views(kind, before, span, after)) if base else [])
                out += [(k, key % 5, label, features(k, b, s, a)) for k, b, s, a, label in made]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "fold", "label", "features"])

    return spans.mapInArrow(spell, "kind int, fold int, label int, features array<double>")


def threshold(scores: np.ndarray, labels: np.ndarray, precision: float) -> float:
    """The lowest score from which on the held-out precision holds, at a border between different scores; 2 if there is none."""
    order = np.argsort(-scores, kind="stable")
    scores, labels = scores[order], labels[order]
    reached = np.cumsum(labels) >= precision * np.arange(1, len(labels) + 1)
    border = np.concatenate((scores[1:] != scores[:-1], [True])) if len(scores) else np.empty(0, bool)
    fitting = np.flatnonzero(reached & border)
    return float(scores[fitting[-1]]) if len(fitting) else 2.0


def thresholds(scored: DataFrame, precision: float) -> list[float]:
    """:func:`threshold` of every kind of a table ``kind, score, label``; the driver gets one number for each.

    Different scores are range partitioned and written; each part adds up its own and the totals of the parts before it.
    """
    counted = scored.groupBy("kind", "score").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    fixed = materialize(counted.repartitionByRange("kind", F.desc("score")).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row for each kind and part.
    totals = fixed.groupBy("kind", "part").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    offsets = totals.select("kind", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "good")])
    inside = Window.partitionBy("kind", "part").orderBy(F.desc("score"))
    running = fixed.select("kind", "part", "score", *[F.sum(c).over(inside).alias(c) for c in ("n", "good")])
    placed = running.join(F.broadcast(offsets), ["kind", "part"])
    reached = placed.where(F.col("good") + F.col("good_before") >= F.lit(precision) * (F.col("n") + F.col("n_before")))
    found = {r.kind: r.score for r in reached.groupBy("kind").agg(F.min("score").alias("score")).collect()}
    return [found.get(k, 2.0) for k in range(len(KINDS))]


def _scored(examples: DataFrame, trees: Trees) -> DataFrame:
    """``kind, score, label`` of the examples."""
    shared = examples.sparkSession.sparkContext.broadcast(trees)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.array(batch.column("features").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            scores = shared.value.probability(matrix) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(scores, pa.float64()), batch.column("label")], ["kind", "score", "label"])

    return examples.select("kind", "label", "features").mapInArrow(judge, "kind int, score double, label int")


def fit(docs: DataFrame, precision: float = PRECISION) -> tuple[Trees, list[float]] | None:
    """Trees and a threshold for each kind; ``None`` if the corpus gives no example of either label."""
    spark = docs.sparkSession
    share_package(spark)
    with batch_rows(spark, BATCH):
        spans = materialize(_spans(docs))
    # Every span becomes some hundred examples. In a fixed order, or two runs would fit different trees.
    parts = max(spark.sparkContext.defaultParallelism, spans.count() // SPANS_AT_ONCE + 1)
    ordered = spans.repartition(parts, "key").sortWithinPartitions("kind", "base", "key")
    with batch_rows(spark, BATCH):
        examples = materialize(_examples(ordered))
    learned = examples.where("fold <> 0")
    if learned.select("label").distinct().count() < 2:
        return None
    trees = fit_trees(learned)
    return trees, thresholds(_scored(examples.where("fold = 0"), trees), precision)


def select_spans(spans: list[Span], scores: np.ndarray, thresholds: list[float]) -> list[Span]:
    """Candidates above their kind's threshold; of overlapping ones the more probable, then the longer, then the first."""
    ranked = sorted((-p, s - e, s, k, e) for (k, s, e), p in zip(spans, scores.tolist(), strict=True) if p >= thresholds[k])
    chosen: dict[int, Span] = {}
    covered: set[int] = set()
    for _, _, start, kind, end in ranked:
        if covered.isdisjoint(range(start, end)):
            covered.update(range(start, end))
            chosen[start] = (kind, start, end)
    return list(chosen.values())


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame, model: tuple[Trees, list[float]] | None, with_text: bool = False) -> DataFrame:
    """Per document of ``docs`` (``doc_id, text``): numbers of base spans, their digest, all spans, how many the model
    added, and on request the redacted text."""
    spark = docs.sparkSession
    share_package(spark)
    shared = spark.sparkContext.broadcast(model)
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"] + ["redacted"] * with_text
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()] + [pa.string()] * with_text
    schema = ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in zip(names, kinds, strict=True))

    def added(text: str, others: list[Span]) -> list[Span]:
        if shared.value is None or not others:
            return []
        trees, thresholds = shared.value
        scores = []
        for i in range(0, len(others), SCORED_AT_ONCE):
            rows = [features(k, *_around(text, s, e)) for k, s, e in others[i : i + SCORED_AT_ONCE]]
            scores.append(trees.probability(np.array(rows, np.float64)))
        return select_spans(others, np.concatenate(scores), thresholds)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                text = text or ""
                base, others = scan(text)
                more = added(text, others)
                every = sorted([*base, *more])
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                out.append((doc, *counts, digest(base), written(every), len(more), redacted(text, every) if with_text else "")[: len(names)])
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    with batch_rows(spark, BATCH):
        return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, schema))
