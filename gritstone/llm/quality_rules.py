"""Quality rules: base counts and a hashed n-gram likelihood ratio between trusted and raw text.

Words and neighbouring word pairs fall into a fixed number of hash buckets. Two
multinomials over the buckets, one of trusted texts and one of the whole corpus,
give every bucket a log ratio; a document's score is the mean over its n-grams,
so length does not decide. A document is kept when no base rule fails and its
score reaches the threshold.

Only DataFrame expressions are used. The corpus is read twice, once to count and
once to score; all trusted texts are counted. What is shuffled and broadcast has one
number per bucket, beside the trusted ids, which are broadcast while they are few;
beyond that the texts are shuffled once to meet them.

Null text has no words. Texts under ``min_words`` words fail a base rule; texts
without n-grams score 0. With no trusted text every score is 0. Repeated rows
are scored alike. Extra columns are kept by :func:`quality_rules` whatever
their names; the result columns are one struct ``quality_rules``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm import text as T

BUCKETS = 1 << 14
#: Trusted documents up to which their ids are broadcast; more meet the texts by a shuffle.
BROADCAST_IDS = 250_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = -0.04
SYMBOLS = "[#*$%&|<>]"


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """Counts of one text; ``words`` is a column that holds its words."""
    whole = F.coalesce(text, F.lit(""))
    filled = F.filter(T.lines(text), lambda line: line.rlike(T.WORD_CHAR))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, f"{T.SPACE}+", "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(filled) - F.size(F.array_distinct(filled))).cast("long"),
    }


def _windows(words: Column) -> Column:
    """Hash and position of every 3-word window, sorted."""
    n = F.size(words)
    every = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
        lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")),
    )
    return F.when(n >= 3, F.sort_array(every)).otherwise(F.slice(every, 1, 0))


def _repeated(windows: Column) -> Column:
    """Words covered by windows that occur at least twice; neighbours in hash order are compared."""
    again = F.zip_with(
        windows,
        F.slice(windows, 2, F.greatest(F.size(windows) - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)),
    )
    return F.size(F.array_distinct(F.flatten(F.filter(again, lambda x: x.isNotNull())))).cast("long")


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of smoothed trusted and corpus frequencies for every bucket.

    ``docs`` has ``doc_id, text``; ``trusted`` has ``doc_id`` of the trusted documents.
    """
    ids = trusted.select("doc_id").distinct().withColumn("trusted", F.lit(1))
    few = trusted.count() <= BROADCAST_IDS
    marked = docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left")
    counts = (
        marked.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), T.words(F.col("text")).alias("words"))
        .select("trusted", F.explode(T.buckets(F.col("words"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("corpus"), F.sum("trusted").alias("target"))
        .collect()  # one row per bucket
    )
    corpus, target = [1.0] * buckets, [1.0] * buckets
    for row in counts:
        corpus[row.bucket] += row.corpus
        target[row.bucket] += row.target
    corpus_all, target_all = math.fsum(corpus), math.fsum(target)
    if target_all == buckets:
        return [0.0] * buckets
    return [math.log(t / target_all) - math.log(c / corpus_all) for t, c in zip(target, corpus, strict=True)]


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Every row of ``docs`` with a struct ``quality_rules`` of counts, score and verdict, beside the row in ``row``."""
    ids_and_text = docs.select("doc_id", "text")
    table = T.constant_array(bucket_weights(ids_and_text, trusted, buckets))
    text = F.col("text")
    split = T.computed(T.packed(docs, text=F.col("text")), ["row", "text"], words=T.words(F.col("text")))
    hashed = T.computed(split, ["row", "text", "words"], grams=T.buckets(F.col("words"), buckets), windows=_windows(F.col("words")))
    measured = T.computed(
        hashed,
        ["row"],
        **base_counts(text, F.col("words")),
        n_repeat_words=_repeated(F.col("windows")),
        n_grams=F.size("grams"),
        total=F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b)),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    score = F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams")).otherwise(0.0)
    judged = measured.withColumn("score", score).withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    return judged.select("row", F.struct(*names).alias("quality_rules"))
