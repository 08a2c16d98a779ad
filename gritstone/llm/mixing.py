"""Mixing documents to target weights by soft domain membership.

A classifier over words is counted from a labelled table and gives every document a
posterior over domains. A word speaks for a domain by the log ratio of its count there
to the count expected from the labelled texts of the same group (a language, say), so a
domain's mix of groups tells nothing. Ratios are shrunk towards none by a prior count
and by one standard error: rare words are silent. Their sum over a text is divided by
the root of its length, and the slope and intercept of every domain are fitted on the
labelled documents. Documents fall in two halves by a hash of their id, and each half is
scored by counts of the other, so no document is judged by its own words.

Words are counted by a 64-bit hash; the table of those that tell something grows with
the labelled words and has no cap. The words of all documents are joined with it, and
sums go back to the documents by a number of their own: what is shuffled is one short
row for each document, and the posteriors are written once.

Nonnegative rates are then fitted so that the expected tokens of each domain, the
sum over documents of rate times tokens times posterior, meet the targets. The fit
is projected gradient descent on the squared misfit. Steps are taken in the metric
of the documents' tokens and misfits are measured by the inverse of the domains'
second moments, which makes a unit step safe and few steps enough.

A step needs one vector with an entry per domain, so the driver holds nothing
that grows with the data: a document's rate is its starting rate followed by the
steps so far, which are constants of one expression. Only DataFrame expressions
are used.

Null or empty text has no words and gets the prior as posterior. Without labelled
rows, domains are equally likely. A document without tokens gets a rate but adds
nothing. Labels of one document that disagree all count. An empty table gives an
empty result. Repeated rows are documents of their own. Extra columns are kept,
whatever their names, inside the struct ``row``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm import text as T
from gritstone.runtime import discard, materialize, written

#: Prior count of every word, and the standard errors by which a log ratio is shrunk.
PRIOR_COUNT = 3.0
SHRINK = 1.0
NEWTON_STEPS = 12
#: Penalty on the squared slopes of the calibration, so that separable domains get finite ones.
RIDGE = 0.1
#: Labelled documents up to which their ids are broadcast; more meet the texts by a shuffle.
BROADCAST_IDS = 250_000
#: Telling words up to which their table is broadcast (some 40 bytes each); a larger one is joined by a shuffle.
BROADCAST_WORDS = 2_000_000
STEPS = 30
#: Misfit that is as good as none, and the least gain of a step, both as shares.
TOLERANCE = 1e-6
LEAST_GAIN = 1e-3


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` from a table of ``doc_id, quality, toxic``: toxic, else clean or low by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def _half(doc_id: Column) -> Column:
    """Half that a document belongs to; rows of one id are in the same."""
    return F.pmod(F.xxhash64(F.lit("half"), doc_id), F.lit(2)).cast("int")


def _key(word: Column, half: Column) -> Column:
    """What a word counts under for one half; null for no word."""
    return F.when(word.isNotNull(), F.xxhash64(word, half))


def numbered(docs: DataFrame, group: Column | None = None) -> DataFrame:
    """Rows with a ``number`` of their own, written so that it stays: ``number, group`` and the columns as ``c0, c1, ...``.

    Columns are not packed in a struct, so that later joins carry only those that are used.
    """
    named = F.lit("") if group is None else F.coalesce(group.cast("string"), F.lit(""))
    columns = [F.col(T.quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return materialize(docs.select(F.monotonically_increasing_id().alias("number"), named.alias("group"), *columns))


def _texts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``number, group, doc_id, text`` of numbered rows."""
    place = {c.lower(): f"c{i}" for i, c in enumerate(columns)}
    return rows.select("number", "group", F.col(place["doc_id"]).alias("doc_id"), F.col(place["text"]).alias("text"))


class DomainClassifier:
    """Shrunk log ratios of words, crosswise over two halves of the labelled documents."""

    def __init__(self, domains: list[str], priors: np.ndarray, telling: DataFrame):
        self.domains = domains
        self.priors = priors  # logarithms
        self.telling = telling  # key, r1, r2, ...: ratios of the other domains less that of the first
        self.words = telling.count()
        self.intercepts = priors - priors[0]
        self.slopes = np.zeros(len(domains))

    @classmethod
    def fit(cls, texts: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DomainClassifier, DataFrame]:
        """The classifier and the scores of all ``texts`` (``number, group, doc_id, text``); ``labelled`` has ``doc_id, domain``."""
        known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        n = known.count()
        chosen = known.select("doc_id", "domain").distinct()
        marked = texts.join(F.broadcast(chosen) if n <= BROADCAST_IDS else chosen.hint("shuffle_hash"), "doc_id")
        sums = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)]
        # Words count under the keys that the other half is scored by.
        split = marked.select("group", "domain", (1 - _half(F.col("doc_id"))).alias("half"), F.explode(T.words(F.col("text"))).alias("word"))
        by_group, path = written(split.groupBy("group", "half", _key(F.col("word"), F.col("half")).alias("key")).agg(F.count("*").alias("n"), *sums))
        totals = by_group.groupBy("group", "half").agg(
            F.sum("n").alias("t"), *[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(domains))]
        )
        counts = (
            by_group.join(F.broadcast(totals), ["group", "half"])
            .groupBy("key")
            .agg(*[c for i in range(len(domains)) for c in (
                F.sum(f"n{i}").alias(f"n{i}"), F.sum(F.col("n") * F.col(f"t{i}") / F.col("t")).alias(f"e{i}"))])
        )
        shrunk = []
        for i in range(len(domains)):
            ratio = F.log((F.col(f"n{i}") + PRIOR_COUNT) / (F.col(f"e{i}") + PRIOR_COUNT))
            size = F.greatest(F.lit(0.0), F.abs(ratio) - SHRINK / F.sqrt(F.col(f"e{i}") + PRIOR_COUNT))
            shrunk.append((F.signum(ratio) * size).alias(f"w{i}"))
        ratios = [(F.col(f"w{i}") - F.col("w0")).alias(f"r{i}") for i in range(1, len(domains))]
        some = F.greatest(*[F.abs(f"r{i}") for i in range(1, len(domains))], F.lit(0.0), F.lit(0.0)) > 0
        telling = materialize(counts.select("key", *shrunk).select("key", *ratios).where(some))
        discard(texts.sparkSession, path)
        priors = np.ones(len(domains))
        for row in chosen.groupBy("domain").count().collect():
            priors[domains.index(row[0])] += row[1]
        found = cls(domains, np.log(priors / priors.sum()), telling)
        scores = materialize(found.scored(texts))
        found.calibrate(scores.join(marked.select("number", "domain"), "number"))
        return found, scores

    def scored(self, rows: DataFrame) -> DataFrame:
        """``number``, the number of words as ``tokens`` and scores ``s1, ...`` of ``rows`` (``number, doc_id, text``)."""
        words = rows.select("number", _half(F.col("doc_id")).alias("half"), F.explode_outer(T.words(F.col("text"))).alias("word"))
        table = F.broadcast(self.telling) if self.words <= BROADCAST_WORDS else self.telling
        joined = words.select("number", _key(F.col("word"), F.col("half")).alias("key")).join(table, "key", "left")
        others = range(1, len(self.domains))
        sums = joined.groupBy("number").agg(F.count("key").cast("double").alias("tokens"), *[F.coalesce(F.sum(f"r{i}"), F.lit(0.0)).alias(f"t{i}") for i in others])
        root = F.sqrt(F.greatest(F.col("tokens"), F.lit(1.0)))
        return sums.select("number", "tokens", *[(F.col(f"t{i}") / root).alias(f"s{i}") for i in others])

    def logits(self) -> dict[str, Column]:
        """Columns ``l0, ...`` from the scores; without words the prior counts alone."""
        out = {"l0": F.lit(0.0)}
        for i in range(1, len(self.domains)):
            fitted = F.lit(float(self.intercepts[i])) + F.lit(float(self.slopes[i])) * F.col(f"s{i}")
            out[f"l{i}"] = F.when(F.col("tokens") > 0, fitted).otherwise(F.lit(float(self.priors[i] - self.priors[0])))
        return out

    def calibrate(self, marked: DataFrame) -> None:
        """Fit intercepts and slopes on scores of labelled documents (``tokens, s1, ..., domain``) by damped Newton steps."""
        k = len(self.domains) - 1
        if not k:
            return
        table = materialize(marked.where("tokens > 0"))
        at, step, before, state = np.concatenate([self.intercepts[1:], self.slopes[1:]]), None, math.inf, None
        for _ in range(NEWTON_STEPS):
            self.intercepts[1:], self.slopes[1:] = at[:k], at[k:]
            rated = _softmax(table.select(*table.columns, *[c.alias(n) for n, c in self.logits().items()]), k + 1)
            ones = [F.lit(1.0)] * k + [F.col(f"s{i + 1}") for i in range(k)]
            hit = [F.when(F.col("domain") == d, 1.0).otherwise(0.0) for d in self.domains]
            likely = sum((hit[i] * F.log(F.greatest(F.col(f"p{i}"), F.lit(1e-300))) for i in range(k + 1)), F.lit(0.0))
            slopes = [F.sum((F.col(f"p{u % k + 1}") - hit[u % k + 1]) * ones[u]).alias(f"g{u}") for u in range(2 * k)]
            bends = [
                F.sum(F.col(f"p{u % k + 1}") * (F.lit(float(u % k == v % k)) - F.col(f"p{v % k + 1}")) * ones[u] * ones[v]).alias(f"h{u}_{v}")
                for u in range(2 * k) for v in range(u, 2 * k)
            ]
            row = rated.agg((-F.sum(likely)).alias("loss"), *slopes, *bends).first()
            if row.loss is None:
                break
            loss = row.loss + RIDGE * float(at[k:] @ at[k:]) / 2
            if loss > before:
                step = step / 4
                at = state + step
                continue
            gradient = np.array([row[f"g{u}"] for u in range(2 * k)]) + RIDGE * np.append(np.zeros(k), at[k:])
            hessian = np.diag([1e-6] * k + [RIDGE] * k)
            for u in range(2 * k):
                for v in range(u, 2 * k):
                    hessian[u, v] += row[f"h{u}_{v}"]
                    hessian[v, u] = hessian[u, v]
            settled = before - loss <= 1e-4 * abs(loss)
            before, state = loss, at
            if settled:
                break
            step = -np.linalg.solve(hessian, gradient)
            at = at + step
        if state is not None:
            self.intercepts[1:], self.slopes[1:] = state[:k], state[k:]


def _softmax(df: DataFrame, n: int) -> DataFrame:
    """Columns ``l0..`` of logits become ``p0..``, in small steps so that nothing is computed twice."""
    names = [f"l{i}" for i in range(n)]
    top = F.greatest(*names) if n > 1 else F.col(names[0])
    others = [c for c in df.columns if c not in names]
    raised = df.withColumn("top", top).select(*others, *[F.exp(F.col(c) - F.col("top")).alias(c) for c in names])
    total = raised.withColumn("all", sum((F.col(c) for c in names), F.lit(0.0)))
    return total.select(*others, *[(F.col(c) / F.col("all")).alias(f"p{i}") for i, c in enumerate(names)])


def posteriors(scored: DataFrame, classifier: DomainClassifier) -> DataFrame:
    """``number, tokens, p0, p1, ...`` from scores, written once."""
    logits = classifier.logits()
    return materialize(_softmax(scored.select("number", "tokens", *[c.alias(n) for n, c in logits.items()]), len(logits)))


def rate_after(steps: list[np.ndarray], n: int, max_rate: float | None) -> Column:
    """A document's rate after the steps, each projected on the allowed rates."""
    if not steps:
        return F.lit(1.0)

    def step(rate: Column, gradient: Column) -> Column:
        moved = F.greatest(F.lit(0.0), rate - sum((F.col(f"p{i}") * F.get(gradient, i) for i in range(n)), F.lit(0.0)))
        return moved if max_rate is None else F.least(F.lit(float(max_rate)), moved)

    return F.aggregate(T.constant_array([g.tolist() for g in steps], "array<array<double>>"), F.lit(1.0), step)


def fit_steps(table: DataFrame, wanted: np.ndarray, max_rate: float | None = None, limit: int = STEPS) -> list[np.ndarray]:
    """Gradient steps that bring the expected tokens of ``table`` (``tokens, p0, ...``) to ``wanted``."""
    n = len(wanted)
    products = [
        F.sum(F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)
    ]
    found = table.agg(*products).first()
    moments = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            moments[i, j] = moments[j, i] = found[f"m{i}_{j}"] or 0.0
    if not moments.any():
        return []
    inverse = np.linalg.pinv(moments, rcond=1e-9, hermitian=True)
    steps: list[np.ndarray] = []
    before = math.inf
    for _ in range(limit):
        rated = table.withColumn("rate", rate_after(steps, n, max_rate))
        sums = rated.agg(*[F.sum(F.col("tokens") * F.col(f"p{i}") * F.col("rate")) for i in range(n)]).first()
        misfit = np.array([v or 0.0 for v in sums]) - wanted
        loss = float(misfit @ inverse @ misfit)
        if loss <= TOLERANCE**2 * float(wanted @ inverse @ wanted) or (steps and before - loss <= LEAST_GAIN * before):
            break
        before = loss
        steps.append(inverse @ misfit)
    return steps


def soft_mixing(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    budget: float | None = None,
    max_rate: float | None = None,
    group: Column | None = None,
) -> DataFrame:
    """Rows of ``docs`` in ``row`` with ``tokens``, ``posteriors`` by domain, ``rate`` and ``copies``.

    ``targets`` gives the domains' shares of ``budget`` tokens (default: the corpus' own). ``copies`` is the rate
    rounded up or down by a fixed hash of ``doc_id``, so that totals are met on average and reruns agree. ``group`` is
    the group that words are compared within.
    """
    domains = list(targets)
    shares = np.array([max(0.0, targets[d]) for d in domains])
    rows = numbered(docs, group)
    classifier, scores = DomainClassifier.fit(_texts(rows, docs.columns), labelled, domains)
    table = posteriors(scores, classifier)
    if budget is None:
        budget = table.agg(F.sum("tokens")).first()[0] or 0.0
    steps = fit_steps(table, shares / max(shares.sum(), 1e-12) * budget, max_rate)
    whole = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    rated = rows.join(table, "number").withColumn("row", whole).withColumn("rate", rate_after(steps, len(domains), max_rate))
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col("row.doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    named = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.col(f"p{i}"))])
    return rated.select(
        "row",
        F.col("tokens").cast("long").alias("tokens"),
        named.alias("posteriors"),
        "rate",
        F.floor(F.col("rate") + chance).cast("long").alias("copies"),
    )
