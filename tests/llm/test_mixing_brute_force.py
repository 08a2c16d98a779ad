"""The registered mixing query against a plain replica: ratios by word, calibration and steps in numpy."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import gritstone.llm.mixing as mixing
from gritstone.llm.queries import MIX

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def calibrated(x, label, k, priors):
    """Intercepts and slopes by the damped Newton steps that the operator takes."""
    at, step, before, state = np.concatenate([priors[1:] - priors[0], np.zeros(k)]), None, math.inf, None
    for _ in range(mixing.NEWTON_STEPS):
        p = softmax(np.column_stack([np.zeros(len(x)), at[:k] + at[k:] * x]))
        hit = np.eye(k + 1)[label]
        loss = -(hit * np.log(np.maximum(p, 1e-300))).sum() + mixing.RIDGE * at[k:] @ at[k:] / 2
        if loss > before:
            step = step / 4
            at = state + step
            continue
        ones = np.column_stack([np.ones((len(x), k)), x])
        wide = np.tile(p[:, 1:], 2)
        gradient = ((wide - np.tile(hit[:, 1:], 2)) * ones).sum(axis=0) + mixing.RIDGE * np.append(np.zeros(k), at[k:])
        same = np.tile(np.eye(k), (2, 2))
        hessian = np.einsum("ru,ruv,ru,rv->uv", wide, same[None] - wide[:, None, :], ones, ones)
        hessian += np.diag([1e-6] * k + [mixing.RIDGE] * k)
        settled = before - loss <= 1e-4 * abs(loss)
        before, state = loss, at
        if settled:
            break
        step = -np.linalg.solve(hessian, gradient)
        at = at + step
    return state[:k], state[k:]


def replica(docs, labels, targets):
    """Posteriors, rates and tokens by document id; ``docs`` has id, words, group and half."""
    domains = list(targets)
    k = len(domains) - 1
    counts = defaultdict(Counter)  # (group, half) -> (word, domain) -> count
    for d, words, group, half in docs:
        for domain in labels.get(d, ()):
            counts[group, 1 - half].update((w, domain) for w in words)
    seen, expected = defaultdict(Counter), defaultdict(float)
    for (group, half), found in counts.items():
        total, share = sum(found.values()), Counter()
        for (_, domain), n in found.items():
            share[domain] += n
        for (w, domain), n in found.items():
            seen[w, half][domain] += n
            for other in domains:
                expected[w, half, other] += n * share[other] / total
    ratio = {}
    for (w, half), by in seen.items():
        logs = []
        for d in domains:
            e = expected[w, half, d] + mixing.PRIOR_COUNT
            value = math.log((by[d] + mixing.PRIOR_COUNT) / e)
            logs.append(math.copysign(max(0.0, abs(value) - mixing.SHRINK / math.sqrt(e)), value))
        ratio[w, half] = np.array(logs[1:]) - logs[0]
    none = np.zeros(k)
    scores = np.array([sum((ratio.get((w, half), none) for w in words), none) / math.sqrt(max(1, len(words))) for _, words, _, half in docs])
    tokens = np.array([len(words) for _, words, _, _ in docs], float)
    priors = np.ones(k + 1)
    for of_one in labels.values():
        for domain in of_one:
            priors[domains.index(domain)] += 1
    priors = np.log(priors / priors.sum())
    marked = [(i, domains.index(x)) for i, (d, words, _, _) in enumerate(docs) if words for x in labels.get(d, ())]
    intercepts, slopes = calibrated(scores[[i for i, _ in marked]], [x for _, x in marked], k, priors)
    logits = np.where(tokens[:, None] > 0, intercepts + slopes * scores, priors[1:] - priors[0])
    p = softmax(np.column_stack([np.zeros(len(docs)), logits]))
    wanted = np.array(list(targets.values())) / sum(targets.values()) * tokens.sum()
    inverse = np.linalg.pinv((p * tokens[:, None]).T @ p, rcond=1e-9, hermitian=True)
    rate, before = np.ones(len(docs)), math.inf
    for step in range(mixing.STEPS):
        misfit = (p * (tokens * rate)[:, None]).sum(axis=0) - wanted
        loss = misfit @ inverse @ misfit
        if loss <= mixing.TOLERANCE**2 * (wanted @ inverse @ wanted) or (step and before - loss <= mixing.LEAST_GAIN * before):
            break
        before = loss
        rate = np.maximum(0, rate - p @ (inverse @ misfit))
    return p, rate, tokens


def test_query_equals_the_replica(spark):
    import __spark_entry__ as entry

    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = table.select("doc_id", "text", "lang", mixing._half(F.col("doc_id")).alias("half")).collect()
    docs = [(r.doc_id, WORD.findall(r.text or ""), r.lang or "", r.half) for r in rows]
    labels = defaultdict(list)
    for r in mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet")).where("domain is not null").distinct().collect():
        labels[r.doc_id].append(r.domain)
    p, rate, tokens = replica(docs, {d: labels[d] for d in labels if d in {x[0] for x in docs}}, MIX)
    found = {r.doc_id: r for r in entry.queries()["op9_soft_mixing"](spark, SF).collect()}
    assert sorted(found) == sorted(d for d, *_ in docs) and len({x[3] for x in docs}) == 2
    assert np.ptp(p[:, 0]) > 0.5
    for i, (d, *_) in enumerate(docs):
        r = found[d]
        assert r.tokens == tokens[i]
        assert [r[f"p_{x}"] for x in MIX] == pytest.approx(p[i].tolist(), abs=1e-6)
        assert r.rate == pytest.approx(rate[i], abs=1e-5)
