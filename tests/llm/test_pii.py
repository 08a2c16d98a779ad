"""Personal data: base spans against the plain patterns, added spans on texts the trees never saw."""

import hashlib
import random
import re

import numpy as np
import pytest

from gritstone.llm import pii
from gritstone.llm.pii_candidates import FEATURES, KINDS, features, luhn, scan, views, written

SF = "/root/testdata/sf0.01"
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_base(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, digits[::-1]))]
            good = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else 0, 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 8 <= len(digits) <= 15][kind]
            if good:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    odd = [
        "", "a@b.c", "a@b", "@b.c x@@y.z a@b.c@d.e", "é@x.y", "a@b.c.", "a.b+c%d@e-f.g-h", "x@y.z@", "a@b..c", "1.2.3.4.5.6.7.8", "1.2.3.256 1.2.3.4", "001.02.3.0004",
        "1.2.3", "4111 1111 1111 1111", "4111-1111 1111-1111x", "41111111 11111111 1", "5  4111111111111111", "+1 (555) 123-4567.", "+1", "++49 30 1234567 +", "+49.", "漢+49 30 123 4567字",
        "1" * 3000, "1." * 500, "a" * 3000 + "@", "+1 " * 400, "- 1 -2--3 " * 50, "0" * 500 + ".1.2.3",
    ]
    parts = ["a@b.c", "@", "+", "4111111111111111", "1", "255", ".", " ", "-", "(", ")", "é", "x", "+49 301", "00", "@x.y", "10.0.0.1"]
    for text in odd + ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(6000)]:
        base, others = scan(text)
        assert base == plain_base(text), repr(text[:80])
        assert others == sorted(set(others)) and all(e <= s or f <= b for _, b, e in base for _, s, f in others)


def test_views_and_features():
    samples = [(0, "ann@mail.example.org"), (1, "10.20.30.40"), (2, "4111111111111111"), (3, "+1 (555) 123-4567")]
    for kind, span in samples:
        made = list(views(kind, "some words ", span, " more"))
        assert {label for *_, label in made} == {0, 1} and all(k == kind for k, *_, label in made if label)
        assert all(len(features(k, b, s, a)) == FEATURES for k, b, s, a, _ in made)
        for _, b, s, a, label in made:
            if label:
                base, others = scan(b + s + a)
                spans = base + others
                assert any(st <= len(b) and en >= len(b) + len(s) and k == kind for k, st, en in spans), (b, s)
    assert len(features(3, "", "", "")) == FEATURES and luhn("4111111111111111")


def test_threshold():
    scores, labels = np.array([0.9, 0.8, 0.8, 0.3]), np.array([1, 1, 0, 1])
    assert pii.threshold(scores, labels, 0.99) == 0.9 and pii.threshold(scores, labels, 0.7) == 0.3
    assert pii.threshold(scores[1:], labels[1:], 0.99) == 2.0 and pii.threshold(np.empty(0), np.empty(0), 0.5) == 2.0


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_query_keeps_every_base_span(spark):
    import __spark_entry__ as entry

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op12_boosted_pii"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    added = 0
    for r in rows:
        base = plain_base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(written(base).split(",") if base else []) <= set(spans) and len(spans) == len(base) + r.n_added
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
        added += r.n_added
    # The corpus itself holds no respelled data: clean text stays.
    assert added <= 5


def test_added_spans_on_unseen_texts(spark, model, prose):
    words = lambda i: " ".join(prose(700 + i, 12))
    hidden = [
        ("email", "walter.gray [at] posteo [dot] net"), ("email", "h.okafor(at)uni-bonn(dot)de"), ("email", "jane_doe at webmail dot org"),
        ("ip", "172[.]16[.]254[.]3"), ("ip", "8(.)8(.)4(.)4"), ("phone", "(415) 867-5309"), ("phone", "212-664-7665"), ("phone", "646.555.0143"),
        ("card", "3782 822463 10005"), ("card", "3714-496353-98431"),
    ]
    clean = [
        "in 2024-05-17 we met", "version 10.2.3 of 2019", "order 12345678 of 99 items", "look at example.com today", "released 17.05.2024 and 18.05.2024",
        "page 1234567 of the file", "4111111111111112 is not valid", "ids 300.400.500.600 here", "sit at home dot", "rates 1000000 2000000 3000000",
    ]
    rows = [(i, f"{words(i)} {s} {words(i + 50)}") for i, (_, s) in enumerate(hidden)] + [(100 + i, f"{words(i)} {s} {words(i + 50)}") for i, s in enumerate(clean)]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), model, with_text=True).collect()}
    caught = sum(kind in found[i].spans and s not in found[i].redacted for i, (kind, s) in enumerate(hidden))
    wrong = [clean[i] for i in range(len(clean)) if found[100 + i].spans]
    assert caught >= 9, [s for i, (k, s) in enumerate(hidden) if k not in found[i].spans]
    assert len(wrong) <= 1, wrong


def test_edges(spark, edge_docs, no_docs, model):
    rows = pii.find_personal_data(edge_docs, model, with_text=True).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in edge_docs.collect())
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.find_personal_data(no_docs, model).count() == 0
    assert pii.fit(no_docs) is None and pii.fit(edge_docs) is None
    some = spark.createDataFrame([(1, "mail a@b.org or b@c.org, a@b.org"), (1, None), (None, "漢字 a@b.org"), (2, "+1 555 123 4567 " * 3000)], "doc_id long, text string")
    got = {(r.doc_id, r.n_email, r.n_phone, r.n_added) for r in pii.find_personal_data(some, None).collect()}
    assert got == {(1, 3, 0, 0), (1, 0, 0, 0), (None, 1, 0, 0), (2, 0, 3000, 0)}
    with_model = pii.find_personal_data(some, model, with_text=True).collect()
    assert {r.redacted for r in with_model if r.doc_id == 1} == {"mail [EMAIL] or [EMAIL], [EMAIL]", ""}


def test_every_span_is_learned_from(spark):
    rows = [(i, f"word{i} a{i}@b{i}.org and 10.0.{i % 256}.{i // 256}") for i in range(1300)] + [(2000, "word7 a7@b7.org and 10.0.7.0"), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.kind, r.base): r["count"] for r in pii._spans(docs).groupBy("kind", "base").count().collect()}
    assert found[0, True] == found[1, True] == 1300


def test_thresholds_of_a_table(spark):
    r = np.random.default_rng(8)
    kind, score = r.integers(0, 3, 3000), r.integers(0, 400, 3000) / 400
    label = (r.random(3000) < score + 0.2 * kind).astype(int)
    scored = spark.createDataFrame([(int(k), float(s), int(x)) for k, s, x in zip(kind, score, label)], "kind int, score double, label int").repartition(5)
    for precision in (0.5, 0.8, 0.995, 1.1):
        assert pii.thresholds(scored, precision) == [pii.threshold(score[kind == k], label[kind == k], precision) for k in range(4)]
