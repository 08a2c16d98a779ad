"""Frequencies of long texts: counted by digest, reported whole and in exact order."""

import random
from collections import Counter

import pytest

from gritstone.operators import frequency, long_text
from gritstone.operators.profile import profile

PAGES = "/root/testdata/sf0.001/pages.parquet"


def brute_force(values):
    counts = Counter(v for v in values if v is not None)
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:8]
    rare = sorted(v for v, n in counts.items() if n == 1)[:8]
    return len(counts), top, rare


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    same = "the same beginning of sixty-four characters and a little more than that, "
    values = [same + "".join(r.choice("ab") for _ in range(9)) for _ in range(700)]
    values += ["x" * 64, "x" * 64, "x" * 65, "x" * 65 + "é", "short", "short", None, ""]
    values += [f"{r.random()} " * 20 for _ in range(50)] + [same] * 3
    r.shuffle(values)
    return values


def check(df, column, values):
    distinct, top, rare = brute_force(values)
    assert {r.column: r.distinct_count for r in frequency.distinct_counts(df).collect()}[column] == distinct
    assert [(r.value, r.n) for r in frequency.top_values(df).where(f"column = '{column}'").orderBy("rank").collect()] == top
    assert [r.value for r in frequency.rare_values(df).where(f"column = '{column}'").orderBy("rank").collect()] == rare
    mode = frequency.modes(df).where(f"column = '{column}'").first()
    assert (mode["mode"], mode.mode_count) == top[0]
    few = frequency.values_up_to(df, [column], distinct)
    assert few[column] == Counter(v for v in values if v is not None) and list(few[column]) == sorted(few[column])


@pytest.mark.parametrize("ties", [2_000, 3])
def test_texts_with_equal_beginnings(spark, texts, monkeypatch, ties):
    """With few ties looked at, texts of the border are taken in ascending portions."""
    monkeypatch.setattr(long_text, "TIES", ties)
    monkeypatch.setattr(long_text, "PORTION", 4)
    df = spark.createDataFrame([(i % 5, v) for i, v in enumerate(texts)], "n int, t string").repartition(4)
    check(df, "t", texts)


def test_whole_pages(spark):
    df = spark.read.parquet(PAGES)
    check(df, "html", [r.html for r in df.collect()])


def test_no_long_text_is_shuffled(spark):
    df = spark.createDataFrame([("y" * 500 + str(i % 3),) for i in range(40)], "t string")
    table = frequency.frequency_table(df)
    assert max(len(r.value) for r in table.collect()) <= long_text.SHOWN + 65
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan.split("Aggregate")[-1]


def test_profile_reports_whole_texts(spark, texts):
    df = spark.createDataFrame([(v,) for v in texts], "t string")
    entry = profile(df).columns[0]
    distinct, top, rare = brute_force(texts)
    assert entry["unique_count" if "unique_count" in entry else "distinct_count"] in (distinct, distinct - 1)
    listed = [v for k, v in entry.items() if k.startswith("top")][0]
    assert {x["value"] for x in listed} <= set(texts)
