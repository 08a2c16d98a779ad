"""Deterministic train/test splits that add no shuffle to the table.

Each row's key is hashed; the rows with the smallest hashes, an exact share of
the table or of every class, are the test set. Only the threshold is searched
for, so the split itself is a predicate. Rows that share a key at the threshold
are told apart by a hash of the whole row. Rows equal in every column cannot be
told apart and stay on one side, the one that keeps the share closer; the
numbers reported are the rows that are really there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gritstone.functions.values import as_text, number_literal, quote, stable_hash, text_literal
from gritstone.operators.frequency import values_up_to
from gritstone.operators.normalize import types_of
from gritstone.operators.order_stats import order_statistics
from gritstone.runtime import small_frame

TEST_SHARE = 0.2
SEED = 42
MAX_STRATA = 20


@dataclass
class Split:
    """A table with an ``is_test`` predicate."""

    df: DataFrame
    condition: str
    target: str | None
    stratified: bool
    rows_total: int
    rows_test: int

    @property
    def marked(self) -> DataFrame:
        return self.df.selectExpr("*", f"{self.condition} as is_test")

    @property
    def train(self) -> DataFrame:
        return self.df.where(f"not {self.condition}")

    @property
    def test(self) -> DataFrame:
        return self.df.where(self.condition)


def _share(n: int, size: float) -> int:
    return math.ceil(round(n * size, 9))


def train_test_split(
    df: DataFrame,
    key: list[str] | str | None = None,
    target: str | None = None,
    size: float = TEST_SHARE,
    seed: int = SEED,
) -> Split:
    """Split by key hash; with a target of 2 to 20 classes, the same share of each class."""
    keys = [key] if isinstance(key, str) else key or df.columns
    place = stable_hash(f"'{seed}'", *[quote(k) for k in keys])
    kinds = types_of(df)
    whole = stable_hash(f"'{seed}/row'", *[as_text(quote(c), kinds[c]) for c in df.columns])
    strata = _strata(df, target) if target else {}
    if len(strata) >= 2 and min(strata.values()) >= 2:
        label = as_text(quote(target), kinds[target])
        members = {v: f"coalesce({label} = {text_literal(v)}, false)" for v in strata}
        tests, chosen = _smallest(df, members, {v: _share(n, size) for v, n in strata.items()}, strata, place, whole)
        return Split(df, f"({' or '.join(tests.values())})", target, True, sum(strata.values()), chosen)
    total = df.count()
    tests, chosen = _smallest(df, {"all": "true"}, {"all": _share(total, size)}, {"all": total}, place, whole)
    return Split(df, tests["all"], target, False, total, chosen)


def _smallest(
    df: DataFrame, members: dict[str, str], wanted: dict[str, int], counts: dict[str, int], place: str, whole: str
) -> tuple[dict[str, str], int]:
    """A predicate for the wanted number of rows of each group with the smallest hashes, and the rows they hold."""
    first = _cut(df, members, wanted, counts, place)
    ties = {g: f"({members[g]} and {place} = {c.at})" for g, c in first.items() if c.before + c.tied > wanted[g]}
    short = {g: wanted[g] - first[g].before for g in ties}
    second = _cut(df, ties, short, {g: first[g].tied for g in ties}, whole) if ties else {}
    tests, chosen = {}, 0
    for g, member in members.items():
        if g not in first:
            tests[g] = "false"
        elif g not in ties:
            tests[g] = f"({member} and {place} <= {first[g].at})"
            chosen += first[g].before + first[g].tied
        else:
            rest = second.get(g)
            above = rest.before + rest.tied if rest else 0
            sign = "<=" if rest and above - short[g] <= short[g] - rest.before else "<"
            tests[g] = f"({member} and ({place} < {first[g].at} or {place} = {first[g].at} and {whole} {sign} {rest.at if rest else 0}))"
            chosen += first[g].before + (above if sign == "<=" else rest.before if rest else 0)
    return tests, chosen


@dataclass
class _Cut:
    """A hash with the rows of a group before it and at it."""

    at: str
    before: int
    tied: int


def _cut(df: DataFrame, members: dict[str, str], wanted: dict[str, int], counts: dict[str, int], place: str) -> dict[str, _Cut]:
    """The hash of each group's last wanted row; groups that want none are left out."""
    asked = {g: m for g, m in members.items() if wanted[g] > 0 and counts[g] > 0}
    if not asked:
        return {}
    masked = {g: f"if({m}, {place}, null)" for g, m in asked.items()}
    found = order_statistics(df, masked, {g: [wanted[g] - 1] for g in asked}, counts)
    at = {g: number_literal(found[g][wanted[g] - 1]) for g in asked}
    fields = [
        f"count_if({m} and {place} {sign} {at[g]}) as {name}{i}"
        for i, (g, m) in enumerate(asked.items())
        for sign, name in (("<", "b"), ("=", "t"))
    ]
    row = df.selectExpr(*fields).first()
    return {g: _Cut(at[g], row[f"b{i}"], row[f"t{i}"]) for i, g in enumerate(asked)}


def _strata(df: DataFrame, target: str) -> dict[str, int]:
    """Rows per class, or nothing when there are more classes than strata allow."""
    return values_up_to(df, [target], MAX_STRATA).get(target, {})


def split_summary(split: Split, task: str, features: int) -> DataFrame:
    """One row describing a split."""
    row = (
        split.target, task, split.rows_total, split.rows_total - split.rows_test, split.rows_test, features,
        split.stratified,
    )
    return small_frame(
        split.df.sparkSession,
        [row],
        "target string, task_type string, rows_total bigint, rows_train bigint, rows_test bigint,"
        " feature_count int, stratified boolean",
    )
