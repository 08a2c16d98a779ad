"""Exact order statistics and quantiles without sorting or collecting a column.

Ranks are found by selection: a sketch brackets every wanted rank, one job counts what lies before
each bracket and groups the few values inside, and the answer is read from that
bounded rest. The sketch only proposes brackets; the counts decide, so the
result is exact whatever the sketch's error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from gritstone.functions.values import number_literal as lit
from gritstone.runtime import chunks

# Largest number of values left inside one bracket before they are ranked.
BRACKET_VALUES = 1_000_000
SKETCH_ACCURACY = 2_000
BRACKET_MARGIN = 3.0 / SKETCH_ACCURACY
COLUMNS_PER_PASS = 8
SEARCHES_PER_PASS = 16
MAX_ROUNDS = 64


@dataclass
class Search:
    """A wanted rank of one column; its value lies in [low, high]."""

    column: int
    rank: int
    low: float = 0.0
    high: float = 0.0
    below: int = 0
    inside: int | None = None

    def margins(self, count: int) -> list[float]:
        q = (self.rank - self.below) / max(count - 1, 1)
        return [max(0.0, q - BRACKET_MARGIN), min(1.0, q + BRACKET_MARGIN)]


def _array(values: list[float]) -> str:
    return f"array({', '.join(lit(v) for v in values)})"


def _prepare(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"cast({e} as double) as v{i}" for i, e in enumerate(exprs.values())])


def _points(base: DataFrame, aggregates: dict[int, str]) -> dict[int, list[float]]:
    """Evaluate one array-valued aggregate per key, a few per pass, in one job."""
    parts = []
    for chunk in chunks(list(aggregates), COLUMNS_PER_PASS):
        wide = base.selectExpr(*[f"{aggregates[i]} as p{i}" for i in chunk])
        rows = ", ".join(f"named_struct('i', {i}, 'points', p{i})" for i in chunk)
        parts.append(wide.selectExpr(f"inline(array({rows}))"))
    return {row["i"]: row["points"] for row in reduce(DataFrame.union, parts).collect()}


def _sketch(base: DataFrame, counts: list[int], searches: list[Search]) -> None:
    """Propose a bracket for every search from one mergeable sketch per column."""
    wanted: dict[int, list[Search]] = {}
    for s in searches:
        wanted.setdefault(s.column, []).append(s)
    aggregates = {}
    for i, group in wanted.items():
        ends = _array([p for s in group for p in s.margins(counts[i])])
        aggregates[i] = f"percentile_approx(v{i}, {ends}, {SKETCH_ACCURACY})"
    points = _points(base, aggregates)
    for i, group in wanted.items():
        for k, s in enumerate(group):
            s.low, s.high = points[i][2 * k], points[i][2 * k + 1]


def _measured(base: DataFrame, searches: list[Search], build) -> dict[int, list]:
    """Four aggregates per search, a few searches per pass, in one job."""
    parts = []
    for chunk in chunks(list(range(len(searches))), SEARCHES_PER_PASS):
        wide, rows = [], []
        for k in chunk:
            wide += [f"{m} as m{k}_{j}" for j, m in enumerate(build(searches[k]))]
            rows.append(f"named_struct('k', {k}, 'm', array(" + ", ".join(f"cast(m{k}_{j} as double)" for j in range(4)) + "))")
        parts.append(base.selectExpr(*wide).selectExpr(f"inline(array({', '.join(rows)}))"))
    return {row["k"]: row["m"] for row in reduce(DataFrame.union, parts).collect()}


def _count(base: DataFrame, searches: list[Search]) -> None:
    """Count values before and inside each bracket; move a bracket that missed its rank."""

    def build(s: Search) -> list[str]:
        v = f"v{s.column}"
        return [f"count_if({v} < {lit(s.low)})", f"count_if({v} <= {lit(s.high)})", f"min({v})", f"max({v})"]

    found = _measured(base, searches, build)
    for k, s in enumerate(searches):
        before, upto = int(found[k][0]), int(found[k][1])
        if s.rank < before:
            s.low, s.high, s.below, s.inside = found[k][2], s.low, 0, None
        elif s.rank >= upto:
            s.low, s.high, s.below, s.inside = s.high, found[k][3], before, None
        else:
            s.below, s.inside = before, upto - before


def _drop_ends(base: DataFrame, searches: list[Search]) -> None:
    """Settle searches whose value is a bound of the bracket; take both bounds out of the others.

    Two values that fill a bracket keep a sketch from narrowing it. Counting them
    themselves always makes it smaller.
    """

    def build(s: Search) -> list[str]:
        v, low, high = f"v{s.column}", lit(s.low), lit(s.high)
        inner = f"if({v} > {low} and {v} < {high}, {v}, null)"
        return [f"count_if({v} = {low})", f"count_if({v} = {high})", f"min({inner})", f"max({inner})"]

    found = _measured(base, searches, build)
    for k, s in enumerate(searches):
        at_low, at_high = int(found[k][0]), int(found[k][1])
        if s.rank < s.below + at_low:
            s.high, s.inside = s.low, at_low
        elif s.rank >= s.below + s.inside - at_high:
            s.below, s.low, s.inside = s.below + s.inside - at_high, s.high, at_high
        else:
            s.below, s.inside = s.below + at_low, s.inside - at_low - at_high
            s.low, s.high = found[k][2], found[k][3]


def _narrow(base: DataFrame, searches: list[Search]) -> None:
    """Shrink crowded brackets: sketch only the values inside them, then recount."""
    _count(base, searches)
    for _ in range(MAX_ROUNDS):
        unsure = [s for s in searches if s.inside is None]
        crowded = [
            s
            for s in searches
            if s.inside is not None and s.low != s.high and s.inside > BRACKET_VALUES
        ]
        if not crowded and not unsure:
            return
        if crowded:
            aggregates = {}
            for k, s in enumerate(crowded):
                inside = f"if(v{s.column} between {lit(s.low)} and {lit(s.high)}, v{s.column}, null)"
                ends = _array(s.margins(s.inside))
                aggregates[k] = f"percentile_approx({inside}, {ends}, {SKETCH_ACCURACY})"
            points = _points(base, aggregates)
            stuck = [s for k, s in enumerate(crowded) if [s.low, s.high] == points[k]]
            for k, s in enumerate(crowded):
                s.low, s.high = points[k]
            if stuck:
                _drop_ends(base, stuck)
            crowded = [s for s in crowded if s not in stuck]
        if crowded or unsure:
            _count(base, crowded + unsure)
    raise RuntimeError("order statistic selection did not converge")


def _gap_counts(base: DataFrame, segments: dict[int, list[list[float]]]) -> DataFrame:
    """(c, zone, v, n) with v null: how many values precede each bracket."""
    parts = []
    for chunk in chunks(list(segments), COLUMNS_PER_PASS):
        measures, rows = [], []
        for i in chunk:
            for k, (low, _) in enumerate(segments[i]):
                after = f" and v{i} > {lit(segments[i][k - 1][1])}" if k else ""
                measures.append(f"count_if(v{i} < {lit(low)}{after}) as g{i}_{k}")
                rows.append(
                    f"named_struct('c', {i}, 'zone', {2 * k}, 'v', cast(null as double), 'n', g{i}_{k})"
                )
        parts.append(base.selectExpr(*measures).selectExpr(f"inline(array({', '.join(rows)}))"))
    return reduce(DataFrame.union, parts)


def _bracket_values(base: DataFrame, segments: dict[int, list[list[float]]]) -> DataFrame:
    """(c, zone, v, n): the distinct values inside the brackets."""
    parts = []
    for chunk in chunks(list(segments), COLUMNS_PER_PASS):
        masked = []
        for i in chunk:
            hits = [f"v{i} between {lit(low)} and {lit(high)}" for low, high in segments[i]]
            masked.append(f"if({' or '.join(hits)}, v{i}, null) as `{i}`")
        wide = base.selectExpr(*masked)
        cells = wide.unpivot([], wide.columns, "key", "v").where("v is not null")
        zones = " ".join(
            f"when key = '{i}' and v <= {lit(high)} then {2 * k + 1}"
            for i in chunk
            for k, (_, high) in enumerate(segments[i])
        )
        counted = cells.groupBy("key", "v").count()
        parts.append(
            counted.selectExpr("cast(key as int) as c", f"case {zones} end as zone", "v", "count as n")
        )
    return reduce(DataFrame.union, parts)


def _select(base: DataFrame, searches: list[Search]) -> dict[tuple[int, int], float]:
    """Rank the values inside the brackets; everything outside only adds to a counter."""
    segments: dict[int, list[list[float]]] = {}
    for s in sorted(searches, key=lambda s: (s.low, s.high)):
        merged = segments.setdefault(s.column, [])
        if merged and s.low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.high)
        else:
            merged.append([s.low, s.high])
    grouped = _gap_counts(base, segments).union(_bracket_values(base, segments))
    ranked = grouped.selectExpr("*", "sum(n) over (partition by c order by zone, v) as upto")
    wanted = " or ".join(
        f"(c = {s.column} and upto > {s.rank} and upto - n <= {s.rank})" for s in searches
    )
    found: dict[tuple[int, int], float] = {}
    for row in ranked.where(f"v is not null and ({wanted})").collect():
        for s in searches:
            if s.column == row["c"] and row["upto"] - row["n"] <= s.rank < row["upto"]:
                found[(s.column, s.rank)] = row["v"]
    return found


def order_statistics(
    df: DataFrame, exprs: dict[str, str], ranks: dict[str, list[int]], counts: dict[str, int]
) -> dict[str, dict[int, float]]:
    """Values at 0-based ranks of each numeric expression's non-null values."""
    base = _prepare(df, exprs)
    totals = [counts[name] for name in exprs]
    searches = [
        Search(i, r)
        for i, name in enumerate(exprs)
        for r in sorted(set(ranks.get(name, [])))
        if 0 <= r < counts[name]
    ]
    if not searches:
        return {name: {} for name in exprs}
    _sketch(base, totals, searches)
    if any(2 * BRACKET_MARGIN * totals[s.column] > BRACKET_VALUES / 4 for s in searches):
        _narrow(base, searches)
    found = _select(base, searches)
    missed = [s for s in searches if (s.column, s.rank) not in found]
    if missed:
        _narrow(base, missed)
        found.update(_select(base, missed))
    return {
        name: {s.rank: found[(i, s.rank)] for s in searches if s.column == i}
        for i, name in enumerate(exprs)
    }


def filled_counts(df: DataFrame, exprs: dict[str, str]) -> dict[str, int]:
    """Non-null count of each expression."""
    row = df.selectExpr(*[f"count({e}) as n{i}" for i, e in enumerate(exprs.values())]).first()
    return {name: row[f"n{i}"] for i, name in enumerate(exprs)}


def quantiles(
    df: DataFrame,
    exprs: dict[str, str],
    probabilities: list[float],
    counts: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated exact quantiles of each numeric expression."""
    if not exprs:
        return {}
    counts = counts or filled_counts(df, exprs)
    ranks = {
        name: [
            r
            for p in probabilities
            if counts[name]
            for r in (math.floor(p * (counts[name] - 1)), math.ceil(p * (counts[name] - 1)))
        ]
        for name in exprs
    }
    values = order_statistics(df, exprs, ranks, counts)

    def point(name: str, p: float) -> float | None:
        if not counts[name]:
            return None
        h = p * (counts[name] - 1)
        low, high = math.floor(h), math.ceil(h)
        a, b = values[name][low], values[name][high]
        return a if a == b else a * (high - h) + b * (h - low)

    return {name: [point(name, p) for p in probabilities] for name in exprs}
