"""Feature preparation: target choice, encoding, scaling, PCA, selection, interactions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gritstone.functions.values import is_number, is_real, is_text, number_literal, quote, text_literal
from gritstone.operators import frequency
from gritstone.operators.correlation import pair_moments, _ratio
from gritstone.operators.normalize import normalize, text_columns, types_of
from gritstone.runtime import small_frame

# Limits of the feature steps.
ONE_HOT_VALUES = 30
PCA_VARIANCE = 0.9
MIN_VARIANCE = 1e-10
MAX_CORRELATION = 0.98
INTERACTION_COLUMNS = 4
TARGET_VALUES = 20
TARGET_SHARE = 0.5
CLASS_VALUES = 20
# Where an estimated distinct count, with a standard error of 2 %, is not trusted.
ESTIMATE_MARGIN = 0.2
FEW = 10
CLASS_SHARE = 0.2


def choose_target(df: DataFrame, hint: str | None = None) -> str | None:
    """The hinted column, else the last with a moderate number of values, else the last."""
    if hint in df.columns:
        return hint
    rows = df.count()
    limit = max(TARGET_VALUES, int(rows * TARGET_SHARE))
    # Estimates decide where they can; only columns near a limit are counted exactly, from the last on.
    estimates = frequency.near_distinct(df, df.columns)
    for c in reversed(df.columns):
        about = estimates[c]
        if about > limit * (1 + ESTIMATE_MARGIN) + FEW:
            continue
        if FEW < about < limit * (1 - ESTIMATE_MARGIN):
            return c
        counted = frequency.distinct_counts(df.select(quote(c))).first()
        if 1 < counted.distinct_count <= limit:
            return c
    return df.columns[-1] if df.columns else None


def infer_task(df: DataFrame, target: str, mode: str = "model_lab") -> str:
    """classification or regression, by type and number of target values."""
    if is_text(types_of(df)[target]):
        return "classification"
    limit = CLASS_VALUES
    if mode == "model_lab":
        rows = df.where(f"{quote(target)} is not null").count()
        limit = min(CLASS_VALUES, max(2, int(rows * CLASS_SHARE)))
    return "classification" if frequency.values_up_to(df, [target], limit) else "regression"


def category_values(df: DataFrame, columns: list[str], limit: int) -> dict[str, list[str]]:
    """Sorted values of the columns that hold at most ``limit`` of them."""
    return {c: list(v) for c, v in frequency.values_up_to(df, columns, limit).items()}


def one_hot(df: DataFrame, max_values: int = ONE_HOT_VALUES, columns: list[str] | None = None) -> DataFrame:
    """Replace low-cardinality text columns by 0/1 columns ``<column>_<value>`` and ``<column>_nan``."""
    texts = text_columns(df) if columns is None else columns
    encoded = category_values(df, texts, max_values)
    kept = [quote(c) for c in df.columns if c not in encoded]
    added = []
    for c, values in encoded.items():
        for v in values:
            hit = f"coalesce({quote(c)} = {text_literal(v)}, false)"
            added.append(f"cast({hit} as int) as {quote(f'{c}_{v}')}")
        added.append(f"cast({quote(c)} is null as int) as {quote(f'{c}_nan')}")
    return df.selectExpr(*kept, *added)


def numeric_features(df: DataFrame) -> DataFrame:
    """Numeric columns only; booleans become 0/1, missing and infinite cells 0."""
    columns = []
    for f in df.schema.fields:
        cell = quote(f.name)
        if isinstance(f.dataType, T.BooleanType):
            columns.append(f"coalesce(cast({cell} as int), 0) as {cell}")
        elif is_real(f.dataType):
            finite = f"abs({cell}) < double('inf')"
            columns.append(f"if({finite}, {cell}, cast(0 as {f.dataType.simpleString()})) as {cell}")
        elif is_number(f.dataType):
            columns.append(f"coalesce({cell}, 0) as {cell}")
    return df.selectExpr(*columns)


def scale_facts(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) of each column from one pass."""
    facts = {}
    for start in range(0, len(columns), 16):
        chunk = columns[start : start + 16]
        row = df.selectExpr(
            *[f"avg({quote(c)}) as m{i}" for i, c in enumerate(chunk)],
            *[f"stddev_pop({quote(c)}) as s{i}" for i, c in enumerate(chunk)],
        ).first()
        facts.update({c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(chunk)})
    return facts


def scaled(cell: str, mean: float, deviation: float) -> str:
    if deviation == 0:
        return f"if({cell} is null, null, 0D)"
    return f"(({cell} - {number_literal(mean)}) / {number_literal(deviation)})"


def standard_scale(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Centre and scale by the population deviation; a constant column becomes 0."""
    names = [c for c in df.columns if is_number(types_of(df)[c])] if columns is None else columns
    facts = scale_facts(df, names)
    return df.selectExpr(
        *[
            f"coalesce({scaled(quote(c), *facts[c])}, 0D) as {quote(c)}" if c in facts else quote(c)
            for c in df.columns
        ]
    )


@dataclass
class PcaResult:
    """Components ``pca_1..k`` with the kept variance ratios."""

    df: DataFrame
    input_features: int
    ratios: list[float]

    @property
    def kept(self) -> int:
        return len(self.ratios)

    @property
    def variance(self) -> DataFrame:
        total, rows = 0.0, []
        for i, ratio in enumerate(self.ratios, start=1):
            total += ratio
            rows.append((i, ratio, total))
        return small_frame(
            self.df.sparkSession, rows, "component int, explained_variance double, cumulative double"
        )


def pca_90(df: DataFrame, columns: list[str] | None = None, share: float = PCA_VARIANCE) -> PcaResult | None:
    """Fewest principal components of the scaled columns that explain ``share`` of the variance."""
    numbers = numeric_features(df)
    names = numbers.columns if columns is None else columns
    rows = numbers.count()
    if len(names) < 2 or rows < 3:
        return None
    ready = standard_scale(numbers.select(*[quote(c) for c in names]))
    vectors = VectorAssembler(inputCols=names, outputCol="__scaled").transform(ready).select("__scaled")
    limit = max(1, min(len(names), rows - 1))
    model = PCA(k=limit, inputCol="__scaled", outputCol="__components").fit(vectors)
    ratios = [float(v) for v in model.explainedVariance.toArray()]
    kept, total = limit, 0.0
    for i, ratio in enumerate(ratios, start=1):
        total += ratio
        if total >= share:
            kept = i
            break
    values = vector_to_array("__components")
    parts = model.transform(vectors).select(*[values[i].alias(f"pca_{i + 1}") for i in range(kept)])
    return PcaResult(parts, len(names), ratios[:kept])


def variances(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Sample variances, largest first; ties keep column order."""
    found: dict[str, float] = {}
    for start in range(0, len(columns), 24):
        chunk = columns[start : start + 24]
        row = df.selectExpr(*[f"var_samp({quote(c)}) as v{i}" for i, c in enumerate(chunk)]).first()
        found.update({c: row[f"v{i}"] or 0.0 for i, c in enumerate(chunk)})
    return dict(sorted(found.items(), key=lambda item: -item[1]))


def variance_select(df: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> list[str]:
    """Columns that vary, by falling variance; the first ``limit`` if given (say 80)."""
    ranked = variances(df, df.columns if columns is None else columns)
    return [c for c, v in ranked.items() if v > MIN_VARIANCE][:limit]


def drop_correlated(df: DataFrame, columns: list[str], limit: float = MAX_CORRELATION) -> list[str]:
    """Columns left after dropping the later one of every strongly correlated pair."""
    flat = normalize(df.select(*[quote(c) for c in columns]))
    moments = pair_moments(flat, columns)
    dropped = set()
    for i, j in combinations(range(len(columns)), 2):
        _, cov, vx, vy = moments[(i, j)]
        value = _ratio(cov, vx, vy)
        if value is not None and math.fabs(value) > limit:
            dropped.add(columns[j])
    return [c for c in columns if c not in dropped]


def interaction_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add products and squares of the columns with the largest variance."""
    names = df.columns if columns is None else columns
    if len(names) < 2:
        return df
    top = list(variances(df, names))[:INTERACTION_COLUMNS]
    added = [(f"{a}__x__{b}", f"{quote(a)} * {quote(b)}") for a, b in combinations(top, 2)]
    added += [(f"{c}__squared", f"{quote(c)} * {quote(c)}") for c in top]
    return df.selectExpr(
        "*", *[f"cast(if(abs({e}) < double('inf'), {e}, 0D) as double) as {quote(n)}" for n, e in added]
    )


def feature_variants(df: DataFrame, columns: list[str]) -> list[tuple[str, DataFrame, list[str], list[str]]]:
    """Up to three (name, table, feature columns, actions): baseline, selected, interactions."""
    others = [c for c in df.columns if c not in columns]
    variants = [("baseline_features", df, columns, ["use the prepared feature table"])]
    if len(columns) >= 3:
        kept = variance_select(df, columns)
        if 0 < len(kept) < len(columns):
            kept = drop_correlated(df, kept)
            actions = ["drop near-constant features", "drop highly correlated duplicates"]
            selected = df.select(*[quote(c) for c in [*others, *kept]])
            variants.append(("selected_low_leakage_features", selected, kept, actions))
    enriched = interaction_features(df, columns)
    if len(enriched.columns) > len(df.columns):
        actions = ["add pairwise interactions", "add squared high-variance terms"]
        names = [c for c in enriched.columns if c not in others]
        variants.append(("interaction_features", enriched, names, actions))
    return variants[:3]


def prepare_features(
    df: DataFrame, target: str | None, keep: list[str] | None = None, scale: bool = True
) -> tuple[DataFrame, list[str]]:
    """Encode and scale everything but the target and ``keep``; returns table and features.

    The kept columns and the target stay beside the features, so no later join
    has to bring them back.
    """
    aside = [c for c in dict.fromkeys([*(keep or []), *([target] if target else [])]) if c in df.columns]
    texts = [c for c in text_columns(df) if c not in aside]
    encoded = one_hot(df, columns=texts)
    features = [
        f.name
        for f in encoded.schema.fields
        if f.name not in aside and (is_number(f.dataType) or isinstance(f.dataType, T.BooleanType))
    ]
    numbers = numeric_expressions(encoded, features)
    ready = encoded.selectExpr(*[quote(c) for c in aside], *numbers)
    return (standard_scale(ready, features) if scale and features else ready), features


def numeric_expressions(df: DataFrame, features: list[str]) -> list[str]:
    types = types_of(df)
    columns = []
    for c in features:
        cell = f"cast({quote(c)} as {'int' if isinstance(types[c], T.BooleanType) else 'double'})"
        columns.append(f"cast(if(abs({cell}) < double('inf'), {cell}, 0) as double) as {quote(c)}")
    return columns
