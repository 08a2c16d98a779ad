"""Column expressions on texts that the native operators share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def lines(text: Column) -> Column:
    """Pieces between line feeds; one empty line for null or empty text."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def buckets(tokens: Column, size: int) -> Column:
    """Hash bucket of each word, then of each pair of neighbours."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    single = F.transform(tokens, lambda w: F.xxhash64(w))
    both = F.concat(single, F.slice(pairs, 1, F.greatest(F.size(tokens) - 1, F.lit(0))))
    return F.transform(both, lambda h: F.pmod(h, F.lit(size)).cast("int"))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The row as one struct column ``row`` beside new columns, so that no name can clash with the input's."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns that later filters and projections use as they are.

    The optimizer replaces a column by its expression where a filter uses it; inside a lambda the expression would then
    run once for every element. A generator of one row is not looked through.
    """
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select(*keep, made.alias("_made")).select(*keep, *[F.col(f"_made.{k}").alias(k) for k in columns])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def constant_array(numbers: list, kind: str = "array<double>") -> Column:
    """A short list of numbers as a constant that the optimizer folds."""
    return F.from_json(F.lit(json.dumps(numbers)), kind)
