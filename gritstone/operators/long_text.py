"""Values that are picked from a frequency table in which long texts stand as short keys.

A key is the beginning of a text and its digest, so keys are counted and ordered like
the texts unless these share their beginning. Of the picked rows, few by nature, the
texts are fetched again and ordered exactly; where too many share a beginning at the
border, texts are taken in ascending portions and looked up in the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.functions.values import quote, text_literal
from gritstone.runtime import small_frame

# Characters of a text that its key shows; a longer text is replaced by these and its digest.
SHOWN = 64
# Keys beyond the wanted ones that are looked at for equal beginnings.
TIES = 200
# Texts of the first ascending portion; later ones are four times as long, up to the last number.
PORTION, MOST = 256, 8192


def key_of(cell: str) -> str:
    """SQL of a text's key: itself, or its beginning and digest, which are longer than any text kept as it is."""
    return f"if(length({cell}) > {SHOWN}, concat(left({cell}, {SHOWN}), ' ', sha2({cell}, 256)), {cell})"


@dataclass
class Pick:
    """The first ``k`` values of each column by ``order`` (SQL, and the same of a row in Python), then by value."""

    kind: str
    k: int
    order: str = ""
    of_row: Callable = lambda r: ()
    where: str = "true"


def by_count(r) -> tuple:
    return (-r.n,)


def native(r) -> tuple:
    return (-r.n, r.real is not None, r.real or 0.0, r.whole is not None, r.whole or 0)


def long_cells(df: DataFrame, columns: dict[int, str]) -> DataFrame:
    """(position, cell, value) of the long texts of some columns, ``value`` being their key."""
    wide = df.selectExpr(*[f"cast({quote(n)} as string) as `{p}`" for p, n in columns.items()])
    cells = wide.unpivot([], wide.columns, "position", "cell").where(f"length(cell) > {SHOWN}")
    return cells.selectExpr("cast(position as int) as position", "cell", f"{key_of('cell')} as value")


def fetch_texts(df: DataFrame, wanted: dict[int, set[str]], columns: dict[int, str]) -> dict[tuple[int, str], str]:
    """Texts of a few keys by position; a task passes on one text for each."""
    keys = [(p, key) for p, some in wanted.items() for key in some]
    if not keys:
        return {}
    listed = small_frame(df.sparkSession, keys, "position int, value string")
    found = long_cells(df, {p: columns[p] for p in wanted}).join(F.broadcast(listed), ["position", "value"])
    texts = found.groupBy("position", "value").agg(F.first("cell").alias("text"))
    return {(r.position, r.value): r.text for r in texts.collect()}


def _ascending(df: DataFrame, freq: DataFrame, position: int, column: str, shown: str, n: int, need: int) -> list[str]:
    """The smallest ``need`` texts of a beginning that occur ``n`` times, in portions of growing size."""
    texts = long_cells(df, {position: column}).where(F.col("cell").substr(1, SHOWN) == F.lit(shown)).select("cell")
    hits: list[str] = []
    bound, size = None, PORTION
    while True:

        def smallest(batches: Iterator[pa.RecordBatch], size=size) -> Iterator[pa.RecordBatch]:
            held: set[str] = set()
            for batch in batches:
                held.update(batch.column(0).to_pylist())
                if len(held) > 2 * size:
                    held = set(heapq.nsmallest(size, held))
            yield pa.RecordBatch.from_arrays([pa.array(heapq.nsmallest(size, held), pa.string())], ["cell"])

        above = texts if bound is None else texts.where(F.col("cell") > F.lit(bound))
        portion = [r.cell for r in above.mapInArrow(smallest, "cell string").distinct().orderBy("cell").limit(size).collect()]
        listed = small_frame(df.sparkSession, [(t,) for t in portion], "cell string").selectExpr("cell", f"{key_of('cell')} as value")
        here = freq.where((F.col("position") == position) & (F.col("n") == n)).select("value")
        known = {r.cell for r in here.join(F.broadcast(listed), "value").select("cell").collect()}
        hits += [t for t in portion if t in known]
        if len(hits) >= need or len(portion) < size:
            return hits[:need]
        bound, size = portion[-1], min(4 * size, MOST)


def pick(df: DataFrame, freq: DataFrame, picks: list[Pick]) -> dict[str, list[tuple]]:
    """``(position, column, rank, value, n)`` for each kind, with whole texts."""
    parts = []
    for p in picks:
        order = f"{p.order}left(value, {SHOWN}), value"
        place = f"row_number() over (partition by position order by {order}) as place"
        ranked = freq.where(p.where).selectExpr("*", place).where(f"place <= {p.k + TIES}")
        parts.append(ranked.selectExpr(f"{text_literal(p.kind)} as kind", "*"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    # At most k + TIES short rows for each column and kind.
    rows = merged.collect()
    columns = {r.position: r.column for r in rows}
    chosen: dict[tuple[str, int], list] = {}
    scans: list[tuple] = []
    wanted: dict[int, set[str]] = {}
    for p in picks:
        for position in columns:
            own = sorted((r for r in rows if r.kind == p.kind and r.position == position), key=lambda r: r.place)

            def level(r, p=p) -> tuple:
                return (*p.of_row(r), r.value[:SHOWN])

            kept = own[: p.k]
            if len(own) > p.k and own[p.k - 1].hashed and level(own[p.k]) == level(own[p.k - 1]):
                tied = [r for r in own if level(r) == level(own[p.k - 1])]
                first = own.index(tied[0])
                if len(own) == p.k + TIES and tied[-1] is own[-1]:
                    kept = own[:first]
                    scans.append((p, position, tied[0], p.k - first))
                else:
                    kept = own[:first] + tied
            chosen[p.kind, position] = kept
            for r in kept:
                if r.hashed:
                    wanted.setdefault(position, set()).add(r.value)
    texts = fetch_texts(df, wanted, columns)
    found: dict[str, list[tuple]] = {p.kind: [] for p in picks}
    for p in picks:
        for position, column in columns.items():
            entries = [(p.of_row(r), texts[position, r.value] if r.hashed else r.value, r.n) for r in chosen[p.kind, position]]
            for scanned, at, r, need in scans:
                if scanned is p and at == position:
                    entries += [(p.of_row(r), t, r.n) for t in _ascending(df, freq, position, column, r.value[:SHOWN], r.n, need)]
            entries.sort(key=lambda e: e[:2])
            found[p.kind] += [(position, column, i, value, n) for i, (_, value, n) in enumerate(entries[: p.k], start=1)]
    return found


def has_text(df: DataFrame, names: list[str]) -> bool:
    return any(isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType)) for f in df.schema.fields if f.name in names)
