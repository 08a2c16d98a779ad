"""Read a dataset by file suffix into a typed DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gritstone.functions.values import MISSING_TEXTS, numeric, quote, text_literal
from gritstone.operators.per_column import per_column
from gritstone.sources.records import read_delimited, read_json_array
from gritstone.sources.workbook import read_workbook

SEPARATORS = {"csv": ",", "tsv": "\t"}
UTF8, LATIN1 = "UTF-8", "ISO-8859-1"
# Spellings of booleans and whole numbers in delimited text.
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")
WHOLE_PATTERN = "^[+-]?[0-9]+$"


def format_of(path: str) -> str:
    """Dataset format named by a path's suffix."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = name.rsplit(".", 1)[-1] if "." in name else ""
    if suffix == "xls":
        raise ValueError("Legacy .xls workbooks are not supported; save the file as .xlsx.")
    return suffix if suffix in {"csv", "tsv", "xlsx", "parquet", "json", "jsonl"} else "csv"


def read_dataset(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    encoding: str = "auto",
    multiline: bool | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Read CSV, TSV, JSON, JSON lines, Parquet or XLSX.

    Delimited text is typed from all its cells. ``schema``, ``encoding`` and
    ``multiline`` spare the passes that would find them out.
    """
    kind = format or format_of(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return read_json_array(spark, path, schema)
    if kind == "jsonl":
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if kind == "xlsx":
        return type_columns(read_workbook(spark, path), schema)
    if kind not in SEPARATORS:
        raise ValueError(f"Unsupported format '{kind}'.")
    if encoding == "auto" or multiline is None:
        found_encoding, found_multiline = probe_text(spark, path)
        encoding = found_encoding if encoding == "auto" else encoding
        multiline = found_multiline if multiline is None else multiline
    if multiline:
        return type_columns(read_delimited(spark, path, SEPARATORS[kind], encoding), schema)
    plain = spark.read.option("header", True).option("sep", SEPARATORS[kind]).option("encoding", encoding).option("escape", '"')
    return type_columns(plain.csv(path), schema)


def probe_text(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding, and whether any quoted cell spans lines, from one pass over the lines.

    Lines that are not valid UTF-8 make it Latin-1. Where a line has unbalanced
    quotes, records are cut by the state of quotes instead of at every line.
    """
    quotes = "length(value) - length(replace(value, '\"', ''))"
    row = (
        spark.read.text(path)
        .selectExpr(
            "coalesce(max(not is_valid_utf8(value)), false) as foreign_bytes",
            f"coalesce(max(({quotes}) % 2 = 1), false) as open_quotes",
        )
        .first()
    )
    return LATIN1 if row["foreign_bytes"] else UTF8, row["open_quotes"]


def type_columns(raw: DataFrame, schema: str | None = None) -> DataFrame:
    """Turn missing-value texts into null and cast each text column to the type all its cells share."""
    listed = ", ".join(text_literal(t) for t in MISSING_TEXTS)
    names = raw.columns
    typed = {f.name for f in raw.schema.fields if not isinstance(f.dataType, T.StringType)}
    texts = raw.selectExpr(*[quote(c) if c in typed else f"if({quote(c)} in ({listed}), null, {quote(c)}) as {quote(c)}" for c in names])
    if schema:
        fields = T.StructType.fromDDL(schema).fields
        return texts.selectExpr(
            *[f"try_cast({quote(c)} as {f.dataType.simpleString()}) as {quote(f.name)}" for c, f in zip(names, fields)]
        )
    untyped = [c for c in names if c not in typed]
    if not untyped:
        return texts
    text_type = raw.schema[untyped[0]].dataType
    booleans = ", ".join(text_literal(t) for t in TRUE_TEXTS + FALSE_TEXTS)
    evidence = {
        "filled": lambda c: f"count({quote(c)})",
        "numbers": lambda c: f"count({numeric(quote(c), text_type)})",
        "wholes": lambda c: f"count(if(trim({quote(c)}) rlike '{WHOLE_PATTERN}', try_cast(trim({quote(c)}) as bigint), null))",
        "booleans": lambda c: f"count_if({quote(c)} in ({booleans}))",
    }
    columns = {c: quote(c) for c in typed}
    for r in per_column(texts, untyped, evidence).collect():
        cell = quote(r.column)
        if not r.filled:
            columns[r.column] = "cast(null as double)"
        elif r.booleans == r.filled:
            columns[r.column] = f"lower({cell}) = 'true'"
        elif r.wholes == r.filled:
            columns[r.column] = f"try_cast(trim({cell}) as bigint)"
        elif r.numbers == r.filled:
            columns[r.column] = numeric(cell, text_type)
        else:
            columns[r.column] = cell
    return texts.selectExpr(*[f"{columns[c]} as {quote(c)}" for c in names])


def export(df: DataFrame, path: str, format: str) -> None:
    """Write a table as csv, tsv, parquet, json or jsonl (one object per line); never overwrites."""
    if format == "parquet":
        df.write.parquet(path)
    elif format in {"json", "jsonl"}:
        df.write.option("ignoreNullFields", False).json(path)
    elif format in SEPARATORS:
        writer = df.write.option("sep", SEPARATORS[format]).option("escape", '"')
        keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(**keep_spaces).csv(path, header=True)
    else:
        raise ValueError(f"Unsupported format '{format}'.")
