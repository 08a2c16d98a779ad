"""Registry of the queries that the driver checks against DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, oracle: str | None = None):
    """Register a query under ``name`` with its equivalent SQL, if SQL can express it."""

    def register(build):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Whole-table views with injected defects. The same text runs in both engines.
DIRTY_CUSTOMER = """
with base as (
  select c_custkey,
    case when c_custkey % 10 = 3 then concat('  ', c_name, ' ') else c_name end as c_name,
    case when c_custkey % 7 = 0 then cast(null as double)
         when c_custkey % 97 = 1 then c_acctbal * 50 else c_acctbal end as c_acctbal,
    case when c_custkey % 20 = 0 then 'n/a' when c_custkey % 20 = 1 then ''
         when c_custkey % 20 = 2 then ' null ' else c_mktsegment end as c_mktsegment,
    case when c_custkey % 11 = 5 then concat('user', cast(c_custkey as varchar(20)), '.example.org')
         when c_custkey % 13 = 0 then cast(null as varchar(60))
         else concat('user', cast(c_custkey as varchar(20)), '@example.org') end as email,
    case when c_custkey % 17 = 4 then 'x' else cast(c_custkey % 50 as varchar(20)) end as age_text,
    case when c_custkey % 19 = 2 then 'not a date'
         else concat('2024-', lpad(cast(c_custkey % 12 + 1 as varchar(2)), 2, '0'), '-',
                     lpad(cast(c_custkey % 28 + 1 as varchar(2)), 2, '0')) end as created_at
  from {customer})
select * from base union all select * from base where c_custkey % 25 = 0
union all select null, null, null, null, null, null, null from {customer} where c_custkey % 500 = 0
"""

DIRTY_LINEITEM = """
select l_orderkey, l_linenumber,
  case when l_orderkey % 9 = 0 then cast(null as double) else l_quantity end as l_quantity,
  case when l_orderkey % 211 = 7 then l_extendedprice * 20 else l_extendedprice end as l_extendedprice,
  l_discount, cast(1.0 as double) as const_col,
  case when l_linenumber = 2 then cast(null as varchar(1)) else l_returnflag end as l_returnflag, l_shipdate
from {lineitem}
"""


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY_CUSTOMER, customer=table(spark, sf_dir, "customer"))


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY_LINEITEM, lineitem=table(spark, sf_dir, "lineitem"))


CUSTOMER_SQL = "(" + DIRTY_CUSTOMER.format(customer="customer") + ")"
LINEITEM_SQL = "(" + DIRTY_LINEITEM.format(lineitem="lineitem") + ")"

# Column kinds of the tables used by generated oracle SQL.
LINEITEM_COLUMNS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
DIRTY_CUSTOMER_COLUMNS = {
    "c_custkey": "bigint", "c_name": "string", "c_acctbal": "double", "c_mktsegment": "string",
    "email": "string", "age_text": "string", "created_at": "string",
}
DIRTY_LINEITEM_COLUMNS = {
    "l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
    "l_discount": "double", "const_col": "double", "l_returnflag": "string", "l_shipdate": "timestamp_ntz",
}
NUMERIC_KINDS = {"bigint", "int", "double"}


def numbers(columns: dict[str, str]) -> list[str]:
    return [c for c, kind in columns.items() if kind in NUMERIC_KINDS]


# DuckDB spellings of the cell readings.
DUCK_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DUCK_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
DUCK_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def duck_number(column: str, kind: str) -> str:
    if kind in NUMERIC_KINDS:
        return f"cast({column} as double)"
    return f"case when regexp_matches(trim({column}), '{DUCK_NUMBER}') then try_cast(trim({column}) as double) end"


def union(parts: list[str]) -> str:
    return " union all ".join(parts)


def per_column_sql(source: str, columns: dict[str, str], build) -> str:
    """One SELECT per column; ``build(name, kind)`` gives the select list."""
    parts = [
        f"select cast({i} as int) as position, '{name}' as \"column\", {build(name, kind)} from src"
        for i, (name, kind) in enumerate(columns.items())
    ]
    return f"with src as (select * from {source}) {union(parts)}"
