"""Read-only SQL over one table, registered as ``dataset``."""

from __future__ import annotations

import threading
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from gritstone.operators.plan_guard import check_plan

MAX_QUERY_LENGTH = 20_000
PREVIEW_ROWS = 100
VIEW = "dataset"
_lock = threading.Lock()


@dataclass
class SqlResult:
    """Lazy result of a cell; ``total`` and ``preview`` run on demand."""

    df: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @cached_property
    def total(self) -> int:
        return self.df.count()

    def preview(self, n: int = PREVIEW_ROWS) -> DataFrame:
        return self.df.limit(n)


def run_sql(df: DataFrame, query: str) -> SqlResult:
    """Run a query over ``dataset``. Analysis is eager, execution stays lazy.

    The text is first analyzed as a subquery, where nothing but a query parses, so a
    command is refused before it can run. The analyzed plan may hold query operators
    only and read no table but ``dataset``.
    """
    text = query.strip()
    if len(text) > MAX_QUERY_LENGTH:
        raise ValueError(f"The query is longer than {MAX_QUERY_LENGTH} characters.")
    spark = df.sparkSession
    with _lock:
        previous = spark.table(VIEW) if spark.catalog.tableExists(VIEW) else None
        files = spark.conf.get("spark.sql.runSQLOnFiles")
        df.createOrReplaceTempView(VIEW)
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        try:
            try:
                nested = spark.sql(f"select * from (\n{text}\n)")
            except AnalysisException as error:  # what does not parse or names another table
                raise ValueError(f"The cell takes one query over {VIEW} and nothing else: {error}") from error
            check_plan(nested._jdf.queryExecution().analyzed(), VIEW)
            found = spark.sql(text)
            check_plan(found._jdf.queryExecution().analyzed(), VIEW)
            return SqlResult(found)
        finally:
            spark.conf.set("spark.sql.runSQLOnFiles", files)
            if previous is None:
                spark.catalog.dropTempView(VIEW)
            else:
                previous.createOrReplaceTempView(VIEW)
