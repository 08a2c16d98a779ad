"""Session helpers: shared scratch space and small metadata frames."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


# Rows that are worth a task of their own where a table is read many times, and the most that such a task gets.
TASK_ROWS = 20_000
MOST_TASK_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a session on this machine alone (master ``local``) may leave it unset; it
    then gets a temporary folder. On a cluster such a folder would be another one
    on every machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured is None:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"Set spark.checkpoint.dir to a folder that all machines of {master} share.")
        configured = tempfile.mkdtemp(prefix="gritstone-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def share_package(spark: SparkSession) -> None:
    """Send this package to the workers once per session, for operators that run Python functions in tasks."""
    context = spark.sparkContext
    if getattr(context, "_gritstone_shared", False):
        return
    root = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as package:
        for source in sorted(root.rglob("*.py")):
            package.write(source, source.relative_to(root.parent))
    # The driver serves this file to the workers; they do not read the folder.
    target = Path(tempfile.mkdtemp(prefix="gritstone-package-")) / "gritstone.zip"
    target.write_bytes(content.getvalue())
    context.addPyFile(str(target))
    context._gritstone_shared = True


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write an intermediate table to the shared folder and read it back; also gives its path."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder once and read it back.

    Later passes then read only the columns they need, whatever executors are lost.
    """
    return written(df)[0]


def dealt(df: DataFrame) -> DataFrame:
    """The rows in as many tasks as there are cores, if they are worth it and too few for files to be split by size.

    Files are split by bytes, so a small compressed file goes through one or two tasks however many rows it holds.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.count()
    tasks = min(cores, rows // TASK_ROWS)
    return df.repartition(tasks) if tasks > 1 and rows <= cores * MOST_TASK_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """A table that is read many times, written once in as many files as its rows are worth; see :func:`dealt`."""
    parts = dealt(df)
    return df if parts is df else materialize(parts)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file unless there is one of its name; of several writers exactly one gets True.

    The content is complete before the name appears: a hidden file is linked, or renamed where the store has no links.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    target = system.makeQualified(hadoop.Path(path))
    hidden = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    system.mkdirs(target.getParent())
    if system.getUri().getScheme() == "file":
        source, final = Path(hidden.toUri().getPath()), Path(target.toUri().getPath())
        source.write_text(content, encoding="utf-8")
        try:
            final.hardlink_to(source)
            return True
        except FileExistsError:
            return False
        finally:
            source.unlink()
    stream = system.create(hidden, False)
    stream.write(bytearray(content.encode()))
    stream.close()
    if not system.exists(target) and system.rename(hidden, target):
        return True
    system.delete(hidden, False)
    return False


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Hand workers at most so many rows at once for jobs run inside, for rows that hold long values."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A local relation for metadata with one row per column, bin or check."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    arrays = [
        pa.array([row[i] for row in rows], type=field.type) for i, field in enumerate(arrow)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), struct)


def chunks(names: list, wide: int) -> list[list]:
    """Group columns into passes over the table, ``wide`` columns each, as many as generated code holds."""
    return [names[i : i + wide] for i in range(0, len(names), wide)]
