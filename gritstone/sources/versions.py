"""Immutable dataset versions as Parquet directories, listed in a log of numbered commits.

A version exists once its commit does. A commit is one small file named by the version's number that is put only if
there is none, so of two promotions to one number exactly one succeeds, and whatever was interrupted is never listed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators.profile import dataset_summary, profile
from gritstone.runtime import dealt, discard, put_if_absent, small_frame

CATALOG_SCHEMA = (
    "dataset_id string, filename string, version int, label string, path string, created_at timestamp_ntz,"
    " row_count bigint, column_count bigint, data_quality_score double, fingerprint string"
)


@dataclass
class VersionStore:
    """Versions below one root folder. Nothing written is ever changed."""

    spark: SparkSession
    root: str

    @property
    def _log_path(self) -> str:
        return f"{self.root.rstrip('/')}/_log"

    def _catalog(self) -> DataFrame:
        """One row per committed version."""
        reader = self.spark.read.schema(CATALOG_SCHEMA).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(self._log_path)

    def _add(self, df: DataFrame, dataset_id: str, filename: str, version: int, label: str, profiled: bool) -> int:
        # Every attempt writes a folder of its own; it becomes a version with its commit, so an attempt that is
        # interrupted in between leaves nothing that blocks the next one.
        path = f"{self.root.rstrip('/')}/{dataset_id}/version-{version}-{uuid.uuid4().hex[:8]}"
        # Stages read a version many times.
        dealt(df).write.mode("error").parquet(path)
        stored = self.spark.read.parquet(path)
        facts = dataset_summary(stored)
        if profiled:
            found = profile(stored)
            tables = {"column_table": found.column_table, "dataset": found.dataset}
            tables["problems"] = small_frame(self.spark, [(i, p) for i, p in enumerate(found.problems, start=1)], "place int, problem string")
            for name, table in tables.items():
                table.write.parquet(f"{path}.profile/{name}")
        now = datetime.now(timezone.utc).replace(tzinfo=None).isoformat(timespec="microseconds")
        row = (
            dataset_id, filename, version, label, path, now, facts["row_count"], facts["column_count"],
            facts["data_quality_score"], facts["fingerprint"],
        )
        names = [part.split()[0] for part in CATALOG_SCHEMA.split(", ")]
        commit = json.dumps(dict(zip(names, row, strict=True)))
        if not put_if_absent(self.spark, f"{self._log_path}/{dataset_id}/{version:08d}.json", commit):
            discard(self.spark, path, f"{path}.profile")
            raise RuntimeError(f"Version {version} of '{dataset_id}' was stored by another promotion.")
        return version

    def create(self, df: DataFrame, filename: str, dataset_id: str | None = None, profiled: bool = False) -> str:
        """Store a table as version 1 of a new dataset, with its profile if wanted, and return the dataset's id."""
        name = dataset_id or f"ds_{uuid.uuid4().hex[:10]}"
        self._add(df, name, filename, 1, "Original upload", profiled)
        return name

    def promote(self, df: DataFrame, dataset_id: str, label: str, profiled: bool = False) -> int:
        """Store a table as the next version; a concurrent promotion of the same number fails."""
        latest = self._latest(dataset_id)
        return self._add(df, dataset_id, latest["filename"], latest["version"] + 1, label, profiled)

    def _versions(self, dataset_id: str) -> DataFrame:
        return self._catalog().where(F.col("dataset_id") == dataset_id)

    def _latest(self, dataset_id: str):
        row = self._versions(dataset_id).orderBy("version", ascending=False).first()
        if row is None:
            raise KeyError(f"Unknown dataset '{dataset_id}'.")
        return row

    def read(self, dataset_id: str, version: int | None = None) -> DataFrame:
        """A version of a dataset, by default the current one."""
        return self.spark.read.parquet(self._path(dataset_id, version))

    def profile(self, dataset_id: str, version: int | None = None, name: str = "column_table") -> DataFrame:
        """A table of the profile that was stored with a version: column_table, dataset or problems."""
        return self.spark.read.parquet(f"{self._path(dataset_id, version)}.profile/{name}")

    def _path(self, dataset_id: str, version: int | None) -> str:
        latest = self._latest(dataset_id)
        wanted = latest["version"] if version is None else version
        if not 1 <= wanted <= latest["version"]:
            raise KeyError(f"Unknown version {wanted} of '{dataset_id}'.")
        return self._versions(dataset_id).where(F.col("version") == wanted).first()["path"]

    def list(self) -> DataFrame:
        """All versions, newest first."""
        return self._catalog().orderBy("created_at", "dataset_id", "version", ascending=[False, True, False])

    def version_compare(self, dataset_id: str) -> DataFrame:
        """Quality, rows and columns per version, with the change since version 1."""
        first = "first_value({0}) over (partition by dataset_id order by version)"
        return self._versions(dataset_id).selectExpr(
            "version",
            "label",
            "row_count",
            "column_count",
            "data_quality_score",
            f"row_count - {first.format('row_count')} as row_delta",
            f"column_count - {first.format('column_count')} as column_delta",
            f"round(data_quality_score - {first.format('data_quality_score')}, 1) as quality_delta",
        )
