"""Cleaning plan derived from a profile: what a run would do, and why."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from gritstone.functions.values import BLANK_MARKERS
from gritstone.operators.profile import Profile
from gritstone.runtime import small_frame

# Title, reason, destructive flag and confidence of each operation type.
OPERATION_FACTS = {
    "remove_duplicates": (
        "Remove exact duplicate rows",
        "Exact duplicates reduce dataset quality and can bias downstream analysis.",
        True,
        0.92,
    ),
    "trim_normalize_text": (
        "Normalize text in {name}",
        "Whitespace and inconsistent blank markers are common import defects.",
        False,
        0.84,
    ),
    "fill_missing_median": (
        "Fill missing numeric values in {name}",
        "Median imputation is deterministic and robust to outliers.",
        False,
        0.78,
    ),
    "parse_dates": (
        "Parse dates in {name}",
        "Standard date parsing creates a consistent ISO-like representation.",
        False,
        0.76,
    ),
    "validate_email": (
        "Flag invalid emails in {name}",
        "Invalid emails should be made explicit without silently deleting rows.",
        False,
        0.86,
    ),
    "copy_with_manifest": (
        "Create audited clean copy",
        "No severe issues were detected; produce a validated immutable output.",
        False,
        0.7,
    ),
}
PLAN_SCHEMA = (
    "id string, title string, reason string, columns string, operation_type string, parameters string,"
    " destructive boolean, reversible boolean, confidence double"
)


@dataclass
class CleaningPlan:
    """Ordered operations with the issues that led to them, all of them unless limits are given (say 16 and 12)."""

    profile: Profile
    request: str = ""
    max_operations: int | None = None
    max_issues: int | None = None

    @property
    def summary(self) -> str:
        return f"Plan for request: {self.request}"

    @property
    def issues(self) -> list[str]:
        return self.profile.problems[: self.max_issues]

    @cached_property
    def steps(self) -> list[tuple[str, str | None, str]]:
        """(operation type, column, parameters) in plan order."""
        found: list[tuple[str, str | None, str]] = []
        if self.profile.summary["duplicate_rows"]:
            found.append(("remove_duplicates", None, ""))
        for c in self.profile.columns:
            name, kind = c["column"], c["inferred_type"]
            if kind in {"string", "categorical", "email"}:
                found.append(("trim_normalize_text", name, "empty_markers=" + "|".join(BLANK_MARKERS)))
            if c["null_count"] and kind == "numeric":
                found.append(("fill_missing_median", name, "strategy=median"))
            if kind == "datetime":
                found.append(("parse_dates", name, ""))
            if kind == "email":
                found.append(("validate_email", name, f"flag_column={name}_is_valid"))
        return found[: self.max_operations] or [("copy_with_manifest", None, "")]

    @property
    def risk_level(self) -> str:
        return "medium" if any(OPERATION_FACTS[s[0]][2] for s in self.steps) else "low"

    @cached_property
    def operations(self) -> DataFrame:
        rows = []
        for i, (kind, name, parameters) in enumerate(self.steps, start=1):
            title, reason, destructive, confidence = OPERATION_FACTS[kind]
            rows.append(
                (
                    f"operation_{i:03d}", title.format(name=name), reason, name or "", kind, parameters,
                    destructive, True, confidence,
                )
            )
        return small_frame(self.profile.df.sparkSession, rows, PLAN_SCHEMA)


def plan_cleaning(
    profile: Profile, request: str = "", max_operations: int | None = None, max_issues: int | None = None
) -> CleaningPlan:
    """Plan the cleaning of a profiled table. Every plan requires approval."""
    return CleaningPlan(profile, request, max_operations, max_issues)
