"""Line removal by site-relative frequency.

Rows are grouped by host. For every line of a host, the number of its pages that
hold the line is divided by the number of all its pages; lines above the ratio
are boilerplate and leave every page of that host, all occurrences included.

Lines are compared without leading and trailing ASCII white space. Blank lines
always stay. A host needs ``min_pages`` rows, and a line ``min_holding``, to be judged. Rows
with a null host keep all lines. Null text has no lines and stays null; so does
empty text. Equal rows count as pages of their own. Extra columns are kept,
whatever their names, inside the struct ``row``.

Counts are combined before they are shuffled and lines travel as 64-bit hashes.
The flagged hashes of a host number at most its mean lines per page divided by
the ratio, so one array per host joins the pages; a host with a third of all
rows is split by adaptive skew handling, because only its side of the join is
large.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from gritstone.llm import text as T
from gritstone.runtime import share_package

MAX_RATIO = 0.3
MIN_PAGES = 5
MIN_HOLDING = 2


def line_hashes(text: Column) -> Column:
    """Hash of every line without outer white space; null for blank lines."""
    trimmed = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, f"^{T.SPACE}+|{T.SPACE}+$", ""))
    return F.transform(trimmed, lambda s: F.when(s != "", F.xxhash64(s)))


def boilerplate(
    pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, min_holding: int = MIN_HOLDING
) -> DataFrame:
    """``host, flagged``: hashes of a host's boilerplate lines. ``pages`` has ``host, hashes``."""
    known = pages.where("host is not null")
    totals = known.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    held = (
        known.select("host", F.explode(F.array_distinct("hashes")).alias("line"))
        .where("line is not null")
        .groupBy("host", "line")
        .agg(F.count("*").alias("holding"))
        .where((F.col("holding") >= min_holding) & (F.col("holding") > F.lit(max_ratio * min_pages)))
    )
    return (
        held.join(totals, "host")
        .where(F.col("holding") > F.lit(max_ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("flagged"))
    )


@F.pandas_udf(StructType().add("text", StringType()).add("n_lines", LongType()).add("n_dropped", LongType()))
def _without(text: pd.Series, hashes: pd.Series, flagged: pd.Series) -> pd.DataFrame:
    out = []
    for whole, codes, drop in zip(text, hashes, flagged, strict=True):
        if whole is None:
            out.append((None, 0, 0))
            continue
        # A list with nulls arrives as floats unless it is kept as objects; see `nullable` below.
        gone = set() if drop is None else set(drop)
        pieces = whole.split("\n")
        kept = [p for p, c in zip(pieces, codes, strict=True) if c not in gone] if gone else pieces
        out.append(("\n".join(kept), len(pieces), len(pieces) - len(kept)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def site_line_dedup(
    pages: DataFrame,
    host: Column,
    text: Column,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    min_holding: int = MIN_HOLDING,
) -> DataFrame:
    """Every input row in ``row`` with a struct ``lines``: remaining text, lines before, lines dropped."""
    share_package(pages.sparkSession)
    known = T.packed(pages, host=host, text=text).withColumn("hashes", line_hashes(F.col("text")))
    flagged = boilerplate(known.select("host", "hashes"), max_ratio, min_pages, min_holding)
    # Zero stands for blank lines: 64-bit values must not pass through floats.
    nullable = F.transform(F.col("hashes"), lambda h: F.coalesce(h, F.lit(0)))
    return known.join(flagged, "host", "left").select("row", _without("text", nullable, "flagged").alias("lines"))


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, every other tag ends a line."""
    bare = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    return F.regexp_replace(bare, r"<[^>]*>", "\n")


def url_host(url: Column) -> Column:
    """Lower-case host of a URL; null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
