"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage takes what its predecessor kept and gives the columns of
``documents``; the last gives one row per packed piece. Between stages the rows
are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.certified_packing import certified_packing
from gritstone.llm.line_dedup import site_line_dedup
from gritstone.llm.mixing import label_domains, soft_mixing
from gritstone.llm.ngram_join import ngram_components
from gritstone.llm.quality_rules import quality_rules
from gritstone.llm.text import packed, quoted
from gritstone.runtime import materialize

#: Shares of the tokens that each domain should have; no document is repeated.
TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}
#: A line is boilerplate above this share of its source's documents, and in so many of them at least. Sources are large
#: and mixed, so shares are far below those of web hosts.
LINE_RATIO = 0.02
LINE_HOLDING = 5


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no base rule and read like the trusted ones; the others go."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality_rules(docs, trusted).where("quality_rules.kept").select("row.*")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents of their source hold; ``n_chars`` follows the text.

    A document that would lose more than half of its lines is a copy rather than a framed text. It stays whole, so that
    the next stage finds it and its group keeps one document.
    """
    found = site_line_dedup(docs, F.col("source"), F.col("text"), LINE_RATIO, min_holding=LINE_HOLDING)
    copy = 2 * F.col("lines.n_dropped") > F.col("lines.n_lines")
    text = F.when(copy, F.col("row.text")).otherwise(F.col("lines.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, rows without id last.

    Rows are told apart by a number of their own, not by ``doc_id``: of repeated rows one stays, with or without an id,
    and a text that shares its id with another is judged for itself.
    """
    numbered = packed(docs).select(F.monotonically_increasing_id().alias("number"), "row")
    # A file of the stage before may be one block, which one task would read whole in every pass.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(numbered.repartition(parts, "number"))
    groups = ngram_components(rows.select(F.col("number").alias("doc_id"), "row.text"))
    ids = rows.select("number", F.col("row.doc_id").alias("id"))
    members = groups.select(F.col("doc_id").alias("number"), "component_id").join(ids, "number")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number")).alias("first"))
    return rows.join(first.select("first.number"), "number", "left_semi").select("row.*")


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the fitted rates, none more than once."""
    labelled = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return soft_mixing(docs, labelled, TARGETS, max_rate=1.0, group=F.col("lang")).where("copies > 0").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return certified_packing(docs)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("line_dedup", drop_boilerplate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Hashed n-grams, similarity components and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
