"""Registered queries of the ten operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_quality_rules(spark, sf_dir):
    from gritstone.llm.quality_rules import quality_rules

    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted).select("row.doc_id", "quality_rules.*")


@query
def op7_minimax_sharding(spark, sf_dir):
    from gritstone.llm.sharding import minimax_shards

    return minimax_shards(table(spark, sf_dir, "documents"))


MIX = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


@query
def op9_soft_mixing(spark, sf_dir):
    from gritstone.llm.mixing import label_domains, soft_mixing

    mixed = soft_mixing(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX, group=F.col("lang"))
    return mixed.select("row.doc_id", "tokens", *[F.col("posteriors")[d].alias(f"p_{d}") for d in MIX], "rate", "copies")


@query
def op10_site_line_dedup(spark, sf_dir):
    from gritstone.llm.line_dedup import page_text, site_line_dedup, url_host

    pages = table(spark, sf_dir, "pages")
    found = site_line_dedup(pages, url_host(F.col("url")), page_text(F.col("html")))
    return found.select("row.page_id", "lines.text", "lines.n_lines", "lines.n_dropped")


# The lines of a page are numbered and judged one by one.
ORACLES["op10_site_line_dedup"] = r"""
with p as (
  select page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '') as host,
    string_split(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
      '<[^>]*>', chr(10), 'g'), chr(10)) as parts
  from pages),
l as (select page_id, host, unnest(parts) as line, generate_subscripts(parts, 1) as i from p),
t as (select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as bare from l),
n as (select host, count(*) as pages from p where host is not null group by host having count(*) >= 5),
f as (select host, bare from t join n using (host) where bare <> ''
      group by host, bare, pages having count(distinct page_id) >= 2 and count(distinct page_id) > 0.3 * pages)
select page_id, coalesce(string_agg(line, chr(10) order by i) filter (where f.bare is null), '') as text,
  count(*) as n_lines, count(f.bare) as n_dropped
from t left join f on t.host = f.host and t.bare = f.bare group by page_id
"""


@query
def op1_packed_matrix(spark, sf_dir):
    from gritstone.llm.packed_matrix import packed_matrix

    return packed_matrix(table(spark, sf_dir, "documents"))


@query
def op8_certified_packing(spark, sf_dir):
    from gritstone.llm.certified_packing import certified_packing

    return certified_packing(table(spark, sf_dir, "documents"))


@query
def op5_epsilon_join(spark, sf_dir):
    from gritstone.llm.epsilon_join import epsilon_join

    return epsilon_join(table(spark, sf_dir, "embeddings"))


@query
def op2_fourier_quality(spark, sf_dir):
    from gritstone.llm.quality_model import quality_scores

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_scores(table(spark, sf_dir, "documents"), labels)


@query
def op6_ngram_join(spark, sf_dir):
    from gritstone.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark, sf_dir):
    from gritstone.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


@query
def op11_max_sketch_search(spark, sf_dir):
    from gritstone.llm.max_sketch import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_token_alignment(spark, sf_dir):
    from gritstone.llm.token_alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"))


@query
def op12_boosted_pii(spark, sf_dir):
    from gritstone.llm.pii import find_personal_data, fit

    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, fit(docs))
