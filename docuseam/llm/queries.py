"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bloom_search import ranked_report, ranked_report_sql
from .common import table
from .conversation_trie import trie_query, trie_sql
from .decontaminate import leak_report
from .html_text import html_report
from .language_id import language_query
from .licenses import license_report
from .quality import quality_query
from .secrets import secret_report
from .sentencepiece_codec import token_report
from .simhash_dedup import simhash_groups
from .topk_search import search_report
from .toxicity import toxicity_query
from .url_filter import url_report, url_report_sql

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_report(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(spark, sf_dir)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(spark, sf_dir)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(spark, sf_dir)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_report(spark, sf_dir)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_report(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(spark, sf_dir)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_report(spark, sf_dir)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_query(spark, sf_dir)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_topk_search": op6_topk_search,
    "op7_licenses": op7_licenses,
    "op8_secrets": op8_secrets,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_language": op13_language,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": url_report_sql(),
    "op11_ranked_search": ranked_report_sql(),
    "op12_prefix_trie": trie_sql(),
}
