"""Fusion of route hits: reciprocal ranks, bonuses and aggregates per case.

Hits are one long table: query_id, route, weight, chunk_id, doc_id,
section_type, score. Ties break by id, never by arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FOCUS_SECTIONS, KEY_SECTIONS, LEGAL_SECTIONS, RERANK_ORDER
from .corpus import section_weight

RRF_K = 10
#: Added before rounding, so that sums of short decimals never sit on a half.
NUDGE = 1e-9


def ranked(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id", "route").orderBy(F.desc("score"), F.asc("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(w))


def chunk_rrf(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Sum of weight / (k + rank) per chunk over the routes."""
    part = F.col("weight") / (k + F.col("rank"))
    return ranked(hits).groupBy("query_id", "chunk_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("routes"))


def kinds(column: Column, among: list[str] | None = None) -> Column:
    return F.count_distinct(F.when(column.isin(among), column) if among else column)


def route_case_ranking(hits: DataFrame, chunk_top_k: int = 3) -> DataFrame:
    """Score of each case within each route: best weighted chunk and three capped bonuses."""
    w = Window.partitionBy("query_id", "route", "doc_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    rows = hits.withColumn("_n", F.row_number().over(w))
    top = F.col("_n") <= chunk_top_k
    section = F.col("section_type")
    out = rows.groupBy("query_id", "route", "weight", "doc_id").agg(
        F.max(F.when(top, F.col("score") * section_weight(section))).alias("best"),
        kinds(section, KEY_SECTIONS).alias("key_kinds"),
        F.count_distinct(F.when(top & section.isin(FOCUS_SECTIONS), section)).alias("focus_kinds"),
        F.count("*").alias("hit_count"),
    )
    score = F.col("best") + F.least(F.lit(0.20), 0.05 * F.col("key_kinds")) + F.least(F.lit(0.10), 0.05 * F.col("focus_kinds")) + F.least(F.lit(0.035), 0.007 * (F.col("hit_count") - 1))
    out = out.withColumn("route_score", F.round(score + NUDGE, 6))
    by = Window.partitionBy("query_id", "route").orderBy(F.desc("route_score"), F.asc("doc_id"))
    return out.withColumn("route_rank", F.row_number().over(by))


def case_bonus(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, route_count, chunk_count, bonus): what a case gets besides its ranks, whatever the routes' weights."""
    section = F.col("section_type")
    seen = hits.groupBy("query_id", "doc_id").agg(
        kinds(section, KEY_SECTIONS).alias("key_kinds"),
        kinds(section, FOCUS_SECTIONS).alias("focus_kinds"),
        F.count_distinct("chunk_id").alias("chunk_count"),
        F.count_distinct(F.substring_index("route", "_", 1)).alias("type_count"),
        F.count_distinct("route").alias("route_count"),
    )
    bonus = (
        F.least(F.lit(0.18), 0.055 * F.col("key_kinds"))
        + F.least(F.lit(0.10), 0.05 * F.col("focus_kinds"))
        + F.when(F.col("type_count") >= 2, 0.05).otherwise(0.0)
        + F.least(F.lit(0.10), 0.015 * (F.col("route_count") - 1))
        + F.least(F.lit(0.035), 0.006 * (F.col("chunk_count") - 1))
    )
    return seen.select("query_id", "doc_id", "route_count", "chunk_count", bonus.alias("bonus"))


def case_rrf(hits: DataFrame, chunk_top_k: int = 3, k: int = RRF_K) -> DataFrame:
    """Case scores over all routes: reciprocal ranks of the route rankings and five bonuses."""
    fused = route_case_ranking(hits, chunk_top_k).groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") / (k + F.col("route_rank"))).alias("rrf"))
    out = fused.join(case_bonus(hits), ["query_id", "doc_id"]).withColumn("case_score", F.round(F.col("rrf") + F.col("bonus") + NUDGE, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("case_score"), F.asc("doc_id"))
    return out.select("query_id", "doc_id", "case_score", "route_count", "chunk_count", F.row_number().over(w).alias("case_rank"))


def merged_chunks(hits: DataFrame) -> DataFrame:
    """One row per case and chunk: best score, sources, and each source's raw score."""
    return hits.groupBy("query_id", "doc_id", "chunk_id", "section_type").agg(
        F.max("score").alias("score"), F.array_sort(F.collect_set("route")).alias("sources"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", "score")))).alias("raw_scores")
    )


def case_aggregate(hits: DataFrame, chunk_top_k: int = 3) -> DataFrame:
    """The other case score: 0.55 best + 0.35 top three, and five capped bonuses."""
    rows = merged_chunks(hits)
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("value"), F.asc("chunk_id"))
    rows = rows.withColumn("value", F.round(F.col("score") * section_weight(F.col("section_type")) + NUDGE, 6)).withColumn("_n", F.row_number().over(w))
    top, section = F.col("_n") <= chunk_top_k, F.col("section_type")
    routes = hits.groupBy("query_id", "doc_id").agg(F.count_distinct("route").alias("sources"))
    out = rows.groupBy("query_id", "doc_id").agg(
        F.max("value").alias("best"), F.sum(F.when(F.col("_n") <= 3, F.col("value"))).alias("top3"), kinds(section, KEY_SECTIONS).alias("key"),
        F.count_distinct(F.when(top & section.isin(FOCUS_SECTIONS), section)).alias("focus"), F.count("*").alias("n"), F.count_if(top & (F.size("sources") >= 2)).alias("multi"),
    ).join(routes, ["query_id", "doc_id"])
    score = (
        0.55 * F.col("best") + 0.35 * F.col("top3")
        + F.least(F.lit(0.18), 0.055 * F.col("key")) + F.least(F.lit(0.08), 0.04 * F.col("focus")) + F.least(F.lit(0.08), 0.018 * (F.col("n") - 1))
        + F.least(F.lit(0.12), 0.018 * (F.col("sources") - 1)) + F.least(F.lit(0.08), 0.02 * F.col("multi"))
    )
    return out.select("query_id", "doc_id", F.round(score + NUDGE, 6).alias("case_score"))


def top_chunks(hits: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return merged_chunks(hits).withColumn("chunk_rank", F.row_number().over(w)).where(F.col("chunk_rank") <= n)


def section_place(section: Column, order: list[str]) -> Column:
    """Position in a fixed order; unknown sections come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in order]), section)
    return F.when(at > 0, at - 1).otherwise(len(order))


def rerank_chunks(hits: DataFrame, n: int = 8) -> DataFrame:
    """Chunks for the reranker: key sections first, then section order, then score."""
    section = F.col("section_type")
    w = Window.partitionBy("query_id", "doc_id").orderBy((~section.isin(KEY_SECTIONS)).cast("int"), section_place(section, RERANK_ORDER), F.desc("score"), F.asc("chunk_id"))
    return merged_chunks(hits).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def pick_best(chunks: DataFrame) -> DataFrame:
    """Add ``pick`` to a case's chunks: the best of each section in the fixed order, then the others: legal sections first, then by score, then by place."""
    section, place = F.col("section_type"), section_place(F.col("section_type"), RERANK_ORDER)
    own = Window.partitionBy("query_id", "doc_id", "section_type").orderBy(F.desc("score"), F.asc("chunk_id"))
    first = (F.col("_own") == 1) & section.isin(RERANK_ORDER)
    turn = F.when(first, place).otherwise((~section.isin(LEGAL_SECTIONS)).cast("int"))
    w = Window.partitionBy("query_id", "doc_id").orderBy((~first).cast("int"), turn, F.when(first, 0.0).otherwise(-F.col("score")), place, F.asc("chunk_id"))
    rows = chunks.withColumn("_own", F.row_number().over(own))
    return rows.withColumn("pick", F.row_number().over(w)).drop("_own")


def best_per_section(hits: DataFrame, n: int = 6) -> DataFrame:
    """The first n picks of every case."""
    return pick_best(merged_chunks(hits)).where(F.col("pick") <= n)
