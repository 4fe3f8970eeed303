"""Queries against their SQL in DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from docuseam.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["compact_text", "clean_text", "clause_split", "term_hits", "case_projection", "section_unpivot", "chunk_links", "line_numbers", "context_window", "anchor_slice", "corpus_stats", "bm25_topk", "knn_cosine_topk", "case_rrf", "best_chunk_per_section", "rank_safe", "metrics_by_group", "diagnosis_summary", "scorer_no_anchor", "judge_agreement", "cache_upsert", "set_ops", "sessions", "route_expansion", "passage_build", "guardrail_penalty", "profile_bonus", "marker_split", "chunk_fixed_split", "section_extract", "preview_sections", "rewrite_parse", "answer_object", "statute_flatten", "diagnosis_export"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, sf, duck, name):
    rows = catalogue.QUERIES[name](spark, sf)
    names = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in rows.collect()), key=repr)
    want = duck.sql(catalogue.ORACLES[name])
    at = [want.columns.index(c) for c in names]
    assert sorted(want.columns) == names
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES


def test_hybrid_search_ranks_are_dense(spark, sf):
    rows = catalogue.hybrid_search(spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r.case_rank)
    assert by and all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())
