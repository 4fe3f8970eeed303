"""Exports of a build in one pass, stored upserts, scorers that are plugged in."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docuseam.config import SearchConfig
from docuseam.operators import rerank, upkeep
from docuseam.plans import build_catalogue, index_build, search_catalogue
from docuseam.plans import search as plan
from docuseam.sources import export

CONFIG = SearchConfig(top_k=10, candidate_size=20, rerank=True, rerank_top_n=15)


def test_export_writes_all_parts_and_guards_them(spark, sf, tmp_path):
    rows, out = build_catalogue.nested_documents(spark, sf), str(tmp_path / "out")
    stats = export.export_build(rows, out, source_file="docs")
    chunks = index_build.chunk_rows(index_build.case_rows(rows, "docs"))
    want = {r.section_type: r["count"] for r in chunks.groupBy("section_type").count().collect()}
    assert stats["cases"] == rows.count() and stats["chunks"] == sum(want.values())
    assert {k: v for k, v in stats["section_counts"].items() if v} == want
    read = spark.read.json(f"{out}/chunks")
    names = [c for c in chunks.columns if c in read.columns]
    assert sorted(r.chunk_id for r in read.collect()) == sorted(r.chunk_id for r in chunks.collect()) and len(names) >= 33
    assert json.loads(spark.read.text(f"{out}/stats").first()[0]) == stats
    assert [f["name"] for f in json.loads(spark.read.text(f"{out}/mapping").first()[0])["chunks"]["fields"]] == chunks.columns
    sample = spark.read.json(f"{out}/sample").collect()
    assert len(sample) == 12 and all(len(r.chunk_text) <= 360 for r in sample)
    with pytest.raises(FileExistsError):
        export.export_build(rows, out)
    assert export.export_build(rows.limit(0), out, overwrite=True)["chunks"] == 0


def test_upsert_writes_touched_folders_only(spark, tmp_path):
    at, schema = str(tmp_path / "table"), "id long, at int, v string"
    table = lambda: {r.id: (r.at, r.v) for r in spark.read.schema(f"{schema}, folder int").parquet(at).collect()}
    files = lambda: {r[0] for r in spark.read.parquet(at).select(F.input_file_name()).distinct().collect()}
    rows = spark.createDataFrame([(i, 1, "a") for i in range(200)] + [(None, 1, "n")], schema)
    assert upkeep.upsert_stored(rows, at, "id", "at") == 32
    before = files()
    new = spark.createDataFrame([(7, 2, "b"), (7, 3, "c"), (8, 0, "old"), (9, 1, "tie"), (1000, 1, "new")], schema)
    for _ in range(2):
        assert upkeep.upsert_stored(new, at, "id", "at") <= 4
        got = table()
        assert len(got) == 202 and got[7] == (3, "c") and got[8] == (1, "a") and got[9] == (1, "tie") and got[1000] == (1, "new") and got[None] == (1, "n")
    assert len(before - files()) <= 4
    assert upkeep.upsert_stored(new.limit(0), at, "id", "at") == 0


def some(spark):
    rows = [(q, d, f"query {q}", "p" * (10 * d)) for q in (1, 2) for d in range(1, 8)] + [(3, 1, None, None)]
    return spark.createDataFrame(rows, "query_id long, doc_id long, asked string, passage string")


def test_scores_come_in_batches_and_failures_stay_apart(spark):
    def make():
        def score(query, passages):
            assert sum(map(len, passages)) <= 150
            if query == "query 2" and len(passages[0]) > 40:
                raise TimeoutError
            return [len(p) / 10 for p in passages] if query != "" else [float("nan")]

        return score

    got = {(r.query_id, r.doc_id): (r.model_score, r.failed) for r in rerank.model_scores(some(spark), make, 100).collect()}
    assert all(got[1, d] == (d, False) for d in range(1, 8))
    assert got[2, 1] == (1, False) and got[2, 7] == (None, True) and got[3, 1] == (None, True)

    def broken():
        raise KeyError

    assert all(r.failed and r.model_score is None for r in rerank.model_scores(some(spark), broken).collect())
    short = lambda: lambda query, passages: [0.5]
    assert {r.failed for r in rerank.model_scores(some(spark).where("query_id = 1"), short).collect()} == {True}


def test_a_failing_scorer_leaves_the_order(spark, sf):
    def ranked(config, scorer=None):
        c = search_catalogue
        rows = plan.search(c._query_vectors(spark, sf), c._chunks(spark, sf), c._t(spark, sf, "embeddings"), c.corpus.case_docs(c._t(spark, sf, "documents")), config, scorer=scorer)
        return sorted((r.query_id, r.case_rank, r.doc_id) for r in rows.collect())

    def broken():
        raise ConnectionError

    assert ranked(CONFIG, broken) == ranked(SearchConfig(top_k=10, candidate_size=20))
    assert ranked(CONFIG, search_catalogue._Overlap) == ranked(CONFIG)


def test_search_with_text_ids(spark, sf):
    """Cases with ids of text, a hash sign in them, are found as those with numbers are, but for ties, which go by id."""
    from docuseam.operators import corpus

    c, text = search_catalogue, lambda name: F.format_string("case#%06d", F.col(name))
    docs, vectors = c._t(spark, sf, "documents"), c._t(spark, sf, "embeddings").where("vec_id IS NOT NULL")
    told = docs.withColumn("doc_id", text("doc_id"))
    chunks = corpus.chunks(told)
    assert chunks.first().chunk_id.startswith("case#0")
    rows = plan.search(c._query_vectors(spark, sf), chunks, vectors.withColumn("vec_id", text("vec_id")), corpus.case_docs(told), CONFIG)
    want = plan.search(c._query_vectors(spark, sf), c._chunks(spark, sf), vectors, corpus.case_docs(docs), CONFIG)
    got, pairs = rows.collect(), {(r.query_id, f"case#{r.doc_id:06d}") for r in want.collect()}
    assert len(got) == len(pairs) and all(r.doc_id.startswith("case#") and r.case_name for r in got)
    assert len({(r.query_id, r.doc_id) for r in got} & pairs) >= 0.9 * len(pairs)


def test_load_of_a_build(spark, sf, tmp_path):
    build, out = str(tmp_path / "build"), str(tmp_path / "tables")
    stats = export.export_build(build_catalogue.nested_documents(spark, sf).limit(20), build, source_file="docs")
    told = export.load_build(spark, build, out, dry_run=True)
    assert (told["case_count"], told["chunk_count"]) == (20, stats["chunks"]) and not os.path.exists(out)
    export.load_build(spark, build, out, "1")
    with pytest.raises(FileExistsError):
        export.load_build(spark, build, out, "2")
    for kw in ({"skip_create": True}, {"skip_create": True}, {"recreate": True}):
        export.load_build(spark, build, out, "2", **kw)
        chunks = spark.read.parquet(f"{out}/chunks")
        assert chunks.count() == chunks.select("chunk_id").distinct().count() == stats["chunks"]
        assert [r.batch for r in chunks.select("batch").distinct().collect()] == ["2"]
    plain = spark.read.parquet(f"{out}/cases").drop("batch", "folder")
    given = spark.read.schema(plain.schema).json(f"{build}/cases")
    assert plain.exceptAll(given).count() == given.exceptAll(plain).count() == 0
    assert export.load_build(spark, str(tmp_path / "none"), out, dry_run=True)["case_count"] == 0


def test_methods_and_raw_routes(spark, sf):
    from docuseam.config import chosen_methods

    assert chosen_methods() == ["hybrid", "hybrid_rerank"] and chosen_methods("hybrid") == ["hybrid"]
    assert chosen_methods(["x", "hybrid_rerank", "hybrid", "hybrid_rerank"]) == ["hybrid_rerank", "hybrid"] and chosen_methods(["x"]) == ["hybrid_rerank"]
    queries = search_catalogue._fired_queries(spark, sf).limit(30)
    every = plan.query_routes(queries, SearchConfig())
    raw = plan.query_routes(queries, SearchConfig(profiles=False))
    assert {r.route for r in raw.select("route").distinct().collect()} == set(plan.RAW_ROUTES)
    assert every.select("route").distinct().count() > 2 and raw.count() == 2 * queries.count()
