"""Weight search, profiles that fire, guardrails and cached rewrites against their SQL; the stored index and its plan."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docuseam.operators import evaluation, fusion, lexical, stored_index, tuning
from docuseam.plans import catalogue, search_catalogue
from test_catalogue import TABLES, plain


@pytest.mark.parametrize("name", [*search_catalogue.ORACLES, "bm25_stored", "stored_term_counts"])
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    make = search_catalogue.QUERIES.get(name) or catalogue.QUERIES[name]
    rows = make(spark, sf)
    names = sorted(rows.columns)
    want = c.sql(search_catalogue.ORACLES.get(name) or catalogue.ORACLES[name])
    at = [want.columns.index(n) for n in names]
    assert sorted(want.columns) == names
    assert sorted((tuple(plain(r[n]) for n in names) for r in rows.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_route_and_a_guardrail_fire(spark, sf):
    assert search_catalogue.fired_hits(spark, sf).select("route").distinct().count() == 12
    got = search_catalogue.fired_guardrails(spark, sf).agg(F.count_if(F.col("penalty") > 0), F.count_if(F.col("bonus") > 0)).first()
    assert all(got)


def test_grid_metrics_are_those_of_each_set_alone(spark):
    """Matrix scores against fusion and evaluation of one set after the other, with text ids, ties and a route outside the grid."""
    rng = np.random.default_rng(3)
    hits = [(q, r, w, f"d{d}#{s}#00#000", f"d{d}", s, float(np.round(rng.random(), 2))) for q in (1, 2, 3) for r, w in (("bm25_raw", 1.0), ("vector_raw", 0.8), ("own_route", 0.5)) for d in rng.choice(40, 25, False) for s in ("facts", "fine_tags")]
    hits = spark.createDataFrame(hits, "query_id long, route string, weight double, chunk_id string, doc_id string, section_type string, score double")
    qrels = spark.createDataFrame([(q, f"d{d}", int(g), float(g)) for q in (1, 2) for d, g in zip(range(30), rng.integers(0, 4, 30), strict=True)], "query_id long, doc_id string, grade int, gain double")
    sets = spark.createDataFrame([(i, "s", r, w) for i, ws in enumerate(((1.0, 0.8), (0.2, 2.0), (3.0, 0.0))) for r, w in zip(("bm25_raw", "vector_raw"), ws, strict=True)], "set_id int, name string, route string, weight double")
    got = {(r.set_id, r.query_id): tuple(r)[2:] for r in tuning.grid_metrics(hits, qrels, sets, top_k=20).collect()}
    for i, (a, b) in enumerate(((1.0, 0.8), (0.2, 2.0), (3.0, 0.0))):
        weighed = hits.withColumn("weight", F.when(F.col("route") == "bm25_raw", a).when(F.col("route") == "vector_raw", b).otherwise(F.col("weight")))
        run = fusion.case_rrf(weighed).where("case_rank <= 20").select("query_id", "doc_id", F.col("case_rank").alias("rank"))
        for r in evaluation.query_metrics(run, qrels).collect():
            assert got[i, r.query_id] == pytest.approx((r.positive_count, r.expected_ndcg_20, r.ndcg_10, r.mrr, r.recall_20), abs=2e-6, nan_ok=True) or (r.query_id == 3 and got[i, 3] == (0, None, None, None, None))
    runs = tuning.search_weights(hits, qrels, sets, 2, 2).collect()
    assert len(runs) == 2 and all(r.queries == 2 for r in runs)


CHUNKS = "chunk_id string, chunk_text string, section_type string"


def test_stored_index_appends_replaces_and_prunes(spark, tmp_path):
    at = str(tmp_path / "index")
    first = spark.createDataFrame([("a", "alpha beta beta", "x"), ("b", "beta", "y"), ("c", None, "x"), ("d", " .. ", None)], CHUNKS)
    second = spark.createDataFrame([("e", "alpha gamma", None), ("f", "delta alpha", "y")], CHUNKS)
    for name, part in (("one", first), ("two", first), ("two", second)):
        stored_index.append_postings(part, at, name)
    index = stored_index.read_postings(spark, at)
    assert stored_index.index_size(index) == (4, 8)
    counts = {r.term: (r.df, r.cf) for r in stored_index.term_counts(index).collect()}
    assert counts == {"alpha": (3, 3), "beta": (2, 3), "gamma": (1, 1), "delta": (1, 1)}
    queries = spark.createDataFrame([(1, "alpha, unheard"), (2, "beta gamma"), (3, ""), (4, None)], "query_id long, query_text string")
    whole = first.unionByName(second)
    key = lambda rows: sorted(map(tuple, rows.collect()))
    assert key(lexical.top_k(stored_index.bm25_stored(index, queries, 2), 2)) == key(lexical.top_k(lexical.bm25_top(queries, whole, 2), 2))
    grouped = lambda rows: key(lexical.top_k(rows.where("section_type IS NOT NULL"), 1, ("query_id", "section_type")).select("query_id", "section_type", "chunk_id", "score"))
    assert grouped(stored_index.bm25_stored(index, queries, 1, group="section_type")) == grouped(lexical.bm25_top(queries, whole, 1, group="section_type"))
    rows = stored_index.term_rows(index, spark.createDataFrame([("alpha", 0)], "term string, place int"), ["alpha"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(folder" in scan and "PushedFilters: [IsNotNull(term)" in scan and "EqualTo(term,alpha)" in scan
    folder = rows.select(F.input_file_name()).distinct().collect()
    assert len({r[0].split("folder=")[1].split("/")[0] for r in folder}) == 1


def test_stored_index_of_many_blocks_and_frequent_terms(spark, tmp_path, monkeypatch):
    """Small blocks of rows, queries and terms give what the scan of the texts gives."""
    for name, value in (("BLOCK_ROWS", 7), ("BLOCK_QUERIES", 5), ("FREQUENT", 6), ("GATHERED", 3), ("NAMED_TERMS", 4)):
        monkeypatch.setattr(stored_index, name, value)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = spark.createDataFrame([(f"c{i}", " ".join(rng.choice(words, rng.integers(1, 30), p=np.arange(60, 0, -1) / 1830)), "xyz"[i % 3]) for i in range(150)], CHUNKS)
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words, 6))) for i in range(17)], "query_id long, query_text string")
    at = str(tmp_path / "index")
    stored_index.append_postings(rows.repartition(3), at, "all")
    for group, by in ((None, ("query_id",)), ("section_type", ("query_id", "section_type"))):
        got, want = (sorted(map(tuple, lexical.top_k(r, 4, by).collect()), key=repr) for r in (stored_index.bm25_stored(stored_index.read_postings(spark, at), queries, 4, group=group), lexical.bm25_top(queries, rows, 4, group=group)))
        assert len(got) == len(want) and [g[:-2] for g in got] == [w[:-2] for w in want]
        assert np.allclose([g[-2] for g in got], [w[-2] for w in want], atol=2e-6)


def test_postings_read_no_word_twice(spark, sf, tmp_path):
    """Texts reach the tasks as they are: words are found there, once; chunks without words leave no trace."""
    rows = spark.createDataFrame([("a", "Übermaß x x"), ("b", " … "), ("c", None), ("d", "x")], "chunk_id string, chunk_text string").coalesce(1)
    seen = []
    whole = type(rows).mapInArrow
    try:
        type(rows).mapInArrow = lambda self, *a, **k: (seen.append(self._jdf.queryExecution().optimizedPlan().toString()), whole(self, *a, **k))[1]
        stored_index.append_postings(rows, str(tmp_path / "at"), "one", group=None)
    finally:
        type(rows).mapInArrow = whole
    assert len(seen) == 1 and "regexp_extract_all" not in seen[0]
    index = stored_index.read_postings(spark, str(tmp_path / "at"))
    assert stored_index.index_size(index) == (2, 4)
    assert sorted(map(tuple, stored_index.term_counts(index).collect())) == [("x", 2, 3), ("übermaß", 1, 1)]
