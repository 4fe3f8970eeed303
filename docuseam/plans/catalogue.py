"""Registered queries over the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..constants import CASE_KEY_SECTIONS, DISPUTE_TERMS, FOCUS_SECTIONS, GROUP_ORDER, KEY_SECTIONS, LEGAL_SECTIONS, OTHER_BUDGET, PASSAGE_LIMIT, RERANK_BUDGETS, RERANK_GROUPS, RERANK_ORDER, ROUTES, SECTION_ORDER, SECTION_TITLES, SECTION_WEIGHTS
from ..functions import text as tx
from ..operators import corpus, details, evaluation, fusion, lexical, profile, rerank, results, stored_index, tuning, upkeep, vector
from ..session import drop_folder, kept, shared_folder
from ..streaming import incremental
from . import search as plan

SIZE = 30  # candidates of a route
ANCHORS = [("process", "P", ["the ", "der "]), ("claims", "C", ["que "]), ("facts", "F", ["tion", "ung"])]
MARKS = ["the ", "der ", "que "]
REQUIRED = [{"name": "one", "query_any": ["the", "der"], "doc_any": ["thth"], "penalty": 0.18}, {"name": "two", "query_all": ["e"], "query_any": ["que"], "doc_any": ["ción"], "penalty": 0.1}]
CONFLICTS = [{"name": "three", "query_any": ["tion"], "doc_any": ["ung"], "absent": ["the "], "penalty": 0.14}]
TERMS = ["the", "and", "tion", "que", "ung", "ción"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chunks(spark, sf):
    return corpus.chunks(_t(spark, sf, "documents"))


def _queries(spark, sf):
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _query_vectors(spark, sf):
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))
    return _queries(spark, sf).join(vectors, "query_id", "left")


def _hits(spark, sf):
    """Hits of all routes, searched once: what reads them several times reads their rows, at most so many as routes and candidates."""
    return kept(plan.route_hits(_query_vectors(spark, sf), _chunks(spark, sf), _t(spark, sf, "embeddings"), SearchConfig(candidate_size=SIZE)))


# --- evaluation fixtures: neighbours by cosine as the run, labels as grades ---


def _run(spark, sf, k=100):
    return vector.knn(_query_vectors(spark, sf).where("embedding IS NOT NULL").select("query_id", "embedding"), _t(spark, sf, "embeddings"), k).select("query_id", F.col("vec_id").alias("doc_id"), "rank")


def _run_far(spark, sf, k=100):
    """Another method for comparisons: the same neighbours from the farthest."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rank"))
    return _run(spark, sf, k).withColumn("rank", F.row_number().over(w))


def _qrels(spark, sf):
    q = _query_vectors(spark, sf).where("embedding IS NOT NULL").select("query_id", "query_label")
    near = q.select("query_id", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"), "query_label").withColumn("label", (F.col("query_label") + F.col("d")).cast("int"))
    rows = near.join(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "label")
    grade = F.when(F.col("d") == 0, 2).otherwise(1)
    return rows.select("query_id", "doc_id", grade.alias("grade"), grade.cast("double").alias("gain"))


def _metrics(spark, sf, run=_run):
    rows = evaluation.query_metrics(run(spark, sf), _qrels(spark, sf))
    return rows.withColumn("difficulty", F.element_at(F.array(F.lit("hard"), F.lit("medium"), F.lit("easy")), (F.col("query_id") % 3 + 1).cast("int"))).withColumn("trap", F.col("query_id") % 2 == 0)


def _cases(spark, sf):
    return fusion.case_rrf(_hits(spark, sf))


# --- queries --------------------------------------------------------------


def compact_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.compact(F.col("text"), 120).alias("brief"), F.length(tx.compact(F.col("text"))).alias("n"))


def clean_text(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", tx.clean_lines(F.col("text")).alias("clean"))


def clause_split(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(tx.clauses(F.col("text"))).alias("pos", "clause"))


def term_hits(spark, sf):
    found = tx.find_terms(F.lower("text"), TERMS, 4)
    return _t(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("terms"), tx.any_term(F.lower("text"), TERMS).alias("any_term"))


def query_profile(spark, sf):
    rows = profile.add_profile(_queries(spark, sf))
    return rows.select("query_id", "profile.raw_query", F.array_join("profile.focus", "|").alias("focus"), F.array_join("profile.requests", "|").alias("requests"), "profile.tendency")


def route_expansion(spark, sf):
    return profile.routes(profile.add_profile(_queries(spark, sf)))


def case_projection(spark, sf):
    return corpus.case_docs(_t(spark, sf, "documents")).drop("full_text")


def full_text_assembly(spark, sf):
    return corpus.full_text(_t(spark, sf, "documents")).select("doc_id", F.length("full_text").alias("n"), F.sha2(F.col("full_text").cast("binary"), 256).alias("hash"))


def section_unpivot(spark, sf):
    return _chunks(spark, sf).select("doc_id", "section_index", "section_type", "chunk_id", F.length("chunk_text").alias("chunk_char_len"))


def chunk_ordinals(spark, sf):
    return corpus.with_ordinals(_chunks(spark, sf)).select("chunk_id", "chunk_index_in_case")


def chunk_links(spark, sf):
    return corpus.with_links(_chunks(spark, sf)).select("chunk_id", "prev_chunk_id", "next_chunk_id")


def chunk_hashes(spark, sf):
    return _chunks(spark, sf).select("chunk_id", F.sha2(F.col("chunk_text").cast("binary"), 256).alias("chunk_hash"))


def embedding_text(spark, sf):
    return corpus.embedding_text(_chunks(spark, sf)).select("chunk_id", F.sha2(F.col("embedding_text").cast("binary"), 256).alias("hash"))


def chunk_offsets(spark, sf):
    return corpus.locate_chunks(_chunks(spark, sf), _t(spark, sf, "documents"), "text")


def section_counts(spark, sf):
    return corpus.section_counts(_chunks(spark, sf))


def line_numbers(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.line_number(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("line"))


def context_window(spark, sf):
    at = F.instr("text", "tion") - 1
    return _t(spark, sf, "documents").select("doc_id", tx.context_window(F.col("text"), F.when(at >= 0, at), F.when(at >= 0, at + 4), 20).alias("context"))


def anchor_slice(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha2(tx.anchor_slice(F.col("text"), ["the ", "der ", "de "], [". ", "!!"]).cast("binary"), 256).alias("hash"))


def corpus_stats(spark, sf):
    return lexical.term_totals(_chunks(spark, sf))


def bm25_topk(spark, sf):
    return lexical.top_k(lexical.bm25_top(_queries(spark, sf), _chunks(spark, sf), 10), 10)


def bm25_stored(spark, sf):
    """The same search from stored postings, appended in two batches, one of them twice."""
    at, chunks = shared_folder(spark, "postings"), _chunks(spark, sf)
    half = F.col("doc_id") % 2 == 0
    for name, part in (("even", half), ("odd", ~half), ("even", half)):
        stored_index.append_postings(chunks.where(part), at, name)
    found = kept(lexical.top_k(stored_index.bm25_stored(stored_index.read_postings(spark, at), _queries(spark, sf), 10), 10))
    drop_folder(spark, at)
    return found


def stored_term_counts(spark, sf):
    at = shared_folder(spark, "postings")
    stored_index.append_postings(_chunks(spark, sf), at, "all")
    return stored_index.term_counts(stored_index.read_postings(spark, at))


def bm25_multifield(spark, sf):
    docs = _t(spark, sf, "documents").withColumn("title", F.concat_ws(" ", "source", "lang"))
    queries = _queries(spark, sf).withColumn("query_text", F.concat_ws(" ", "query_text", F.lit("en src1")))
    return lexical.top_k(lexical.best_field(queries, docs, {"text": 3.0, "title": 1.4}, 10, "doc_id"), 10, key="doc_id")


def bm25_filtered(spark, sf):
    rows = _chunks(spark, sf).where(lexical.exact_or_phrase(F.col("lang"), "en") & (F.col("section_type") == "fine_rule"))
    return lexical.top_k(lexical.bm25_top(_queries(spark, sf), rows, 10), 10)


def date_range_filter(spark, sf):
    return _t(spark, sf, "orders").where(lexical.date_range(F.col("o_orderdate"), "1995-01-01", "1996-06-30")).select("o_orderkey", "o_custkey", "o_totalprice")


def knn_cosine_topk(spark, sf):
    q = _query_vectors(spark, sf).where("embedding IS NOT NULL").select("query_id", "embedding")
    return vector.knn(q, _t(spark, sf, "embeddings"), 10)


def knn_filtered(spark, sf):
    q = _query_vectors(spark, sf).where("embedding IS NOT NULL").select("query_id", "embedding")
    return vector.knn(q, _t(spark, sf, "embeddings").where("label < 5"), 10)


def route_hits(spark, sf):
    return fusion.ranked(_hits(spark, sf))


def chunk_rrf(spark, sf):
    return fusion.chunk_rrf(_hits(spark, sf))


def route_case_ranking(spark, sf):
    return fusion.route_case_ranking(_hits(spark, sf)).select("query_id", "route", "doc_id", "hit_count", "route_score", "route_rank")


def case_rrf(spark, sf):
    return _cases(spark, sf)


def case_aggregate_alt(spark, sf):
    return fusion.case_aggregate(_hits(spark, sf))


def chunk_merge(spark, sf):
    return fusion.merged_chunks(_hits(spark, sf)).select("query_id", "chunk_id", "score", F.array_join("sources", ",").alias("sources"), F.size("raw_scores").alias("n_raw"))


def top_chunks_per_case(spark, sf):
    return fusion.top_chunks(_hits(spark, sf)).select("query_id", "doc_id", "chunk_id", "chunk_rank")


def rerank_chunk_pick(spark, sf):
    return fusion.rerank_chunks(_hits(spark, sf)).select("query_id", "doc_id", "chunk_id", "pick")


def best_chunk_per_section(spark, sf):
    return fusion.best_per_section(_hits(spark, sf)).select("query_id", "doc_id", "chunk_id", "pick")


def minmax_normalize(spark, sf):
    w = Window.partitionBy("query_id")
    return _cases(spark, sf).select("query_id", "doc_id", F.round(rerank.minmax(F.col("case_score"), w), 6).alias("normal"))


def structure_adjustment(spark, sf):
    rows = _hits(spark, sf).groupBy("query_id", "doc_id").agg(F.collect_set("section_type").alias("sections"))
    return rows.select("query_id", "doc_id", F.round(rerank.structure_adjustment(F.col("sections")), 6).alias("adjustment"))


def _fused(spark, sf):
    hits = _hits(spark, sf)
    sections = hits.groupBy("query_id", "doc_id").agg(F.collect_set("section_type").alias("sections"))
    rows = fusion.case_rrf(hits).join(sections, ["query_id", "doc_id"])
    rows = rows.withColumn("model_score", F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 11) / 10.0)).withColumn("penalty", F.lit(0.0)).withColumn("bonus", F.lit(0.0)).withColumn("flagged", F.lit(False))
    return rerank.fuse(rows, 20)


def rerank_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "doc_id", "case_rank", "fused_score", "rerank_rank")


def rank_safe(spark, sf):
    return rerank.rank_safe(_fused(spark, sf), 5).select("query_id", "doc_id", "safe_score", "safe_rank")


def result_entry(spark, sf):
    return results.result_entries(_cases(spark, sf), corpus.case_docs(_t(spark, sf, "documents")), 10)


def public_result(spark, sf):
    return results.public_results(_cases(spark, sf), _qrels(spark, sf)).drop("case_score")


def hybrid_search(spark, sf):
    config = SearchConfig(top_k=10, candidate_size=SIZE, rerank=True, rerank_top_n=30)
    return plan.search(_query_vectors(spark, sf), _chunks(spark, sf), _t(spark, sf, "embeddings"), corpus.case_docs(_t(spark, sf, "documents")), config)


def passage_build(spark, sf):
    picked = fusion.best_per_section(_hits(spark, sf)).join(_chunks(spark, sf).select("chunk_id", "chunk_text"), "chunk_id", "left")
    return rerank.passages(picked, corpus.case_docs(_t(spark, sf, "documents")))


def guardrail_penalty(spark, sf):
    """Guardrails with factors of these texts' own words, each query against its cases' documents."""
    docs = _t(spark, sf, "documents").select("doc_id", F.col("text").alias("doc"))
    rows = _cases(spark, sf).join(docs, "doc_id").join(_queries(spark, sf), "query_id")
    g = rerank.guardrail(F.col("query_text"), F.col("doc"), REQUIRED, CONFLICTS)
    return rows.select("query_id", "doc_id", g.alias("g")).select("query_id", "doc_id", F.round("g.penalty", 6).alias("penalty"), F.round("g.bonus", 6).alias("bonus"), F.array_join("g.missing", ",").alias("missing"), F.array_join("g.conflicts", ",").alias("conflicts"))


def profile_bonus(spark, sf):
    """The bonus of every chunk under one profile of these texts' own words."""
    lists = {"reasons": ["fr", "tion."], "relations": ["the ", "der "], "requests": ["que "], "negatives": [], "statutes": ["la "]}
    made = F.struct(*[tx.strings(v).alias(k) for k, v in lists.items()])
    bonus = profile.profile_bonus(made, F.col("chunk_text"), F.col("lang"), F.col("section_type"), F.array(F.col("source")))
    return _chunks(spark, sf).select("chunk_id", F.round(bonus, 6).alias("bonus"))


def marker_split(spark, sf):
    parts = corpus.marker_parts(F.col("text"), f"(?=(?:{'|'.join(MARKS)}))")
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(parts).alias("pos", "unit"))


def chunk_fixed_split(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.lit("claims").alias("section_type"), F.col("text").alias("section_text"))
    return corpus.split_sections(rows).select("doc_id", F.col("chunk_index_in_section").alias("pos"), F.length("chunk_text").alias("n"), F.sha2(F.col("chunk_text").cast("binary"), 256).alias("hash"))


def advisor_fallback(spark, sf):
    return results.fallback_answers(result_entry(spark, sf))


def citations_valid(spark, sf):
    entries = _cases(spark, sf).where("case_rank <= 10")
    cited = entries.groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("cited"))
    cited = cited.withColumn("cited", F.concat("cited", F.transform("cited", lambda x: x + 1)))
    return results.valid_citations(cited, entries).select("query_id", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"))


def query_metrics(spark, sf):
    return evaluation.query_metrics(_run(spark, sf), _qrels(spark, sf))


def metrics_by_group(spark, sf):
    return evaluation.group_metrics(_metrics(spark, sf), ["difficulty", "trap"])


def diagnosis(spark, sf):
    return evaluation.diagnose(_metrics(spark, sf)).select("query_id", "label", "bucket")


def diagnosis_summary(spark, sf):
    return diagnosis(spark, sf).groupBy("bucket", "label").agg(F.count("*").alias("queries"))


def missed_positives(spark, sf):
    return evaluation.missed_positives(_run(spark, sf), _qrels(spark, sf))


def method_comparison(spark, sf):
    return evaluation.compare(query_metrics(spark, sf), evaluation.query_metrics(_run_far(spark, sf), _qrels(spark, sf)))


def scorer(spark, sf):
    return evaluation.score_run(_run(spark, sf), _qrels(spark, sf))


def scorer_no_anchor(spark, sf):
    anchors = _queries(spark, sf).select("query_id", F.col("query_id").alias("doc_id"))
    return evaluation.score_run(_run(spark, sf), _qrels(spark, sf), anchors)


def grade_counts(spark, sf):
    return evaluation.grade_counts(_qrels(spark, sf))


def judge_agreement(spark, sf):
    return evaluation.agreement(_t(spark, sf, "lineitem").select((F.col("l_quantity").cast("long") % 4).alias("a"), (F.col("l_linenumber").cast("long") % 4).alias("b")))


def dedup_first(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"))
    return evaluation.dedup_run(rows)


def grid_refuse(spark, sf):
    ranks = fusion.route_case_ranking(_hits(spark, sf)).select("query_id", "route", "weight", "doc_id", "route_rank")
    sets = tuning.weight_sets(spark, {"bm25_raw": (0.8, 1.2), "vector_raw": (0.6, 1.0)}, {})
    return tuning.refuse(ranks, sets).where("rank <= 5").select("set_id", "query_id", "doc_id", "score", "rank")


def best_runs(spark, sf):
    rows = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("set_id")).agg(F.count("*").alias("queries"), F.round(F.avg("o_totalprice"), 4).alias("objective"))
    return tuning.best_runs(rows, 5)


def resume_anti_join(spark, sf):
    return upkeep.pending(_t(spark, sf, "documents").select("doc_id", "lang"), _t(spark, sf, "labels"), "doc_id")


def cache_upsert(spark, sf):
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    late = F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    old, new = orders.where(~late), orders.where(late)
    return upkeep.upsert(old, new, "o_custkey", "at").select("o_custkey", "o_orderkey")


def point_lookup(spark, sf):
    return upkeep.lookup(_t(spark, sf, "documents"), _t(spark, sf, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang", "source")


def set_ops(spark, sf):
    a, b = _t(spark, sf, "orders").select(F.col("o_custkey").alias("k")), _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    named = lambda d, n: d.select(F.lit(n).alias("op"), "k")
    return named(a.intersect(b), "both").union(named(b.subtract(a), "only_b")).union(named(a.union(b).distinct(), "either"))


def json_fields(spark, sf):
    props = F.from_json("props", "map<string,string>")
    return _t(spark, sf, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(props)), ",").alias("keys"))


def stream_windows(spark, sf):
    return incremental.windowed_counts(_t(spark, sf, "events"))


def sessions(spark, sf):
    return incremental.sessions(_t(spark, sf, "events"))


def _sections(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.explode(details.text_sections(F.col("text"), ANCHORS)).alias("s"))
    return rows.select("doc_id", "s.*")


def section_extract(spark, sf):
    return _sections(spark, sf).select("doc_id", "place", "id", "title", F.length("content").alias("n"), F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


def preview_sections(spark, sf):
    return details.ranked_sections(_sections(spark, sf), ["facts", "claims", "judgment"]).select("doc_id", "at", "id", F.length("content").alias("n"))


def case_detail(spark, sf):
    cases = corpus.case_docs(_t(spark, sf, "documents")).drop("full_text").join(_t(spark, sf, "documents").select("doc_id", F.col("text").alias("full_text")), "doc_id")
    rows = details.case_detail(cases, _t(spark, sf, "labels").where("quality = 1"), ANCHORS, _chunks(spark, sf))
    return rows.select("doc_id", "case_name", "court_name", "reason", F.array_join(F.transform("sections", lambda x: x["id"]), ",").alias("section_ids"), "preview")


def first_sections(spark, sf):
    return details.first_sections(_chunks(spark, sf), ["claims", "facts", "reasoning", "judgment"]).select("doc_id", "section_type", "chunk_id")


def draft_cut(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha2(details.draft(F.col("text"), ["que ", "tion", "und "]).cast("binary"), 256).alias("hash"))


def rewrite_parse(spark, sf):
    """Rewrites as JSON: some of them broken, some of other types, the rest of turns of conversations."""
    good = F.to_json(F.struct(F.col("text").alias("expanded_query"), F.col("role").alias("legal_issue"), F.array("role", "text", "role").alias("focus_labels")))
    kind = F.col("turn") % 5
    content = F.when(kind == 0, F.concat(F.lit("no json: "), "text")).when(kind == 1, "[1, 2]").when(kind == 2, '{"expanded_query": 5, "focus_labels": "x"}').otherwise(good)
    rows = _t(spark, sf, "conversations").select("conv_id", "turn", details.parse_rewrite(content).alias("r")).select("conv_id", "turn", "r.*")
    return rows.withColumn("focus_labels", F.array_join("focus_labels", "|"))


def answer_object(spark, sf):
    """Objects in answers with fences and words around them."""
    turn = F.to_json(F.struct("role", "turn"))
    content = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), turn, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("so: "), turn, F.lit(" done"))).otherwise(F.lit("none"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", details.json_object(content).alias("object"))


def chunk_passage(spark, sf):
    none = F.array().cast("array<string>")
    said = details.chunk_passage(F.col("lang"), F.lit(""), F.col("section_type"), none, F.array("source", "lang"), F.col("chunk_text"))
    return _chunks(spark, sf).select("chunk_id", F.sha2(said.cast("binary"), 256).alias("hash"))


def core_issue(spark, sf):
    labels = F.array(F.lit(" "), F.col("source"), F.concat(F.lit(" "), "lang"))
    rows = _t(spark, sf, "documents")
    return rows.select("doc_id", details.core_issue(F.col("lang"), labels, F.lit(None).cast("array<string>")).alias("issue"), details.chunk_key(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("doc_id"), F.col("lang"), F.col("text")).alias("chunk_key"))


def statute_flatten(spark, sf):
    cited = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("article"), F.col("l_returnflag").alias("law"), F.col("l_linestatus").alias("original"))))
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(details.statute_lines(cited).alias("lines"))


def chunk_sample(spark, sf):
    return details.sample_chunks(_chunks(spark, sf))


def worst_deltas(spark, sf):
    return details.worst_deltas(method_comparison(spark, sf), ["d_mrr", "d_map", "d_recall_20"], "d_mrr").select("query_id", "d_mrr", "d_map")


def label_samples(spark, sf):
    return details.label_samples(_t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 50).alias("doc_id"), (F.col("l_quantity").cast("int") % 4).alias("grade")))


def diagnosis_export(spark, sf):
    positives = _qrels(spark, sf).where("grade >= 2")
    return details.diagnosis_export(evaluation.diagnose(_metrics(spark, sf)), positives, missed_positives(spark, sf), "near")


FLAGSHIP = "hybrid_search"
QUERIES = {f.__name__: f for f in (
    compact_text, clean_text, clause_split, term_hits, query_profile, route_expansion, case_projection, full_text_assembly, section_unpivot, chunk_ordinals, chunk_links, chunk_hashes, embedding_text,
    section_counts, chunk_offsets, line_numbers, context_window, anchor_slice, corpus_stats, bm25_topk, bm25_stored, stored_term_counts, bm25_multifield, bm25_filtered, date_range_filter, knn_cosine_topk, knn_filtered, route_hits, chunk_rrf,
    route_case_ranking, case_rrf, case_aggregate_alt, chunk_merge, top_chunks_per_case, rerank_chunk_pick, best_chunk_per_section, minmax_normalize, structure_adjustment, rerank_fusion, rank_safe,
    result_entry, public_result, hybrid_search, passage_build, guardrail_penalty, profile_bonus, marker_split, chunk_fixed_split, advisor_fallback, citations_valid, query_metrics, metrics_by_group, diagnosis, diagnosis_summary, missed_positives, method_comparison,
    scorer, scorer_no_anchor, grade_counts, judge_agreement, dedup_first, grid_refuse, best_runs, resume_anti_join, cache_upsert, point_lookup, set_ops, json_fields, stream_windows, sessions,
    section_extract, preview_sections, case_detail, first_sections, draft_cut, rewrite_parse, answer_object, chunk_passage, core_issue, statute_flatten, chunk_sample, worst_deltas, label_samples, diagnosis_export,
)}

# --- SQL --------------------------------------------------------------------

_WHITE = r"[\s\x{1c}-\x{1f}\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _compact(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WHITE}', ' ', 'g'))"


def _clean(x: str) -> str:
    lines = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '{lines}'), lambda l: regexp_replace(l, '^{_WHITE}|{_WHITE}$', '', 'g')), lambda l: l <> ''), chr(10))"


_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_ARRAY = "[" + ", ".join(f"'{s}'" for s in SECTION_ORDER) + "]"
_WEIGHT = "CASE section_type " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in SECTION_WEIGHTS.items()) + " ELSE 0.6 END"
_PLACE = "CASE section_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(RERANK_ORDER)) + f" ELSE {len(RERANK_ORDER)} END"

_CHUNKS = f"""
para AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS section_index FROM documents),
chunks AS (SELECT doc_id, lang, source, section_index::INT AS section_index, trim(line, ' ') AS chunk_text, {_ARRAY}[section_index % 10 + 1] AS section_type FROM para WHERE trim(line, ' ') <> ''),
ch AS (SELECT *, printf('%d#%s#%02d#%03d', doc_id, section_type, section_index, 0) AS chunk_id FROM chunks)"""
_TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def _bm25(rows: str, key: str, text: str, queries: str, name: str, boost: float = 1.0) -> str:
    tok, qtok = _TOK.format(x=text), _TOK.format(x="query_text")
    return f"""
{name}_tok AS (SELECT {key} AS id, unnest({tok}) AS term FROM {rows}),
{name}_tf AS (SELECT id, term, count(*) AS tf FROM {name}_tok GROUP BY ALL),
{name}_dl AS (SELECT id, count(*) AS dl FROM {name}_tok GROUP BY ALL),
{name}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_dl),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name}_q AS (SELECT DISTINCT query_id, unnest({qtok}) AS term FROM {queries}),
{name} AS (SELECT query_id, id, round({boost} * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_q JOIN {name}_df USING (term) JOIN {name}_tf USING (term) JOIN {name}_dl USING (id), {name}_st GROUP BY ALL)"""


_Q = "q AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"
_KNN = """
qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS e, label AS query_label FROM benchmark JOIN embeddings ON item_id = vec_id),
sim AS (SELECT query_id, vec_id, label, round((1 + list_cosine_similarity(e, embedding::DOUBLE[])) / 2, 6) AS score FROM qv, embeddings),
knn AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sim)"""
# these queries' profiles name no terms, so only the section decides the bonus; profile_bonus has the rest
_BONUS = "(CASE WHEN section_type IN ('fine_tags', 'focus_tags', 'defense', 'judgment') THEN 0.03 WHEN section_type IN ('fine_rule', 'focus_analysis') THEN 0.02 WHEN section_type IN ('reasoning', 'facts') THEN 0.04 WHEN section_type IN ('header', 'statutes') THEN -0.03 ELSE 0 END)::DOUBLE"
_SECTION_ROUTES = {s: (n, w) for n, _, w, s in ROUTES if s}
_HITS = f"""{_CHUNKS}, {_Q}, {_bm25("ch", "chunk_id", "chunk_text", "q", "bm")}, {_KNN},
sc AS (SELECT query_id, id AS chunk_id, score, split_part(id, '#', 1)::BIGINT AS doc_id, split_part(id, '#', 2) AS section_type FROM bm),
hits0 AS (
 SELECT query_id, 'bm25_raw' AS route, 1.0::DOUBLE AS weight, chunk_id, doc_id, section_type, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM sc) WHERE r <= {SIZE}
 UNION ALL SELECT query_id, 'bm25_' || section_type, (CASE section_type {" ".join(f"WHEN '{s}' THEN {w}" for s, (_, w) in _SECTION_ROUTES.items())} END)::DOUBLE, chunk_id, doc_id, section_type, score
   FROM (SELECT *, row_number() OVER (PARTITION BY query_id, section_type ORDER BY score DESC, chunk_id) AS r FROM sc WHERE section_type IN {_IN(_SECTION_ROUTES)}) WHERE r <= {SIZE}
 UNION ALL SELECT query_id, 'vector_raw', 0.8::DOUBLE, printf('%d#header#00#000', vec_id), vec_id, 'header', score FROM knn WHERE rank <= {SIZE}),
hits AS (SELECT * REPLACE (round(score + {_BONUS}, 6) AS score) FROM hits0),
merged AS (SELECT query_id, doc_id, chunk_id, section_type, max(score) AS score, list_sort(list(DISTINCT route)) AS sources FROM hits GROUP BY ALL)"""
_CASE = f"""{_HITS},
rc0 AS (SELECT *, row_number() OVER (PARTITION BY query_id, route, doc_id ORDER BY score DESC, chunk_id) AS n FROM hits),
rc1 AS (SELECT query_id, route, weight, doc_id, count(*) AS hit_count,
  round(max(score * {_WEIGHT}) FILTER (n <= 3) + least(0.20::DOUBLE, 0.05::DOUBLE * count(DISTINCT section_type) FILTER (section_type IN {_IN(KEY_SECTIONS)}))
   + least(0.10::DOUBLE, 0.05::DOUBLE * count(DISTINCT section_type) FILTER (n <= 3 AND section_type IN {_IN(FOCUS_SECTIONS)})) + least(0.035::DOUBLE, 0.007::DOUBLE * (count(*) - 1)) + 1e-9, 6) AS route_score FROM rc0 GROUP BY ALL),
rc AS (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY route_score DESC, doc_id) AS route_rank FROM rc1),
fused AS (SELECT query_id, doc_id, sum(weight / (10 + route_rank)) AS rrf, count(*) AS route_count FROM rc GROUP BY ALL),
seen AS (SELECT query_id, doc_id, count(DISTINCT section_type) FILTER (section_type IN {_IN(KEY_SECTIONS)}) AS kk, count(DISTINCT section_type) FILTER (section_type IN {_IN(FOCUS_SECTIONS)}) AS fk,
  count(DISTINCT chunk_id) AS chunk_count, count(DISTINCT split_part(route, '_', 1)) AS tc FROM hits GROUP BY ALL),
cs0 AS (SELECT query_id, doc_id, route_count, chunk_count, round(rrf + least(0.18::DOUBLE, 0.055::DOUBLE * kk) + least(0.10::DOUBLE, 0.05::DOUBLE * fk) + CASE WHEN tc >= 2 THEN 0.05::DOUBLE ELSE 0 END
  + least(0.10::DOUBLE, 0.015::DOUBLE * (route_count - 1)) + least(0.035::DOUBLE, 0.006::DOUBLE * (chunk_count - 1)) + 1e-9, 6) AS case_score FROM fused JOIN seen USING (query_id, doc_id)),
cs AS (SELECT query_id, doc_id, case_score, route_count, chunk_count, row_number() OVER (PARTITION BY query_id ORDER BY case_score DESC, doc_id)::INT AS case_rank FROM cs0)"""
_SECTS = f"""sx AS (SELECT query_id, doc_id, count(DISTINCT section_type) FILTER (section_type IN {_IN(LEGAL_SECTIONS)}) AS legal, count(DISTINCT section_type) FILTER (section_type IN {_IN(FOCUS_SECTIONS)}) AS focus,
  count(DISTINCT section_type) FILTER (section_type NOT IN ('facts', 'claims', 'defense')) AS others, bool_or(section_type = 'facts') AS facts, bool_or(section_type = 'reasoning') AS reasoning FROM hits GROUP BY ALL),
adj AS (SELECT query_id, doc_id, legal, least(0.06::DOUBLE, 0.025::DOUBLE * legal) + CASE WHEN focus = 4 THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN reasoning AND focus > 0 THEN 0.02::DOUBLE ELSE 0 END
  + CASE WHEN others = 0 AND legal = 0 THEN -0.08::DOUBLE WHEN facts AND legal = 0 THEN -0.04::DOUBLE ELSE 0 END AS a FROM sx)"""
_FUSED = f"""{_CASE}, {_SECTS},
f0 AS (SELECT cs.*, a, legal, case_rank <= 20 AS head, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 11) / 10.0::DOUBLE END AS ms FROM cs JOIN adj USING (query_id, doc_id)),
f1 AS (SELECT *, coalesce(ms, min(ms) OVER (PARTITION BY query_id, head), 0) AS m FROM f0),
f2 AS (SELECT *, min(case_score) OVER w AS cl, max(case_score) OVER w AS chh, min(m) OVER w AS ml, max(m) OVER w AS mh FROM f1 WINDOW w AS (PARTITION BY query_id, head)),
f3 AS (SELECT *, CASE WHEN head THEN round(greatest(0, 0.75::DOUBLE * CASE WHEN chh <= cl THEN 1 ELSE (case_score - cl) / (chh - cl) END + 0.25::DOUBLE * CASE WHEN mh <= ml THEN 1 ELSE (m - ml) / (mh - ml) END + a) + 1e-9, 6) ELSE case_score END AS fused_score FROM f2),
f4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN head THEN 0 ELSE 1 END, CASE WHEN head THEN -fused_score ELSE case_rank END, doc_id)::INT AS rerank_rank FROM f3)"""
_QRELS = """qrels AS (SELECT query_id, vec_id AS doc_id, CASE WHEN label = query_label THEN 2 ELSE 1 END AS grade, (CASE WHEN label = query_label THEN 2 ELSE 1 END)::DOUBLE AS gain FROM qv JOIN embeddings ON abs(label - query_label) <= 1)"""


def _metrics_sql(run: str, name: str) -> str:
    lin = lambda src, k: f"sum(CASE WHEN rank <= {k} THEN {src} / log2(rank + 1) ELSE 0 END)"
    return f"""
{name}_j AS (SELECT r.query_id, r.doc_id, r.rank, coalesce(grade, 0) AS grade, coalesce(gain, 0.0) AS gain FROM {run} r LEFT JOIN qrels USING (query_id, doc_id)),
{name}_h AS (SELECT *, sum((grade >= 2)::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM {name}_j),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS rank FROM qrels),
{name}_i AS (SELECT query_id, count(*) FILTER (grade >= 2) AS p, {lin("(pow(2, gain) - 1)", 10)} AS ie, {", ".join(f"{lin('gain', k)} AS i{k}" for k in (10, 20, 50))} FROM {name}_o GROUP BY ALL),
{name}_d AS (SELECT query_id, min(rank) FILTER (grade >= 2) AS first, {", ".join(f"count(*) FILTER (grade >= 2 AND rank <= {k}) AS in{k}" for k in (5, 10, 20, 50, 100))},
  sum(CASE WHEN grade >= 2 THEN hits / rank ELSE 0 END) AS pr, {lin("(pow(2, gain) - 1)", 10)} AS de, {", ".join(f"{lin('gain', k)} AS d{k}" for k in (10, 20, 50))}, count(*) FILTER (grade = 1 AND rank <= 20) AS weak, count(*) AS ret FROM {name}_h GROUP BY ALL),
{name} AS (SELECT query_id, coalesce(p, 0) AS positive_count, first AS first_positive_rank, weak AS weak_top20, ret AS returned_count,
  {", ".join(f"CASE WHEN p > 0 THEN (in{k} > 0)::INT::DOUBLE END AS hit_{k}" for k in (5, 10))}, {", ".join(f"round(in{k} / nullif(p, 0)::DOUBLE, 6) AS recall_{k}" for k in (20, 50, 100))},
  CASE WHEN p > 0 THEN round(coalesce(1.0 / first, 0)::DOUBLE, 6) END AS mrr, round(pr / nullif(p, 0), 6) AS map, round(de / nullif(ie, 0), 6) AS ndcg_10, {", ".join(f"round(d{k} / nullif(i{k}, 0), 6) AS expected_ndcg_{k}" for k in (10, 20, 50))},
  in20 > 0 AS top20_has_positive, in100 > 0 AS top100_has_positive FROM {name}_d LEFT JOIN {name}_i USING (query_id))"""


_RUN = "run AS (SELECT query_id, vec_id AS doc_id, rank FROM knn WHERE rank <= 100), far AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS rank FROM run)"
_EVAL = f"{_KNN}, {_QRELS}, {_RUN}, {_metrics_sql('run', 'm')}"
_LABEL = """CASE WHEN positive_count = 0 THEN 'no_positive' WHEN NOT top100_has_positive THEN 'recall_failure' WHEN NOT top20_has_positive THEN 'ranking_failure' WHEN coalesce(expected_ndcg_20 < 0.6, false) AND weak_top20 >= 10 THEN 'front_pollution'
 WHEN first_positive_rank > 10 THEN 'late_positive' WHEN coalesce(expected_ndcg_20 < 0.6, false) THEN 'low_alignment' ELSE 'good' END"""
_DIAG = f"{_EVAL}, dg AS (SELECT *, {_LABEL} AS label FROM m), dz AS (SELECT *, CASE label WHEN 'no_positive' THEN 'excluded' WHEN 'recall_failure' THEN 'recall' WHEN 'good' THEN 'good' ELSE 'ranking' END AS bucket FROM dg)"
_MEANS = ", ".join(f"round(avg({x}), 6) AS {x}" for x in evaluation.MEANS)
_PICK = "row_number() OVER (PARTITION BY query_id, doc_id ORDER BY {o})::INT"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WHITE}|{_WHITE}$', '', 'g')"
_AT = lambda needles: "list_min(list_filter([" + ", ".join(f"instr(text, '{n}')" for n in needles) + "], lambda i: i > 0))"
_EXTRACT = f"""an AS (SELECT doc_id, text, unnest([{', '.join(_AT(n) for _, _, n in ANCHORS)}]) AS a, unnest(range(1, {len(ANCHORS) + 1}))::INT AS place, unnest({[i for i, _, _ in ANCHORS]}) AS id, unnest({[t for _, t, _ in ANCHORS]}) AS title FROM documents),
 ao AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a, place), length(text) + 1) AS b FROM an WHERE a IS NOT NULL),
 ah AS (SELECT doc_id, 0 AS place, 'header' AS id, '首部信息' AS title, substring(text, 1, coalesce((SELECT min(a) FROM ao WHERE ao.doc_id = d.doc_id), length(text) + 1) - 1) AS raw FROM documents d),
 xs AS (SELECT doc_id, place, id, title, {_STRIP('raw')} AS content FROM (SELECT * FROM ah UNION ALL SELECT doc_id, place, id, title, substring(text, a, b - a) FROM ao) WHERE {_STRIP('raw')} <> '')"""
_FIRST = f"own = 1 AND section_type IN {_IN(RERANK_ORDER)}"
_BEST = _PICK.format(o=f"NOT ({_FIRST}), CASE WHEN {_FIRST} THEN {_PLACE} ELSE (section_type NOT IN {_IN(LEGAL_SECTIONS)})::INT END, CASE WHEN {_FIRST} THEN 0 ELSE -score END, {_PLACE}, chunk_id")


def _case(x: str, table: dict, other) -> str:
    lit = lambda v: "NULL" if v is None else repr(v)
    return f"CASE {x} {' '.join(f'WHEN {k!r} THEN {lit(v)}' for k, v in table.items())} ELSE {lit(other)} END"


def _stop(a: str, most: int = 760) -> str:
    """End of the piece that starts at ``a``: after the last full stop or line feed of its second half."""
    half = most // 2
    back = f"list_min(list_filter([strpos(reverse(substring(t, {a} + {half} + 1, {most - half})), m) for m in ['。', chr(10)]], lambda i: i > 0))"
    return f"CASE WHEN length(t) <= {a} + {most} THEN length(t) ELSE {a} + {most} + 1 - coalesce({back}, 1) END"


_SCORER = "SELECT round(avg(coalesce(expected_ndcg_10, 0)), 6) AS ndcg_10, round(avg(recall_20), 6) AS recall_20, round(avg(mrr), 6) AS mrr, round(avg(map), 6) AS map, count(*) AS queries FROM {m}"

_ASKED = ["规则争议焦点", "规则请求类型", "规则否定事实", "规则法律关系"]  # labels of the rerank query; these queries' profiles are empty
_HYBRID = f"""{_CASE}, {_SECTS}, hd AS (SELECT query_id, doc_id FROM cs WHERE case_rank <= 30),
k0 AS (SELECT query_id, doc_id, chunk_id, section_type, section_index, chunk_text, section_type IN {_IN(CASE_KEY_SECTIONS)} AS ky FROM ch JOIN hd USING (doc_id)),
kn AS (SELECT query_id, 8 * count(DISTINCT doc_id) AS most FROM k0 GROUP BY ALL),
k1 AS (SELECT k0.*, ky AND row_number() OVER (PARTITION BY query_id, ky ORDER BY doc_id, section_index, chunk_id) <= most AS is_key FROM k0 JOIN kn USING (query_id)),
ow AS (SELECT query_id, doc_id, chunk_id, section_type AS hit_type, score FROM merged JOIN hd USING (query_id, doc_id)),
ec AS (SELECT query_id, doc_id, chunk_id, coalesce(section_type, hit_type) AS section_type, coalesce(score, 0::DOUBLE) AS score, coalesce(chunk_text, '') AS chunk_text FROM k1 FULL JOIN ow USING (query_id, doc_id, chunk_id) WHERE is_key OR score IS NOT NULL),
eo AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, section_type ORDER BY score DESC, chunk_id) AS own FROM ec),
ep AS (SELECT *, {_BEST} AS pick FROM eo QUALIFY pick <= 6),
et AS (SELECT query_id, doc_id, pick, {_compact('chunk_text')} AS body, {_case('section_type', RERANK_BUDGETS, OTHER_BUDGET)} AS budget, {_case('section_type', RERANK_GROUPS, GROUP_ORDER[-1])} AS grp, coalesce({_case('section_type', SECTION_TITLES, None)}, section_type) AS label FROM ep),
eg AS (SELECT query_id, doc_id, list_position({GROUP_ORDER}, grp) AS place, grp || ' ' || string_agg(label || '：' || CASE WHEN length(body) > budget THEN body[1:budget - 1] || '…' ELSE body END, ' ' ORDER BY pick) AS block FROM et WHERE body <> '' GROUP BY query_id, doc_id, grp),
ew AS (SELECT query_id, doc_id, string_agg(block, ' ' ORDER BY place) AS blocks FROM eg GROUP BY ALL),
ex AS (SELECT query_id, doc_id, {_compact("concat_ws(' ', CASE WHEN lang IS NOT NULL THEN '【案件类型】 案名：' || source || ' ' || lang || ' 案由：' || lang END, blocks)")} AS t FROM (SELECT DISTINCT query_id, doc_id FROM ec) LEFT JOIN ew USING (query_id, doc_id) LEFT JOIN documents USING (doc_id)),
ey AS (SELECT query_id, doc_id, list_distinct(list_concat({_TOK.format(x=_compact('query_text'))}, {_ASKED})) AS wq, {_TOK.format(x=f"CASE WHEN length(t) > {PASSAGE_LIMIT} THEN t[1:{PASSAGE_LIMIT} - 1] || '…' ELSE t END")} AS wt FROM ex JOIN q USING (query_id)),
ms AS (SELECT query_id, doc_id, round(len(list_intersect(wq, wt)) / greatest(1, len(wq)), 6) AS ms FROM ey),
z0 AS (SELECT cs.*, a, legal, ms FROM cs JOIN adj USING (query_id, doc_id) LEFT JOIN ms USING (query_id, doc_id) WHERE case_rank <= 30),
z1 AS (SELECT *, coalesce(ms, min(ms) OVER (PARTITION BY query_id), 0) AS m FROM z0),
z2 AS (SELECT *, min(case_score) OVER w AS cl, max(case_score) OVER w AS chh, min(m) OVER w AS ml, max(m) OVER w AS mh FROM z1 WINDOW w AS (PARTITION BY query_id)),
z3 AS (SELECT *, round(greatest(0, 0.75::DOUBLE * CASE WHEN chh <= cl THEN 1 ELSE (case_score - cl) / (chh - cl) END + 0.25::DOUBLE * CASE WHEN mh <= ml THEN 1 ELSE (m - ml) / (mh - ml) END + a) + 1e-9, 6) AS fused_score FROM z2),
z4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, doc_id) AS rr FROM z3),
z5 AS (SELECT *, round(fused_score - least(0.8::DOUBLE, 0.025::DOUBLE * (greatest(0, CASE WHEN case_rank <= 20 THEN greatest(1, case_rank - 20) ELSE greatest(11, case_rank - 20) END - rr) + CASE WHEN rr <= 10 AND legal = 0 THEN 3 ELSE 0 END)) + 1e-9, 6) AS safe FROM z4),
z6 AS (SELECT query_id, doc_id, safe, row_number() OVER (PARTITION BY query_id ORDER BY safe DESC, rr)::INT AS place FROM z5)"""
ORACLES = {
    "hybrid_search": f"WITH {_HYBRID} SELECT query_id, place AS case_rank, doc_id, safe AS case_score, coalesce(source || ' ' || lang, '') AS case_name, coalesce(source, '') AS court_name, coalesce(lang, '') AS reason FROM z6 LEFT JOIN documents USING (doc_id) WHERE place <= 10",
    "compact_text": f"SELECT doc_id, CASE WHEN length(t) > 120 THEN t[1:119] || '…' ELSE t END AS brief, length(t)::INT AS n FROM (SELECT doc_id, {_compact('text')} AS t FROM documents)",
    "clean_text": f"SELECT conv_id, turn, {_clean('text')} AS clean FROM conversations",
    "clause_split": f"""WITH c AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array({_compact('text')}, '[。！？!?；;]+'), lambda x: {_compact("regexp_replace(x, '^[ ，,、]+|[ ，,、]+$', '', 'g')")}), lambda x: x <> '') AS l FROM conversations),
      d AS (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i)[1:16] AS l FROM c) SELECT conv_id, turn, unnest(range(len(l)))::INT AS pos, unnest(l) AS clause FROM d""",
    "term_hits": f"SELECT doc_id, array_to_string(list_filter({TERMS}, lambda t: contains(lower(text), t))[1:4], ',') AS terms, {' OR '.join(f'''contains(lower(text), '{t}')''' for t in TERMS)} AS any_term FROM documents",
    "query_profile": f"""WITH c AS (SELECT item_id AS query_id, {_compact('text')} AS raw_query FROM benchmark), p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(raw_query, '[。！？!?；;]+'), lambda x: {_compact("regexp_replace(x, '^[ ，,、]+|[ ，,、]+$', '', 'g')")}), lambda x: x <> '' AND ({' OR '.join(f"contains(x, '{t}')" for t in DISPUTE_TERMS)})) AS f FROM c)
      SELECT query_id, raw_query, array_to_string(f[1:5], '|') AS focus, '' AS requests, '' AS tendency FROM p""",
    "case_projection": f"SELECT doc_id, split_part(doc_id::VARCHAR, '#', 1) AS case_code, source || ' ' || lang AS case_name, coalesce(nullif(source, ''), 'unknown') AS court_name, lang AS reason, sha256({_clean('text')}) AS full_text_hash FROM documents",
    "full_text_assembly": f"WITH p AS (SELECT doc_id, {_clean('''array_to_string(list_filter(['法院：' || source, '案由：' || lang, '正文：' || text], lambda x: NOT ends_with(x, '：')), chr(10) || chr(10))''')} AS t FROM documents) SELECT doc_id, length(t)::INT AS n, sha256(t) AS hash FROM p",
    "section_unpivot": f"WITH {_CHUNKS} SELECT doc_id, section_index, section_type, chunk_id, length(chunk_text)::INT AS chunk_char_len FROM ch",
    "chunk_ordinals": f"WITH {_CHUNKS} SELECT chunk_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section_index, chunk_id) - 1)::INT AS chunk_index_in_case FROM ch",
    "chunk_links": f"WITH {_CHUNKS} SELECT chunk_id, coalesce(lag(chunk_id) OVER w, '') AS prev_chunk_id, coalesce(lead(chunk_id) OVER w, '') AS next_chunk_id FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY section_index, chunk_id)",
    "chunk_hashes": f"WITH {_CHUNKS} SELECT chunk_id, sha256(chunk_text) AS chunk_hash FROM ch",
    "embedding_text": f"WITH {_CHUNKS} SELECT chunk_id, sha256(concat_ws(chr(10), '案由：' || lang, '法院：' || source, '段落：' || CASE section_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in corpus.SECTION_TITLES.items())} END, chunk_text)) AS hash FROM ch",
    "chunk_offsets": f"""WITH {_CHUNKS}, o AS (SELECT doc_id, section_index, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY section_index) - length(line) - 1 + length(line) - length(ltrim(line, ' ')) AS a FROM para)
      SELECT chunk_id, a::INT AS char_start, (a + length(chunk_text))::INT AS char_end, (section_index + 1)::INT AS line_start, (section_index + 1)::INT AS line_end FROM ch JOIN o USING (doc_id, section_index)""",
    "section_counts": f"WITH {_CHUNKS} SELECT section_type, count(*) AS chunks, sum(length(chunk_text))::BIGINT AS chars FROM ch GROUP BY ALL",
    "line_numbers": "SELECT doc_id, (length(text[1:length(text) // 2]) - length(replace(text[1:length(text) // 2], chr(10), '')) + 1)::INT AS line FROM documents",
    "context_window": "SELECT doc_id, CASE WHEN p = 0 THEN '' ELSE substring(text, greatest(p - 20, 1)::BIGINT, least(20, p - 1)::BIGINT) || '[[' || substring(text, p, 4) || ']]' || substring(text, p + 4, 20) END AS context FROM (SELECT *, instr(text, 'tion') AS p FROM documents)",
    "anchor_slice": """WITH a AS (SELECT doc_id, text, list_min(list_filter([instr(text, 'the '), instr(text, 'der '), instr(text, 'de ')], lambda i: i > 0)) AS p FROM documents), b AS (SELECT *, substring(text, p) AS rest FROM a),
      c AS (SELECT *, list_min(list_filter([instr(substring(rest, 2), '. '), instr(substring(rest, 2), '!!')], lambda i: i > 0)) AS s FROM b) SELECT doc_id, sha256(coalesce(CASE WHEN s IS NULL THEN rest ELSE substring(rest, 1, s) END, '')) AS hash FROM c""",
    "corpus_stats": f"WITH {_CHUNKS}, t AS (SELECT chunk_id, unnest({_TOK.format(x='chunk_text')}) AS term FROM ch) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM t GROUP BY ALL",
    "bm25_topk": f"WITH {_CHUNKS}, {_Q}, {_bm25('ch', 'chunk_id', 'chunk_text', 'q', 'bm')} SELECT query_id, id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM bm QUALIFY rank <= 10",
    "bm25_multifield": f"""WITH q AS (SELECT item_id AS query_id, text || ' en src1' AS query_text FROM benchmark), d AS (SELECT *, source || ' ' || lang AS title FROM documents), {_bm25('d', 'doc_id', 'text', 'q', 'a', 3.0)}, {_bm25('d', 'doc_id', 'title', 'q', 'b', 1.4)},
      u AS (SELECT query_id, id AS doc_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM u QUALIFY rank <= 10""",
    "bm25_filtered": f"WITH {_CHUNKS}, {_Q}, cf AS (SELECT * FROM ch WHERE lang = 'en' AND section_type = 'fine_rule'), {_bm25('cf', 'chunk_id', 'chunk_text', 'q', 'bm')} SELECT query_id, id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM bm QUALIFY rank <= 10",
    "date_range_filter": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'",
    "knn_cosine_topk": f"WITH {_KNN} SELECT query_id, vec_id, score, rank::INT AS rank FROM knn WHERE rank <= 10",
    "knn_filtered": f"WITH {_KNN} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM sim WHERE label < 5 QUALIFY rank <= 10",
    "route_hits": f"WITH {_HITS} SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, chunk_id)::INT AS rank FROM hits",
    "chunk_rrf": f"WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, chunk_id) AS rank FROM hits) SELECT query_id, chunk_id, doc_id, round(sum(weight / (10 + rank)), 6) AS score, count(*) AS routes FROM r GROUP BY ALL",
    "route_case_ranking": f"WITH {_CASE} SELECT query_id, route, doc_id, hit_count, route_score, route_rank::INT AS route_rank FROM rc",
    "case_rrf": f"WITH {_CASE} SELECT * FROM cs",
    "case_aggregate_alt": f"""WITH {_HITS}, v AS (SELECT *, round(score * {_WEIGHT} + 1e-9, 6) AS value FROM merged), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY value DESC, chunk_id) AS n FROM v),
      g AS (SELECT query_id, doc_id, max(value) AS best, sum(value) FILTER (n <= 3) AS top3, count(DISTINCT section_type) FILTER (section_type IN {_IN(KEY_SECTIONS)}) AS kk, count(DISTINCT section_type) FILTER (n <= 3 AND section_type IN {_IN(FOCUS_SECTIONS)}) AS fk, count(*) AS c, count(*) FILTER (n <= 3 AND len(sources) >= 2) AS mu FROM n GROUP BY ALL),
      s AS (SELECT query_id, doc_id, count(DISTINCT route) AS so FROM hits GROUP BY ALL)
      SELECT query_id, doc_id, round(0.55::DOUBLE * best + 0.35::DOUBLE * top3 + least(0.18::DOUBLE, 0.055::DOUBLE * kk) + least(0.08::DOUBLE, 0.04::DOUBLE * fk) + least(0.08::DOUBLE, 0.018::DOUBLE * (c - 1)) + least(0.12::DOUBLE, 0.018::DOUBLE * (so - 1)) + least(0.08::DOUBLE, 0.02::DOUBLE * mu) + 1e-9, 6) AS case_score FROM g JOIN s USING (query_id, doc_id)""",
    "chunk_merge": f"WITH {_HITS} SELECT query_id, chunk_id, score, array_to_string(sources, ',') AS sources, len(sources)::INT AS n_raw FROM merged",
    "top_chunks_per_case": f"WITH {_HITS} SELECT query_id, doc_id, chunk_id, {_PICK.format(o='score DESC, chunk_id')} AS chunk_rank FROM merged QUALIFY chunk_rank <= 3",
    "rerank_chunk_pick": f"WITH {_HITS} SELECT query_id, doc_id, chunk_id, {_PICK.format(o=f'section_type NOT IN {_IN(KEY_SECTIONS)}, {_PLACE}, score DESC, chunk_id')} AS pick FROM merged QUALIFY pick <= 8",
    "best_chunk_per_section": f"WITH {_HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, section_type ORDER BY score DESC, chunk_id) AS own FROM merged) SELECT query_id, doc_id, chunk_id, {_BEST} AS pick FROM o QUALIFY pick <= 6",
    "minmax_normalize": f"WITH {_CASE}, w AS (SELECT *, min(case_score) OVER (PARTITION BY query_id) AS lo, max(case_score) OVER (PARTITION BY query_id) AS hi FROM cs) SELECT query_id, doc_id, round(CASE WHEN hi <= lo THEN 1.0::DOUBLE ELSE (case_score - lo) / (hi - lo) END, 6) AS normal FROM w",
    "structure_adjustment": f"WITH {_HITS}, {_SECTS} SELECT query_id, doc_id, round(a, 6) AS adjustment FROM adj",
    "rerank_fusion": f"WITH {_FUSED} SELECT query_id, doc_id, case_rank, fused_score, rerank_rank FROM f4",
    "rank_safe": f"""WITH {_FUSED}, g0 AS (SELECT *, CASE WHEN case_rank <= 20 THEN greatest(1, case_rank - 5) WHEN case_rank <= 50 THEN greatest(11, case_rank - 5) ELSE greatest(21, case_rank - 5) END AS allowed FROM f4),
      g1 AS (SELECT *, round(fused_score - least(0.8::DOUBLE, 0.025::DOUBLE * (greatest(0, allowed - rerank_rank) + CASE WHEN rerank_rank <= 10 AND legal = 0 THEN 3 ELSE 0 END)) + 1e-9, 6) AS safe_score FROM g0)
      SELECT query_id, doc_id, safe_score, row_number() OVER (PARTITION BY query_id ORDER BY safe_score DESC, rerank_rank)::INT AS safe_rank FROM g1""",
    "result_entry": f"WITH {_CASE} SELECT query_id, case_rank, doc_id, case_score, coalesce(source || ' ' || lang, '') AS case_name, coalesce(source, '') AS court_name, coalesce(lang, '') AS reason FROM cs LEFT JOIN documents USING (doc_id) WHERE case_rank <= 10",
    "public_result": f"WITH {_CASE}, {_QRELS} SELECT query_id, doc_id, case_rank, coalesce(grade, 0) AS grade, doc_id = query_id AS is_anchor, grade IS NOT NULL AS is_judged, coalesce(grade, 0) >= 2 AS is_positive, coalesce(grade, 0) = 1 AS is_weak FROM cs LEFT JOIN qrels USING (query_id, doc_id)",
    "route_expansion": f"""WITH {_Q}, r AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', '{t}', {w}::DOUBLE, {'NULL' if x is None else repr(x)})" for i, (n, t, w, x) in enumerate([r for r in ROUTES if r[3] or r[0].endswith('_raw')]))}) v(route_ord, route, route_type, weight, section_type))
      SELECT query_id, route_ord, route, route_type, weight, section_type, {_compact('query_text')} AS query FROM q, r""",
    "passage_build": f"""WITH {_HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, section_type ORDER BY score DESC, chunk_id) AS own FROM merged),
      p AS (SELECT query_id, doc_id, chunk_id, section_type, {_BEST} AS pick FROM o QUALIFY pick <= 6),
      t AS (SELECT p.*, {_compact("coalesce(chunk_text, '')")} AS body, {_case('p.section_type', RERANK_BUDGETS, OTHER_BUDGET)} AS budget, {_case('p.section_type', RERANK_GROUPS, GROUP_ORDER[-1])} AS grp, coalesce({_case('p.section_type', SECTION_TITLES, None)}, p.section_type) AS label FROM p LEFT JOIN ch USING (chunk_id)),
      e AS (SELECT query_id, doc_id, pick, grp, list_position({GROUP_ORDER}, grp) AS place, label || '：' || CASE WHEN length(body) > budget THEN body[1:budget - 1] || '…' ELSE body END AS entry FROM t WHERE body <> ''),
      g AS (SELECT query_id, doc_id, place, grp || ' ' || string_agg(entry, ' ' ORDER BY pick) AS block FROM e GROUP BY query_id, doc_id, place, grp),
      w AS (SELECT query_id, doc_id, string_agg(block, ' ' ORDER BY place) AS blocks FROM g GROUP BY ALL),
      a AS (SELECT DISTINCT query_id, doc_id FROM p),
      x AS (SELECT query_id, doc_id, {_compact("concat_ws(' ', CASE WHEN lang IS NOT NULL THEN '【案件类型】 案名：' || source || ' ' || lang || ' 案由：' || lang END, blocks)")} AS t FROM a LEFT JOIN w USING (query_id, doc_id) LEFT JOIN documents USING (doc_id))
      SELECT query_id, doc_id, CASE WHEN length(t) > {PASSAGE_LIMIT} THEN t[1:{PASSAGE_LIMIT} - 1] || '…' ELSE t END AS passage FROM x""",
    "guardrail_penalty": f"""WITH {_CASE}, d AS (SELECT query_id, doc_id, text AS doc, {_compact('query_text')} AS qt FROM cs JOIN documents USING (doc_id) JOIN q USING (query_id)),
      f AS (SELECT *, contains(qt, 'the') OR contains(qt, 'der') AS a1, contains(doc, 'thth') AS h1, contains(qt, 'e') AND contains(qt, 'que') AS a2, contains(doc, 'ción') AS h2, contains(qt, 'tion') AND contains(doc, 'ung') AND NOT contains(doc, 'the ') AS b3 FROM d)
      SELECT query_id, doc_id, round(least(0.35::DOUBLE, CASE WHEN a1 AND NOT h1 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN a2 AND NOT h2 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN b3 THEN 0.14::DOUBLE ELSE 0 END), 6) AS penalty,
        CASE WHEN (a1 AND h1 OR a2 AND h2) AND NOT (a1 AND NOT h1) AND NOT (a2 AND NOT h2) AND NOT b3 THEN round(least(0.02::DOUBLE, 0.008::DOUBLE * ((a1 AND h1)::INT + (a2 AND h2)::INT)), 6) ELSE 0::DOUBLE END AS bonus,
        concat_ws(',', CASE WHEN a1 AND NOT h1 THEN 'one' END, CASE WHEN a2 AND NOT h2 THEN 'two' END) AS missing, CASE WHEN b3 THEN 'three' ELSE '' END AS conflicts FROM f""",
    "profile_bonus": f"""WITH {_CHUNKS}, t AS (SELECT *, {_compact('chunk_text')} AS body FROM ch) SELECT chunk_id, round(greatest(-0.05::DOUBLE, least(0.28::DOUBLE, {_BONUS} + CASE WHEN lang = 'fr' OR contains(body, 'fr') OR contains(body, 'tion.') THEN 0.08 ELSE 0 END::DOUBLE
      + CASE WHEN contains(body, 'the ') OR contains(body, 'der ') THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN contains(body, 'que ') THEN 0.04 ELSE 0 END::DOUBLE + CASE WHEN contains(body, 'la ') OR contains(source, 'la ') THEN 0.05 ELSE 0 END::DOUBLE)), 6) AS bonus FROM t""",
    "marker_split": f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS ln FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)),
      u AS (SELECT doc_id, ln, unnest(p) AS unit, unnest(range(len(p))) AS k FROM (SELECT doc_id, ln, string_split(regexp_replace(line, '({'|'.join(MARKS)})', chr(1) || '\\1', 'g'), chr(1)) AS p FROM l)),
      c AS (SELECT doc_id, ln, k, {_clean('unit')} AS unit FROM u) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) - 1)::INT AS pos, unit FROM c WHERE unit <> ''""",
    "chunk_fixed_split": f"""WITH RECURSIVE c AS (SELECT doc_id, {_clean('text')} AS t FROM documents), r AS (SELECT doc_id, t, 0::BIGINT AS a, {_stop('0')} AS b FROM c WHERE t <> '' UNION ALL SELECT doc_id, t, b, {_stop('b')} FROM r WHERE b < length(t)),
      p AS (SELECT doc_id, a, {_clean('substring(t, a + 1, b - a)')} AS piece FROM r)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS pos, length(piece)::INT AS n, sha256(piece) AS hash FROM p WHERE piece <> ''""",
    "advisor_fallback": f"WITH {_CASE} SELECT query_id, string_agg(case_rank || '. ' || coalesce(source || ' ' || lang, '') || ' [' || doc_id || ']', chr(10) ORDER BY case_rank) AS answer FROM cs LEFT JOIN documents USING (doc_id) WHERE case_rank <= 3 GROUP BY ALL",
    "citations_valid": f"WITH {_CASE} SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS cited FROM cs WHERE case_rank <= 10 GROUP BY ALL",
    "query_metrics": f"WITH {_EVAL} SELECT * REPLACE (first_positive_rank::INT AS first_positive_rank) FROM m",
    "metrics_by_group": f"""WITH {_EVAL}, d AS (SELECT *, ['hard', 'medium', 'easy'][query_id % 3 + 1] AS difficulty, (query_id % 2 = 0)::VARCHAR AS trap FROM m)
      SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(trap) = 0 THEN 'trap' ELSE 'overall' END AS grouped_by, difficulty, trap, count(*) AS queries, count(*) FILTER (positive_count > 0) AS queries_with_positive, {_MEANS} FROM d GROUP BY GROUPING SETS ((), (difficulty), (trap))""",
    "diagnosis": f"WITH {_DIAG} SELECT query_id, label, bucket FROM dz",
    "diagnosis_summary": f"WITH {_DIAG} SELECT bucket, label, count(*) AS queries FROM dz GROUP BY ALL",
    "missed_positives": f"WITH {_KNN}, {_QRELS}, {_RUN} SELECT query_id, doc_id, grade FROM qrels WHERE grade >= 2 AND NOT EXISTS (SELECT 1 FROM run WHERE run.query_id = qrels.query_id AND run.doc_id = qrels.doc_id)",
    "method_comparison": f"WITH {_EVAL}, {_metrics_sql('far', 'f')} SELECT m.query_id, {', '.join(f'round(f.{x} - m.{x}, 6) AS d_{x}' for x in evaluation.MEANS)}, (f.first_positive_rank - m.first_positive_rank)::INT AS d_first_positive_rank, f.weak_top20 - m.weak_top20 AS d_weak_top20 FROM m JOIN f USING (query_id)",
    "scorer": f"WITH {_EVAL} {_SCORER.format(m='m')}",
    "scorer_no_anchor": f"WITH {_KNN}, {_QRELS.replace('qrels AS (', 'qrels AS (SELECT * FROM (')} WHERE query_id <> doc_id), {_RUN}, na AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM run WHERE query_id <> doc_id), {_metrics_sql('na', 'm')} {_SCORER.format(m='m')}",
    "grade_counts": f"WITH {_KNN}, {_QRELS} SELECT query_id, count(*) AS sample_total, {', '.join(f'count(*) FILTER (grade = {g}) AS grade_{g}_count' for g in (3, 2, 1))}, {', '.join(f'round(count(*) FILTER (grade = {g}) / count(*), 6) AS grade_{g}_ratio' for g in (3, 2, 1))} FROM qrels GROUP BY ALL",
    "judge_agreement": """WITH p AS (SELECT l_quantity::BIGINT % 4 AS a, l_linenumber::BIGINT % 4 AS b FROM lineitem), s AS (SELECT count(*) AS n, avg((a = b)::INT) AS same, avg((abs(a - b) <= 1)::INT) AS w1, corr(a, b) AS r, sum(pow(a - b, 2)) AS mv FROM p),
      x AS (SELECT a, count(*) AS na FROM p GROUP BY ALL), y AS (SELECT b, count(*) AS nb FROM p GROUP BY ALL), c AS (SELECT sum(na * nb) FILTER (a = b) AS sc, sum(na * nb * pow(a - b, 2)) AS mc FROM x, y)
      SELECT n, round(w1, 6) AS within_one, round(r, 6) AS pearson, round((same - sc / (n::DOUBLE * n)) / (1 - sc / (n::DOUBLE * n)), 6) AS kappa, round(1 - mv * n / mc, 6) AS weighted_kappa FROM s, c""",
    "dedup_first": "WITH d AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, min(l_linenumber) AS r FROM lineitem GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id)::INT AS rank FROM d",
    "grid_refuse": f"""WITH {_CASE}, g AS (SELECT * FROM (VALUES (0, 0.8, 0.6), (1, 0.8, 1.0), (2, 1.2, 0.6), (3, 1.2, 1.0)) t(set_id, wb, wv)),
      s AS (SELECT set_id, query_id, doc_id, round(sum((CASE route WHEN 'bm25_raw' THEN wb WHEN 'vector_raw' THEN wv ELSE weight END)::DOUBLE / (10 + route_rank)), 6) AS score FROM rc, g GROUP BY ALL)
      SELECT set_id, query_id, doc_id, score, row_number() OVER (PARTITION BY set_id, query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 5""",
    "best_runs": "WITH r AS (SELECT o_custkey AS set_id, count(*) AS queries, round(avg(o_totalprice), 4) AS objective FROM orders GROUP BY ALL) SELECT * FROM r WHERE queries >= 5 OR NOT (SELECT max(queries) >= 5 FROM r) ORDER BY objective DESC, set_id LIMIT 10",
    "resume_anti_join": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "cache_upsert": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "point_lookup": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "set_ops": "SELECT 'both' AS op, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'only_b', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', k FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)",
    "json_fields": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "section_extract": f"WITH {_EXTRACT} SELECT doc_id, place, id, title, length(content)::INT AS n, sha256(content) AS hash FROM xs",
    "preview_sections": f"WITH {_EXTRACT}, k AS (SELECT doc_id, unnest([0, 1, 2])::INT AS at, unnest(['facts', 'claims', 'judgment']) AS id FROM (SELECT DISTINCT doc_id FROM xs)) SELECT doc_id, k.at AS \"at\", id, coalesce(length(content), 0)::INT AS n FROM k LEFT JOIN xs USING (doc_id, id)",
    "case_detail": f"""WITH {_CHUNKS}, {_EXTRACT}, g AS (SELECT doc_id, string_agg(id, ',' ORDER BY place) AS section_ids, arg_min(content, place) FILTER (place > 0) AS c FROM xs GROUP BY ALL), f AS (SELECT doc_id, arg_min(chunk_text, section_index) AS fc FROM ch GROUP BY ALL),
      p AS (SELECT d.doc_id, d.source, d.lang, coalesce(section_ids, '') AS section_ids, {_compact("coalesce(nullif(coalesce(c, fc), ''), '暂无内容')")} AS t FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN f USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
      SELECT doc_id, source || ' ' || lang AS case_name, coalesce(nullif(source, ''), 'unknown') AS court_name, lang AS reason, section_ids, CASE WHEN length(t) > 260 THEN t[1:259] || '…' ELSE t END AS preview FROM p""",
    "first_sections": f"WITH {_CHUNKS} SELECT doc_id, section_type, arg_min(chunk_id, section_index) AS chunk_id FROM ch WHERE section_type IN ('claims', 'facts', 'reasoning', 'judgment') GROUP BY ALL",
    "draft_cut": f"SELECT doc_id, sha256(coalesce(substring(text, {_AT(['que ', 'tion', 'und '])}), '')) AS hash FROM documents",
    "rewrite_parse": f"""WITH c AS (SELECT conv_id, turn, turn % 5 AS k, role, {_compact('text')} AS t FROM conversations), l AS (SELECT *, list_filter([role, t], lambda x: x <> '' AND length(x) <= 40) AS ls FROM c)
      SELECT conv_id, turn, CASE WHEN k > 2 AND length(t) <= 120 THEN t ELSE '' END AS expanded_query, CASE WHEN k > 2 THEN role ELSE '' END AS legal_issue, '' AS fact_elements, '' AS statutes, '' AS main_leaf,
      CASE WHEN k > 2 THEN array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), '|') ELSE '' END AS focus_labels, k > 2 AS used, CASE WHEN k < 2 THEN 'invalid_json' WHEN k = 2 THEN 'empty_fields' ELSE '' END AS fallback_reason FROM l""",
    "answer_object": """SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN '{"role":"' || role || '","turn":' || turn || '}' END AS object FROM conversations""",
    "chunk_passage": f"WITH {_CHUNKS} SELECT chunk_id, sha256(concat_ws(chr(10), '案由：' || lang, '章节：' || section_type, '裁判结果标签：' || source || '、' || lang, '正文：' || chunk_text)) AS hash FROM ch",
    "core_issue": "SELECT doc_id, lang || '；' || source || '；' || lang AS issue, CASE WHEN doc_id % 2 = 0 THEN source ELSE doc_id || ':' || lang || ':' || text[1:80] END AS chunk_key FROM documents",
    "statute_flatten": "SELECT l_orderkey, string_agg(l_returnflag || ' 第' || l_linenumber || '条 ' || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag, l_linestatus) AS lines FROM lineitem GROUP BY ALL",
    "chunk_sample": f"WITH {_CHUNKS} SELECT doc_id, chunk_id, section_type, chunk_text[1:360] AS chunk_text FROM ch ORDER BY doc_id, section_index, chunk_id LIMIT 12",
    "worst_deltas": f"WITH {_EVAL}, {_metrics_sql('far', 'f')}, d AS (SELECT m.query_id, round(f.mrr - m.mrr, 6) AS d_mrr, round(f.map - m.map, 6) AS d_map, round(f.recall_20 - m.recall_20, 6) AS r FROM m JOIN f USING (query_id)) SELECT query_id, d_mrr, d_map FROM d WHERE coalesce(d_mrr, d_map, r) IS NOT NULL ORDER BY coalesce(d_mrr, 0), query_id LIMIT 8",
    "label_samples": "WITH s AS (SELECT l_suppkey AS query_id, l_partkey % 50 AS doc_id, l_quantity::INT % 4 AS g FROM lineitem) SELECT query_id, doc_id, floor(avg(g) + 0.5)::INT AS main, round(avg(g), 6) AS expected, round(stddev_pop(g), 6) AS deviation, count(*) AS samples FROM s GROUP BY ALL",
    "diagnosis_export": f"""WITH {_DIAG}, p AS (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM qrels WHERE grade >= 2 GROUP BY ALL), x AS (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM qrels WHERE grade >= 2 AND NOT EXISTS (SELECT 1 FROM run WHERE run.query_id = qrels.query_id AND run.doc_id = qrels.doc_id) GROUP BY ALL)
      SELECT 'near' AS method, dz.query_id, ['hard', 'medium', 'easy'][dz.query_id % 3 + 1] AS difficulty, dz.query_id % 2 = 0 AS trap, positive_count, expected_ndcg_20, recall_20, recall_100, mrr, first_positive_rank::INT AS first_positive_rank, top20_has_positive, top100_has_positive, weak_top20, label AS diagnosis_label, bucket AS diagnosis_bucket, coalesce(p.ids, '') AS positive_doc_ids, coalesce(x.ids, '') AS missed_positive_doc_ids
      FROM dz LEFT JOIN p ON p.query_id = dz.query_id LEFT JOIN x ON x.query_id = dz.query_id""",
    "stream_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
      SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, sid""",
}

ORACLES["bm25_stored"] = ORACLES["bm25_topk"]
ORACLES["stored_term_counts"] = ORACLES["corpus_stats"]
