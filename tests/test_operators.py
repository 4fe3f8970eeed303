import math

from pyspark.sql import functions as F

from docuseam.config import ADVISOR, SearchConfig
from docuseam.functions import text as tx
from docuseam.operators import corpus, details, evaluation, fusion, lexical, profile, rerank, results, tuning, upkeep, vector
from docuseam.sources import io
from docuseam.streaming import incremental


def one(df):
    return df.collect()[0]


def run_of(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, rank int")


QRELS = [("q", "A", 3, 3.0), ("q", "B", 2, 2.0), ("q", "C", 1, 1.0)]


def test_graded_metrics_after_dedup(spark):
    run = evaluation.dedup_run(run_of(spark, [("q", x, i) for i, x in enumerate(["B", "X", "A", "B", "C", None, " "], 1)]))
    m = one(evaluation.query_metrics(run, spark.createDataFrame(QRELS, "query_id string, doc_id string, grade int, gain double")))
    gains, ideal = [2, 0, 3, 1], [3, 2, 1]
    dcg = lambda g, f: sum(f(x) / math.log2(i + 2) for i, x in enumerate(g))
    assert abs(m.ndcg_10 - dcg(gains, lambda x: 2**x - 1) / dcg(ideal, lambda x: 2**x - 1)) < 1e-5
    assert abs(m.expected_ndcg_20 - dcg(gains, float) / dcg(ideal, float)) < 1e-5
    assert (m.positive_count, m.first_positive_rank, m.mrr, m.recall_20) == (2, 1, 1.0, 1.0)
    assert abs(m.map - (1 + 2 / 3) / 2) < 1e-5


def test_metrics_without_positives_are_null(spark):
    m = one(evaluation.query_metrics(run_of(spark, [("q", "A", 1)]), spark.createDataFrame([("q", "B", 1, 0.0)], "query_id string, doc_id string, grade int, gain double")))
    assert m.recall_20 is None and m.mrr is None and m.ndcg_10 is None and m.positive_count == 0


def test_diagnosis_order(spark):
    rows = spark.createDataFrame([(0, False, False, None, 0, None), (3, False, False, None, 0, 0.1), (3, True, False, 30, 0, 0.1), (3, True, True, 8, 12, 0.52), (3, True, True, 12, 0, 0.9), (3, True, True, 1, 0, 0.5), (3, True, True, 1, 0, 0.9)], "p int, a boolean, b boolean, f int, w int, e double")
    got = [r.x for r in rows.select(evaluation.diagnosis(*[F.col(c) for c in "pabfwe"]).alias("x")).collect()]
    assert got == ["no_positive", "recall_failure", "ranking_failure", "front_pollution", "late_positive", "low_alignment", "good"]


def test_negation_before_a_term(spark):
    rows = spark.createDataFrame([("本案未涉及发票问题",), ("双方因发票发生争议",), ("未涉及发票。此后因为双方交易往来关系复杂多次协商不成，发票仍有争议",), ("",)], "t string")
    assert [r.x for r in rows.select(rerank.positive_hit(F.col("t"), F.lit("发票")).alias("x")).collect()] == [False, True, True, False]


def test_guardrail_penalty_and_bonus(spark):
    rows = spark.createDataFrame([("请求适用定金罚则", "合同约定定金罚则"), ("请求适用定金罚则", "仅涉及货款"), ("无关", "无关")], "q string, d string")
    got = [r.g for r in rows.select(rerank.guardrail(F.col("q"), F.col("d")).alias("g")).collect()]
    assert got[0].bonus == 0.008 and got[0].penalty == 0.0
    assert got[1].penalty == 0.12 and got[1].missing == ["deposit_penalty"]
    assert got[2].penalty == 0.0 and got[2].bonus == 0.0


def test_profile_and_routes(spark):
    q = spark.createDataFrame([(1, "买卖合同纠纷中卖方未交付货物，是否应当返还定金？原告主张违约金。"), (2, "hello")], "query_id int, query_text string")
    p = {r.query_id: r.profile for r in profile.add_profile(q).collect()}
    assert p[1].reasons == ["买卖合同纠纷"] and "返还" in p[1].requests and p[1].negatives and p[2].focus == []
    names = {}
    for r in profile.routes(profile.add_profile(q)).orderBy("route_ord").collect():
        names.setdefault(r.query_id, []).append(r.route)
    assert names[1][:4] == ["bm25_raw", "vector_raw", "bm25_focus", "vector_focus"] and "bm25_negative" in names[1]
    assert names[2] == ["bm25_raw", "vector_raw", "bm25_fine_tags", "bm25_fine_rule", "bm25_focus_tags", "bm25_focus_analysis", "bm25_reasoning", "bm25_facts"]


def test_rewrite_changes_queries_not_names(spark):
    kind = "query_id int, query_text string, rw struct<used:boolean,legal_issue:string,main_leaf:string,statutes:string,fact_elements:string,expanded_query:string,focus_labels:array<string>>"
    q = spark.createDataFrame([(1, "hello", (True, "issue", "leaf", "law", "facts", "expanded", ["a", "b"]))], kind)
    got = {r.route: r["query"] for r in profile.routes(profile.add_profile(q), "rw").collect()}
    assert got["bm25_focus"] == "expanded" and got["bm25_fine_tags"] == "issue leaf a b" and got["bm25_facts"] == "facts" and got["bm25_legal"] == "issue law leaf"


def test_rank_safe_bounds_promotion(spark):
    rows = spark.createDataFrame([("q", 1, 40, 1, 0.9, ["reasoning"], False), ("q", 2, 1, 2, 0.8, ["reasoning"], False)], "query_id string, doc_id int, case_rank int, rerank_rank int, fused_score double, sections array<string>, flagged boolean")
    got = {r.doc_id: (r.safe_score, r.safe_rank) for r in rerank.rank_safe(rows, 20).collect()}
    assert got == {1: (0.425, 2), 2: (0.8, 1)}


def test_splitters():
    text = "一。" * 1000
    parts = corpus.split_text(text, 900, 120)
    assert all(len(p) <= 900 for p in parts) and parts[0].endswith("。")
    assert corpus.pack(["aa", "bb", "cccc", "d"], 5, 0) == ["aa\nbb", "cccc", "d"] and corpus.pack(["aa", "bb" * 4, "c"], 5, 0) == ["aa", "bbbbb", "bbb", "c"]
    assert corpus.merge_short_heads(["短", "这是一段足够长的文字内容在此"]) == ["短这是一段足够长的文字内容在此"]
    assert corpus.split_section("facts", "起因。2020年1月1日签约。2021年2月3日交货。") == ["起因。\n2020年1月1日签约。\n2021年2月3日交货。"]


def test_split_sections_in_spark(spark):
    rows = spark.createDataFrame([(1, "claims", "x" * 1600), (2, "reasoning", None)], "doc_id int, section_type string, section_text string")
    got = corpus.split_sections(rows).collect()
    assert [(r.doc_id, len(r.chunk_text)) for r in got] == [(1, 760), (1, 760), (1, 80)]


def test_scalars(spark):
    r = one(spark.createDataFrame([(" a　b \n", "x\n\n y ", "3.7", " 3 ")], "a string, b string, c string, d string").select(tx.compact(F.col("a")).alias("a"), tx.clean_lines(F.col("b")).alias("b"), tx.int_or_null(F.col("c")).alias("c"), tx.int_or_null(F.col("d")).alias("d"), tx.compact(F.lit("abcdef"), 4).alias("e")))
    assert tuple(r) == ("a b", "x\ny", None, 3, "abc…")


def test_knn_empty_and_ties(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in vector.knn(q, v, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert vector.knn(q.limit(0), v, 2).count() == 0


def test_upkeep_and_citations(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("c", 1)], "k string, v int")
    assert {(r.k, r.v) for r in upkeep.upsert(old, new, "k", "v").collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert [r.k for r in upkeep.pending(new, old, "k").collect()] == ["c"]
    a = spark.createDataFrame([("q", [3, 9, 3, 1]), ("r", [9])], "query_id string, cited array<int>")
    b = spark.createDataFrame([("q", 1), ("q", 3)], "query_id string, doc_id int")
    assert [(r.query_id, r.cited) for r in results.valid_citations(a, b).collect()] == [("q", [3, 1])]


def test_grid(spark):
    sets = tuning.weight_sets(spark)
    assert sets.select("set_id").distinct().count() == 391  # 384 of the grid and 8 presets, one of which is in the grid
    got = {r.route: r.weight for r in sets.where("name = 'vector_up'").collect()}
    assert len(got) == 12 and (got["vector_raw"], got["vector_focus"], got["bm25_raw"]) == (1.2, 1.3, 1.0)


def test_sources(spark, tmp_path):
    p = tmp_path / "qrels.jsonl"
    p.write_text('{"query_id":"q","candidates":[{"doc_id":"a","grade_主档":2,"grade_期望":1.5},{"doc_id":"a","grade_主档":3}]}\n\n', "utf-8")
    assert [tuple(r) for r in io.read_qrels(spark, str(p)).collect()] == [("q", "a", 3, 3.0, None)]
    t = tmp_path / "qrels.txt"
    t.write_text("q 0 a 2\n\nq 0 b x\n")
    assert [tuple(r) for r in io.read_trec_qrels(spark, str(t)).collect()] == [("q", "a", 2), ("q", "b", None)]
    r = tmp_path / "run.jsonl"
    r.write_text('{"query_id":"q","ranking":["x"]}\n{"query_id":"q","ranking":["b","a"]}\n')
    assert [tuple(x) for x in io.read_run(spark, str(r)).collect()] == [("q", "b", 1), ("q", "a", 2)]
    assert io.count_lines(spark, str(t)) == 2
    j = tmp_path / "rows.jsonl"
    j.write_text('{"a":1}\n\n{"a":2}\n{"a":3}\n')
    assert [x.a for x in io.read_jsonl_head(spark, str(j), "a int", 3).collect()] == [1, 2]
    assert io.read_json_object(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert io.first_existing(spark, str(tmp_path / "none"), str(j)) == str(j) and io.first_existing(spark, "x", "y") == "x"


def test_config():
    assert ADVISOR.rerank_weight == 0.35 and SearchConfig(rerank_weight=3).validate().rerank_weight == 1.0
    try:
        SearchConfig(mode="x").validate()
    except ValueError:
        return
    raise AssertionError


def test_stream_appends_each_row_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    rows.write.parquet(src)
    go = lambda: incremental.enrich_new(spark, src, rows.schema, out, state, "k", lambda d: d.withColumn("n", F.length("t"))).awaitTermination()
    go()
    rows.union(spark.createDataFrame([(3, "ccc")], "k int, t string")).write.mode("append").parquet(src)
    go()
    assert sorted((r.k, r.n) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_pleadings_and_details(spark):
    text = "原告张三诉称：货款未付。\n被告李四辩称：已付清。第三人王五述称：不知情。当事人围绕诉讼请求依法提交了证据，略。"
    got = one(spark.range(1).select(corpus.pleading_sections(F.lit(text)).alias("s"), corpus.pleading_sections(F.lit("无标记")).alias("t")))
    assert [(x.section_type, x.section_text) for x in got.s] == [("claims", "原告张三诉称：货款未付。"), ("defense", "被告李四辩称：已付清。"), ("defense", "第三人王五述称：不知情。")]
    assert [(x.section_type, x.section_text) for x in got.t] == [("claims", "无标记")]
    sections = one(spark.range(1).select(details.text_sections(F.lit("上海法院。经审理查明：甲。本院认为：乙。判决如下：丙。")).alias("s"))).s
    assert [(x.id, x.content) for x in sections] == [("header", "上海法院。"), ("facts", "经审理查明：甲。"), ("reasoning", "本院认为：乙。"), ("judgment", "判决如下：丙。")]
    assert one(spark.range(1).select(details.draft(F.lit("思考……观点一：甲。整体判断：乙")).alias("d"))).d == "观点一：甲。整体判断：乙"
    r = one(spark.range(1).select(details.parse_rewrite(F.lit('{"expanded_query": "' + "长" * 200 + '", "legal_issue": ["x"], "focus_labels": ["ok", 3, " ", "ok"]}')).alias("r"))).r
    assert (r.expanded_query, r.legal_issue, r.focus_labels, r.used, r.fallback_reason) == ("", "", ["ok"], True, "")


def test_best_chunks_fill_by_law_then_score(spark):
    rows = [("facts", "a", 9.0), ("facts", "b", 8.0), ("reasoning", "c", 1.0), ("reasoning", "d", 0.5), ("other", "e", 7.0)]
    hits = spark.createDataFrame([("q", 1, c, s, x, "bm25_raw") for s, c, x in rows], "query_id string, doc_id int, chunk_id string, section_type string, score double, route string")
    picked = [r.chunk_id for r in fusion.best_per_section(hits, 5).orderBy("pick").collect()]
    assert picked == ["c", "a", "d", "b", "e"]


def test_bm25_blocks_match_pairs(spark):
    """Scores of blocks of queries against the formula, with empty texts, repeated terms and groups."""
    texts = ["a b b c", "a a", "", None, "c c c d", "b", "a b c d e f"]
    rows = spark.createDataFrame([(f"k{i}", t, "x" if i % 2 else "y") for i, t in enumerate(texts)], "chunk_id string, chunk_text string, g string")
    queries = spark.createDataFrame([(1, "b c b"), (2, "a"), (3, "zzz"), (4, None)], "query_id long, query_text string")
    words = {f"k{i}": (t or "").split() for i, t in enumerate(texts) if t}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    want = {}
    for q, terms in ((1, "bc"), (2, "a")):
        for k, w in words.items():
            s = sum(math.log(1 + (n - df + 0.5) / (df + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if (df := sum(t in v for v in words.values())))
            if s:
                want[(q, k)] = round(s, 6)
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25_top(queries, rows, 10, group="g").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert {(r.query_id, r.chunk_id) for r in lexical.top_k(lexical.bm25_top(queries, rows, 1), 1).collect()} == {(q, max((k for k in want if k[0] == q), key=lambda k: (want[k], k))[1]) for q in (1, 2)}
    assert lexical.bm25_top(queries.limit(0), rows, 3).count() == 0 and lexical.bm25_top(queries, rows.limit(0), 3).count() == 0


def test_chunk_spans(spark):
    text = "aa\nbb cc\naa\ndd"
    chunks = F.array(*[F.struct(F.lit(k).alias("chunk_id"), F.lit(c).alias("chunk_text")) for k, c in (("1", "aa"), ("2", "aa"), ("3", "bb"), ("4", "cc\n dd "), ("5", "none"))])
    got = one(spark.range(1).select(corpus.chunk_spans(F.lit(text), chunks).alias("s"))).s
    assert [(x.start, x.end) for x in got] == [(0, 2), (9, 11), (3, 5), (6, 14), (0, 4)]


def test_words_on_bytes_are_those_of_the_regular_expression(spark):
    texts = ["Ein Übermaß, 3½ mal!", "", "a_b—c…d́e 东京都。東京", None, "x", "z\U0001d400z \U0001f600 9", "naïve\nCAFÉ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    want = [(r.i, w) for r in rows.select("i", tx.tokens(F.col("t")).alias("w")).collect() for w in r.w]
    batch = rows.select(F.lower(tx.or_empty(F.col("t"))).alias("t")).toArrow()["t"].combine_chunks()
    for some in (batch, batch.slice(2, 4)):
        owner, words = lexical._words(some, lexical.letters())
        low = 0 if some is batch else 2
        assert [(int(o) + low, w) for o, w in zip(owner, words.to_pylist())] == [x for x in want if low <= x[0] < low + len(some)]


def test_a_task_passes_on_its_last_best_only(spark, monkeypatch):
    """Scores that were among the best for a while, but not in the end, are not shuffled; blocks of queries and of products change nothing."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = spark.createDataFrame([(f"k{i:03}", " ".join(["a"] * (i + 1) + ["b"] * 40), "xy"[i % 2]) for i in range(60)], "chunk_id string, chunk_text string, g string").coalesce(1)
    queries = spark.createDataFrame([(1, "a"), (2, "a b")], "query_id long, query_text string")
    monkeypatch.setattr(lexical, "bounded_batches", lambda spark: None)
    plain = sorted(map(tuple, lexical.bm25_top(queries, rows, 2, group="g").collect()))
    assert len(plain) <= 2 * 2 * 3
    for name, value in (("HELD_ROWS", 8), ("PRODUCTS", 3), ("BLOCK_QUERIES", 1), ("BLOCK_TERMS", 1)):
        monkeypatch.setattr(lexical, name, value)
    by = ("query_id", "g")
    got = lexical.top_k(lexical.bm25_top(queries, rows, 2, group="g"), 2, by).drop("rank").collect()
    want = lexical.top_k(spark.createDataFrame(plain, "query_id long, chunk_id string, g string, score double"), 2, by).drop("rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
