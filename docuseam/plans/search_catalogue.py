"""Registered queries of weight search and of profiles that fire, with their SQL for DuckDB."""

from __future__ import annotations


import json
import re

from pyspark.sql import functions as F

from ..config import SearchConfig
from ..constants import CONFLICT_FACTORS, DISPUTE_TERMS, NEGATION_CUES, NEGATION_LOOKBACK, NEGATION_SUFFIX, NEGATIVE_TERMS, REASON_TERMS, REJECT_TERMS, RELATION_TERMS, REQUEST_TERMS, REQUIRED_FACTORS, ROUTES, SECTION_TITLES, SUPPORT_TERMS
from ..functions.text import LAW_NAME, STATUTE
from ..operators import corpus, fusion, lexical, profile, rerank, results, tuning, upkeep
from ..session import drop_folder, kept, shared_folder
from ..streaming import rewrites
from . import search as plan
from .catalogue import ORACLES as SHARED
from .catalogue import _PICK, _Q, _bm25, _case, _CASE, _CHUNKS, _KNN, _QRELS, _TOK, SIZE, _chunks, _compact, _hits, _qrels, _queries, _query_vectors, _t

#: What is added to queries by their id, and to chunks by their document and place, so that profiles name terms and chunks hold them.
ASKED = ["。买卖合同纠纷中，返还定金是否应予支持？", "。出卖人未支付货款，《民法典》第五百九十五条如何认定", "；租赁合同纠纷，押金予以支持，违约金驳回。未开发票", ""]
HELD = [" 定金罚则 返还定金。", " 未支付货款，证据不足；未开票", " 没有约定定金罚则，发票", " 《民法典》第五百九十五条 买卖合同纠纷", ""]


def grid_metrics(spark, sf):
    """Measures of every query under every weight set of the grid."""
    return tuning.grid_metrics(_hits(spark, sf), _qrels(spark, sf), tuning.weight_sets(spark))


def grid_best(spark, sf):
    """The ten best weight sets, from hits to the choice."""
    return tuning.search_weights(_hits(spark, sf), _qrels(spark, sf), tuning.weight_sets(spark), 30)


def _fired_queries(spark, sf):
    told = F.concat("query_text", F.element_at(F.array(*[F.lit(x) for x in ASKED]), (F.col("query_id") % len(ASKED) + 1).cast("int")))
    focus = _t(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("focus_embedding"))  # that of the next vector
    return _query_vectors(spark, sf).withColumn("query_text", told).join(focus, "query_id", "left")


def _fired_chunks(spark, sf):
    more = F.element_at(F.array(*[F.lit(x) for x in HELD]), ((F.col("doc_id") + F.col("section_index")) % len(HELD) + 1).cast("int"))
    return _chunks(spark, sf).withColumn("chunk_text", F.concat("chunk_text", more))


def fired_profiles(spark, sf):
    """Profiles of queries that name terms, dispute points, negated facts, statutes and outcomes."""
    rows = profile.add_profile(_fired_queries(spark, sf))
    lists = ("reasons", "requests", "focus", "facts", "negatives", "relations", "statutes")
    return rows.select("query_id", *[F.array_join(f"profile.{k}", "|").alias(k) for k in lists], "profile.tendency")


def fired_routes(spark, sf):
    """All twelve routes of such profiles."""
    return profile.routes(profile.add_profile(_fired_queries(spark, sf)))


def fired_hits(spark, sf):
    """Hits of all twelve routes, each with its own text or vector, with the whole bonus."""
    return plan.route_hits(_fired_queries(spark, sf), _fired_chunks(spark, sf), _t(spark, sf, "embeddings"), SearchConfig(candidate_size=SIZE))


def fired_guardrails(spark, sf):
    """The engine's own guardrails, every query against the facts of the documents whose vector has its label."""
    chunks = _fired_chunks(spark, sf).where("section_type = 'facts'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_index", "chunk_text"))), lambda x: x["chunk_text"]), "\n").alias("doc"))
    queries = _fired_queries(spark, sf).select("query_id", "query_text", F.col("query_label").alias("label"))
    rows = queries.join(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "label").join(chunks, "doc_id")
    g = rerank.guardrail(F.col("query_text"), F.col("doc"))
    return rows.select("query_id", "doc_id", g.alias("g")).select("query_id", "doc_id", F.round("g.penalty", 6).alias("penalty"), F.round("g.bonus", 6).alias("bonus"), F.array_join("g.missing", ",").alias("missing"), F.array_join("g.conflicts", ",").alias("conflicts"))


class _Overlap:
    """A scorer of one's own that says what the built-in one says, by sets of words."""

    def __call__(self, query: str, passages: list[str]) -> list[float]:
        words = set(self.split(query))
        return [round(len(words & set(self.split(p))) / max(1, len(words)), 6) for p in passages]

    @staticmethod
    def split(text: str) -> list[str]:
        return re.findall(r"[^\W_]+", text.lower())


def scored_search(spark, sf):
    """Hybrid search with a scorer that is plugged in."""
    config = SearchConfig(top_k=10, candidate_size=SIZE, rerank=True, rerank_top_n=30)
    return plan.search(_query_vectors(spark, sf), _chunks(spark, sf), _t(spark, sf, "embeddings"), corpus.case_docs(_t(spark, sf, "documents")), config, scorer=_Overlap)


def prompt_payloads(spark, sf):
    """What a prompt takes of the ten best cases: their matched chunks, some with a context that names the judgment."""
    hits = _hits(spark, sf)
    ranked = fusion.case_rrf(hits).where("case_rank <= 10").select("query_id", "doc_id")
    title = F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTION_TITLES.items() for x in kv]), F.col("section_type"))
    context = F.when(F.col("section_index") % 3 == 0, F.concat(F.lit("判决如下："), "chunk_text"))
    texts = _chunks(spark, sf).select("chunk_id", F.struct("section_type", title.alias("section_title"), "chunk_text", context.alias("context_text")).alias("c"))
    listed = fusion.top_chunks(hits).join(ranked, ["query_id", "doc_id"], "left_semi").join(texts, "chunk_id").groupBy("query_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_rank", "c"))), lambda x: x["c"]).alias("chunks"))
    rows = results.prompt_payload(ranked.join(listed, ["query_id", "doc_id"], "left"))
    return rows.select("query_id", "doc_id", "claims", "facts", "reasoning", "judgment")


def chunk_rerank(spark, sf):
    """The first 20 chunks of every query's raw search in the order of the lexical scorer."""
    found = lexical.top_k(lexical.bm25_top(_queries(spark, sf), _chunks(spark, sf), 20), 20).drop("rank")
    texts = found.join(_chunks(spark, sf).select("chunk_id", "chunk_text"), "chunk_id").join(_queries(spark, sf), "query_id")
    scores = texts.select("query_id", "chunk_id", rerank.lexical_model_score(F.col("query_text"), F.col("chunk_text")).alias("model_score"))
    return rerank.rerank_chunks(found, scores, 20)


def upsert_table(spark, sf):
    """The last order of every customer, put into a stored table in three batches, the middle one twice."""
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    at = shared_folder(spark, "upsert")
    year = F.year("o_orderdate")
    for part in (year < 1995, year == 1995, year == 1995, year > 1995):
        upkeep.upsert_stored(upkeep.upsert(orders.limit(0), orders.where(part), "o_custkey", "at"), at, "o_custkey", "at")
    rows = kept(spark.read.parquet(at).select("o_custkey", "o_orderkey"))
    drop_folder(spark, at)
    return rows


def _echo():
    """A rewriter for the test tables: it fails on some texts, answers nonsense to others, and echoes the rest."""

    def answer(text: str) -> str:
        if len(text) % 5 == 0:
            raise TimeoutError(text)
        return "no answer" if len(text) % 7 == 0 else json.dumps({"legal_issue": text[:40], "focus_labels": [text[:10]]})

    return answer


def rewrite_cache(spark, sf):
    """Texts of conversations through the cache: first the opening turns, then all turns."""
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("query_text"))
    at = shared_folder(spark, "rewrites")
    rewrites.warm_cache(turns.where("turn = 0"), at, _echo, "openings").collect()
    rows = kept(rewrites.rewrite_through(turns, at, _echo, "all"))
    drop_folder(spark, at)
    return rows.select("conv_id", "turn", "cached", "rewrite.used", "rewrite.fallback_reason", "rewrite.legal_issue", F.array_join("rewrite.focus_labels", "|").alias("focus_labels"))


QUERIES = {f.__name__: f for f in (grid_metrics, grid_best, fired_profiles, fired_routes, fired_hits, fired_guardrails, rewrite_cache, scored_search, prompt_payloads, chunk_rerank, upsert_table)}


# --- SQL --------------------------------------------------------------------


def _sets() -> str:
    """The grid as a table, by its rule: presets first, then the product of the steps, each set of weights once."""
    rows = ", ".join(f"({i}, '{name}', '{route}', {float(w)!r}::DOUBLE)" for i, name, route, w in tuning.set_rows())
    return f"sets AS (SELECT * FROM (VALUES {rows}) t(set_id, name, route, w))"


_GRID = f"""{_CASE}, {_QRELS}, {_sets()},
bonus AS (SELECT query_id, doc_id, least(0.18::DOUBLE, 0.055::DOUBLE * kk) + least(0.10::DOUBLE, 0.05::DOUBLE * fk) + CASE WHEN tc >= 2 THEN 0.05::DOUBLE ELSE 0 END
  + least(0.10::DOUBLE, 0.015::DOUBLE * (route_count - 1)) + least(0.035::DOUBLE, 0.006::DOUBLE * (chunk_count - 1)) AS b FROM fused JOIN seen USING (query_id, doc_id)),
fs AS (SELECT set_id, query_id, doc_id, round(sum(w / (10 + route_rank)) + any_value(b) + 1e-9, 6) AS score FROM rc JOIN sets USING (route) JOIN bonus USING (query_id, doc_id) GROUP BY ALL),
fr AS (SELECT set_id, query_id, doc_id, row_number() OVER (PARTITION BY set_id, query_id ORDER BY score DESC, doc_id) AS rank FROM fs QUALIFY rank <= 100),
ideal AS (SELECT query_id, count(*) FILTER (grade >= 2) AS p, sum(CASE WHEN o <= 10 THEN (pow(2, gain) - 1) / log2(o + 1) ELSE 0 END) AS e10, sum(CASE WHEN o <= 20 THEN gain / log2(o + 1) ELSE 0 END) AS l20
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS o FROM qrels) GROUP BY ALL),
got AS (SELECT set_id, query_id, min(rank) FILTER (grade >= 2) AS first, count(*) FILTER (grade >= 2 AND rank <= 20) AS in20,
  sum(CASE WHEN rank <= 10 THEN (pow(2, coalesce(gain, 0)) - 1) / log2(rank + 1) ELSE 0 END) AS d10, sum(CASE WHEN rank <= 20 THEN coalesce(gain, 0) / log2(rank + 1) ELSE 0 END) AS d20 FROM fr LEFT JOIN qrels USING (query_id, doc_id) GROUP BY ALL),
gm AS (SELECT set_id::INT AS set_id, query_id, coalesce(p, 0) AS positive_count, round(d20 / nullif(l20, 0), 6) AS expected_ndcg_20, round(d10 / nullif(e10, 0), 6) AS ndcg_10,
  CASE WHEN p > 0 THEN round(coalesce(1.0 / first, 0)::DOUBLE, 6) END AS mrr, round(in20 / nullif(p, 0)::DOUBLE, 6) AS recall_20 FROM got LEFT JOIN ideal USING (query_id))"""

_pick = lambda values, at: f"[{', '.join(repr(v) for v in values)}][{at} % {len(values)} + 1]"
_any = lambda x, terms: "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"
_found = lambda terms, n="": f"list_filter([{', '.join(repr(t) for t in terms)}], lambda x: contains(raw, x)){n}"
_once = lambda xs: f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"
_having = lambda terms, n: f"list_filter(parts, lambda x: {_any('x', terms)})[1:{n}]"


def _chain(*xs: str) -> str:
    """All lists one after the other, as compact text."""
    whole = xs[0]
    for x in xs[1:]:
        whole = f"list_concat({whole}, {x})"
    return _compact(f"array_to_string({whole}, ' ')")


_PROFILE = f"""
fq AS (SELECT item_id AS query_id, text || {_pick(ASKED, 'item_id')} AS query_text FROM benchmark),
fr0 AS (SELECT query_id, query_text, {_compact('query_text')} AS raw FROM fq),
fc0 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(raw, '[。！？!?；;]+'), lambda x: {_compact("regexp_replace(x, '^[ ，,、]+|[ ，,、]+$', '', 'g')")}), lambda x: x <> '') AS cs,
  list_concat(regexp_extract_all(raw, '{STATUTE.replace(chr(92) + 'd', '0-9')}'), regexp_extract_all(raw, '{LAW_NAME}')) AS st FROM fr0),
fc AS (SELECT *, ({_once('cs')})[1:16] AS parts FROM fc0),
fp AS (SELECT query_id, query_text, raw, {_found(REASON_TERMS, '[1:4]')} AS reasons, {_found(REQUEST_TERMS, '[1:8]')} AS requests, {_having(DISPUTE_TERMS, 5)} AS focus,
  list_filter(parts, lambda x: NOT {_any('x', NEGATIVE_TERMS)} AND {_any('x', REQUEST_TERMS + RELATION_TERMS)})[1:6] AS facts, {_having(NEGATIVE_TERMS, 6)} AS negatives,
  {_found(RELATION_TERMS, '[1:8]')} AS relations, ({_once('st')})[1:8] AS statutes,
  CASE WHEN {_any('raw', SUPPORT_TERMS)} AND {_any('raw', REJECT_TERMS)} THEN '部分支持或需区分请求' WHEN {_any('raw', SUPPORT_TERMS)} THEN '支持请求' WHEN {_any('raw', REJECT_TERMS)} THEN '不支持请求' ELSE '' END AS tendency FROM fc)"""

_FIRED = f"""{_PROFILE},
fx AS (SELECT *, coalesce(nullif({_chain('focus', 'requests', 'facts', 'relations', 'reasons')}, ''), raw) AS said, {_chain('negatives', 'requests', 'relations', 'reasons')} AS negated, {_chain('reasons', 'relations', 'statutes', 'requests')} AS legal FROM fp),
rt AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{t}', {w}::DOUBLE, {repr(x) if x else 'NULL'}, {i})" for i, (n, t, w, x) in enumerate(ROUTES))}) v(route, route_type, weight, section_type, o)),
fy AS (SELECT query_id, route, route_type, weight, section_type, o, CASE route WHEN 'bm25_raw' THEN raw WHEN 'vector_raw' THEN raw WHEN 'bm25_focus' THEN nullif(said, raw) WHEN 'vector_focus' THEN nullif(said, raw) WHEN 'bm25_negative' THEN negated WHEN 'bm25_legal' THEN legal ELSE said END AS query FROM fx, rt),
froutes AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY o) - 1)::INT AS route_ord, route, route_type, weight, section_type, query FROM fy WHERE coalesce(query, '') <> '')"""

_TEXTS = f"""{_CHUNKS.replace("ch AS (SELECT *", f"ch AS (SELECT * REPLACE (chunk_text || {_pick(HELD, '(doc_id + section_index)')} AS chunk_text)")}"""
_FIRED_HITS = f"""{_TEXTS}, {_FIRED}, {_KNN},
texts AS (SELECT DISTINCT query FROM froutes WHERE route_type = 'bm25'),
tok AS (SELECT chunk_id AS id, unnest({_TOK.format(x='chunk_text')}) AS term FROM ch), tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT id, count(*) AS dl FROM tok GROUP BY ALL),
stt AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), tq AS (SELECT DISTINCT query, unnest({_TOK.format(x='query')}) AS term FROM texts),
bmx AS (SELECT query, id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tq JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (id), stt GROUP BY ALL),
lex AS (SELECT r.query_id, route, weight, chunk_id, ch.doc_id, ch.section_type, score FROM froutes r JOIN bmx USING (query) JOIN ch USING (chunk_id) WHERE route_type = 'bm25' AND (r.section_type IS NULL OR r.section_type = ch.section_type)
  QUALIFY row_number() OVER (PARTITION BY r.query_id, route ORDER BY score DESC, chunk_id) <= {SIZE}),
nv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON item_id + 1 = vec_id),
ns AS (SELECT query_id, vec_id, round((1 + list_cosine_similarity(e, embedding::DOUBLE[])) / 2, 6) AS score FROM nv, embeddings),
nk AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ns),
vec AS (SELECT query_id, route, weight, printf('%d#header#00#000', vec_id) AS chunk_id, vec_id AS doc_id, 'header' AS section_type, score
  FROM (SELECT *, 'vector_raw' AS route FROM knn UNION ALL BY NAME SELECT *, 'vector_focus' AS route FROM nk) JOIN (SELECT query_id, route, weight FROM froutes) USING (query_id, route) WHERE rank <= {SIZE}),
held AS (SELECT h.*, coalesce({_compact('ch.chunk_text')}, '') AS body, coalesce(ch.lang, '') AS reason FROM (SELECT * FROM lex UNION ALL SELECT * FROM vec) h LEFT JOIN (SELECT chunk_id, chunk_text, lang FROM ch) ch USING (chunk_id)),
fh AS (SELECT query_id, route, weight, chunk_id, doc_id, section_type, round(score + greatest(-0.05::DOUBLE, least(0.28::DOUBLE,
  CASE WHEN section_type IN ('fine_tags', 'focus_tags', 'defense', 'judgment') THEN 0.03::DOUBLE WHEN section_type IN ('fine_rule', 'focus_analysis') THEN 0.02::DOUBLE WHEN section_type IN ('reasoning', 'facts') THEN 0.04::DOUBLE WHEN section_type IN ('header', 'statutes') THEN -0.03::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN len(list_filter(reasons, lambda x: x = reason OR contains(body, x))) > 0 THEN 0.08::DOUBLE ELSE 0::DOUBLE END + CASE WHEN len(list_filter(relations, lambda x: contains(body, x))) > 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN len(list_filter(requests, lambda x: contains(body, x))) > 0 THEN 0.04::DOUBLE ELSE 0::DOUBLE END + CASE WHEN len(negatives) > 0 AND {_any('body', NEGATIVE_TERMS)} THEN 0.12::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN len(list_filter(negatives, lambda x: contains(body, x))) > 0 THEN 0.06::DOUBLE ELSE 0::DOUBLE END + CASE WHEN len(list_filter(statutes, lambda x: contains(body, x))) > 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END)), 6) AS score FROM held JOIN fp USING (query_id))"""


def _positive(text: str, terms: list[str]) -> str:
    """Whether one of the terms occurs without a negation before it: cut the text at the term and look at the end of every part but the last."""
    before = "regexp_replace(right(array_to_string(string_split({t}, '{x}')[1:i], '{x}'), {n}), '\\s+', '', 'g')"
    one = []
    for x in terms:
        w = before.format(t=text, x=x, n=NEGATION_LOOKBACK)
        one.append(f"(contains({text}, '{x}') AND len(list_filter(range(1, len(string_split({text}, '{x}'))), lambda i: NOT ({_any(w, NEGATION_CUES)} OR ends_with({w}, '{NEGATION_SUFFIX}')))) > 0)")
    return "(" + " OR ".join(one) + ")" if one else "false"


def _cut(x: str, limit: int = results.PROMPT_CHARS) -> str:
    whole = _compact(x)
    return f"CASE WHEN length({whole}) > {limit} THEN {whole}[1:{limit - 1}] || '…' ELSE {whole} END"


def _factor(k: int, f: dict, required: bool) -> str:
    """The pairs that a factor applies to, and whether it speaks against them."""
    asked = _any("asked", f["query_any"]) + "".join(f" AND contains(asked, '{t}')" for t in f.get("query_all", []))
    has = _positive("doc", f["doc_any"])
    bad = f"NOT {has}" if required else f"{has} AND NOT {_positive('doc', f.get('absent', []))}"
    return f"SELECT query_id, doc_id, {k} AS o, '{f['name']}' AS name, {required} AS required, {f['penalty']}::DOUBLE AS penalty, {bad} AS bad FROM g0 WHERE {asked}"


_FACTORS = [*((f, True) for f in REQUIRED_FACTORS), *((f, False) for f in CONFLICT_FACTORS)]
_GUARDED = f"""{_TEXTS}, fq AS (SELECT item_id AS query_id, text || {_pick(ASKED, 'item_id')} AS query_text FROM benchmark), {_KNN},
gd AS (SELECT doc_id, string_agg(chunk_text, chr(10) ORDER BY section_index) AS doc FROM ch WHERE section_type = 'facts' GROUP BY doc_id),
g0 AS (SELECT query_id, gd.doc_id, {_compact('query_text')} AS asked, doc FROM fq JOIN qv USING (query_id) JOIN embeddings ON label = query_label JOIN gd ON gd.doc_id = vec_id),
g1 AS ({' UNION ALL '.join(_factor(k, f, r) for k, (f, r) in enumerate(_FACTORS))}),
g2 AS (SELECT query_id, doc_id, least(0.35::DOUBLE, coalesce(sum(penalty) FILTER (bad), 0)) AS penalty, count(*) FILTER (required AND NOT bad) AS matched, count(*) FILTER (bad) AS wrong,
  coalesce(string_agg(name, ',' ORDER BY o) FILTER (bad AND required), '') AS missing, coalesce(string_agg(name, ',' ORDER BY o) FILTER (bad AND NOT required), '') AS conflicts FROM g1 GROUP BY ALL)"""

ORACLES = {
    "grid_metrics": f"WITH {_GRID} SELECT * FROM gm",
    "grid_best": f"""WITH {_GRID}, r AS (SELECT set_id, count(*) FILTER (positive_count > 0) AS queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in tuning.JUDGED)} FROM gm GROUP BY ALL),
o AS (SELECT *, round(0.5::DOUBLE * coalesce(expected_ndcg_20, 0) + 0.15::DOUBLE * coalesce(ndcg_10, 0) + 0.35::DOUBLE * coalesce(mrr, 0) + 1e-9, 6) AS objective FROM r)
SELECT o.*, name FROM (SELECT * FROM o WHERE queries >= 30 OR NOT (SELECT max(queries) >= 30 FROM o) ORDER BY objective DESC, set_id LIMIT 10) o JOIN (SELECT DISTINCT set_id, name FROM sets) USING (set_id)""",
    "fired_profiles": f"WITH {_PROFILE} SELECT query_id, {', '.join(f"array_to_string({k}, '|') AS {k}" for k in ('reasons', 'requests', 'focus', 'facts', 'negatives', 'relations', 'statutes'))}, tendency FROM fp",
    "fired_routes": f"WITH {_FIRED} SELECT * FROM froutes",
    "fired_hits": f"WITH {_FIRED_HITS} SELECT * FROM fh",
    "prompt_payloads": f"""WITH {_CASE}, top AS (SELECT query_id, doc_id FROM cs WHERE case_rank <= 10), tc AS (SELECT query_id, doc_id, chunk_id, {_PICK.format(o='score DESC, chunk_id')} AS chunk_rank FROM merged QUALIFY chunk_rank <= 3),
tx AS (SELECT query_id, doc_id, chunk_rank AS r, ch.section_type AS kind, {_case('ch.section_type', SECTION_TITLES, None)} AS title, {_cut('chunk_text')} AS t, {_cut("CASE WHEN section_index % 3 = 0 THEN '判决如下：' || chunk_text ELSE chunk_text END")} AS around FROM tc JOIN top USING (query_id, doc_id) JOIN ch USING (chunk_id)),
tg AS (SELECT query_id, doc_id, arg_min(t, r) FILTER (kind = 'claims') AS claims, arg_min(t, r) FILTER (kind = 'facts') AS facts, arg_min(t, r) FILTER (kind = 'reasoning') AS reasoning, arg_min(t, r) FILTER (kind = 'judgment') AS judgment,
  arg_min(around, r) FILTER (contains(title, '本院认为') OR contains(around, '本院认为')) AS r2, arg_min(around, r) FILTER (contains(title, '裁判结果') OR contains(around, '判决如下') OR contains(around, '裁定如下')) AS j2 FROM tx GROUP BY ALL)
SELECT query_id, doc_id, coalesce(claims, '') AS claims, coalesce(facts, '') AS facts, coalesce(reasoning, r2, '') AS reasoning, coalesce(judgment, j2, '') AS judgment FROM top LEFT JOIN tg USING (query_id, doc_id)""",
    "chunk_rerank": f"""WITH {_CHUNKS}, {_Q}, {_bm25('ch', 'chunk_id', 'chunk_text', 'q', 'bm')}, h AS (SELECT query_id, id AS chunk_id, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
s AS (SELECT query_id, chunk_id, score AS pre_rerank, list_distinct({_TOK.format(x='query_text')}) AS wq, {_TOK.format(x='chunk_text')} AS wt FROM h JOIN ch USING (chunk_id) JOIN q USING (query_id)),
m AS (SELECT query_id, chunk_id, pre_rerank, round(len(list_intersect(wq, wt)) / greatest(1, len(wq)), 6) AS score FROM s)
SELECT query_id, chunk_id, score, pre_rerank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM m""",
    "scored_search": SHARED["hybrid_search"],
    "upsert_table": SHARED["cache_upsert"],
    "fired_guardrails": f"""WITH {_GUARDED} SELECT query_id, doc_id, round(coalesce(penalty, 0), 6) AS penalty, round(CASE WHEN matched > 0 AND wrong = 0 THEN least(0.02::DOUBLE, 0.008::DOUBLE * matched) ELSE 0 END, 6) AS bonus, coalesce(missing, '') AS missing, coalesce(conflicts, '') AS conflicts
FROM g0 LEFT JOIN g2 USING (query_id, doc_id)""",
    "rewrite_cache": """WITH c AS (SELECT conv_id, turn, text, length(text) AS n, trim(text) = '' AS blank FROM conversations), o AS (SELECT DISTINCT text FROM c WHERE turn = 0 AND n % 5 <> 0 AND n % 7 <> 0 AND NOT blank),
u AS (SELECT *, NOT blank AND n % 5 <> 0 AND n % 7 <> 0 AS used FROM c)
SELECT conv_id, turn, text IN (SELECT text FROM o) AS cached, used, CASE WHEN used THEN '' WHEN blank THEN 'empty_query' WHEN n % 5 = 0 THEN 'llm_error:TimeoutError' ELSE 'invalid_json' END AS fallback_reason,
  CASE WHEN used THEN """ + _compact("substring(text, 1, 40)") + """ ELSE '' END AS legal_issue, CASE WHEN used THEN """ + _compact("substring(text, 1, 10)") + """ ELSE '' END AS focus_labels FROM u""",
}
