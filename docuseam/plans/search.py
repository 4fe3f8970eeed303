"""Hybrid search of all queries in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..config import SearchConfig
from ..constants import CASE_KEY_SECTIONS
from ..operators import fusion, lexical, profile, rerank, results, stored_index, vector
from ..session import kept

#: Hits up to this many rows are small enough to be broadcast to the chunks they name.
SMALL_ROWS = 200_000


#: Folders of postings that are made for one search.
FEW_FOLDERS = 4


#: The routes that take a query as it is.
RAW_ROUTES = ("bm25_raw", "vector_raw")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """The frame with a broadcast hint if its bound of rows allows it; else a shuffle joins it."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def _doc(chunk_id: Column, kind: DataType) -> Column:
    """The case of a chunk: what stands before its section and numbers, in the type of the cases' ids."""
    return F.regexp_replace(chunk_id, r"#[^#]*#[^#]*#[^#]*\z", "").cast(kind)


def query_routes(queries: DataFrame, config: SearchConfig, rewrite: str | None = None) -> DataFrame:
    """The routes of every query's profile with the weights of the settings.

    ``text_id`` names a query's text: routes with the same text share its search.
    """
    rows = profile.routes(profile.add_profile(queries), rewrite if config.profiles else None)
    if not config.profiles:
        rows = rows.where(F.col("route").isin(*RAW_ROUTES))
    given = F.create_map(*[F.lit(x) for kv in (config.route_weights or {"": 0.0}).items() for x in (kv[0], float(kv[1]))])
    same = Window.partitionBy("query_id", "query")
    lead = F.min("route_ord").over(same).cast("string")
    return rows.withColumn("weight", F.coalesce(F.try_element_at(given, F.col("route")), F.col("weight"))).withColumn("text_id", F.concat_ws(":", F.col("query_id").cast("string"), lead))


def route_hits(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, config: SearchConfig, rewrite: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Hits of all routes of the queries' profiles: query_id, route, weight, chunk_id, doc_id, section_type, score.

    ``queries``: query_id, query_text, embedding and, for the focus route of the
    vectors, focus_embedding; ``rewrite`` names a struct as in ``profile.routes``.
    Each distinct text of a query is scored once; its best chunks are taken for
    the routes over all sections, and per section for the section routes. The
    profile's bonus is added to a route's candidates afterwards. ``index``: stored
    postings of the chunks in ``FEW_FOLDERS`` folders, which are searched in place
    of their texts. Document
    vectors hit their document as a whole, as section ``header``.
    """
    size, parts = config.candidate_size, []
    asked = kept(query_routes(queries, config, rewrite))  # several steps below read them
    bound = asked.count() * size
    if config.mode in ("hybrid", "bm25"):
        lexed = asked.where("route_type = 'bm25'")
        texts = lexed.select(F.col("text_id").alias("query_id"), F.col("query").alias("query_text")).distinct()
        scored = lexical.bm25_top(texts, chunks, size, group="section_type") if index is None else stored_index.bm25_stored(index, texts, size, group="section_type", folders=FEW_FOLDERS)
        scored = scored.withColumnRenamed("query_id", "text_id")
        mine = lexed.select("text_id", "query_id", "route", "weight", F.col("section_type").alias("wanted"))
        best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("chunk_id"))) <= size
        # one shuffle by the text serves both ranks
        scored = scored.repartition("text_id").withColumn("whole", best("text_id")).withColumn("own", best("text_id", "section_type")).where("whole OR own")
        hit = F.when(F.col("wanted").isNull(), F.col("whole")).otherwise((F.col("wanted") == F.col("section_type")) & F.col("own"))
        found = scored.join(mine, "text_id").where(hit)
        parts.append(found.select("query_id", "route", "weight", "chunk_id", _doc(F.col("chunk_id"), chunks.schema["doc_id"].dataType).alias("doc_id"), "section_type", "score"))
    if config.mode in ("hybrid", "vector"):
        for route, column in (("vector_raw", "embedding"), ("vector_focus", "focus_embedding")):
            if column not in queries.columns:
                continue
            found = vector.knn(queries.select("query_id", F.col(column).alias("embedding")), vectors, size)
            found = found.join(asked.where(F.col("route") == route).select("query_id", "route", "weight"), "query_id")
            parts.append(found.select("query_id", "route", "weight", F.concat(F.col("vec_id").cast("string"), F.lit("#header#00#000")).alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.lit("header").alias("section_type"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_bonus(out, queries, chunks, bound) if config.profiles and config.bonus else out


def with_bonus(hits: DataFrame, queries: DataFrame, chunks: DataFrame, bound: int) -> DataFrame:
    """Add the profile's bonus to every hit's score. ``bound``: at most so many hits there are."""
    named = _small(hits.select("chunk_id").distinct(), bound)
    told = chunks.join(named, "chunk_id", "left_semi").select("chunk_id", "chunk_text", F.col("lang").alias("reason"))
    rows = hits.join(told, "chunk_id", "left").join(profile.add_profile(queries.select("query_id", "query_text")).drop("query_text"), "query_id")
    bonus = profile.profile_bonus(F.col("profile"), F.coalesce("chunk_text", F.lit("")), F.coalesce("reason", F.lit("")), F.col("section_type"), F.lit(None).cast("array<string>"))
    return rows.withColumn("score", F.round(F.col("score") + bonus, 6)).select(*hits.columns)


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, cases: DataFrame, config: SearchConfig = SearchConfig(), rewrite: str | None = None, index: DataFrame | None = None, scorer: rerank.Factory | None = None) -> DataFrame:
    """Ranked cases of every query with their fields. ``index``: as in ``route_hits``; nothing reads it after the call. ``scorer``: as in ``reranked``."""
    config = config.validate()
    hits = kept(route_hits(queries, chunks, vectors, config, rewrite, index))  # several steps below read them
    ranked = fusion.case_rrf(hits, config.chunk_top_k)
    if config.rerank:
        ranked = reranked(hits, ranked, queries, chunks, cases, config, rewrite, scorer)
    return results.result_entries(ranked, cases, config.top_k)


def case_chunks(hits: DataFrame, head: DataFrame, chunks: DataFrame, per_case: int = 8, bound: int = SMALL_ROWS + 1) -> DataFrame:
    """What the reranker may read of a query's head cases: their hit chunks and their key chunks, each once, with text.

    Key chunks are those of the key sections in order of case and place, so many
    per case on average; looked up, not searched, they have score 0. ``bound``:
    at most so many rows ``head`` has. Chunks are read once.
    """
    named = _small(head.select("query_id", "doc_id"), bound)
    every = chunks.select("doc_id", "chunk_id", "section_type", "section_index", "chunk_text").join(named, "doc_id")
    key = F.col("section_type").isin(CASE_KEY_SECTIONS)
    turn = F.row_number().over(Window.partitionBy("query_id", key).orderBy("doc_id", "section_index", "chunk_id"))
    most = F.size(F.collect_set("doc_id").over(Window.partitionBy("query_id"))) * per_case  # a head has a bounded number of cases
    looked_up = every.withColumn("is_key", key & (turn <= most)).drop("section_index")
    own = fusion.merged_chunks(hits).join(named, ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "chunk_id", F.col("section_type").alias("hit_type"), "score")
    both = looked_up.join(own, ["query_id", "doc_id", "chunk_id"], "full").where("is_key OR score IS NOT NULL")
    return both.select("query_id", "doc_id", "chunk_id", F.coalesce("section_type", "hit_type").alias("section_type"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("chunk_text", F.lit("")).alias("chunk_text"))


def reranked(hits: DataFrame, ranked: DataFrame, queries: DataFrame, chunks: DataFrame, cases: DataFrame, config: SearchConfig, rewrite: str | None = None, scorer: rerank.Factory | None = None) -> DataFrame:
    """Rerank the head by passages, structure and guardrails, with bounded promotion.

    ``rewrite``: as in ``route_hits``. ``scorer`` makes what judges a query's
    passages, see ``rerank.model_scores``; without one a lexical score does. A
    query whose scorer fails keeps the order that it has.
    """
    most = max(config.top_k, config.rerank_top_n)
    head = ranked.where(F.col("case_rank") <= most)
    bound = queries.count() * most
    texts = rerank.case_texts(case_chunks(hits, head, chunks, bound=bound), cases)
    profiled = profile.add_profile(queries.select("query_id", "query_text", *([rewrite] if rewrite else [])))
    asked = profiled.select("query_id", "query_text", profile.rerank_query(F.col("profile"), F.col(rewrite) if rewrite else None).alias("asked"))
    paired = texts.join(asked, "query_id")
    guarded = rerank.guardrail(F.col("query_text"), F.col("guardrail_text")).alias("g")
    if scorer is None:
        judged = paired.select("query_id", "doc_id", rerank.lexical_model_score(F.col("asked"), F.col("passage")).alias("model_score"), guarded)
    else:
        paired = kept(paired)
        scores = kept(rerank.model_scores(paired, scorer))  # asked once, read twice
        lost = scores.where("failed").select("query_id").distinct()
        judged = paired.select("query_id", "doc_id", guarded).join(scores.drop("failed"), ["query_id", "doc_id"])
        unranked, head = head.join(lost, "query_id", "left_semi"), head.join(lost, "query_id", "left_anti")
    sections = hits.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set("section_type")).alias("sections"))
    rows = head.join(judged, ["query_id", "doc_id"], "left").join(sections, ["query_id", "doc_id"], "left")
    rows = rows.withColumn("penalty", F.coalesce("g.penalty", F.lit(0.0))).withColumn("bonus", F.coalesce("g.bonus", F.lit(0.0)))
    rows = rows.withColumn("flagged", F.coalesce(F.size("g.missing") + F.size("g.conflicts") > 0, F.lit(False)))
    safe = rerank.rank_safe(rerank.fuse(rows, config.rerank_top_n, config.rerank_weight), config.rank_safe)
    out = safe.select("query_id", "doc_id", F.col("safe_score").alias("case_score"), "route_count", "chunk_count", F.col("safe_rank").alias("case_rank"))
    return out if scorer is None else out.unionByName(unranked.select(out.columns))
