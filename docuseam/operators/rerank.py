"""Reranking: normalised scores, structure, guardrails, bounded promotion, passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    CASE_KEY_SECTIONS, CONFLICT_FACTORS, FOCUS_SECTIONS, GROUP_ORDER, GUARDRAIL_CHUNKS, GUARDRAIL_LIMIT, LEGAL_SECTIONS, NEGATION_CUES, NEGATION_LOOKBACK, NEGATION_SUFFIX,
    OTHER_BUDGET, PASSAGE_LIMIT, REQUIRED_FACTORS, RERANK_BUDGETS, RERANK_GROUPS, RERANK_ORDER, SECTION_TITLES,
)
from ..functions import text as tx
from .fusion import NUDGE, pick_best, section_place


def minmax(score: Column, group: Window) -> Column:
    """0 to 1 within the group; 1 where all are equal."""
    low, high = F.min(score).over(group), F.max(score).over(group)
    return F.when(high <= low, 1.0).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def structure_adjustment(sections: Column) -> Column:
    """What the set of sections of a case says about it."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    legal, focus = F.size(F.array_intersect(sections, lit(LEGAL_SECTIONS))), F.size(F.array_intersect(sections, lit(FOCUS_SECTIONS)))
    others = F.size(F.array_except(sections, lit(["facts", "claims", "defense"])))
    weak = F.when((F.size(sections) > 0) & (others == 0) & (legal == 0), -0.08).when(F.array_contains(sections, "facts") & (legal == 0), -0.04).otherwise(0.0)
    return F.least(F.lit(0.06), 0.025 * legal) + F.when(focus == 4, 0.02).otherwise(0.0) + F.when(F.array_contains(sections, "reasoning") & (focus > 0), 0.02).otherwise(0.0) + weak


def positive_hit(text: Column, term: Column) -> Column:
    """Whether some occurrence of the term has no negation in the characters before it."""
    cut = F.split(text, F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1)

    def free(i):
        before = F.call_function("array_join", F.slice(cut, 1, i + 1), term)
        window = F.regexp_replace(F.right(before, F.lit(NEGATION_LOOKBACK)), tx.WHITE, "")
        return ~(tx.any_term(window, NEGATION_CUES) | window.endswith(NEGATION_SUFFIX))

    return F.contains(text, term) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(cut) - 2, F.lit(0))), free)


def any_positive(text: Column, terms: Column) -> Column:
    """Whether one of an array of terms has such an occurrence."""
    return F.exists(terms, lambda t: positive_hit(text, t))


def _factors(required: list[dict], conflicts: list[dict]) -> Column:
    """Factors of guardrails as one array of structs."""
    one = lambda f, wanted: F.struct(
        F.lit(f["name"]).alias("name"), F.lit(wanted).alias("required"), F.lit(f["penalty"]).alias("penalty"), tx.strings(f["query_any"]).alias("query_any"),
        tx.strings(f.get("query_all", [])).alias("query_all"), tx.strings(f["doc_any"]).alias("doc_any"), tx.strings(f.get("absent", [])).alias("absent"),
    )
    return F.array(*[one(f, True) for f in required], *[one(f, False) for f in conflicts])


def guardrail(query: Column, doc: Column, required: list[dict] = REQUIRED_FACTORS, conflicts: list[dict] = CONFLICT_FACTORS) -> Column:
    """Struct of penalty, bonus, missing and conflicts of a case text under a query text."""
    factors = _factors(required, conflicts)

    def applies(asked):
        return F.filter(factors, lambda f: F.exists(f["query_any"], lambda t: F.contains(asked, t)) & F.forall(f["query_all"], lambda t: F.contains(asked, t)))

    def said(f):
        has = any_positive(doc, f["doc_any"])
        bad = F.when(f["required"], ~has).otherwise(has & ~any_positive(doc, f["absent"]))
        return F.struct(f["name"].alias("name"), f["required"].alias("required"), f["penalty"].alias("penalty"), bad.alias("bad"))

    def told(says):
        names = lambda required: F.transform(F.filter(says, lambda x: x["bad"] & (x["required"] == required)), lambda x: x["name"])
        penalty = F.aggregate(says, F.lit(0.0), lambda a, x: a + F.when(x["bad"], x["penalty"]).otherwise(0.0))
        matched = F.size(F.filter(says, lambda x: x["required"] & ~x["bad"]))
        clean = ~F.exists(says, lambda x: x["bad"])
        bonus = F.when((matched > 0) & clean, F.least(F.lit(0.02), 0.008 * matched)).otherwise(0.0)
        return F.struct(F.least(F.lit(0.35), penalty).alias("penalty"), bonus.alias("bonus"), names(True).alias("missing"), names(False).alias("conflicts"))

    # values used more than once are bound to lambda variables, so that they are made once
    applying = F.transform(F.array(tx.compact(query, GUARDRAIL_LIMIT)), applies)[0]
    return F.transform(F.array(F.transform(applying, said)), told)[0]


def fuse(cases: DataFrame, top_n: int, weight: float = 0.25) -> DataFrame:
    """Rerank the head of every query's cases and leave the tail as it is.

    ``cases``: query_id, doc_id, case_score, case_rank, model_score (null where
    the model gave none), sections, penalty, bonus. Adds fused_score and
    rerank_rank; head scores are normalised, tail scores are not.
    """
    weight = min(1.0, max(0.0, weight))
    head = F.col("case_rank") <= max(1, top_n)
    by = Window.partitionBy("query_id", head)
    model = F.coalesce("model_score", F.min("model_score").over(by), F.lit(0.0))
    rows = cases.withColumn("_model", model)
    own = (1 - weight) * minmax(F.col("case_score"), by) + weight * minmax(F.col("_model"), by)
    score = F.greatest(F.lit(0.0), own + structure_adjustment(F.col("sections")) + F.col("bonus") - F.col("penalty"))
    rows = rows.withColumn("fused_score", F.when(head, F.round(score + NUDGE, 6)).otherwise(F.col("case_score"))).drop("_model")
    order = Window.partitionBy("query_id").orderBy((~head).cast("int"), F.when(head, -F.col("fused_score")).otherwise(F.col("case_rank")), F.asc("doc_id"))
    return rows.withColumn("rerank_rank", F.row_number().over(order))


def allowed_rank(original: Column, most: int) -> Column:
    """The best rank that a case of this original rank may reach."""
    return F.when(original <= 20, F.greatest(F.lit(1), original - most)).when(original <= 50, F.greatest(F.lit(11), original - most)).otherwise(F.greatest(F.lit(21), original - most))


def rank_safe(cases: DataFrame, most: int = 20) -> DataFrame:
    """Demote cases that climbed too far: query_id, doc_id, case_rank, rerank_rank, fused_score, sections, flagged."""
    if most <= 0:
        return cases.withColumn("safe_score", F.col("fused_score")).withColumn("safe_rank", F.col("rerank_rank"))
    over = F.greatest(F.lit(0), allowed_rank(F.col("case_rank"), most) - F.col("rerank_rank"))
    front = F.col("rerank_rank") <= 10
    legal = F.arrays_overlap("sections", F.array(*[F.lit(s) for s in LEGAL_SECTIONS]))
    over = over + F.when(front & ~legal, 3).otherwise(0) + F.when(front & F.col("flagged"), 4).otherwise(0)
    rows = cases.withColumn("safe_score", F.round(F.col("fused_score") - F.least(F.lit(0.8), 0.025 * over) + NUDGE, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("safe_score"), F.asc("rerank_rank"))
    return rows.withColumn("safe_rank", F.row_number().over(w))


def _section_label(section: Column) -> Column:
    title = F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTION_TITLES.items() for x in kv]), section)
    return F.coalesce(title, F.nullif(section, F.lit("")))


def passage_entry(section: Column, pick: Column, text: Column) -> Column:
    """A picked chunk in its passage: place of its group, pick, group, and its text within the budget; null if it has none."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    budget = F.coalesce(F.try_element_at(table(RERANK_BUDGETS), section), F.lit(OTHER_BUDGET))
    body = tx.compact(text)
    body = F.when(F.length(body) > budget, F.concat(F.substring(body, F.lit(1), budget - 1), F.lit("…"))).otherwise(body)
    group = F.coalesce(F.try_element_at(table(RERANK_GROUPS), section), F.lit(GROUP_ORDER[-1]))
    entry = F.concat(F.coalesce(_section_label(section), F.lit("片段")), F.lit("："), body)
    return F.when(body != "", F.struct(F.array_position(tx.strings(GROUP_ORDER), group).alias("place"), pick.alias("pick"), group.alias("group"), entry.alias("entry")))


def passage_text(entries: Column, name: Column, reason: Column) -> Column:
    """What the case is, then its entries: groups in the fixed order under their headings, compacted and cut at the limit."""
    about = lambda label, x: F.when(tx.or_empty(x) != "", F.concat(F.lit(label), x))
    head = F.concat_ws(" ", about("案名：", name), about("案由：", reason))
    said = F.transform(F.array_sort(entries), lambda x: F.struct(x["group"].alias("group"), x["entry"].alias("entry")))
    start = F.struct(F.lit("").alias("group"), F.when(head != "", F.concat(F.lit("【案件类型】 "), head)).otherwise("").alias("out"))
    step = lambda a, x: F.struct(x["group"].alias("group"), F.concat_ws(" ", a["out"], F.when(a["group"] != x["group"], x["group"]), x["entry"]).alias("out"))
    return tx.compact(F.aggregate(said, start, step, lambda a: a["out"]), PASSAGE_LIMIT)


def passages(picked: DataFrame, cases: DataFrame, text: str = "chunk_text") -> DataFrame:
    """One passage per query and case of its picked chunks. ``cases``: doc_id, case_name, reason."""
    entry = passage_entry(F.col("section_type"), F.col("pick"), F.coalesce(F.col(text), F.lit("")))
    per = picked.groupBy("query_id", "doc_id").agg(F.collect_list(entry).alias("xs"))  # at most the picks of a case
    rows = per.join(cases.select("doc_id", "case_name", "reason"), "doc_id", "left")
    return rows.select("query_id", "doc_id", passage_text(F.col("xs"), F.col("case_name"), F.col("reason")).alias("passage"))


def case_texts(chunks: DataFrame, cases: DataFrame, n: int = 6) -> DataFrame:
    """query_id, doc_id, passage and guardrail_text, with one grouping of a case's chunks.

    ``chunks``: query_id, doc_id, chunk_id, section_type, score, chunk_text, each
    chunk once. Guardrails read the case's name, its reason and its first chunks,
    key sections first.
    """
    section = F.col("section_type")
    w = Window.partitionBy("query_id", "doc_id").orderBy((~section.isin(CASE_KEY_SECTIONS)).cast("int"), section_place(section, RERANK_ORDER), F.desc("score"), F.asc("chunk_id"))
    rows = pick_best(chunks).withColumn("_at", F.row_number().over(w)).where((F.col("pick") <= n) | (F.col("_at") <= GUARDRAIL_CHUNKS))
    entry = F.when(F.col("pick") <= n, passage_entry(section, F.col("pick"), F.col("chunk_text")))
    said = F.when(F.col("_at") <= GUARDRAIL_CHUNKS, F.struct("_at", F.concat_ws(" ", _section_label(section), "chunk_text").alias("said")))
    per = rows.groupBy("query_id", "doc_id").agg(F.collect_list(entry).alias("xs"), F.collect_list(said).alias("ys"))
    rows = per.join(cases.select("doc_id", "case_name", "reason"), "doc_id", "left")
    whole = F.concat_ws(" ", "case_name", "reason", F.array_join(F.transform(F.array_sort("ys"), lambda x: x["said"]), " "))
    return rows.select("query_id", "doc_id", passage_text(F.col("xs"), F.col("case_name"), F.col("reason")).alias("passage"), tx.compact(whole, GUARDRAIL_LIMIT).alias("guardrail_text"))


#: Makes a scorer in a worker: a function from a query and its passages to their scores. It may raise.
Factory = Callable[[], Callable[[str, list[str]], list[float]]]


def model_scores(texts: DataFrame, factory: Factory, batch_chars: int = 200_000) -> DataFrame:
    """(query_id, doc_id, model_score, failed) of query_id, doc_id, asked, passage rows.

    A scorer is made once for each task and given a query's passages together,
    in batches of at most ``batch_chars`` characters. What a scorer raises,
    also while it is made, leaves the rows of that batch without a score and
    marks them as failed; so do scores that are missing or no numbers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = broken = None
        for f in frames:
            scores = pd.Series(np.nan, f.index)
            for asked, rows in f.groupby(f["asked"].fillna(""), sort=False):
                passages = rows["passage"].fillna("")
                for _, part in passages.groupby(passages.str.len().cumsum() // batch_chars):
                    try:
                        if scorer is None and broken is None:
                            try:
                                scorer = factory()
                            except Exception as e:
                                broken = e
                        if broken is not None:
                            raise broken
                        got = [float(x) for x in scorer(asked, part.tolist())]
                        if len(got) != len(part):
                            raise ValueError("one score for each passage")
                        scores[part.index] = got
                    except Exception:  # the rows stay unscored, and their query unranked
                        continue
            ok = np.isfinite(scores)
            yield pd.DataFrame({"query_id": f["query_id"], "doc_id": f["doc_id"], "model_score": scores.where(ok), "failed": ~ok})

    schema = T.StructType([texts.schema["query_id"], texts.schema["doc_id"], T.StructField("model_score", T.DoubleType()), T.StructField("failed", T.BooleanType())])
    # the passages of a query's head, which are few, lie together
    return texts.select("query_id", "doc_id", "asked", "passage").repartition("query_id").sortWithinPartitions("query_id", "doc_id").mapInPandas(run, schema)


def rerank_chunks(hits: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """The first ``top_n`` chunks of each query in the order of a scorer: query_id, chunk_id, score, pre_rerank, rank.

    ``hits``: query_id, chunk_id, score; ``scores``: query_id, chunk_id,
    model_score. Chunks without a score are left out, as are those behind the
    first ones; ties go by id.
    """
    by = lambda score: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("chunk_id")))
    head = hits.withColumn("rank", by("score")).where(F.col("rank") <= top_n).select("query_id", "chunk_id", F.col("score").alias("pre_rerank"))
    scored = head.join(scores.where("model_score IS NOT NULL"), ["query_id", "chunk_id"])
    return scored.select("query_id", "chunk_id", F.col("model_score").alias("score"), "pre_rerank", by("model_score").alias("rank"))


def lexical_model_score(query: Column, passage: Column) -> Column:
    """Deterministic stand-in for a cross encoder: share of query tokens in the passage."""
    words = F.array_distinct(tx.tokens(query))
    return F.round(F.size(F.array_intersect(words, F.array_distinct(tx.tokens(passage)))) / F.greatest(F.lit(1), F.size(words)), 6)
