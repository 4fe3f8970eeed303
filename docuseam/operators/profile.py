"""Query profiles, routes and the profile bonus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DISPUTE_TERMS, NEGATIVE_TERMS, REASON_TERMS, REJECT_TERMS, RELATION_TERMS, REQUEST_TERMS, ROUTES, SUPPORT_TERMS
from ..functions import text as tx


def tendency(text: Column) -> Column:
    yes, no = tx.any_term(text, SUPPORT_TERMS), tx.any_term(text, REJECT_TERMS)
    return F.when(yes & no, "部分支持或需区分请求").when(yes, "支持请求").when(no, "不支持请求").otherwise("")


def outcome_tags(text: Column) -> Column:
    yes, no = tx.any_term(text, SUPPORT_TERMS), tx.any_term(text, REJECT_TERMS)
    part = F.contains(text, F.lit("部分支持")) | (F.contains(text, F.lit("支持")) & F.contains(text, F.lit("驳回")))
    return F.array_compact(F.array(F.when(yes, "支持"), F.when(no, "不支持或驳回"), F.when(part, "部分支持")))


def add_profile(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Add ``profile``: the rules' reading of each query."""
    rows = queries.withColumn("_raw", tx.compact(F.col(text))).withColumn("_clauses", tx.clauses(F.col(text)))
    raw, parts = F.col("_raw"), F.col("_clauses")
    having = lambda terms: F.filter(parts, lambda c: tx.any_term(c, terms))
    facts = F.filter(parts, lambda c: ~tx.any_term(c, NEGATIVE_TERMS) & tx.any_term(c, REQUEST_TERMS + RELATION_TERMS))
    profile = F.struct(
        raw.alias("raw_query"),
        tx.find_terms(raw, REASON_TERMS, 4).alias("reasons"),
        tx.ordered_distinct(tx.find_terms(raw, REQUEST_TERMS), 8).alias("requests"),
        F.slice(having(DISPUTE_TERMS), 1, 5).alias("focus"),
        F.slice(facts, 1, 6).alias("facts"),
        F.slice(having(NEGATIVE_TERMS), 1, 6).alias("negatives"),
        tx.find_terms(raw, RELATION_TERMS, 8).alias("relations"),
        tx.statutes(raw).alias("statutes"),
        tendency(raw).alias("tendency"),
    )
    return rows.withColumn("profile", profile).drop("_raw", "_clauses")


def _joined(*lists: Column) -> Column:
    return tx.compact(F.array_join(F.concat(*lists), " "))


def routes(profiled: DataFrame, rewrite: str | None = None) -> DataFrame:
    """One row per query and route: route_ord, route, route_type, weight, section_type, query.

    ``rewrite``: name of a struct column with legal_issue, main_leaf, statutes,
    fact_elements, expanded_query (strings), focus_labels (array) and used.
    """
    p = {k: F.col(f"profile.{k}") for k in ("raw_query", "reasons", "requests", "focus", "facts", "negatives", "relations", "statutes")}
    own = lambda k: F.when(F.col(f"{rewrite}.used"), F.nullif(F.col(f"{rewrite}.{k}"), F.lit(""))) if rewrite else F.lit(None).cast("string")
    full = lambda *names: F.nullif(tx.compact(F.concat_ws(" ", *[F.array_join(own_list(n), " ") if n == "focus_labels" else own(n) for n in names])), F.lit(""))
    own_list = lambda n: F.when(F.col(f"{rewrite}.used"), F.col(f"{rewrite}.{n}"))
    nothing = F.lit(None).cast("string")
    focus = F.coalesce(F.nullif(_joined(p["focus"], p["requests"], p["facts"], p["relations"], p["reasons"]), F.lit("")), p["raw_query"])
    legal = full("legal_issue", "main_leaf", "focus_labels") if rewrite else nothing
    section = F.coalesce(legal, F.nullif(focus, F.lit("")), p["raw_query"])
    expanded = F.coalesce(own("expanded_query"), focus)
    statute = full("legal_issue", "statutes", "main_leaf") if rewrite else nothing
    text = {
        "bm25_raw": p["raw_query"], "vector_raw": p["raw_query"],
        "bm25_focus": F.when(expanded != p["raw_query"], expanded), "vector_focus": F.when(expanded != p["raw_query"], expanded),
        "bm25_facts": F.coalesce(own("fact_elements"), section),
        "bm25_negative": _joined(p["negatives"], p["requests"], p["relations"], p["reasons"]),
        "bm25_legal": F.coalesce(statute, _joined(p["reasons"], p["relations"], p["statutes"], p["requests"])),
    }
    made = [F.struct(F.lit(n).alias("route"), F.lit(t).alias("route_type"), F.lit(w).alias("weight"), F.lit(s).cast("string").alias("section_type"), text.get(n, section).alias("query")) for n, t, w, s in ROUTES]
    kept = F.filter(F.array(*made), lambda r: F.coalesce(r["query"], F.lit("")) != "")
    return profiled.select("query_id", F.posexplode(kept).alias("route_ord", "r")).select("query_id", "route_ord", "r.*")


def rerank_query(profile: Column, rewrite: Column | None = None) -> Column:
    """What the reranker is asked: the raw query, the rules' reading of it and, if it is used, the rewrite's issue, facts and statutes, labelled."""
    part = lambda label, sep, *names: F.concat(F.lit(label), F.array_join(F.concat(*[profile[n] for n in names]), sep))
    labels = {"LLM核心争点：": "legal_issue", "LLM事实要素：": "fact_elements", "LLM法条：": "statutes"}
    said = [F.when(rewrite["used"] & (tx.or_empty(rewrite[n]) != ""), F.concat(F.lit(label), rewrite[n])) for label, n in labels.items()] if rewrite is not None else []
    return tx.compact(F.concat_ws(" ", profile["raw_query"], part("规则争议焦点：", "；", "focus"), part("规则请求类型：", "、", "requests"), part("规则否定事实：", "；", "negatives"), part("规则法律关系：", "、", "relations", "reasons"), *said))


def override_weight(weight: Column, name: Column, overrides: Column) -> Column:
    """Weight of the route in a map of strings if it is a number there, else its own."""
    return F.coalesce(F.try_element_at(overrides, name).try_cast("double"), weight)


def profile_bonus(profile: Column, chunk: Column, reason: Column, section: Column, statutes: Column) -> Column:
    """What a chunk gains from the profile, between -0.05 and 0.28."""
    text = tx.compact(chunk)
    any_in = lambda name: F.exists(profile[name], lambda x: F.contains(text, x))
    by_section = (
        F.when(section.isin("fine_tags", "focus_tags"), 0.03)
        .when(section.isin("fine_rule", "focus_analysis"), 0.02)
        .when(section.isin("reasoning", "facts"), 0.04)
        .when(section.isin("defense", "judgment"), 0.03)
        .when(section.isin("header", "statutes"), -0.03)
        .otherwise(0.0)
    )
    listed = F.array_join(F.coalesce(statutes, F.array().cast("array<string>")), " ")
    hit = lambda c, w: F.when(c, w).otherwise(0.0)
    negative = F.size(profile["negatives"]) > 0
    total = (
        by_section
        + hit(F.exists(profile["reasons"], lambda x: (x == reason) | F.contains(text, x)), 0.08)
        + hit(any_in("relations"), 0.05)
        + hit(any_in("requests"), 0.04)
        + hit(negative & tx.any_term(text, NEGATIVE_TERMS), 0.12)
        + hit(negative & any_in("negatives"), 0.06)
        + hit(F.exists(profile["statutes"], lambda x: F.contains(text, x) | F.contains(listed, x)), 0.05)
    )
    return F.greatest(F.lit(-0.05), F.least(F.lit(0.28), total))
