"""Result entries, public projections and fallback answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def result_entries(cases: DataFrame, case_docs: DataFrame, top_k: int) -> DataFrame:
    """Final ranking with the case's own fields; empty strings where the case is missing."""
    head = cases.where(F.col("case_rank") <= top_k)
    keep = head.join(case_docs.select("doc_id", "case_name", "court_name", "reason"), "doc_id", "left")
    return keep.select("query_id", "case_rank", "doc_id", "case_score", *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("")).alias(c) for c in ("case_name", "court_name", "reason")])


def public_results(cases: DataFrame, qrels: DataFrame, anchor: str = "query_id") -> DataFrame:
    """Ranking with grades and what they mean."""
    rows = cases.join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    return rows.select(
        "query_id", "doc_id", "case_rank", "case_score", F.coalesce("grade", F.lit(0)).alias("grade"), (F.col("doc_id") == F.col(anchor)).alias("is_anchor"),
        F.col("grade").isNotNull().alias("is_judged"), (F.coalesce("grade", F.lit(0)) >= 2).alias("is_positive"), (F.coalesce("grade", F.lit(0)) == 1).alias("is_weak"),
    )


def fallback_answers(entries: DataFrame, most: int = 3, chars: int = 80) -> DataFrame:
    """A deterministic answer from the first results of each query."""
    rows = entries.where(F.col("case_rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("case_rank", "doc_id", "case_name"))).alias("top"))
    return rows.select("query_id", F.array_join(F.transform("top", lambda x: F.concat(x["case_rank"].cast("string"), F.lit(". "), tx.compact(x["case_name"], chars), F.lit(" ["), x["doc_id"].cast("string"), F.lit("]"))), "\n").alias("answer"))


def valid_citations(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Cited ids that were retrieved for the query, in order and distinct; answers left without any fall out.

    ``answers``: query_id, cited (array of ids); ``retrieved``: query_id, doc_id.
    """
    cited = answers.select("query_id", F.posexplode("cited").alias("pos", "doc_id")).join(retrieved.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    first = cited.groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("cited"))


#: Characters of a section in a prompt, and cited articles.
PROMPT_CHARS, PROMPT_STATUTES = 420, 6


def prompt_payload(cases: DataFrame, chunks: str = "chunks") -> DataFrame:
    """Add claims, facts, reasoning and judgment of each case as a prompt takes them; ``statutes`` are cut to the first ones.

    ``chunks``: array of (section_type, section_title, chunk_text, context_text)
    in the order of the matches. A section's text is its first chunk with text,
    compacted and cut. Reasoning and judgment fall back to the first chunk whose
    title or text, in its context if it has one, names them. Missing sections are
    empty, null arrays count as empty.
    """
    listed = F.transform(F.coalesce(F.col(chunks), F.array().cast(cases.schema[chunks].dataType)), lambda c: F.struct(
        tx.or_empty(c["section_type"]).alias("kind"), tx.or_empty(c["section_title"]).alias("title"), tx.compact(c["chunk_text"], PROMPT_CHARS).alias("text"),
        tx.compact(F.coalesce(F.nullif(c["context_text"], F.lit("")), c["chunk_text"]), PROMPT_CHARS).alias("around"),
    ))
    rows = cases.withColumn("_listed", listed)
    first = lambda keep, text: F.get(F.transform(F.filter("_listed", lambda c: keep(c) & (c[text] != "")), lambda c: c[text]), F.lit(0))
    own = lambda kind, title=None: first(lambda c: (c["kind"] == kind) | (c["title"] == title) if title else c["kind"] == kind, "text")
    names = {"reasoning": ("本院认为", ["本院认为"]), "judgment": ("裁判结果", ["判决如下", "裁定如下"])}

    def found(kind: str):
        title, marks = names[kind]
        return F.coalesce(own(kind, title), first(lambda c: F.contains(c["title"], F.lit(title)) | tx.any_term(c["around"], marks), "around"))

    texts = {"claims": own("claims"), "facts": own("facts"), "reasoning": found("reasoning"), "judgment": found("judgment")}
    cited = {"statutes": F.slice(F.coalesce("statutes", F.array().cast("array<string>")), 1, PROMPT_STATUTES)} if "statutes" in cases.columns else {}
    return rows.withColumns({k: tx.or_empty(v) for k, v in texts.items()} | cited).drop("_listed")
