"""Details of cases and reports: sections of full texts, rewrites, passages, samples, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: (id, title, anchors): where sections of a full text start.
ANCHORS = [
    ("process", "审理经过", ["本院于", "本案现已审理终结", "依法公开开庭进行了审理"]), ("claims", "原告诉称", ["原告向本院提出诉讼请求", "原告诉称", "上诉人请求", "申请人称"]),
    ("defense", "被告辩称", ["被告辩称", "被告未具答辩", "被上诉人辩称", "被申请人称"]), ("facts", "本院查明", ["经审理查明", "本院经审理认定", "查明事实如下"]), ("reasoning", "本院认为", ["本院认为"]),
    ("judgment", "裁判结果", ["判决如下", "裁定如下"]), ("statutes", "附法律依据", ["附：相关法律条文", "附法律依据"]),
]
DRAFT_MARKERS = ["整体判断：", "整体判断", "观点一：", "观点1：", "观点一", "观点1"]
FIELD_LIMIT, LABEL_LIMIT, MOST_LABELS = 120, 40, 4


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{tx.WHITE}|{tx.WHITE}\z", "")


def first_anchor(text: Column, needles: list[str]) -> Column:
    """Place, from 1, of the needle that occurs first; null if none does."""
    return F.array_min(F.array_compact(F.array(*[F.nullif(F.instr(text, n), F.lit(0)) for n in needles])))


def text_sections(text: Column, anchors: list[tuple[str, str, list[str]]] = ANCHORS) -> Column:
    """Array of (place, id, title, content): the text cut at its anchors, in the canonical order.

    What stands before the first anchor is the header; a text without content is
    empty, one without anchors is one section. Of anchors at one place the last
    of the list has the content.
    """
    body = tx.or_empty(text)
    made = [F.struct(first_anchor(body, needles).alias("at"), F.lit(k).alias("place"), F.lit(i).alias("id"), F.lit(t).alias("title")) for k, (i, t, needles) in enumerate(anchors, start=1)]
    found = F.array_sort(F.filter(F.array(*made), lambda a: a["at"].isNotNull()))

    def cut(places):
        def content(a, i):
            end = F.coalesce(F.get(places, i + 1)["at"], F.length(body) + 1)
            return F.struct(a["place"].alias("place"), a["id"].alias("id"), a["title"].alias("title"), stripped(F.substring(body, a["at"], end - a["at"])).alias("content"))

        first = F.coalesce(F.get(places, F.lit(0))["at"], F.length(body) + 1)
        header = F.struct(F.lit(0).alias("place"), F.lit("header").alias("id"), F.lit("首部信息").alias("title"), stripped(F.substring(body, F.lit(1), first - 1)).alias("content"))
        return F.array_sort(F.filter(F.concat(F.array(header), F.transform(places, content)), lambda s: s["content"] != ""))

    return F.transform(F.array(found), cut)[0]


def first_sections(chunks: DataFrame, sections: list[str]) -> DataFrame:
    """The first chunk of each of the sections of every case: doc_id, section_type, chunk_id, chunk_text."""
    rows = chunks.where(F.col("section_type").isin(sections))
    first = F.min_by(F.struct("chunk_id", "chunk_text"), F.struct("section_index", "chunk_id"))
    return rows.groupBy("doc_id", "section_type").agg(first.alias("c")).select("doc_id", "section_type", "c.*")


def draft(text: Column, markers: list[str] = DRAFT_MARKERS) -> Column:
    """The text from the earliest marker on; empty without one."""
    body = tx.or_empty(text)
    at = F.array_min(F.filter(F.transform(tx.strings(markers), lambda m: F.position(m, body)), lambda i: i > 0))
    return F.coalesce(F.substring(body, at, F.length(body)), F.lit(""))


def json_object(content: Column) -> Column:
    """The JSON object of an answer: fences are taken off; if the rest is no JSON, what the outer braces hold. Null if there is none."""
    plain = stripped(F.regexp_replace(stripped(tx.or_empty(content)), r"^```(?:json)?\s*|\s*```\z", ""))
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    good = lambda x: F.try_parse_json(x).isNotNull() & x.startswith("{")
    return F.when(good(plain), plain).when(good(inner), inner)


def _field(parsed: Column, name: str) -> Column:
    """A string field, compacted; empty if it is no string or too long."""
    value = F.try_variant_get(parsed, f"$.{name}", "variant")
    text = tx.compact(F.try_variant_get(parsed, f"$.{name}", "string"))
    return F.when((F.schema_of_variant(value) == "STRING") & (F.length(text) <= FIELD_LIMIT), text).otherwise("")


def parse_rewrite(content: Column) -> Column:
    """Struct of a rewrite's clean fields, focus_labels, used and fallback_reason (invalid_json, empty_fields or empty)."""
    whole = F.try_parse_json(content)
    parsed = F.when(stripped(content).startswith("{"), whole)
    names = ("expanded_query", "legal_issue", "fact_elements", "statutes", "main_leaf")
    listed = F.coalesce(F.try_variant_get(parsed, "$.focus_labels", "array<variant>"), F.array().cast("array<variant>"))
    kept = F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING")
    labels = F.filter(F.transform(kept, lambda v: tx.compact(F.try_variant_get(v, "$", "string"))), lambda x: (x != "") & (F.length(x) <= LABEL_LIMIT))
    fields = [_field(parsed, n).alias(n) for n in names]
    got = F.struct(*fields, F.slice(F.array_distinct(labels), 1, MOST_LABELS).alias("focus_labels"))

    def told(r):
        some = F.lit(False)
        for n in names:
            some = some | (r[n] != "")
        used = some | (F.size(r["focus_labels"]) > 0)
        reason = F.when(parsed.isNull(), "invalid_json").when(~used, "empty_fields").otherwise("")
        return F.struct(*[r[n].alias(n) for n in names], r["focus_labels"].alias("focus_labels"), (used & parsed.isNotNull()).alias("used"), reason.alias("fallback_reason"))

    return F.transform(F.array(got), told)[0]


def core_issue(main_leaf: Column, fine: Column, labels: Column) -> Column:
    """The issue of a case: its leaf, its fine issues and its labels without blanks."""
    said = lambda xs: F.array_join(F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), stripped), lambda x: x != ""), "；")
    return F.concat_ws("；", *[F.nullif(x, F.lit("")) for x in (main_leaf, said(fine), said(labels))])


def statute_lines(statutes: Column) -> Column:
    """One line for each cited article. ``statutes``: array of (law, article, original)."""
    line = lambda s: stripped(F.concat(tx.or_empty(s["law"]), F.lit(" 第"), F.coalesce(s["article"].cast("string"), F.lit("None")), F.lit("条 "), tx.or_empty(s["original"])))
    return F.array_join(F.filter(F.transform(F.coalesce(statutes, F.array()), line), lambda x: x != ""), "\n")


def chunk_key(chunk_id: Column, doc_id: Column, section: Column, text: Column) -> Column:
    """What names a chunk: its id, else its case, section and the start of its text."""
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.concat_ws(":", doc_id.cast("string"), section, F.substring(text, 1, 80)))


def chunk_passage(reason: Column, level: Column, label: Column, negative: Column, outcome: Column, text: Column) -> Column:
    """One chunk as the reranker reads it: labelled lines without the empty ones, the text last."""
    line = lambda name, x: F.when(tx.or_empty(x) != "", F.concat(F.lit(name), x))
    tags = lambda name, xs: line(name, F.array_join(xs, "、"))
    return F.concat_ws("\n", line("案由：", reason), line("审级：", level), line("章节：", label), tags("否定事实标签：", negative), tags("裁判结果标签：", outcome), F.concat(F.lit("正文："), tx.or_empty(text)))


def sample_chunks(chunks: DataFrame, n: int = 12, limit: int = 360) -> DataFrame:
    """The first chunks of the corpus, in order, with their text cut: a sample for reports."""
    cut = F.substring("chunk_text", 1, limit).alias("chunk_text")
    return chunks.orderBy("doc_id", "section_index", "chunk_id").limit(n).select("doc_id", "chunk_id", "section_type", cut)


def worst_deltas(deltas: DataFrame, columns: list[str], by: str, n: int = 8) -> DataFrame:
    """The n rows that lost most by one measure, of those with any measure; a missing one counts as 0."""
    some = F.coalesce(*[F.col(c).cast("double") for c in columns]).isNotNull()
    return deltas.where(some).orderBy(F.coalesce(F.col(by), F.lit(0.0)), "query_id").limit(n)


def label_samples(samples: DataFrame) -> DataFrame:
    """Of K grades for each query and document: the rounded mean, the mean and the deviation."""
    mean = F.avg("grade")
    return samples.groupBy("query_id", "doc_id").agg(F.floor(mean + 0.5).cast("int").alias("main"), F.round(mean, 6).alias("expected"), F.round(F.coalesce(F.stddev_pop("grade"), F.lit(0.0)), 6).alias("deviation"), F.count("*").alias("samples"))


def diagnosis_export(metrics: DataFrame, positives: DataFrame, missed: DataFrame, method: str) -> DataFrame:
    """One flat row per query: its measures, its diagnosis, and the ids of its positive and missed documents."""
    ids = lambda df, name: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda x: x.cast("string")), ",").alias(name))
    rows = metrics.join(ids(positives, "positive_doc_ids"), "query_id", "left").join(ids(missed, "missed_positive_doc_ids"), "query_id", "left")
    kept = ["query_id", "difficulty", "trap", "positive_count", "expected_ndcg_20", "recall_20", "recall_100", "mrr", "first_positive_rank", "top20_has_positive", "top100_has_positive", "weak_top20", F.col("label").alias("diagnosis_label"), F.col("bucket").alias("diagnosis_bucket")]
    return rows.select(F.lit(method).alias("method"), *kept, *[tx.or_empty(F.col(c)).alias(c) for c in ("positive_doc_ids", "missed_positive_doc_ids")])


def ranked_sections(rows: DataFrame, order: list[str]) -> DataFrame:
    """Preview sections: the first of each kind, in the order of the list, kinds without one filled with an empty text."""
    w = Window.partitionBy("doc_id", "id").orderBy("place")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(i).alias("id")) for k, i in enumerate(order)])).alias("k")
    every = rows.select("doc_id").distinct().select("doc_id", kinds).select("doc_id", F.col("k.place").alias("at"), F.col("k.id").alias("id"))
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc_id", "id", "content")
    return every.join(first, ["doc_id", "id"], "left").select("doc_id", "at", "id", tx.or_empty(F.col("content")).alias("content"))


def case_detail(cases: DataFrame, ids: DataFrame, anchors: list[tuple[str, str, list[str]]] = ANCHORS, chunks: DataFrame | None = None) -> DataFrame:
    """The asked cases with their fields, empty where missing, and the sections of their full text.

    ``cases``: doc_id, case_name, court_name, reason, full_text. A preview of each
    case, its first section besides the header, falls back to the first of
    ``chunks`` and then to a placeholder.
    """
    rows = cases.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("sections", text_sections(F.col("full_text"), anchors))
    first = F.filter("sections", lambda x: x["id"] != "header")
    rows = rows.withColumn("preview", F.get(first, F.lit(0))["content"])
    if chunks is not None:
        own = chunks.groupBy("doc_id").agg(F.min_by("chunk_text", F.struct("section_index", "chunk_id")).alias("first_chunk"))
        rows = rows.join(own, "doc_id", "left").withColumn("preview", F.coalesce("preview", "first_chunk"))
    return rows.select("doc_id", *[tx.or_empty(F.col(c)).alias(c) for c in ("case_name", "court_name", "reason")], "sections", tx.compact(F.coalesce(F.nullif(F.col("preview"), F.lit("")), F.lit("暂无内容")), 260).alias("preview"))
