"""Index build: nested rows become case rows and chunk records.

A row holds one case with structs and arrays of sections. Everything that a
chunk needs lies in its case's row, so sections, pieces, places in the full text
and links are made inside the row, and the build has no shuffle; the last step
deals the pieces out as rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BUILD_ORDER, CASE_TYPE, DEFAULT_REASON, EMBEDDING_DIM, NESTED_ROW, OTHER_STORED_WEIGHT, QUALITY_FLAGS, REGIONS, SECTION_TITLES, SECTION_WEIGHTS
from ..functions import text as tx
from ..operators import corpus
from ..operators.details import core_issue, statute_lines
from ..session import bounded_batches

JOINER = "；"
SECTIONS = "array<struct<section_type:string,section_text:string>>"
PIECES = "array<struct<section_index:int,pos:int,section_type:string,chunk_text:string>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Nested rows of JSON lines; rows that can't be read, and rows without an id, are left out."""
    return spark.read.schema(NESTED_ROW).option("mode", "DROPMALFORMED").json(path).where("doc_id IS NOT NULL")


def _leaves(value) -> Iterator[str]:
    """Texts of a JSON value from left to right, at any depth."""
    if isinstance(value, dict | list):
        for x in value.values() if isinstance(value, dict) else value:
            yield from _leaves(x)
    elif value is not None:
        yield value.strip() if isinstance(value, str) else str(value)


def value_text(value: Column) -> Column:
    """A JSON value as text: all its texts in their own order, blanks left out, joined by a full-width semicolon.

    ``value``: JSON as text. The order of an object's fields is the written one,
    which a variant does not keep. Null and broken JSON give an empty text.
    """

    @F.pandas_udf("string")
    def joined(values: pd.Series) -> pd.Series:
        def one(x: str | None) -> str:
            try:
                return JOINER.join(t for t in _leaves(json.loads(x or "null")) if t)
            except ValueError:
                return ""

        return values.map(one)

    return joined(value)


def _listed(values: Column) -> Column:
    """Stripped values without blanks, joined."""
    texts = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.regexp_replace(tx.or_empty(x), rf"^{tx.WHITE}|{tx.WHITE}$", ""))
    return F.array_join(F.filter(texts, lambda x: x != ""), JOINER)


def _labelled(**parts: Column) -> list[Column]:
    return [F.concat(F.lit(f"{label}："), tx.or_empty(x)) for label, x in parts.items()]


def _fields() -> dict[str, Column]:
    """What sections and full texts say, by label. Missing structs count as empty."""
    c = F.col
    focus, fine, paragraph = c("争议焦点"), c("细争点"), c("段落")
    return {
        "案号": c("案号"), "法院": c("法院"), "案由": c("案由"), "法律关系": c("法律关系"), "标的物类型": c("标的物类型"), "焦点标签": _listed(focus["焦点标签"]),
        "案情核心": focus["焦点评析"]["案情核心"], "法律争点": focus["焦点评析"]["法律争点"], "裁判要旨": focus["焦点评析"]["裁判要旨"],
        "主叶子": fine["主叶子"], "细争点": _listed(fine["细争点"]), "裁判规则争点": fine["裁判规则争点"],
        "诉称": paragraph["诉称"], "查明事实": paragraph["查明事实"], "本院认为": paragraph["本院认为"], "裁判结果": paragraph["裁判结果"],
        "引用法条": statute_lines(_articles()), "焦点原文": focus["焦点原文"],
    }


def _articles() -> Column:
    return F.transform(F.coalesce(F.col("引用法条"), F.array()), lambda s: F.struct(s["法律"].alias("law"), s["条"].alias("article"), s["原文"].alias("original")))


def full_text() -> Column:
    """The labelled fields of a row without the empty ones, as clean lines."""
    parts = F.array(*_labelled(**{k: v for k, v in _fields().items() if k != "焦点原文"}))
    return tx.clean_lines(F.array_join(F.filter(parts, lambda p: ~p.endswith("：")), "\n\n"))


def sections() -> Column:
    """The sections of a row in the order of the build, pleadings cut by who speaks; empty ones keep their place."""
    f = _fields()

    def lines(*labels: str) -> Column:
        return F.concat_ws("\n", *_labelled(**{k: f[k] for k in labels}))

    body = {
        "fine_tags": lines("主叶子", "细争点"), "fine_rule": lines("裁判规则争点"), "focus_tags": lines("焦点标签"),
        "focus_analysis": lines("案情核心", "法律争点", "裁判要旨", "焦点原文"), "facts": tx.or_empty(f["查明事实"]),
        "reasoning": tx.or_empty(f["本院认为"]), "judgment": tx.or_empty(f["裁判结果"]), "statutes": f["引用法条"],
    }
    one = lambda kind: F.array(F.struct(F.lit(kind).alias("section_type"), body[kind].alias("section_text"))).cast(SECTIONS)
    return F.concat(*[corpus.pleading_sections(f["诉称"]).cast(SECTIONS) if kind == "pleadings" else one(kind) for kind in BUILD_ORDER])


def case_rows(rows: DataFrame, source_file: str = "", schema_version: str = "1") -> DataFrame:
    """Case records of nested rows, with the sections of each. ``source_row_id``, if the input has it, is kept."""
    court = tx.or_empty(F.col("法院"))
    region = F.coalesce(*[F.when(F.contains(court, F.lit(r)), r) for r in REGIONS], F.lit(""))
    code = F.nullif(F.col("案号"), F.lit(""))
    cited = F.transform(F.coalesce(F.col("引用法条"), F.array()), lambda s: _listed(F.array(s["法律"], s["条"].cast("string"), s["原文"])))
    whole = rows.withColumn("full_text", full_text())
    return whole.select(
        "doc_id",
        F.coalesce(code, F.substring_index("doc_id", "#", 1)).alias("case_code"),
        F.coalesce(code, F.col("doc_id")).alias("case_name"),
        court.alias("court_name"),
        region.alias("court_region"),
        F.lit(CASE_TYPE).alias("case_type"),
        tx.or_empty(F.col("审级")).alias("trial_level"),
        F.coalesce(F.nullif(F.col("案由"), F.lit("")), F.lit(DEFAULT_REASON)).alias("reason"),
        F.nullif(F.col("裁判日期"), F.lit("")).try_cast("date").alias("judge_date"),
        F.lit(None).cast("date").alias("publish_date"),
        F.coalesce(F.col("当事人"), F.array().cast(rows.schema["当事人"].dataType)).alias("litigants"),
        cited.cast("array<string>").alias("statutes"),
        "full_text",
        F.sha2(F.col("full_text").cast("binary"), 256).alias("full_text_hash"),
        F.lit(source_file).alias("source_file"),
        F.col("source_row_id") if "source_row_id" in rows.columns else F.lit(None).cast("long").alias("source_row_id"),
        F.lit(schema_version).alias("schema_version"),
        tx.or_empty(F.col("法律关系")).alias("legal_relation"),
        tx.or_empty(F.col("标的物类型")).alias("subject_type"),
        tx.or_empty(F.col("裁判结果_标签")).alias("result_label"),
        core_issue(F.col("细争点")["主叶子"], F.col("细争点")["细争点"], F.col("争议焦点")["焦点标签"]).alias("core_issue"),
        sections().alias("sections"),
    )


def pieces(section_list: Column) -> Column:
    """Pieces of all sections of a case in order, each cut by the splitter of its kind; see ``PIECES``."""

    @F.pandas_udf(PIECES)
    def cut(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        def one(k, t) -> list[dict]:
            return [{"section_index": i, "pos": p, "section_type": kind, "chunk_text": piece} for i, (kind, text) in enumerate(zip(k, t, strict=True)) for p, piece in enumerate(corpus.split_section(kind, text or ""))]

        return pd.Series([one(k, t) for k, t in zip(kinds, texts, strict=True)], dtype=object)

    return cut(F.transform(section_list, lambda s: s["section_type"]), F.transform(section_list, lambda s: s["section_text"]))


class Chunkify:
    """Table function (section_type, section_text) to (pos, chunk_text), for LATERAL joins in SQL."""

    def eval(self, section_type: str, section_text: str):
        yield from enumerate(corpus.split_section(section_type or "", section_text or ""))


def register_splitters(spark: SparkSession, name: str = "chunkify") -> None:
    """Make the splitters known to SQL: SELECT ... FROM sections, LATERAL chunkify(section_type, section_text)."""
    spark.udtf.register(name, F.udtf(Chunkify, returnType="pos int, chunk_text string"))


def chunk_rows(cases: DataFrame, embedding_model: str = "", embedding_version: str = "", embedding_dim: int = EMBEDDING_DIM, cut: bool = False) -> DataFrame:
    """Chunk records of case rows: 34 columns, one row per piece, with places in the full text and links.

    The section index counts every section, also those without a piece. Links of
    the first and the last chunk are empty. ``cut``: the cases hold their ``pieces`` already.
    """
    bounded_batches(cases.sparkSession)
    whole = cases if cut else cases.withColumn("pieces", pieces(F.col("sections")))
    cid = lambda x: F.format_string("%s#%s#%02d#%03d", F.col("doc_id"), x["section_type"], x["section_index"], x["pos"])
    named = whole.withColumns({"ids": F.transform("pieces", cid), "spans": corpus.placed(F.col("full_text"), F.transform("pieces", lambda x: x["chunk_text"]))})
    # a piece holds all that it needs of its case's lists and full text, so that no row of a piece carries them
    near = lambda i, k: F.coalesce(F.get("ids", i + k), F.lit(""))
    made = F.transform("pieces", lambda x, i: F.struct(F.get("ids", i).alias("id"), near(i, -1).alias("prev"), near(i, 1).alias("next"), x.alias("x"), F.get("spans", i).alias("span")))
    held = named.withColumn("made", made).drop("pieces", "sections", "ids", "spans", "full_text")
    # the outer form infers no filter by the length of the list, which would make the list twice
    rows = held.select("*", F.posexplode_outer("made").alias("i", "m")).drop("made").where("i IS NOT NULL").select("*", "m.x", "m.span")
    span, body, kind = F.col("span"), F.col("x.chunk_text"), F.col("x.section_type")
    title = F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTION_TITLES.items() for x in kv]), kind)
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTION_WEIGHTS.items() for x in kv]), kind), F.lit(OTHER_STORED_WEIGHT))
    always = lambda label, x: F.concat(F.lit(f"{label}："), x)
    some = lambda label, x: F.when(F.col(x) != "", always(label, F.col(x)))
    embedded = F.concat_ws("\n", always("案由", F.col("reason")), always("审级", F.col("trial_level")), always("法院", F.col("court_name")), some("法律关系", "legal_relation"), some("标的物", "subject_type"), some("裁判结果", "result_label"), some("核心争点", "core_issue"), always("章节", title), always("正文", body))
    return rows.select(
        F.col("m.id").alias("chunk_id"), "doc_id", body.alias("chunk_text"), embedded.alias("embedding_text"), kind.alias("section_type"), title.alias("section_title"),
        F.col("x.section_index").alias("section_index"), F.col("i").alias("chunk_index_in_case"), F.col("x.pos").alias("chunk_index_in_section"),
        span["start"].alias("char_start"), span["end"].alias("char_end"), span["line_start"].alias("line_start"), span["line_end"].alias("line_end"),
        F.col("m.prev").alias("prev_chunk_id"), F.col("m.next").alias("next_chunk_id"), F.length(body).alias("chunk_char_len"), F.sha2(body.cast("binary"), 256).alias("chunk_hash"), "full_text_hash",
        "case_name", "case_code", "court_name", "court_region", "reason", "trial_level", "judge_date", "publish_date", "case_type", "statutes",
        F.lit(embedding_model).alias("embedding_model"), F.lit(embedding_version).alias("embedding_version"), F.lit(embedding_dim).alias("embedding_dim"),
        weight.alias("section_weight"), F.array(*[F.lit(q) for q in QUALITY_FLAGS]).alias("quality_flags"), "schema_version",
    )


def build_index(spark: SparkSession, corpus_path: str, out: str, source_file: str | None = None, **settings) -> None:
    """Corpus file to stored cases and chunks: ``out``/cases and ``out``/chunks, rewritten as wholes."""
    cases = case_rows(read_corpus(spark, corpus_path), source_file or corpus_path)
    cases.drop("sections", "legal_relation", "subject_type", "result_label", "core_issue").write.mode("overwrite").parquet(f"{out}/cases")
    chunk_rows(cases, **settings).write.mode("overwrite").parquet(f"{out}/chunks")
