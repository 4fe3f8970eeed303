"""Registered queries of the index build, with their SQL for DuckDB.

The nested rows are made of the driver's documents: their lines are dealt to the
sections of a case, and full stops and commas become markers of the splitters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CHUNK_SIZES, NESTED_ROW, OTHER_CHUNK_SIZE, SECTION_TITLES, SECTION_WEIGHTS
from . import index_build
from .catalogue import _clean, _t

CLAIM, DEFENSE, DATE, ABOUT = "。原告甲诉称", "。被告乙辩称", "。2020年1月2日", "。关于"


def nested_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nested rows of cases."""
    docs = _t(spark, sf, "documents")
    lines = F.split("text", "\n")
    every_fourth = lambda k: F.array_join(F.filter(lines, lambda x, i: i % 4 == k), "\n")
    part = [every_fourth(k) for k in range(4)]
    swap = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    odd = F.col("doc_id") % 2 == 1
    none = lambda kind: F.lit(None).cast(kind)
    analysis = F.struct(F.substring("text", 1, 60).alias("案情核心"), none("string").alias("法律争点"), F.substring("text", 61, 60).alias("裁判要旨"))
    focus = F.struct(F.array("lang", F.lit(" "), "source").alias("焦点标签"), analysis.alias("焦点评析"), F.substring("text", 200, 50).alias("焦点原文"), F.lit(False).alias("是否显式"))
    law = lambda name, number, text: F.struct(name.alias("法律"), number.alias("条"), text.alias("原文"))
    paragraph = F.struct(
        swap(swap(part[1], ". ", CLAIM), ", ", DEFENSE).alias("诉称"),
        swap(part[2], ". ", DATE).alias("查明事实"),
        swap(part[3], ". ", ABOUT).alias("本院认为"),
        F.element_at(lines, -1).alias("裁判结果"),
    )
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("(2021)"), "doc_id", F.lit("号"))).alias("案号"),
        F.col("source").alias("法院"),
        none("string").alias("审级"),
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).otherwise("").alias("案由"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise("2021-03-05").alias("裁判日期"),
        none("array<struct<`角色`:string,`名称`:string,`类型`:string>>").alias("当事人"),
        F.col("lang").alias("法律关系"),
        F.when(odd, F.col("source")).alias("标的物类型"),
        F.when(F.col("doc_id") % 7 != 0, focus).alias("争议焦点"),
        F.struct(F.col("lang").alias("主叶子"), F.array("source", F.concat("source", F.lit("x"))).alias("细争点"), part[0].alias("裁判规则争点")).alias("细争点"),
        none("string").alias("裁判结果_标签"),
        F.array(law(F.concat(F.lit("《"), "lang", F.lit("》")), (F.col("n_chars") % 100).cast("int"), F.substring("text", 1, 20)), law(none("string"), none("int"), F.lit(""))).alias("引用法条"),
        paragraph.alias("段落"),
    )
    return rows.to(spark.createDataFrame([], NESTED_ROW).schema)


def case_build(spark, sf):
    """Case rows of the nested documents."""
    rows = index_build.case_rows(nested_documents(spark, sf))
    return rows.select("doc_id", "case_code", "case_name", "court_name", "court_region", "reason", F.col("judge_date").cast("string").alias("judge_date"), F.array_join("statutes", "|").alias("statutes"), "full_text_hash", "core_issue")


def section_build(spark, sf):
    """Every section of every case in the order of the build."""
    rows = index_build.case_rows(nested_documents(spark, sf)).select("doc_id", F.posexplode("sections").alias("section_index", "s"))
    return rows.select("doc_id", "section_index", "s.section_type", F.length("s.section_text").alias("n"), F.sha2(F.col("s.section_text").cast("binary"), 256).alias("hash"))


def section_pieces(spark, sf):
    """Pieces of every section, cut by the table function of the splitters in a LATERAL join."""
    index_build.register_splitters(spark)
    rows = index_build.case_rows(nested_documents(spark, sf)).select("doc_id", F.posexplode("sections").alias("section_index", "s"))
    cut = spark.sql("SELECT doc_id, section_index, s.section_type, p.pos, p.chunk_text FROM {rows}, LATERAL chunkify(s.section_type, s.section_text) AS p", rows=rows)
    return cut.select("doc_id", "section_index", "section_type", "pos", F.length("chunk_text").alias("n"), F.sha2(F.col("chunk_text").cast("binary"), 256).alias("hash"))


def chunk_build(spark, sf):
    """Chunk records of all cases."""
    rows = index_build.chunk_rows(index_build.case_rows(nested_documents(spark, sf)))
    return rows.select(
        "chunk_id", "doc_id", "section_type", "section_title", "section_index", "chunk_index_in_case", "chunk_index_in_section", "char_start", "char_end", "line_start", "line_end", "prev_chunk_id", "next_chunk_id",
        "chunk_char_len", "chunk_hash", "full_text_hash", F.sha2(F.col("embedding_text").cast("binary"), 256).alias("embedding_hash"), "case_name", "case_code", "court_name", "court_region", "reason",
        F.col("judge_date").cast("string").alias("judge_date"), "case_type", F.array_join("statutes", "|").alias("statutes"), "embedding_dim", "section_weight", F.array_join("quality_flags", ",").alias("quality_flags"),
    )


def value_texts(spark, sf):
    """Conversations as nested JSON of four levels, with blanks and nulls, as one text each."""
    said = F.struct(F.col("turn").alias("turn"), F.struct(F.col("role").alias("zz_role"), F.struct(F.col("text").alias("text"), F.lit("  ").alias("blank"), F.lit(None).cast("string").alias("none")).alias("said")).alias("by"))
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))  # a conversation is one row's worth
    whole = F.to_json(F.struct(F.lit(True).alias("open"), "turns", F.col("conv_id").alias("id")), {"ignoreNullFields": "false"})
    return rows.select("conv_id", index_build.value_text(whole).alias("t")).select("conv_id", F.length("t").alias("n"), F.sha2(F.col("t").cast("binary"), 256).alias("hash"))


QUERIES = {f.__name__: f for f in (case_build, section_build, section_pieces, chunk_build, value_texts)}


# --- SQL --------------------------------------------------------------------


def _part(k: int) -> str:
    return f"array_to_string(list_filter(list_transform(l, lambda x, i: CASE WHEN i % 4 = {(k + 1) % 4} THEN x END), lambda x: x IS NOT NULL), chr(10))"


def _said(label: str, x: str) -> str:
    return f"'{label}：' || coalesce({x}, '')"


_PARTS = [
    ("案号", "code"), ("法院", "source"), ("案由", "cause"), ("法律关系", "lang"), ("标的物类型", "subject"), ("焦点标签", "labels"), ("案情核心", "core"), ("法律争点", "NULL"), ("裁判要旨", "ruling"),
    ("主叶子", "lang"), ("细争点", "fine"), ("裁判规则争点", "rule"), ("诉称", "claims"), ("查明事实", "facts"), ("本院认为", "reasoning"), ("裁判结果", "judgment"), ("引用法条", "articles"),
]

_CASES = f"""
src AS (SELECT doc_id AS d, doc_id::VARCHAR AS doc_id, text, lang, source, n_chars, string_split(text, chr(10)) AS l, doc_id % 7 <> 0 AS focused FROM documents),
fields AS (
  SELECT d, doc_id, lang, source,
    CASE WHEN d % 5 <> 0 THEN '(2021)' || d || '号' END AS code, CASE WHEN d % 3 <> 0 THEN lang ELSE '' END AS cause, CASE WHEN d % 2 = 1 THEN source END AS subject,
    CASE WHEN focused THEN lang || '；' || source ELSE '' END AS labels, CASE WHEN focused THEN substring(text, 1, 60) END AS core, CASE WHEN focused THEN substring(text, 61, 60) END AS ruling,
    CASE WHEN focused THEN substring(text, 200, 50) END AS original, source || '；' || source || 'x' AS fine, {_part(0)} AS rule,
    replace(replace({_part(1)}, '. ', '{CLAIM}'), ', ', '{DEFENSE}') AS claims, replace({_part(2)}, '. ', '{DATE}') AS facts, replace({_part(3)}, '. ', '{ABOUT}') AS reasoning, l[-1] AS judgment,
    '《' || lang || '》 第' || (n_chars % 100) || '条 ' || substring(text, 1, 20) AS first_article, '《' || lang || '》；' || (n_chars % 100) || coalesce('；' || nullif({_clean('substring(text, 1, 20)')}, ''), '') AS cited
  FROM src),
lined AS (SELECT *, regexp_replace(first_article, '^[\\s]+|[\\s]+$', '', 'g') || chr(10) || '第None条' AS articles FROM fields),
cases AS (
  SELECT *, {_clean(f"array_to_string(list_filter([{', '.join(_said(k, v) for k, v in _PARTS)}], lambda p: NOT ends_with(p, '：')), chr(10) || chr(10))")} AS full_text,
    coalesce(code, doc_id) AS case_code, coalesce(code, doc_id) AS case_name, coalesce(nullif(cause, ''), '买卖合同纠纷') AS reason, CASE WHEN d % 4 <> 0 THEN '2021-03-05' END AS judge_date,
    cited || '|' AS statutes, lang || '；' || fine || CASE WHEN labels <> '' THEN '；' || labels ELSE '' END AS core_issue
  FROM lined),
pleaded AS (
  SELECT d, list_filter(list_transform(string_split(replace(replace({_clean('claims')}, '原告甲诉称', chr(1) || '原告甲诉称'), '被告乙辩称', chr(1) || '被告乙辩称'), chr(1)), lambda x: {_clean('x')}), lambda x: x <> '') AS parts FROM cases),
listed AS (
  SELECT d, doc_id, list_concat(
    [struct_pack(kind := 'fine_tags', t := {_said('主叶子', 'lang')} || chr(10) || {_said('细争点', 'fine')}), struct_pack(kind := 'fine_rule', t := {_said('裁判规则争点', 'rule')}),
     struct_pack(kind := 'focus_tags', t := {_said('焦点标签', 'labels')}),
     struct_pack(kind := 'focus_analysis', t := {_said('案情核心', 'core')} || chr(10) || {_said('法律争点', 'NULL')} || chr(10) || {_said('裁判要旨', 'ruling')} || chr(10) || {_said('焦点原文', 'original')})],
    list_transform(parts, lambda x: struct_pack(kind := CASE WHEN starts_with(x, '被告乙辩称') THEN 'defense' ELSE 'claims' END, t := x)),
    [struct_pack(kind := 'facts', t := facts), struct_pack(kind := 'reasoning', t := reasoning), struct_pack(kind := 'judgment', t := judgment), struct_pack(kind := 'statutes', t := articles)]) AS s
  FROM cases JOIN pleaded USING (d)),
sections AS (SELECT d, doc_id, si, s[si + 1].kind AS kind, s[si + 1].t AS t FROM (SELECT *, unnest(range(len(s)))::INT AS si FROM listed))"""


def _sizes(k: int) -> str:
    return "CASE " + " ".join(f"WHEN kind = '{s}' THEN {v[k]}" for s, v in CHUNK_SIZES.items()) + f" ELSE {OTHER_CHUNK_SIZE[k]} END"


def _end(a: str) -> str:
    """End of the piece of ``t`` that starts at ``a``."""
    last = f"list_min(list_filter([strpos(reverse(substring(t, {a} + most // 2 + 1, most - most // 2)), m) for m in ['。', chr(10)]], lambda i: i > 0))"
    return f"CASE WHEN length(t) <= {a} + most THEN length(t) ELSE {a} + most + 1 - coalesce({last}, 1) END"


_PIECES = f"""
units AS (
  SELECT d, si, kind, {_sizes(0)} AS most, {_sizes(1)} AS overlap,
    CASE WHEN kind IN ('facts', 'reasoning') THEN list_filter(list_transform(string_split(replace(replace(replace({_clean('t')}, '2020年1月2日', CASE WHEN kind = 'facts' THEN chr(1) ELSE '' END || '2020年1月2日'), '关于', CASE WHEN kind = 'reasoning' THEN chr(1) ELSE '' END || '关于'), chr(10), chr(1)), chr(1)), lambda x: {_clean('x')}), lambda x: x <> '')
      ELSE list_filter([{_clean('t')}], lambda x: x <> '') END AS u FROM sections),
unit AS (SELECT d, si, kind, most, overlap, n, u[n] AS x, len(u) AS total FROM (SELECT *, unnest(range(1, len(u) + 1)) AS n FROM units)),
heads AS (
  SELECT d, si, n, false AS skip, length(x) AS w FROM unit WHERE kind = 'reasoning' AND n = 1
  UNION ALL SELECT u.d, u.si, u.n, NOT skip AND w < 12, length(x) FROM heads h JOIN unit u ON u.d = h.d AND u.si = h.si AND u.n = h.n + 1),
joined AS (
  SELECT u.d, u.si, u.kind, u.most, u.overlap, u.n AS grp, u.x || CASE WHEN length(u.x) < 12 THEN coalesce(v.x, '') ELSE '' END AS t FROM unit u JOIN heads h ON h.d = u.d AND h.si = u.si AND h.n = u.n AND NOT skip LEFT JOIN unit v ON v.d = u.d AND v.si = u.si AND v.n = u.n + 1),
packs AS (
  SELECT d, si, n, 1::BIGINT AS grp, CASE WHEN length(x) > most THEN -1 ELSE length(x) END AS w FROM unit WHERE kind = 'facts' AND n = 1
  UNION ALL SELECT u.d, u.si, u.n, grp + CASE WHEN length(x) <= most AND w >= 0 AND w + 1 + length(x) <= most THEN 0 ELSE 1 END, CASE WHEN length(x) > most THEN -1 WHEN w >= 0 AND w + 1 + length(x) <= most THEN w + 1 + length(x) ELSE length(x) END
  FROM packs p JOIN unit u ON u.d = p.d AND u.si = p.si AND u.n = p.n + 1),
whole AS (
  SELECT d, si, kind, most, overlap, grp, string_agg(x, chr(10) ORDER BY n) AS t FROM packs JOIN unit USING (d, si, n) GROUP BY ALL
  UNION ALL SELECT d, si, kind, most, overlap, grp, t FROM joined
  UNION ALL SELECT d, si, kind, most, overlap, n, x FROM unit WHERE kind NOT IN ('facts', 'reasoning')),
cuts AS (
  SELECT *, 0::BIGINT AS a, {_end('0')} AS b FROM whole
  UNION ALL SELECT d, si, kind, most, overlap, grp, t, s AS a, {_end('s')} AS b FROM (SELECT *, greatest(a + 1, b - overlap) AS s FROM cuts WHERE b < length(t))),
pieces AS (
  SELECT d, si, kind, piece, (row_number() OVER (PARTITION BY d, si ORDER BY grp, a) - 1)::INT AS pos, (row_number() OVER (PARTITION BY d ORDER BY si, grp, a) - 1)::INT AS i
  FROM (SELECT *, CASE WHEN length(t) <= most THEN t ELSE {_clean('substring(t, a + 1, b - a)')} END AS piece FROM cuts) WHERE piece <> '')"""


def _find(x: str) -> str:
    return f"coalesce(nullif(strpos(substr(full_text, hint + 1), {x}), 0) + hint, nullif(strpos(full_text, {x}), 0)) - 1"


_THROUGH = "list_reduce(list_filter(string_split(piece, chr(10)), lambda x: x <> '')[2:], lambda c, x: CASE WHEN strpos(substr(full_text, c + 1), x) > 0 THEN c + strpos(substr(full_text, c + 1), x) - 1 + length(x) ELSE c END, head + length(string_split(piece, chr(10))[1]))"
_PLACE = f"""SELECT d, i, coalesce(found, head, 0) AS a, CASE WHEN found IS NOT NULL THEN found + length(piece) WHEN head IS NOT NULL THEN {_THROUGH} ELSE length(piece) END AS b, found IS NULL AND head IS NULL AS lost, hint AS before
  FROM (SELECT *, {_find('piece')} AS found, {_find('string_split(piece, chr(10))[1]')} AS head FROM """
_PLACES = f"""
text_pieces AS (SELECT d, i, piece, full_text FROM pieces JOIN cases USING (d)),
places AS (
  {_PLACE}(SELECT *, 0::BIGINT AS hint FROM text_pieces WHERE i = 0))
  UNION ALL {_PLACE}(SELECT t.*, CASE WHEN lost THEN before ELSE b END AS hint FROM places p JOIN text_pieces t ON t.d = p.d AND t.i = p.i + 1)))"""


def _table(values: dict, key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {other} END"


def _line(at: str) -> str:
    return f"(length(substring(full_text, 1, {at})) - length(replace(substring(full_text, 1, {at}), chr(10), '')) + 1)::INT"


ORACLES = {
    "case_build": f"WITH {_CASES} SELECT doc_id, case_code, case_name, source AS court_name, '' AS court_region, reason, judge_date, statutes, sha256(full_text) AS full_text_hash, core_issue FROM cases",
    "section_build": f"WITH {_CASES} SELECT doc_id, si AS section_index, kind AS section_type, length(t)::INT AS n, sha256(t) AS hash FROM sections",
    "section_pieces": f"WITH RECURSIVE {_CASES}, {_PIECES} SELECT d::VARCHAR AS doc_id, si AS section_index, kind AS section_type, pos, length(piece)::INT AS n, sha256(piece) AS hash FROM pieces",
    "chunk_build": f"""WITH RECURSIVE {_CASES}, {_PIECES}, {_PLACES},
ids AS (SELECT *, printf('%s#%s#%02d#%03d', d::VARCHAR, kind, si, pos) AS chunk_id FROM pieces)
SELECT chunk_id, doc_id, kind AS section_type, {_table(SECTION_TITLES, 'kind', 'NULL')} AS section_title, si AS section_index, i AS chunk_index_in_case, pos AS chunk_index_in_section, a::INT AS char_start, b::INT AS char_end, {_line('a')} AS line_start, {_line('b')} AS line_end,
  coalesce(lag(chunk_id) OVER w, '') AS prev_chunk_id, coalesce(lead(chunk_id) OVER w, '') AS next_chunk_id, length(piece)::INT AS chunk_char_len, sha256(piece) AS chunk_hash, sha256(full_text) AS full_text_hash,
  sha256('案由：' || reason || chr(10) || '审级：' || chr(10) || '法院：' || source || chr(10) || '法律关系：' || lang || CASE WHEN subject IS NOT NULL THEN chr(10) || '标的物：' || subject ELSE '' END || chr(10) || '核心争点：' || core_issue || chr(10) || '章节：' || {_table(SECTION_TITLES, 'kind', 'NULL')} || chr(10) || '正文：' || piece) AS embedding_hash,
  case_name, case_code, source AS court_name, '' AS court_region, reason, judge_date, '民事' AS case_type, statutes, 1024 AS embedding_dim, ({_table(SECTION_WEIGHTS, 'kind', '1.0')})::DOUBLE AS section_weight, 'caselaw_benchmark_structured' AS quality_flags
FROM ids JOIN places USING (d, i) JOIN cases USING (d) WINDOW w AS (PARTITION BY d ORDER BY i)""",
    "value_texts": """WITH c AS (SELECT conv_id, list(turn::VARCHAR || '；' || role || CASE WHEN trim(text) <> '' THEN '；' || text ELSE '' END ORDER BY turn) AS said FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, 'True；' || array_to_string(said, '；') || '；' || conv_id AS t FROM c) SELECT conv_id, length(t)::INT AS n, sha256(t) AS hash FROM t""",
}
