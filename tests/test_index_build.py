"""Index build: nested rows from a file, missing parts, values as text, splitters in SQL, stored tables."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from docuseam.operators import corpus
from docuseam.plans import build_catalogue, index_build
from test_catalogue import TABLES, plain


@pytest.mark.parametrize("name", sorted(build_catalogue.ORACLES))
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = build_catalogue.QUERIES[name](spark, sf)
    names = sorted(rows.columns)
    want = c.sql(build_catalogue.ORACLES[name])
    at = [want.columns.index(n) for n in names]
    assert sorted(want.columns) == names
    assert sorted((tuple(plain(r[n]) for n in names) for r in rows.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


FULL = {
    "doc_id": "D1#2", "案号": "（2021）沪01号", "法院": "上海某法院", "审级": "一审", "案由": "租赁合同纠纷", "裁判日期": "2021-03-05", "当事人": [{"角色": "原告", "名称": "甲", "类型": "自然人"}],
    "法律关系": "租赁", "标的物类型": "房屋", "争议焦点": {"焦点标签": ["押金", " ", "租金"], "焦点评析": {"案情核心": "核心", "法律争点": "争点", "裁判要旨": "要旨"}, "焦点原文": "原文", "是否显式": True},
    "细争点": {"主叶子": "押金返还", "细争点": ["一", "二"], "裁判规则争点": "规则"}, "裁判结果_标签": "支持",
    "引用法条": [{"法律": "《民法典》", "条": 703, "原文": "租赁合同"}, {"法律": None, "条": None, "原文": None}],
    "段落": {"诉称": "前言。\n原告甲诉称要求返还押金。被告乙辩称不应返还。当事人围绕诉讼请求依法提交了证据，如下。", "查明事实": "2020年1月2日签约。2020年3月4日退租。", "本院认为": "综上，应予支持。关于押金，应当返还。", "裁判结果": "返还押金。"},
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus") / "corpus.jsonl"
    lines = [json.dumps(FULL, ensure_ascii=False), json.dumps({"doc_id": "bare"}), "{broken", json.dumps({"案号": "no id"}, ensure_ascii=False), ""]
    at.write_text("\n".join(lines), "utf-8")
    return str(at), index_build.read_corpus(spark, str(at))


def test_case_of_a_full_and_a_bare_row(rows):
    got = {r.doc_id: r for r in index_build.case_rows(rows[1], "corpus.jsonl").collect()}
    full, bare = got["D1#2"], got["bare"]
    assert len(got) == 2 and full.court_region == "上海" and bare.court_region == "" and bare.reason == "买卖合同纠纷"
    assert full.statutes == ["《民法典》；703；租赁合同", ""] and bare.statutes == [] and bare.case_code == bare.case_name == "bare"
    assert full.core_issue == "押金返还；一；二；押金；租金" and str(full.judge_date) == "2021-03-05" and bare.judge_date is None
    kinds = ["fine_tags", "fine_rule", "focus_tags", "focus_analysis", "claims", "claims", "defense", "facts", "reasoning", "judgment", "statutes"]
    assert [s.section_type for s in full.sections] == kinds
    assert [s.section_text for s in full.sections][4:7] == ["前言。", "原告甲诉称要求返还押金。", "被告乙辩称不应返还。"]
    assert [s.section_type for s in bare.sections] == [k for k in kinds if k not in ("claims", "defense")]
    assert full.full_text.splitlines()[:3] == ["案号：（2021）沪01号", "法院：上海某法院", "案由：租赁合同纠纷"]


def test_chunks_of_a_case(rows):
    cases = index_build.case_rows(rows[1])
    got = [r for r in index_build.chunk_rows(cases, "m", "v").orderBy("doc_id", "chunk_index_in_case").collect() if r.doc_id == "D1#2"]
    text = next(r.full_text for r in cases.collect() if r.doc_id == "D1#2")
    assert len(got[0]) == 34 and got[0].chunk_id == "D1#2#fine_tags#00#000"
    assert [r.chunk_text for r in got if r.section_type == "facts"] == ["2020年1月2日签约。\n2020年3月4日退租。"]
    assert [r.chunk_text for r in got if r.section_type == "reasoning"] == ["综上，应予支持。关于押金，应当返还。"]
    assert [r.prev_chunk_id for r in got] == ["", *(r.chunk_id for r in got[:-1])] and got[-1].next_chunk_id == ""
    for r in got:
        if r.section_type == "facts":  # its pieces lie on one line of the text, so it is found line by line
            assert text[r.char_start : r.char_end] == "2020年1月2日签约。2020年3月4日退租。"
        elif r.section_type not in ("focus_analysis", "reasoning", "focus_tags"):
            assert text[r.char_start : r.char_end] == r.chunk_text, r.chunk_id
        assert r.line_start == text.count("\n", 0, r.char_start) + 1
    assert got[0].embedding_text.splitlines() == ["案由：租赁合同纠纷", "审级：一审", "法院：上海某法院", "法律关系：租赁", "标的物：房屋", "裁判结果：支持", "核心争点：押金返还；一；二；押金；租金", "章节：细争点标签", "正文：主叶子：押金返还", "细争点：一；二"]


def test_build_has_no_shuffle(spark, sf):
    rows = index_build.chunk_rows(index_build.case_rows(build_catalogue.nested_documents(spark, sf)))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_stored_index(spark, rows, tmp_path):
    for _ in range(2):
        index_build.build_index(spark, rows[0], str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/cases")).count() == 2
    chunks = spark.read.parquet(str(tmp_path / "index/chunks"))
    assert chunks.select("chunk_id").distinct().count() == chunks.count() > 10


def test_value_text(spark):
    given = ['{"b": " x ", "a": [1, 2.5, true, null, " ", ["y", {"z": "z"}]]}', '"  only "', "[]", "null", None, "{broken", '[{"k": {"l": ["deep"]}}]']
    rows = spark.createDataFrame(list(enumerate(given)), "i int, v string")
    got = [r.t for r in rows.select("i", index_build.value_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == ["x；1；2.5；True；y；z", "only", "", "", "", "", "deep"]


def test_chunkify_is_the_splitter_of_the_kind(spark):
    index_build.register_splitters(spark)
    text = "一二三四五六七八九。" * 300
    rows = spark.createDataFrame([(k, text) for k in ("facts", "reasoning", "claims", "judgment")] + [("claims", None), ("claims", "")], "k string, t string")
    got = {}
    for r in spark.sql("SELECT k, p.pos, p.chunk_text FROM {rows}, LATERAL chunkify(k, t) p", rows=rows).collect():
        got.setdefault(r.k, {})[r.pos] = r.chunk_text
    for k, v in got.items():
        assert [v[i] for i in range(len(v))] == corpus.split_section(k, text)
    assert len(got["facts"]) > len(got["judgment"]) > 1


def test_rows_of_pieces_carry_no_case_text(spark, sf):
    """What is dealt out as rows must not hold the full text or the lists of its case, whose size would count once per piece."""
    rows = build_catalogue.chunk_build(spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Generate " in line and "explode" in line]
    assert len(dealt) == 1 and "full_text#" not in dealt[0] and "ids#" not in dealt[0] and "spans#" not in dealt[0]


def test_places_of_many_pieces(spark):
    lines = [f"word{i} of {i % 7}" for i in range(20_000)]
    text, pieces = "\n".join(lines), [*lines, lines[3], "none", "word5 of 5\n lost \nword9 of 2"]
    got = list(corpus.place_pieces(text, pieces))
    starts = [sum(len(x) + 1 for x in lines[:k]) for k in range(10)]
    assert [text[a:b] for a, b in got[:20_000]] == lines and [a for a, _ in got] == sorted({a for a, _ in got[:20_000]}) + [starts[3], 0, starts[5]]
    assert got[-2:] == [(0, 4), (starts[5], starts[9] + len(lines[9]))]
    row = spark.createDataFrame([(text, pieces)], "t string, p array<string>").select(corpus.placed("t", "p").alias("s")).first()
    assert [(x.start, x.end) for x in row.s] == got and [x.line_start for x in row.s][:3] == [1, 2, 3] and row.s[-1].line_end == 10
