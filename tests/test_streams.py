"""Streams: rewrites through the cache with failures, reruns and restarts; visits, windows and late rows against batches."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from docuseam.operators import profile
from docuseam.streaming import incremental, rewrites, visits


def echo(log=None):
    """A rewriter that echoes the text; it raises on 'bad', answers nonsense on 'odd', and makes a note of each call."""

    def make():
        def answer(text):
            if log:
                with open(log, "a") as f:
                    f.write(text + "\n")
            if "bad" in text:
                raise ValueError(text)
            return "no json" if "odd" in text else json.dumps({"legal_issue": f"issue of {text}", "focus_labels": ["a", 3, " "]})

        return answer

    return make


def told(rows):
    return {r.query_text: (r.cached, r.rewrite.used, r.rewrite.fallback_reason, r.rewrite.legal_issue) for r in rows.collect()}


def test_only_answers_of_use_are_cached(spark, tmp_path):
    cache, log = str(tmp_path / "cache"), str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "one"), (2, "one"), (3, "bad two"), (4, "odd three"), (5, None), (6, "  ")], "id int, query_text string")
    first = rewrites.rewrite_through(rows, cache, echo(log), "a")
    assert first.count() == 6
    got = told(first)
    assert got["one"] == (False, True, "", "issue of one") and got["bad two"][1:3] == (False, "llm_error:ValueError") and got["odd three"][1:3] == (False, "invalid_json")
    assert got[None][1:3] == got["  "][1:3] == (False, "empty_query")
    assert sorted(open(log).read().split("\n")) == ["", "bad two", "odd three", "one"]
    again = told(rewrites.rewrite_through(rows, cache, echo(log), "b"))
    assert again["one"] == (True, True, "", "issue of one") and not again["bad two"][0]
    assert open(log).read().split("\n").count("one") == 1 and open(log).read().split("\n").count("bad two") == 2
    assert [r.query_text for r in rewrites.read_cache(spark, cache).collect()] == ["one"]


def test_a_batch_run_again_keeps_its_rows(spark, tmp_path):
    cache, log = str(tmp_path / "cache"), str(tmp_path / "log")
    part = spark.createDataFrame([("one",), ("two",)], "query_text string")
    for _ in range(2):
        rewrites.rewrite_through(part, cache, echo(log), "a")
    rewrites.rewrite_through(part.union(spark.createDataFrame([("three",)], "query_text string")), cache, echo(log), "a")
    assert sorted(r.query_text for r in rewrites.read_cache(spark, cache).collect()) == ["one", "three", "two"]
    assert sorted(open(log).read().split()) == ["one", "three", "two"]


def test_warm_cache_and_a_rewriter_that_cannot_be_made(spark, tmp_path):
    def broken():
        raise KeyError("no key")

    rows = spark.createDataFrame([("one",), ("one",), ("bad",)], "query_text string")
    cache = str(tmp_path / "cache")
    assert tuple(rewrites.warm_cache(rows, cache, broken, "a").first()) == (2, 0, 0, 2)
    assert tuple(rewrites.warm_cache(rows, cache, echo(), "b").first()) == (2, 0, 1, 1)
    assert tuple(rewrites.warm_cache(rows, cache, broken, "c").first()) == (2, 1, 0, 1)


def test_rewrite_stream_survives_a_failure(spark, tmp_path):
    """The second batch fails between cache and target; after the restart every query has one row and was asked once."""
    source, cache, out, state, log = (str(tmp_path / n) for n in ("in", "cache", "out", "state", "log"))
    for part in (["q1", "q2"], ["q2", "q3", "bad q"]):
        spark.createDataFrame([(t,) for t in part], "query_text string").coalesce(1).write.mode("append").parquet(source)
        calls = rewrites.rewrite_through
        if "q3" in part:

            def failing(batch, at, factory, name, text="query_text"):
                calls(batch, at, factory, name, text)
                raise RuntimeError("lost")

            rewrites.rewrite_through = failing
            try:
                with pytest.raises(Exception, match="lost"):
                    rewrites.rewrite_stream(spark, source, "query_text string", cache, out, state, echo(log), 1).awaitTermination()
            finally:
                rewrites.rewrite_through = calls
        rewrites.rewrite_stream(spark, source, "query_text string", cache, out, state, echo(log), 1).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r.query_text for r in rows.collect()) == ["bad q", "q1", "q2", "q2", "q3"]
    assert sorted(r.query_text for r in rewrites.read_cache(spark, cache).collect()) == ["q1", "q2", "q3"]
    asked = open(log).read().split("\n")
    assert [asked.count(q) for q in ("q1", "q2", "q3")] == [1, 1, 1] and asked.count("bad q") == 2


def test_rerank_query_takes_the_rewrite(spark):
    rw = "struct<legal_issue:string,fact_elements:string,statutes:string,main_leaf:string,expanded_query:string,used:boolean>"
    rows = spark.createDataFrame([(1, "法院如何认定买卖合同成立？", ("无书面合同", "微信对账", "民法典第五百九十五条", "A1", "扩展", True)), (2, "法院如何认定买卖合同成立？", ("无书面合同", "微信对账", "", "", "", False)), (3, "法院如何认定买卖合同成立？", None)], f"query_id int, query_text string, rewrite {rw}")
    got = {r.query_id: (r.a, r.b) for r in profile.add_profile(rows).select("query_id", profile.rerank_query(F.col("profile"), F.col("rewrite")).alias("a"), profile.rerank_query(F.col("profile")).alias("b")).collect()}
    assert all(x in got[1][0] for x in ("LLM核心争点：无书面合同", "LLM事实要素：微信对账", "LLM法条：民法典第五百九十五条")) and "A1" not in got[1][0] and "扩展" not in got[1][0]
    assert got[1][0].startswith(got[1][1]) and got[2][0] == got[2][1] == got[3][0]


# --- event time ---------------------------------------------------------------


T0 = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + datetime.timedelta(minutes=m), u, k, v) for i, (m, u, k, v) in enumerate(rows)], EVENTS)


def run(spark, make, source, out, state):
    stream = make(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source))
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_windows_drop_late_rows_and_survive_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [[(10, 1, "a", 1.0), (70, 1, "a", 2.0)], [(50, 2, "a", 4.0), (400, 1, "b", 1.0)], [(20, 3, "a", 100.0), (600, 2, "b", 1.0)], [(1200, 1, "z", 0.0)]]
    for k, part in enumerate(parts):
        events(spark, part).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):  # stopped and started again with the state of before
            run(spark, incremental.windowed_counts, source, out, state)
    got = {(r.window_start, r.event_type): (r.events, r.value) for r in spark.read.parquet(out).collect()}
    on_time = events(spark, [r for p in parts for r in p if r[3] != 100.0])  # the row of minute 20 came after the watermark of minute 280
    want = {(r.window_start, r.event_type): (r.events, r.value) for r in incremental.windowed_counts(on_time).collect() if r.event_type != "z"}
    assert got == want


def test_visits_equal_the_batch(spark, tmp_path):
    """Visits of a stream in three files and two runs against sessions of the batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [[(0, 1, "a", 1.0), (20, 1, "b", 2.0), (25, 2, "a", 1.5)], [(45, 1, "c", 3.0), (10, 1, "a", 0.5), (200, 2, "b", 1.0)], [(500, 1, "a", 1.0), (515, 1, "b", 1.0)], [(3000, 9, "z", 0.0)], [(3001, 9, "z", 0.0)]]
    for k, part in enumerate(parts):
        events(spark, part).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3, 4):
            run(spark, visits.visits_stream, source, out, state)
    got = sorted((r.user_id, r.visit_start, r.visit_end, r.events, r.value, r.last_type) for r in spark.read.parquet(out).collect())
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    assert [(u, a.replace(tzinfo=None), b.replace(tzinfo=None), n, v, t) for u, a, b, n, v, t in got] == [(1, at(0), at(45), 4, 6.5, "c"), (1, at(500), at(515), 2, 2.0, "b"), (2, at(25), at(25), 1, 1.5, "a"), (2, at(200), at(200), 1, 1.0, "b")]
