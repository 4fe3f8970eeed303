"""Cache-through rewriting: known rewrites come from a stored table, new ones are written through if they are of use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.details import parse_rewrite
from ..session import kept

#: Makes a rewriter in a worker: a function from a query's text to the answer, JSON as text. It may raise.
Factory = Callable[[], Callable[[str], str | None]]
FIELDS = ("expanded_query string, legal_issue string, fact_elements string, statutes string, main_leaf string, focus_labels array<string>, used boolean, fallback_reason string")
CACHE = f"query_text string, rewrite struct<{', '.join(f.replace(' ', ':', 1) for f in FIELDS.split(', '))}>, batch string"
#: Queries of an Arrow batch while a rewriter is asked, so that a slow one hands on what it has.
ASKED_AT_ONCE = 64


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """query_text, rewrite, batch; empty where there is no cache yet."""
    return spark.read.schema(CACHE).parquet(path) if _exists(spark, path) else spark.createDataFrame([], CACHE)


def ask(texts: DataFrame, factory: Factory) -> DataFrame:
    """(query_text, answer, error): each text put to a rewriter, which is made once for each task; errors are told by their names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter, broken = None, None
        for f in frames:
            answers, errors = [], []
            for text in f["query_text"]:
                answer = error = None
                try:
                    if rewriter is None and broken is None:
                        try:
                            rewriter = factory()
                        except Exception as e:
                            broken = e
                    if broken is not None:
                        raise broken
                    answer = rewriter(text)
                except Exception as e:  # the query goes on without a rewrite
                    error = f"llm_error:{type(e).__name__}"
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame({"query_text": f["query_text"], "answer": answers, "error": errors})

    return texts.select("query_text").mapInPandas(run, "query_text string, answer string, error string")


def rewrite_through(queries: DataFrame, cache: str, factory: Factory, batch: str, text: str = "query_text") -> DataFrame:
    """Every row with ``rewrite`` (a struct, see ``parse_rewrite``) and ``cached``, whether it was known before.

    Each distinct text that the cache does not hold is asked once; answers of use
    are written to the cache under the name of the batch. Running a batch again
    keeps what it wrote before and asks only for the rest. Failures are never
    stored, so they are asked again next time. Null and blank texts are not
    asked and count as empty. The rows are written before they are returned.
    """
    spark = queries.sparkSession
    known = read_cache(spark, cache).groupBy("query_text").agg(F.min_by("rewrite", "batch").alias("known"), F.min("batch").alias("in_batch"))
    asked = queries.where(F.trim(F.col(text)) != "").select(F.col(text).alias("query_text")).distinct()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ASKED_AT_ONCE))
    try:
        got = ask(asked.join(known, "query_text", "left_anti"), factory)
        told = got.withColumn("rewrite", parse_rewrite(F.coalesce("answer", F.lit("")))).withColumn("rewrite", F.col("rewrite").withField("fallback_reason", F.coalesce("error", "rewrite.fallback_reason")))
        fresh = kept(told.select("query_text", "rewrite"))  # read twice, asked once
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    before = kept(known)  # the cache as it was; what is written below does not count as known
    mine = read_cache(spark, cache).where(F.col("batch") == batch).select("query_text", "rewrite")
    new = kept(mine.unionByName(fresh.where("rewrite.used")))
    new.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(cache)
    rows = queries.join(before.drop("in_batch"), queries[text].eqNullSafe(before["query_text"]), "left").drop(before["query_text"])
    rows = rows.join(fresh, rows[text].eqNullSafe(fresh["query_text"]), "left").drop(fresh["query_text"])
    whole = F.coalesce("known", "rewrite", parse_rewrite(F.lit("")).withField("fallback_reason", F.lit("empty_query")))
    return rows.withColumn("cached", F.col("known").isNotNull()).withColumn("rewrite", whole).drop("known")


def warm_cache(queries: DataFrame, cache: str, factory: Factory, batch: str, text: str = "query_text") -> DataFrame:
    """One row: asked (distinct texts), cached before, new and failed."""
    rows = rewrite_through(queries.where(F.trim(F.col(text)) != "").select(text).distinct(), cache, factory, batch, text)
    used = F.col("rewrite.used")
    return rows.agg(F.count("*").alias("asked"), F.count_if("cached").alias("cached"), F.count_if(~F.col("cached") & used).alias("new"), F.count_if(~used).alias("failed"))


def rewrite_stream(spark: SparkSession, source: str, schema, cache: str, target: str, state: str, factory: Factory, files: int = 100) -> StreamingQuery:
    """Rewrite queries of files as they come, through the cache, into ``target``.

    Cache and target are written by batch, and a batch that is run again after a
    failure replaces its own rows, so each query has one row.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = rewrite_through(batch, cache, factory, f"stream-{number:09d}")
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
