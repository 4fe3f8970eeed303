"""Readers and writers: JSON lines, qrels, runs, CSV; tables and bulk loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QRELS = "query_id string, query_source_doc string, candidates array<struct<doc_id:string,`grade_主档`:int,`grade_期望`:double,grade_std:double>>"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped before ``limit`` counts."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.json(path)
    return rows.limit(limit) if limit else rows


def read_jsonl_head(spark: SparkSession, path: str, schema: T.StructType | str, lines: int) -> DataFrame:
    """The rows of a file's first lines, blank ones counted."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at")).orderBy("_file", "_at").limit(lines)
    return rows.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists, else the first one."""
    return next((p for p in paths if p and exists(spark, p)), paths[0])


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_json_object(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object over many lines; a corrupt one gives nulls, a missing file no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade, gain, anchor); of repeated pairs the last candidate counts."""
    rows = spark.read.schema(QRELS).json(path).select("query_id", F.col("query_source_doc").alias("anchor"), F.posexplode("candidates").alias("pos", "c"))
    w = Window.partitionBy("query_id", "c.doc_id").orderBy(F.desc("pos"))
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    grade = F.coalesce("c.grade_主档", F.lit(0))
    return rows.select("query_id", "c.doc_id", grade.alias("grade"), F.coalesce("c.grade_期望", grade.cast("double")).alias("gain"), "anchor")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rank); of repeated queries the later line counts."""
    rows = spark.read.schema("query_id string, ranking array<string>").json(path).withColumn("at", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")))
    rows = rows.groupBy("query_id").agg(F.max_by("ranking", "at").alias("ranking"))
    return rows.select("query_id", F.posexplode("ranking").alias("pos", "doc_id")).select("query_id", "doc_id", (F.col("pos") + 1).alias("rank"))


def read_trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Four columns separated by white space: query, unused, document, grade."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), F.col("p")[3].try_cast("int").alias("grade"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def write_report(chunks: DataFrame, path: str, sample: int = 12, limit: int = 360) -> None:
    """Counts of the chunks by section, and their first ones with the text cut, as JSON beside each other."""
    counts = chunks.groupBy("section_type").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"))
    counts.write.mode("overwrite").json(f"{path}/stats")
    some = chunks.orderBy("doc_id", "section_index", "chunk_id").limit(sample)
    some.select("doc_id", "chunk_id", "section_type", F.substring("chunk_text", 1, limit).alias("chunk_text")).write.mode("overwrite").json(f"{path}/sample")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; without ``overwrite`` an existing target is an error."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_table(rows: DataFrame, name: str, key: str | None = None, buckets: int = 64, recreate: bool = False) -> None:
    """A Parquet table, bucketed and sorted by ``key`` so that joins on it need no shuffle."""
    writer = rows.write.format("parquet").mode("overwrite" if recreate else "errorifexists")
    (writer.bucketBy(buckets, key).sortBy(key) if key else writer).saveAsTable(name)
