"""Export of an index build: cases, chunks, statistics, a sample and the fields' types from one pass over the corpus."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import SECTION_TITLES
from ..operators.upkeep import upsert_stored
from ..plans import index_build
from ..session import drop_folder, shared_folder

PARTS = ("cases", "chunks", "stats", "sample", "mapping")
SAMPLE, SAMPLE_CHARS = 12, 360


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_build(spark: SparkSession, build: str, out: str, batch: str = "0", dry_run: bool = False, recreate: bool = False, skip_create: bool = False) -> dict:
    """Load an exported build into stored tables ``out``/cases and ``out``/chunks by id; returns the summary.

    A missing part counts 0 rows. ``dry_run`` only counts; ``recreate`` deletes
    the tables first; without it an existing table is an error, unless
    ``skip_create`` adds to it. ``batch`` orders loads: of rows with one id that
    of the greatest batch stays, so a load that is run again changes nothing.
    """
    keys = {"cases": "doc_id", "chunks": "chunk_id"}
    told: dict = {"build": build, "out": out, "dry_run": dry_run}
    for part in keys:
        told[f"{part[:-1]}_count"] = spark.read.text(f"{build}/{part}").where(F.trim("value") != "").count() if _exists(spark, f"{build}/{part}") else 0
    if dry_run:
        return told
    if recreate and not skip_create:
        for part in keys:
            drop_folder(spark, f"{out}/{part}")
    elif not skip_create and (there := [p for p in keys if _exists(spark, f"{out}/{p}")]):
        raise FileExistsError(f"{out} holds {', '.join(there)}: recreate them or skip their creation")
    mapping = json.loads(spark.read.text(f"{build}/mapping").first()[0])
    for part, key in keys.items():
        if told[f"{part[:-1]}_count"]:
            rows = spark.read.schema(StructType.fromJson(mapping[part])).json(f"{build}/{part}")
            upsert_stored(rows.where(F.col(key).isNotNull()).withColumn("batch", F.lit(batch)), f"{out}/{part}", key, "batch")
    return told


def _of_kind(kind: str):
    return F.coalesce(F.sum(F.size(F.filter("kinds", lambda x: x == kind))), F.lit(0)).alias(kind)


def export_build(rows: DataFrame, out: str, overwrite: bool = False, source_file: str = "", **settings) -> dict:
    """Write the build of nested rows under ``out`` as JSON lines; returns the statistics.

    Without ``overwrite`` any target that exists is an error before anything is
    read. The rows are read and split once, into a staged table in the shared
    folder, whose write also counts cases, chunks and sections; both sinks are
    projections of that table. Sections without a chunk count 0.
    """
    spark = rows.sparkSession
    there = [p for p in PARTS if _exists(spark, f"{out}/{p}")]
    if there and not overwrite:
        raise FileExistsError(f"{', '.join(there)} under {out}")
    cases = index_build.case_rows(rows, source_file)
    cases = cases.withColumn("pieces", index_build.pieces(F.col("sections")))
    kinds = F.transform("pieces", lambda x: x["section_type"])
    seen = Observation()
    counted = cases.withColumn("kinds", kinds).observe(
        seen,
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(F.sum(F.size("kinds")), F.lit(0)).alias("chunks"),
        *[_of_kind(k) for k in SECTION_TITLES],
    )
    at = shared_folder(spark, "build")
    counted.drop("kinds").write.parquet(at)
    staged = spark.read.schema(counted.drop("kinds").schema).parquet(at)
    chunks = index_build.chunk_rows(staged, cut=True, **settings)
    plain = staged.drop("sections", "pieces", "legal_relation", "subject_type", "result_label", "core_issue")
    for name, part in (("cases", plain), ("chunks", chunks)):
        part.write.mode("overwrite").json(f"{out}/{name}")
    sample = chunks.orderBy("doc_id", "chunk_index_in_case").limit(SAMPLE).select("chunk_id", "case_name", "section_type", F.substring("chunk_text", 1, SAMPLE_CHARS).alias("chunk_text"))
    sample.coalesce(1).write.mode("overwrite").json(f"{out}/sample")
    got = seen.get
    stats = {"source_file": source_file, "cases": got["cases"], "chunks": got["chunks"], "section_counts": {k: got[k] for k in SECTION_TITLES}, "outputs": {p: f"{out}/{p}" for p in PARTS}}
    told = {"stats": stats, "mapping": {"cases": json.loads(plain.schema.json()), "chunks": json.loads(chunks.schema.json())}}
    for name, value in told.items():
        spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/{name}")
    drop_folder(spark, at)
    return stats
