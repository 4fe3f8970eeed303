"""Incremental upkeep: resume, upserts, lookups, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

#: Folders that the keys of a stored table are dealt to.
FOLDERS = 32


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Union of both where the last row of each key by ``order`` stays; new rows win ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def lookup(cases: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """All wanted cases in one join."""
    return cases.join(ids.select(key).distinct(), key, "left_semi")


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_stored(new: DataFrame, path: str, key: str, order: str, folders: int = FOLDERS) -> int:
    """Put rows into a stored table by key; the last row of a key by ``order`` stays, new rows win ties. Returns the folders written.

    Rows lie in folders by a hash of their key, and only folders that new rows
    fall in are read and written again, so a small batch costs a small part of
    the table. A batch that is run again changes nothing. Null keys count as
    one key.
    """
    spark = new.sparkSession
    folder = F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")
    fresh = kept(new.withColumn("folder", folder))
    touched = sorted(r[0] for r in fresh.select("folder").distinct().collect())
    if not touched:
        return 0
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = fresh.limit(0)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        old = spark.read.schema(fresh.schema).parquet(path).where(F.col("folder").isin(touched))
    merged = kept(upsert(old, fresh, key, order))  # what is written is read no more
    merged.repartition(len(touched), "folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)
    return len(touched)
