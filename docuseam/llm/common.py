"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold at most this many bytes or rows, so that one batch of
#: long texts still fits a small Python worker.
ARROW_BYTES = 16 << 20
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def ship(spark: SparkSession, model: object) -> Broadcast:
    """Broadcast a model of bounded size together with its class."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def shipped(shared: Broadcast):
    """The broadcast model, in a task; a worker makes it once and keeps it with the broadcast."""
    if not hasattr(shared, "model"):
        shared.model = cloudpickle.loads(shared.value)
    return shared.model


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def other_columns(df: DataFrame, *names: str | None) -> list[str]:
    """The columns that have none of these names in any case."""
    taken = {n.lower() for n in names if n}
    return [c for c in df.columns if c.lower() not in taken]


def crc_mod(doc_id: Column, mod: int) -> Column:
    """Remainder of crc32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(mod)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared folder; a folder of the driver's is set only where driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}"))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys with more than this share of the rows, and this many at least, are hot; so there are at most a thousand of them.
HOT_SHARE, HOT_ROWS = 0.001, 10_000


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys that hold more than a thousandth of all rows: counted with partial sums, a thousand at most."""
    total = rows.count()
    if total < HOT_ROWS:
        return []
    least = max(HOT_ROWS, int(HOT_SHARE * total))
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least)
    return [r[0] for r in found.select(key).collect()]


def join_hot(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with a frame that has each key once, where some keys may hold most rows.

    The partners of hot keys, a thousand at most, are broadcast, so that the rows
    of such a key stay where they are; all others are shuffled as usual.
    """
    hot = hot_keys(rows, key)
    if not hot:
        return rows.join(few, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(few.where(is_hot)), key).unionByName(rows.where(~is_hot).join(few, key))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type, in any
    direction. Alternates large-star and small-star steps until the set of
    edges no longer changes; each step is a group-by with partial aggregation
    and a join on the node, in which hubs are dealt apart. Returns
    ``node`` and ``root``; nodes without edges are absent. Self loops and null
    ends are ignored.
    """
    e = edges.select("a", "b").where("a <> b").distinct()
    e = cut_lineage(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        # large star: every larger neighbour of u links to u's smallest neighbour or u
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = join_hot(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, link to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        sign = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components are not finished after {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
