"""Exact cosine search: the stated queries against all vectors, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors of a broadcast block hold at most so many numbers.
BLOCK_NUMBERS = 4 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of each query by (1 + cosine) / 2.

    ``queries``: query_id, embedding; ``vectors``: vec_id, embedding. Products
    are computed in double and rounded to 6 digits before ranking, ties by id.
    Null vectors, vectors of another length than the queries', and vectors
    without an id have no row. Ids keep their type, whole numbers or text.
    Every task keeps its k best of each query, so what is shuffled does not grow
    with the vectors of a task. Queries are broadcast in blocks of bounded size.
    """
    spark = vectors.sparkSession
    asked = queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    total, dims = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    asked = asked.where(F.size("embedding") == (dims or 0))
    blocks = max(1, -(-total // max(1, BLOCK_NUMBERS // (dims or 1))))
    rows = vectors.where((F.size("embedding") == (dims or 0)) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    out = None
    for b in range(blocks):
        got = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        ids = got["query_id"].combine_chunks()
        shared = spark.sparkContext.broadcast((ids, _unit(_matrix(got["embedding"], len(ids)))))
        found = rows.mapInArrow(_scan(shared, k), schema)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column, n: int) -> np.ndarray:
    """The rows of a column of lists of one length."""
    flat = pa.chunked_array(column).combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _scan(shared, k: int):
    def run(batches):
        ids, q = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, object), np.zeros(0)) for _ in range(len(ids))]
        kind = None
        for batch in batches:
            kind = batch.schema.types[0]
            if not batch.num_rows or not len(ids):
                continue
            names = np.array(batch.column(0).to_pylist(), object)
            x = _unit(_matrix(batch.column(1), batch.num_rows))
            scores = np.round((1 + q @ x.T) / 2, 6)
            # only what reaches a query's k-th best so far is sorted in
            least = np.array([s[-1] if len(s) == k else -1.0 for _, s in held])
            for i in np.flatnonzero((scores >= least[:, None]).any(axis=1)):
                some = np.flatnonzero(scores[i] >= least[i])
                n, s = np.concatenate([held[i][0], names[some]]), np.concatenate([held[i][1], scores[i][some]])
                order = np.unique(n, return_inverse=True)[1]
                best = np.lexsort((order, -s))[:k]
                held[i] = (n[best], s[best])
        sizes = [len(n) for n, _ in held]
        if kind is not None:
            owner = pa.array(np.repeat(np.arange(len(ids)), sizes))
            found = [x for n, _ in held for x in n]
            yield pa.RecordBatch.from_arrays([ids.take(owner), pa.array(found, kind), pa.array(np.concatenate([np.zeros(0), *(s for _, s in held)]))], ["query_id", "vec_id", "score"])

    return run
