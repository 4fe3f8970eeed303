"""Stored inverted index: postings by block of chunks, dealt to folders by term, appended batch by batch.

A block is up to ``BLOCK_ROWS`` chunks of one task. Its head row holds the keys,
lengths and groups of the chunks; each of its terms has a row with the chunks'
places and counts. Rows lie in folders by batch and by a hash of the term, so a
search reads the folders of its terms only, and writing a batch again replaces
it. A search brings the postings of its terms together block by block, scores
them for many queries at once, and never reads a text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import or_empty, tokens
from ..session import bounded_batches
from .lexical import K1, B, _words, letters

BLOCK_ROWS = 4096
#: Folders that terms are dealt to; heads of blocks have folder -1.
FOLDERS = 64
HEAD = -1
#: Queries that are scored at once, the terms of a block of queries, and terms that are looked up by name in the scan's filter.
BLOCK_QUERIES, BLOCK_TERMS, NAMED_TERMS = 512, 100_000, 2000
#: Chunks times queries from which a term's scores are made by a product of matrices, and the terms of such a product.
FREQUENT, GATHERED = 1000, 256


def _folder(term, folders: int):
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def append_postings(rows: DataFrame, path: str, batch: str, key: str = "chunk_id", text: str = "chunk_text", group: str | None = "section_type", folders: int = FOLDERS) -> None:
    """Add the chunks of a batch to the index at ``path``; a batch of this name is replaced.

    Chunks without words are left out. Keys and groups are stored as text. All
    batches of an index, and its searches, need the same number of folders.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError("a batch is named by letters, digits, _ and -")
    bounded_batches(rows.sparkSession)
    listed = rows.select(F.col(key).cast("string").alias("key"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"), F.lower(or_empty(F.col(text))).alias("text"))
    schema = "block string, term string, at array<int>, tf array<int>, dl array<int>, keys array<string>, grps array<string>"
    posted = listed.mapInArrow(_post(batch, rows.sparkSession.sparkContext.broadcast(letters())), schema).withColumn("folder", F.when(F.col("term").isNull(), HEAD).otherwise(_folder("term", folders)))
    # one folder's rows meet in few files; large folders are split, small ones put together
    dealt = posted.hint("rebalance", "folder").sortWithinPartitions("folder", "term")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("folder").parquet(f"{path}/batch={batch}")


def _post(batch: str, shared):
    def run(batches):
        from pyspark import TaskContext

        part, turn, letter = TaskContext.get().partitionId(), 0, shared.value
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_ROWS):
                rows = b.slice(i, BLOCK_ROWS)
                owner, words = _words(rows.column(2), letter)
                if not len(owner):
                    continue
                sizes = np.bincount(owner, minlength=rows.num_rows)
                rows, owner, sizes = rows.filter(pa.array(sizes > 0)), (np.cumsum(sizes > 0) - 1)[owner], sizes[sizes > 0]
                coded = words.dictionary_encode()
                n = len(coded.dictionary)
                code, tf = np.unique(coded.indices.to_numpy() * np.int64(len(sizes)) + owner, return_counts=True)
                term, at = np.divmod(code, len(sizes))
                ends = pa.array(np.searchsorted(term, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at, tf)]
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                block = f"{batch}-{part}-{turn}"
                turn += 1
                none = lambda kind, m: pa.nulls(m, pa.list_(kind))
                names = ["block", "term", "at", "tf", "dl", "keys", "grps"]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.string()), none(pa.int32(), 1), none(pa.int32(), 1), one(sizes.tolist(), pa.int32()), one(rows.column(0).to_pylist(), pa.string()), one(rows.column(1).to_pylist(), pa.string())], names)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n), coded.dictionary, *lists, none(pa.int32(), n), none(pa.string(), n), none(pa.string(), n)], names)

    return run


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("block string, term string, at array<int>, tf array<int>, dl array<int>, keys array<string>, grps array<string>, batch string, folder int").parquet(path)


def term_rows(index: DataFrame, terms: DataFrame, named: list[str] | None = None, folders: int = FOLDERS) -> DataFrame:
    """Rows of the index for some terms, from the folders of these terms only.

    ``terms``: a frame of distinct terms, joined with a broadcast; ``named``: the
    same terms, if they are few enough for the scan's own filters.
    """
    rows = index.where(F.col("folder") != HEAD)
    if named is not None:
        some = [r[0] for r in index.sparkSession.createDataFrame([(t,) for t in named], "term string").select(_folder("term", folders)).distinct().collect()]
        rows = rows.where(F.col("folder").isin(some) & F.col("term").isin(named))
    return rows.join(F.broadcast(terms.withColumn("folder", _folder("term", folders))), ["term", "folder"])


def index_size(index: DataFrame) -> tuple[int, int]:
    """Chunks and words of the index, from the heads of its blocks."""
    got = index.where(F.col("folder") == HEAD).agg(F.sum(F.size("dl")), F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return got[0] or 0, got[1] or 0


def term_counts(index: DataFrame) -> DataFrame:
    """(term, df, cf) of the whole index; a term's rows lie in one folder and are few."""
    cf = F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)
    return index.where(F.col("folder") != HEAD).groupBy("term").agg(F.sum(F.size("at").cast("long")).alias("df"), F.sum(cf).alias("cf"))


def bm25_stored(index: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", group: str | None = None, boost: float = 1.0, folders: int = FOLDERS) -> DataFrame:
    """(query_id, key, score), with ``group``'s name a column of groups: what may be among the k best of a query, or of a query and group.

    Scores are those of ``bm25_top``. ``queries``: query_id, query_text; their
    distinct terms are broadcast, in blocks of queries of bounded size. Each
    task passes on only what reaches its own k-th best score.
    """
    spark = queries.sparkSession
    bounded_batches(spark)
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("terms")).persist()
    n_terms, n_queries = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count("*")).first()
    n, words = index_size(index)
    blocks = max(1, -(-n_terms // BLOCK_TERMS), -(-n_queries // BLOCK_QUERIES))
    schema = T.StructType([queries.schema["query_id"], T.StructField(key, T.StringType()), *([T.StructField(group, T.StringType())] if group else []), T.StructField("score", T.DoubleType())])
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        terms = part.select(F.explode("terms").alias("term")).distinct()
        names = sorted(r[0] for r in terms.collect())  # bounded by the block
        places = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "term string, place int")
        rows = term_rows(index, places, names if len(names) <= NAMED_TERMS else None, folders).select("block", "place", "at", "tf", "dl", "keys", "grps")
        df = np.zeros(len(names))
        for place, count in rows.groupBy("place").agg(F.sum(F.size("at"))).collect():
            df[place] = count
        listed = part.toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((listed["query_id"].combine_chunks(), *_weights(listed["terms"].combine_chunks(), names, np.log(1 + (n - df + 0.5) / (df + 0.5)))))
        heads = index.where(F.col("folder") == HEAD).select("block", F.lit(HEAD).alias("place"), "at", "tf", "dl", "keys", "grps")
        # a block's head comes before its terms
        dealt = heads.unionByName(rows).repartition("block").sortWithinPartitions("block", "place")
        found = dealt.mapInArrow(_score(shared, k, words / n if n else 1.0, boost, group is not None, [f.name for f in schema]), schema)
        out = found if out is None else out.unionByName(found)
    asked.unpersist()
    return out


def _weights(terms: pa.ListArray, names: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of terms, queries, weights), by place."""
    flat = terms.flatten()
    place = pc.index_in(flat, value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int32)
    query = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy())
    order = np.argsort(place, kind="stable")
    return place[order], query[order], idf[place[order]]


def _score(shared, k: int, mean: float, boost: float, grouped: bool, names: list[str]):
    """Scores of all blocks of a task; ``best`` holds the k best scores so far of all chunks and of each group."""

    def run(batches):
        ids, place, query, weight = shared.value
        width = len(ids)
        best: dict = {}
        head = scores = values = weights = None
        used = 0

        def multiply():
            """Add the gathered columns of frequent terms, all at once."""
            nonlocal used
            if used:
                np.add(scores, values[:, :used] @ weights[:used], out=scores)
                values[:, :used], weights[:used], used = 0, 0, 0

        def done():
            multiply()
            rounded = np.round(boost * scores, 6)
            keep = np.zeros(rounded.shape, bool)
            parts = {None: np.arange(len(rounded))}
            if grouped:
                coded = head[1].dictionary_encode()
                codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
                parts |= {("group", coded.dictionary[int(c)].as_py() if c >= 0 else None): np.flatnonzero(codes == c) for c in np.unique(codes)}
            for name, some in parts.items():
                top = np.concatenate([best.get(name, np.zeros((k, width))), rounded[some]])
                best[name] = np.partition(top, len(top) - k, axis=0)[len(top) - k :]
                keep[some] |= rounded[some] >= best[name].min(axis=0)
            row, col = np.nonzero(keep & (rounded > 0))
            at = pa.array(row)
            columns = [ids.take(pa.array(col)), head[0].take(at), *([head[1].take(at)] if grouped else []), pa.array(rounded[row, col])]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for i, p in enumerate(b.column(1).to_pylist()):
                if p == HEAD:
                    if head is not None:
                        yield done()
                    head = [b.column(c)[i].values for c in (5, 6)]
                    norm = K1 * (1 - B + B * b.column(4)[i].values.to_numpy() / mean)
                    scores, values, weights = np.zeros((len(norm), width)), np.zeros((len(norm), GATHERED)), np.zeros((GATHERED, width))
                elif width:
                    at, tf = (b.column(c)[i].values.to_numpy() for c in (2, 3))
                    lo, hi = np.searchsorted(place, [p, p + 1])
                    value = tf * (K1 + 1) / (tf + norm[at])
                    if len(at) * (hi - lo) < FREQUENT:
                        scores[np.ix_(at, query[lo:hi])] += value[:, None] * weight[lo:hi]
                        continue
                    values[at, used], weights[used, query[lo:hi]] = value, weight[lo:hi]
                    used += 1
                    if used == GATHERED:
                        multiply()
        if head is not None and width:
            yield done()

    return run
