"""BM25 over chunks: postings, statistics and scores for all queries in one plan."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import or_empty, tokens
from ..session import bounded_batches

K1, B = 1.2, 0.75
#: Queries of a broadcast block, and about the most weights of their terms.
BLOCK_QUERIES, BLOCK_WEIGHTS = 512, 4 << 20
#: Terms of a broadcast block, and the products of weights and values that are held at once.
BLOCK_TERMS, PRODUCTS = 1 << 20, 1 << 20
#: Rows that a task holds before those that no longer reach a k-th best are left out.
HELD_ROWS = 1 << 19


def postings(rows: DataFrame, key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """(term, key, tf, dl) of every chunk that has tokens.

    Counted inside the row, so that the only shuffle is the one by term later.
    """
    words = F.col("_words")
    listed = rows.select(key, tokens(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    return listed.select(key, F.size(words).cast("long").alias("dl"), F.explode(words).alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def term_totals(rows: DataFrame, text: str = "chunk_text") -> DataFrame:
    """(term, df, cf): rows with the term and its occurrences, by one shuffle of partial sums."""
    words = F.col("_words")
    counted = F.concat(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))), F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))))
    listed = rows.select(tokens(F.col(text)).alias("_words")).select(F.explode(counted).alias("x"))
    return listed.groupBy("x.term").agg(F.sum("x.d").alias("df"), F.sum("x.c").alias("cf"))


def corpus_stats(posted: DataFrame, key: str = "chunk_id") -> DataFrame:
    per = posted.groupBy(key).agg(F.first("dl").alias("dl"))
    return per.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def letters() -> np.ndarray:
    """Whether a code point is a letter or a number, which words are made of, as in ``tokens``."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])


def _words(texts: pa.Array, letter: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The row of every word of an Arrow batch of lower-cased texts, and the words: what ``tokens`` finds, for all texts at once on their bytes."""
    texts = texts.cast(pa.string())
    _, offsets, held = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[0] == at[-1]:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    data, at = np.frombuffer(held, np.uint8)[at[0] : at[-1]], at - at[0]
    inside = np.append(letter[:128], np.zeros(128, bool))[data]
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int32)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & np.array([0, 0, 31, 15, 7])[size]
    for k in (1, 2, 3):
        some = size > k
        code[some] = code[some] << 6 | (data[lead[some] + k] & 63)
    lead, size = lead[letter[code]], size[letter[code]]
    for k in range(4):
        inside[lead[size > k] + k] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    before[at[:-1][at[:-1] < len(data)]] = False  # no word goes on in the next text
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    ends = np.append(0, np.cumsum(end - start)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return np.searchsorted(at, start, side="right") - 1, words


def _counted(texts: pa.Array, letter: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, owner, term, tf): the words of every text, and how often it holds each of the terms, by text and term."""
    owner, words = _words(texts, letter)
    lengths = np.bincount(owner, minlength=len(texts))
    at = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False)
    known = at >= 0
    code, tf = np.unique(owner[known] * max(1, len(terms)) + at[known], return_counts=True)
    return lengths, *np.divmod(code, max(1, len(terms))), tf


def term_statistics(queries: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(term, df, words) of the queries' terms, in one pass; the term '' says how many rows have words, and how many words.

    Every task counts by itself, so that no row of a word leaves it. Terms are broadcast in blocks of bounded size.
    """
    spark = rows.sparkSession
    wanted = queries.select(F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term")).distinct().persist()
    blocks, letter, out = max(1, -(-wanted.count() // BLOCK_TERMS)), letters(), None
    for b in range(blocks):
        terms = wanted.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).toArrow()["term"].combine_chunks().cast(pa.string())
        shared = spark.sparkContext.broadcast((letter, terms))
        found = rows.select(F.lower(or_empty(F.col(text))).alias("_text")).mapInArrow(_count(shared, b == 0), "term string, df long, words long")
        out = found if out is None else out.unionByName(found)
    wanted.unpersist()
    return out.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def _count(shared, whole: bool):
    def run(batches):
        letter, terms = shared.value
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            lengths, _, term, _ = _counted(b.column(0), letter, terms)
            df += np.bincount(term, minlength=len(terms))
            n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
        some = np.flatnonzero(df)
        if len(some):
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(some)), pa.array(df[some]), pa.array(np.zeros(len(some), np.int64))], ["term", "df", "words"])
        if whole and n:
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([n]), pa.array([total])], ["term", "df", "words"])

    return run


def bm25_top(queries: DataFrame, rows: DataFrame, k: int, key: str = "chunk_id", text: str = "chunk_text", group: str | None = None, boost: float = 1.0) -> DataFrame:
    """(query_id, key, score): every pair that may be among the k best of its query, or of its query and ``group``.

    Scores are rounded to 6 digits; rows without a common term have none. Terms
    are found and counted on the bytes of an Arrow batch and multiplied with the
    weights of a block of queries at once, and each task passes on only what
    reaches its own k-th best score, so what is shuffled afterwards does not grow
    with the rows of a task. Document frequencies are those of all rows. Null
    texts count as empty.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    asked = queries.select("query_id", "query_text").persist()
    stats = term_statistics(asked, rows, text).persist()
    total, words = asked.agg(F.count("*"), F.coalesce(F.sum(F.size(F.array_distinct(tokens(F.col("query_text"))))), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK_QUERIES), -(-words // BLOCK_WEIGHTS))
    whole = stats.where("term = ''").first()
    n, mean = (whole["df"], whole["words"] / whole["df"]) if whole else (0, 1.0)
    idf_of = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term")).join(stats, "term").select("query_id", "term", idf_of.alias("idf"))
    listed = rows.select(key, *([group] if group else []), F.lower(or_empty(F.col(text))).alias("_text"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *listed.drop("_text").schema.fields, T.StructField("score", T.DoubleType())])
    letter, out = letters(), None
    for b in range(blocks):
        part = weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        ids, terms = (pa.chunked_array(part[c]).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        order = np.argsort(terms.indices.to_numpy(), kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary))))
        held = (ends, ids.indices.to_numpy()[order].astype(np.int64), part["idf"].to_numpy()[order])
        shared = spark.sparkContext.broadcast((letter, ids.dictionary, terms.dictionary.cast(pa.string()), held))
        found = listed.mapInArrow(_scan(shared, k, mean, boost, group is not None, schema.names), schema)
        out = found if out is None else out.unionByName(found)
    asked.unpersist()
    stats.unpersist()
    return out


def _scores(owner: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, width: int, held) -> np.ndarray:
    """Scores of rows under queries: the weights that hold a row's terms, times their values, summed; what is multiplied at once is bounded."""
    ends, query, weight = held
    out = np.zeros(rows * width)
    sizes = np.diff(ends)[term]
    upto = np.append(0, np.cumsum(sizes))
    i = 0
    while i < len(term):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PRODUCTS, side="right")) - 1)
        size = sizes[i:j]
        pair = np.repeat(ends[term[i:j]] - (upto[i:j] - upto[i]), size) + np.arange(upto[j] - upto[i])
        low = int(owner[i]) * width
        got = np.bincount(np.repeat(owner[i:j] * width, size) + query[pair] - low, np.repeat(value[i:j], size) * weight[pair])
        out[low : low + len(got)] += got
        i = j
    return out.reshape(rows, width)


def _scan(shared, k: int, mean: float, boost: float, grouped: bool, names: list[str]):
    """Scores of a block of queries, batch by batch; ``best`` holds the k best scores so far of all rows and of each group, and only what reaches them in the end is passed on."""

    def run(batches):
        letter, ids, terms, weights = shared.value
        width = len(ids)
        best, places, held = {None: np.zeros((k, width))}, {None: 0}, []
        if not width:
            return

        def reaching(found):
            """What still reaches the k-th best of all rows or of its group."""
            least = np.stack([x.min(axis=0) for x in best.values()])
            columns, query, group, value = found
            some = np.flatnonzero((value >= least[0, query]) | (grouped & (value >= least[group, query])))
            return [x.take(pa.array(some)) for x in columns], query[some], group[some], value[some]

        def batch_of(found):
            columns, query, _, value = found
            return pa.RecordBatch.from_arrays([ids.take(pa.array(query)), *columns, pa.array(value)], names)

        def joined():
            columns = [pa.concat_arrays(x) for x in zip(*(h[0] for h in held), strict=True)]
            return reaching((columns, *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3))))

        for b in batches:
            lengths, owner, term, tf = _counted(b.column(b.num_columns - 1), letter, terms)
            value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean))
            scores = _scores(owner, term, value, len(lengths), width, weights)
            scores *= boost
            keep = np.zeros(scores.shape, bool)
            parts, group = {None: np.arange(len(lengths))}, np.zeros(len(lengths), np.int64)
            if grouped:
                kinds = b.column(1).dictionary_encode()
                codes = pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False)
                parts |= {("group", kinds.dictionary[int(c)].as_py() if c >= 0 else None): np.flatnonzero(codes == c) for c in np.unique(codes)}
            for name, some in parts.items():
                group[some] = places.setdefault(name, len(places))
                before = best.setdefault(name, np.zeros((k, width)))
                # only what may reach a query's k-th best so far is rounded and ranked
                some = some[((scores[some] > 0) & (scores[some] >= before.min(axis=0) - 1e-6)).any(axis=1)]
                own = np.round(scores[some], 6)
                top = np.concatenate([before, own])
                best[name] = np.partition(top, len(top) - k, axis=0)[len(top) - k :]
                keep[some] |= own >= best[name].min(axis=0)
            row, query = np.nonzero(keep)
            value = np.round(scores[row, query], 6)
            row, query, value = (x[value > 0] for x in (row, query, value))
            held.append(([b.column(i).take(pa.array(row)) for i in range(b.num_columns - 1)], query, group[row], value))
            if sum(len(h[1]) for h in held) > HELD_ROWS:
                held = [joined()]
                if len(held[0][1]) > HELD_ROWS // 2:  # many equal scores
                    yield batch_of(held.pop())
        if held:
            yield batch_of(joined())

    return run


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), key: str = "chunk_id") -> DataFrame:
    """The k best of each group, ties by key, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_field(queries: DataFrame, rows: DataFrame, fields: dict[str, float], k: int, key: str = "chunk_id") -> DataFrame:
    """Each field scored by itself and boosted; the best field counts. Exact for the k best, which are among the k best of a field."""
    parts = [bm25_top(queries, rows, k, key, f, boost=b) for f, b in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", key).agg(F.max("score").alias("score"))


def exact_or_phrase(column: Column, value: str) -> Column:
    return (column == value) | F.contains(column, F.lit(value))


def date_range(column: Column, first: str | None = None, last: str | None = None) -> Column:
    """Inclusive on both sides, either may be open; nulls fall out."""
    out = column.isNotNull()
    if first:
        out = out & (column >= F.to_timestamp_ntz(F.lit(first)))
    if last:
        out = out & (column < F.to_timestamp_ntz(F.lit(last)) + F.expr("INTERVAL 1 DAY"))
    return out
