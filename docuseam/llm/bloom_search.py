"""Ranked lexical search: bit-sliced Bloom signatures bound every score, exact scores decide.

A task deals its documents to shards by the number of their distinct terms, so
that the signatures of a shard are equally full. A signature is a column of a bit
matrix; a row of the matrix, a slice, is a bitmap over the shard's documents. A
term sets ``HASHES`` bits for itself and as many again for each of the levels 2,
4, 8, ... that its number of occurrences reaches. The bitmaps of a term and level
therefore hold every document that reaches the level, and some more. Adding up
slices, each weighted by what its level may add to the score of the document's
length, gives upper bounds for all documents of a shard at once.

Documents whose bound reaches the k-th best exact score known so far are scored
exactly from the shard's counted terms, highest bounds first; no other document
can be among the k best. Statistics are those of all documents.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut_lineage, drop_folder, ensure_checkpoint_dir, ship, shipped, table

#: Bits of a signature for each entry of the shard's fullest document, and bits that an entry sets.
BITS, HASHES = 10, 3
#: A shard is closed at this many documents or this many entries; so is the largest open one of a task whose open shards have so many together.
SHARD_DOCS, SHARD_ENTRIES, OPEN_ENTRIES = 4096, 200_000, 500_000
#: Characters of items that are searched at once.
BLOCK_CHARS = 500_000

_UPPER, _DIGITS, _LOWER = range(0x41, 0x5B), range(0x30, 0x3A), range(0x61, 0x7B)
#: Bytes of terms, lower-cased; every other ASCII byte becomes a space.
_TERM_BYTES = bytes(b + 32 if b in _UPPER else b if b in _DIGITS or b in _LOWER or b >= 0x80 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all other characters beyond ASCII; only A-Z lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


def levels_of(tf: np.ndarray) -> np.ndarray:
    """Number of levels 1, 2, 4, ... that a number of occurrences reaches."""
    return np.frexp(tf.astype(float))[1]


def hashes_of(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms))


def slices_of(hashes: np.ndarray, level: np.ndarray | int, n_slices: int) -> np.ndarray:
    """The slices of terms at their level: terms x HASHES."""
    x = hashes + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    first, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(n_slices)).astype(np.int64)


def gains(tf, m: np.ndarray) -> np.ndarray:
    """What tf occurrences of a term of weight 1 add to the score of a document with length part m; rises with tf."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class OpenShard:
    """Documents of a task that are not yet a shard."""

    def __init__(self):
        self.ids, self.n, self.terms, self.counts, self.vocab, self.entries = [], [], [], [], {}, 0

    def add(self, doc_id, n: int, counted: Counter) -> None:
        vocab = self.vocab
        self.ids.append(doc_id)
        self.n.append(n)
        self.terms.append(np.fromiter((vocab.setdefault(t, len(vocab)) for t in counted), np.int64, len(counted)))
        self.counts.append(np.fromiter(counted.values(), np.int64, len(counted)))
        self.entries += len(counted)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.entries >= SHARD_ENTRIES

    def row(self) -> tuple:
        size = np.array([len(t) for t in self.terms])
        doc, term, tf = np.repeat(np.arange(len(size)), size), np.concatenate(self.terms), np.concatenate(self.counts)
        levels = levels_of(tf)
        n_slices = BITS * int(np.bincount(doc, levels).max()) + 64
        bits = np.zeros((n_slices, len(size)), bool)
        hashes = hashes_of(list(self.vocab))
        for level in range(levels.max()):
            at = levels > level
            bits[slices_of(hashes[term[at]], level, n_slices), doc[at, None]] = True
        order = np.argsort(doc * len(self.vocab) + term)
        df = np.bincount(term, minlength=len(self.vocab))
        return self.ids, self.n, n_slices, np.packbits(bits, axis=1).tobytes(), list(self.vocab), df, term[order].astype(np.int32).tobytes(), tf[order].astype(np.int32).tobytes(), size.astype(np.int32).tobytes()


def build_signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: ids, lengths, slices, terms with the number of their documents, and counted terms by document.

    Documents without terms, among them null texts, are in no shard.
    """
    bounded_batches(docs.sparkSession)
    numbers = T.ArrayType(T.LongType())
    kinds = {"ids": T.ArrayType(docs.schema[key].dataType), "n": numbers, "n_slices": T.IntegerType(), "slices": T.BinaryType(), "vocab": T.ArrayType(T.StringType()), "df": numbers, "term": T.BinaryType(), "tf": T.BinaryType(), "sizes": T.BinaryType()}
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])

    def batch(rows, like):
        c = list(zip(*rows, strict=True))
        kinds = [pa.list_(like), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        columns = [pa.array(x, k) for x, k in zip(c, kinds, strict=True)]
        columns[4] = columns[4].cast(pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches):
        shards: dict[int, OpenShard] = {}
        like, entries = None, 0
        for b in batches:
            like = b.schema.types[0]
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                words = terms_of(raw.as_py())
                if not words:
                    continue
                counted = Counter(words)
                kind = len(counted).bit_length()
                shard = shards.setdefault(kind, OpenShard())
                shard.add(doc_id, len(words), counted)
                entries += len(counted)
                while shard.full() or entries > OPEN_ENTRIES:
                    kind = kind if shard.full() else max(shards, key=lambda k: shards[k].entries)
                    done = shards.pop(kind)
                    entries -= done.entries
                    yield batch([done.row()], like)
                    shard = OpenShard()
        for kind in sorted(shards):
            yield batch([shards.pop(kind).row()], like)

    return docs.select(key, text).mapInArrow(run, schema)


class Shard:
    """A shard's row, ready to be searched."""

    def __init__(self, n, n_slices: int, slices: bytes, vocab: pa.Array, term: bytes, tf: bytes, sizes: bytes, n_docs: int, n_terms: int):
        self.size, self.n_slices, self.vocab = len(n), n_slices, vocab
        self.slices = np.frombuffer(slices, np.uint8).reshape(n_slices, -1)
        self.m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
        doc = np.repeat(np.arange(self.size), np.frombuffer(sizes, np.int32))
        self.entry = doc * len(vocab) + np.frombuffer(term, np.int32)
        self.tf = np.frombuffer(tf, np.int32).astype(np.int64)

    def bounds(self, hashes: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Upper bounds, items x documents. ``asked``: places among ``hashes`` and weights of each item's terms."""
        out = np.zeros((len(asked), self.size))
        terms, before, reached = np.arange(len(hashes)), np.zeros(self.size), None
        place = np.full(len(hashes), -1)
        for level in range(40):
            at = slices_of(hashes[terms], level, self.n_slices)
            found = np.bitwise_and.reduce(self.slices[at], axis=1)
            if reached is not None:
                found &= reached
            some = found.any(axis=1)
            terms, reached = terms[some], found[some]
            if not len(terms):
                break
            place[:] = -1
            place[terms] = np.arange(len(terms))
            bits = np.unpackbits(reached, axis=1, count=self.size)
            most = gains(2 ** (level + 1) - 1, self.m).astype(float)
            more, before = most - before, most
            for row, (mine, weight) in zip(out, asked, strict=True):
                p = place[mine]
                if (held := p >= 0).any():
                    row += (weight[held].astype(float) @ bits[p[held]]) * more
        return out

    def scores(self, docs: np.ndarray, places: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``places``: of the item's terms in the vocabulary."""
        wanted = docs[:, None] * len(self.vocab) + places
        at = np.minimum(np.searchsorted(self.entry, wanted), len(self.entry) - 1)
        tf = np.where(self.entry[at] == wanted, self.tf[at], 0)
        return (weight * gains(tf, self.m[docs, None])).sum(axis=1)


class Items:
    """A block of items: distinct terms with hashes and weights, and each item's terms."""

    def __init__(self, texts: list[bytes | None]):
        counted = [Counter(terms_of(t)) for t in texts]
        self.terms = sorted(set().union(*counted)) if counted else []
        self.hashes = hashes_of(self.terms)
        at = {t: i for i, t in enumerate(self.terms)}
        self.of = [(np.fromiter((at[t] for t in c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))) for c in counted]

    def weigh(self, df: dict[str, int], n_docs: int) -> None:
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t.decode(), 0) + 1))) for t in self.terms], np.int64)
        self.asked = [(mine, times * weight[mine]) for mine, times in self.of]


class Best:
    """The k best of every item so far, equal scores by ascending id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.held, self.least, self.rescored = k, [[] for _ in range(n)], np.zeros(n, np.int64), 0

    def look(self, shard: Shard, ids: list, items: Items) -> None:
        places = pc.fill_null(pc.index_in(pa.array(items.terms, pa.binary()).cast(pa.string()), value_set=shard.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = shard.bounds(items.hashes, items.asked)
        for i, (mine, weight) in enumerate(items.asked):
            known = places[mine] >= 0
            if not known.any():
                continue
            mine, weight = places[mine][known], weight[known]
            docs = np.flatnonzero(bounds[i] >= max(1, self.least[i]))
            docs = docs[np.argsort(-bounds[i, docs], kind="stable")]
            turn, step = 0, 2 * self.k
            while turn < len(docs) and bounds[i, docs[turn]] >= self.least[i]:
                some = docs[turn : turn + step]
                self.rescored += len(some)
                self._take(i, ids, some, shard.scores(some, mine, weight))
                turn, step = turn + step, 2 * step

    def _take(self, i: int, ids: list, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(1, self.least[i])
        if good.any():
            new = [(-int(s), ids[d] is None, ids[d]) for d, s in zip(docs[good], scores[good], strict=True)]
            rows = sorted(self.held[i] + new, key=lambda r: r[:2] if r[1] else r)[: self.k]
            self.held[i] = rows
            self.least[i] = -rows[-1][0] if len(rows) == self.k else 0


def search_signatures(index: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of every item, rank 1 the best.

    ``index``: a stored result of ``build_signatures``. Every row of ``items`` is
    an item of its own, repeated rows too; items without terms, among them null
    texts, have no result, nor have documents that score 0. Repeated documents
    are each ranked. Equal scores go by ascending id, null ids last. Items are
    searched in blocks of about ``BLOCK_CHARS`` characters, which bounds what
    is broadcast.
    """
    spark = items.sparkSession
    bounded_batches(spark)
    whole = index.agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_docs, n_terms = (whole[0] or 0), (whole[1] or 0)
    listed = cut_lineage(items.select(F.col(item).alias("item"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    chars = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", listed.schema["item"].dataType), T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    out = None
    for b in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow().combine_chunks()
        asked = Items([None if x is None else x.encode() for x in part["text"].to_pylist()])
        wanted = spark.createDataFrame([(t.decode(),) for t in asked.terms], "term string")
        seen = index.select(F.explode(F.arrays_zip("vocab", "df")).alias("x")).select(F.col("x.vocab").alias("term"), F.col("x.df").alias("df"))
        df = dict(seen.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("df")).collect())
        asked.weigh(df, n_docs)
        found = index.drop("df").mapInArrow(_scan(ship(spark, (asked, part.select(["item", "row"]))), k, n_docs, n_terms), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", "doc_id", "score")


def _scan(shared, k: int, n_docs: int, n_terms: int):
    """A task's k best documents of every item of the block."""

    def run(batches):
        items, names = shipped(shared)
        best, like = Best(len(names), k), None
        for b in batches:
            like = b.schema.types[0].value_type
            for r in range(b.num_rows):
                ids, n, n_slices, slices, vocab, term, tf, sizes = (b.column(c)[r] for c in range(8))
                shard = Shard(n.as_py(), n_slices.as_py(), slices.as_py(), vocab.values, term.as_py(), tf.as_py(), sizes.as_py(), n_docs, n_terms)
                best.look(shard, ids.as_py(), items)
        if like is not None:
            rows = [(i, d, -s) for i, held in enumerate(best.held) for s, _, d in held]
            found = names.take(pa.array([r[0] for r in rows], pa.int64())).combine_chunks()
            columns = [found["item"].combine_chunks(), found["row"].combine_chunks(), pa.array([r[1] for r in rows], like), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "row", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Build the signatures in the shared folder, search them, and delete them.

    Results and their handling of nulls, ties and repeated rows are those of
    ``search_signatures``; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/signatures-{uuid.uuid4().hex}"
    index = build_signatures(docs, key, text)
    index.write.parquet(at)
    out = cut_lineage(search_signatures(spark.read.schema(index.schema).parquet(at), items, k, item, item_text))
    drop_folder(spark, at)
    return out


def ranked_report(spark, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def ranked_report_sql() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
full_ AS (SELECT r, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
size_ AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM full_),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM full_) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
items AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
weighed AS (SELECT i, item_id, items.term, times * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM items JOIN df USING (term), size_),
m AS (SELECT r, doc_id, 100 - 75 + (75 * n * n_docs) // n_terms AS m FROM full_, size_),
scored AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM weighed JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
