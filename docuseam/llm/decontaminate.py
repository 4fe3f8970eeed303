"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

Items and texts are read as lower-cased words. An item leaks where some part of
a text is within an edit distance, in words, of a fifth of the item's length.
Item-sized windows of the text are embedded by the CGK random walk, which maps
edit distance to Hamming distance; each repetition takes a walk of its own and
samples positions of the embedding. The samples of all items stand in hash
tables, one for each length and repetition, and a window whose samples are in a
table is a candidate for the items found there: nothing else proposes items.
Candidates are verified exactly, by the edit distance between the item and the
best part of the text around.

Windows that no item can match are not embedded. One edit changes at most three
runs of three words, and an insertion at most two, so a part within k edits of
an item of n words, which starts where the window does, leaves at least
n - 2 - 3 k positions in a window of n words whose run of three words occurs in
an item of that length. Windows with fewer such positions are passed over; for
lengths where that says nothing, n - k positions must have a word of an item.
Positions are counted, not distinct runs, so it holds for repetitive items too.

Items are broadcast in blocks of bounded size; documents are scanned once per
block, and nothing is shuffled.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh_name, ship, shipped, table

_WORD = re.compile(r"\w+")
#: Broadcast blocks of items have about this many characters at most.
BLOCK_CHARS = 8 << 20
MAX_DISTANCE = 0.2
#: Sampled positions of a repetition, the share of positions in which embeddings of a
#: pair at the greatest distance agree at least, and the recall that the number of repetitions aims at.
SAMPLED, AGREE, TARGET_RECALL = 3, 0.35, 0.99
_MASK = (1 << 22) - 1
_WINDOWS = 256

LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("distance", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def repetitions(sampled: int = SAMPLED, recall: float = TARGET_RECALL, agree: float = AGREE) -> int:
    """Repetitions after which a pair whose embeddings agree in that share of positions is missed at most so often."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


class Walks:
    """The random walks of all repetitions for windows of n words.

    Walk r outputs the current word and moves on if a random bit of (r, step,
    word) says so: half a word a step. Samples are taken from its first 3 n / 2
    steps, in which it seldom leaves the window.
    """

    def __init__(self, n: int, reps: int, sampled: int = SAMPLED, seed: int = 5) -> None:
        rng = np.random.default_rng([seed, n])
        self.n, steps = n, max(1, 3 * n // 2)
        self.at = np.sort(rng.integers(0, steps, (reps, sampled)), axis=1)
        self.salt = rng.integers(1, 1 << 62, (reps, steps), dtype=np.int64).astype(np.uint64)
        self.taken = [[tuple(x) for x in np.argwhere(self.at == j)] for j in range(int(self.at.max()) + 1)]
        self.mix = rng.integers(1, 1 << 62, (reps, sampled + 1), dtype=np.int64).astype(np.uint64) | np.uint64(1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One key for each row of n words and repetition; 0 where a sample lies past the end. Words are 0 or more, less is no word."""
        rows, reps = len(x), len(self.at)
        padded = np.concatenate([x, np.full((rows, 1), -1, x.dtype)], axis=1)
        place, line = np.zeros((rows, reps), np.int64), np.arange(rows)[:, None]
        out = np.repeat(self.mix[None, :, -1], rows, axis=0)
        whole = np.ones((rows, reps), bool)
        for j, taken in enumerate(self.taken):
            word = padded[line, place]
            for r, k in taken:
                out[:, r] = (out[:, r] ^ word[:, r].astype(np.uint64)) * self.mix[r, k]
                out[:, r] ^= out[:, r] >> np.uint64(31)
                whole[:, r] &= word[:, r] >= 0
            h = (word.astype(np.uint64) + self.salt[None, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            bit = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(np.int64)
            place = np.minimum(place + np.where(word < 0, 0, bit), self.n)
        return np.where(whole, out, np.uint64(0))


def best_part(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between the item and any part of the text, and where that part ends."""
    m = len(text)
    row = np.zeros(m + 1, np.int64)
    step = np.arange(m + 1)
    for i, w in enumerate(item, start=1):
        diag = row[:-1] + (text != w)
        new = np.empty(m + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(diag, row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


class Length:
    """All items of n words: what their windows must hold, and the hash tables of their samples."""

    def __init__(self, n: int, most: int, reps: int) -> None:
        self.n, self.most = n, most
        self.by_runs = n - 2 - 3 * most >= 1
        self.need = n - 2 - 3 * most if self.by_runs else max(1, n - most)
        self.walks = Walks(n, reps)
        self.items: list[int] = []

    def build(self, rows: np.ndarray) -> None:
        keys = self.walks.keys(rows)
        flat = (keys ^ np.arange(keys.shape[1], dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)).ravel()
        owner = np.repeat(np.array(self.items), keys.shape[1])[keys.ravel() != 0]
        flat = flat[keys.ravel() != 0]
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner = flat[order], owner[order]

    def candidates(self, rows: np.ndarray) -> set[int]:
        """Items that share their samples with one of the rows in some repetition."""
        keys = self.walks.keys(rows)
        flat = (keys ^ np.arange(keys.shape[1], dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93))[keys != 0]
        a, b = np.searchsorted(self.keys, flat), np.searchsorted(self.keys, flat, side="right")
        return {int(self.owner[i]) for x, y in set(zip(a[a < b].tolist(), b[a < b].tolist(), strict=True)) for i in range(x, y)}

    def starts(self, at: np.ndarray, n_words: int) -> list[tuple[int, int]]:
        """Ranges (first, last) of starts of windows with ``need`` of the positions ``at``; near ones are joined."""
        width = self.n - 2 if self.by_runs else self.n
        if len(at) < self.need:
            return []
        low, high = at[: len(at) - self.need + 1], at[self.need - 1 :]
        fits = high - low < width
        first, last = np.maximum(0, high[fits] - width + 1), np.minimum(low[fits], n_words - 1)
        out: list[tuple[int, int]] = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if out and a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


class Items:
    """An index of one block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]], max_distance: float = MAX_DISTANCE, reps: int | None = None) -> None:
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.lengths: dict[int, Length] = {}
        self.runs: dict[int, set[int]] = {}
        self.words: dict[int, set[int]] = {}
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64)
            n = len(ids)
            if n not in self.lengths:
                self.lengths[n] = Length(n, int(max_distance * n), repetitions() if reps is None else reps)
            length = self.lengths[n]
            length.items.append(len(self.items))
            self.items.append((item_id, ids))
            for code in self._codes(ids).tolist() if length.by_runs else ids.tolist():
                (self.runs if length.by_runs else self.words).setdefault(code, set()).add(n)
        for length in self.lengths.values():
            length.build(np.stack([self.items[k][1] for k in length.items]))
        self.bits = np.zeros(_MASK + 1, bool)
        self.bits[np.array([c & _MASK for c in self.runs], np.int64)] = True
        self.alone = np.zeros(len(self.vocab) + 1, bool)
        self.alone[list(self.words)] = True

    @staticmethod
    def _codes(ids: np.ndarray) -> np.ndarray:
        """One number for each run of three words; words that no item has make it negative."""
        if len(ids) < 3:
            return np.zeros(0, np.int64)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        code = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0x7FFFFFFFFFFFFFFF
        return np.where((a > 0) & (b > 0) & (c > 0), code ^ (code >> 23), -1)

    def windows(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By length in words: ranges of starts of the windows that an item of that length may match."""
        codes = self._codes(ids)
        hits = np.flatnonzero((codes >= 0) & self.bits[codes & _MASK])
        places: dict[int, list[int]] = {}
        for table, some, found in ((self.runs, hits, codes), (self.words, np.flatnonzero(self.alone[ids]) if self.words else hits[:0], ids)):
            for p, code in zip(some.tolist(), found[some].tolist(), strict=True):
                for n in table.get(code, ()):
                    places.setdefault(n, []).append(p)
        out = {n: self.lengths[n].starts(np.array(at), len(ids)) for n, at in places.items()}
        return {n: ranges for n, ranges in out.items() if ranges}

    def leaks(self, text: str | None) -> list[dict]:
        """Items that leak into the text, each at its best and of equal ones its first place, by item."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        if not len(ids):
            return []
        best: dict[int, tuple[int, int, int]] = {}
        for n, ranges in self.windows(ids).items():
            length = self.lengths[n]
            for first, last in ranges:
                found: set[int] = set()
                for s in range(first, last + 1, _WINDOWS):
                    at = np.arange(s, min(s + _WINDOWS, last + 1))[:, None] + np.arange(n)
                    found |= length.candidates(np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], -2))
                a, b = max(0, first - length.most), min(len(ids), last + n + length.most)
                for k in found:
                    self._verify(k, ids[a:b], a, length.most, best)
        return [
            {"item_id": self.items[k][0], "start_word": at, "n_words": size, "distance": d, "similarity": 1 - d / len(self.items[k][1])}
            for k, (d, at, size) in sorted(best.items(), key=lambda x: self.items[x[0]][0])
        ]

    def _verify(self, k: int, text: np.ndarray, offset: int, most: int, best: dict) -> None:
        item = self.items[k][1]
        d, end = best_part(item, text)
        if d <= most:
            _, size = best_part(item[::-1], text[:end][::-1])
            place = (d, offset + end - size, size)
            best[k] = min(best.get(k, place), place)


def item_blocks(spark: SparkSession, benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Blocks of (item_id, text), each of a bounded number of characters on average."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block_chars))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((r.item_id if r.item_id is not None else -1, r.text) for r in part.distinct().collect())


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Add ``out``: the benchmark items that leak into each whole text, with place and distance.

    Null and empty texts, and null or wordless items, leak nothing. Repeated
    items leak each by its id. All input columns stay, one named ``out`` is
    replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [c for c in docs.columns if c != out]
    rows = docs.select(*names).withColumn(out, F.array().cast(LEAKS))
    for block in item_blocks(spark, benchmark):
        shared = ship(spark, Items(block, max_distance))
        more = fresh_name(rows, "_more_leaks")
        schema = T.StructType([*rows.schema.fields, T.StructField(more, LEAKS)])
        rows = rows.mapInArrow(_scan(shared, [*rows.columns, more], rows.columns.index(text)), schema)
        rows = rows.withColumn(out, F.concat(out, more)).drop(more)
    return rows


def _scan(shared, names: list[str], at: int):
    def run(batches):
        items = shipped(shared)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32()), ("similarity", pa.float64())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([items.leaks(x.as_py()) for x in b.column(at)], kind)], names)

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents without leaked benchmark items; all columns stay."""
    name = fresh_name(docs, "leaked_items")
    return find_leaks(docs, benchmark, text, name).where(F.size(name) == 0).drop(name)


def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item that leaks into it: doc_id, item_id, place, distance, similarity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return rows.select("doc_id", "leak.*")
