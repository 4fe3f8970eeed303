"""Language of a text: averaged hashed subword embeddings with a linear softmax.

A word becomes the hashed n-grams of its letters with marks at both ends, and the
word itself. A text's vector is the mean of the embeddings of all its words'
subwords; a linear layer and a softmax give the probabilities of the languages.
Embeddings and layer are trained together by stochastic gradient descent in
numpy, on a sample of labelled texts that is even over the languages. A fold of
that sample, apart from training, gives the temperature that makes probabilities
honest, and the score under which an answer is rejected. Buckets that training
never met are zero, so that foreign scripts come out undecided and are rejected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_mod, ship, shipped, table

#: Bound of the labelled sample, and of what training reads of a text: windows of words dealt over the whole of it.
MAX_LABELLED, WINDOWS, WINDOW_WORDS = 4000, 4, 40
BUCKETS, DIMS, NGRAMS = 1 << 16, 16, (1, 2, 3, 4)
EPOCHS, RATE, SHORT_WORDS = 6, 0.5, 5
#: Part of the sample that only calibrates, and the part of its right answers that may be rejected.
FOLD, REJECTED = 5, 0.005
#: A longer run of letters is read as pieces of so many letters.
MOST_LETTERS = 32
#: Words whose sums a worker remembers, and words of a text that are looked up at once.
MEMO, PIECE = 200_000, 20_000

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; very long runs come in pieces, none is left out."""
    found = _WORD.findall((text or "").lower())
    return [p for w in found for p in ([w] if len(w) <= MOST_LETTERS else [w[i : i + MOST_LETTERS] for i in range(0, len(w), MOST_LETTERS)])]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and of the words themselves, word by word, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # letters to the end of the word
    gram, ids, owners = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, max(NGRAMS) + 1):
        gram[: len(codes) - n + 1] = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        held = left >= n
        if n in NGRAMS:
            ids.append(gram[held])
            owners.append(owner[held])
    ids.append(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) << np.uint64(32))
    owners.append(np.arange(len(words)))
    x, owner = np.concatenate(ids) * np.uint64(0x9E3779B97F4A7C15), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return ((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[order], np.bincount(owner, minlength=len(words))


@dataclass
class Languages:
    """A fitted model; its size is bounded by BUCKETS times the number of languages."""

    names: list[str]
    logits: np.ndarray  # BUCKETS x languages: embeddings times the layer
    temperature: float = 1.0
    least: float = 0.0  # scores under it are rejected
    memo: dict = field(default_factory=dict, repr=False)  # place of a word in ``sums``
    sums: np.ndarray | None = field(default=None, repr=False)  # sum of a word's subwords, and their number

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "sums": None}

    def _places(self, words: list[str]) -> np.ndarray:
        """Places of at most PIECE words in ``sums``; words that the worker does not remember are added up at once."""
        new = [w for w in set(words) if w not in self.memo]
        if self.sums is None or len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            self.sums, new = np.zeros((MEMO, len(self.names) + 1)), list(set(words))
        if new:
            ids, size = subwords(new)
            at = len(self.memo)
            self.sums[at : at + len(new), :-1] = np.add.reduceat(self.logits[ids], np.append(0, np.cumsum(size)[:-1]), axis=0)
            self.sums[at : at + len(new), -1] = size
            self.memo.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def probabilities(self, text: str | None) -> np.ndarray:
        words, total = words_of(text), np.zeros(len(self.names) + 1)
        for i in range(0, len(words), PIECE):
            total += self.sums_of(words[i : i + PIECE])
        return softmax(total[:-1] / max(1.0, total[-1]) / self.temperature)

    def sums_of(self, words: list[str]) -> np.ndarray:
        places = self._places(words)
        return self.sums[places].sum(axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(best language, its probability, whether it is rejected) of each whole text; without a letter: undetermined, 0, rejected."""
        out = []
        for text in texts:
            if not self.names or not _WORD.search(text or ""):
                out.append((UNDETERMINED, 0.0, True))
                continue
            p = self.probabilities(text)
            best = int(p.argmax())
            out.append((self.names[best], float(p[best]), bool(p[best] < self.least)))
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[list[np.ndarray], int]], n_languages: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and layer from (subwords of every word, language) rows by stochastic gradient descent with a falling rate.

    Each step takes the mean over a row's words, or over a few neighbouring words
    of it in every second step, so that short texts are learned too.
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    layer = np.zeros((DIMS, n_languages), np.float32)
    met = np.zeros(BUCKETS, bool)
    steps, step = 2 * EPOCHS * max(1, len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            words, label = rows[i]
            for short in (False, True):
                size = min(len(words), int(rng.integers(1, SHORT_WORDS + 1))) if short else len(words)
                at = int(rng.integers(0, len(words) - size + 1))
                ids, counts = np.unique(np.concatenate(words[at : at + size]), return_counts=True)
                share = (counts / counts.sum()).astype(np.float32)
                hidden = share @ emb[ids]
                error = softmax(hidden @ layer)
                error[label] -= 1
                rate = RATE * (1 - step / steps)
                back = layer @ error
                layer -= rate * np.outer(hidden, error)
                emb[ids] -= rate * share[:, None] * back
                met[ids] = True
                step += 1
    emb[~met] = 0
    return emb, layer


def calibrate(model: Languages, rows: list[tuple[list[np.ndarray], int]]) -> None:
    """Temperature of least cross entropy on rows that training has not seen, and the score that nearly all right answers reach."""
    if not rows:
        return
    some = [(words[:k] if k else words, y) for i, (words, y) in enumerate(rows) for k in (0, 1 + i % SHORT_WORDS)]  # whole, and a few words of it
    z = np.stack([model.logits[np.concatenate(words)].mean(axis=0) for words, _ in some])
    y = np.array([label for _, label in some])
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    if len(right):
        model.least = float(max(right[int(REJECTED * len(right))] * 0.999, 1.001 / len(model.names) if len(model.names) > 1 else 0.0))


def fit(rows: list[tuple[list[np.ndarray], str]]) -> Languages:
    """Fit on (subwords of every word, language) rows; rows without words are left out. Every ``FOLD``-th row of a language calibrates."""
    rows = [r for r in rows if r[0]]
    names = sorted({r[1] for r in rows})
    seen: Counter = Counter()
    parts: tuple[list, list] = [], []
    for words, name in rows:
        seen[name] += 1
        parts[seen[name] % FOLD == 0].append((words, names.index(name)))
    emb, layer = train(parts[0], len(names))
    model = Languages(names, emb @ layer)
    calibrate(model, parts[1])
    return model


def language_sample(docs: DataFrame, learn: Column, at_most: int = MAX_LABELLED, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """At most ``at_most`` labelled rows, as many of each language as there are: id, text, language.

    Rows are taken in the order of a hash of id and language, spread by how often
    the language occurs: so frequent languages lose rows before rare ones, and no
    language is gathered in one task. Null ids and languages are left out; of
    repeated rows the smallest text counts.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), learn.alias("ok")).where("id is not null and lang is not null and ok").drop("ok").distinct()
    share = F.pmod(F.xxhash64(F.col("id").cast("string"), "lang"), F.lit(1 << 40)) * F.col("n")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    if sizes.count() > at_most:
        raise ValueError(f"more than {at_most} languages")
    taken = rows.join(F.broadcast(sizes), "lang").orderBy(share, "id", "lang").limit(at_most).select("id", "lang")
    found = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(taken), ["id", "lang"])
    return found.groupBy("id", "lang").agg(F.min("text").alias("text"))


def fit_languages(docs: DataFrame, learn: Column, at_most: int = MAX_LABELLED, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """Fit on the labelled sample. Only hashed subwords of bounded windows reach the driver."""
    bounded_batches(docs.sparkSession)
    sample = language_sample(docs, learn, at_most, key, text, lang)

    def run(batches):
        for b in batches:
            flat, sizes = zip(*(subwords(windows_of(words_of(t))) for t in b.column(2).to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.list_(pa.int32())), pa.array(flat, pa.list_(pa.int32()))], ["id", "lang", "sizes", "flat"])

    schema = sample.select("id", "lang").schema.add("sizes", T.ArrayType(T.IntegerType())).add("flat", T.ArrayType(T.IntegerType()))
    got = sample.select("id", "lang", "text").mapInArrow(run, schema).toArrow().sort_by([("lang", "ascending"), ("id", "ascending")])
    rows = []
    for name, sizes, flat in zip(got["lang"].to_pylist(), got["sizes"], got["flat"], strict=True):
        ends = np.cumsum(sizes.values.to_numpy())
        rows.append((np.split(flat.values.to_numpy(), ends[:-1]) if len(ends) else [], name))
    return fit(rows)


def windows_of(words: list[str]) -> list[str]:
    """Windows of words spread evenly over a text, the whole of a short one."""
    if len(words) <= WINDOWS * WINDOW_WORDS:
        return words
    gap = (len(words) - WINDOW_WORDS) / (WINDOWS - 1)
    return [w for k in range(WINDOWS) for w in words[int(k * gap) : int(k * gap) + WINDOW_WORDS]]


def identify_languages(docs: DataFrame, model: Languages, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Add the best language, its probability and whether the model rejects the answer; other columns stay.

    The whole text is read. Null texts and texts without a letter are ``und``
    with score 0, and so are all without labelled rows. Input columns named like
    an output, in whatever case, are replaced, but for the text itself.
    """
    bounded_batches(docs.sparkSession)
    shared = ship(docs.sparkSession, model)
    taken = {c.lower() for c in out}
    if text.lower() in taken:
        raise ValueError(f"{text} is the name of an output")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    at = [c.lower() for c in kept.columns].index(text.lower())

    def run(batches):
        fitted = shipped(shared)
        for b in batches:
            best, score, rejected = zip(*fitted.predict(b.column(at).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*b.schema.names, *out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.BooleanType())]))


def language_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit_languages(docs, ~held_out)
    rows = identify_languages(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def language_query(spark, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))
