"""Quality classifier: similarity-weighted votes of labelled neighbours.

Documents become vectors of term weights. Terms are the lower-cased words of the
whole text, hashed to a fixed number of columns, three-character patterns of
character classes, and binned repetition measures of words and lines. A
truncated singular value decomposition of the labelled sample's tf-idf matrix,
by subspace iteration, gives the latent-semantic space. The sample's vectors and labels
are broadcast (at most ``MAX_LABELLED`` rows of ``DIMS`` numbers), and every
document gets exact cosine products with all of them, block by block; its score
is the mean label of its nearest neighbours, weighted by similarity.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_mod, fresh_name, ship, shipped, table

#: Bound of the labelled sample that the classifier is fitted on.
MAX_LABELLED = 4096
DIMS = 32
NEIGHBOURS = 15
_BLOCK = 512

_N_CLASSES = 14


def _class_table() -> np.ndarray:
    """Character class of each byte: letters by case, digits, spaces, marks, others."""
    out = np.full(256, 13, np.uint16)  # other ASCII marks and controls
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[0x80:] = 3
    for k, chars in enumerate((" \t\r", "\n", ".", ",", "!?", "|", "#$%&*@~^+=<>_\\", "\"'`", "()[]{}"), start=4):
        for c in chars:
            out[ord(c)] = k
    return out


_CLASS = _class_table()
N_PATTERNS = _N_CLASSES**3
_BINS = 12
#: repeated neighbour words, distinct words, repeated lines, longest word, upper-case words, length
_MEASURES = 6
#: columns of hashed words, and their part in a document's vector
WORDS, WORD_PART = 4096, 0.5
_FIRST_WORD = N_PATTERNS + _MEASURES * _BINS
N_TERMS = _FIRST_WORD + WORDS


def term_weights(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a whole text and their weights; null and empty texts have only measures."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    counts = np.zeros(N_PATTERNS)
    for i in range(0, len(c), 1 << 20):  # in pieces, so that long texts need little memory
        p = c[i : i + (1 << 20) + 2]
        if len(p) > 2:
            counts += np.bincount((p[:-2] * _N_CLASSES + p[1:-1]) * _N_CLASSES + p[2:], minlength=N_PATTERNS)
    ids = np.flatnonzero(counts)
    share = counts[ids] / max(1.0, counts.sum())
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    measures = (
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, max(map(len, words), default=0) / 200),
        sum(map(bytes.isupper, words)) / n,
        min(1.0, np.log1p(len(raw)) / 16),
    )
    extra = [N_PATTERNS + k * _BINS + min(_BINS - 1, int(m * _BINS)) for k, m in enumerate(measures)]
    counted = Counter(words)
    hashed = np.fromiter((zlib.crc32(w.lower()) % WORDS for w in counted), np.int64, len(counted))
    said = np.bincount(hashed, np.fromiter(counted.values(), float, len(counted)), minlength=WORDS) if counted else np.zeros(WORDS)
    at = np.flatnonzero(said)
    weights = [np.sqrt(share), np.full(_MEASURES, 0.15), WORD_PART * np.sqrt(said[at] / n)]
    return np.concatenate([ids, extra, _FIRST_WORD + at]).astype(np.int32), np.concatenate(weights).astype(np.float32)


@dataclass(frozen=True)
class Neighbours:
    """A fitted classifier; its size is bounded by MAX_LABELLED, DIMS and N_TERMS."""

    projection: np.ndarray  # N_TERMS x DIMS, with the idf weights in it
    vectors: np.ndarray  # labelled rows x DIMS, of unit length
    labels: np.ndarray
    prior: float

    def embed(self, texts) -> np.ndarray:
        out = np.empty((len(texts), self.projection.shape[1]), np.float32)
        for i, t in enumerate(texts):
            ids, w = term_weights(t)
            out[i] = w @ self.projection[ids]
        return _unit(out)

    def score(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), _BLOCK):
            cos = self.embed(texts[i : i + _BLOCK]) @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cos, near, 1), 0.0).astype(float) ** 8
            total = weight.sum(axis=1)
            # the prior counts as one distant neighbour, so scores are defined without any similarity
            out[i : i + _BLOCK] = ((weight * self.labels[near]).sum(axis=1) + 1e-3 * self.prior) / (total + 1e-3)
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int = DIMS) -> Neighbours:
    """Fit on (terms, weights, label) rows; with none, every score is 0.5."""
    if not rows:
        return Neighbours(np.zeros((N_TERMS, dims), np.float32), np.zeros((0, dims), np.float32), np.zeros(0), 0.5)
    labels = np.array([r[2] for r in rows], float)
    seen = np.zeros(N_TERMS)
    for ids, _, _ in rows:
        seen[ids] += 1
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    projection = (_directions(rows, idf, min(dims, len(rows))) * idf[:, None]).astype(np.float32)
    projection = np.pad(projection, ((0, 0), (0, dims - projection.shape[1])))
    vectors = _unit(np.stack([w @ projection[ids] for ids, w, _ in rows]))
    return Neighbours(projection, vectors.astype(np.float32), labels, float(labels.mean()))


def _directions(rows, idf: np.ndarray, dims: int, rounds: int = 8, spare: int = 16, seed: int = 3) -> np.ndarray:
    """Right singular vectors of the rows' tf-idf matrix, which is made dense a few rows at a time."""

    def blocks():
        for i in range(0, len(rows), 256):
            x = np.zeros((len(rows[i : i + 256]), N_TERMS), np.float32)
            for r, (ids, w, _) in zip(x, rows[i : i + 256], strict=True):
                r[ids] = w
            yield x * idf

    q = np.random.default_rng(seed).normal(size=(N_TERMS, min(dims + spare, len(rows)))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(sum(x.T @ (x @ q) for x in blocks()))[0]
    small = np.concatenate([x @ q for x in blocks()])
    return q @ np.linalg.svd(small, full_matrices=False)[2][:dims].T


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, at_most: int) -> DataFrame:
    """At most ``at_most`` labelled rows outside the held-out fold: id, text and label, one for each id.

    The ids with the smallest hash are taken, so the sample does not depend on
    partitioning; of repeated rows of an id the smallest text counts. Only the
    bounded list of ids is broadcast.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), mod) != held_out))
    ids = ids.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, at_most: int = MAX_LABELLED) -> Neighbours:
    """Fit on a bounded sample of labelled rows; only their term weights reach the driver."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", mod, held_out, at_most)

    def run(batches):
        for b in batches:
            pairs = [term_weights(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.float32()))], ["doc_id", "y", "ids", "w"])

    schema = sample.select("doc_id", "y").schema.add("ids", T.ArrayType(T.IntegerType())).add("w", T.ArrayType(T.FloatType()))
    got = sample.mapInArrow(run, schema).toArrow()
    rows = [(np.array(i, np.int32), np.array(w, np.float32), int(y)) for i, w, y, d in sorted(zip(got["ids"].to_pylist(), got["w"].to_pylist(), got["y"].to_pylist(), got["doc_id"].to_pylist(), strict=True), key=lambda r: (r[3], r[0]))]
    return fit(rows)


def score_quality(docs: DataFrame, model: Neighbours, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out`` (0 to 1, higher: good quality likelier) to every row, whose other columns stay.

    Null texts count as empty; without labelled rows every score is 0.5. An
    input column named like ``out``, in whatever case, is replaced.
    """
    bounded_batches(docs.sparkSession)
    shared = ship(docs.sparkSession, model)
    names = [c for c in docs.columns if c.lower() != out.lower() or c == text]

    def run(batches):
        fitted = shipped(shared)
        for b in batches:
            scores = fitted.score(b.column(names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, out])

    return docs.select(*names).mapInArrow(run, docs.select(*names).schema.add(out, "double"))


def keep_good(docs: DataFrame, model: Neighbours, text: str = "text", least: float = 0.5) -> DataFrame:
    """Documents that score at least ``least``; all columns stay."""
    name = fresh_name(docs, "quality_score")
    return score_quality(docs, model, text, name).where(F.col(name) >= least).drop(name)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fit_quality(docs, labels)
    rows = score_quality(docs.select("doc_id", "text"), model).drop("text")
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_query(spark, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
