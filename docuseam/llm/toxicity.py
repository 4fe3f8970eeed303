"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Texts are read as words; a word of over ``PIECE`` characters is read as pieces of
that length that overlap, so that no character is left out. Each word has a
learned vector, looked up by a hash of the word, and a character vector, the
mean of learned vectors of hashed character n-grams with word boundaries. Windows of words, overlapping by half,
go through a recurrent layer in each direction; attention pools the states to
one logit per window. A document's score is that of its highest window. The
network is trained in numpy on the driver, on a bounded sample of labelled
documents; executors score all windows of whole texts in numpy.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, ship, shipped, table
from .quality import labelled_sample

#: Bounds of the labelled sample: documents, and their words together. Whole texts are taken, as many as fit.
MAX_LABELLED = 3000
MAX_TRAIN_WORDS = 4_000_000
WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM = 8, 12, 12
WORD_BUCKETS, CHAR_BUCKETS = 1 << 18, 1 << 16
#: A word has a vector of its own if it occurs in so many labelled documents; rarer and unknown words have their characters only.
LEAST_DOCS = 8
#: Every so many-th labelled document is not trained on; the best round by its area under the curve counts.
FOLD = 6
#: Part of the toxic documents, those with the weakest best windows, that late rounds leave out: wrong labels.
DOUBTED = 0.1
_GRAMS = (3, 5)
#: Longest word that is read as one, and the characters by which pieces of longer ones overlap.
PIECE, OVERLAP = 24, 4
_WIDTH = PIECE + 2
_CACHE = 300_000
_CHUNK = 2048


_MARKS = string.punctuation


def words_of(text: str | None) -> list[str]:
    words = [w.strip(_MARKS) or w for w in (text or "").lower().split()]
    if max(map(len, words), default=0) <= PIECE:
        return words
    step = PIECE - OVERLAP
    return [w[i : i + PIECE] for w in words for i in range(0, max(1, len(w) - OVERLAP), step)]


def word_key(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word with its boundaries, and how often they count.

    Two arrays of words x places; words have ``PIECE`` characters at most. All
    n-grams of all words are hashed at once.
    """
    marked = np.array([f"<{w}>" for w in words] or [""], f"<U{_WIDTH}")
    c = marked.view(np.uint32).reshape(len(marked), _WIDTH)[: len(words)]
    keys, count = [], []
    for n in _GRAMS:
        h = np.full((len(c), _WIDTH - n + 1), n, np.uint32)
        for k in range(n):
            h = (h ^ c[:, k : _WIDTH - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        keys.append(h % CHAR_BUCKETS)
        count.append(c[:, n - 1 :] != 0)
    return np.concatenate(keys, axis=1).astype(np.int32), np.concatenate(count, axis=1)


def window_starts(n: int) -> range:
    """Starts of the windows of a text of n words; the last may be short."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _cut(got: list[int]) -> np.ndarray:
    """Windows x positions of a text's word ids, padded with 0."""
    n = len(window_starts(len(got)))
    ids = np.zeros(n * STRIDE + WINDOW, np.int32)
    ids[: len(got)] = got
    return np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[: n * STRIDE : STRIDE]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Network:
    """Weights; gates are stacked as update, reset, candidate."""

    p: dict[str, np.ndarray]
    offset: float = 0.0

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        p = {"word": np.zeros((WORD_BUCKETS, WORD_DIM)), "char": r.normal(0, 0.1, (CHAR_BUCKETS, CHAR_DIM))}
        for way in "fb":
            p |= {f"W{way}": r.normal(0, d**-0.5, (d, 3 * h)), f"U{way}": r.normal(0, h**-0.5, (h, 3 * h)), f"b{way}": np.zeros(3 * h)}
        p |= {"Wa": r.normal(0, 0.3, (2 * h, h)), "ba": np.zeros(h), "va": r.normal(0, 0.3, h), "wo": r.normal(0, 0.3, 2 * h), "bo": np.zeros(1)}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def word_vectors(self, words: list[str]) -> np.ndarray:
        """Word and character vectors of distinct words; the empty word is all zero."""
        keys, count = gram_keys(words)
        return self._vectors(np.array([word_key(w) for w in words], np.int64), keys, count, np.array([bool(w) for w in words], bool))

    def _vectors(self, word_keys: np.ndarray, keys: np.ndarray, count: np.ndarray, real: np.ndarray) -> np.ndarray:
        out = np.zeros((len(word_keys), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"][word_keys]
        total = np.maximum(1, count.sum(axis=1)).astype(np.float32)
        for a in range(0, len(out), 4096):
            part = np.einsum("wkd,wk->wd", self.p["char"][keys[a : a + 4096]], count[a : a + 4096].astype(np.float32))
            out[a : a + 4096, WORD_DIM:] = part / total[a : a + 4096, None]
        out[~real] = 0
        return out

    def gate_inputs(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds to the gates, per direction: computed once for each distinct word.

        Update and reset gates are halved, as ``logits`` takes them.
        """
        half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), HIDDEN)
        return (vectors @ self.p["Wf"] + self.p["bf"]) * half, (vectors @ self.p["Wb"] + self.p["bb"]) * half

    def logits(self, gates_f: np.ndarray, gates_b: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logit of each window of word ids, 0 where there is no word.

        Both directions advance together: the state holds them side by side and
        the recurrent weights are block-diagonal. A sigmoid is a scaled tanh.
        """
        p, h_ = self.p, HIDDEN
        u_zr, u_c = np.zeros((2 * h_, 4 * h_), np.float32), np.zeros((2 * h_, 2 * h_), np.float32)
        for k, way in enumerate("fb"):
            at = slice(k * h_, (k + 1) * h_)
            u_zr[at, k * h_ : (k + 1) * h_] = p[f"U{way}"][:, :h_] / 2  # update gates first, then reset gates
            u_zr[at, (2 + k) * h_ : (3 + k) * h_] = p[f"U{way}"][:, h_ : 2 * h_] / 2
            u_c[at, at] = p[f"U{way}"][:, 2 * h_ :]
        place = np.ascontiguousarray(ids.T)
        t, n = place.shape
        live = (place > 0).astype(np.float32)
        states = np.empty((t, n, 2 * h_), np.float32)
        h, x, keep = np.zeros((n, 2 * h_), np.float32), np.empty((n, 6 * h_), np.float32), np.empty((n, 2 * h_), np.float32)
        for i in range(t):
            f, b = gates_f[place[i]], gates_b[place[t - 1 - i]]
            for k, g in enumerate((f, b)):
                x[:, k * h_ : (k + 1) * h_] = g[:, :h_]
                x[:, (2 + k) * h_ : (3 + k) * h_] = g[:, h_ : 2 * h_]
                x[:, (4 + k) * h_ : (5 + k) * h_] = g[:, 2 * h_ :]
            zr = x[:, : 4 * h_] + h @ u_zr
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            c = x[:, 4 * h_ :] + (h * zr[:, 2 * h_ :]) @ u_c
            np.tanh(c, out=c)
            c -= h
            np.subtract(1, zr[:, : 2 * h_], out=keep)
            keep[:, :h_] *= live[i][:, None]
            keep[:, h_:] *= live[t - 1 - i][:, None]
            c *= keep
            h += c
            states[i, :, :h_] = h[:, :h_]
            states[t - 1 - i, :, h_:] = h[:, h_:]
        attn = np.tanh(states.reshape(-1, 2 * h_) @ p["Wa"] + p["ba"]) @ p["va"]
        attn = np.where(live > 0, attn.reshape(t, n), np.float32(-1e9))
        attn = np.exp(attn - attn.max(axis=0))
        said = (states.reshape(-1, 2 * h_) @ p["wo"]).reshape(t, n)
        return (attn * said).sum(axis=0) / attn.sum(axis=0) + p["bo"][0]


class _Ids(dict):
    """Numbers words as they come; new ones are kept for the next gate inputs."""

    def __init__(self) -> None:
        super().__init__({"": 0})
        self.fresh = [""]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Scorer:
    """Scores texts with a network; keeps gate inputs of recent words in a bounded cache."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.ids = _Ids()
        self.tables = [np.zeros((0, 3 * HIDDEN), np.float32)] * 2

    def _window_logits(self, ids: np.ndarray) -> np.ndarray:
        if self.ids.fresh:
            fresh = self.ids.fresh
            more = [self.net.gate_inputs(self.net.word_vectors(fresh[i : i + 8192])) for i in range(0, len(fresh), 8192)]
            self.tables = [np.concatenate([a, *b]) for a, b in zip(self.tables, zip(*more, strict=True), strict=True)]
            self.ids.fresh = []
        return np.concatenate([self.net.logits(*self.tables, ids[i : i + _CHUNK]) for i in range(0, len(ids), _CHUNK)])

    def logits(self, texts) -> np.ndarray:
        """Highest window logit of each text. Texts are cut in pieces of whole windows, so memory stays bounded."""
        best = np.full(len(texts), -np.inf)
        rows, owner, held = [], [], 0

        def flush() -> None:
            nonlocal rows, owner, held
            if rows:
                np.maximum.at(best, np.concatenate(owner), self._window_logits(np.concatenate(rows)))
            rows, owner, held = [], [], 0
            if len(self.ids) > _CACHE:
                self._clear()

        step = STRIDE * 4096
        for k, text in enumerate(texts):
            words = words_of(text)
            for a in range(0, max(1, len(words)), step):
                piece = words[a : a + step + WINDOW]
                windows = _cut(list(map(self.ids.__getitem__, piece)))
                rows.append(windows)
                owner.append(np.full(len(windows), k))
                held += len(windows)
                if held >= 32768:
                    flush()
        flush()
        return best

    def score(self, texts) -> np.ndarray:
        return _sigmoid(self.logits(texts).astype(float) + self.net.offset) if len(texts) else np.zeros(0)


# --- training -------------------------------------------------------------


def _pass(net: Network, vec: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of a batch of windows; ``vec``: vectors of the batch's words."""
    p, (n, t), h_ = net.p, ids.shape, HIDDEN
    mask = (ids > 0).astype(np.float32)
    x = vec[ids]
    keep = {}
    states = np.zeros((t, n, 2 * h_), np.float32)
    for way, order, at in (("f", range(t), 0), ("b", range(t - 1, -1, -1), h_)):
        pre = x @ p[f"W{way}"] + p[f"b{way}"]
        u, h, steps = p[f"U{way}"], np.zeros((n, h_), np.float32), []
        for i in order:
            zr = _sigmoid(pre[:, i, : 2 * h_] + h @ u[:, : 2 * h_])
            z, r = zr[:, :h_], zr[:, h_:]
            c = np.tanh(pre[:, i, 2 * h_ :] + (h * r) @ u[:, 2 * h_ :])
            steps.append((i, h, z, r, c))
            h = h + mask[:, i, None] * (1 - z) * (c - h)
            states[i, :, at : at + h_] = h
        keep[way] = steps
    e = np.tanh(states @ p["Wa"] + p["ba"])
    a = np.where(mask.T > 0, e @ p["va"], -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tnh,tn->nh", states, a)
    prob = _sigmoid(pooled @ p["wo"] + p["bo"][0])
    loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
    d = ((prob - y) / n).astype(np.float32)
    g["wo"], g["bo"] = pooled.T @ d, np.array([d.sum()], np.float32)
    dp = d[:, None] * p["wo"]
    ds = a[:, :, None] * dp
    da = np.einsum("tnh,nh->tn", states, dp)
    da = a * (da - (a * da).sum(axis=0))
    g["va"] = np.einsum("tn,tnh->h", da, e)
    de = da[:, :, None] * p["va"] * (1 - e * e)
    g["Wa"], g["ba"] = np.einsum("tni,tnj->ij", states, de), de.sum(axis=(0, 1))
    ds = ds + de @ p["Wa"].T
    dx = np.zeros_like(x)
    for way, at in (("f", 0), ("b", h_)):
        u, dh, dpre = p[f"U{way}"], np.zeros((n, h_), np.float32), np.zeros((n, t, 3 * h_), np.float32)
        for i, h, z, r, c in reversed(keep[way]):
            dh = dh + ds[i, :, at : at + h_]
            m = mask[:, i, None]
            dc = dh * m * (1 - z) * (1 - c * c)
            dz = dh * m * -(c - h) * z * (1 - z)
            drh = dc @ u[:, 2 * h_ :].T
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            g[f"U{way}"][:, : 2 * h_] += h.T @ dzr
            g[f"U{way}"][:, 2 * h_ :] += (h * r).T @ dc
            dpre[:, i] = np.concatenate([dzr, dc], axis=1)
            dh = dh * (1 - m * (1 - z)) + drh * r + dzr @ u[:, : 2 * h_].T
        flat = dpre.reshape(-1, 3 * h_)
        g[f"W{way}"], g[f"b{way}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
        dx += dpre @ p[f"W{way}"].T
    g["x"] = dx
    return loss, g


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * x * x
            p[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def train(rows: list[tuple[list[str], int]], rounds: int = 7, batches: int = 100, batch: int = 256, seed: int = 7) -> Network:
    """Fit on (words, label) rows. With fewer than two classes the score is constant.

    Only documents are labelled, so the windows of toxic documents that speak
    for the label are chosen anew in every round: first by smoothed log odds of
    words and character n-grams, then by the network itself, which also picks
    the hardest windows of clean documents.
    """
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in rows])
    if len(set(labels.tolist())) < 2:
        net.p["wo"][:] = 0
        net.p["bo"][0] = 0.0 if not len(labels) else 4.0 * (2 * int(labels[0]) - 1)
        return net
    index = _Ids()
    windows = [_cut([index[w] for w in words]) for words, _ in rows]
    vocab = list(index)
    real = np.array([bool(w) for w in vocab])
    words, (grams, count) = np.array([word_key(w) for w in vocab]), gram_keys(vocab)
    docs_of = np.bincount(np.concatenate([np.unique(w) for w in windows]), minlength=len(vocab))
    own_vector = np.bincount(words, docs_of * real, WORD_BUCKETS)[words] >= LEAST_DOCS
    net.p["word"][words[own_vector]] = r.normal(0, 0.1, (int(own_vector.sum()), WORD_DIM))
    fold = np.array([zlib.crc32(" ".join(w[:50]).encode("utf-8", "surrogatepass")) % FOLD == 0 for w, _ in rows])
    fold &= bool(len(set(labels[~fold].tolist())) == 2 == len(set(labels[fold].tolist())))
    everything, windows, all_labels, labels = windows, [w for w, f in zip(windows, fold, strict=True) if not f], labels, labels[~fold]
    # smoothed log odds of every bucket's documents
    seen = np.ones((2, WORD_BUCKETS + CHAR_BUCKETS))
    for y, win in zip(labels, windows, strict=True):
        own = np.unique(win[win > 0])
        seen[y, np.unique(np.concatenate([words[own], WORD_BUCKETS + grams[own][count[own]]]))] += 1
    odds = np.log(seen[1] / (labels.sum() + 2)) - np.log(seen[0] / ((1 - labels).sum() + 2))
    strength = np.maximum(odds[words], np.where(count, odds[WORD_BUCKETS + grams], -9.0).max(axis=1))
    strength[~real] = -9.0
    clean = np.concatenate([w for w, y in zip(windows, labels, strict=True) if not y])
    toxic = [w for w, y in zip(windows, labels, strict=True) if y]
    ends = np.cumsum([0, *map(len, toxic)])
    every = np.concatenate(toxic)
    adam, rate, kept = _Adam(0.01), 8.0, (-1.0, net.p)

    def logits(win: np.ndarray) -> np.ndarray:
        gates = net.gate_inputs(net._vectors(words, grams, count, real))
        return np.concatenate([net.logits(*gates, win[i : i + _CHUNK]) for i in range(0, len(win), _CHUNK)])

    def tops(some: list[np.ndarray]) -> np.ndarray:
        return np.maximum.reduceat(logits(np.concatenate(some)), np.cumsum([0, *map(len, some[:-1])]))

    def repeated(n: int) -> np.ndarray:
        """Windows that repeat one word of a clean document: repetition is not toxicity."""
        at = clean[r.integers(0, len(clean), n), r.integers(0, WINDOW, n)]
        return np.repeat(at[at > 0][:, None], WINDOW, axis=1)

    def shortened(n: int) -> np.ndarray:
        """Clean windows of few words, like those of short texts."""
        at = clean[r.integers(0, len(clean), n)]
        return np.where(np.arange(WINDOW) < r.integers(1, WINDOW // 3, n)[:, None], at, 0)

    hard, score = np.concatenate([clean, repeated(len(clean)), shortened(len(clean))]), strength[every].max(axis=1)
    for k in range(rounds):
        if k:
            some = np.concatenate([clean[r.integers(0, len(clean), min(len(clean), 100_000))], repeated(20_000), shortened(40_000)])
            hard = some[np.argsort(-logits(some))[: max(batch, len(some) // 40)]]
            score = logits(every)
        at = np.array([a + score[a:b].argmax() for a, b in zip(ends, ends[1:], strict=False)])
        best = every[at[score[at] >= np.quantile(score[at], DOUBTED if k else 0)]]
        for _ in range(batches):
            pos = best[r.integers(0, len(best), batch // 2)]
            neg = np.concatenate([clean[r.integers(0, len(clean), batch // 4)], hard[r.integers(0, len(hard), batch // 4)]])
            y = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))]).astype(np.float32)
            ids = np.concatenate([pos, neg])
            used, local = np.unique(np.append(ids.ravel(), 0), return_inverse=True)
            local = local[:-1].reshape(ids.shape)
            vec = net._vectors(words[used], grams[used], count[used], real[used])
            _, g = _pass(net, vec, local, y)
            grad = np.zeros_like(vec)
            np.add.at(grad, local.ravel(), g.pop("x").reshape(-1, vec.shape[1]))
            adam.step(net.p, g)
            _embed_step(net, words[used], grams[used], count[used], real[used], own_vector[used], grad, rate)
        rate *= 0.7
        if fold.any():
            area = auc(tops([w for w, f in zip(everything, fold, strict=True) if f]), all_labels[fold])
            if area >= kept[0]:
                kept = area, {name: v.copy() for name, v in net.p.items()}
    if fold.any():
        net.p = kept[1]
    # the cut between the classes' highest windows becomes score 0.5
    top = tops(everything)
    order = np.sort(top)
    cuts = (order[1:] + order[:-1]) / 2
    toxic_tops, clean_tops = np.sort(top[all_labels == 1]), np.sort(top[all_labels == 0])
    wrong = np.searchsorted(toxic_tops, cuts) / len(toxic_tops) + 1 - np.searchsorted(clean_tops, cuts) / len(clean_tops)
    low = np.flatnonzero(np.isclose(wrong, wrong.min()))
    net.offset = -float((cuts[low[0]] + cuts[low[-1]]) / 2)
    return net


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Probability that a toxic document scores over a clean one, ties half."""
    _, place, times = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[place]
    n = label.sum()
    return float((rank[label == 1].sum() - n * (n + 1) / 2) / max(1, n * (len(label) - n)))


def _embed_step(net: Network, words, grams, count, real, own_vector, grad: np.ndarray, rate: float) -> None:
    """Sparse steps on the word and character vectors that a batch used, of bounded length."""
    grad = grad * real[:, None]
    norm = np.maximum(1.0, np.linalg.norm(grad, axis=1, keepdims=True) * rate / 0.5)
    step = (rate * grad / norm).astype(np.float32)
    np.subtract.at(net.p["word"], words[own_vector], step[own_vector, :WORD_DIM])
    share = step[:, WORD_DIM:] / np.sqrt(np.maximum(1, count.sum(axis=1, keepdims=True)))
    owner, place = np.nonzero(count)
    keys = grams[owner, place]
    for k in range(CHAR_DIM):
        net.p["char"][:, k] -= np.bincount(keys, share[owner, k], minlength=CHAR_BUCKETS).astype(np.float32)


# --- Spark ----------------------------------------------------------------


def fit_toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held_out: int = 0, at_most: int = MAX_LABELLED) -> Network:
    """Train on a bounded sample of labelled rows outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull())
    parts = [labelled_sample(docs, known.where(F.col("toxic") == y), "toxic", mod, held_out, at_most // 2) for y in (0, 1)]
    rows = []
    for part in parts:
        # which of the ids' whole texts fit together; the ids come in the order of their hashes
        sizes = part.select("doc_id", F.xxhash64("doc_id").alias("h"), F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("n")).orderBy("h", "doc_id").collect()
        ids, room = [], MAX_TRAIN_WORDS // 2
        for r in sizes:
            if r.n <= room:
                ids.append(r.doc_id)
                room -= r.n
        got = part.where(F.col("doc_id").isin(ids)).select("doc_id", "y", "text").toArrow()
        rows += zip(got["doc_id"].to_pylist(), map(words_of, got["text"].to_pylist()), got["y"].to_pylist(), strict=True)
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))
    return train([(words, int(y)) for _, words, y in rows])


def score_toxicity(docs: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out`` (0 to 1, higher: toxic likelier) to every row, whose other columns stay.

    Every overlapping window of the whole text is scored. Null and empty texts
    get the score of an empty window. An input column named like ``out``,
    in whatever case, is replaced.
    """
    bounded_batches(docs.sparkSession)
    shared = ship(docs.sparkSession, net)
    names = [c for c in docs.columns if c.lower() != out.lower() or c == text]

    def run(batches):
        scorer = Scorer(shipped(shared))
        for b in batches:
            texts = b.column(names.index(text))
            scores = [scorer.score(texts[i : i + 64].to_pylist()) for i in range(0, len(texts), 64)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, out])

    return docs.select(*names).mapInArrow(run, docs.select(*names).schema.add(out, "double"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    net = fit_toxicity(docs, labels)
    rows = score_toxicity(docs.select("doc_id", "text"), net).drop("text")
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
