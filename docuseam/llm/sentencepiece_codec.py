"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary is that of a given model file. Its pieces are ranked (the file
holds byte-pair merges, so the scores are ranks, not probabilities); a piece of
rank r gets the log probability of Zipf's law, -log(r + 2.7), and Viterbi picks
the segmentation of highest total. Characters outside the vocabulary become
their bytes.

There is one encoder for all texts, whatever their length. It moves over the
characters and keeps the scores of the last ``longest piece`` positions, the
states from which a piece may still start. Backpointers are held only since the
last commit. Ids are committed whenever all surviving backpointer paths meet in
one boundary: at once where no piece spans a position, as before every word,
else when a look at the paths of the live states, taken every window, finds the
last boundary they share. From such a boundary on, the ids depend only on the
characters up to the next certain one, so stretches between boundaries that no
piece can span are remembered, in a memo bounded in bytes.

Ids therefore differ from those of the byte-pair merge order of the library for
this kind of file; decoding gives back the text exactly.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh_name, other_columns, ship, shipped, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
_NEVER = -1e30
_END = (0, 0.0, 0)
#: Bytes of each of the two halves of a worker's memo.
MEMO_BYTES = 24 << 20


class Memo:
    """Ids of stretches; the older half is dropped when the younger one is full."""

    def __init__(self, half: int = MEMO_BYTES) -> None:
        self.half, self.held = half, 0
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def find(self, key: str) -> list[int] | None:
        ids = self.old.get(key)
        if ids is not None:
            self.keep(key, ids)
        return ids

    def keep(self, key: str, ids: list[int]) -> None:
        cost = 260 + 4 * len(key) + 8 * len(ids)  # the numbers themselves are the codec's
        if cost > self.half:
            return
        if self.held + cost > self.half:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = ids
        self.held += cost


class Codec:
    """Pieces, ids and log probabilities; bounded by the vocabulary."""

    def __init__(self, pieces: list[str], kinds: list[str]) -> None:
        self.pieces, self.kinds = pieces, kinds
        self.made: tuple | None = None
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.logp: dict[str, float] = {}
        rank = 0
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == "byte":
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif kind == "normal":
                self.ids.setdefault(piece, i)
                self.logp.setdefault(piece, -math.log(rank + 2.7))
                rank += 1
        self.byte_cost = -math.log(rank + 2.7) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        # characters that no longer piece holds stand alone: both their boundaries are meeting points
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t\r" if c not in joined)
        spans = any(_SPACE in p.lstrip(_SPACE) for p in self.ids)
        cut = re.escape(self.alone)
        word = f"{_SPACE}*[^{_SPACE}{cut}]+" if not spans else f"[^{cut}]+"
        self.chunks = re.compile(f"{word}|{_SPACE}+" + (f"|[{cut}]" if cut else ""))

    @classmethod
    def load(cls, path: str = MODEL) -> Codec:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if p.is_byte(i) else "normal" if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) else "other"
        n = p.get_piece_size()
        return cls([p.id_to_piece(i) for i in range(n)], [kind(i) for i in range(n)])

    def matcher(self):
        """All pieces in one automaton; a match says (length, log probability, id)."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            found.add_word(piece, (len(piece), self.logp[piece], i))
        found.make_automaton()
        return found

    def walker(self):
        """A function from a stretch of text to its ids, by Viterbi over a bounded window of live states.

        ``seen``, a list of two numbers, counts the commits and keeps the widest window of backpointers.
        """
        pieces, byte_cost, longest, meeting, emit = self.matcher().iter, self.byte_cost, self.longest, self._meeting, self._emit

        def walk(text: str, seen: list[int] | None = None) -> list[int]:
            out: list[int] = []
            score, back, which = [0.0], [0], [-1]  # of the positions from the last committed one on
            base = top = 0  # the last committed boundary, and the last position that has a state
            limit = 2 * longest  # a window this long is looked at
            for at, (size, logp, i) in chain(pieces(text), [(len(text), _END)]):  # by end, the longest piece first
                if at >= top:
                    while top < at or top - base >= limit:
                        if top - base >= limit:  # commit where the paths of the live states meet
                            meet = meeting(back, base, top)
                            limit = top - base + longest if meet == base else 2 * longest
                            base = emit(out, text, score, back, which, base, meet, seen)
                        if top < at:  # no piece ends there: the character becomes bytes
                            score.append(score[-1] + byte_cost)
                            back.append(top)
                            which.append(-1)
                            top += 1
                    if not size:
                        break
                    score.append(_NEVER)
                    back.append(at)
                    which.append(-1)
                    top = at + 1
                k = top - size - base
                s = score[k] + logp
                if s > score[-1]:
                    score[-1], back[-1], which[-1] = s, k + base, i
            emit(out, text, score, back, which, base, top, seen)
            return out

        return walk

    def _emit(self, out: list[int], text: str, score: list, back: list, which: list, base: int, end: int, seen: list[int] | None) -> int:
        """Give out the ids of the path from ``base`` to ``end`` and forget what is before; returns ``end``."""
        path, at = [], end
        while at > base:
            path.append((at, which[at - base]))
            at = back[at - base]
        for at, i in reversed(path):
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in text[at - 1].encode("utf-8", "surrogatepass")]
        if end > base and seen is not None:
            seen[0], seen[1] = seen[0] + 1, max(seen[1], len(score))
        keep = end - base
        del score[:keep], back[:keep], which[:keep]
        return end

    def _meeting(self, back: list[int], base: int, end: int) -> int:
        """Last boundary that the paths from all live states up to ``end`` share."""
        meet: set[int] | None = None
        for state in range(max(base, end - self.longest + 1), end + 1):
            path, at = set(), state
            while at > base:
                path.add(at)
                at = back[at - base]
            meet = path if meet is None else meet & path
        return max(meet or (), default=base)

    def both(self) -> tuple:
        """An encoder and a decoder, made once in a worker; tasks that follow share the automaton and the memo."""
        self.made = self.made or (self.encoder(), self.decoder())
        return self.made

    def encoder(self):
        """A function from text to ids with a memo of its own; null and empty texts have no ids."""
        memo = Memo()
        cut, walk, mark = self.chunks.findall, self.walker(), [self.byte_ids[b] for b in _SPACE.encode()]

        def encode(text: str | None) -> list[int]:
            out: list[int] = []
            for n, part in enumerate((text or "").split(_SPACE)):
                if n:  # the mark itself, which stands for a space in pieces, is kept as bytes
                    out += mark
                if not part:
                    continue
                for stretch in cut((_SPACE + part if not n else part).replace(" ", _SPACE)):
                    ids = memo.young.get(stretch)
                    if ids is None:
                        ids = memo.find(stretch)
                        if ids is None:
                            ids = walk(stretch)
                            memo.keep(stretch, ids)
                    out += ids
            return out

        return encode

    def decoder(self):
        """A function from ids to text; ids out of range and control pieces are left out."""
        text = [p.replace(_SPACE, " ").encode() if k == "normal" else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        for b, i in enumerate(self.byte_ids):
            text[i] = bytes([b])
        n = len(text)

        def decode(ids) -> str:
            raw = b"".join([text[i] for i in ids if 0 <= i < n])
            return raw.decode("utf-8", "replace").removeprefix(" ")

        return decode


def encode_texts(docs: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL, check: str | None = None) -> DataFrame:
    """Replace the text by ``out``, its ids; all other columns and rows stay.

    A first piece mark stands before the text, as in the library; decoding takes
    one leading space off. A text that starts with the mark itself has none.
    Input columns named like an output, in whatever case, are replaced.
    ``check``: name of a column that says whether decoding gives the text back.
    """
    bounded_batches(docs.sparkSession)
    shared = ship(docs.sparkSession, Codec.load(model))
    others = other_columns(docs, text, out, check)
    schema = T.StructType([*docs.select(*others).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    if check:
        schema = schema.add(check, "boolean")

    def run(batches):
        encode, decode = shipped(shared).both()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column(len(others)).to_pylist()
                flat, ends, same = [], [0], []
                for t in texts:
                    ids = encode(t)
                    flat += ids
                    ends.append(len(flat))
                    if check:
                        same.append(decode(ids) == (t or ""))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], ids, *([pa.array(same, pa.bool_())] if check else [])], schema.names)

    return docs.select(*others, F.col(text).alias(fresh_name(docs.select(*others), "text"))).mapInArrow(run, schema)


def decode_texts(docs: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """Replace the ids by ``out``, their text; null ids count as none. All other columns stay, but for one named like ``out`` in whatever case."""
    bounded_batches(docs.sparkSession)
    shared = ship(docs.sparkSession, Codec.load(model))
    others = other_columns(docs, ids, out)
    schema = T.StructType([*docs.select(*others).schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        decode = shipped(shared).both()[1]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array([decode(x.as_py() or ()) for x in b.column(len(others))], pa.string())], schema.names)

    return docs.select(*others, F.col(ids).alias(fresh_name(docs.select(*others), "ids"))).mapInArrow(run, schema)


def token_report(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, and whether decoding gives the text back exactly."""
    rows = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), check="exact")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")
