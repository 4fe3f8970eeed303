"""SimHash near-duplicates through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits differ in at
most ``max_bits`` of their 8 bytes, so they share at least ``8 - max_bits``
positional bytes. The inverted index posts each distinct fingerprint under
tuples of positional bytes: the 8 positions form ``max_bits + 2`` blocks and
every choice of 2 blocks is one key, so a linked pair meets under at least one
key. Candidates from the postings get their shared positional bytes tallied,
pairs below the guaranteed count fall out, and the rest is verified bit by bit.

A posting list that is longer than ``hot_list`` is never expanded into pairs.
Two of its members share the key's bytes, and two fingerprints at two or fewer
differing bits have a common neighbour at one or no differing bit from each.
So each member posts itself and its one-bit neighbours, and members of one
such neighbour link to its smallest member. That is exact, linear in the list
and spreads the list over many keys.
"""

from __future__ import annotations

import gc
import math
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import bounded_batches, connected_components, cut_lineage, ensure_checkpoint_dir, fresh_name, join_hot, other_columns

#: ASCII white space of the contract; other white space is part of a word.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text; null counts as empty, no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return hashed(b" ".join(words), seed)
    join = b" ".join
    total, ones = 0, np.zeros(64, np.int64)
    shingles = zip(*(words[i:] for i in range(shingle_words)), strict=False)
    while part := [hashed(join(s), seed) for _, s in zip(range(1 << 16), shingles, strict=False)]:
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def add_fingerprints(docs: DataFrame, text: str = "text", shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """Replace the text, and a column of the new name in whatever case, by ``fingerprint`` (signed 64-bit); all other columns stay."""
    bounded_batches(docs.sparkSession)
    others = other_columns(docs, text, "fingerprint")
    kept = docs.select(*others, F.col(text).alias(fresh_name(docs.select(*others), "text")))

    def run(batches):
        for b in batches:
            texts = b.column(len(others))
            prints = np.array([simhash(t.as_py(), shingle_words, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(prints, pa.int64())], [*others, "fingerprint"])

    schema = docs.select(*others).schema.add("fingerprint", "long")
    return kept.mapInArrow(run, schema)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * i).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of positional bytes that two fingerprints share."""
    return sum(((_byte(a, i) == _byte(b, i)).cast("int") for i in range(8)), F.lit(0))


def index_masks(max_bits: int) -> list[int]:
    """Byte masks of the keys: every pair of ``max_bits + 2`` blocks of positions."""
    n = max_bits + 2
    blocks = [[i for i in range(8) if i * n // 8 == k] for k in range(n)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(255 << (56 - 8 * i) for i in (*x, *y))) for x, y in combinations(blocks, 2)]


def link_fingerprints(prints: DataFrame, max_bits: int = 2, hot_list: int = 64) -> DataFrame:
    """Edges (a, b) whose closure is the closure of all links at ``max_bits`` or fewer.

    ``prints`` has one column ``fingerprint`` of distinct values.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("max_bits must be 1 or 2: longer distances need another index")
    masks = index_masks(max_bits)
    fp = F.col("fingerprint")
    keys = F.array(*[F.struct(F.lit(i).alias("slot"), fp.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    postings = prints.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.slot", "k.key")
    lists = postings.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(postings.join(lists, ["slot", "key"]))

    cold = shared.where(F.col("n") <= hot_list)
    left = cold.select("slot", "key", F.col("fingerprint").alias("a"))
    right = cold.select("slot", "key", F.col("fingerprint").alias("b"))
    pairs = left.join(right, ["slot", "key"]).where("a < b").select("a", "b")

    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    hot = shared.where(F.col("n") > hot_list).select("fingerprint").distinct()
    near = hot.select("fingerprint", F.explode(F.transform(flips, lambda m: fp.bitwiseXOR(m))).alias("near"))
    first = near.groupBy("near").agg(F.min("fingerprint").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(first, "near").where(F.col("fingerprint") != F.col("a")).select("a", F.col("fingerprint").alias("b"))
    if max_bits < 2:  # members of a common neighbour's list may be two bits apart, so links of one bit go to the neighbour itself
        stars = near.where(F.col("near") != fp).join(hot.select(F.col("fingerprint").alias("near")), "near").select(F.col("near").alias("a"), F.col("fingerprint").alias("b"))
    found = pairs.union(stars).distinct()
    found = found.where(shared_bytes(F.col("a"), F.col("b")) >= 8 - max_bits)  # count filter
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)  # verification


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle_words: int = 3, seed: int = 42, max_bits: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex) and ``component_id``.

    Null texts count as empty; texts without words get fingerprint 0 and link
    like any other. Rows with a null id keep their fingerprint and take part in
    links, the component id is the smallest id that is not null. Repeated rows
    stay repeated. Columns besides the id and the text are not read. An empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    marked = cut_lineage(add_fingerprints(rows, "text", shingle_words, seed))
    prints = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    edges = link_fingerprints(prints.select("fingerprint"), max_bits)
    roots = connected_components(edges)
    classes = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    classes = classes.select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = join_hot(classes, lowest, "root").select("fingerprint", "component_id")
    out = join_hot(marked, classes, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity ---------------------------------------------
#
# At a similarity of 0.8 the bits of SimHash differ in 15 of 100 places, so no
# tuple of its bytes is sure to be shared. The near-copy stage therefore fills
# the positional bytes with minwise hashes of the shingles: each of them is
# shared with the probability of the similarity itself. The rest is the same:
# an index of tuples of positions, a tally of the shared bytes, verification.

#: Odd factors of a shingle's words by place.
_PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Positions of a key, and keys of a text: a pair at 0.8 shares a key with a probability of over 0.9999.
POSITIONS, KEYS = 7, 42
_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, KEYS * POSITIONS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
#: One bit of each of so many positions, four words of 64, is compared where pairs are made.
SKETCH_BITS = 256
#: Standard deviations that a pair's tally may lie under its mean at the similarity.
SLACK = 4.5
#: Rounds in which the members of a list are compared with its leader, the one that meets most in all its lists,
#: before what is still apart meets in its rare shingles; the first round takes one list of so many.
LEADER_ROUNDS, FIRST_SHARE = 2, 8
#: Shingles of a batch that leaves a Python worker.
SHINGLE_ROWS = 1 << 18


def shingle_set(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes; a text with fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    w = np.array([hashed(x, 42) for x in words], np.uint64)
    n = min(shingle_words, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * _PLACES[k % len(_PLACES)] + w[k : k + len(h)]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def minwise(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The keys of a set of shingles, its sketch and its positional bytes; an empty set has keys of its own."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):  # bounds what is held at once
        np.minimum(low, (s[i : i + 256, None] * _FACTORS).min(axis=0), out=low)
    mixed = low ^ (low >> np.uint64(31))
    keys = np.zeros(KEYS, np.uint64)
    for k, part in enumerate(mixed.reshape(KEYS, POSITIONS).T):
        keys = (keys ^ (keys >> np.uint64(29))) * _PLACES[k % len(_PLACES)] + part
    keys = (keys + np.arange(KEYS, dtype=np.uint64)) * _PLACES[0]
    spread = mixed * _PLACES[1]
    sketch = np.packbits((spread[:SKETCH_BITS] & np.uint64(1 << 40)) > 0).view(np.int64)
    return keys ^ (keys >> np.uint64(32)), sketch, (spread >> np.uint64(56)).astype(np.uint8).tobytes()


def near_sketches(a: str, b: str, similarity: float) -> Column:
    """Whether two sketches differ in no more bits than the similarity allows, but for one pair of hundreds of thousands."""
    mean = SKETCH_BITS * (1 - similarity) / 2
    most = math.floor(mean + SLACK * math.sqrt(mean * (1 + similarity) / 2))
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_BITS // 64)), F.lit(0)) <= most


def least_tally(similarity: float) -> int:
    """So many positional bytes are shared at least, but for one pair of hundreds of thousands, at this similarity."""
    n = KEYS * POSITIONS
    return max(POSITIONS, math.floor(n * similarity - SLACK * math.sqrt(n * similarity * (1 - similarity))))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is this or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _mark_rows(docs: DataFrame, text: str, shingle_words: int) -> tuple[DataFrame, dict[str, str]]:
    """All columns and, under fresh names, a tag of the row, its set of shingles (node), its keys, sketch and positional bytes; kept as Parquet in the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ensure_checkpoint_dir(spark)
    name = {c: fresh_name(docs, f"_{c}") for c in ("tag", "node", "keys", "sketch", "bytes")}
    tagged = docs.select("*", F.monotonically_increasing_id().alias(name["tag"]))
    at, names = docs.columns.index(text), [*tagged.columns, *[name[c] for c in ("node", "keys", "sketch", "bytes")]]

    def run(batches):
        for b in batches:
            nodes, keys, sketches, held = [], [], [], []
            for t in b.column(at):
                s = shingle_set(t.as_py(), shingle_words)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                k, sketch, x = minwise(s)
                keys.append(k.view(np.int64))
                sketches.append(sketch)
                held.append(x)
            lists = lambda xs, n: pa.ListArray.from_arrays(pa.array(np.arange(len(xs) + 1, dtype=np.int32) * n), pa.array(np.concatenate([np.empty(0, np.int64), *xs])))
            more = [pa.array(np.array(nodes, np.uint64).view(np.int64)), lists(keys, KEYS), lists(sketches, SKETCH_BITS // 64), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names)

    schema = StructType([*tagged.schema.fields]).add(name["node"], "long").add(name["keys"], ArrayType(LongType())).add(name["sketch"], ArrayType(LongType())).add(name["bytes"], "binary")
    return _kept(spark, tagged.mapInArrow(run, schema)), name


def _tallied(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Count filter: the pairs (a, b) that share as many positional bytes as the similarity asks for."""
    side = lambda end: prints.select(F.col("id").alias(end), F.col("bytes").alias(f"bytes_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bytes_a", "bytes_b")
    least = least_tally(similarity)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, KEYS * POSITIONS) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingles are alike."""
    side = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, b, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
                sets = []
                for node, text in ((a.as_py(), x), (b.as_py(), y)):
                    if node not in known:
                        known[node] = shingle_set(text.as_py(), shingle_words)
                    sets.append(known[node])
                keep.append(alike(*sets, similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The frame as Parquet in the shared folder, which takes less room than a checkpoint; shuffles nobody needs any more are dropped."""
    path = f"{spark.sparkContext.getCheckpointDir()}/near-copies-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _shingle_rows(texts: DataFrame, shingle_words: int) -> DataFrame:
    """``node``, ``size`` (shingles of the node) and ``shingle``, a row for each distinct shingle of (node, text)."""
    names = ["node", "size", "shingle"]

    def rows(held):
        sizes = np.array([len(s) for _, s in held], np.int64)
        nodes = np.array([node for node, _ in held], np.int64)
        columns = (np.repeat(nodes, sizes), np.repeat(sizes, sizes), np.concatenate([s for _, s in held]).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                held.append((node.as_py(), shingle_set(text.as_py(), shingle_words)))
                total += len(held[-1][1])
                if total >= SHINGLE_ROWS:
                    yield rows(held)
                    held, total = [], 0
        if held:
            yield rows(held)

    return texts.select("node", "text").mapInArrow(run, "node long, size long, shingle long")


def _rare_pairs(apart: DataFrame, texts: DataFrame, kept, shingle_words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different groups (node, root, sketch); all pairs at the similarity are among them.

    The shingles of a node stand in one order for all nodes, from rare to common.
    Two sets at the similarity share so many shingles that the first shared one
    stands early in both: within a fifth of the larger set and a ninth of the
    smaller one at 0.8. So texts that have a common passage, but not enough
    beside it, never meet, however many they are.
    """
    nodes = apart.select("node", "root", "sketch").dropDuplicates(["node"])
    rows = kept(_shingle_rows(texts.join(nodes.select("node"), "node", "left_semi"), shingle_words))
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = join_hot(rows, often, "shingle")  # a shingle of one node comes first and meets nobody
    of_node = Window.partitionBy("node")
    place = F.col("size") - F.count("*").over(of_node) + F.row_number().over(of_node.orderBy("df", "shingle")) - 1
    first = shared.select("node", "size", "shingle", place.alias("at"))
    posted = first.where(F.col("size") - F.col("at") >= similarity * F.col("size") - 1e-6).join(nodes, "node")
    end = lambda e: posted.select("shingle", *[F.col(c).alias(f"{c}_{e}") for c in ("node", "size", "at", "root", "sketch")])
    both = similarity / (1 + similarity)
    least = both * (F.col("size_a") + F.col("size_b")) - 1e-6
    fit = (F.struct("size_a", "node_a") < F.struct("size_b", "node_b")) & (F.col("size_a") >= similarity * F.col("size_b") - 1e-6)
    fit = fit & (F.col("size_a") - F.col("at_a") >= least) & (F.col("size_b") - F.col("at_b") >= least)
    fit = fit & (F.col("root_a") != F.col("root_b")) & near_sketches("sketch_a", "sketch_b", similarity)
    small = end("a").where(F.col("size_a") - F.col("at_a") >= 2 * both * F.col("size_a") - 1e-6)
    return small.join(end("b"), "shingle").where(fit).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _near_copy_roots(rows: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """``node`` and ``root``, tags of their first rows, of all sets of shingles (node, keys, sketch, bytes, tag, text) that have a near copy."""
    spark = rows.sparkSession
    kept = lambda df: _kept(spark, df)
    # a set is named by its first row's tag from here on
    firsts = rows.groupBy("node").agg(F.min("tag").alias("tag"))
    prints = rows.join(firsts.select("tag"), "tag", "left_semi").select(F.col("tag").alias("id"), "keys", "sketch", "bytes")
    postings = prints.select("id", F.explode("keys").alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = postings.join(lists, "key").select("key", F.col("id").alias("node"), "n")
    # whom a node meets in all its lists together: the middle of a group meets most of it
    shared = kept(met.join(prints.select(F.col("id").alias("node"), "sketch"), "node").withColumn("met", F.sum("n").over(Window.partitionBy("node"))).drop("n"))
    some = shared.select("node").distinct()
    signs = kept(prints.join(some.withColumnRenamed("node", "id"), "id", "left_semi").select("id", "bytes"))
    texts = kept(rows.select(F.col("tag").alias("node"), "text").join(some, "node", "left_semi"))
    decided = lambda pairs: kept(_verified(_tallied(pairs.distinct(), signs, similarity), texts, shingle_words, similarity))

    # the first round takes an eighth of the lists: members of a large group meet its leaders in any of them
    edges, apart = None, shared.withColumn("root", F.col("node"))
    for k in range(LEADER_ROUNDS):
        some = apart if k else apart.where(F.pmod("key", F.lit(FIRST_SHARE)) == 0)
        led = some.groupBy("key").agg(F.max_by(F.struct("node", "root", "sketch"), F.struct("met", "node")).alias("f"))
        led = led.select("key", F.col("f.node").alias("leader"), F.col("f.root").alias("root_of"), F.col("f.sketch").alias("sketch_of"))
        fit = (F.col("root") != F.col("root_of")) & near_sketches("sketch", "sketch_of", similarity)
        stars = some.join(led, "key").where(fit).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        found = decided(stars)
        edges = found if edges is None else edges.union(found)
        roots = connected_components(edges)
        part = apart.drop("root").join(roots, "node", "left").select("key", "node", "sketch", "met", F.coalesce("root", "node").alias("root"))
        mixed = part.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        apart = kept(part.join(mixed, "key", "left_semi"))
        if apart.isEmpty():
            return roots
    return connected_components(edges.union(decided(_rare_pairs(apart, texts, kept, shingle_words, similarity))))


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: ``doc_id`` and ``component_id`` of near copies at this similarity of their shingles.

    Links are pairs whose sets of distinct shingles have this Jaccard similarity.
    Equal sets are merged first. The index posts each set under ``KEYS`` tuples
    of ``POSITIONS`` positional bytes, minwise hashes of its shingles; pairs that
    meet, and whose sketches are near, get their shared bytes tallied, and those
    with enough are decided by the shingles of their texts. The members of a list are compared with a leader, the
    member that meets most in all its lists: where a group has a middle, it leads.
    What leaders leave in different groups meets once more in its rare shingles, where
    no pair at the similarity is lost, so no list is capped or paired in full. Nulls, empty texts and repeated rows are as in ``simhash_groups``.
    """
    marked, name = _mark_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", shingle_words)
    rows = marked.select("doc_id", "text", *[F.col(n).alias(c) for c, n in name.items()])
    roots = _near_copy_roots(rows, shingle_words, similarity)
    prints = rows.groupBy(F.col("node").alias("set")).agg(F.min("tag").alias("node"), F.min("doc_id").alias("first_id"))
    classes = prints.join(roots, "node", "left").select("set", "first_id", F.coalesce("root", "node").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = join_hot(classes, lowest, "root").select("set", "component_id")
    return join_hot(rows.select("doc_id", F.col("node").alias("set")), classes, "set").select("doc_id", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Documents without their near copies: of each group the row with the smallest id stays.

    Of rows of a group that share that id, the one with the smallest hash of its
    text stays. Rows with a null id stay only where their group has no other
    row. Rows of different groups never displace each other, whatever their ids.
    All columns stay.
    """
    void = {c for c, kind in docs.dtypes if kind == "void"}  # Parquet has no such columns
    marked, name = _mark_rows(docs.drop(*void), text, shingle_words)
    rows = marked.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *[F.col(n).alias(c) for c, n in name.items()])
    roots = _near_copy_roots(rows, shingle_words, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.xxhash64("text").alias("hash"), "tag")
    best = rows.groupBy(F.col("node").alias("set")).agg(F.min("tag").alias("node"), F.min(order).alias("o"))
    best = best.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("o").alias("o"))
    kept = marked.join(best.select(F.col("o.tag").alias(name["tag"])), name["tag"], "left_semi")
    return kept.select(*[F.lit(None).alias(c) if c in void else c for c in docs.columns])
