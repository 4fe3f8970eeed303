"""Prefix trie of conversations, from padded matrices of turn ids.

Conversations are dealt to range shards in the order of their turns, copies by
their id, and a task reads its shard in that order, block by block. A block is a
matrix with a row for each conversation and a column for each turn, padded with
an id smaller than all others. A row that differs from the one above in some
column differs in all later ones, so an OR-accumulated mask of changes marks where
the nodes of each depth start, and one ``reduceat`` over the columns aggregates
the nodes of all depths.

A node that holds neither the first nor the last row of its block is whole: no
other block has a member of it. The others, two paths a block, are boundary
nodes: their parts are merged by a digest of their turns, and sums over their
subtrees are gathered by pointers that reach twice as far with every round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut_lineage, table

#: Cells of a block's matrix; one conversation of more turns is a block by itself.
BLOCK_CELLS = 1 << 20
#: Turns that the range of a shard is told by; copies beyond them are dealt by id, which boundary nodes make good.
RANGE_TURNS = 16

_PAD = np.iinfo(np.int64).min
_NODE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [T.StructField("ends_sha256", T.StringType())]
    # of boundary nodes: their digest; of them and of nodes below them: the parent's digest
    + [T.StructField("node", T.BinaryType()), T.StructField("parent", T.BinaryType()), T.StructField("block", T.StringType())]
    + [T.StructField("tokens", T.LongType()), T.StructField("ends", T.StringType()), T.StructField("first_end", T.LongType())]
)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, each as two 64-bit hashes of role and text and the text's code points.

    Turns are ordered by turn, nulls first, then role and text; null roles and
    texts count as empty. Rows with a null conv_id belong to no conversation and
    are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    clamp = F.lit(int(_PAD) + 1).cast("long")
    one = F.struct(
        F.greatest(F.xxhash64(role, text), clamp).alias("hi"),
        F.greatest(F.xxhash64(F.lit(1), text, role), clamp).alias("lo"),
        F.length(text).alias("tokens"),
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", role.alias("role"), F.sha2(text, 256).alias("at"), one.alias("one")).alias("x"))
    # struct order puts nulls first; equal roles of one turn go by the text's digest
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["one"]).alias("turns"))


def rebuild(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Every conversation with its first h turns taken from the first of its group, h = crc32(id) % most."""
    head = F.crc32(F.col("conv_id").cast("string")) % most
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, most).alias("heads"))
    own = turns.select("conv_id", "turns", head.cast("int").alias("h"), first.alias("first")).join(heads, "first", "left")
    none = F.array().cast(turns.schema["turns"].dataType)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.select("conv_id", F.concat(F.when(F.col("h") > 0, F.slice(F.coalesce("heads", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none), rest).alias("turns"))


class Block:
    """The trie of some conversations; ``hi``, ``lo``, ``tokens``: flat values of the turns of all rows."""

    def __init__(self, conv: np.ndarray, sizes: np.ndarray, hi: np.ndarray, lo: np.ndarray, tokens: np.ndarray):
        width, n = int(sizes.max()), len(conv)
        held = np.arange(width) < sizes[:, None]
        ids = np.full((2, n, width), _PAD)
        ids[0][held], ids[1][held] = hi, lo
        long = np.zeros((n, width + 1), np.int64)
        long[:, 1:][held] = tokens
        order = np.lexsort([conv, *(ids[k, :, d] for d in range(width - 1, -1, -1) for k in (1, 0))])
        self.conv, self.size, self.ids = conv[order], sizes[order], ids[:, order]
        changed = np.ones((n, width + 1), bool)
        changed[1:, 0] = False
        changed[1:, 1:] = (self.ids[:, 1:] != self.ids[:, :-1]).any(axis=0)
        starts = np.logical_or.accumulate(changed, axis=1).T  # depth x row
        self._aggregate(starts, long[order].T, width, n)

    def _aggregate(self, starts: np.ndarray, long: np.ndarray, width: int, n: int) -> None:
        at = np.flatnonzero(starts)
        depth, row = np.divmod(at, n)
        real = self.size >= np.arange(width + 1)[:, None]  # rows that reach a depth
        count = np.diff(np.append(at, starts.size))
        new = starts & real

        def below(values: np.ndarray) -> np.ndarray:
            """Sums of values at starts of nodes over each node's subtree."""
            return np.add.reduceat(np.cumsum(values[::-1], axis=0)[::-1].ravel(), at)

        place = np.cumsum(starts.ravel()) - 1  # node of every cell
        saved = np.zeros(starts.shape, np.int64)
        saved.ravel()[at] = (count - 1) * long.ravel()[at]
        deeper = np.zeros(starts.shape, np.int64)
        deeper[:-1] = new[1:]
        children = np.add.reduceat(deeper.ravel(), at)
        leaf = np.zeros(starts.shape, np.int64)
        leaf.ravel()[at] = children == 0
        ended = np.add.reduceat((self.size == np.arange(width + 1)[:, None]).ravel().astype(np.int64), at)
        lowest = np.minimum.reduceat(np.tile(self.conv, width + 1), at)
        self.valid = real.ravel()[at]
        open_ = np.zeros(len(at), bool)  # nodes with the first or the last row
        open_[place.reshape(starts.shape)[:, [0, -1]].ravel()] = True
        self.open = open_ & self.valid
        parent = place[np.maximum(at - n, 0)]
        self.depth, self.row, self.count, self.parent, self.lowest = depth, row, count, parent, lowest
        self.ended, self.tokens = ended, long.ravel()[at]
        # of whole nodes their subtree, of boundary nodes what is whole below them
        all_leaves, all_saved = below(leaf * new), below(saved * new)
        top = self.valid & ~self.open & self.open[parent] & (depth > 0)  # whole nodes right below a boundary node
        size = len(at)
        under = np.zeros((3, size), np.int64)
        for total, values in zip(under, (np.ones(size, np.int64), all_leaves, all_saved), strict=True):
            np.add.at(total, parent[top], values[top])
        self.children, self.leaves, self.saved = (np.where(self.open, a, b) for a, b in zip(under, (children, all_leaves, all_saved), strict=True))

    def digests(self) -> dict[int, bytes]:
        """Digest of the turns of every boundary node, along the paths of the first and the last row."""
        at = {(int(d), int(r)): i for i, d, r in zip(np.flatnonzero(self.open), self.depth[self.open], self.row[self.open], strict=True)}
        starts = {}
        for d, r in at:
            starts.setdefault(d, []).append(r)
        out: dict[int, bytes] = {}
        for row in {0, len(self.conv) - 1}:
            digest = hashlib.blake2b(digest_size=16)
            for d in range(self.size[row] + 1):
                if d:
                    digest.update(self.ids[:, row, d - 1].tobytes())
                out[at[d, max(r for r in starts[d] if r <= row)]] = digest.copy().digest()
        return out

    def rows(self, name: str) -> pa.RecordBatch:
        digest = self.digests()
        kept = np.flatnonzero(self.valid)
        ends, sha, first = [], [], []
        for i in kept:
            mine = self.conv[self.row[i] : self.row[i] + self.ended[i]]
            text = ",".join(map(str, mine))
            ends.append(text if self.open[i] and len(mine) else None)
            first.append(int(mine[0]) if self.open[i] and len(mine) else None)
            sha.append(None if self.open[i] else hashlib.sha256(text.encode()).hexdigest())
        up = self.parent[kept]
        rooted = self.depth[kept] == 0
        far = self.open[up] & ~rooted  # the parent is a boundary node
        columns = [pa.array(x[kept], pa.int64()) for x in (self.lowest, self.depth)]
        columns.append(pa.array(self.lowest[up], pa.int64(), mask=far | rooted))
        columns += [pa.array(x[kept], pa.int64()) for x in (self.count, self.children, self.leaves, self.saved)]
        columns += [pa.array(sha, pa.string()), pa.array([digest.get(i) for i in kept], pa.binary())]
        columns += [pa.array([digest[p] if f else None for p, f in zip(up, far, strict=True)], pa.binary()), pa.array([name] * len(kept))]
        columns += [pa.array(self.tokens[kept], pa.int64()), pa.array(ends, pa.string()), pa.array(first, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, _NODE.names)


def _blocks(batches):
    """Matrices of at most BLOCK_CELLS cells from sorted rows; a block ends where a row would make it larger."""
    held, width, rows = [], 0, 0

    def cut():
        conv, sizes, hi, lo, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        return Block(conv, sizes, hi, lo, tokens)

    for b in batches:
        conv, turns = b.column(0).to_numpy(), b.column(1)
        sizes = turns.value_lengths().to_numpy()
        ends = np.append(0, np.cumsum(sizes))
        flat = turns.flatten()
        values = [flat.field(k).to_numpy() for k in ("hi", "lo", "tokens")]
        a = 0
        for i, s in enumerate(sizes):
            if rows and (rows + 1) * max(width, s, 1) > BLOCK_CELLS:
                if i > a:
                    held.append((conv[a:i], sizes[a:i], *(v[ends[a] : ends[i]] for v in values)))
                yield cut()
                held, width, rows, a = [], 0, 0, i
            rows, width = rows + 1, max(width, s)
        if a < len(sizes):
            held.append((conv[a:], sizes[a:], *(v[ends[a] :] for v in values)))
    if held:
        yield cut()


def block_nodes(turns: DataFrame) -> DataFrame:
    """Whole nodes and parts of boundary nodes of all blocks."""
    bounded_batches(turns.sparkSession)
    ids = F.transform("turns", lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo")))
    ranged = turns.withColumn("ids", ids).repartitionByRange(F.slice("ids", 1, RANGE_TURNS), "conv_id").sortWithinPartitions("ids", "conv_id")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, block in enumerate(_blocks(batches)):
            yield block.rows(f"{part}-{k}")

    return ranged.select("conv_id", "turns").mapInArrow(run, _NODE)


def digest_of_ends(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of boundary nodes: their pieces, which are sorted and apart, run through one digest piece by piece."""
    pieces = parts.where("ends is not null").select("node", "first_end", "ends")
    dealt = pieces.repartition("node").sortWithinPartitions("node", "first_end")

    def run(batches):
        node, digest, done = None, None, []
        for b in batches:
            for key, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["node", "ends_sha256"])
            done = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    return dealt.select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def merge_boundaries(parts: DataFrame) -> DataFrame:
    """Boundary nodes from their parts: sums over blocks, then over subtrees by pointers of doubling reach."""
    total = parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("tokens").alias("tokens"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    below = total.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    total = total.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    total = cut_lineage(
        total.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("tokens")).drop("more", "tokens")
    )
    deepest, reach = total.agg(F.max("depth")).first()[0] or 0, 1
    sums = total.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    while reach <= deepest:
        # up: the node ``reach`` above; sums: over descendants nearer than ``reach``
        got = sums.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        over = sums.select(F.col("node").alias("up"), F.col("up").alias("next"))
        added = sums.join(got, "node", "left").join(over, "up", "left")
        sums = cut_lineage(added.select("node", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")))
        reach *= 2
    return total.drop("n_leaves", "saved_tokens").join(sums.drop("up"), "node")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns) rows, see ``turns_of``; conv_id is unique.

    One row per distinct beginning of a conversation, the empty one included:
    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256 (digest of the ids of the
    members that end there, ascending). No rows without conversations. Turns
    are told apart by 128 bits of hashes.
    """
    nodes = cut_lineage(block_nodes(turns))
    parts = nodes.where("node is not null")
    merged = cut_lineage(merge_boundaries(parts))
    named = merged.select("node", F.col("conv_id").alias("parent_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # nodes below a boundary node learn its id within their block, so that the root's many children stay dealt
    whole = nodes.where("node is null")
    of_block = parts.select("block", "node").join(named, "node").select("block", F.col("node").alias("parent"), "parent_id")
    near = whole.where("parent is null").select(names)
    far = whole.where("parent is not null").join(of_block, ["block", "parent"]).withColumn("parent_conv_id", F.col("parent_id")).select(names)
    none = hashlib.sha256(b"").hexdigest()
    edge = merged.join(named.withColumnRenamed("node", "parent"), "parent", "left").join(digest_of_ends(parts), "node", "left")
    edge = edge.withColumn("parent_conv_id", F.col("parent_id")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))).select(names)
    return near.unionByName(far).unionByName(edge)


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(rebuild(turns_of(conversations)))


def trie_query(spark, sf_dir: str) -> DataFrame:
    return trie_report(table(spark, sf_dir, "conversations"))


def trie_sql() -> str:
    shift = "list_reduce(range(8), lambda b, k: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END, xor(c, ascii(x)::BIGINT))"
    return f"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, (xor(list_reduce(string_split(conv_id::VARCHAR, ''), lambda c, x: {shift}, 4294967295::BIGINT), 4294967295) % 6)::INT AS h FROM own),
built AS (
  SELECT o.conv_id, list_concat(coalesce(p.turns, [])[1:h], o.turns[h + 1:]) AS turns
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own p ON p.conv_id = o.conv_id - o.conv_id % 100),
members AS (SELECT conv_id AS c, d, turns[1:d] AS path, len(turns) AS n FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(length(path[d].t), 0) AS tokens,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM members GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sums AS (
  SELECT path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * tokens)::BIGINT AS saved_tokens
  FROM (SELECT path[1:k] AS path, n_children, n_convs, tokens FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_)) GROUP BY path)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_ f JOIN sums s USING (path) LEFT JOIN nodes p ON f.d > 0 AND p.path = f.path[1:f.d - 1]"""
