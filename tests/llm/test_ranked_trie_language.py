"""Ranked lexical search, prefix trie and language identification against SQL, brute force and held-out labels."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docuseam.llm import bloom_search, conversation_trie, language_id, queries
from docuseam.llm.common import crc_mod


def rows_of(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name,tables", [("op11_ranked_search", ["documents", "benchmark"]), ("op12_prefix_trie", ["conversations"])])
def test_matches_sql(spark, sf, name, tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    assert rows_of(queries.QUERIES[name](spark, sf), want.columns) == sorted(want.fetchall(), key=repr)


# --- ranked search -----------------------------------------------------------


def sql_of(tables: dict, sql: str):
    c = duckdb.connect()
    for name, (columns, rows) in tables.items():
        c.sql(f"CREATE TABLE {name} ({columns})")
        if rows:
            c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    got = c.sql(sql)
    return got.columns, sorted(got.fetchall(), key=repr)


WORDS = ["alpha", "beta", "Gamma", "delta9", "ünï", "x", "the", "漢字", "rare"]


def some_texts(rng, n):
    return [None if rng.random() < 0.05 else "" if rng.random() < 0.05 else rng.choice([" ", "\n", "-", "."]).join(rng.choices(WORDS, range(len(WORDS), 0, -1), k=rng.choice([1, 3, 9, 80]))) for _ in range(n)]


@pytest.mark.parametrize("shard", [3, 4096])
def test_ranked_search_of_nulls_ties_and_repeats(spark, monkeypatch, shard):
    monkeypatch.setattr(bloom_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(bloom_search, "BLOCK_CHARS", 300)
    rng = random.Random(4)
    docs = [(i // 2 if i % 7 == 0 else i, t) for i, t in enumerate(some_texts(rng, 300))] + [(None, "alpha rare rare"), (None, "alpha rare rare"), (900, "rare " * 4000)]
    items = [(i % 20, t) for i, t in enumerate(some_texts(rng, 40))] + [(None, "rare alpha alpha"), (77, "unheard-of"), (78, "rare alpha alpha")]
    frames = [spark.createDataFrame(rows, f"{key} long, text string").withColumn("SCORE", F.lit("own")).withColumn("row", F.lit(1)) for key, rows in (("doc_id", docs), ("item_id", items))]
    got = bloom_search.ranked_search(frames[0].repartition(3), frames[1])
    names, want = sql_of({"documents": ("doc_id BIGINT, text VARCHAR", docs), "benchmark": ("item_id BIGINT, text VARCHAR", items)}, bloom_search.ranked_report_sql())
    assert rows_of(got, names) == want


def test_ranked_search_keeps_text_ids_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert [tuple(r) for r in bloom_search.ranked_search(docs, items, k=3).orderBy("rank").select("item_id", "rank", "doc_id").collect()] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]
    assert bloom_search.ranked_search(docs.limit(0), items).count() == 0
    assert bloom_search.ranked_search(docs, items.limit(0)).count() == 0


def test_bounds_hold_and_exclude():
    rng = random.Random(7)
    opened, vocab = bloom_search.OpenShard(), [f"w{i}" for i in range(3000)]
    from collections import Counter

    texts = [[vocab[min(2999, int(rng.expovariate(0.004)))] for _ in range(rng.choice([20, 60, 120]))] for _ in range(800)]
    for i, t in enumerate(texts):
        opened.add(i, len(t), Counter(w.encode() for w in t))
    ids, n, n_slices, slices, words, df, term, tf, sizes = opened.row()
    import pyarrow as pa

    shard = bloom_search.Shard(n, n_slices, slices, pa.array(words, pa.binary()).cast(pa.string()), term, tf, sizes, 800, sum(map(len, texts)))
    items = bloom_search.Items([" ".join(rng.sample(vocab[:900], 12)).encode() for _ in range(20)])
    items.weigh({w.decode(): int(x) for w, x in zip(words, df, strict=True)}, 800)
    at = {w: i for i, w in enumerate(words)}
    places = np.array([at.get(t, -1) for t in items.terms])
    bounds = shard.bounds(items.hashes, items.asked)
    for i, (mine, weight) in enumerate(items.asked):
        known = places[mine] >= 0
        assert (shard.scores(np.arange(800), places[mine][known], weight[known]) <= bounds[i]).all()
    best = bloom_search.Best(20, 10)
    best.look(shard, ids, items)
    assert best.rescored < 0.3 * 20 * 800


# --- prefix trie -------------------------------------------------------------


def brute_trie(rows):
    """Nodes of (conv_id, [(role, text)]) rows."""
    members: dict = {}
    for c, turns in rows:
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, len(turns)))
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}

    def under(p):
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        deeper = [under(q) for q in kids[p]]
        return (sum(x[0] for x in deeper) or 1) if kids[p] else 1, own + sum(x[1] for x in deeper)

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c, n in sorted(m) if n == len(p))
        out.append((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), len(kids[p]), *under(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def random_conversations(rng, n):
    out = []
    for c in rng.sample(range(-50, 4 * n), n):
        kind = rng.random()
        turns = [("user", "hot ü"), ("assistant", "漢字 answer")] if kind < 0.35 else [(rng.choice("ua"), rng.choice(["", "x", "yy", "zzz"])) for _ in range(rng.choice([0, 1, 2, 3, 5, 30]))]
        out.append((c, turns))
    return out


@pytest.mark.parametrize("cells", [1, 24, 1 << 20])
def test_trie_of_blocks_of_any_size(spark, monkeypatch, cells):
    monkeypatch.setattr(conversation_trie, "BLOCK_CELLS", cells)
    convs = random_conversations(random.Random(cells), 120)
    rows = [(c, k, r, t) for c, turns in convs for k, (r, t) in enumerate(turns)]
    turns = conversation_trie.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = conversation_trie.prefix_trie(turns)
    assert rows_of(got, NAMES) == brute_trie([c for c in convs if c[1]])


def test_trie_of_rebuilt_conversations(spark, monkeypatch):
    """Against the rule read plainly, with nulls in all columns, repeated rows, clashing columns and absent first conversations."""
    monkeypatch.setattr(conversation_trie, "BLOCK_CELLS", 40)
    rng = random.Random(11)
    rows = [(c, None if k == 2 else k, rng.choice(["user", None]), rng.choice(["a", "bb", "", None])) for c in [*range(-3, 40), *range(100, 130), *range(203, 220)] for k in range(rng.choice([1, 2, 4, 7]))]
    rows += rows[:5] + [(None, 0, "user", "no conversation")]
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - int(np.fmod(c, 100))
        built.append((c, own.get(first, [])[:h] + turns[h:]))
    assert any(not t for _, t in built)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("TURNS", F.lit(1)).withColumn("node", F.lit("own"))
    assert rows_of(conversation_trie.trie_report(df), NAMES) == brute_trie(built)
    assert conversation_trie.trie_report(df.limit(0)).count() == 0


# --- language identification --------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and 0.2 < len(held) / len(got) < 0.3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    for lang in {r.lang for r in held}:
        mine = [r for r in held if r.lang == lang]
        assert sum(r.lang_pred == lang for r in mine) / len(mine) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, t, g) for i in range(0, 400, 2) for t, g in [(f"the house of the {i} and thing", "en"), (f"das haus der {i} und ding", "de")][i % 4 // 2 :][:1]]
    rows += [(1001, None, "en"), (1003, "", "de"), (1005, "12 34 !?", None), (None, "the thing", "en"), (1007, "the and of " * 60_000, "en"), (1007, "the and of " * 60_000, "en"), (1009, "これは何ですか", None), (1011, "the " + "x" * 500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("SCORE", F.lit("own")).withColumn("id", F.lit(1)).withColumn("words", F.lit(2))
    model = language_id.fit_languages(docs, F.lit(True))
    assert model.names == ["de", "en"]
    out = language_id.identify_languages(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "id", "words", "lang_pred", "score", "rejected"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.rejected))
    assert got[1001] == got[1003] == got[1005] == [("und", 0.0, True)]
    assert got[None][0][0] == "en" and len(got[1007]) == 2 and got[1007][0][0] == "en" and not got[1007][0][2]
    assert got[1009][0][2]  # a script that training never met
    assert sum(len(v) for v in got.values()) == len(rows)
    assert all(g[0] == lang for i, _, lang in rows[:200] for g in got[i])
    nothing = language_id.fit_languages(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify_languages(docs, nothing).collect()} == {"und"}
    assert language_id.identify_languages(docs.limit(0), model).count() == 0


def test_language_sample_is_even_and_bounded(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), "id").alias("text"), F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("lang"))
    got = {r.lang: r["count"] for r in language_id.language_sample(docs, crc_mod(F.col("doc_id"), 4) != 2, 80).groupBy("lang").count().collect()}
    assert sum(got.values()) == 80 and got["rare"] >= 30


def test_subwords_are_those_of_each_word_alone():
    words = ["a", "über", "漢字", "x" * 32, "a"]
    ids, size = language_id.subwords(words)
    parts = np.split(ids, np.cumsum(size)[:-1])
    for w, part in zip(words, parts, strict=True):
        assert sorted(part) == sorted(language_id.subwords([w])[0])
        assert len(part) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in language_id.NGRAMS)
