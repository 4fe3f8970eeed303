"""Nulls, empty and long texts, repeated rows, extra columns and empty tables for every operator."""

import glob
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docuseam.llm import decontaminate, html_text, licenses, quality, secrets, sentencepiece_codec, simhash_dedup, topk_search, toxicity, url_filter

LONG = "word " * 50_000
SECRET = 'password = "abcdefgh12345678"'


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "plain text of some words", "x"), (1, "plain text of some words", "x"), (2, None, "y"), (3, "", None), (4, "   \n\t", "z"), (None, "no id here", "w"), (5, LONG, "l"), (6, f"see {SECRET} now", "s")]
    # names that operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("spans", F.lit(1)).withColumn("fingerprint", F.lit(2)).withColumn("leaks", F.lit(3)).withColumn("_secret_lower", F.lit(4))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


ALL = [1, 1, 2, 3, 4, 5, 6, None]


def test_simhash(docs, empty):
    got = {r.doc_id: r for r in simhash_dedup.simhash_groups(docs).collect()}
    assert got[2].fingerprint == got[3].fingerprint == got[4].fingerprint == "0" * 16
    assert got[2].component_id == got[3].component_id == got[4].component_id == 2
    assert simhash_dedup.simhash_groups(docs).count() == 8 and simhash_dedup.simhash_groups(empty).count() == 0
    kept = simhash_dedup.keep_one_per_group(docs)
    assert ids(kept) == [1, 2, 5, 6, None] and kept.columns == docs.columns


def test_secrets(docs, empty):
    found = secrets.find_secrets(docs)
    assert {r.doc_id: len(r.secrets) for r in found.collect()}[6] == 1 and found.columns == [*docs.columns, "secrets"]
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean[6] == "see [assign]\" now" and clean[2] is None and clean[5] == LONG
    assert ids(secrets.redact(docs)) == ALL and secrets.redact(empty).count() == 0 and secrets.redact(docs).columns == docs.columns


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [got[k].n_words for k in (1, 2, 3, 4, 5)] == [5, 0, 0, 0, 50_000] and got[2].base == []
    assert licenses.scan_licenses(empty).count() == 0


def test_tokens(docs, empty):
    rows = sentencepiece_codec.encode_texts(docs, check="exact")
    assert ids(rows) == ALL and all(r.exact for r in rows.collect())
    back = sentencepiece_codec.decode_texts(rows)
    assert {r.doc_id: r.text for r in back.collect()}[6] == f"see {SECRET} now"
    assert sentencepiece_codec.encode_texts(empty).count() == 0


def test_models(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model)
    assert ids(rows) == ALL and {r.score for r in rows.collect()} == {0.5}
    assert quality.score_quality(empty, model).count() == 0 and ids(quality.keep_good(docs, model)) == ALL
    net = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, net)
    assert ids(rows) == ALL and {r.score for r in rows.collect()} == {0.5}
    assert toxicity.score_toxicity(empty, net).count() == 0


def test_fitted_models(spark, docs, empty):
    """Nulls, empty and very long texts, repeated labels and clashing names under models that were fitted."""
    texts = [("Good plain prose of a calm kind, line by line.", 1, 0), ("$$$ ### BUY BUY BUY ### $$$ 000", 0, 0), ("you vile hateful fool and worse", 1, 1)]
    rows = [(i, *texts[i % 3]) for i in range(60)]
    known = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(0, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(0, 1, None), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    clashing = docs.withColumnRenamed("score", "Score")
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        model = fit(known, labels)
        got = score(clashing, model)
        assert ids(got) == ALL and [c.lower() for c in got.columns].count("score") == 1
        by = {}
        for r in got.collect():
            assert 0 <= r.score <= 1
            by.setdefault(r.doc_id, set()).add(r.score)
        assert all(len(v) == 1 for v in by.values()) and by[2] == by[3] == by[4] and len({*by[1], *by[5]}) == 2
        assert score(empty, model).count() == 0
        ends = {r.doc_id: r.score for r in score(known.where("text IS NOT NULL"), model).collect()}
        right = [r for r in rows if (ends[r[0]] >= 0.5) == bool(r[2] if fit is quality.fit_quality else r[3])]
        assert len(right) == len(rows)


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(7, "plain text of some words"), (8, None), (9, ""), (10, "not in any of the documents at all")], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {1: [7], 2: [], 3: [], 4: [], 5: [], 6: [], None: []}
    assert ids(decontaminate.drop_leaks(docs, items)) == [2, 3, 4, 5, 6, None]
    assert decontaminate.find_leaks(empty, items).count() == 0 and ids(decontaminate.drop_leaks(docs, items.limit(0))) == ALL


def test_search(docs, empty):
    got = topk_search.search(docs, docs, 3).collect()
    assert {r.query_id for r in got} == {1, 5, 6} and max(r["rank"] for r in got) <= 3
    assert topk_search.search(empty, empty).count() == 0 and topk_search.search(docs, empty).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {(r.query_id, r.doc_id) for r in topk_search.search(named, named, 1).collect()} == {("d1", "d1"), ("d5", "d5"), ("d6", "d6")}


def test_search_passes_over_blocks():
    """Blocks whose maxima stay under the threshold are not scored, and the result is that of scoring all."""
    rng = np.random.default_rng(2)
    topics = [rng.integers(0, 300, 40) + 1000 * t for t in range(1, 9)]  # and ten terms of little weight that any document may hold
    terms = [np.unique(np.append(rng.choice(topics[i % 8], 25), rng.integers(9990, 10000, 5))) for i in range(2000)]
    freqs = [rng.integers(1, 4, len(t)).astype(np.int32) for t in terms]
    ids, parts = topk_search._shard_row(list(range(2000)), [int(f.sum()) for f in freqs], terms, freqs)
    shard = topk_search.Shard(*parts, 40.0)
    every = 0
    for q in range(0, 2000, 97):
        weight = np.where(terms[q] < 9990, 1.0, 0.01)
        at, score = shard.top(terms[q], weight, 10)
        scores = []
        for d, (t, f) in enumerate(zip(terms, freqs, strict=True)):
            hit = np.isin(t, terms[q])
            tf, w = f[hit], np.where(t[hit] < 9990, 1.0, 0.01)
            every += len(tf)
            scores.append((-round(float((w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * f.sum() / 40.0))).sum()), 6), d))
        assert [(-s, d) for s, d in sorted(scores)[:10]] == [(float(s), ids[i]) for i, s in zip(at, score, strict=True)]
    assert shard.scored < every


def test_search_takes_many_queries_together():
    """Queries that a shard answers together get what scoring every document gives: terms in a few documents, in most and in none, with and without a threshold, and more results than a block holds."""
    rng = np.random.default_rng(5)
    terms = [np.unique(np.append(rng.integers(0, 4000, 20), rng.integers(5000, 5030, 12))) for _ in range(700)] + [np.zeros(0, np.int64)]
    freqs = [rng.integers(1, 5, len(t)).astype(np.int32) for t in terms]
    ids, parts = topk_search._shard_row(list(range(701)), [int(f.sum()) for f in freqs], terms, freqs)
    shard = topk_search.Shard(*parts, 60.0)
    assert 0 < len(shard.matrix) < len(shard.terms)
    asked = [terms[q] for q in range(0, 700, 70)] + [np.array([9999]), np.array([5001]), np.zeros(0, np.int64)]
    weights = [rng.random(len(t)) + 0.1 for t in asked]
    owner = np.repeat(np.arange(len(asked)), [len(t) for t in asked])
    for k, least in ((10, 0.0), (10, 6.0), (200, 0.0)):
        got = {}
        for q, rank, at, score in zip(*shard.top_all(owner, shard.find(np.concatenate(asked)), np.concatenate(weights), len(asked), k, np.full(len(asked), least)), strict=True):
            got.setdefault(int(q), []).append((int(rank), ids[at], float(score)))
        for q, (t, w) in enumerate(zip(asked, weights, strict=True)):
            gain = dict(zip(t.tolist(), w.tolist(), strict=True))
            scores = []
            for d, (own, f) in enumerate(zip(terms, freqs, strict=True)):
                s = round(sum(gain[x] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * int(f.sum()) / 60.0)) for x, n in zip(own.tolist(), f.tolist(), strict=True) if x in gain), 6)
                scores += [(-s, d)] if s > 0 and s >= least else []
            want = sorted(scores)[:k]
            assert [(r, d) for r, d, _ in got.get(q, [])] == [(i, d) for i, (_, d) in enumerate(want)]
            assert np.allclose([s for _, _, s in got.get(q, [])], [-s for s, _ in want], atol=2e-6)


def test_search_multiplies_what_is_frequent_among_neighbours():
    """A term of a few alike documents is frequent in their block only, and scored there with the block's matrix instead of its list; results are those of scoring every document."""
    rng = np.random.default_rng(7)
    terms = [np.append(np.sort(rng.choice(35, 30, replace=False)), 99) + 100 * (i % 64) for i in range(2048)]
    freqs = [np.where(t % 100 == 99, 9, rng.integers(1, 4, len(t))).astype(np.int32) for t in terms]
    ids, parts = topk_search._shard_row(list(range(2048)), [int(f.sum()) for f in freqs], terms, freqs)
    shard = topk_search.Shard(*parts, 60.0)
    assert shard.size.sum() < 0.2 * sum(map(len, terms))
    asked = [np.append(terms[q], terms[q + 1][:5]) for q in range(0, 2000, 190)]  # of one group of documents and a little of another
    weights = [rng.random(len(t)) + 0.1 for t in asked]
    found = shard.top_all(np.repeat(np.arange(len(asked)), [len(t) for t in asked]), shard.find(np.concatenate(asked)), np.concatenate(weights), len(asked), 10, np.zeros(len(asked)))
    for q, (t, w) in enumerate(zip(asked, weights, strict=True)):
        gain, scores = dict(zip(t.tolist(), w.tolist(), strict=True)), []
        for d, (own, f) in enumerate(zip(terms, freqs, strict=True)):
            scores.append((-round(sum(gain.get(x, 0) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * int(f.sum()) / 60.0)) for x, n in zip(own.tolist(), f.tolist(), strict=True)), 6), d))
        assert [(ids[at], -float(s)) for own, _, at, s in zip(*found, strict=True) if own == q] == [(d, s) for s, d in sorted(scores)[:10]]
    assert len(found[0]) == 10 * len(asked)


def test_search_order_of_queries():
    """Queries that share their most common term stand together, and every term keeps its query."""
    ids, term = np.array([0, 1, 2, 0, 1, 2, 3, 3]), np.array([5, 6, 5, 1, 2, 3, 6, 4])
    line, at = topk_search._alike(ids, term, 4)
    assert sorted(line.tolist()) == [0, 1, 2, 3] and line[at].tolist() == ids.tolist()
    assert {*line[:2].tolist()} in ({0, 2}, {1, 3})
    assert len(topk_search._alike(ids[:0], term[:0], 0)[0]) == 0


def test_search_scores_copies_once(spark):
    """Documents and queries that are copies are scored once, and all of them are ranked as if each had been."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(3, 30))) for _ in range(40)]
    rows = [(i * 1010 + j, t if i % 2 else " ".join(reversed(t.split()))) for i in range(6) for j, t in enumerate(texts)]  # six shards, every second one asks for other documents
    rows += [(None, texts[0]), (None, None), (9000, ""), (9001, "W5, w5 \u0130x"), (9001, texts[3])]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string")
    asked = docs.where("doc_id % 20 = 0").union(spark.createDataFrame([(9500, texts[7]), (9500, "w1 w1"), (9501, "none")], docs.schema))
    k, every = 5, [topk_search._WORD.findall((t or "").lower()) for _, t in rows]
    n, mean = sum(1 for w in every if w), sum(map(len, every)) / sum(1 for w in every if w)
    df = {t: sum(t in w for w in every) for t in {t for w in every for t in w}}
    asks = {}
    for r in asked.collect():
        asks.setdefault(r.doc_id, []).extend(topk_search._WORD.findall((r.text or "").lower()))
    want = {}
    for q, words in asks.items():
        found = []
        for (d, _), w in zip(rows, every, strict=True):
            s = sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in words if t in w)
            found += [(-round(float(s), 6), -1 if d is None else d)] if s > 0 else []
        want[q] = sorted(found)[:k]
    before = set(glob.glob(f"{(spark.sparkContext.getCheckpointDir() or '').removeprefix('file:')}/top-k-*"))
    got = {}
    for r in topk_search.search(docs, asked, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, -1 if r.doc_id is None else r.doc_id))
    assert {q: [d for _, _, d in sorted(x)] for q, x in got.items()} == {q: [d for _, d in x] for q, x in want.items() if x}
    assert all(np.allclose([s for _, s, _ in sorted(x)], [s for s, _ in want[q]], atol=2e-6) for q, x in got.items())
    made = set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/top-k-*")) - before
    assert sum(spark.read.parquet(f"{x}/*").count() for x in made) <= 5 * k * 3  # of five different queries


def test_search_waves():
    """Every shard is in one wave, and the first wave, whose k-th best scores all others start with, is small."""
    for n in (0, 1, 2, 3, 8, 32, 385):
        waves = topk_search._waves(list(range(n)), 6)
        assert sorted(x for w in waves for x in w) == list(range(n)) and all(waves)
        assert n < 4 or len(waves[0]) <= max(1, min(6, n / 3))


def test_search_starts_with_the_threshold_of_earlier_waves():
    """A shard passes on only what reaches the k-th best score that its task was given."""
    rng = np.random.default_rng(3)
    terms = [np.unique(rng.integers(0, 500, 30)) for _ in range(900)]
    ids, parts = topk_search._shard_row(list(range(900)), [len(t) for t in terms], terms, [np.ones(len(t), np.int32) for t in terms])
    row = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([ids]), *[pa.array([x], pa.binary()) for x in parts]], ["shard", "ids", *topk_search._PARTS])
    asked = terms[:50]
    asks = SimpleNamespace(value=(pa.array(range(50)), np.cumsum([len(t) for t in asked]), np.arange(500), np.concatenate(asked).astype(np.int32), np.ones(sum(map(len, asked)))))
    run = lambda least: pa.Table.from_batches(topk_search._scan(asks, SimpleNamespace(value=(least, {7: np.ones(900, np.int32)})), 28.0, 10)([row])).to_pylist()
    whole = run(np.zeros(50))
    assert len(whole) == 500
    least = np.array([sorted(r["score"] for r in whole if r["line"] == q)[-3] for q in range(50)])
    assert run(least) == [r for r in whole if r["score"] >= least[r["line"]]]


def test_search_words():
    """Words are those of the pattern on lower-cased text, equal ones alike and others apart, long texts included."""
    texts = ["Stra\u00dfe \u00c4\u00d6_9 \u0391\u03a3 \u03a3", "", None, "\u0130stanbul \ufb01 \U0001d7d8x \ud800 a\u0301b x_ " * 3, "\u65e5\u672c\u8a9e " * 10, "a" * 100 + " " + "a" * 101, "\n\n", "x", "one two " * 150_000]
    found, told = topk_search.Words().hashes(texts), {}
    for text, bits in zip(texts, found, strict=True):
        for word, b in zip(topk_search._WORD.findall((text or "").lower()), bits.tolist(), strict=True):
            assert told.setdefault(word, b) == b >= 0
    assert len(set(told.values())) == len(told)


def test_pages(spark):
    rows = [(1, "http://A.example.com/de/1?x#y", "<p>Hi</p>", 1), (1, "http://A.example.com/de/1?x#y", "<p>Hi</p>", 1), (2, None, None, 2), (3, "no scheme", "", 3), (4, "x://h.net", "<nav>menu</nav>", 4), (5, "x://h.net/", "<p>" + LONG, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/de/1", "example.com/de/", "block")
    assert (got[2].host, got[2].path, got[2].verdict) == ("", "", "allow") and got[4].rule is None and got[5].rule == "net/"
    assert url_filter.judge_urls(pages).count() == 6 and url_filter.judge_urls(pages.limit(0)).count() == 0
    text = {r.page_id: r.text for r in html_text.extract_main_text(pages).collect()}
    assert text[1] == "Hi" and text[2] == "" and text[4] == "" and len(text[5]) == len(LONG.strip())
    assert html_text.extract_main_text(pages.limit(0)).count() == 0
