"""Near copies: whole recall from the similarity on, long lists, and which row stays."""

import itertools
import random

import pytest

from docuseam.llm import common, simhash_dedup

WORDS = "doc_id long, text string"


def word(rng):
    return "".join(rng.choices("abcdefghij", k=8))


def copy_at(rng, words, similarity):
    """The words with a new tail, so that their five-word shingles have this similarity."""
    shingles = len(words) - 4
    cut = int(shingles * (1 - similarity) / (1 + similarity))
    return words[: len(words) - cut] + [word(rng) for _ in range(cut)]


def groups(spark, rows):
    return {r.doc_id: r.component_id for r in simhash_dedup.near_copy_groups(spark.createDataFrame(rows, WORDS)).collect()}


def test_every_pair_from_the_similarity_on(spark):
    rng, rows = random.Random(3), []
    for similarity in (0.8, 0.82, 0.85, 0.88, 0.9, 0.95, 0.78, 0.7):
        for _ in range(15):
            base = [word(rng) for _ in range(rng.randrange(60, 400))]
            for words in (base, copy_at(rng, base, similarity)):
                rows.append((len(rows), " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    got = groups(spark, rows)
    assert all((got[d + 1] == d) == alike(sets[d], sets[d + 1]) for d in range(0, len(rows), 2))
    assert all(got[d] == d for d in range(0, len(rows), 2))


def test_pairs_in_long_lists(spark):
    """Pairs alike at 0.9 that share most of their text with 60 sets that are not alike; leaders seldom are among them."""
    rng, rows, want = random.Random(8), [], {}
    common = [word(rng) for _ in range(200)]
    for k in range(70):
        base = common + [word(rng) for _ in range(80)]
        for words in (base, copy_at(rng, base, 0.9)) if k < 20 else (base,):
            want[len(rows)] = want.get(len(rows) - 1, len(rows)) if words is not base else len(rows)
            rows.append((len(rows), " ".join(words)))
    assert groups(spark, rows) == want


def test_copies_of_one_original_do_not_meet_in_pairs(spark, monkeypatch):
    """Copies with edits of their own are alike to their original at 0.81, but not to each other."""
    rng, seen = random.Random(5), []
    base = [word(rng) for _ in range(150)]
    rows = [(0, " ".join(base))]
    for d in range(1, 150):
        copy = list(base)
        for at in rng.sample(range(5, 140), 3):
            copy[at] = word(rng)
        rows.append((d, " ".join(copy)))
    rare = simhash_dedup._rare_pairs

    def counted(*given):
        found = rare(*given)
        seen.append(found.distinct().count())
        return found

    monkeypatch.setattr(simhash_dedup, "_rare_pairs", counted)
    assert set(groups(spark, rows).values()) == {0}
    assert sum(seen) < len(rows)


def test_rows_stay_by_group(spark):
    rng = random.Random(4)
    one, two, three, four = (" ".join(word(rng) for _ in range(50)) for _ in range(4))
    rows = [(1, one), (1, two), (2, two), (None, three), (None, four), (None, four), (None, one), (3, one), (1, one)]
    kept = simhash_dedup.keep_one_per_group(spark.createDataFrame(rows, WORDS)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, one), (1, two), (0, three), (0, four)])


def test_links_of_the_table(spark, sf):
    """Every link of the documents table, and no other, against the similarity of all pairs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: simhash_dedup.shingle_set(r.text) for r in docs.collect()}
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        if simhash_dedup.alike(sets[a], sets[b], 0.8):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id: r.component_id for r in simhash_dedup.near_copy_groups(docs).collect()} == {d: find(d) for d in sets}


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = spark.range(400).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS k")
    few = spark.range(300).selectExpr("id AS k", "id * 2 AS twice")
    assert common.hot_keys(rows, "k") == [7]
    want = sorted((r.id, r.twice) for r in rows.join(few, "k").collect())
    assert sorted((r.id, r.twice) for r in common.join_hot(rows, few, "k").collect()) == want


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        common.connected_components(chain, rounds=1)
    assert {r.root for r in common.connected_components(chain).collect()} == {0}
