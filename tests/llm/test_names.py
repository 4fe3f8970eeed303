"""Extra columns whose names clash with an operator's own, in any case, for every operator and the pipeline."""

import pytest
from pyspark.sql import functions as F

from docuseam.llm import bloom_search, conversation_trie, decontaminate, html_text, language_id, licenses, quality, secrets, sentencepiece_codec, simhash_dedup, topk_search, toxicity, url_filter

NAMES = ["IDS", "Fingerprint", "Component_ID", "_tag", "SPANS", "Score", "Rank", "filled", "leaf", "Block", "Purity", "Node", "Turns", "_secret_lower", "_Secret_Postings", "text_", "_words", "Labels", "Secrets", "Y", "H", "N", "Term", "row", "Item"]


def clashing(df):
    have = {c.lower() for c in df.columns}
    for n in NAMES:
        if n.lower() not in have:
            df = df.withColumn(n, F.lit("own"))
    return df


@pytest.fixture(scope="module")
def docs(spark, sf):
    return clashing(spark.read.parquet(f"{sf}/documents.parquet").limit(40))


def unique(df):
    low = [c.lower() for c in df.columns]
    assert len(set(low)) == len(low), low
    return df


def test_frames_have_no_ambiguous_column(spark, sf, docs):
    n = docs.count()
    for out in (secrets.find_secrets(docs), secrets.redact(docs), licenses.scan_licenses(docs), simhash_dedup.add_fingerprints(docs), sentencepiece_codec.encode_texts(docs), toxicity.score_toxicity(docs, toxicity.train([])), quality.score_quality(docs, quality.fit([])), language_id.identify_languages(docs, language_id.fit([]))):
        assert unique(out).count() == n
    assert simhash_dedup.keep_one_per_group(docs).columns == docs.columns
    pages = clashing(spark.read.parquet(f"{sf}/pages.parquet")).withColumn("Text", F.lit("own"))
    assert unique(url_filter.judge_urls(pages)).count() == unique(html_text.extract_main_text(pages)).count() == pages.count()
    items = clashing(spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert decontaminate.drop_leaks(docs, items).columns == docs.columns
    assert bloom_search.ranked_search(docs, items, k=1).count() > 0
    assert unique(topk_search.search(docs, docs.where("doc_id % 20 = 0"), k=2)).count() > 0
    talks = clashing(spark.read.parquet(f"{sf}/conversations.parquet"))
    assert conversation_trie.trie_report(talks).count() > 0


def test_pipeline_stages_with_clashing_names(spark, sf, docs):
    import corpus_pipeline

    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns
    last = unique(corpus_pipeline.STAGES[-1][1](spark, kept, sf))
    assert last.count() == kept.count() > 0 and "ids" in last.columns


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (2, ""), (None, "some words of a text")]])
def test_pipeline_of_nulls_and_of_nothing(spark, sf, rows):
    import corpus_pipeline

    kept = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
    assert kept.count() <= len(rows)
