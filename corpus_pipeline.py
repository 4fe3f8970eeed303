"""The training-data pipeline: documents through five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docuseam.llm.common import drop_folder, ensure_checkpoint_dir, table
from docuseam.llm.decontaminate import drop_leaks
from docuseam.llm.quality import fit_quality, keep_good
from docuseam.llm.secrets import redact
from docuseam.llm.sentencepiece_codec import encode_texts
from docuseam.llm.simhash_dedup import keep_one_per_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the neighbours' vote rejects."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id.

    As a stage on word shingles it takes five words and a similarity of 0.8.
    """
    return keep_one_per_group(docs, shingle_words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by the name of its kind."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts; the ids take the place of the text."""
    return encode_texts(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: The first three stages are a fitted classifier, components of a graph and
#: edit distances, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with Parquet in the shared checkpoint folder between them.

    What a stage has read is deleted once its own result is written.
    """
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if read is not None:
            drop_folder(spark, read)
        read = out
    return docs
