"""Graded retrieval metrics, groups, diagnosis and comparison.

``run``: query_id, doc_id, rank. ``qrels``: query_id, doc_id, grade, gain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITIVE = 2


def dedup_run(run: DataFrame) -> DataFrame:
    """Null, blank and repeated ids out, first places kept, ranks dense again."""
    rows = run.where(F.col("doc_id").isNotNull() & (F.trim(F.col("doc_id").cast("string")) != ""))
    rows = rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return rows.select("query_id", "doc_id", F.row_number().over(w).alias("rank"))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade"), F.coalesce("gain", F.lit(0.0)).alias("gain"))


def _discounted(gain: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, gain / F.log2(rank + 1)).otherwise(0.0))


def query_metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row per query of the run; metrics without positives or ideal are null."""
    rows = judged(run, qrels)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    positive = F.col("grade") >= POSITIVE
    rows = rows.withColumn("hits", F.sum(positive.cast("int")).over(w))
    ideal = qrels.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), F.asc("doc_id"))))
    ideal = ideal.groupBy("query_id").agg(
        F.count_if(positive).alias("positive_count"), _discounted(F.pow(F.lit(2.0), F.col("gain")) - 1, F.col("rank"), 10).alias("i_exp10"),
        *[_discounted(F.col("gain"), F.col("rank"), k).alias(f"i_lin{k}") for k in (10, 20, 50)],
    )
    at = F.col("rank")
    found = rows.groupBy("query_id").agg(
        F.min(F.when(positive, at)).alias("first_positive_rank"),
        *[F.count_if(positive & (at <= k)).alias(f"in{k}") for k in (5, 10, 20, 50, 100)],
        F.sum(F.when(positive, F.col("hits") / at).otherwise(0.0)).alias("precisions"),
        _discounted(F.pow(F.lit(2.0), F.col("gain")) - 1, at, 10).alias("d_exp10"),
        *[_discounted(F.col("gain"), at, k).alias(f"d_lin{k}") for k in (10, 20, 50)],
        F.count_if((F.col("grade") == 1) & (at <= 20)).alias("weak_top20"),
        F.count("*").alias("returned_count"),
    )
    rows = found.join(ideal, "query_id", "left").withColumn("positive_count", F.coalesce("positive_count", F.lit(0)))
    n = F.nullif(F.col("positive_count"), F.lit(0))
    share = lambda c: F.round(c / n, 6)
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), 6)
    return rows.select(
        "query_id", "positive_count", "first_positive_rank", "weak_top20", "returned_count",
        *[F.when(n.isNotNull(), (F.col(f"in{k}") > 0).cast("double")).alias(f"hit_{k}") for k in (5, 10)],
        *[share(F.col(f"in{k}")).alias(f"recall_{k}") for k in (20, 50, 100)],
        F.when(n.isNotNull(), F.round(F.coalesce(1.0 / F.col("first_positive_rank"), F.lit(0.0)), 6)).alias("mrr"),
        share(F.col("precisions")).alias("map"),
        ratio("d_exp10", "i_exp10").alias("ndcg_10"),
        *[ratio(f"d_lin{k}", f"i_lin{k}").alias(f"expected_ndcg_{k}") for k in (10, 20, 50)],
        (F.col("in20") > 0).alias("top20_has_positive"), (F.col("in100") > 0).alias("top100_has_positive"),
    )


MEANS = ["hit_5", "hit_10", "recall_20", "recall_50", "recall_100", "mrr", "map", "ndcg_10", "expected_ndcg_10", "expected_ndcg_20", "expected_ndcg_50"]


def group_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Means over all queries and by each key, in one pass over grouping sets."""
    sets = ", ".join(["()", *[f"({k})" for k in keys]])
    means = ", ".join(f"round(avg({m}), 6) AS {m}" for m in MEANS)
    names = ", ".join(f"CAST({k} AS STRING) AS {k}" for k in keys)
    by = " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys)
    text = f"SELECT CASE {by} ELSE 'overall' END AS grouped_by, {names}, count(*) AS queries, count_if(positive_count > 0) AS queries_with_positive, {means} FROM {{rows}} GROUP BY GROUPING SETS ({sets})"
    return metrics.sparkSession.sql(text, rows=metrics)


def diagnosis(positives: Column, in100: Column, in20: Column, first: Column, weak: Column, expected20: Column) -> Column:
    low = F.coalesce(expected20 < 0.60, F.lit(False))
    return (
        F.when(positives == 0, "no_positive").when(~in100, "recall_failure").when(~in20, "ranking_failure").when(low & (weak >= 10), "front_pollution")
        .when(first > 10, "late_positive").when(low, "low_alignment").otherwise("good")
    )


def diagnose(metrics: DataFrame) -> DataFrame:
    label = diagnosis(F.col("positive_count"), F.col("top100_has_positive"), F.col("top20_has_positive"), F.col("first_positive_rank"), F.col("weak_top20"), F.col("expected_ndcg_20"))
    bucket = F.when(F.col("label") == "no_positive", "excluded").when(F.col("label") == "recall_failure", "recall").when(F.col("label") == "good", "good").otherwise("ranking")
    return metrics.withColumn("label", label).withColumn("bucket", bucket)


def missed_positives(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    return qrels.where(F.col("grade") >= POSITIVE).join(run.where(F.col("rank") <= k), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "grade")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences b - a of two methods' metrics per query; null where either is."""
    pairs = a.alias("a").join(b.alias("b"), "query_id")
    return pairs.select("query_id", *[F.round(F.col(f"b.{m}") - F.col(f"a.{m}"), 6).alias(f"d_{m}") for m in MEANS], (F.col("b.first_positive_rank") - F.col("a.first_positive_rank")).alias("d_first_positive_rank"), (F.col("b.weak_top20") - F.col("a.weak_top20")).alias("d_weak_top20"))


def score_run(run: DataFrame, qrels: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Macro averages with linear gains; with ``anchors`` (query_id, doc_id) those documents count nowhere.

    NDCG@10 averages over all queries of the run (0 without an ideal), the
    others over queries with positives.
    """
    if anchors is not None:
        run, qrels = (x.join(anchors, ["query_id", "doc_id"], "left_anti") for x in (run, qrels))
        run = run.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    m = query_metrics(run, qrels)
    return m.agg(F.round(F.avg(F.coalesce("expected_ndcg_10", F.lit(0.0))), 6).alias("ndcg_10"), F.round(F.avg("recall_20"), 6).alias("recall_20"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("map"), 6).alias("map"), F.count("*").alias("queries"))


def grade_counts(qrels: DataFrame) -> DataFrame:
    n = F.count("*")
    parts = [F.count_if(F.col("grade") == g).alias(f"grade_{g}_count") for g in (3, 2, 1)]
    ratios = [F.round(F.count_if(F.col("grade") == g) / n, 6).alias(f"grade_{g}_ratio") for g in (3, 2, 1)]
    return qrels.groupBy("query_id").agg(n.alias("sample_total"), *parts, *ratios)


def agreement(pairs: DataFrame) -> DataFrame:
    """Agreement of two judges' grades ``a`` and ``b``: within one, Pearson, kappa, quadratic kappa."""
    base = pairs.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("same"), F.avg((F.abs(F.col("a") - F.col("b")) <= 1).cast("double")).alias("within_one"), F.corr("a", "b").alias("pearson"), F.sum(F.pow(F.col("a") - F.col("b"), F.lit(2.0))).alias("moved"))
    a, b = pairs.groupBy("a").agg(F.count("*").alias("na")), pairs.groupBy("b").agg(F.count("*").alias("nb"))
    chance = a.crossJoin(F.broadcast(b)).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * F.col("nb"))).alias("same_by_chance"), F.sum(F.col("na") * F.col("nb") * F.pow(F.col("a") - F.col("b"), F.lit(2.0))).alias("moved_by_chance"))
    both, n = base.crossJoin(chance), F.col("n").cast("double")
    expected = F.col("same_by_chance") / (n * n)
    return both.select("n", F.round("within_one", 6).alias("within_one"), F.round("pearson", 6).alias("pearson"), F.round((F.col("same") - expected) / F.nullif(1 - expected, F.lit(0.0)), 6).alias("kappa"), F.round(1 - F.col("moved") * n / F.nullif(F.col("moved_by_chance"), F.lit(0.0)), 6).alias("weighted_kappa"))
