"""Weight search: hits are retrieved once and fused anew for every weight set."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ROUTES
from .evaluation import POSITIVE
from .fusion import NUDGE, RRF_K, case_bonus, route_case_ranking

# --- fixed values: presets and grid of route weights --------------------------
PRESETS = {
    "baseline": {},
    "issue_strong": {"bm25_fine_tags": 1.60, "bm25_focus_tags": 1.50, "bm25_facts": 0.70},
    "issue_extreme": {"bm25_fine_tags": 1.80, "bm25_focus_tags": 1.70, "bm25_facts": 0.50},
    "facts_down": {"bm25_facts": 0.50, "bm25_reasoning": 1.20},
    "vector_up": {"vector_raw": 1.20, "vector_focus": 1.30},
    "bm25_up": {"bm25_raw": 1.20, "bm25_focus": 1.10, "bm25_fine_tags": 1.60},
    "negative_up": {"bm25_negative": 1.40, "bm25_facts": 0.70},
    "reasoning_up": {"bm25_reasoning": 1.30, "bm25_focus_tags": 1.50},
}
GRID = {"bm25_fine_tags": (1.2, 1.4, 1.6, 1.8), "bm25_focus_tags": (1.2, 1.4, 1.6, 1.8), "bm25_facts": (0.4, 0.6, 0.8, 1.0), "vector_raw": (0.8, 1.0, 1.2), "vector_focus": (0.9, 1.2)}


def set_rows(grid: dict[str, tuple[float, ...]] = GRID, presets: dict[str, dict[str, float]] = PRESETS) -> list[tuple[int, str, str, float]]:
    """(set_id, name, route, weight): presets, then the grid's product, each over the routes' own weights and each once."""
    own = {n: w for n, _, w, _ in ROUTES}
    made = [*presets.items(), *(("grid", dict(zip(grid, ws, strict=True))) for ws in itertools.product(*grid.values()))]
    sets: dict[tuple, str] = {}
    for name, changed in made:
        sets.setdefault(tuple((own | changed).items()), name)
    return [(i, name, route, float(w)) for i, (weights, name) in enumerate(sets.items()) for route, w in weights]


def weight_sets(spark: SparkSession, grid: dict[str, tuple[float, ...]] = GRID, presets: dict[str, dict[str, float]] = PRESETS) -> DataFrame:
    """The rows of ``set_rows`` as a frame."""
    return spark.createDataFrame(set_rows(grid, presets), "set_id int, name string, route string, weight double")


def refuse(route_ranks: DataFrame, sets: DataFrame) -> DataFrame:
    """Rank of every case under every weight set, from one retrieval.

    ``route_ranks``: query_id, route, weight, doc_id, route_rank. The weight
    sets are a fixed small grid; routes outside of it keep their weight.
    """
    ids = sets.select("set_id").distinct()
    rows = route_ranks.withColumnRenamed("weight", "own").crossJoin(F.broadcast(ids)).join(F.broadcast(sets.select("set_id", "route", "weight")), ["set_id", "route"], "left")
    part = F.coalesce("weight", "own") / (RRF_K + F.col("route_rank"))
    out = rows.groupBy("set_id", "query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("set_id", "query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return out.withColumn("rank", F.row_number().over(w))


def objective(expected20, ndcg10, mrr, recall20, weights=(0.50, 0.15, 0.35, 0.0)):
    return sum((w * F.coalesce(m, F.lit(0.0)) for w, m in zip(weights, (expected20, ndcg10, mrr, recall20), strict=True)), F.lit(0.0))


def best_runs(runs: DataFrame, least_queries: int, n: int = 10) -> DataFrame:
    """The n best valid runs; all runs count if none is valid. ``runs``: set_id, queries, objective."""
    valid = F.col("queries") >= least_queries
    some = runs.agg(F.max(valid).alias("_some"))
    rows = runs.crossJoin(F.broadcast(some)).where(valid | ~F.col("_some")).drop("_some")
    return rows.orderBy(F.desc("objective"), F.asc("set_id")).limit(n)


#: Measures of a weight set that the search is judged by, in the order of ``objective``.
JUDGED = ["expected_ndcg_20", "ndcg_10", "mrr", "recall_20"]


def grid_metrics(hits: DataFrame, qrels: DataFrame, sets: DataFrame, top_k: int = 100, chunk_top_k: int = 3) -> DataFrame:
    """(set_id, query_id, positive_count, measures): every query under every weight set, from one retrieval.

    A query's cases are a matrix of reciprocal route ranks; its product with the
    matrix of weights gives the scores of all sets at once, so no row is copied
    for a set. Scores, ranks and measures are those of ``case_rrf`` and
    ``query_metrics`` over the first ``top_k`` cases. ``sets`` is a small fixed
    grid; routes without a weight there keep their own. A query's candidates
    and judged documents are bounded by what its routes return and what was
    judged for it.
    """
    weights = sorted(map(tuple, sets.select("set_id", "route", "weight").collect()))
    ids = sorted({w[0] for w in weights})
    routes = sorted({w[1] for w in weights})
    grid = np.full((len(routes), len(ids)), np.nan)
    for s, r, w in weights:
        grid[routes.index(r), ids.index(s)] = w
    ranks = route_case_ranking(hits, chunk_top_k).select("query_id", "doc_id", "route", "weight", "route_rank")
    rows = ranks.join(case_bonus(hits).select("query_id", "doc_id", "bonus"), ["query_id", "doc_id"])
    judged = qrels.select("query_id", "doc_id", "grade", "gain")
    schema = T.StructType([T.StructField("set_id", sets.schema["set_id"].dataType), hits.schema["query_id"], T.StructField("positive_count", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in JUDGED]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _judge(left, right, ids, routes, grid, top_k)
        query = left["query_id"].combine_chunks().slice(0, 1)
        n = len(ids) if len(left) else 0
        columns = [pa.array(ids[:n], schema_types[0]), pa.concat_arrays([query] * n) if n else query.slice(0, 0), *[pa.array(x[:n], t) for x, t in zip(out, schema_types[1:], strict=True)]]
        return pa.Table.from_arrays(columns, schema.names)

    schema_types = [pa.int32() if isinstance(schema[0].dataType, T.IntegerType) else pa.int64(), pa.int64(), *[pa.float64()] * len(JUDGED)]
    return rows.groupBy("query_id").cogroup(judged.groupBy("query_id")).applyInArrow(run, schema)


def _judge(left: pa.Table, right: pa.Table, ids: list, routes: list[str], grid: np.ndarray, top_k: int) -> list:
    """Positive documents of a query and its four measures under every set; null where nothing can be measured."""
    coded = left["doc_id"].combine_chunks().dictionary_encode()
    names = np.array(coded.dictionary.to_pylist())
    by_id = np.argsort(names, kind="stable")
    place = np.empty(len(names), np.int64)
    place[by_id] = np.arange(len(names))
    case = place[coded.indices.to_numpy()] if len(left) else np.zeros(0, np.int64)
    part = 1.0 / (RRF_K + left["route_rank"].to_numpy())
    route = np.array([routes.index(r) if r in routes else -1 for r in left["route"].to_pylist()], np.int64)
    own = left["weight"].to_numpy()
    shares, fixed = np.zeros((len(names), len(routes))), np.zeros((len(names), len(ids)))
    known = route >= 0
    shares[case[known], route[known]] = part[known]
    np.add.at(fixed, case[~known], (own[~known] * part[~known])[:, None])
    for c, r, w, p in zip(case[known], route[known], own[known], part[known], strict=True):
        blank = np.isnan(grid[r])
        fixed[c, blank] += w * p
    bonus = np.zeros(len(names))
    bonus[case] = left["bonus"].to_numpy()
    scores = np.round(shares @ np.nan_to_num(grid) + fixed + bonus[:, None] + NUDGE, 6)
    order = np.argsort(-scores, axis=0, kind="stable")[:top_k]  # rows are in the order of their ids
    grades, gains = {}, {}
    for d, g, x in zip(right["doc_id"].to_pylist(), right["grade"].to_pylist(), right["gain"].to_pylist(), strict=True):
        grades[d], gains[d] = g or 0, x or 0.0
    grade = np.array([grades.get(d, 0) for d in names[by_id].tolist()], float)[order]
    gain = np.array([gains.get(d, 0.0) for d in names[by_id].tolist()], float)[order]
    discount = lambda n: 1 / np.log2(np.arange(2, n + 2))
    positives = sum(g >= POSITIVE for g in grades.values())
    ideal = np.sort(np.array(list(gains.values()), float))[::-1]

    def ratio(found: np.ndarray, best: np.ndarray, k: int) -> list:
        top = float((best[:k] * discount(len(best[:k]))).sum())
        got = (found[:k] * discount(len(found[:k]))[:, None]).sum(axis=0)
        return [round(x / top, 6) if top else None for x in got.tolist()]

    positive = grade >= POSITIVE
    first = np.where(positive.any(axis=0), positive.argmax(axis=0) + 1, 0)
    mrr = [round(1.0 / f if f else 0.0, 6) if positives else None for f in first.tolist()]
    recall = [round(x / positives, 6) if positives else None for x in positive[:20].sum(axis=0).tolist()]
    return [[positives] * len(ids), ratio(gain, ideal, 20), ratio(2**gain - 1, 2**ideal - 1, 10), mrr, recall]


def grid_runs(metrics: DataFrame) -> DataFrame:
    """(set_id, queries, measures, objective): the runs of a grid; means leave nulls out, ``queries`` has a positive document."""
    means = [F.round(F.avg(m), 6).alias(m) for m in JUDGED]
    runs = metrics.groupBy("set_id").agg(F.count_if(F.col("positive_count") > 0).alias("queries"), *means)
    return runs.withColumn("objective", F.round(objective(*[F.col(m) for m in JUDGED]) + NUDGE, 6))


def search_weights(hits: DataFrame, qrels: DataFrame, sets: DataFrame, least_queries: int = 45, n: int = 10) -> DataFrame:
    """The n best weight sets with their names and measures; all sets count if none has enough queries."""
    best = best_runs(grid_runs(grid_metrics(hits, qrels, sets)), least_queries, n)
    return best.join(F.broadcast(sets.select("set_id", "name").distinct()), "set_id")
