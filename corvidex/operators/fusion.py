"""Fusion of ranked lists by score-weighted reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60.0


def rank_bonus(rank: Column) -> Column:
    """0.05 for the first place (0), 0.02 for the next two, nothing beyond."""
    return F.when(rank == 0, 0.05).when(rank <= 2, 0.02).otherwise(0.0)


def rank_list(df: DataFrame, by: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Adds the 0-based ``rank``, within each key if there are keys."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return df.withColumn("rank", F.row_number().over(w.orderBy(*by)) - 1)


def fuse(lists: DataFrame, keys: list[str] | None = None, rrf_k: float = RRF_K) -> DataFrame:
    """(keys.., chunk_id, rrf_score, best_rank, in_vec, in_fts, distance, similarity, fts_rank).

    ``lists`` has (keys.., list_idx, kind vec|fts, weight, chunk_id, rank, score,
    distance, fts_rank), one row per list and chunk. A chunk's score is the sum of
    weight * score / (k + rank) and one bonus for its best rank. The first vector
    list that holds it gives its distance, the last keyword list its rank.
    """
    by = [*(keys or []), "chunk_id"]
    vec, fts = F.col("kind") == "vec", F.col("kind") == "fts"
    out = lists.groupBy(*by).agg(
        F.sum(F.col("weight") * F.col("score") / (F.lit(rrf_k) + F.col("rank"))).alias("sum"),
        F.min("rank").alias("best_rank"),
        F.max(vec).alias("in_vec"), F.max(fts).alias("in_fts"),
        F.min_by("distance", F.when(vec, F.col("list_idx"))).alias("distance"),
        F.max_by("fts_rank", F.when(fts, F.col("list_idx"))).alias("fts_rank"),
    )
    return out.select(*by, (F.col("sum") + rank_bonus(F.col("best_rank"))).alias("rrf_score"), "best_rank", "in_vec", "in_fts",
                      "distance", (1 - F.col("distance")).alias("similarity"), "fts_rank")
