"""Retrieval evaluation: gold ranks, metrics, leaderboards, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gold_ranks(ranked: DataFrame, gold: DataFrame, query: str, doc: str) -> DataFrame:
    """(query, rank): where in the ranking the first of a query's gold documents stands; null if none does."""
    hits = ranked.join(gold, [query, doc]).groupBy(query).agg(F.min("rank").alias("rank"))
    return gold.select(query).distinct().join(hits, query, "left")


def scores(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall, NDCG (of one relevant document) and the mean reciprocal rank."""
    hit = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    out = [F.round(F.avg(hit(k).cast("double")), 6).alias(f"recall_{k}") for k in ks]
    out += [F.round(F.avg(F.when(hit(k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)), 6).alias(f"ndcg_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("n_queries"), *out, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Results (combo, mrr, ...) with their place; ties by name."""
    return results.withColumn("place", F.row_number().over(W.orderBy(F.desc("mrr"), "combo")))


def plan(workloads: DataFrame, policies: DataFrame) -> DataFrame:
    """Every workload under every policy, with a hash of the setting. Both are short lists that a person writes."""
    out = workloads.crossJoin(F.broadcast(policies))
    slug = F.concat_ws("__", F.lower(F.regexp_replace("workload", "[^A-Za-z0-9]+", "-")), F.lower(F.regexp_replace("policy", "[^A-Za-z0-9]+", "-")))
    return out.withColumn("slug", slug).withColumn("config_hash", F.substring(F.sha2(slug.cast("binary"), 256), 1, 16))
