"""Ranking metrics of judged queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_query(results: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rr, p_at_k, r_at_k, ndcg, zero) for each judged query.

    ``results`` is (query_id, doc_id, rank from 1), ``judgments`` (query_id,
    doc_id, grade); a grade above 0 is relevant, gains are 2^grade - 1 with a
    log2 discount. A query without results has zeros and ``zero`` set.
    """
    top = results.where(F.col("rank") <= k).join(judgments, ["query_id", "doc_id"], "left")
    good = F.coalesce("grade", F.lit(0)) > 0
    gain = (F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("rank") + 1)
    got = top.groupBy("query_id").agg(F.count_if(good).alias("hit"), F.min(F.when(good, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    best = judgments.where("grade > 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"))))
    ideal = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1))).alias("ideal"))
    every = judgments.select("query_id").distinct().join(got, "query_id", "left").join(ideal, "query_id", "left")
    zero = F.lit(0.0)
    return every.select(
        "query_id",
        F.coalesce(1 / F.col("first"), zero).alias("rr"),
        (F.coalesce("hit", F.lit(0)) / k).alias("p_at_k"),
        F.coalesce(F.col("hit") / F.col("relevant"), zero).alias("r_at_k"),
        F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"),
        F.col("hit").isNull().alias("zero"),
    )


def overall(per_query: DataFrame) -> DataFrame:
    """Means over the queries: mrr, p_at_k, r_at_k, ndcg, zero_rate."""
    return per_query.agg(F.avg("rr").alias("mrr"), F.avg("p_at_k").alias("p_at_k"), F.avg("r_at_k").alias("r_at_k"), F.avg("ndcg").alias("ndcg"), F.avg(F.col("zero").cast("int")).alias("zero_rate"))
