"""Evaluation: NDCG, quantiles of latencies, agreement of encoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(relevance: Column, rank: Column) -> Column:
    return relevance / F.log2(rank + 1)


def ndcg(ranked: DataFrame, relevant: DataFrame, depth: int = 10) -> DataFrame:
    """(qid, ndcg) of ranked (qid, key, rank from 1) against relevant (qid, key, rel); queries without relevance are left out."""
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "key"))
    ideal = relevant.withColumn("r", ideal_rank).filter(F.col("r") <= depth).groupBy("qid").agg(F.sum(_gain(F.col("rel"), F.col("r"))).alias("ideal"))
    got = ranked.filter(F.col("rank") <= depth).join(relevant, ["qid", "key"]).groupBy("qid").agg(F.sum(_gain(F.col("rel"), F.col("rank"))).alias("got"))
    return ideal.filter("ideal > 0").join(got, "qid", "left").select("qid", (F.coalesce("got", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def mean_ndcg(ranked: DataFrame, relevant: DataFrame, depth: int = 10) -> DataFrame:
    return ndcg(ranked, relevant, depth).agg(F.avg("ndcg").alias("ndcg"))


def clamped_quantile(rows: DataFrame, value: str, q: float, most: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, quantile): the first value that at least ceil(q n) values don't exceed, values beyond `most` counted there."""
    clamped = f"percentile_disc({q}) WITHIN GROUP (ORDER BY least({value}, {most}D))"
    return rows.groupBy(*by).agg(F.expr(clamped).alias("quantile"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(mean, least, greatest) cosine of two vectors a row."""
    from ..functions.vector import dot, norm

    cosine = dot(F.col(a), F.col(b)) / (norm(F.col(a)) * norm(F.col(b)))
    return pairs.agg(F.avg(cosine).alias("mean"), F.min(cosine).alias("least"), F.max(cosine).alias("greatest"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n); values outside go to the end bins."""
    at = F.floor((value - low) / ((high - low) / bins)).cast("int")
    return rows.select(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
