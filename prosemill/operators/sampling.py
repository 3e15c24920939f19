"""Scalar semantics of sampling from logits, and token totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def penalize(logit: Column, seen: Column, penalty: float) -> Column:
    """MTH9: seen ids: positive logits are divided, others multiplied."""
    return F.when(~seen, logit).when(logit > 0, logit / penalty).otherwise(logit * penalty)


def top_k_softmax(logits: DataFrame, key: str, k: int, temperature: float) -> DataFrame:
    """SRT10, MTH9: (key, token, logit) -> p over the k best; all ties at the k-th value stay."""
    w = Window.partitionBy(key)
    kept = logits.withColumn("_r", F.rank().over(w.orderBy(F.desc("logit")))).where(F.col("_r") <= k).drop("_r")
    e = F.exp((F.col("logit") - F.max("logit").over(w)) / temperature)
    return kept.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def masked_mean(nll: Column, target: Column, ignore: int = -100) -> Column:
    """AGG15."""
    return F.avg(F.when(target != ignore, nll))


def mean_of_means(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """AGG12: every batch counts the same."""
    return df.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("loss"))


def token_totals(df: DataFrame, ids: str) -> DataFrame:
    """AGG8: ids with one end for each row."""
    return df.agg(F.coalesce(F.sum(F.size(ids) + 1), F.lit(0)).alias("tokens"), F.count("*").alias("rows"))


def max_steps(epochs: Column, tokens: Column, per_step: Column) -> Column:
    """MTH6."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.floor(epochs * tokens / per_step)))


def with_best(checkpoint: DataFrame) -> DataFrame:
    """MAP2: older checkpoints lack the best loss and its step."""
    for c, d in (("best_val_loss", "val_loss"), ("best_iter", "iter")):
        checkpoint = checkpoint.withColumn(c, F.coalesce(F.col(c), F.col(d)) if c in checkpoint.columns else F.col(d))
    return checkpoint
