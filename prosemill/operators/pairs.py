"""Question/answer pairs and blocks: validation with reasons, counts of what was dropped, unions in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .corpus import first_seen, offsets

#: Reasons, in the order in which they are looked for; the first that holds is given.
REASONS = ("unknown target", "answer lacks target", "sibling in answer", "question leaks answer", "bare answer")


def validate(value: Column, question: Column, answer: Column, values: Column, pattern: str, least: int = P.MIN_ANSWER_WORDS) -> Column:
    """FLT10, CLS5, SET3: why a pair is rejected, or null if it is good. A null field counts as empty.

    Values of the answer are found by the pattern that found those of the passage, so no part of a longer value counts.
    """
    value, question, answer = (F.coalesce(c, F.lit("")) for c in (value, question, answer))
    siblings = F.array_intersect(F.regexp_extract_all(answer, F.lit(pattern), 0), F.array_remove(values, value))
    rules = (~F.array_contains(values, value), ~F.contains(answer, value), F.size(siblings) > 0, F.contains(question, value), F.size(T.words(answer)) < least)
    out = F.lit(None).cast("string")
    for rule, reason in reversed(list(zip(rules, REASONS, strict=True))):
        out = F.when(rule, reason).otherwise(out)
    return out


def judge_pairs(pairs: DataFrame, pattern: str, least: int = 2, most: int = P.MAX_PAIRS) -> DataFrame:
    """AGG6, FLT11: pairs(passage, seq, value, question, answer, values) -> the same rows and reason; null: kept.

    Malformed pairs, rejected ones, all but the first of a target, those of passages that keep fewer than
    ``least`` and those beyond ``most`` each have a reason of their own.
    """
    malformed = F.lit(False)
    for c in ("value", "question", "answer"):
        malformed |= F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(malformed, "malformed pair").otherwise(validate(F.col("value"), F.col("question"), F.col("answer"), F.col("values"), pattern))
    rows = pairs.withColumn("reason", reason)
    good = F.col("reason").isNull()
    # windows inside a passage, whose pairs come from one reply
    nth = F.row_number().over(Window.partitionBy("passage", good, F.when(good, F.col("value"))).orderBy("seq"))
    rows = rows.withColumn("_nth", nth).withColumn("reason", F.when(good & (F.col("_nth") > 1), "duplicate target").otherwise(F.col("reason")))
    whole = Window.partitionBy("passage")
    rows = rows.withColumn("_n", F.count_if(F.col("reason").isNull()).over(whole)).withColumn("_i", F.row_number().over(Window.partitionBy("passage", F.col("reason").isNull()).orderBy("seq")))
    late = F.when(F.col("_n") < least, "passage yielded too few").when(F.col("_i") > most, "over the cap")
    return rows.withColumn("reason", F.when(F.col("reason").isNull(), late).otherwise(F.col("reason"))).drop("_nth", "_n", "_i")


def rewrite_context(block: Column) -> Column:
    """TXT14: the context of a block clipped to its last sentence; blocks of another shape stay."""
    inside = F.regexp_extract(block, P.CONTEXT, 1)
    clipped = T.clip_sentence(inside)
    return F.when(block.rlike(P.CONTEXT), F.concat(F.lit("Context: "), clipped, F.substring(block, F.lit(10) + F.length(inside), F.length(block)))).otherwise(block)


def block_status(block: Column) -> Column:
    """FLT13, TXT15: blank, no answer (no mark) or ok."""
    return F.when(T.strip(F.coalesce(block, F.lit(""))) == "", "blank").when(~F.contains(block, F.lit("\nAnswer:")), "no answer").otherwise("ok")


def pairs_per_context(pairs: DataFrame, key: str) -> DataFrame:
    """AGG11: pairs, contexts and their ratio; no pairs give 0 over 1."""
    return pairs.agg(F.count("*").alias("pairs"), F.count_distinct(key).alias("contexts")).withColumn("average", F.col("pairs") / F.greatest(F.col("contexts"), F.lit(1)))


def concat_in_order(parts: list[DataFrame], order: str) -> DataFrame:
    """SET1, SET2: all rows of the parts, part by part, with a global position ``pos`` from 0."""
    found = None
    for i, part in enumerate(parts):
        d = part.withColumn("_o", F.struct(F.lit(i).alias("part"), F.col(order).alias("o")))
        found = d if found is None else found.unionByName(d)
    return offsets(found, F.lit(1), "_o").withColumnRenamed("offset", "pos").drop("_o")


def prioritized(first: DataFrame, pool: DataFrame, each_first: int, each_pool: int) -> DataFrame:
    """SET5: the first part with its number of pairs, then the pool with its own; the pool may repeat what the first has."""
    return first.withColumn("priority", F.lit(0)).withColumn("pairs", F.lit(each_first)).unionByName(pool.withColumn("priority", F.lit(1)).withColumn("pairs", F.lit(each_pool)))


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """FLT5, SRT1: the first rows in order; strings by code point."""
    return df.orderBy(order).limit(n)


def members_not_seen(df: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """JN9, SET4: the first row of each key that is not among those seen."""
    return first_seen(df, key, order).join(seen.select(key).distinct(), key, "left_anti")
