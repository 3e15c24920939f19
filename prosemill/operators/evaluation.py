"""Classification of judged answers, tallies and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _premise(category: Column, corrected: Column) -> Column:
    return F.when(category == "non_factual", "non_factual").when(
        category == "false_premise", F.when(corrected.isNull(), "judge_error").when(corrected, "premise_corrected").otherwise("premise_accepted_hallucination")
    )


def whitebox(category: Column, context: Column, corrected: Column, expected: Column, relevant: Column, correct: Column) -> Column:
    """CLS1; a null judgment field stands for a failed judge."""
    no_context = F.when(expected.isNull(), "judge_error").when(expected, "rag_recall_failure").otherwise("no_context_expected")
    with_context = F.when(relevant.isNull(), "judge_error").when(~relevant, "rag_precision_failure").when(F.coalesce(correct, F.lit(False)), "success").otherwise("finetuning_grounding_failure")
    return F.coalesce(_premise(category, corrected), F.when(context.isNull(), no_context).otherwise(with_context))


def blackbox(category: Column, corrected: Column, correct: Column) -> Column:
    """CLS2."""
    return F.coalesce(_premise(category, corrected), F.when(correct.isNull(), "judge_error").when(correct, "success").otherwise("incorrect"))


def precision_diagnosis(failed: Column, rank: Column, expected: Column) -> Column:
    """CLS3; rank 0 counts as none."""
    return F.when(failed, "judge_error").when(rank == 1, "rank1_reassessed_relevant").when(rank > 0, "lookup_issue").when(expected, "coverage_or_embedding_gap").otherwise("no_coverage_expected")


def fetch_status(text: Column, failed: Column, cleaned: Column, least: int) -> Column:
    """CLS4."""
    return F.when(failed, "error").when(text.isNull(), "missing").when(F.length(cleaned) < least, "short").otherwise("ok")


def tally(df: DataFrame, label: str, pos: str) -> DataFrame:
    """AGG2: counts with the place of the first row, by which ties are ordered."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))


def pivot_counts(df: DataFrame, run: str, label: str, labels: list[str]) -> DataFrame:
    """AGG4: a column for each label in a fixed order, 0 where a run has none."""
    return df.groupBy(run).agg(*[F.count_if(F.col(label) == x).alias(x) for x in labels])


def stacked(df: DataFrame, run: str, order: str, n: str) -> DataFrame:
    """WIN10: where each bar starts."""
    return df.withColumn("bottom", F.sum(n).over(Window.partitionBy(run).orderBy(order)) - F.col(n))


def champion(runs: DataFrame, score: str, incumbent: str, name: str) -> DataFrame:
    """AGG9: the best run; the incumbent keeps a tie, else the least name."""
    best = runs.agg(F.max(F.struct(F.col(score), F.col(incumbent).cast("int").alias("i"))).alias("b"))
    at = runs.join(F.broadcast(best), (F.col(score) == F.col("b")[score]) & (F.col(incumbent).cast("int") == F.col("b")["i"]))
    return at.groupBy().agg(F.min(name).alias(name), F.max(score).alias(score))


def patch(records: DataFrame, fixes: DataFrame, key: str, label: str, bad: str = "judge_error") -> DataFrame:
    """JN8: only rows with the bad label take the fix of their key, where there is one."""
    f = fixes.select(F.col(key).alias("_k"), F.col(label).alias("_new"))
    joined = records.join(f, (F.col(key) == F.col("_k")) & (F.col(label) == bad), "left")
    return joined.withColumn(label, F.coalesce("_new", label)).drop("_k", "_new")


def last_override(overrides: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """JN2, FLT9: the last usable override of each key."""
    usable = overrides.where(F.col("status").isin("ok", "needs_review") & (F.col(value) != ""))
    return usable.groupBy(key).agg(F.max_by(value, order).alias(value))


def rejudge(records: DataFrame, category: str, corrected: Column, correct: Column) -> DataFrame:
    """CLS6: without score, context and earlier judgment, classified by blackbox()."""
    gone = [c for c in ("score", "context_used", "context", "classification", "judgment") if c in records.columns]
    return records.withColumn("_new", blackbox(F.col(category), corrected, correct)).drop(*gone).withColumnRenamed("_new", "classification")


def with_checkpoint(runs: DataFrame, sources: DataFrame, source: str, default: str) -> DataFrame:
    """JN6: the checkpoint of the run's source summary, or the default."""
    s = sources.select(F.col("run_name").alias("_s"), F.col("checkpoint").alias("_c"))
    return runs.join(s, F.col(source) == F.col("_s"), "left").withColumn("checkpoint", F.coalesce("_c", F.lit(default))).drop("_s", "_c")


def labelled(runs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """JN10: labels(name, label); a run without a label is called by its name. The table of labels is written by hand, so it is small."""
    found = labels.select(F.col(name).alias("_n"), F.col("label").alias("_l"))
    return runs.join(F.broadcast(found), F.col(name) == F.col("_n"), "left").withColumn("label", F.coalesce("_l", name)).drop("_n", "_l")


def tally_map(df: DataFrame, run: str, label: str) -> DataFrame:
    """AGG3: run -> a map of label to count."""
    n = df.groupBy(run, label).agg(F.count("*").alias("n"))
    return n.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("tally"))


def nonzero(df: DataFrame, series: str, n: str) -> DataFrame:
    """FLT14: the rows of series that are not zero throughout."""
    keep = df.groupBy(series).agg(F.max(n).alias("_m")).where("_m > 0").select(series)
    return df.join(keep, series, "left_semi")


def first_relevant(candidates: DataFrame, query: str, rank: str, relevant: str) -> DataFrame:
    """WIN11: the rank of the first relevant candidate; null if there is none."""
    return candidates.groupBy(query).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("first_rank"))


def truthy(judgment: Column, field: str) -> Column:
    """JS3: a field of a JSON object as truth: null, false, 0 and empty are false, any other string, also "false", is true; null without the field."""
    v = F.try_parse_json(judgment)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    text = F.try_variant_get(v, f"$.{field}", "string")
    falsy = ((kind == "BOOLEAN") & (text == "false")) | (kind == "VOID") | (text == "") | (kind.rlike("BIGINT|DECIMAL|DOUBLE") & (text.try_cast("double") == 0)) | text.isin("[]", "{}")
    return F.when(kind.isNull(), F.lit(None).cast("boolean")).otherwise(~F.coalesce(falsy, F.lit(False)))
