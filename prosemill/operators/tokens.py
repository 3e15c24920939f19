"""Token ids of a given vocabulary file: encoding, budgets, streams and their splits. Vocabularies are never trained here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.io import counted
from .corpus import Ordered, loss_mask
from .pairs import block_status


def encode(df: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """MDL9: adds ids, those of the text by the vocabulary file; null text has none (an empty array).

    Workers load the file at the given path once a task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        for f in frames:
            yield f.assign(ids=[e.ids for e in t.encode_batch(f[column].fillna("").tolist(), add_special_tokens=False)])

    fields = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return df.mapInPandas(run, f"{fields}, ids array<int>")


def decode(df: DataFrame, vocabulary: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """MDL9: adds the text of an array of ids; null for null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        for f in frames:
            yield f.assign(**{out: [None if x is None else t.decode([int(i) for i in x], skip_special_tokens=False) for x in f[column]]})

    fields = ", ".join(f"`{n}` {k}" for n, k in df.dtypes)
    return df.mapInPandas(run, f"{fields}, {out} string")


def fit_budget(df: DataFrame, vocabulary: str, column: str = "text", most: int = P.MAX_PASSAGE_TOKENS) -> DataFrame:
    """TXT10: adds passage: the collapsed text, of its first ``most`` tokens where it has more, clipped to its last sentence."""
    ids = encode(df.withColumn("_t", T.collapse(F.col(column))), vocabulary, "_t")
    cut = decode(ids.withColumn("_cut", F.when(F.size("ids") > most, F.slice("ids", 1, most))), vocabulary, "_cut", "_d")
    return cut.withColumn("passage", T.clip_sentence(F.coalesce("_d", "_t"))).drop("_t", "_cut", "_d", "ids")


def within_limit(examples: DataFrame, ids: str = "ids", most: int = P.MAX_EXAMPLE_TOKENS) -> tuple[DataFrame, Observation]:
    """FLT4: the examples of at most ``most`` ids; the number of all rows and of the ``oversized`` ones is told by the pass that reads them."""
    fine = F.size(ids) <= most
    rows, seen = counted(examples, oversized=~fine)
    return rows.where(fine), seen


def shape_examples(blocks: DataFrame, vocabulary: str, end: int, most: int = P.MAX_EXAMPLE_TOKENS) -> tuple[DataFrame, Observation]:
    """S6: blocks(block) -> prompt, key, ids (with the end id), mask; other columns stay.

    Blocks without an answer mark, and examples of more than ``most`` ids, go. The counts of the pass: rows, blank, no_answer, oversized, mismatched
    (the prompt's ids are no prefix, so all ids bear loss). Null blocks are blank.
    """
    status = block_status(F.col("block"))
    ok = blocks.withColumn("_s", status).withColumn("_rest", T.after(F.col("block"), "\nAnswer:"))
    ok = ok.withColumn("prompt", F.when(F.col("_s") == "ok", F.expr("substring(block, 1, length(block) - length(_rest))"))).withColumn("_all", F.when(F.col("_s") == "ok", F.col("block")))
    kept = [c for c in blocks.columns if c not in ("prompt", "key", "ids", "mask")]
    heads = encode(ok, vocabulary, "prompt").withColumnRenamed("ids", "_head")
    full = encode(heads, vocabulary, "_all").withColumn("ids", with_end(F.col("ids"), end))
    fits, fine = F.slice("ids", F.lit(1), F.size("_head")) == F.col("_head"), F.col("_s") == "ok"
    rows, seen = counted(full, blank=F.col("_s") == "blank", no_answer=F.col("_s") == "no answer", oversized=fine & (F.size("ids") > most), mismatched=fine & (F.size("ids") <= most) & ~fits)
    rows = rows.where(fine & (F.size("ids") <= most)).withColumn("mask", loss_mask(F.col("ids"), F.col("_head"))).withColumn("key", T.group_key(F.col("prompt")))
    return rows.select(*kept, "prompt", "key", "ids", "mask"), seen


def with_end(ids: Column, end: int) -> Column:
    """ARR7: the ids and the end id."""
    return F.concat(ids, F.array(F.lit(end).cast("int")))


def stream_split(docs: DataFrame, ids: str, order: str, share: float) -> DataFrame:
    """SNK4, WIN3: each document's ids in train and val: the last int(total * share) ids of the stream are val, which may cut a document.

    Adds offset, train and val (arrays, either may be empty).
    """
    stream = Ordered(docs, F.size(ids), order)
    placed, total = stream.offsets(), stream.total()
    border = total - int(total * share)
    n = F.least(F.greatest(F.lit(border) - F.col("offset"), F.lit(0)), F.size(ids)).cast("int")
    return placed.withColumn("_n", n).withColumn("train", F.slice(ids, F.lit(1), F.col("_n"))).withColumn("val", F.slice(ids, F.col("_n") + 1, F.size(ids))).drop("_n")


def shifted_window(ids: Column, start: Column, size: int) -> tuple[Column, Column]:
    """ARR1: x = ids[start : start + size] and y, one id later."""
    return F.slice(ids, start + 1, size), F.slice(ids, start + 2, size)


def random_start(seed: int, key: Column, n: Column, size: int) -> Column:
    """ARR1: a start that depends on seed and key only, so that a window of ``size`` and its target fit; null for shorter streams."""
    return F.when(n > size, F.pmod(F.xxhash64(F.lit(seed), key), n - size).cast("int"))


def undecodable(vocabulary: str, spark) -> DataFrame:
    """FLT15: the ids whose own text holds U+FFFD, for they are parts of characters; one row for each, at most the vocabulary's size."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return spark.createDataFrame([(i,) for i in range(t.get_vocab_size()) if "�" in t.decode([i], skip_special_tokens=False)], "id int")
