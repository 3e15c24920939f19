"""The model boundary: judges, generators, encoders, scorers and answerers are callables.

A backend takes a batch of prompts and returns as many replies. Offline, replies come from a
table by the prompt's hash; nothing here claims to reproduce a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Backend = Callable[[list[str]], list[str | None]]


def ask(prompts: DataFrame, backend: Backend, retries: int = 3, column: str = "prompt") -> DataFrame:
    """MDL1-MDL3, MDL7: adds reply and tries; a reply that stays None after the retries is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            reply, tries = [None] * len(f), [0] * len(f)
            for _ in range(retries):
                todo = [i for i, r in enumerate(reply) if r is None]
                if not todo:
                    break
                for i, r in zip(todo, backend([f[column].iloc[i] for i in todo]), strict=True):
                    reply[i], tries[i] = r, tries[i] + 1
            yield f.assign(reply=pd.Series(reply, index=f.index, dtype="object"), tries=tries)

    fields = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes)
    return prompts.mapInPandas(run, f"{fields}, reply string, tries int")


def replay(prompts: DataFrame, replies: DataFrame, column: str = "prompt") -> DataFrame:
    """The offline backend: replies(prompt, reply) joined by the prompt; a missing one is null."""
    known = replies.groupBy(F.md5(column).alias("_h")).agg(F.max("reply").alias("reply"))
    return prompts.withColumn("_h", F.md5(column)).join(known, "_h", "left").drop("_h")


def retry_errors(records: DataFrame, label: str, redo: Callable[[DataFrame], DataFrame], stage: Callable[[DataFrame], DataFrame], passes: int = 3) -> DataFrame:
    """CLS7: up to ``passes`` times the rows with judge_error are judged again; ``stage`` persists each pass."""
    for _ in range(passes):
        bad = records.where(F.col(label) == "judge_error")
        if bad.isEmpty():
            break
        records = stage(records.where(~F.col(label).eqNullSafe("judge_error")).unionByName(redo(bad)))
    return records


def encode(passages: DataFrame, encoder: Callable[[list[str]], list[list[float]]], column: str = "passage") -> DataFrame:
    """MDL4: adds a vector of unit length."""
    from .vectors import unit

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(vec=encoder(f[column].fillna("").tolist()))

    fields = ", ".join(f"`{n}` {t}" for n, t in passages.dtypes)
    return passages.mapInPandas(run, f"{fields}, vec array<double>").withColumn("vec", unit(F.col("vec")))
