"""From a question to a shown answer, and from an API reply to a passage."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from .vectors import gate, top_k

API = "query struct<pages: map<string, struct<extract: string, missing: string>>>"


def best_passage(queries: DataFrame, vectors: DataFrame, passages: DataFrame, least: float = P.MIN_COSINE) -> DataFrame:
    """MDL5: queries(query_id, qvec), vectors(id, vec), passages(id, passage) -> query_id, id, score, passage, context (null below ``least``)."""
    hits = top_k(queries, vectors, 1, exclude_self=False).drop("rank").join(passages, "id")
    return gate(hits, least)


def choose_context(questions: DataFrame, mode: str, retrieved: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """MDL8: questions(question, category) -> context, score and missing_override (an override is wanted, but there is none).

    mode is retrieval (retrieved(question, context, score)), none, or override (overrides(question, passage)).
    """
    if mode == "retrieval":
        out = questions.join(retrieved, "question", "left")
    elif mode == "override":
        out = questions.join(overrides.select("question", F.col("passage").alias("context")), "question", "left").withColumn("score", F.lit(None).cast("double"))
    elif mode == "none":
        out = questions.withColumn("context", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return out.withColumn("missing_override", F.lit(mode == "override") & F.col("context").isNull() & (F.col("category") != "non_factual"))


def cut_tail(chunks: Column, budget: Column) -> Column:
    """TXT22: the chunks up to the first full stop from place int(budget * 0.8) on; all and ... if the budget is spent without one."""
    # the lambda sees a chunk only: what it holds besides is evaluated for each
    late = F.floor(budget * P.TAIL_SHARE).cast("int")
    first = F.array_position(F.transform(F.slice(chunks, late + 1, F.size(chunks)), lambda x: F.contains(x, F.lit("."))), True).cast("int")
    at = F.when(first > 0, late + first).otherwise(0)
    cut = F.concat(F.array_join(F.slice(chunks, F.lit(1), at - 1), ""), F.substring_index(F.get(chunks, at - 1), ".", 1), F.lit("."))
    whole = F.array_join(chunks, "")
    return F.when(at > 0, cut).when(F.size(chunks) >= budget, F.concat(whole, F.lit("..."))).otherwise(whole)


def debug_suffix(context: Column, score: Column, least: float) -> Column:
    """TXT28: what is shown below an answer: the context used, or that none was, or nothing if nothing was looked for."""
    used = F.concat(F.lit("\n\n<details><summary>📄 Context used (score "), F.format_string("%.2f", score), F.lit(")</summary>\n\n"), context, F.lit("\n\n</details>"))
    none = F.concat(F.lit("\n\n<details><summary>⚠️ No context used (best score "), F.format_string("%.2f", score), F.lit(f", below threshold {least})</summary></details>"))
    return F.when(context.isNotNull() & score.isNotNull(), used).when(context.isNull() & score.isNotNull(), none).otherwise("")


def api_extract(body: Column) -> Column:
    """JS4: the extract of the only page of a reply; null for the page -1, a missing page and what is no reply."""
    pages = F.map_entries(F.from_json(body, API)["query"]["pages"])
    page = F.get(pages, F.lit(0))
    return F.when((page["key"] != "-1") & page["value"]["missing"].isNull(), page["value"]["extract"])


def backoff(attempt: Column, retry_after: Column) -> Column:
    """MTH7: seconds to wait: at least what the server asks for, else 2^attempt, not more than 2^6."""
    return F.greatest(F.coalesce(retry_after.cast("double"), F.lit(0.0)), F.pow(F.lit(2.0), F.least(attempt, F.lit(6))))


def fetch(titles: DataFrame, get: Callable[[str], tuple[int, str | None, float]], retries: int = 8, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """SRC12: titles(title) -> title, body, failed. ``get`` gives status, body and the server's wait; 200 and 404 end, others are asked again.

    A failed fetch is not a missing page: its body is null and failed is true.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for title in f["title"]:
                body, failed = None, True
                for attempt in range(retries + 1):
                    status, got, after = get(title)
                    if status in (200, 404):
                        body, failed = (got if status == 200 else None), False
                        break
                    if attempt < retries:
                        wait(max(after, 2.0 ** min(attempt, 6)))
                rows.append((title, body, failed))
            yield pd.DataFrame(rows, columns=["title", "body", "failed"])

    return titles.select("title").mapInPandas(run, "title string, body string, failed boolean")


def fetch_all(titles: DataFrame, get, stage: Callable[[DataFrame], DataFrame], passes: int = 5, cooldown: float = 30.0, wait: Callable[[float], None] = time.sleep, **options) -> DataFrame:
    """STR8: failed fetches again, up to ``passes`` times with a pause between; ``stage`` persists each pass. What still fails stays failed."""
    done = stage(fetch(titles, get, wait=wait, **options))
    for _ in range(passes - 1):
        bad = done.where("failed")
        if bad.isEmpty():
            break
        wait(cooldown)
        done = stage(done.where("not failed").unionByName(fetch(bad.select("title"), get, wait=wait, **options)))
    return done


def toggles(events: DataFrame, session: str, order: str) -> DataFrame:
    """STR7: the state of each switch after each event: the last value set so far in the session; null before the first."""
    upto = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    switches = [c for c in events.columns if c not in (session, order)]
    return events.select(session, order, *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in switches])


def cadences(step: Column, **every: int) -> list[Column]:
    """STR4: for each named cadence whether a step is one of its turns; step 0 is none."""
    return [((step > 0) & (step % k == 0)).alias(name) for name, k in every.items()]
