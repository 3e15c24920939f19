"""Generators of question/answer pairs and of questions: prompts as columns, replies through the model boundary, items read in Spark.

A model is any callable of a prompt, a bound on the reply's tokens and a temperature; it gives a Reply. It runs in tasks,
some calls at a time; what it says is written before anything looks at it, so a reply is asked for once.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.staging import staged
from .pairs import members_not_seen


class Reply(NamedTuple):
    """A model's reply; ``stop`` is TRUNCATED where the bound on tokens cut it."""

    text: str | None
    stop: str = "end"


TRUNCATED = "max_tokens"
Model = Callable[[str, int, float | None], Reply]


class ModelError(Exception):
    """The model refuses a prompt: its row fails, others go on."""


class Busy(ModelError):
    """The model can't answer now; it is asked again after a pause."""


@dataclass(frozen=True)
class Generator:
    """What is asked, and how the reply is read.

    ``template`` holds {column} places and {n}. ``shape`` is pairs (question, answer), targets (value, question, answer) or
    questions. ``shows`` says whether blocks hold the passage as context.
    """

    name: str
    template: str
    shape: str
    n: int
    max_tokens: int = 1500
    temperature: float | None = None
    shows: bool = True


_PAIRS = " Reply with a JSON array of objects with the keys question and answer, and nothing else."
_QUESTIONS = " Reply with a JSON array of {n} strings without double quotes inside, and nothing else."
_PASSAGE = "\n\nPassage:\n---\n{passage}\n---"
#: The wording is a parameter; bounds on tokens, numbers of items and the temperature are fixed values.
GENERATORS: dict[str, Generator] = {
    g.name: g
    for g in (
        Generator("context", "Write {n} questions that the passage answers, each with a short answer from it." + _PAIRS + _PASSAGE, "pairs", 2),
        Generator("grounding", "Write {n} questions whose answers must follow the passage where it differs from common belief." + _PAIRS + _PASSAGE, "pairs", 2),
        Generator("false_premise", "Write {n} questions that assume something which the passage contradicts; answers correct it." + _PAIRS + _PASSAGE, "pairs", 2),
        Generator("false_premise_no_context", "Write {n} questions about {title} with a false assumption; answers correct it and stand alone." + _PAIRS + _PASSAGE, "pairs", 1, shows=False),
        Generator("no_context", "Write {n} questions of the kind: {category}. Each has a short answer." + _PAIRS, "pairs", 20, 4000, 1.0, False),
        Generator("discrimination", "The passage holds these values:\n{listed}\nWrite a question for each whose only answer is that value; the answer, a short sentence, names no other of them. Reply with a JSON array of objects with the keys value, question and answer, and nothing else." + _PASSAGE, "targets", P.MAX_PAIRS, 2000),
        Generator("complex", "Write {n} questions of fact that take two steps to answer." + _QUESTIONS, "questions", 150, 10000),
        Generator("false", "Write {n} questions that assume something false." + _QUESTIONS, "questions", 50, 4000),
        Generator("open", "Write {n} questions of fact that call for an explanation." + _QUESTIONS, "questions", 100, 8000),
    )
}


def add_generator(generator: Generator) -> None:
    """MDL2, MDL3: adds a generator under its name; a name is taken once."""
    if generator.name in GENERATORS:
        raise ValueError(f"there is a generator {generator.name}")
    GENERATORS[generator.name] = generator


def fill(template: str, **values: Column | str | int) -> Column:
    """A template as a column: each {name} is its value (a null one is empty), all else stays as it is."""
    parts = re.split(r"\{(\w+)\}", template)
    missing = set(parts[1::2]) - set(values)
    if missing:
        raise ValueError(f"the template wants {', '.join(sorted(missing))}")
    as_text = lambda v: F.coalesce(v.cast("string"), F.lit("")) if isinstance(v, Column) else F.lit(str(v))
    return F.concat(*[as_text(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def ask_model(prompts: DataFrame, model: Model, generator: Generator, retries: int = 3, pause: float = 5.0, concurrency: int = 8, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """MDL2, MDL3: rows with ``prompt`` -> these with reply, stop and tries; a null reply is a failed one.

    A busy model is asked again after pause, 2 pause, 4 pause seconds; a refusal and a model busy to the end fail the row only.
    """

    def one(prompt: str) -> tuple[str | None, str | None, int]:
        for attempt in range(retries + 1):
            try:
                return *model(prompt, generator.max_tokens, generator.temperature), attempt + 1
            except Busy:
                if attempt < retries:
                    wait(2**attempt * pause)
            except ModelError:
                return None, None, attempt + 1
        return None, None, retries + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for f in frames:
                got = list(pool.map(one, f["prompt"]))
                reply, stop, tries = zip(*got, strict=True) if got else ((), (), ())
                yield f.assign(reply=pd.Series(reply, f.index, dtype="object"), stop=pd.Series(stop, f.index, dtype="object"), tries=pd.Series(tries, f.index, dtype="int32"))

    fields = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes)
    return prompts.mapInPandas(run, f"{fields}, reply string, stop string, tries int")


def json_items(text: Column) -> Column:
    """A JSON array's items as variants; null for other JSON, what is no JSON, and text behind the array."""
    # inside another array, what follows the array breaks it or makes a second item
    outer = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    only = F.when(F.size(outer) == 1, F.get(outer, F.lit(0)))
    return F.when(F.schema_of_variant(only).startswith("ARRAY"), F.try_variant_get(only, "$", "array<variant>"))


def _field(item: Column, name: str, texts_only: bool) -> Column:
    """A field as stripped text; null if it is missing, blank before stripping, zero, false, a list or an object (or no text at all, with ``texts_only``)."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    kind, text = F.schema_of_variant(value), F.try_variant_get(item, f"$.{name}", "string")
    fine = (kind == "STRING") & (text != "")
    if not texts_only:
        fine |= (kind == "BOOLEAN") & (text == "true") | (kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")) & (text.try_cast("double") != 0)
    return F.when(fine, T.strip(text))


def read_reply(reply: Column, shape: str) -> Column:
    """The items of a reply, in order: an array of structs of question, answer and value (null where the shape has none); null if it can't be read.

    Pairs: objects without a text for question and answer are left out. Targets: these stay, with a null for each such field, so that
    pairs.judge_pairs counts them; numbers become text. Questions: the texts of a JSON array, blank ones left out; where the reply is no JSON array,
    its lines in double quotes, if there are any.
    """
    text = T.strip_fence(reply)
    items = json_items(text)
    none = F.lit(None).cast("string")
    row = lambda q, a, v: F.struct(q.alias("question"), a.alias("answer"), v.alias("value"))
    if shape == "pairs":
        made = F.transform(items, lambda x: row(_field(x, "question", True), _field(x, "answer", True), none))
        return F.filter(made, lambda x: x["question"].isNotNull() & x["answer"].isNotNull())
    if shape == "targets":
        return F.transform(items, lambda x: row(_field(x, "question", False), _field(x, "answer", False), _field(x, "value", False)))
    if shape != "questions":
        raise ValueError(f"unknown shape {shape}")
    texts = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: T.strip(F.try_variant_get(x, "$", "string")))
    lines = T.quoted_lines(text)
    found = F.when(items.isNotNull(), F.filter(texts, lambda x: x != "")).when(F.size(lines) > 0, lines)
    return F.transform(found, lambda x: row(x, none, none))


def read_replies(asked: DataFrame, generator: Generator, strict: bool = False) -> DataFrame:
    """Adds status (ok, failed, truncated, unreadable) and items; these are null unless the status is ok.

    A truncated list of questions is an error, however much of it could be read: its row says so, or with ``strict`` the job fails. Truncated
    pairs count as what is left of them: mostly unreadable.
    """
    items = read_reply(F.col("reply"), generator.shape)
    cut = F.lit(generator.shape == "questions") & F.col("stop").eqNullSafe(TRUNCATED)
    rows = asked.withColumn("items", items).withColumn("status", F.when(F.col("reply").isNull(), "failed").when(cut, "truncated").when(F.col("items").isNull(), "unreadable").otherwise("ok"))
    if strict:
        error = F.raise_error(F.lit(f"a reply of {generator.name} was cut at {generator.max_tokens} tokens: raise the bound"))
        rows = rows.where(F.when(F.col("status") == "truncated", error.cast("boolean")).otherwise(True))
    return rows.withColumn("items", F.when(F.col("status") == "ok", F.col("items")))


def generate(rows: DataFrame, generator: Generator, model: Model, strict: bool = False, **options) -> DataFrame:
    """MDL2, MDL3: rows with the template's columns -> these with prompt, reply, stop, tries, status and items.

    ``listed`` of the discrimination generator is made from a column ``values``, an array. Replies are written before they are read:
    a lost executor or a second look at the result asks for none again.
    """
    given = {c: F.col(c) for c in rows.columns} | {"n": generator.n}
    if "values" in rows.columns:
        given["listed"] = F.array_join(F.transform("values", lambda v: F.concat(F.lit("- "), v)), "\n")
    asked = ask_model(rows.withColumn("prompt", fill(generator.template, **given)), model, generator, **options)
    return read_replies(staged(asked, "replies"), generator, strict)


def item_rows(generated: DataFrame) -> DataFrame:
    """A row for each item: the columns of the input, seq (from 0), question, answer, value."""
    left = [c for c in generated.columns if c not in ("prompt", "reply", "stop", "tries", "status", "items", "question", "answer", "value", "seq")]
    return generated.select(*left, F.posexplode("items").alias("seq", "_i")).select(*left, "seq", "_i.question", "_i.answer", "_i.value")


def block(generator: Generator, question: Column, answer: Column, passage: Column | None = None) -> Column:
    """A pair as a block of the training text, with its passage where the generator shows it."""
    head = F.concat(F.lit("Context: "), passage) if generator.shows and passage is not None else F.lit(P.NO_CONTEXT)
    return F.concat(head, F.lit("\nQuestion: "), question, F.lit("\nAnswer: "), answer, F.lit(f"\n{P.END_OF_TEXT}\n"))


def generate_until(rows: DataFrame, generator: Generator, model: Model, target: int, once: bool = False, first: int | None = None, **options) -> DataFrame:
    """MDL2: asks rows in the order of their ``pos`` (0, 1, ...) in waves until there are ``target`` pairs, or no rows -> item rows.

    A wave has as many rows as the yield so far asks for, at most twice those of the wave before, so there are few waves; every
    item of a row asked stays, as its reply is paid for. ``once`` keeps the first of the questions with the same letters and digits over all waves.
    """
    size, at, have, found = first or max(1, math.ceil(target / generator.n)), 0, 0, None
    total = rows.count()
    while found is None or have < target and at < total:
        got = item_rows(generate(rows.where((F.col("pos") >= at) & (F.col("pos") < at + size)), generator, model, **options))
        if once:
            got = got.withColumn("_key", T.dedup_key(F.col("question"))).withColumn("_at", F.struct("pos", "seq"))
            seen = got.limit(0).select("_key") if found is None else found.select("_key")
            got = members_not_seen(got, seen, "_key", "_at").drop("_at")
        got = staged(got, "wave")
        have, at = have + got.count(), at + size
        found = got if found is None else found.unionByName(got)
        size = min(2 * size, max(1, math.ceil((target - have) * at / max(have, 1))))
    return found.drop("_key")
