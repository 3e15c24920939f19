"""Scalar text functions as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (TXT7: trim() only knows the blank)."""
    return F.regexp_replace(c, f"^[{P.WS}]+|[{P.WS}]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"[{P.WS}]+$", "")


def newlines(c: Column) -> Column:
    """Line ends of any system as \\n."""
    return F.regexp_replace(c, "\\r\\n?", "\n")


def strip_boilerplate(c: Column) -> Column:
    """TXT1: the captures between start and end marks, joined; unchanged without a match."""
    found = F.regexp_extract_all(c, F.lit(P.BOILERPLATE), 1)
    return F.when(F.size(found) == 0, c).otherwise(F.array_join(found, "\n\n"))


def unwrap_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, P.HYPHEN_BREAK, "")


def dewrap(c: Column) -> Column:
    """TXT3: a line that starts in lower case goes on with the one before, others start a paragraph."""
    def joined(lines: Column) -> Column:
        rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), line)
        return F.concat(F.element_at(lines, 1), F.array_join(rest, ""))

    def line(x: Column) -> Column:
        x = F.trim(x, F.lit(" \t"))
        return F.concat(F.when(x.rlike("^\\p{IsLowercase}"), " ").otherwise("\n\n"), x)

    # as the variable of a function the lines are split once, however often they are named
    return F.element_at(F.transform(F.array(F.split(c, "\\n+", -1)), joined), 1)


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, P.NOT_ASCII_TEXT, "")


def clean_book(c: Column) -> Column:
    """TXT5."""
    return ascii_only(dewrap(unwrap_hyphens(strip_boilerplate(newlines(c)))))


def text_only(c: Column) -> Column:
    return F.regexp_replace(c, P.NOT_TEXT, "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{P.WS}]+", " "))


def clip_sentence(c: Column) -> Column:
    """TXT9: cut after the last sentence end that white space follows; unchanged if it ends one, or there is none."""
    cut = F.regexp_extract(c, P.SENTENCE_END, 1)
    return F.when(c.rlike("[.!?\"']$") & ~c.rlike("\\n$"), c).when(cut == "", c).otherwise(cut)


def strip_gloss(c: Column) -> Column:
    """TXT11: drops a leading pronunciation in brackets."""
    inside = F.regexp_extract(c, P.GLOSS, 2)
    return F.when(c.rlike(P.GLOSS) & inside.rlike(P.GLOSS_INSIDE), F.regexp_replace(c, P.GLOSS, "$1 ")).otherwise(c)


def dedup_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), P.NOT_WORD, "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"[{P.WS}]+"), lambda x: x != "")


def distinct_values(c: Column, pattern: str, least: int = P.MIN_VALUES) -> Column:
    """TXT23: distinct matches in order of appearance, null if fewer than ``least``."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), 0))
    return F.when(F.size(found) >= least, found)


def clean_reply(c: Column) -> Column:
    """TXT20."""
    for pattern, to in ((P.CONTROL, ""), (P.BREAKS, " "), (P.BLANKS, " "), ("�", ""), (P.BLANKS, " ")):
        c = F.regexp_replace(c, pattern, to)
    return c


def cut_at_markers(c: Column, markers=P.STOP_MARKERS) -> Column:
    for m in markers:
        c = F.substring_index(c, m, 1)
    return strip(c)


def strip_fence(c: Column) -> Column:
    return F.regexp_replace(strip(c), P.FENCE, "")


def group_key(c: Column) -> Column:
    """TXT16: the first line, or all of a text without context."""
    line = F.substring_index(c, "\n", 1)
    return F.when(line == P.NO_CONTEXT, c).otherwise(line)


def after(c: Column, marker: str) -> Column:
    """What follows the first marker; null without one."""
    at = F.instr(c, F.lit(marker)) if isinstance(marker, Column) else F.locate(marker, c)
    return F.when(at > 0, F.substring(c, at + F.length(F.lit(marker)), F.length(c)))


def prompt(context: Column, question: Column) -> Column:
    """TXT17: with and without context."""
    tail = F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))
    return F.when(context.isNull(), tail).otherwise(F.concat(F.lit("Context: "), context, F.lit("\n"), tail))


def parse_object(c: Column, schema: str) -> Column:
    """JS2: a JSON object, else the widest {...} in the text, else null."""
    t = strip_fence(c)
    strict = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.rlike("(?s)^\\{.*\\}$"), F.from_json(x, schema))
    return F.coalesce(strict(t), strict(F.regexp_extract(t, "(?s)\\{.*\\}", 0)))


def parse_pairs(c: Column) -> Column:
    """JS1: a JSON array of question and answer; empty if the text is anything else."""
    t = strip_fence(c)
    pairs = F.from_json(t, "array<struct<question:string,answer:string>>")
    fine = F.try_parse_json(t).isNotNull() & t.rlike("(?s)^\\[.*\\]$") & ~t.rlike("(?s)^\\[[^\"]*'")
    good = F.filter(pairs, lambda x: (F.coalesce(x["question"], F.lit("")) != "") & (F.coalesce(x["answer"], F.lit("")) != ""))
    return F.coalesce(F.when(fine, good), F.array().cast("array<struct<question:string,answer:string>>"))


def thousands(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).cast("double")


def quoted_lines(c: Column) -> Column:
    """TXT25: the lines in double quotes, without them and without white space and commas behind; inner quotes stay."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(strip(x), ",+$", ""))
    return F.transform(F.filter(lines, lambda x: (F.length(x) >= 2) & x.startswith('"') & x.endswith('"')), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def candidate_list(candidates: Column) -> Column:
    """TXT18: array of (rank, score, passage) in order of rank, as text: Rank i (score s): the first 400 characters."""
    one = lambda x: F.format_string("Rank %d (score %.3f): %s", x["rank"], x["score"], F.substring(x["passage"], 1, 400))
    return F.array_join(F.transform(F.array_sort(candidates), one), "\n\n")
