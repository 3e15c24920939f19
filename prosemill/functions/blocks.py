"""A table function for SQL that parses question and answer blocks, and the extractors that a query can name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import patterns as P

Extractor = Callable[[str], list[str]]
#: Name -> pattern, or a function from a text to its values. A session's parse_blocks knows those of the time at which register() was called.
EXTRACTORS: dict[str, str | Extractor] = {"years": P.YEAR, "numbers": P.NUMBER.replace(r"\p{Nd}", r"\d")}


def add_extractor(name: str, extractor: str | Extractor) -> None:
    """MDL2: adds an extractor under a name, as a pattern or a function; a name is taken once."""
    if name in EXTRACTORS:
        raise ValueError(f"there is an extractor {name}")
    EXTRACTORS[name] = extractor


def register(spark: SparkSession, name: str = "parse_blocks") -> None:
    """Makes parse_blocks(text, extractor) known to a session's SQL.

    It gives a row for each block that is not blank: pos (from 0), status (ok, no answer), context (null for a
    closed-book block), question, answer, and the distinct values in the context, else in the question, in order of appearance. A block without an answer has nulls. A null text has no
    rows. The extractor is a constant: another name, or a column, is an error before anything runs.
    """
    known = dict(EXTRACTORS)

    class ParseBlocks:
        @staticmethod
        def analyze(text: AnalyzeArgument, extractor: AnalyzeArgument) -> AnalyzeResult:
            if text.dataType != StringType():
                raise ValueError("parse_blocks: the text must be a string")
            if not extractor.isConstantExpression or extractor.value not in known:
                raise ValueError(f"parse_blocks: the extractor must be one of {', '.join(sorted(known))}")
            s = StructType().add("pos", IntegerType(), False).add("status", StringType(), False)
            for c in ("context", "question", "answer"):
                s = s.add(c, StringType())
            return AnalyzeResult(s.add("values", ArrayType(StringType())))

        def eval(self, text: str | None, extractor: str) -> Iterator[tuple]:
            how = known[extractor]
            find = re.compile(how).findall if isinstance(how, str) else how
            for pos, block in enumerate(b for b in (text or "").split(P.END_OF_TEXT) if b.strip()):
                block = block.strip()
                head, mark, answer = block.partition("\nAnswer:")
                if not mark:
                    yield pos, "no answer", None, None, None, None
                    continue
                context, asked, question = head.partition("\nQuestion: ")
                if not asked:
                    context, question = "", head.removeprefix("Question: ")
                context = None if not context or context == P.NO_CONTEXT else context.removeprefix("Context: ")
                yield pos, "ok", context, question, answer.strip(), list(dict.fromkeys(find(context if context is not None else question)))

    spark.udtf.register(name, udtf(ParseBlocks))
