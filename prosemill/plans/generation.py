"""Registered queries through the model boundary, over whole texts.

The models here are stand-ins that answer from the prompt alone, so that SQL can say what has to come out; they claim nothing
about a real model.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import generators, vectors
from ..operators.generators import GENERATORS, TRUNCATED, Generator, Reply
from .registry import WS_STRIP, _q, query, table


def _lines(prompt: str) -> list[str]:
    """The lines of the passage of a prompt that aren't blank, stripped."""
    passage = prompt.split("\n---\n", 1)[1].rsplit("\n---", 1)[0]
    return [x.strip() for x in passage.split("\n") if x.strip()]


def line_pairs(prompt: str, max_tokens: int, temperature: float | None) -> Reply:
    """A pair for each line: its first word is asked about, the line is the answer. By the number of lines the reply is fenced, broken or refused."""
    lines = _lines(prompt)
    if len(lines) % 7 == 3:
        raise generators.ModelError("refused")
    text = json.dumps([{"question": f" What follows {x.split()[0]}? ", "answer": x} for x in lines], ensure_ascii=len(lines) % 2 == 0)
    return Reply({1: f"```json\n{text}\n```", 2: text[:-1]}.get(len(lines) % 7, text))


def line_questions(prompt: str, max_tokens: int, temperature: float | None) -> Reply:
    """Each line as a question. By the number of lines the reply is one text a line instead of JSON, or cut."""
    lines = _lines(prompt)
    if len(lines) % 5 == 1:
        return Reply("[\n" + "\n".join(f'  "{x}",' for x in lines) + "\n]")
    return Reply(json.dumps(lines), TRUNCATED if len(lines) % 5 == 2 else "end")


def word_overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """Common distinct words over all distinct words, split at spaces."""
    out = []
    for a, b in pairs:
        x, y = set(a.split(" ")), set(b.split(" "))
        out.append(len(x & y) / len(x | y))
    return out


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {WS_STRIP.format('x')}), lambda x: x <> '')"
_WORD = _q(f"^[^{P.WS}]+")


@query(f"""WITH d AS (SELECT doc_id, text, {_LINES} AS ls FROM documents), s AS (SELECT *, CASE len(ls) % 7 WHEN 3 THEN 'failed' WHEN 2 THEN 'unreadable' ELSE 'ok' END AS status FROM d)
SELECT doc_id, status, CASE WHEN status = 'ok' THEN len(ls)::BIGINT ELSE 0 END AS n,
CASE WHEN status = 'ok' THEN md5(array_to_string(list_transform(ls, lambda x: 'Context: ' || text || chr(10) || 'Question: What follows ' || regexp_extract(x, {_WORD}) || '?' || chr(10) || 'Answer: ' || x || chr(10) || '<|endoftext|>' || chr(10)), '')) ELSE md5('') END AS blocks_md5 FROM s""")
def generated_pairs(spark, sf):
    context = GENERATORS["context"]
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("passage"))
    got = generators.generate(d, context, line_pairs)
    blocks = F.transform(F.coalesce("items", F.array()), lambda x: generators.block(context, x["question"], x["answer"], F.col("passage")))
    return got.select("doc_id", "status", F.size(blocks).cast("long").alias("n"), F.md5(F.array_join(blocks, "")).alias("blocks_md5"))


@query(f"""WITH t AS (SELECT conv_id, turn, {_LINES} AS ls FROM conversations)
SELECT conv_id, turn, CASE WHEN len(ls) % 5 = 2 THEN 'truncated' ELSE 'ok' END AS status, CASE WHEN len(ls) % 5 <> 2 THEN len(ls)::BIGINT END AS n,
CASE WHEN len(ls) % 5 <> 2 THEN md5(array_to_string(ls, chr(10))) END AS questions_md5 FROM t""")
def generated_questions(spark, sf):
    about = Generator("about", "Write questions about the passage.\n---\n{passage}\n---", "questions", 100, 8000)
    got = generators.generate(table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("passage")), about, line_questions)
    return got.select("conv_id", "turn", "status", F.when(F.col("items").isNotNull(), F.size("items")).cast("long").alias("n"), F.md5(F.array_join("items.question", "\n")).alias("questions_md5"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS passage_id, list_sum(list_transform(range(1, len(qv) + 1), lambda i: CAST(qv[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) AS s FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, passage_id) AS rank FROM s),
w AS (SELECT query_id, passage_id, rank, list_distinct(string_split(a.text, ' ')) AS a, list_distinct(string_split(b.text, ' ')) AS b FROM r JOIN documents a ON a.doc_id = query_id JOIN documents b ON b.doc_id = passage_id WHERE rank <= 10),
c AS (SELECT *, len(list_intersect(a, b)) AS m FROM w), p AS (SELECT *, m / (len(a) + len(b) - m) AS ce FROM c)
SELECT query_id, passage_id, round(ce, 9) AS ce_score, row_number() OVER (PARTITION BY query_id ORDER BY ce DESC, rank) AS new_rank FROM p""")
def rerank_scored(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    d = table(spark, sf, "documents").where("text is not null")
    hits = vectors.top_k(e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), e, P.TOP_K)
    two = hits.join(d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")), "query_id").join(d.select(F.col("doc_id").alias("id"), F.col("text").alias("passage")), "id")
    best = vectors.rerank(vectors.score_pairs(two, word_overlap))
    return best.select("query_id", F.col("id").alias("passage_id"), F.round("ce_score", 9).alias("ce_score"), F.col("new_rank").cast("long").alias("new_rank"))
