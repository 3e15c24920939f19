"""Registered queries over the test tables, each with the SQL that answers the same.

Shapes that the tables lack (separators, wrapped lines, marks, log lines) are made from their
rows by the same expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import corpus, evaluation, logs, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _q(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def _docs(spark, sf, c, *more):
    return table(spark, sf, "documents").select("doc_id", *more, c.alias("out"))


WS_STRIP = f"regexp_replace({{}}, {_q(f'^[{P.WS}]+|[{P.WS}]+$')}, '', 'g')"


def _text(name: str, column, sql: str) -> None:
    """A query that applies a text function to all documents."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _docs(spark, sf, column(F.col("text")))

    run.__name__ = name
    query(f"SELECT doc_id, {sql} AS out FROM documents")(run)


# vectors


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS passage_id, list_sum(list_transform(range(1, len(qv) + 1), lambda i: CAST(qv[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) AS s
      FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, passage_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, passage_id, round(s, 4) AS score, s >= 0.55 AS context_used FROM r WHERE rank <= 10""")
def flagship_retrieve_topk(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    hits = vectors.top_k(e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), e, P.TOP_K)
    gated = vectors.gate(hits, P.MIN_COSINE, "id")
    return gated.select("query_id", "rank", F.col("id").alias("passage_id"), F.round("score", 4).alias("score"), F.col("context").isNotNull().alias("context_used"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, len(embedding) AS dim FROM embeddings")
def vector_norms(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.size("embedding").cast("long").alias("dim"))


@query("""
WITH h AS (SELECT l.doc_id, l.quality, d.text, row_number() OVER (ORDER BY l.doc_id) AS r FROM labels l JOIN documents d USING (doc_id))
SELECT doc_id, length(text) AS n FROM h WHERE quality = 1""")
def lookup_passages(spark, sf):
    hits = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return hits.join(table(spark, sf, "documents"), "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


@query("""
WITH c AS (SELECT doc_id % 7 AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY n_chars DESC, doc_id) AS rank, n_chars % 5 AS ce FROM documents)
SELECT query_id, doc_id, ce AS ce_score, row_number() OVER (PARTITION BY query_id ORDER BY ce DESC, rank) AS new_rank FROM c WHERE rank <= 10""")
def rerank_candidates(spark, sf):
    w = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    c = table(spark, sf, "documents").withColumn("query_id", F.col("doc_id") % 7).withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    return vectors.rerank(c.withColumn("ce_score", F.col("n_chars") % 5)).select("query_id", "doc_id", "ce_score", F.col("new_rank").cast("long").alias("new_rank"))


# text functions

_text("clean_ascii", lambda x: T.ascii_only(x), f"regexp_replace(text, {_q(P.NOT_ASCII_TEXT)}, '', 'g')")
_text("charset_unicode", lambda x: T.text_only(x), f"regexp_replace(text, {_q(P.NOT_TEXT)}, '', 'g')")
_text("collapse_whitespace", lambda x: T.collapse(x), WS_STRIP.format(f"regexp_replace(text, {_q(f'[{P.WS}]+')}, ' ', 'g')"))
_text("prefix_slice", lambda x: F.substring(x, 1, P.PREFIX_CHARS), f"substring(text, 1, {P.PREFIX_CHARS})")
_text("newline_to_space", lambda x: F.replace(x, F.lit("\n"), F.lit(" ")), "replace(text, chr(10), ' ')")
_text("word_count", lambda x: F.size(T.words(x)).cast("long"), f"CAST(len(list_filter(regexp_split_to_array(text, {_q(f'[{P.WS}]+')}), lambda x: x <> '')) AS BIGINT)")
_text("hyphen_unwrap", lambda x: T.unwrap_hyphens(F.replace(x, F.lit("en"), F.lit("e-\n\nn"))), "regexp_replace(replace(text, 'en', 'e-' || chr(10) || chr(10) || 'n'), '-\\n+', '', 'g')")
_MARKED = "START OF THE PROJECT GUTENBERG EBOOK X\n"
_text(
    "boilerplate_strip",
    lambda x: T.strip_boilerplate(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("head\n" + _MARKED), x, F.lit("END OF THIS PROJECT GUTENBERG EBOOK tail\n" + _MARKED), F.col("lang"), F.lit("END OF THE PROJECT GUTENBERG EBOOK"))).when(F.col("doc_id") % 3 == 1, F.concat(x, F.lit(_MARKED))).otherwise(x)),
    f"CASE doc_id % 3 WHEN 0 THEN text || chr(10) || chr(10) || lang WHEN 1 THEN text || {_q(_MARKED)} ELSE text END",
)
_text("reply_cleanup", lambda x: T.clean_reply(x), f"regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, {_q(P.CONTROL)}, '', 'g'), {_q(P.BREAKS)}, ' ', 'g'), {_q(P.BLANKS)}, ' ', 'g'), chr(65533), ''), {_q(P.BLANKS)}, ' ', 'g')")
_text(
    "stop_marker_cut",
    lambda x: T.cut_at_markers(F.concat(x, F.lit("\nQuestion: more"))),
    WS_STRIP.format("string_split(string_split(string_split(text || chr(10) || 'Question: more', chr(10) || chr(10))[1], chr(10) || 'Question:')[1], chr(10) || 'Context:')[1]"),
)
_text("distinct_numbers", lambda x: F.array_join(F.array_sort(T.distinct_values(x, P.NUMBER, 1)), "|"), f"CASE WHEN len(regexp_extract_all(text, {_q(P.NUMBER)})) > 0 THEN array_to_string(list_sort(list_distinct(regexp_extract_all(text, {_q(P.NUMBER)}))), '|') END")
_text("dedup_key", lambda x: T.dedup_key(x), f"regexp_replace(lower(text), {_q(P.NOT_WORD)}, '', 'g')")
_text(
    "clip_sentence",
    lambda x: T.clip_sentence(x),
    f"""CASE WHEN regexp_matches(text, '[.!?"'']\\z') OR regexp_extract(text, {_q(P.SENTENCE_END)}, 1) = '' THEN text
    ELSE regexp_extract(text, {_q(P.SENTENCE_END)}, 1) END""",
)
_text("fence_strip", lambda x: T.strip_fence(F.concat(F.lit("```json\n"), x, F.lit("\n```"))), WS_STRIP.format("text"))
_text("prompt_template", lambda x: T.prompt(F.when(F.col("doc_id") % 2 == 0, x), F.col("lang")), "CASE WHEN doc_id % 2 = 0 THEN 'Context: ' || text || chr(10) ELSE '' END || 'Question: ' || lang || chr(10) || 'Answer:'")
_text("candidate_format", lambda x: F.format_string("Rank %d (score %.3f): %s", F.lit(1), F.col("n_chars") / 8, F.substring(x, 1, 400)), "format('Rank 1 (score {:.3f}): {}', n_chars / 8, substring(text, 1, 400))")
_text("url_label", lambda x: F.regexp_extract(F.concat(F.lit("runs/"), "source", F.lit("/")), "([^/]+)/*$", 1), "source")
_text("thousands", lambda x: F.concat(F.format_number("n_chars", 0), F.lit(" "), T.thousands(F.format_number("n_chars", 0)).cast("long").cast("string")), "format('{:,}', n_chars) || ' ' || n_chars")


@query(f"""
SELECT doc_id, p AS pos, string_split(replace(text, chr(10), {_q(P.SHARD_SEPARATOR)}), {_q(P.SHARD_SEPARATOR)})[p + 1] AS record
FROM (SELECT *, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)""")
def split_articles(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(P.SHARD_SEPARATOR)).alias("text"))
    return corpus.split_records(d).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, p AS pos, {WS_STRIP.format('string_split(text, chr(10))[p + 1]')} AS record FROM (SELECT *, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)")
def loose_records(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(P.END_OF_TEXT)).alias("text"))
    return corpus.split_records(d, P.END_OF_TEXT, strip=True).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, replace(text, chr(10), {_q(P.SHARD_SEPARATOR)}) AS text FROM documents")
def rejoin_articles(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return corpus.rejoin_records(corpus.split_records(d, "\n"))


def _dewrap_sql() -> str:
    return f"""
WITH l AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, {_q(P.NOT_ASCII_TEXT)}, '', 'g'), '\\n+') AS a FROM documents)
SELECT doc_id, a[1] || coalesce(array_to_string(list_transform(a[2:], lambda x: CASE WHEN regexp_matches(regexp_replace(x, '^[ \\t]+|[ \\t]+$', '', 'g'), '^[a-z]') THEN ' ' ELSE chr(10) || chr(10) END || regexp_replace(x, '^[ \\t]+|[ \\t]+$', '', 'g')), ''), '') AS out FROM l"""


@query(_dewrap_sql())
def dewrap(spark, sf):
    return _docs(spark, sf, T.dewrap(T.ascii_only(F.col("text"))))


@query(f"""
WITH c AS (SELECT length(text) AS b, length(regexp_replace(text, {_q(P.NOT_ASCII_TEXT)}, '', 'g')) AS a FROM documents)
SELECT count(*) AS n_in, count(*) FILTER (a >= 150) AS n_out, CAST(sum(b) AS BIGINT) AS chars_before, CAST(sum(a) FILTER (a >= 150) AS BIGINT) AS chars_after,
round(100 * (1 - sum(a) FILTER (a >= 150) / sum(b)), 6) AS pct_dropped FROM c""")
def clean_stats(spark, sf):
    c = table(spark, sf, "documents").select(F.length("text").alias("b"), F.length(T.ascii_only(F.col("text"))).alias("a"))
    kept = F.when(F.col("a") >= P.MIN_CLEAN_CHARS, F.col("a"))
    return c.agg(F.count("*").alias("n_in"), F.count(kept).alias("n_out"), F.sum("b").alias("chars_before"), F.sum(kept).alias("chars_after"), F.round(100 * (1 - F.sum(kept) / F.sum("b")), 6).alias("pct_dropped"))


@query(f"SELECT doc_id, length(text) AS n FROM documents WHERE length({WS_STRIP.format('text')}) >= 500")
def length_filter(spark, sf):
    return table(spark, sf, "documents").where(F.length(T.strip(F.col("text"))) >= P.MIN_ARTICLE_CHARS).select("doc_id", F.length("text").cast("long").alias("n"))


_COLLAPSED = WS_STRIP.format(f"regexp_replace(html, {_q(f'[{P.WS}]+')}, ' ', 'g')")


@query(f"""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN page_id % 11 = 0 THEN 'error' WHEN page_id % 7 = 0 THEN 'missing'
WHEN length({_COLLAPSED}) < 500 THEN 'short' ELSE 'ok' END AS status FROM pages) GROUP BY status""")
def passage_status(spark, sf):
    p = table(spark, sf, "pages").withColumn("raw", F.when(F.col("page_id") % 7 != 0, F.col("html")))
    return p.groupBy(evaluation.fetch_status(F.col("raw"), F.col("page_id") % 11 == 0, T.collapse(F.col("raw")), P.MIN_ARTICLE_CHARS).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY md5(text)")
def first_seen_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return corpus.first_seen(d, "h", "doc_id")


@query(f"SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.source = 'src1' AND {WS_STRIP.format('b.text')} = {WS_STRIP.format('d.text')})")
def anti_join_exclusion(spark, sf):
    d = table(spark, sf, "documents")
    return corpus.exclude(d, d.where("source = 'src1'").select("text"), "text").select("doc_id")


@query("SELECT doc_id, coalesce(sum(octet_length(encode(text)) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM documents")
def byte_offsets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return corpus.offsets(d, F.col("n") + 1, "doc_id").select("doc_id", F.col("offset").alias("byte_offset"))


@query("SELECT doc_id, unnest(range(0, n_chars - 1024, 1024)) AS start FROM documents WHERE n_chars >= 1025")
def validation_windows(spark, sf):
    return corpus.windows(table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("n")))


# questions and answers

_PAIRS = "(SELECT conv_id, turn, question, answer FROM (SELECT *, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"


@query(f"SELECT * FROM {_PAIRS}")
def qa_pairs(spark, sf):
    return corpus.question_pairs(table(spark, sf, "conversations"))


def _blocks(spark, sf):
    p = corpus.question_pairs(table(spark, sf, "conversations"))
    context = F.when(F.col("conv_id") % 3 == 0, P.NO_CONTEXT).otherwise(F.concat(F.lit("Context: c"), F.floor(F.col("conv_id") / 4).cast("string")))
    return p.select("conv_id", "turn", F.concat(context, F.lit("\nQuestion: "), "question", F.lit("\nAnswer: "), "answer").alias("block"))


_BLOCKS = f"(SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Context: N/A' ELSE 'Context: c' || CAST(floor(conv_id / 4) AS BIGINT) END || chr(10) || 'Question: ' || question || chr(10) || 'Answer: ' || answer AS block FROM {_PAIRS})"
_KEY = "CASE WHEN string_split(block, chr(10))[1] = 'Context: N/A' THEN block ELSE string_split(block, chr(10))[1] END"


@query(f"SELECT conv_id, turn, {_KEY} AS key FROM {_BLOCKS}")
def group_key(spark, sf):
    return _blocks(spark, sf).select("conv_id", "turn", T.group_key(F.col("block")).alias("key"))


@query(f"SELECT conv_id, turn, substring(block, 1, instr(block, chr(10) || 'Answer:') + 7) AS prompt, substring(block, instr(block, chr(10) || 'Answer:') + 8) AS completion FROM {_BLOCKS}")
def prompt_completion(spark, sf):
    rest = T.after(F.col("block"), "\nAnswer:")
    b = _blocks(spark, sf).withColumn("completion", rest)
    return b.select("conv_id", "turn", F.expr("substring(block, 1, length(block) - length(completion))").alias("prompt"), "completion")


@query(f"""
WITH b AS (SELECT conv_id * 1000 + turn AS o, {_KEY} AS key FROM {_BLOCKS}), p AS (SELECT *, row_number() OVER (ORDER BY o) - 1 AS pos, count(*) OVER () AS n FROM b),
e AS (SELECT *, n - CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS brd FROM p), k AS (SELECT min(pos) AS cut FROM e WHERE pos >= brd AND key <> (SELECT key FROM e WHERE pos = brd - 1))
SELECT o, pos, pos >= coalesce((SELECT cut FROM k), n) AS is_val FROM e""")
def group_split_snap(spark, sf):
    b = _blocks(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("o"), T.group_key(F.col("block")).alias("key"))
    return corpus.context_safe_split(b, "key", "o", 0.1).select("o", "pos", "is_val")


@query(f"SELECT o, row_number() OVER (ORDER BY h, o) AS pos FROM (SELECT conv_id * 1000 + turn AS o, md5('42|' || {_KEY}) AS h FROM {_BLOCKS})")
def group_shuffle(spark, sf):
    b = _blocks(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("o"), T.group_key(F.col("block")).alias("key"))
    b = b.withColumn("h", F.concat(corpus.seeded_order(b, 42, "key"), F.lpad(F.col("o").cast("string"), 20, "0")))
    return corpus.offsets(b, F.lit(1), "h").select("o", (F.col("offset") + 1).alias("pos"))


@query(f"""
WITH p AS (SELECT conv_id AS passage, turn AS seq, question[1:1] AS target FROM {_PAIRS}), f AS (SELECT passage, target, min(seq) AS seq FROM p GROUP BY 1, 2),
c AS (SELECT *, count(*) OVER (PARTITION BY passage) AS n, row_number() OVER (PARTITION BY passage ORDER BY seq) AS i FROM f)
SELECT passage, seq, target FROM c WHERE n >= 2 AND i <= 4""")
def cap_pairs(spark, sf):
    p = corpus.question_pairs(table(spark, sf, "conversations"))
    return corpus.cap_pairs(p.select(F.col("conv_id").alias("passage"), F.col("turn").alias("seq"), F.substring("question", 1, 1).alias("target"))).select("passage", "seq", "target")


@query(f"""
WITH g AS (SELECT conv_id, count(*) AS n FROM {_PAIRS} GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT conv_id, n FROM r WHERE before < 50""")
def target_limit(spark, sf):
    g = corpus.question_pairs(table(spark, sf, "conversations")).groupBy("conv_id").agg(F.count("*").alias("n"))
    return corpus.until_target(g, "n", "conv_id", 50).select("conv_id", "n")


@query("""
WITH c AS (SELECT unnest([0, 1, 2, 3, 4]) AS cat, unnest([20, 20, 30, 20, 10]) AS w), r AS (SELECT unnest(range(1, 201)) AS round)
SELECT round, cat FROM r, c WHERE floor(round * w / 100) > floor((round - 1) * w / 100)""")
def weighted_round_robin(spark, sf):
    return corpus.round_robin(spark, 200)


_JSON = """CASE item_id % 4 WHEN 0 THEN '```json' || chr(10) || '[{"question": "q' || item_id || '", "answer": "a"}, {"question": "", "answer": "b"}]' || chr(10) || '```' WHEN 1 THEN '[{"question": "q", "answer": "a"}] zz' WHEN 2 THEN 'no json' ELSE '[{"question": "x", "answer": "y"}, {"question": "z", "answer": "w"}]' END"""


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'q' || item_id || '=a' WHEN 3 THEN 'x=y|z=w' ELSE '' END AS pairs FROM benchmark")
def json_pairs(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.expr(_JSON.replace("chr(10)", "'\\n'")).alias("t"))
    return b.select("item_id", F.array_join(F.transform(T.parse_pairs(F.col("t")), lambda p: F.concat_ws("=", p["question"], p["answer"])), "|").alias("pairs"))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS correct FROM benchmark""")
def json_judgment(spark, sf):
    t = F.when(F.col("item_id") % 3 == 0, 'Sure: {"correct": true, "explanation": "e"} ok').when(F.col("item_id") % 3 == 1, '```{"correct": false}```').otherwise("none")
    return table(spark, sf, "benchmark").select("item_id", T.parse_object(t, "correct boolean, explanation string")["correct"].alias("correct"))


@query("SELECT 'factual' AS category, item_id AS pos FROM benchmark WHERE item_id < 10 UNION ALL SELECT 'open', item_id FROM benchmark WHERE item_id < 5")
def tagged_union(spark, sf):
    b = table(spark, sf, "benchmark")
    part = lambda name, n: b.where(F.col("item_id") < n).select(F.lit(name).alias("category"), F.col("item_id").alias("pos"))
    return part("factual", 10).unionByName(part("open", 5))


# evaluation

_REC = """(SELECT d.doc_id, CASE d.doc_id % 5 WHEN 0 THEN 'false_premise' WHEN 1 THEN 'non_factual' ELSE 'factual' END AS category,
CASE WHEN n_chars >= 600 THEN 'c' END AS context, l.toxic = 1 AS flag, l.quality = 1 AS good, source AS run FROM documents d LEFT JOIN labels l USING (doc_id))"""
_PREMISE = "WHEN category = 'non_factual' THEN 'non_factual' WHEN category = 'false_premise' THEN CASE WHEN flag IS NULL THEN 'judge_error' WHEN flag THEN 'premise_corrected' ELSE 'premise_accepted_hallucination' END"
_BLACK = f"CASE {_PREMISE} WHEN good IS NULL THEN 'judge_error' WHEN good THEN 'success' ELSE 'incorrect' END"


def _records(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    cat = F.when(F.col("doc_id") % 5 == 0, "false_premise").when(F.col("doc_id") % 5 == 1, "non_factual").otherwise("factual")
    return d.select("doc_id", cat.alias("category"), F.when(F.col("n_chars") >= 600, "c").alias("context"), (F.col("toxic") == 1).alias("flag"), (F.col("quality") == 1).alias("good"), F.col("source").alias("run"))


def _black(spark, sf):
    return _records(spark, sf).withColumn("label", evaluation.blackbox(F.col("category"), F.col("flag"), F.col("good")))


@query(f"SELECT doc_id, {_BLACK} AS label FROM {_REC}")
def classify_blackbox(spark, sf):
    return _black(spark, sf).select("doc_id", "label")


@query(f"""SELECT doc_id, CASE {_PREMISE} WHEN context IS NULL THEN CASE WHEN good IS NULL THEN 'judge_error' WHEN good THEN 'rag_recall_failure' ELSE 'no_context_expected' END
WHEN flag IS NULL THEN 'judge_error' WHEN NOT flag THEN 'rag_precision_failure' WHEN good THEN 'success' ELSE 'finetuning_grounding_failure' END AS label FROM {_REC}""")
def classify_whitebox(spark, sf):
    c = F.col
    return _records(spark, sf).select("doc_id", evaluation.whitebox(c("category"), c("context"), c("flag"), c("good"), c("flag"), c("good")).alias("label"))


@query(f"SELECT doc_id, CASE WHEN good IS NULL THEN 'judge_error' WHEN doc_id % 4 = 1 THEN 'rank1_reassessed_relevant' WHEN doc_id % 4 > 0 THEN 'lookup_issue' WHEN good THEN 'coverage_or_embedding_gap' ELSE 'no_coverage_expected' END AS label FROM {_REC}")
def precision_diagnosis(spark, sf):
    return _records(spark, sf).select("doc_id", evaluation.precision_diagnosis(F.col("good").isNull(), F.col("doc_id") % 4, F.col("good")).alias("label"))


@query(f"SELECT label, count(*) AS n, min(doc_id) AS first_pos FROM (SELECT doc_id, {_BLACK} AS label FROM {_REC}) GROUP BY label")
def tally(spark, sf):
    return evaluation.tally(_black(spark, sf), "label", "doc_id")


_LABELS = ("success", "incorrect", "premise_corrected", "premise_accepted_hallucination", "non_factual", "judge_error")


@query(f"SELECT run, {', '.join(f'''count(*) FILTER (label = '{x}') AS {x}''' for x in _LABELS)} FROM (SELECT run, {_BLACK} AS label FROM {_REC}) GROUP BY run")
def tally_pivot(spark, sf):
    return evaluation.pivot_counts(_black(spark, sf), "run", "label", list(_LABELS))


@query(f"""SELECT run, label, n, sum(n) OVER (PARTITION BY run ORDER BY label ROWS UNBOUNDED PRECEDING)::BIGINT - n AS bottom FROM (SELECT run, {_BLACK} AS label, count(*) AS n FROM {_REC} GROUP BY 1, 2)""")
def stacked_bottoms(spark, sf):
    return evaluation.stacked(_black(spark, sf).groupBy("run", "label").agg(F.count("*").alias("n")), "run", "label", "n").select("run", "label", "n", "bottom")


@query(f"""SELECT run, score FROM (SELECT run, count(*) FILTER ({_BLACK} IN ('success', 'premise_corrected')) AS score FROM {_REC} GROUP BY run) ORDER BY score DESC, (run = 'src3') DESC, run LIMIT 1""")
def champion(spark, sf):
    runs = _black(spark, sf).groupBy("run").agg(F.count_if(F.col("label").isin("success", "premise_corrected")).alias("score"))
    return evaluation.champion(runs.withColumn("incumbent", F.col("run") == "src3"), "score", "incumbent", "run")


@query(f"""SELECT run, score, row_number() OVER (ORDER BY score, run) AS place FROM (SELECT run, count(*) FILTER ({_BLACK} = 'success') AS score FROM {_REC} GROUP BY run)""")
def run_ranking(spark, sf):
    runs = _black(spark, sf).groupBy("run").agg(F.count_if(F.col("label") == "success").alias("score"))
    return runs.withColumn("place", F.row_number().over(Window.orderBy("score", "run")).cast("long"))


@query(f"SELECT doc_id, CASE WHEN label = 'judge_error' AND doc_id % 2 = 0 THEN 'success' ELSE label END AS label FROM (SELECT doc_id, {_BLACK} AS label FROM {_REC})")
def patch_errors(spark, sf):
    r = _black(spark, sf).select("doc_id", "label")
    return evaluation.patch(r, r.where("doc_id % 2 = 0").select("doc_id", F.lit("success").alias("label")), "doc_id", "label")


@query("""WITH o AS (SELECT item_id % 20 AS k, arg_max(text, item_id) AS passage FROM benchmark WHERE item_id % 3 <> 1 GROUP BY 1)
SELECT item_id, passage FROM benchmark LEFT JOIN o ON k = item_id""")
def override_lookup(spark, sf):
    b = table(spark, sf, "benchmark")
    status = F.when(F.col("item_id") % 3 == 0, "ok").when(F.col("item_id") % 3 == 1, "bad").otherwise("needs_review")
    o = evaluation.last_override(b.select((F.col("item_id") % 20).alias("k"), F.col("text").alias("passage"), "item_id", status.alias("status")), "k", "passage", "item_id")
    return b.select("item_id").join(o, F.col("item_id") == F.col("k"), "left").select("item_id", "passage")


# logs

_LOG = "(SELECT event_type AS run, event_id AS step, value AS loss, epoch(ts) AS s FROM events)"


def _log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))


_BEST = f"""(SELECT *, sum(CAST(improved AS INT)) OVER (PARTITION BY run ORDER BY step) AS i FROM (SELECT *, loss IS NOT NULL AND coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved,
min(loss) OVER (PARTITION BY run ORDER BY step) AS best FROM {_LOG}))"""
_STALE = "row_number() OVER (PARTITION BY run, i ORDER BY step) - CASE WHEN i = 0 THEN 0 ELSE 1 END AS stale"


@query(f"SELECT run, step, best, max(CASE WHEN improved THEN step END) OVER (PARTITION BY run ORDER BY step) AS best_step, improved, {_STALE} FROM {_BEST}")
def running_best(spark, sf):
    return logs.running_best(_log(spark, sf), "run", "step", "loss").select("run", "step", "best", "best_step", "improved", "stale")


@query(f"""WITH x AS (SELECT run, step, {_STALE} FROM {_BEST}), p AS (SELECT run, min(step) FILTER (stale >= 5) AS stop FROM x GROUP BY run)
SELECT run, step, stale FROM x JOIN p USING (run) WHERE stop IS NULL OR step <= stop""")
def early_stop(spark, sf):
    return logs.early_stop(logs.running_best(_log(spark, sf), "run", "step", "loss"), "run", "step", 5).select("run", "step", "stale")


@query(f"SELECT run, arg_min(step, (loss, step)) FILTER (loss IS NOT NULL) AS step, min(loss) AS loss FROM {_LOG} GROUP BY run")
def best_checkpoint(spark, sf):
    return _log(spark, sf).groupBy("run").agg(F.min_by("step", F.when(F.col("loss").isNotNull(), F.struct("loss", "step"))).alias("step"), F.min("loss").alias("loss"))


@query("""SELECT event_id, round(CASE WHEN event_id < 200 THEN 6e-4 * (event_id + 1) / 200 WHEN event_id > 8000 THEN 6e-5
ELSE 6e-5 + 0.5 * (1 + cos(pi() * (event_id - 200) / 7800)) * (6e-4 - 6e-5) END, 10) AS lr FROM events""")
def lr_schedule(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(logs.learning_rate(F.col("event_id"), 200, 8000, 6e-4, 6e-5), 10).alias("lr"))


@query("SELECT event_id, round(exp(least(value / 100, 20.0)), 6) AS ppl FROM events")
def perplexity(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(logs.perplexity(F.col("value") / 100), 6).alias("ppl"))


@query("SELECT doc_id, round(1.69 + 406.4 / pow(CAST(n_chars AS DOUBLE) * 1000, 0.34) + 410.7 / pow(CAST(n_chars AS DOUBLE) * 20000, 0.28), 6) AS floor FROM documents")
def scaling_floor(spark, sf):
    n = F.col("n_chars").cast("double")
    return table(spark, sf, "documents").select("doc_id", F.round(logs.scaling_floor(n * 1000, n * 20000), 6).alias("floor"))


@query("SELECT round(pow(10, 1 + 4 * i / 199.0), 4) AS x, i FROM (SELECT unnest(range(200)) AS i)")
def geometric_space(spark, sf):
    return spark.range(200).select(F.round(F.pow(F.lit(10.0), 1 + 4 * F.col("id") / 199.0), 4).alias("x"), F.col("id").alias("i"))


@query("""SELECT event_id AS step, (event_id % 400 + 100) / 100 AS train_loss, (event_id % 250 + 50) / 100 AS val_loss, (event_id % 90 + 10) / 100 AS best_val, (event_id * 7 + 1000)::DOUBLE AS tok_s
FROM events WHERE event_id % 10 <> 0 AND event_id % 7 <> 0""")
def parse_log(spark, sf):
    e, c = table(spark, sf, "events"), F.col("event_id")
    number = lambda n, low: F.format_string("%.2f", (c % n + low) / 100.0)
    loss = F.when(c % 10 == 0, "nan").otherwise(number(250, 50))
    gap = F.element_at(F.array(F.lit(" "), F.lit("  "), F.lit("\t")), (c % 3 + 1).cast("int"))
    line = F.concat(F.lit("[eval] step"), gap, c.cast("string"), F.lit("/99999 | train loss "), number(400, 100), F.lit(" (x) | val loss "), loss, F.lit(" y | best val "), number(90, 10), F.lit("@5 z | "), F.format_number(c * 7 + 1000, 0), F.lit(" tok/s"))
    return logs.parse_eval(e.select(F.when(c % 7 == 0, F.concat(F.lit("noise "), c.cast("string"))).otherwise(line).alias("value")))


@query(f"""SELECT run, step, CASE WHEN s > f THEN round((step - g) * 24576 / (s - f), 3) END AS tok_s FROM (SELECT *, first(s) OVER w AS f, first(step) OVER w AS g FROM {_LOG} WINDOW w AS (PARTITION BY run ORDER BY step))""")
def throughput(spark, sf):
    return logs.throughput(_log(spark, sf), "run", "step", "s", 24576).select("run", "step", F.round("tok_s", 3).alias("tok_s"))


_GRID = (0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0, 3.0)


def _curves(spark, sf):
    """A falling loss for each event: a run for each kind of event."""
    e = table(spark, sf, "events")
    t = F.col("event_id") + 1
    return e.select(F.col("event_type").alias("run"), t.alias("step"), (1.7 + F.pow(t.cast("double"), F.lit(-0.4)) * 5 + F.col("user_id") % 7 / 100.0).alias("loss"))


@query(f"""WITH r AS (SELECT event_type AS run, ln((event_id + 1)::DOUBLE) AS t, 1.7::DOUBLE + pow((event_id + 1)::DOUBLE, -0.4::DOUBLE) * 5 + (user_id % 7) / 100.0::DOUBLE AS y FROM events), x AS (SELECT run, alpha, exp(-alpha * t) AS x, y FROM r, (SELECT unnest({list(_GRID)})::DOUBLE AS alpha)),
s AS (SELECT run, alpha, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, greatest(min(y), 0.5) AS top FROM x GROUP BY run, alpha),
f AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS fa, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS ff FROM s),
o AS (SELECT run, alpha, n, sx, sy, sxx, sxy, syy, unnest(CASE WHEN fa BETWEEN 1e-6 AND 1e6 AND ff BETWEEN 0.5 AND top THEN [(ff, fa)] ELSE [(0.5, least(greatest((sxy - 0.5 * sx) / sxx, 1e-6), 1e6)), (top, least(greatest((sxy - top * sx) / sxx, 1e-6), 1e6)),
(least(greatest((sy - 1e-6 * sx) / n, 0.5), top), 1e-6::DOUBLE), (least(greatest((sy - 1e6 * sx) / n, 0.5), top), 1e6::DOUBLE)] END) AS p FROM f),
e AS (SELECT run, alpha, p[1] AS floor, p[2] AS a, greatest(0, syy - 2 * p[1] * sy - 2 * p[2] * sxy + n * p[1] * p[1] + 2 * p[1] * p[2] * sx + p[2] * p[2] * sxx) AS sse FROM o)
SELECT run, alpha, round(arg_min(floor, sse), 4) AS floor, round(arg_min(a, sse), 3) AS a, round(min(sse), 3) AS sse FROM e GROUP BY run, alpha""")
def fit_curve_grid(spark, sf):
    c = _curves(spark, sf)
    alphas = c.select("run").distinct().withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in _GRID])))
    return logs.fit_grid(c, "run", "step", "loss", alphas).select("run", "alpha", F.round("floor", 4).alias("floor"), F.round("a", 3).alias("a"), F.round("sse", 3).alias("sse"))


@query()  # an iterative fit: tested against planted curves
def fit_curve(spark, sf):
    return logs.fit_power_law(_curves(spark, sf), "run", "step", "loss")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


from . import generation, more  # noqa: E402, F401  register their queries here
