"""More registered queries: pairs and blocks, tokens, evaluation and JSON, sampling semantics."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import blocks as table_blocks
from ..functions import patterns as P
from ..functions import text as T
from ..operators import answers, corpus, evaluation, logs, pairs, sampling, tokens, vectors, vocabulary
from ..sources import binary
from ..sources.staging import shared_folder
from .registry import _BLACK, _BLOCKS, _PAIRS, _REC, WS_STRIP, _black, _blocks, _q, _records, _text, query, table

# text functions

_text(
    "strip_gloss",
    lambda x: T.strip_gloss(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Lima (pronounced "), F.col("lang"), F.lit(") "), x)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Lima ("), F.col("lang"), F.lit(") "), x)).otherwise(x)),
    "CASE doc_id % 3 WHEN 0 THEN 'Lima ' || text WHEN 1 THEN 'Lima (' || lang || ') ' || text ELSE text END",
)
_text(
    "clean_book",
    lambda x: T.clean_book(x),
    f"""(SELECT regexp_replace(a[1] || coalesce(array_to_string(list_transform(a[2:], lambda c: CASE WHEN regexp_matches(regexp_replace(c, '^[ \\t]+|[ \\t]+$', '', 'g'), '^\\p{{Ll}}') THEN ' ' ELSE chr(10) || chr(10) END || regexp_replace(c, '^[ \\t]+|[ \\t]+$', '', 'g')), ''), ''), {_q(P.NOT_ASCII_TEXT)}, '', 'g')
    FROM (SELECT regexp_split_to_array(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '-\\n+', '', 'g'), '\\n+') AS a))""",
)
# each line of a text as an item of a list
_text("list_fallback", lambda x: F.array_join(T.quoted_lines(F.concat(F.lit('"'), F.replace(x, F.lit("\n"), F.lit('",\n "')), F.lit('",,\nno quotes'))), "|"), "replace(text, chr(10), '|')")
_text(
    "tail_cut",
    lambda x: answers.cut_tail(F.split(x, " "), F.size(F.split(x, " "))),
    """(SELECT CASE WHEN p IS NULL THEN array_to_string(c, '') || '...' ELSE array_to_string(c[1:p - 1], '') || string_split(c[p], '.')[1] || '.' END
    FROM (SELECT c, nullif(list_position(list_transform(c, lambda x, i: i - 1 >= late AND contains(x, '.')), true), 0) AS p FROM (SELECT c, floor(len(c) * 0.8::DOUBLE) AS late FROM (SELECT string_split(text, ' ') AS c))))""",
)
_text(
    "debug_suffix",
    lambda x: answers.debug_suffix(F.when(F.col("doc_id") % 3 == 0, x), F.when(F.col("doc_id") % 3 < 2, F.col("n_chars") / 4), P.MIN_COSINE),
    """CASE doc_id % 3 WHEN 0 THEN chr(10) || chr(10) || '<details><summary>📄 Context used (score ' || format('{:.2f}', n_chars / 4) || ')</summary>' || chr(10) || chr(10) || text || chr(10) || chr(10) || '</details>'
    WHEN 1 THEN chr(10) || chr(10) || '<details><summary>⚠️ No context used (best score ' || format('{:.2f}', n_chars / 4) || ', below threshold 0.55)</summary></details>' ELSE '' END""",
)


@query("""WITH c AS (SELECT doc_id % 7 AS q, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS r, n_chars / 8 AS s, text FROM documents)
SELECT q, string_agg(format('Rank {} (score {:.3f}): {}', r, s, substring(text, 1, 400)), chr(10) || chr(10) ORDER BY r) AS listed FROM c WHERE r <= 5 GROUP BY q""")
def candidate_list(spark, sf):
    r = F.row_number().over(Window.partitionBy("q").orderBy("doc_id"))
    c = table(spark, sf, "documents").select((F.col("doc_id") % 7).alias("q"), "doc_id", (F.col("n_chars") / 8).alias("score"), F.col("text").alias("passage")).withColumn("rank", r).where("rank <= 5")
    return c.groupBy("q").agg(T.candidate_list(F.collect_list(F.struct("rank", "score", "passage"))).alias("listed"))


# pairs and blocks

_PLANTED = """SELECT *, CASE WHEN doc_id % 11 = 0 THEN '9999' ELSE CASE doc_id % 2 WHEN 0 THEN '18' ELSE '19' END || lpad(CAST(doc_id % 4 * 10 + doc_id % 3 AS VARCHAR), 2, '0') END AS value,
['1800', '1901', '1812', '1910', '1820', '1922', '1830', '1931', '1802', '1832'] AS vals FROM documents"""


def _valued(spark, sf):
    d = table(spark, sf, "documents")
    year = F.concat(F.when(F.col("doc_id") % 2 == 0, "18").otherwise("19"), F.lpad((F.col("doc_id") % 4 * 10 + F.col("doc_id") % 3).cast("string"), 2, "0"))
    value = F.when(F.col("doc_id") % 11 == 0, "9999").otherwise(year)
    answer = F.when(F.col("doc_id") % 13 == 0, value).when(F.col("doc_id") % 17 == 0, "nothing of the kind here").when(F.col("doc_id") % 19 == 0, F.concat(F.lit("between 1800 and "), value, F.lit(" or so"))).otherwise(F.concat(F.lit("it was in "), value))
    question = F.when(F.col("doc_id") % 23 == 0, F.concat(F.lit("Was it "), value, F.lit("?"))).when(F.col("doc_id") % 29 == 0, "").otherwise("When was it?")
    values = F.array(*[F.lit(v) for v in ("1800", "1901", "1812", "1910", "1820", "1922", "1830", "1931", "1802", "1832")])
    return d.select((F.col("doc_id") % 97).alias("passage"), F.col("doc_id").alias("seq"), value.alias("value"), question.alias("question"), answer.alias("answer"), values.alias("values"))


_VALID = f"""WITH v AS ({_PLANTED}), a AS (SELECT doc_id % 97 AS passage, doc_id AS seq, value, vals,
CASE WHEN doc_id % 13 = 0 THEN value WHEN doc_id % 17 = 0 THEN 'nothing of the kind here' WHEN doc_id % 19 = 0 THEN 'between 1800 and ' || value || ' or so' ELSE 'it was in ' || value END AS answer,
CASE WHEN doc_id % 23 = 0 THEN 'Was it ' || value || '?' WHEN doc_id % 29 = 0 THEN '' ELSE 'When was it?' END AS question FROM v),
r AS (SELECT *, CASE WHEN question = '' THEN 'malformed pair' WHEN NOT list_contains(vals, value) THEN 'unknown target' WHEN NOT contains(answer, value) THEN 'answer lacks target'
WHEN len(list_filter(regexp_extract_all(answer, {_q(P.YEAR)}), lambda x: x <> value AND list_contains(vals, x))) > 0 THEN 'sibling in answer' WHEN contains(question, value) THEN 'question leaks answer'
WHEN len(string_split(answer, ' ')) < 4 THEN 'bare answer' END AS reason FROM a),
d AS (SELECT * EXCLUDE (reason), CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY passage, reason IS NULL, CASE WHEN reason IS NULL THEN value END ORDER BY seq) > 1 THEN 'duplicate target' ELSE reason END AS reason FROM r),
n AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY passage) AS n, row_number() OVER (PARTITION BY passage, reason IS NULL ORDER BY seq) AS i FROM d),
f AS (SELECT passage, seq, CASE WHEN reason IS NULL AND n < 2 THEN 'passage yielded too few' WHEN reason IS NULL AND i > 4 THEN 'over the cap' ELSE reason END AS reason FROM n)"""


@query(f"{_VALID} SELECT passage, seq, reason FROM f")
def validate_pairs(spark, sf):
    return pairs.judge_pairs(_valued(spark, sf), P.YEAR).select("passage", "seq", "reason")


@query(f"{_VALID} SELECT reason, count(*) AS n FROM f WHERE reason IS NOT NULL GROUP BY reason")
def rejection_counts(spark, sf):
    return pairs.judge_pairs(_valued(spark, sf), P.YEAR).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no context here' ELSE 'Context: First of ' || lang || '. Then ' || source || CASE WHEN doc_id % 3 = 1 THEN ' cut' ELSE '.' END || chr(10) || 'Question: q' || doc_id END AS block FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'Context: First of ' || regexp_extract(block, 'of (.*)\\. Then', 1) || '.' || chr(10) || 'Question: q' || doc_id ELSE block END AS block, doc_id % 3 = 1 AS changed FROM b""")
def context_rewrite(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    block = F.concat(F.lit("Context: First of "), "lang", F.lit(". Then "), "source", F.when(i % 3 == 1, " cut").otherwise("."), F.lit("\nQuestion: q"), i.cast("string"))
    b = d.select("doc_id", F.when(i % 3 == 0, "no context here").otherwise(block).alias("old"))
    return b.withColumn("block", pairs.rewrite_context(F.col("old"))).select("doc_id", "block", (F.col("block") != F.col("old")).alias("changed"))


@query(f"SELECT CASE conv_id % 5 WHEN 0 THEN 'blank' WHEN 1 THEN 'no answer' ELSE 'ok' END AS status, count(*) AS n FROM {_BLOCKS} GROUP BY 1")
def block_counts(spark, sf):
    b = _blocks(spark, sf).withColumn("b", F.when(F.col("conv_id") % 5 == 0, F.lit(" \n\t")).when(F.col("conv_id") % 5 == 1, F.substring_index("block", "\nAnswer:", 1)).otherwise(F.col("block")))
    return b.groupBy(pairs.block_status(F.col("b")).alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS pairs, count(DISTINCT conv_id) AS contexts, count(*) / greatest(count(DISTINCT conv_id), 1) AS average FROM {_PAIRS}")
def pairs_per_context(spark, sf):
    return pairs.pairs_per_context(corpus.question_pairs(table(spark, sf, "conversations")), "conv_id")


@query("""SELECT part, id, row_number() OVER (ORDER BY part, id) - 1 AS pos FROM (SELECT 0 AS part, item_id AS id FROM benchmark UNION ALL SELECT 1, doc_id FROM documents WHERE lang = 'fr')""")
def ordered_concat(spark, sf):
    b = table(spark, sf, "benchmark").select(F.lit(0).alias("part"), F.col("item_id").alias("id"))
    d = table(spark, sf, "documents").where("lang = 'fr'").select(F.lit(1).alias("part"), F.col("doc_id").alias("id"))
    return pairs.concat_in_order([b, d], "id").select("part", "id", "pos")


@query(f"SELECT doc_id, 0 AS priority, 4 AS pairs FROM (SELECT doc_id, {_BLACK} AS label FROM {_REC}) WHERE label = 'incorrect' UNION ALL SELECT doc_id, 1, 2 FROM documents WHERE lang = 'en'")
def prioritized_union(spark, sf):
    failing = _black(spark, sf).where("label = 'incorrect'").select("doc_id")
    return pairs.prioritized(failing, table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), 4, 2)


@query(f"SELECT doc_id FROM (SELECT doc_id, {_BLACK} AS label FROM {_REC}) WHERE label = 'incorrect'")
def failed_rows(spark, sf):
    return _black(spark, sf).where("label = 'incorrect'").select("doc_id")


@query("SELECT DISTINCT source FROM documents ORDER BY source LIMIT 7")
def first_names(spark, sf):
    return pairs.first_n(table(spark, sf, "documents").select("source").distinct(), "source", 7)


@query("SELECT h, min(doc_id) AS doc_id FROM (SELECT md5(text) AS h, doc_id, source FROM documents) GROUP BY h HAVING h NOT IN (SELECT md5(text) FROM documents WHERE source = 'src2')")
def membership(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("h"), "doc_id", "source")
    return pairs.members_not_seen(d.select("h", "doc_id"), d.where("source = 'src2'"), "h", "doc_id").select("h", "doc_id")


@query("SELECT unnest([0, 1, 2, 3, 4]) AS cat, unnest([20, 20, 30, 20, 10]) AS w")
def category_table(spark, sf):
    return spark.createDataFrame(list(enumerate(P.CATEGORY_WEIGHTS)), "cat int, w int")


@query(f"""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'c' || CAST(floor(conv_id / 4) AS BIGINT) END AS context, question, {WS_STRIP.format('answer')} AS answer,
len(list_distinct(regexp_extract_all(CASE WHEN conv_id % 3 = 0 THEN question ELSE 'c' || CAST(floor(conv_id / 4) AS BIGINT) END, {_q(P.YEAR)})))::INTEGER AS n_values FROM {_PAIRS}""")
def parsed_blocks(spark, sf):
    table_blocks.register(spark)
    _blocks(spark, sf).createOrReplaceTempView("question_blocks")
    return spark.sql("SELECT b.conv_id, b.turn, p.context, p.question, p.answer, size(p.values) AS n_values FROM question_blocks b, LATERAL parse_blocks(b.block, 'years') p WHERE p.status = 'ok'")


# evaluation, runs and JSON


@query(f"SELECT doc_id, category, {_BLACK} AS classification FROM {_REC}")
def rejudge(spark, sf):
    r = _records(spark, sf).withColumn("score", F.lit(0.5)).withColumn("classification", F.lit("old")).withColumn("judgment", F.lit("{}"))
    return evaluation.rejudge(r, "category", F.col("flag"), F.col("good")).select("doc_id", "category", "classification")


@query("""WITH s AS (SELECT source, max(lang) AS checkpoint FROM documents WHERE source < 'src2' GROUP BY source)
SELECT DISTINCT d.source AS run, coalesce(s.checkpoint, 'unknown checkpoint') AS checkpoint FROM documents d LEFT JOIN s ON s.source = d.source""")
def source_checkpoint(spark, sf):
    d = table(spark, sf, "documents")
    s = d.where("source < 'src2'").groupBy(F.col("source").alias("run_name")).agg(F.max("lang").alias("checkpoint"))
    return evaluation.with_checkpoint(d.select(F.col("source").alias("run")).distinct(), s, "run", P.UNKNOWN_CHECKPOINT)


@query("SELECT DISTINCT source AS run, CASE source WHEN 'src1' THEN 'first run' WHEN 'src3' THEN 'third run' ELSE source END AS label FROM documents")
def run_labels(spark, sf):
    labels = spark.createDataFrame([("src1", "first run"), ("src3", "third run")], "run string, label string")
    return evaluation.labelled(table(spark, sf, "documents").select(F.col("source").alias("run")).distinct(), labels, "run")


_TALLY = f"(SELECT run, label, count(*) AS n FROM (SELECT run, {_BLACK} AS label FROM {_REC}) GROUP BY run, label)"


@query(f"SELECT run, string_agg(label || '=' || n, '|' ORDER BY label) AS tally FROM {_TALLY} GROUP BY run")
def tally_map(spark, sf):
    t = evaluation.tally_map(_black(spark, sf), "run", "label")
    return t.select("run", F.array_join(F.transform(F.array_sort(F.map_entries("tally")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), "|").alias("tally"))


@query(f"SELECT run, coalesce(sum(n) FILTER (label = 'judge_error'), 0)::BIGINT AS errors, 0::BIGINT AS unknown FROM {_TALLY} GROUP BY run")
def map_default(spark, sf):
    t = evaluation.tally_map(_black(spark, sf), "run", "label")
    get = lambda k: F.coalesce(F.try_element_at("tally", F.lit(k)), F.lit(0)).cast("long")
    return t.select("run", get("judge_error").alias("errors"), get("no such label").alias("unknown"))


@query(f"WITH t AS (SELECT run, label, CASE WHEN label = 'success' THEN 0 ELSE n END AS n FROM {_TALLY}) SELECT run, label, n FROM t WHERE label IN (SELECT label FROM t GROUP BY label HAVING max(n) > 0)")
def nonzero_series(spark, sf):
    t = _black(spark, sf).groupBy("run", "label").agg(F.count("*").alias("n"))
    return evaluation.nonzero(t.withColumn("n", F.when(F.col("label") == "success", 0).otherwise(F.col("n")).cast("long")), "label", "n").select("run", "label", "n")


@query("""WITH c AS (SELECT doc_id % 31 AS q, row_number() OVER (PARTITION BY doc_id % 31 ORDER BY n_chars DESC, doc_id) AS rank, lang = 'de' AS fine FROM documents)
SELECT q, min(rank) FILTER (fine) AS first_rank FROM c WHERE rank <= 10 GROUP BY q""")
def first_relevant_rank(spark, sf):
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n_chars"), "doc_id")).cast("long")
    c = table(spark, sf, "documents").withColumn("q", F.col("doc_id") % 31).withColumn("rank", r).where("rank <= 10").withColumn("fine", F.col("lang") == "de")
    return evaluation.first_relevant(c, "q", "rank", "fine")


@query("SELECT item_id, CASE item_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false END AS truth FROM benchmark")
def truthiness(spark, sf):
    values = ("true", "false", '"false"', '""', "3", "null")
    j = F.element_at(F.array(*[F.lit(f'{{"correct": {v}}}') for v in values], F.lit("{}"), F.lit("no json")), (F.col("item_id") % 8 + 1).cast("int"))
    return table(spark, sf, "benchmark").select("item_id", evaluation.truthy(j, "correct").alias("truth"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE NULL END AS extract FROM pages")
def api_extract(spark, sf):
    i = F.col("page_id")
    page = F.concat(F.lit('{"query": {"pages": {"'), i.cast("string"), F.lit('": {"extract": "'), "url", F.lit('"}}}}'))
    body = F.when(i % 4 == 0, page).when(i % 4 == 1, '{"query": {"pages": {"-1": {"extract": "x"}}}}').when(i % 4 == 2, '{"query": {"pages": {"7": {"missing": ""}}}}').otherwise("gateway error")
    return table(spark, sf, "pages").select("page_id", answers.api_extract(body).alias("extract"))


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","context_used":' || CASE WHEN n_chars >= 600 THEN 'true' ELSE 'false' END || '}' AS record FROM documents""")
def to_json_record(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", (F.col("n_chars") >= 600).alias("context_used"))).alias("record"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS stamp, strftime(ts, '%Y%m%d_%H%M%S') AS run_name FROM events")
def utc_stamp(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("stamp"), F.date_format(ts, "yyyyMMdd_HHmmss").alias("run_name"))


@query("""WITH o AS (SELECT text AS question, text AS passage FROM benchmark WHERE item_id % 3 = 0)
SELECT b.item_id, b.item_id % 3 = 0 AS has_context, b.item_id % 3 <> 0 AND b.item_id % 5 <> 0 AS missing_override FROM benchmark b""")
def context_switch(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.concat("text", F.col("item_id").cast("string")).alias("question"), F.when(F.col("item_id") % 5 == 0, "non_factual").otherwise("factual").alias("category"))
    out = answers.choose_context(b, "override", overrides=b.where("item_id % 3 = 0").select("question", F.col("question").alias("passage")))
    return out.select("item_id", F.col("context").isNotNull().alias("has_context"), "missing_override")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, list_sum(list_transform(range(1, len(qv) + 1), lambda i: CAST(qv[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))) AS s FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM s)
SELECT query_id, id, round(s, 4) AS score, s >= 0.55 AS used FROM r JOIN documents ON doc_id = id WHERE n = 1""")
def best_passage(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage"))
    best = answers.best_passage(e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), e, p)
    return best.select("query_id", "id", F.round("score", 4).alias("score"), F.col("context").isNotNull().alias("used"))


# logs, schedules and scalars


@query("SELECT event_id AS step, (event_id * 3 + 100)::DOUBLE AS tok_s FROM events WHERE event_id % 2 = 0")
def parse_console(spark, sf):
    i = F.col("event_id")
    line = F.concat(F.lit("[console] step \t"), i.cast("string"), F.lit("/9 loss 1.0 | "), F.format_number(i * 3 + 100, 0), F.lit(" tok/s"))
    return logs.parse_console(table(spark, sf, "events").select(F.when(i % 2 == 0, line).otherwise("[eval] step 1").alias("value")))


@query("SELECT event_id AS step, row_number() OVER (ORDER BY event_id % 100, event_id) - 1 AS pos FROM events")
def log_order(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.struct((F.col("event_id") % 100).alias("s"), "event_id").alias("o"))
    return corpus.offsets(e, F.lit(1), "o").select("step", F.col("offset").alias("pos"))


@query("SELECT event_id, 6.0::DOUBLE * 1100000000 * (event_id * 24 * 1024)::DOUBLE AS flops FROM events")
def training_flops(spark, sf):
    return table(spark, sf, "events").select("event_id", logs.training_flops(F.lit(1100000000), F.col("event_id") * 24 * 1024).alias("flops"))


@query("SELECT layers, 50257 * 768 + 1024 * 768 + layers * (12 * 768 * 768 + 2 * 768) + 768 AS params FROM (SELECT unnest(range(1, 25)) AS layers)")
def parameter_count(spark, sf):
    return spark.createDataFrame([(i, logs.parameter_count(i, 768, 50257, 1024)) for i in range(1, 25)], "layers bigint, params bigint")


@query("SELECT event_id, greatest(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE (event_id % 90)::DOUBLE END, pow(2.0, least(event_id % 9, 6))) AS seconds FROM events")
def backoff(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", answers.backoff(i % 9, F.when(i % 3 != 0, i % 90)).alias("seconds"))


@query("SELECT event_id, event_id > 0 AND event_id % 10 = 0 AS console, event_id > 0 AND event_id % 250 = 0 AS eval, event_id > 0 AND event_id % 1000 = 0 AS checkpoint FROM events")
def cadences(spark, sf):
    return table(spark, sf, "events").select("event_id", *answers.cadences(F.col("event_id"), console=10, eval=250, checkpoint=1000))


@query("""SELECT event_id, user_id, last_value(CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END IGNORE NULLS) OVER w AS context, last_value(CASE WHEN event_id % 7 = 0 THEN event_id % 2 = 0 END IGNORE NULLS) OVER w AS speak
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def session_toggles(spark, sf):
    kind = F.col("event_type")
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(kind == "click", True).when(kind == "view", False).alias("context"), F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 2 == 0).alias("speak"))
    return answers.toggles(e, "user_id", "event_id")


@query("SELECT doc_id, greatest(1, floor(floor(3.5::DOUBLE * n_chars / 24576.0)))::BIGINT AS steps FROM documents")
def max_steps(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sampling.max_steps(F.lit(3.5), F.col("n_chars"), F.lit(24576.0)).cast("long").alias("steps"))


@query()  # an iterative training: tested against one merge after the other
def bpe_merges(spark, sf):
    tokens_by_id, merges = vocabulary.train_bpe(table(spark, sf, "documents"), 512)
    rows = [(i, a, b, new, tokens_by_id[new], n) for i, (a, b, new, n) in enumerate(merges)]
    return spark.createDataFrame(rows, "place int, left_id int, right_id int, id int, token string, n bigint")


# tokens and sampling; ids are the code points of the words' first letters, so that SQL has the same

_IDS = "list_transform(string_split(text, ' '), lambda x: CASE WHEN x = '' THEN 0 ELSE unicode(x) END)"


def _ids(spark, sf, *more):
    ids = F.transform(F.split("text", " "), lambda x: F.when(x == "", 0).otherwise(F.ascii(x)).cast("int"))
    return table(spark, sf, "documents").select("doc_id", ids.alias("ids"), *more)


@query(f"SELECT doc_id, len(ids) + 1 AS n, ids[-1] AS last, 50256 AS appended FROM (SELECT doc_id, {_IDS} AS ids FROM documents)")
def end_appended(spark, sf):
    d = _ids(spark, sf).withColumn("e", tokens.with_end(F.col("ids"), 50256))
    return d.select("doc_id", F.size("e").cast("long").alias("n"), F.element_at("e", -2).alias("last"), F.element_at("e", -1).alias("appended"))


@query(f"SELECT CAST(sum(len(ids) + 1) AS BIGINT) AS tokens, count(*) AS rows FROM (SELECT {_IDS} AS ids FROM documents)")
def token_totals(spark, sf):
    return sampling.token_totals(_ids(spark, sf), "ids")


@query(f"""WITH t AS (SELECT doc_id, len({_IDS}) AS n FROM documents), o AS (SELECT *, sum(n) OVER (ORDER BY doc_id) - n AS before, sum(n) OVER () AS total FROM t),
b AS (SELECT *, total - CAST(floor(total * 0.1::DOUBLE) AS BIGINT) AS border FROM o)
SELECT doc_id, before::BIGINT AS offset, greatest(least(border - before, n), 0)::BIGINT AS n_train, (n - greatest(least(border - before, n), 0))::BIGINT AS n_val FROM b""")
def stream_split(spark, sf):
    s = tokens.stream_split(_ids(spark, sf), "ids", "doc_id", 0.1)
    return s.select("doc_id", "offset", F.size("train").cast("long").alias("n_train"), F.size("val").cast("long").alias("n_val"))


@query(f"""WITH f AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, id FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM (SELECT doc_id, {_IDS} AS ids FROM documents))),
t AS (SELECT count(*) - CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) AS n FROM f)
SELECT pos // 64 * 64 AS start, CAST(sum(id) AS BIGINT) AS x_sum, CAST(sum(next) AS BIGINT) AS y_sum FROM (SELECT pos, id, lead(id) OVER (ORDER BY pos) AS next FROM f) CROSS JOIN t WHERE pos // 64 * 64 + 64 < n GROUP BY pos // 64""")
def ids_windows(spark, sf):
    folder = f"{shared_folder(spark)}/prosemill-ids-{uuid.uuid4().hex}"
    binary.write_ids(_ids(spark, sf), folder, "ids", "doc_id", 0.1, 65_536)
    d = binary.read_ids(spark, f"{folder}/train_ids.bin", "<u4", window=64)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select("start", total("x").alias("x_sum"), total("y").alias("y_sum"))


@query(f"""SELECT doc_id, array_to_string(ids[s + 1:s + 8], ' ') AS x, array_to_string(ids[s + 2:s + 9], ' ') AS y FROM (SELECT doc_id, {_IDS} AS ids, doc_id % 5 AS s FROM documents) WHERE len(ids) > s + 8""")
def shifted_windows(spark, sf):
    d = _ids(spark, sf).where(F.size("ids") > F.col("doc_id") % 5 + 8)
    x, y = tokens.shifted_window(F.col("ids"), (F.col("doc_id") % 5).cast("int"), 8)
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    return d.select("doc_id", text(x).alias("x"), text(y).alias("y"))


@query(f"""WITH t AS (SELECT doc_id, {_IDS} AS ids FROM documents), p AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN [-1] ELSE ids[1:doc_id % 4] END AS prompt FROM t)
SELECT doc_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN doc_id % 4 <> 0 AND i <= len(prompt) THEN 0 ELSE 1 END), '') AS mask,
array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN doc_id % 4 <> 0 AND i <= len(prompt) THEN -100 ELSE ids[i] END), ' ') AS targets FROM p""")
def loss_mask(spark, sf):
    d = _ids(spark, sf).withColumn("prompt", F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(-1))).otherwise(F.slice("ids", F.lit(1), (F.col("doc_id") % 4).cast("int"))))
    d = d.withColumn("m", corpus.loss_mask(F.col("ids"), F.col("prompt")))
    text = lambda c, by: F.array_join(F.transform(c, lambda i: i.cast("string")), by)
    return d.select("doc_id", text(F.col("m"), "").alias("mask"), text(corpus.masked_targets(F.col("ids"), F.col("m")), " ").alias("targets"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * i / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))))), 5) AS projected FROM embeddings")
def unit_vectors(spark, sf):
    u = vectors.unit(F.transform("embedding", lambda x: x * 2))
    weighed = F.zip_with(u, F.sequence(F.lit(1), F.size("embedding")), lambda x, i: x * i)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x), 5).alias("projected"))


_LOGITS = "(SELECT vec_id AS k, i AS token, round(CAST(embedding[i] AS DOUBLE), 1) + 0::DOUBLE AS logit FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def _logits(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("p", "v"))
    return e.select("k", (F.col("p") + 1).cast("long").alias("token"), (F.round(F.col("v").cast("double"), 1) + F.lit(0.0)).alias("logit"))


@query(f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY logit DESC) AS r FROM {_LOGITS}) SELECT k, token, round(exp(logit / 0.8) / sum(exp(logit / 0.8)) OVER (PARTITION BY k), 6) AS p FROM r WHERE r <= 10""")
def top_k_softmax(spark, sf):
    return sampling.top_k_softmax(_logits(spark, sf), "k", 10, 0.8).select("k", "token", F.round("p", 6).alias("p"))


@query(f"SELECT k, token, round(CASE WHEN token % 3 <> 0 THEN logit WHEN logit > 0 THEN logit / 1.3 ELSE logit * 1.3 END, 6) + 0::DOUBLE AS logit FROM {_LOGITS}")
def repetition_penalty(spark, sf):
    return _logits(spark, sf).select("k", "token", (F.round(sampling.penalize(F.col("logit"), F.col("token") % 3 == 0, 1.3), 6) + F.lit(0.0)).alias("logit"))


@query("SELECT round(avg(m), 6) AS loss FROM (SELECT avg(value) AS m FROM events GROUP BY event_id % 37)")
def mean_of_means(spark, sf):
    e = table(spark, sf, "events").withColumn("batch", F.col("event_id") % 37)
    return sampling.mean_of_means(e, "batch", "value").select(F.round("loss", 6).alias("loss"))


@query("SELECT event_type, round(avg(CASE WHEN event_id % 4 <> 0 THEN value END), 6) AS loss FROM events GROUP BY event_type")
def masked_mean(spark, sf):
    e = table(spark, sf, "events").withColumn("target", F.when(F.col("event_id") % 4 == 0, -100).otherwise(F.col("event_id")))
    return e.groupBy("event_type").agg(F.round(sampling.masked_mean(F.col("value"), F.col("target")), 6).alias("loss"))
