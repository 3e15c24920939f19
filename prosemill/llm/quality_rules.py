"""Host-level quality rules, in DataFrame operations only.

Each document is measured in its own row. Rule failures are summed by host, each host's
failure rate is shrunk with a beta prior fitted to all hosts (method of moments), and the
host's verdict is joined back to its documents. A host is watched where its posterior lies
above the rate of the whole corpus, so the verdict acts at any level of failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD_GAP, lookup_join, staged

#: Posterior standard deviations by which a host's shrunken rate has to lie above a bound: one is about five in six.
SURE = 1.0
#: A host surely above BLOCK loses all documents; one surely above the corpus's rate is watched and
#: loses those that fail any rule; others lose only those that fail a base rule.
BLOCK = 0.8
MIN_WORDS, MAX_REPEAT = 50, 0.5


def measures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, host, text) -> doc_id, host and the counts of the whole text.

    A null or empty text has no words and zero counts. Every row is measured for itself,
    so repeated rows and null ids or hosts keep their rows. Other columns are not read.

    A word counts as repeated if one of the 3-word windows over it occurs twice: windows
    are hashed, sorted with their places, and neighbours of equal hash give the repeated
    starts p1 < p2 < ..., which cover sum(min(3, p[i+1] - p[i])) + 3 words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", "host", text.alias("text")).select(
        "doc_id", "host",
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.btrim("text", F.lit(SPACES)).alias("body"),
    )
    step = step.select(
        "doc_id", "host", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", WORD_GAP)).alias("words"),
    )
    n = F.size("words")
    step = step.select(
        "*",
        F.when(n < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(_at("words", i), _at("words", i + 1), _at("words", i + 2))))
        .alias("windows"),
    )
    step = step.select(
        "doc_id", "host", "n_symbols", "n_lines", "n_dup_lines",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("ranked"),
    )
    m = F.size("ranked")
    starts = F.filter("ranked", lambda x, k: ((k > 0) & (_at("ranked", k - 1).getField("h") == x.getField("h"))) | ((k + 1 < m) & (_at("ranked", k + 1).getField("h") == x.getField("h"))))
    step = step.withColumn("starts", F.sort_array(F.transform(starts, lambda x: x.getField("p")))).drop("ranked")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a.getField("n") + F.least(F.lit(3), p - a.getField("last"))).alias("n"), p.alias("last")),
        lambda a: a.getField("n"),
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def rules(m: DataFrame) -> DataFrame:
    """Adds base_failed and any_failed to the measures."""
    return m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEAT * F.col("n_words"))).withColumn(
        "any_failed", F.col("base_failed") | (F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_lines")) | (F.col("word_chars") > 20 * F.col("n_words"))
    )


def host_verdicts(judged: DataFrame) -> DataFrame:
    """judged(host, any_failed) -> host, n_docs, n_failed, rate, tier (block, watch, pass).

    The prior beta(a, b) has the mean of all documents and the between-host variance of the
    raw rates; a + b is kept within 1 and 1e6, so one host, no variance or no failure are
    defined cases. The tier follows from the posterior mean less SURE posterior standard deviations.
    A null host is a host of its own. No rows give no rows.
    """
    hosts = staged(judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("any_failed").cast("long")).alias("n_failed")), "hosts")
    raw = F.col("n_failed") / F.col("n_docs")
    row = hosts.agg(F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.var_pop(raw).alias("v")).first()
    mean = (row.f or 0) / row.n if row.n else 0.0
    strength = min(max(mean * (1 - mean) / row.v - 1, 1.0), 1e6) if row.v else 1e6
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    least = F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + strength + 1))
    return hosts.withColumn("rate", rate).withColumn("tier", F.when(least > BLOCK, "block").when(least > mean, "watch").otherwise("pass"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs(doc_id, host, text) -> the measures, base_failed, any_failed, tier, kept; a row for each row.

    kept is false where a base rule fails, where the host is blocked, or where the host is
    watched and any rule fails. Hosts are grouped after each document has become one
    narrow row and join back by broadcast up to a checked number of hosts, else salted.
    """
    judged = staged(rules(measures(docs)).withColumn("_host", F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("-"))), "measures")
    tiers = host_verdicts(judged.select(F.col("_host").alias("host"), "any_failed")).select(F.col("host").alias("_host"), "tier")
    out = lookup_join(judged, tiers, "_host", F.col("doc_id"))
    kept = ~F.col("base_failed") & (F.col("tier") != "block") & ~((F.col("tier") == "watch") & F.col("any_failed"))
    return out.withColumn("kept", kept).drop("_host")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("host"), "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), d AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1
), r AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, unnest([0, 1, 2]) AS o FROM d) GROUP BY rid
), m AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
), j AS (
  SELECT *, (base_failed OR n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 20 * n_words) AS any_failed FROM b
), h AS (
  SELECT source, count(*) AS n, sum(CAST(any_failed AS BIGINT)) AS f FROM j GROUP BY source
), p AS (
  SELECT sum(f) / sum(n) AS mu, var_pop(f / n) AS v FROM h
), q AS (
  SELECT mu, CASE WHEN v > 0 THEN least(greatest(mu * (1 - mu) / v - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM p
), y AS (
  SELECT source, n, s, mu, (f + mu * s) / (n + s) AS rate FROM h, q
), z AS (
  SELECT source, mu, rate - 1.0 * sqrt(rate * (1 - rate) / (n + s + 1)) AS least FROM y
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND least <= 0.8 AND NOT (least > mu AND any_failed) AS kept
FROM j JOIN z ON j.source IS NOT DISTINCT FROM z.source
"""
