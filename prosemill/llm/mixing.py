"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target over its size is its repetition rate. A document's expected copies are
that rate, weighed by the bit length of its size, so fragments are repeated less than long
texts. Each document first gets its certain whole copies; what is left of its expectation is its
inclusion probability in a sample of fixed size in words: documents are ranked by random
odds divided by inclusion odds, and the first fill what the whole copies leave of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, WORD_GAP, lookup_join, staged

MAX_REPEATS = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Parts of the order of a source to a unit of the log odds, which are logistic: a part has at most 1 in 4 * PARTS documents of a weight.
PARTS = 256
#: No copies of a document beyond MAX_REPEATS, nor sizes beyond 2^(MAX_BITS - 1) words that weigh more.
MAX_BITS = 40


def word_count(text):
    """Words of a text column; 0 for null."""
    body = F.btrim(text, F.lit(SPACES))
    return F.when(text.isNull() | (body == ""), F.lit(0)).otherwise(F.size(F.split(body, WORD_GAP))).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) -> also target: weights 1, 2, 3 by code point, null last, capped.

    Source s gets min(cap_s, weight_s * x), with the x at which all targets add up to the whole
    size: sources in the order of cap over weight are capped until the share of the
    others fits. One row for each source, so one task for the windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(WEIGHTS)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), k + 1)).withColumn("cap", (MAX_REPEATS * F.col("source_size")).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    prior = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(prior), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(prior), F.lit(0.0))))
    s = s.withColumn("place", F.row_number().over(by_ratio))
    s = s.withColumn("x", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every).getField("level"))
    return s.select("source", "source_size", F.least("cap", F.col("w") * F.col("x")).alias("target"))


def expected_copies(classes: DataFrame) -> DataFrame:
    """classes(key, source, bits, words) -> key, bits, source_size, target, whole, odds, fill.

    All documents of a source whose size has the same bit length expect the same number of
    copies, least(MAX_REPEATS, bits * c), with the c at which the expected words are the source's target:
    classes are capped from the largest weight on until c of the others keeps them below
    the cap. whole is the integer part, odds are the inclusion odds of the rest (null where it is 0),
    fill is what is left of the target after all whole copies. A row for each source and bit length.
    """
    sizes = classes.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size")).withColumn("key", source_key()).drop("source")
    every = Window.partitionBy("key")
    heavier = every.orderBy(F.desc("bits")).rowsBetween(Window.unboundedPreceding, -1)
    weighed = F.col("bits") * F.col("words")
    rows = classes.drop("source").join(F.broadcast(targets) if sizes.count() <= BROADCAST_ROWS else targets, "key")
    rows = rows.withColumn("mass", F.sum(weighed).over(every) - F.coalesce(F.sum(weighed).over(heavier), F.lit(0)))
    rows = rows.withColumn("level", F.when(F.col("mass") > 0, (F.col("target") - MAX_REPEATS * F.coalesce(F.sum("words").over(heavier), F.lit(0))) / F.col("mass")))
    c = F.max(F.when(F.col("level") * F.col("bits") <= MAX_REPEATS, F.struct("bits", "level"))).over(every).getField("level")
    rows = rows.withColumn("expected", F.coalesce(F.least(F.lit(float(MAX_REPEATS)), F.col("bits") * c), F.lit(float(MAX_REPEATS))))
    f = F.col("expected") - F.floor("expected")
    rows = rows.withColumn("whole", F.floor("expected").cast("long")).withColumn("odds", F.when(f > 0, f / (1 - f)))
    return rows.withColumn("fill", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every)).select("key", "bits", "source_size", "target", "whole", "odds", "fill")


def source_key():
    """A source as a key that is not null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))


def pareto_mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs(doc_id, source, size[, tie]) -> these and source_size, target, copies, taken; a row for each row.

    A document has its whole copies (expected_copies()), and one more if its rank lets it in: rank is u / (1 - u) over its
    inclusion odds, where u is a hash of seed and doc_id; by rank, documents are let in as long as that
    brings the words of the source nearer to its target. Reruns agree. Documents of no words get their
    whole copies and take no words. A null source is a source. Null ids draw by the column tie, a digest of the text, if there is one; rows
    that agree in all of this are let in one by one, in any order. Ties of the rank go by id, then size. Empty input gives no rows. Only these columns are read.

    The order of a source is cut into parts by the logarithm of the rank. Sums of parts tell in which
    one the sample ends; only this part is sorted, so a hot source needs no more than sums.
    """
    more = ["tie"] if "tie" in docs.columns else []
    drawn = F.coalesce(F.col("doc_id").cast("string"), *map(F.col, more), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), drawn)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    base = docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), u.alias("u"), source_key().alias("_key"), *more)
    bits = F.least(F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(1), F.lit(MAX_BITS)).cast("long")
    base = staged(base.withColumn("_cell", F.concat("_key", F.lit("/"), bits)).withColumn("_bits", bits), "sizes")
    classes = staged(base.groupBy(F.col("_key").alias("key"), F.col("_bits").alias("bits")).agg(F.first("source").alias("source"), F.sum("size").alias("words")), "classes")
    expected = staged(expected_copies(classes).withColumn("_cell", F.concat("key", F.lit("/"), "bits")).drop("key", "bits"), "expected")
    rows = lookup_join(base, expected, "_cell", F.col("u"))
    rows = rows.withColumn("q", (F.col("u") / (1 - F.col("u"))) / F.col("odds")).withColumn("part", F.floor(PARTS * F.log("q")))
    # the part of each source's order in which the sample is full
    cells = rows.where("part is not null").groupBy("_key", "part").agg(F.sum("size").alias("words"), F.first("fill").alias("fill"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = cells.withColumn("ahead", ahead).where("ahead <= fill").groupBy("_key").agg(F.max(F.struct(F.col("part").alias("edge"), "ahead")).alias("e")).select("_key", "e.*")
    rows = lookup_join(rows, staged(edges, "edges"), "_key", F.col("u"))
    rest = rows.withColumn("extra", F.when(F.col("part") < F.col("edge"), 1).otherwise(0)).where("part is null or edge is null or part <> edge")
    inside = Window.partitionBy("_key").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("fill") - F.col("ahead") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = rows.where("part = edge").withColumn("extra", F.when(2 * gap >= F.col("size"), 1).otherwise(0))
    copies = F.col("whole") + F.when(F.col("size") > 0, F.col("extra")).otherwise(0)
    return rest.unionByName(last).withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; see pareto_mix() for nulls, ties, repeated rows and empty input."""
    digest = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))).alias("tie")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"), digest)
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), b AS (
  SELECT *, CASE WHEN size > 0 THEN least(length(ltrim(bin(size), '0')), 40) ELSE 1 END AS bits FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w
  FROM d GROUP BY source
), r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM r WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(level, place) FROM l WHERE level <= ratio)) AS target FROM l
), c AS (
  SELECT source, bits, CAST(sum(size) AS DOUBLE) AS words FROM b GROUP BY source, bits
), m AS (
  SELECT c.source, c.bits, c.words, t.source_size, t.target,
         sum(c.bits * c.words) OVER (PARTITION BY c.source) - coalesce(sum(c.bits * c.words) OVER heavier, 0) AS mass,
         coalesce(sum(c.words) OVER heavier, 0) AS over_words
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
  WINDOW heavier AS (PARTITION BY c.source ORDER BY c.bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, CASE WHEN mass > 0 THEN (target - 3 * over_words) / mass END AS level FROM m
), e AS (
  SELECT *, coalesce(least(3.0::DOUBLE, bits * max(CASE WHEN level * bits <= 3 THEN {'bits': bits, 'level': level} END) OVER (PARTITION BY source).level), 3.0::DOUBLE) AS expected FROM v
), x AS (
  SELECT *, floor(expected) AS whole, expected - floor(expected) AS f,
         target - sum(floor(expected) * words) OVER (PARTITION BY source) AS fill
  FROM e
), y AS (
  SELECT b.doc_id, b.size, b.source, x.source_size, x.target, x.whole, x.fill,
         CASE WHEN x.f > 0 THEN (b.u / (1 - b.u)) / (x.f / (1 - x.f)) END AS q
  FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source AND b.bits = x.bits
), z AS (
  SELECT *, fill - coalesce(sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap
  FROM y
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN q IS NOT NULL AND size > 0 AND 2 * gap >= size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM z
"""
