"""The corpus pipeline: five stages, each over all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns documents (doc_id, text, lang, source,
n_chars), the last one the packed pieces. run() writes each stage to the shared folder and
reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import language_id, minhash, mixing, packing, secrets
from prosemill.llm.common import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Languages that stay; None keeps every learned one. What has no letter has none.
LANGUAGES = None
#: Near duplicates share 80 % of their five-word shingles.
SHINGLE_WORDS, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an accepted language (null, empty or letterless texts) and sets lang to the predicted one; ids may be null or repeated."""
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    tagged = language_id.tag(docs, model)
    keep = F.col("lang_pred") != language_id.UNKNOWN
    if LANGUAGES is not None:
        keep &= F.col("lang_pred").isin(*LANGUAGES)
    return tagged.where(keep).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the smallest id (null last). Rows are told apart by a number of their own, so null and repeated ids neither save nor lose a row."""
    # the number is fixed once the rows are written
    rows = staged(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), shingle_words=SHINGLE_WORDS, percent=PERCENT)
    groups = rows.select("_row", "doc_id").join(found.select(F.col("doc_id").alias("_row"), "component_id").hint("shuffle_merge"), "_row")
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_first"))
    return rows.join(kept.select("_first._row").hint("shuffle_merge"), "_row").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found, at any depth of encoding, by a mark; rows are taken one by one, null texts stay."""
    clean = secrets.redact(docs)
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents to the target weights of their sources; one taken n times has n rows.

    Rows without an id are drawn by their text. Rows of one id, text and source take their copies together; no rows give none.
    """
    keyed = docs.select(*COLUMNS).withColumn("tie", F.md5(F.coalesce("text", F.lit(""))))
    mixed = mixing.pareto_mix(keyed.select("doc_id", "source", "tie", mixing.word_count(F.col("text")).alias("size")))
    copies = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("source").alias("_source")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")) & F.col("source").eqNullSafe(F.col("_source"))
    taken = keyed.join(copies, same).dropDuplicates(["doc_id", "tie", "source"])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of all rows into sequences; see packing.pack() for nulls, repeated rows and empty input."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but mixing is expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written and read again; an empty table gives no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
