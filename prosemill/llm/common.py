"""What the operators of this subpackage share: shared folders, guarded joins, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = "[ \\t-\\r]+"

#: Rows of a lookup table up to which it is broadcast; beyond, the join is a salted shuffle join.
BROADCAST_ROWS = 50_000
SALTS = 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    Read from ``spark.checkpoint.dir``; only where that is unset (tests, one machine)
    a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="prosemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def _drop(spark: SparkSession, uri: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder; it goes when the driver ends."""
    uri = f"{shared_folder(spark).rstrip('/')}/prosemill-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, uri)
    return uri


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    uri = scratch(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def local_path(uri: str) -> str | None:
    """The path that open() takes, or None where the folder is in a store of another kind."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, also where it isn't installed on them."""
    context = spark.sparkContext
    if getattr(context, "_prosemill_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="prosemill-")) / "prosemill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._prosemill_shipped = True


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Readies a session for Python operators: Arrow batches of at most ``rows`` rows, so that a batch of long texts stays small."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def lookup_join(left: DataFrame, right: DataFrame, on: str, salt: Column, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, which has one row for each non-null key ``on`` and is cheap to count.

    Up to ``BROADCAST_ROWS`` rows of ``right`` are broadcast. Beyond that both sides are
    shuffled by key and salt, so that a key with a third of all rows is spread over
    ``SALTS`` tasks. ``salt`` is a column of ``left`` that varies inside a key.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, [on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, root), root being the smallest node that can be reached.

    ``edges`` has two columns of one ordered type. Nulls and loops are left out. Alternates
    large-star and small-star steps, each a pre-aggregated minimum and a join, with every
    round written to the shared folder. Nothing is broadcast. Returns only nodes that have an edge.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("shuffle_merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("shuffle_merge"), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = staged(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
