"""Tables between steps: written once to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a lookup table up to which it is broadcast; beyond, both sides are shuffled, by key and salt.
BROADCAST_ROWS, SALTS = 50_000, 32


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as a URI; only where it is unset, on one machine (tests), a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="prosemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def store(spark: SparkSession, path: str):
    """The file system of a path, and the maker of its paths."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _drop(spark: SparkSession, uri: str) -> None:
    try:
        files, at = store(spark, uri)
        files.delete(at(uri), True)
    except Exception:  # noqa: BLE001  the session has ended already
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: computed once, whatever reads it, and safe from lost executors. It goes when the driver ends."""
    spark = df.sparkSession
    uri = f"{shared_folder(spark).rstrip('/')}/prosemill-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, uri)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def lookup(left: DataFrame, right: DataFrame, on: str, salt: Column, how: str = "left") -> DataFrame:
    """Joins ``right``, with a row for each key ``on`` and cheap to count: broadcast if it is small, else shuffled by key and ``salt``, so that a key with a third of all rows is spread."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    dealt = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(dealt, [on, "_salt"], how).drop("_salt")


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
