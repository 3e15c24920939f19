"""Sources and sinks of text corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

SUMMARY = "run_name string, timestamp_utc string, checkpoint string, index_dir string, rerank boolean, min_context_score double, num_factual bigint, num_factual_complex bigint, num_factual_open bigint, num_false_premise bigint, num_non_factual bigint, tally map<string,bigint>"


def read_files(spark: SparkSession, *folders: str) -> DataFrame:
    """SRC1, SRC4: path, name, folder's place, whole text; invalid UTF-8 replaced, line ends folded."""
    found = None
    for i, folder in enumerate(folders):
        d = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.lit(i).alias("folder"), T.newlines(F.col("value")).alias("text"))
        found = d if found is None else found.unionByName(d)
    return found


def file_index(spark: SparkSession, *folders: str) -> DataFrame:
    """SRC4: the files of the folders in order (folder as given, then name by code point), from metadata alone: place, folder, name, path, bytes, before (bytes of all files in front)."""
    from ..operators.corpus import Ordered

    found = None
    for i, folder in enumerate(folders):
        # the content is never selected, so no file is opened
        d = spark.read.format("binaryFile").load(folder).select(F.lit(i).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("bytes"))
        found = d if found is None else found.unionByName(d)
    ordered = Ordered(found.withColumn("_o", F.struct("folder", "name")), F.col("bytes"), "_o").offsets().withColumnRenamed("offset", "before")
    return Ordered(ordered, F.lit(1), "_o").offsets().withColumnRenamed("offset", "place").select("place", "folder", "name", "path", "bytes", "before")


def read_first(spark: SparkSession, n: int, *folders: str) -> DataFrame:
    """FLT5, SRC4: place, path, text of the first n files in order. The order is known before a byte is read, so the scan has those files only; n is a few thousand at most."""
    first = file_index(spark, *folders).where(F.col("place") < n).orderBy("place").collect()
    if not first:
        return spark.createDataFrame([], "place bigint, path string, text string")
    # the scan shows a path as a URI, with its blanks escaped, and may show the scheme in another way
    as_uri = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    places = spark.createDataFrame([(r.place, r.path, as_uri(r.path).toUri().toString()) for r in first], "place bigint, path string, _uri string")
    short = lambda c: F.regexp_replace(c, "^file:/+", "/")
    texts = spark.read.text([r.path for r in first], wholetext=True).select(F.col("_metadata.file_path").alias("_p"), T.newlines(F.col("value")).alias("text"))
    return texts.join(F.broadcast(places), short(F.col("_p")) == short(F.col("_uri"))).select("place", "path", "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: the lines that are not blank."""
    return spark.read.text(path).where(F.col("value").rlike(f"[^{P.WS}]"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: the blocks between end marks that are not blank."""
    return spark.read.option("lineSep", P.END_OF_TEXT + "\n").text(path).where(F.col("value").rlike(f"[^{P.WS}]")).select(F.col("value").alias("block"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC6, SRC16: JSON lines of a fixed schema; a bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """SRC7: run summaries, oldest first; keys that a producer leaves out are null."""
    return spark.read.schema(SUMMARY).option("multiLine", True).json(pattern).orderBy("timestamp_utc", "run_name")


def read_token_file(spark: SparkSession, path: str, dtype: str = "<u2", window: int = 1 << 20) -> DataFrame:
    """SRC9: raw little-endian ids of binary files as rows of at most ``window`` ids: path, start, ids."""
    import numpy as np
    import pandas as pd

    def cut(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                ids = np.frombuffer(content, dtype)
                for at in range(0, len(ids), window):
                    yield pd.DataFrame({"path": [path], "start": [at], "ids": [ids[at : at + window].astype("int64")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "path string, start bigint, ids array<bigint>")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """SNK1, SNK3: appends the rows whose key is not written yet; returns how many were appended, as counted by the write itself."""
    spark = df.sparkSession
    try:
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows")).write.mode("append").parquet(path)
    return seen.get["rows"]


def counted(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """AGG6, FLT13, SNK6: ``df`` and, once an action has run over it, the number of its rows for which each condition holds, of that very pass.

    A stream takes ``df.observe(name, ...)`` in the same way and shows the counts in each progress (see count_columns()).
    """
    seen = Observation()
    return df.observe(seen, *count_columns(**conditions)), seen


def count_columns(**conditions: Column) -> list[Column]:
    return [F.count("*").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]]


def write_split(df: DataFrame, path: str, is_val: str = "is_val", **conditions: Column) -> dict:
    """SNK4, SNK5, SNK6: one folder for each split and one row of counts beside: rows of each split, and those for which a further condition holds. The table is passed over once; returns the counts."""
    val = F.coalesce(F.col(is_val), F.lit(False))
    rows, seen = counted(df, val=val, train=~val, **conditions)
    rows.withColumn("split", F.when(val, "val").otherwise("train")).drop(is_val).write.partitionBy("split").mode("overwrite").parquet(f"{path}/rows")
    found = {k: v for k, v in seen.get.items() if k != "rows"}
    df.sparkSession.createDataFrame([tuple(found.values())], [*found]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return found


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def swap(df: DataFrame, path: str) -> None:
    """SNK7: replaces a table by one derived from it: written beside, the old one renamed aside, the new one renamed, the old one deleted.

    A crash leaves the table at path, or whole at path.old with the new one whole at path.new.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    store, at = _store(spark, path)
    store.delete(at(path + ".old"), True)
    if store.exists(at(path)) and not store.rename(at(path), at(path + ".old")):
        raise OSError(f"cannot move {path} aside")
    if not store.rename(at(path + ".new"), at(path)):
        raise OSError(f"cannot rename {path}.new to {path}")
    store.delete(at(path + ".old"), True)


def resume(spark: SparkSession, path: str, build) -> DataFrame:
    """SNK8: the table at path if an earlier run has finished it, else what build() gives, written there first."""
    store, at = _store(spark, path)
    if not store.exists(at(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def promote(spark: SparkSession, winner: str, canonical: str, losers: tuple[str, ...] = ()) -> None:
    """SNK11: the winner's table under the canonical name; the losers' tables go."""
    if winner != canonical:
        swap(spark.read.parquet(winner), canonical)
    store, at = _store(spark, canonical)
    for path in losers:
        if path not in (winner, canonical):
            store.delete(at(path), True)


def write_literal(df: DataFrame, column: str, order: str, name: str) -> str:
    """SNK12: a short column in order as source text of a list of JSON strings. For lists written by hand: all of it comes to the driver."""
    import json

    rows = [r[0] for r in df.orderBy(order).select(column).collect()]
    return f"{name} = [\n" + "".join(f"    {json.dumps(x, ensure_ascii=False)},\n" for x in rows) + "]\n"


def line_offsets(lines: DataFrame, order: str, value: str = "value") -> DataFrame:
    """SRC11's index: the byte at which each line of the joined file starts."""
    from ..operators.corpus import offsets

    return offsets(lines, F.octet_length(value) + 1, order)


def requested_runs(runs: DataFrame, names: list[str]) -> DataFrame:
    """JN5: the named runs in the order asked for; unknown names are an error."""
    asked = runs.sparkSession.createDataFrame(list(enumerate(names)), "place int, run_name string")
    missing = [r[0] for r in asked.join(runs, "run_name", "left_anti").select("run_name").collect()]
    if missing:
        raise ValueError(f"unknown runs: {', '.join(sorted(missing))}")
    return asked.join(runs, "run_name").orderBy("place")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Duplicate keys: the last row wins (JN7)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
