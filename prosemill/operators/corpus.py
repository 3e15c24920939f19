"""Splitting, ordering and shaping of document and question/answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.staging import lookup, staged


def split_records(docs: DataFrame, separator: str = P.SHARD_SEPARATOR, key: str = "doc_id", value: str = "text", strip: bool = False) -> DataFrame:
    """SRC2/SRC8: one row for each record between separators, with its place; with ``strip`` (SRC3) without white space around it."""
    quoted = "\\Q" + separator + "\\E"
    out = docs.select(key, F.posexplode(F.split(value, quoted, -1)).alias("pos", "record"))
    return out.withColumn("record", T.strip(F.col("record"))) if strip else out


def rejoin_records(records: DataFrame, key: str = "doc_id", separator: str = P.SHARD_SEPARATOR) -> DataFrame:
    """SNK2: the records of a shard in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "record")))
    return records.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["record"]), separator).alias("text"))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """WIN7/SET4: the first row of each key; a null key is a key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def exclude(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """JN1: rows whose stripped text is not among the other's; null and empty exclusions exclude nothing."""
    # a digest is shuffled, not the text: 128 bits and the length stand for it
    digest = lambda c: F.concat(F.md5(c), F.length(c).cast("string"))
    gone = other.select(T.strip(F.col(column)).alias("_t")).where("_t <> ''").select(digest(F.col("_t")).alias("_d")).distinct()
    return df.join(gone, digest(T.strip(F.col(column))) == F.col("_d"), "left_anti")


class Ordered:
    """The rows of ``df`` in one order over all ranges, each with the sum of the lengths before it.

    Rows are ranged by ``order`` once and written, so every later look sees the same ranges; inside a range a window adds up
    lengths, and the sums of the ranges, one row each, are added up beside. Rows that tie on ``order`` follow a hash of their content,
    equal rows come in any order: both are split over ranges, however many there are. Nulls come first; a null length counts 0.
    There are as many ranges as the session has shuffle partitions, or ``parts``.
    """

    def __init__(self, df: DataFrame, length: Column, order: str, parts: int | None = None):
        self.columns = df.columns
        # maps have no hash
        content = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
        self.by = [F.col(order), F.col("_tie"), F.col("_row")]
        keyed = df.withColumn("_len", F.coalesce(length.cast("long"), F.lit(0))).withColumn("_tie", content).withColumn("_row", F.monotonically_increasing_id())
        ranged = keyed.repartitionByRange(*([parts] if parts else []), *self.by).sortWithinPartitions(*self.by)
        self.rows = staged(ranged.withColumn("_part", F.spark_partition_id()), "ordered")
        before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # a row for each range
        self.sums = staged(self.rows.groupBy("_part").agg(F.sum("_len").alias("_sum")).withColumn("_before", before), "range-sums")

    def total(self) -> int:
        return self.sums.agg(F.coalesce(F.sum("_sum"), F.lit(0))).first()[0]

    def offsets(self, first_part: int = 0) -> DataFrame:
        """The columns of ``df`` and offset; of the ranges from first_part on only, if it is given."""
        rows = self.rows.where(F.col("_part") >= first_part) if first_part else self.rows
        inner = F.coalesce(F.sum("_len").over(Window.partitionBy("_part").orderBy(*self.by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        moved = lookup(rows.withColumn("_in", inner), self.sums.select("_part", "_before"), "_part", F.col("_row"), "inner")
        return moved.select(*[F.col(f"`{c}`") for c in self.columns], (F.col("_before") + F.col("_in")).alias("offset"))

    def part_of(self, offset: int) -> int:
        """The range that holds an offset."""
        return self.sums.where((F.col("_before") <= offset) & (F.col("_sum") > 0)).agg(F.coalesce(F.max("_part"), F.lit(0))).first()[0]


def offsets(df: DataFrame, length: Column, order: str, parts: int | None = None) -> DataFrame:
    """WIN2/WIN3: adds offset, the sum of the lengths of all rows before, in order; see Ordered for ties and nulls."""
    return Ordered(df, length, order, parts).offsets()


def context_safe_split(df: DataFrame, key: str, order: str, share: float) -> DataFrame:
    """ALG1: the last part is validation, but a run of equal keys over the border stays in training.

    Adds pos (from 0) and is_val. Only the ranges from the border on are read to find where its run ends.
    """
    if not 0 <= share < 1:
        raise ValueError("share must be from 0 to below 1")
    ranked = Ordered(df, F.lit(1), order)
    n = ranked.total()
    border = n - int(n * share)
    rows = ranked.offsets().withColumnRenamed("offset", "pos")
    if border >= n:
        return rows.withColumn("is_val", F.lit(False))
    near = ranked.offsets(ranked.part_of(border - 1)).select(F.col(key).alias("k"), F.col("offset").alias("pos"))
    edge = near.where(F.col("pos") == border - 1).first()[0]
    other = near.where((F.col("pos") >= border) & ~F.col("k").eqNullSafe(F.lit(edge))).agg(F.min("pos")).first()[0]
    return rows.withColumn("is_val", F.col("pos") >= F.lit(n if other is None else other))


def seeded_order(df: DataFrame, seed: int, *keys: str) -> Column:
    """SRT7/SRT8: an order that depends on seed and keys only; rows of one key follow each other by the last."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def question_pairs(turns: DataFrame) -> DataFrame:
    """conversations -> each user turn that an assistant turn follows."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    nxt = turns.withColumn("_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    return nxt.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def cap_pairs(pairs: DataFrame, least: int = 2, most: int = P.MAX_PAIRS) -> DataFrame:
    """WIN8: pairs(passage, seq, target): first pair of each target; passages with fewer than ``least`` go, at most ``most`` stay."""
    first = first_seen(pairs.withColumn("_k", F.struct("passage", "target")), "_k", "seq").drop("_k")
    n = first.withColumn("_n", F.count("*").over(Window.partitionBy("passage"))).withColumn("_i", F.row_number().over(Window.partitionBy("passage").orderBy("seq")))
    return n.where((F.col("_n") >= least) & (F.col("_i") <= most)).drop("_n", "_i")


def until_target(groups: DataFrame, n: str, order: str, target: int) -> DataFrame:
    """SRT9: groups in order until the target is reached; the one that crosses it stays whole."""
    return offsets(groups, F.col(n), order).where(F.col("offset") < target)


def round_robin(spark, rounds: int, weights=P.CATEGORY_WEIGHTS) -> DataFrame:
    """MTH8: each round a category gains its weight in credit and is given out at each 100."""
    cats = spark.createDataFrame(list(enumerate(weights)), "cat int, w int")
    r = spark.range(1, rounds + 1).withColumnRenamed("id", "round")
    return r.join(F.broadcast(cats), F.floor(F.col("round") * F.col("w") / 100) > F.floor((F.col("round") - 1) * F.col("w") / 100)).select("round", "cat")


def windows(lengths: DataFrame, size: int = 1024) -> DataFrame:
    """ARR2: starts of the whole windows that leave one id for the shifted target; none for short streams."""
    return lengths.where(F.col("n") >= size + 1).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - size - 1, F.lit(size).cast("long"))).alias("start"))


def loss_mask(full: Column, prompt: Column) -> Column:
    """ARR3: 0 for the prompt's ids, 1 after; all 1 if the prompt is no prefix."""
    p, n = F.size(prompt), F.size(full)
    fits = F.slice(full, F.lit(1), p) == prompt
    return F.when(fits, F.concat(F.array_repeat(F.lit(0), p), F.array_repeat(F.lit(1), n - p))).otherwise(F.array_repeat(F.lit(1), n))


def masked_targets(y: Column, mask: Column, ignore: int = -100) -> Column:
    """ARR4."""
    return F.zip_with(y, mask, lambda t, m: F.when(m == 1, t).otherwise(F.lit(ignore)))
