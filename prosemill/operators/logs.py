"""Training-log analytics: parsing, running best, patience, schedules, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.staging import lookup, staged
from .corpus import Ordered

#: Rows of a log that follow each other and are looked through by one task.
RANGE_ROWS = 1 << 20


def parse_eval(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC14: typed rows of evaluation lines; other lines, and losses that are no number, are dropped."""
    get = lambda i: F.regexp_extract(column, P.EVAL_LINE, i)
    rows = lines.where(F.col(column).rlike(P.EVAL_LINE))
    return rows.select(get(1).cast("long").alias("step"), get(2).cast("double").alias("train_loss"), get(3).cast("double").alias("val_loss"), get(4).cast("double").alias("best_val"), T.thousands(get(5)).alias("tok_s"))


def parse_console(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC14: typed rows of console lines: step, tok_s; other lines are dropped."""
    get = lambda i: F.regexp_extract(column, P.CONSOLE_LINE, i)
    return lines.where(F.col(column).rlike(P.CONSOLE_LINE)).select(get(1).cast("long").alias("step"), T.thousands(get(2)).alias("tok_s"))


def parameter_count(layers: int, width: int, vocabulary: int, block: int, bias: bool = False) -> int:
    """AGG14: parameters of a decoder with tied embeddings: tokens and places, per layer attention, a four times wider layer and two norms, and the last norm."""
    each = 12 * width * width + 2 * width + (11 * width if bias else 0)
    return vocabulary * width + block * width + layers * each + width + (width if bias else 0)


def training_flops(params: Column, tokens: Column) -> Column:
    """MTH4."""
    return 6.0 * params.cast("double") * tokens.cast("double")


def running_best(df: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """WIN4, WIN5: best loss so far with its first step, whether the row improved, and the rows since.

    A null or NaN loss is never an improvement; before the first loss best and best_step are null and stale counts from the run's first row.
    A run may hold any share of all rows: rows are ranged by run and step, each range finds its own best, and the bests of a run's ranges before are added.
    """
    ordered = Ordered(df.withColumn("_o", F.struct(F.col(run), F.col(step))), F.lit(1), "_o")
    rows = ordered.offsets().drop("_o").withColumn("_x", F.when(F.col(loss).isNotNull() & ~F.isnan(loss), F.struct(F.col(loss).alias("loss"), F.col("offset").alias("at"), F.col(step).alias("step"))))
    rows = staged(rows, "log-order")
    # a range is a piece of the order: RANGE_ROWS rows that follow each other
    rows = rows.withColumn("_part", F.floor(F.col("offset") / RANGE_ROWS)).withColumn("_run", F.coalesce(F.col(run).cast("string"), F.lit("")))
    pieces = rows.groupBy("_part", "_run").agg(F.min("_x").alias("_m"), F.min("offset").alias("_f"))
    upto = Window.partitionBy("_run").orderBy("_part")
    pieces = pieces.select(F.struct("_part", "_run").alias("_k"), F.min("_m").over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias("_early"), F.first("_f").over(upto).alias("_start"))
    own = Window.partitionBy("_part", "_run").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = lookup(rows.withColumn("_own", F.min("_x").over(own)).withColumn("_k", F.struct("_part", "_run")), staged(pieces, "log-pieces"), "_k", F.col("offset"), "inner")
    best = F.least("_early", "_own")
    out = rows.withColumn("best", best["loss"]).withColumn("best_step", best["step"]).withColumn("improved", F.coalesce(best["at"] == F.col("offset"), F.lit(False)))
    out = out.withColumn("stale", F.col("offset") - F.coalesce(best["at"], F.col("_start") - 1))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "best", "best_step", "improved", "stale")


def early_stop(df: DataFrame, run: str, step: str, patience: int) -> DataFrame:
    """WIN6: rows of running_best() up to the first with ``patience`` stale rows; a null run has no stop."""
    stop = df.groupBy(run).agg(F.min(F.when(F.col("stale") >= patience, F.col(step))).alias("_stop")).where("_stop is not null")
    return lookup(df, staged(stop, "stops"), run, F.col(step)).where(F.col("_stop").isNull() | (F.col(step) <= F.col("_stop"))).select(df.columns)


def learning_rate(it: Column, warmup: int, total: int, peak: float, low: float) -> Column:
    """MTH1."""
    share = (it - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(it < warmup, peak * (it + 1) / warmup).when(it > total, low).otherwise(low + 0.5 * (1 + F.cos(F.pi() * share)) * (peak - low))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def scaling_floor(params: Column, tokens: Column) -> Column:
    """MTH3; without parameters or tokens it is infinite."""
    # Spark refuses to divide by zero
    part = lambda top, x: F.when(x == 0, F.lit(float("inf"))).otherwise(top / x)
    return 1.69 + part(406.4, F.pow(params, F.lit(0.34))) + part(410.7, F.pow(tokens, F.lit(0.28)))


def throughput(df: DataFrame, run: str, step: str, seconds: str, tokens_per_step: int) -> DataFrame:
    """WIN12: tokens a second since the run's first row; null there, and for a null run."""
    first = df.groupBy(run).agg(F.min(F.struct(F.col(step).alias("step"), F.col(seconds).alias("seconds"))).alias("_first"))
    steps, took = F.col(step) - F.col("_first.step"), F.col(seconds) - F.col("_first.seconds")
    return lookup(df, staged(first, "run-starts"), run, F.col(step)).withColumn("tok_s", F.when(took > 0, steps * tokens_per_step / took)).drop("_first")


def _line(x: Column, y: Column) -> list[Column]:
    """The five sums of a least-squares line."""
    return [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy")]


def fit_grid(df: DataFrame, run: str, step: str, loss: str, alphas: DataFrame) -> DataFrame:
    """alphas(run, alpha) -> run, alpha, floor, a, sse: for each exponent the best L = floor + a * t^-alpha inside the bounds.

    One aggregate: a row meets its run's exponents, whose sums are added up before they are shuffled. floor lies in [0.5, max(0.5, min L)], a in [1e-6, 1e6]; of the
    four edges of that box and its inside the least sum of squares is taken, so a bound holds exactly. Steps below 1 and losses that are no number take no part.
    """
    rows = df.where((F.col(step) > 0) & ~F.isnan(loss) & F.col(loss).isNotNull() & (F.abs(loss) < float("inf"))).select(F.col(run).alias("run"), F.log(F.col(step).cast("double")).alias("t"), F.col(loss).cast("double").alias("y"))
    meets = lookup(rows, staged(alphas.groupBy("run").agg(F.collect_list("alpha").alias("alphas")), "exponents"), "run", F.col("t"), "inner")
    each = meets.withColumn("alpha", F.explode("alphas"))
    x = F.exp(-F.col("alpha") * F.col("t"))
    s = each.groupBy("run", "alpha").agg(*_line(x, F.col("y")), F.greatest(F.min("y"), F.lit(0.5)).alias("top"))
    low_a, high_a, low_f = F.lit(1e-6), F.lit(1e6), F.lit(0.5)
    slope = lambda f: F.least(F.greatest((F.col("sxy") - f * F.col("sx")) / F.col("sxx"), low_a), high_a)
    level = lambda a: F.least(F.greatest((F.col("sy") - a * F.col("sx")) / F.col("n"), low_f), F.col("top"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    free_a = F.when(det > 1e-12 * F.col("n") * F.col("sxx"), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    free_f = (F.col("sy") - free_a * F.col("sx")) / F.col("n")
    inside = (free_a >= low_a) & (free_a <= high_a) & (free_f >= low_f) & (free_f <= F.col("top"))
    sse = lambda f, a: F.greatest(F.lit(0.0), F.col("syy") - 2 * f * F.col("sy") - 2 * a * F.col("sxy") + F.col("n") * f * f + 2 * f * a * F.col("sx") + a * a * F.col("sxx"))
    option = lambda f, a: F.struct(sse(f, a).alias("sse"), f.alias("floor"), a.alias("a"))
    edges = [option(low_f, slope(low_f)), option(F.col("top"), slope(F.col("top"))), option(level(low_a), low_a), option(level(high_a), high_a)]
    best = F.coalesce(F.when(inside, option(free_f, free_a)), F.least(*edges))
    return s.select("run", "alpha", best.alias("b"), "n").select("run", "alpha", "b.floor", "b.a", "b.sse", "n")


def fit_power_law(df: DataFrame, run: str, step: str, loss: str, rounds: int = 4, points: int = 24) -> DataFrame:
    """AGG16: L = floor + a * t^-alpha inside [0.5, min L], [1e-6, 1e6], [0.01, 3]: run, floor, a, alpha, sse.

    A grid of exponents, then ``rounds`` finer ones around each run's best, each a pass of fit_grid(): sums are gathered, never a run's
    rows, so a run may be of any size. Runs without a usable row have no row.
    """
    runs = df.select(F.col(run).alias("run")).where("run is not null").distinct()
    low, high = 0.01, 3.0
    grid = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.lit(low) * F.pow(F.lit(high / low), i / F.lit(float(points))))
    alphas, best, ratio = runs.select("run", F.explode(grid).alias("alpha")), None, (high / low) ** (1 / points)
    for i in range(rounds + 1):
        found = fit_grid(df, run, step, loss, alphas).groupBy("run").agg(F.min(F.struct("sse", "floor", "a", "alpha")).alias("b"))
        found = staged(found if best is None else found.unionByName(best).groupBy("run").agg(F.min("b").alias("b")), "fits")
        best = found
        if i < rounds:
            steps = F.array(*[F.lit(ratio ** (k / (points / 2))) for k in range(-points // 2, points // 2 + 1)])
            finer = F.transform(steps, lambda x: F.least(F.greatest(F.col("b.alpha") * x, F.lit(low)), F.lit(high)))
            alphas, ratio = best.select("run", F.explode(F.array_distinct(finer)).alias("alpha")), ratio ** (2.0 / points)
    return best.select(F.col("run").alias(run), "b.floor", "b.a", "b.alpha", "b.sse")
