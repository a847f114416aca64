"""Cutting ordered samples into windows: tumbling, sliding, dense, label-pure, gap-based.

Samples are rows (session, idx, ...) with a gapless index per session; every function keeps the
session as its partitioning key, so successive steps shuffle once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def indexed(df: DataFrame, session: str, order: list[str]) -> DataFrame:
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1)


def tumbling(samples: DataFrame, session: str, size: int) -> DataFrame:
    """Adds tile ``t`` and place ``pos``; an incomplete last tile is dropped."""
    n = F.count("*").over(Window.partitionBy(session))
    return samples.withColumns({"t": F.floor(F.col("idx") / size), "pos": F.col("idx") % size, "__n": n}).where(F.col("t") < F.floor(F.col("__n") / size)).drop("__n")


def means(tiles: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """Mean ``m`` of each tile, added up by ``pos``: its last digits, by which near ties are ranked, depend on
    neither partitioning nor the way of aggregation. Nulls don't count."""
    held = [F.max(F.when(F.col("pos") == k, F.col(value))).alias(f"__{k}") for k in range(size)]
    total = sum((F.coalesce(f"__{k}", F.lit(0.0)) for k in range(1, size)), F.coalesce("__0", F.lit(0.0)))
    return tiles.groupBy(*keys).agg(F.count(value).alias("__n"), *held).select(*keys, F.when(F.col("__n") > 0, total / F.col("__n")).alias("m"))


def arrays(tiles: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """One row per tile with each column as an array ordered by ``pos``."""
    listed = F.array_sort(F.collect_list(F.struct("pos", *columns.values())))
    out = tiles.groupBy(*keys).agg(listed.alias("__s"))
    return out.select(*keys, *[F.col(f"__s.{c}").alias(name) for name, c in columns.items()])


def sliding(samples: DataFrame, session: str, size: int, stride: int) -> DataFrame:
    """Each sample once for every window it is in; incomplete windows are dropped."""
    n = F.count("*").over(Window.partitionBy(session))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / stride)).cast("int")
    last = F.floor(F.col("idx") / stride).cast("int")
    full = F.floor((F.col("__n") - size) / stride).cast("int")
    s = samples.withColumn("__n", n).where(F.col("__n") >= size)
    s = s.withColumn("w", F.explode(F.sequence(first, F.greatest(first, last)))).where((F.col("w") <= full) & (F.col("w") <= last))
    return s.withColumn("pos", F.col("idx") - F.col("w") * stride).drop("__n")


def dense_counts(samples: DataFrame, session: str, size: int, flag: Column) -> DataFrame:
    """At every start of a full window, how many of its samples have the flag: differences of a
    running sum, not a join."""
    w = Window.partitionBy(session).orderBy("idx").rowsBetween(0, size - 1)
    return samples.withColumns({"hits": F.sum(flag.cast("int")).over(w), "__k": F.count("*").over(w)}).where(F.col("__k") == size).drop("__k")


def majority(tiles: DataFrame, keys: list[str], label: str, centre: int) -> DataFrame:
    """Label that occurs most (the smallest on ties), its share, and the label at place ``centre``."""
    counts = tiles.groupBy(*keys, label).agg(F.count("*").alias("n"), F.max(F.when(F.col("pos") == centre, F.col(label))).alias("c"))
    least = F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l")))
    return counts.groupBy(*keys).agg(least.alias("x"), F.sum("n").alias("size"), F.max("c").alias("label_centre")).select(*keys, F.col("x.l").alias("label"), (-F.col("x.m") / F.col("size")).alias("purity"), "label_centre")


def label_runs(samples: DataFrame, session: str, label: str) -> DataFrame:
    """Gaps and islands: one row per run of equal labels with run, start, end (inclusive) and length."""
    w = Window.partitionBy(session).orderBy("idx")
    changed = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    marked = samples.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w))
    return marked.groupBy(session, "run").agg(F.first(label).alias(label), F.min("idx").alias("start"), F.max("idx").alias("end"), F.count("*").alias("length"))


def merged_sequence(runs: DataFrame, session: str, label: str, null: object) -> DataFrame:
    """Runs without the null label, repeats merged: the order of bouts."""
    w = Window.partitionBy(session).orderBy("start")
    kept = runs.where(F.col(label) != F.lit(null)).withColumn("__p", F.lag(label).over(w))
    first = kept.where(F.col("__p").isNull() | (F.col("__p") != F.col(label)))
    return first.withColumn("bout", F.row_number().over(w)).select(session, "bout", label, "start")


def pure_windows(runs: DataFrame, size: int, stride: int) -> DataFrame:
    """Windows on the stride's grid that lie inside one run."""
    first = F.ceil(F.col("start") / stride) * stride
    last = F.col("end") - size + 1
    fits = runs.where(first <= last)
    return fits.withColumn("w_start", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(stride).cast("long"))))


def gap_blocks(samples: DataFrame, session: str, at: str, share: float = 0.95) -> DataFrame:
    """A block ends where the gap to the next sample exceeds the session's own quantile of gaps."""
    w = Window.partitionBy(session).orderBy("idx")
    gaps = samples.withColumn("gap", F.col(at) - F.lag(at).over(w))
    limits = gaps.groupBy(session).agg(F.percentile("gap", F.lit(share)).alias("__limit"))
    joined = gaps.join(limits, session)
    return joined.withColumn("block", F.sum(F.when(F.col("gap") > F.col("__limit"), 1).otherwise(0)).over(w)).drop("__limit")


def pooled(tiles: DataFrame, session: str, mean: str, std: str, weights: tuple[int, int]) -> DataFrame:
    """Weighted pooling of each tile with the next one of its session: mean and population deviation."""
    a, b = weights
    w = Window.partitionBy(session).orderBy("t")
    m2, s2 = F.lead(mean).over(w), F.lead(std).over(w)
    both = tiles.withColumns({"m2": m2, "s2": s2}).where("m2 is not null")
    m = (F.col(mean) * a + F.col("m2") * b) / (a + b)
    second = ((F.pow(std, F.lit(2.0)) + F.pow(mean, F.lit(2.0))) * a + (F.pow("s2", F.lit(2.0)) + F.pow("m2", F.lit(2.0))) * b) / (a + b)
    return both.select(session, "t", m.alias("pooled_mean"), F.sqrt(F.greatest(second - m * m, F.lit(0.0))).alias("pooled_std"))


def interpolated(samples: DataFrame, session: str | list[str], value: str) -> Column:
    """Linear interpolation of nulls inside, nearest value at the ends, 0 without any value."""
    before = Window.partitionBy(session).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(session).orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("idx"))
    x0, x1 = F.last(value, ignorenulls=True).over(before), F.first(value, ignorenulls=True).over(after)
    i0, i1 = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
    inside = F.when(i1 > i0, x0 + (x1 - x0) * (F.col("idx") - i0) / (i1 - i0)).otherwise(x0)
    return F.coalesce(inside, x0, x1, F.lit(0.0))
