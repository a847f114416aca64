"""Deterministic sampling and folds: every draw is a hash of the key, never a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOD = 2147483648


def lcg(key: Column, seed: int = 0) -> Column:
    """Arithmetic hash in [0, 2**31), the same in every SQL dialect. Keys are reduced first so that the
    product stays within 64 bits."""
    return ((key + seed * 7919) % MOD * 1103515245 + 12345) % MOD


def uniform(key: Column, seed: int = 0) -> Column:
    return (lcg(lcg(key, seed)) + F.lit(0.5)) / MOD


def per_group(df: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, the first in hash order."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(lcg(lcg(F.col(key), seed)), key))
    return df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def undersampled(df: DataFrame, label: str, big: object, factor: float, key: str) -> DataFrame:
    """The big class is cut to ``factor`` times the median count of the others."""
    counts = df.groupBy(label).agg(F.count("*").alias("n")).where(F.col(label) != F.lit(big)).agg(F.percentile("n", F.lit(0.5)).alias("__m"))
    r = F.row_number().over(Window.partitionBy(label).orderBy(lcg(lcg(F.col(key))), key))
    return df.withColumn("__r", r).join(F.broadcast(counts)).where((F.col(label) != F.lit(big)) | (F.col("__r") <= F.col("__m") * factor)).drop("__r", "__m")


def negatives(pairs: DataFrame, positive: Column, n: int) -> DataFrame:
    """All positives of each source and n hashed negatives."""
    order = Window.partitionBy("src", "pos").orderBy(lcg(F.col("dst"), 3), "dst")
    return pairs.withColumn("pos", positive.cast("int")).withColumn("r", F.row_number().over(order)).where((F.col("pos") == 1) | (F.col("r") <= n)).drop("r")


def hashed_place(groups: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """(key, place): distinct groups' places in hash order, from 0. They are ordered inside 4096 ranges
    of the hash; the ranges' totals are the only global order."""
    g = groups.select(key).distinct().withColumn("__h", lcg(lcg(F.col(key), seed)))
    g = g.withColumn("__b", F.floor(F.col("__h") / (MOD // 4096)))
    n = g.groupBy("__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = n.select(F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1
    return g.withColumn("__r", inner).join(F.broadcast(before), F.col("__b") == F.col("__c")).select(key, (F.col("__before") + F.col("__r")).alias("place"))


def folds(groups: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """(key, fold): distinct groups in hash order, dealt round robin."""
    return hashed_place(groups, key, seed).select(key, (F.col("place") % k).cast("int").alias("fold"))


def balanced_folds(groups: DataFrame, key: str, k: int) -> DataFrame:
    """(key, fold): largest group first into the lightest fold. One row per group reaches the driver
    (groups are subjects or recordings)."""
    sizes = [(r[key], r["n"]) for r in groups.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).collect()]
    load, out = [0] * k, []
    for name, n in sizes:
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += n
        out.append((name, f, n))
    kind = dict(groups.dtypes)[key]
    return groups.sparkSession.createDataFrame(out, f"{key} {kind}, fold int, n long")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, balanced, inverse, root): weights by class counts."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.max("n").alias("m"))
    return c.join(F.broadcast(t)).select(label, "n", (F.col("t") / (F.col("k") * F.col("n"))).alias("balanced"), (F.lit(1.0) / F.col("n")).alias("inverse"), F.sqrt(F.col("m") / F.col("n")).alias("root"))


def confident(df: DataFrame, group: list[str], score: str, share: float) -> DataFrame:
    """Rows whose score reaches the group's (1 - share) quantile."""
    q = df.groupBy(*group).agg(F.percentile(score, F.lit(1 - share)).alias("__q"))
    return df.join(q, group).where(F.col(score) >= F.col("__q")).drop("__q")


def capped(df: DataFrame, by: list[str], key: str, cap: int) -> DataFrame:
    return per_group(df, by, key, cap)
