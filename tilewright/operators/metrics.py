"""Evaluation: confusion, F1, agreement, AUC, chi-square, bootstrap, class profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import MOD, lcg


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def f1_by_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(class, tp, fp, fn, f1) of the classes in truth or guess."""
    c = confusion(df, truth, guess)
    tall = c.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit("t").alias("side")), F.struct(F.col("guess").alias("class"), F.lit("g").alias("side")))).alias("x"), "truth", "guess", "n").select("x.class", "x.side", "n", (F.col("truth") == F.col("guess")).alias("hit"))
    by = tall.groupBy("class").agg(F.sum(F.when((F.col("side") == "t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when((F.col("side") == "g") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when((F.col("side") == "t") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fn"))
    return by.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro_f1(df: DataFrame, truth: str, guess: str, classes: int | None = None) -> DataFrame:
    """Mean of the classes' F1: over those present, or over a fixed number of classes."""
    by = f1_by_class(df, truth, guess)
    mean = F.avg("f1") if classes is None else F.sum("f1") / classes
    return by.agg(mean.alias("macro_f1"), (F.sum("tp") / (F.sum("tp") + F.sum("fn"))).alias("accuracy"))


def agreement(votes: DataFrame) -> DataFrame:
    """(a, b, share) of every two voters from rows (id, voter, label). The few voters of an id meet in a
    self-join on the id."""
    x, y = votes.select("id", F.col("voter").alias("a"), F.col("label").alias("la")), votes.select("id", F.col("voter").alias("b"), F.col("label").alias("lb"))
    return x.join(y, "id").groupBy("a", "b").agg(F.avg((F.col("la") == F.col("lb")).cast("int")).alias("share"))


BINS = 4096


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC by rank sums, average ranks on ties. Scores are counted first; distinct ones
    are ordered inside ``BINS`` ranges of equal width, whose totals are the only global order."""
    by = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("int")).alias("p"))
    ends = by.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    binned = by.join(F.broadcast(ends)).withColumn("__b", F.coalesce(F.least(F.floor((F.col(score) - F.col("__lo")) / F.nullif(width, F.lit(0.0)) * BINS), F.lit(BINS - 1)), F.lit(0)))  # one row
    totals = binned.groupBy("__b").agg(F.sum("n").alias("all"))
    before = totals.select(F.col("__b").alias("__c"), F.coalesce(F.sum("all").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("__b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    inner = binned.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    ranked = inner.join(F.broadcast(before), F.col("__b") == F.col("__c")).withColumn("rank", F.col("before") + F.col("below") + (F.col("n") + 1) / 2)  # BINS rows at most
    s = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Correlation of average ranks within each group."""

    def rank(c):
        w = Window.partitionBy(by)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2

    return df.withColumns({"__x": rank(x), "__y": rank(y)}).groupBy(by).agg(F.corr("__x", "__y").alias("rho"), F.corr(x, y).alias("r"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    c = df.groupBy(a, b).agg(F.count("*").alias("n"))
    row, col = c.groupBy(a).agg(F.sum("n").alias("ra")), c.groupBy(b).agg(F.sum("n").alias("cb"))
    total = c.agg(F.sum("n").alias("t"))
    # every cell, also the empty ones: both keys have few values (they are classes)
    cells = row.join(F.broadcast(col)).join(F.broadcast(total)).join(c, [a, b], "left").fillna(0, ["n"])
    e = F.col("ra") * F.col("cb") / F.col("t")
    return cells.agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("chi2"), ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("df"))


def bootstrap(df: DataFrame, group: str, value: str, draws: int, seed: int) -> DataFrame:
    """(lo, mid, hi) of the mean over resampled groups. Each group is reduced to a count and a sum
    first; a draw takes groups by hashed places."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    placed = g.withColumn("place", F.row_number().over(Window.orderBy(group)) - 1)
    size = g.count()
    picks = df.sparkSession.range(draws * size).select(F.floor(F.col("id") / size).alias("draw"), F.floor(lcg(lcg(F.col("id"), seed)) / MOD * size).alias("place"))
    means = picks.join(placed, "place").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return means.agg(q.alias("q")).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi"))


def class_profile(df: DataFrame, ranks: list[int]) -> DataFrame:
    """Per class of tall probabilities: soft and argmax counts, and the k-th largest margins
    (p minus the best other p) for the given k."""
    by_id = Window.partitionBy("id")
    first = F.max("p").over(by_id)
    two = df.withColumns({"top": first, "r": F.row_number().over(by_id.orderBy(F.desc("p"), "class"))}).withColumn("second", F.max(F.when(F.col("r") == 2, F.col("p"))).over(by_id))
    m = two.withColumn("margin", F.col("p") - F.when(F.col("r") == 1, F.col("second")).otherwise(F.col("top")))
    placed = m.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy(F.desc(F.round("margin", 6)), "id")))
    return placed.groupBy("class").agg(F.sum("p").alias("soft"), F.sum((F.col("r") == 1).cast("int")).alias("hard"), *[F.max(F.when(F.col("k") == k, F.col("margin"))).alias(f"m{k}") for k in ranks])
