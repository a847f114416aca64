"""Fusion of class probabilities and votes. Tables are tall: (id, class, p), one per member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_id():
    return Window.partitionBy("id")


def _stacked(members: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    out = None
    for name, (df, weight) in members.items():
        one = df.select("id", "class", "p", F.lit(name).alias("member"), F.lit(float(weight)).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


def softmaxed(df: DataFrame, score: str) -> DataFrame:
    m = F.max(score).over(by_id())
    e = df.withColumn("__e", F.exp(F.col(score) - m))
    return e.withColumn("p", F.col("__e") / F.sum("__e").over(by_id())).drop("__e")


def log_blend(members: dict[str, tuple[DataFrame, float]], floor: float = 1e-6, votes: DataFrame | None = None, bonus: float = 0.0, total: float | None = None) -> DataFrame:
    """softmax(sum of weight * log p), with ``bonus`` for each vote (id, class); ``total`` rescales the
    weights to that sum."""
    scale = 1.0 if total is None else total / sum(w for _, w in members.values())
    rows = _stacked(members).select("id", "class", (F.col("weight") * scale * F.ln(F.greatest("p", F.lit(floor)))).alias("s"))
    if votes is not None:
        rows = rows.unionByName(votes.select("id", "class", F.lit(bonus).alias("s")))
    return softmaxed(rows.groupBy("id", "class").agg(F.sum("s").alias("s")), "s").select("id", "class", "p")


def mean(members: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean over the members that have the row."""
    rows = _stacked(members).where("p is not null")
    return rows.groupBy("id", "class").agg((F.sum(F.col("weight") * F.col("p")) / F.sum("weight")).alias("p"))


def geometric(members: dict[str, tuple[DataFrame, float]], floor: float = 1e-9) -> DataFrame:
    logs = _stacked(members).groupBy("id", "class").agg((F.sum(F.col("weight") * F.ln(F.greatest("p", F.lit(floor)))) / F.sum("weight")).alias("l"))
    return normalised(logs.select("id", "class", F.exp("l").alias("p")))


def normalised(df: DataFrame) -> DataFrame:
    return df.withColumn("p", F.col("p") / F.sum("p").over(by_id()))


def majority(votes: DataFrame, first: str | None = None) -> DataFrame:
    """(id, label) of the greatest total weight from rows (id, voter, label, weight); ties go to the label
    of voter ``first``, then to the smallest."""
    by = votes.groupBy("id", "label").agg(F.sum("weight").alias("w"), F.max((F.col("voter") == F.lit(first)).cast("int")).alias("own"))
    rank = F.row_number().over(by_id().orderBy(F.desc(F.round("w", 6)), F.desc("own"), "label"))
    return by.withColumn("r", rank).where("r = 1").select("id", "label", "w")


def family_mass(df: DataFrame, family: Column, aux: DataFrame) -> DataFrame:
    """Keeps shares within a family and takes the families' masses from ``aux`` (id, family, g)."""
    inside = df.withColumn("family", family)
    own = F.sum("p").over(Window.partitionBy("id", "family"))
    return inside.withColumn("own", own).join(aux, ["id", "family"]).select("id", "class", (F.col("g") * F.col("p") / F.greatest("own", F.lit(1e-12))).alias("p"))


def scaled_class(df: DataFrame, which: int, factor: float) -> DataFrame:
    return normalised(df.withColumn("p", F.when(F.col("class") == which, F.col("p") * factor).otherwise(F.col("p"))))


def without_prior(df: DataFrame, prior: DataFrame, alpha: float, temperature: float, floor: float = 1e-9) -> DataFrame:
    """softmax((log p - alpha log prior) / temperature); prior: (class, prior), a row per class."""
    s = (F.ln(F.greatest("p", F.lit(floor))) - F.lit(alpha) * F.ln(F.greatest("prior", F.lit(floor)))) / temperature
    return softmaxed(df.join(F.broadcast(prior), "class").withColumn("s", s), "s").select("id", "class", "p")


def gated(base: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """The other labels where the base is unsure (confidence below the threshold) and the other label is
    among the base's top two; rows (id, label, conf, second) and (id, label)."""
    o = other.select("id", F.col("label").alias("o"))
    take = (F.col("conf") < threshold) & ((F.col("o") == F.col("label")) | (F.col("o") == F.col("second")))
    return base.join(o, "id", "left").select("id", F.when(take, F.col("o")).otherwise(F.col("label")).alias("label"), F.coalesce(take & (F.col("o") != F.col("label")), F.lit(False)).alias("changed"))


def top_two(df: DataFrame) -> DataFrame:
    """(id, label, conf, second, margin); ties go to the smaller class."""
    r = F.row_number().over(by_id().orderBy(F.desc(F.round("p", 6)), "class"))
    ranked = df.withColumn("r", r).where("r <= 2")
    return ranked.groupBy("id").agg(F.max(F.when(F.col("r") == 1, F.col("class"))).alias("label"), F.max("p").alias("conf"), F.max(F.when(F.col("r") == 2, F.col("class"))).alias("second"), (F.max("p") - F.min("p")).alias("margin"))
