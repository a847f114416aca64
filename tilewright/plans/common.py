"""Fixtures that the registered queries share, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import tiling

SIZE = 8  # samples per tile
SESSIONS = 5
CLASSES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded for comparison. The nudge keeps exact halves, which two engines may round apart, off
    the border; adding 0 turns -0.0 into 0.0."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(3e-8), 6) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str, **values: Column) -> DataFrame:
    return df.select(*keep, *[r6(v.cast("double")).alias(k) for k, v in values.items()])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.indexed(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type"), "user_id", ["ts", "event_id"])


def tiled(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    return tiling.tumbling(samples(spark, sf_dir), "user_id", size)


def tile_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.arrays(tiled(spark, sf_dir), ["user_id", "t"], x="value")


SAMPLES = "samples AS (SELECT user_id, event_id, ts, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"
TILED = f"{SAMPLES}, tiled AS (SELECT * FROM (SELECT *, idx // 8 AS t, idx % 8 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM samples) WHERE t < n // 8)"
#: x: a tile's values in order
ARRAYS = f"{TILED}, arr AS (SELECT user_id, t, list(value ORDER BY pos) AS x FROM tiled GROUP BY user_id, t)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, id, v (doubles), label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % SESSIONS).cast("int").alias("session"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


VECTORS = "vec AS (SELECT (vec_id % 5)::INT AS session, vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each (fold, label); fold = id % 2."""
    v = vectors(spark, sf_dir).select((F.col("id") % 2).alias("fold"), "label", F.posexplode("v").alias("d", "x"))
    by = v.groupBy("fold", "label", "d").agg(F.avg("x").alias("m"))
    return by.groupBy("fold", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, id, label, p: softmax of minus twice the distance to the other fold's class means."""
    v = vectors(spark, sf_dir).withColumn("fold", (F.col("id") + 1) % 2)
    c = centroids(spark, sf_dir).withColumnRenamed("label", "class")
    d = v.join(F.broadcast(c), "fold").withColumn("s", -F.lit(2.0) * A.norm(F.zip_with("v", "c", lambda a, b: a - b)))
    scores = d.groupBy("session", "id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "s"))), lambda s: s["s"]).alias("s"))
    return scores.select("session", "id", "label", A.softmax(F.col("s")).alias("p"))


PROBS = f"""{VECTORS}, cen AS (SELECT fold, label AS class, list(m ORDER BY d) AS c FROM (SELECT fold, label, d, avg(x) AS m FROM (SELECT id % 2 AS fold, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vec) GROUP BY ALL) GROUP BY ALL),
sco AS (SELECT session, id, label, class, -2 * list_distance(v, c) AS s FROM vec JOIN cen ON cen.fold = (id + 1) % 2),
tall AS (SELECT session, id, label, class, exp(s - max(s) OVER (PARTITION BY id)) AS e, s FROM sco),
prob AS (SELECT session, id, label, class, e / sum(e) OVER (PARTITION BY id) AS p FROM tall)"""


def tall(p: DataFrame) -> DataFrame:
    """session, id, label, class, p from arrays."""
    return p.select("session", "id", "label", F.posexplode("p").alias("class", "p"))
