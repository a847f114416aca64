"""Smaller steps between the stages: imputation, shifts, splits, smoothing over links, flips, priors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, sampling
from .common import PROBS, SAMPLES, TILED, VECTORS, probabilities, r6, samples, tall, tiled, vectors
from .vectors import LINKS, TOP, top


def imputed(spark, d):
    """Missing values take the median of their type, 0 where there is none."""
    s = samples(spark, d).withColumn("v", F.when(F.col("idx") % 4 != 0, F.col("value")))
    m = s.groupBy("event_type").agg(F.median("v").alias("m"))
    return s.join(m, "event_type").select("user_id", "idx", r6(F.coalesce("v", "m", F.lit(0.0))).alias("v"))


IMPUTED = f"WITH {SAMPLES}, s AS (SELECT *, CASE WHEN idx % 4 <> 0 THEN value END AS v FROM samples), m AS (SELECT event_type, median(v) AS m FROM s GROUP BY 1) SELECT user_id, idx, round(coalesce(v, m, 0) + 3e-8, 6) + 0.0 AS v FROM s JOIN m USING (event_type)"


def shifted(spark, d):
    """Labels three samples earlier, without each user's last five samples."""
    w = Window.partitionBy("user_id").orderBy("idx")
    n = F.count("*").over(Window.partitionBy("user_id"))
    s = samples(spark, d).withColumns({"label": F.lead("event_type", 3).over(w), "n": n})
    return s.where("idx < n - 5").select("user_id", "idx", "label")


SHIFTED = f"WITH {SAMPLES} SELECT user_id, idx, label FROM (SELECT user_id, idx, lead(event_type, 3) OVER (PARTITION BY user_id ORDER BY idx) AS label, count(*) OVER (PARTITION BY user_id) AS n FROM samples) WHERE idx < n - 5"


def split(spark, d):
    """Three parts of each tile; the first parts take what doesn't divide."""
    size, k = 8, 3
    long_, short = -(-size // k), size // k
    edge = long_ * (size % k)
    part = F.when(F.col("pos") < edge, F.floor(F.col("pos") / long_)).otherwise(size % k + F.floor((F.col("pos") - edge) / short))
    g = tiled(spark, d).groupBy("user_id", "t", part.cast("int").alias("part")).agg(F.avg("value").alias("m"), F.avg(F.col("value") * F.col("value")).alias("e"))
    whole = F.sum("e").over(Window.partitionBy("user_id", "t"))
    return g.select("user_id", "t", "part", r6("m").alias("mean"), r6(F.col("e") / whole).alias("energy"))


SPLIT = f"WITH {TILED}, g AS (SELECT user_id, t, CASE WHEN pos < 6 THEN pos // 3 ELSE 2 END AS part, avg(value) AS m, avg(value * value) AS e FROM tiled GROUP BY ALL) SELECT user_id, t, part::INT AS part, round(m + 3e-8, 6) + 0.0 AS mean, round(e / sum(e) OVER (PARTITION BY user_id, t) + 3e-8, 6) + 0.0 AS energy FROM g"


def negatives(spark, d):
    v = vectors(spark, d)
    p = top(spark, d).join(v.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    return sampling.negatives(p, F.col("a") == F.col("b"), 3).select("src", "dst", "pos")


NEGATIVES = f"WITH {TOP}, p AS (SELECT src, dst, (x.label = y.label)::INT AS pos FROM topk JOIN vec x ON x.id = src JOIN vec y ON y.id = dst) SELECT src, dst, pos FROM (SELECT *, row_number() OVER (PARTITION BY src, pos ORDER BY ((dst + 23757) % 2147483648 * 1103515245 + 12345) % 2147483648, dst) AS r FROM p) WHERE pos = 1 OR r <= 3"


def link_smoothing(spark, d):
    """0.6 of the own distribution, 0.4 of the mean of the linked rows'."""
    links = graph.one_to_one(top(spark, d))
    both = links.select("src", "dst").union(links.select("dst", "src"))
    p = tall(probabilities(spark, d)).select("id", "class", "p")
    near = both.join(p.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "class").agg(F.avg("p").alias("q"))
    return p.join(near, ["id", "class"], "left").select("id", F.col("class").cast("int").alias("class"), r6(F.col("p") * 0.6 + F.coalesce("q", "p") * 0.4).alias("p"))


_P = PROBS + ", " + LINKS.removeprefix(VECTORS + ", ")
LINK_SMOOTHING = f"WITH {_P}, b AS (SELECT src, dst FROM link UNION ALL SELECT dst, src FROM link), n AS (SELECT src AS id, class, avg(p) AS q FROM b JOIN prob ON prob.id = dst GROUP BY ALL) SELECT id, class::INT AS class, round(p * 0.6 + coalesce(q, p) * 0.4 + 3e-8, 6) + 0.0 AS p FROM prob LEFT JOIN n USING (id, class)"


def embedding_smoothing(spark, d):
    """Vectors plus half of their linked vectors, as squared lengths."""
    links = graph.one_to_one(top(spark, d))
    both = links.select("src", "dst").union(links.select("dst", "src"))
    x = vectors(spark, d).select("id", F.posexplode("v").alias("k", "x"))
    near = both.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "k").agg(F.sum("x").alias("y"))
    z = x.join(near, ["id", "k"], "left").withColumn("z", F.col("x") + F.coalesce("y", F.lit(0.0)) * 0.5)
    return z.groupBy("id").agg(r6(F.sum(F.col("z") * F.col("z"))).alias("length2"))


EMBEDDING = f"WITH {LINKS}, b AS (SELECT src, dst FROM link UNION ALL SELECT dst, src FROM link), x AS (SELECT id, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM vec), n AS (SELECT src AS id, k, sum(x) AS y FROM b JOIN x ON x.id = dst GROUP BY ALL) SELECT id, round(sum((x + coalesce(y, 0) * 0.5) ** 2) + 3e-8, 6) + 0.0 AS length2 FROM x LEFT JOIN n USING (id, k) GROUP BY id"


def neighbour_block(spark, d):
    """Mean distribution of the ten nearest, with their mean and best similarity."""
    t = top(spark, d)
    p = tall(probabilities(spark, d)).select(F.col("id").alias("dst"), "class", "p")
    return t.join(p, "dst").groupBy(F.col("src").alias("id"), "class").agg(r6(F.avg("p")).alias("p"), r6(F.avg("s")).alias("mean_s"), r6(F.max("s")).alias("max_s")).withColumn("class", F.col("class").cast("int"))


_Q = PROBS + ", " + TOP.removeprefix(VECTORS + ", ")
NEIGHBOURS = f"WITH {_Q} SELECT src AS id, class::INT AS class, round(avg(p) + 3e-8, 6) + 0.0 AS p, round(avg(s) + 3e-8, 6) + 0.0 AS mean_s, round(max(s) + 3e-8, 6) + 0.0 AS max_s FROM topk JOIN prob ON prob.id = dst GROUP BY src, class"


def flips(spark, d):
    """Boundary rows: where a link joins different guesses, the source takes the other guess if the mean
    over its links says so; the best one per row."""
    p = tall(probabilities(spark, d)).select("id", "class", "p")
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("p", 6)), "class"))
    guess = p.withColumn("r", r).where("r = 1").select("id", F.col("class").alias("g"))
    t = top(spark, d).where("rank <= 3").select("src", "dst")
    a, b = guess.select(F.col("id").alias("src"), F.col("g").alias("own")), guess.select(F.col("id").alias("dst"), F.col("g").alias("other"))
    edge = t.join(a, "src").join(b, "dst").where("own <> other")
    score = edge.join(p.select(F.col("id").alias("dst"), F.col("class").alias("other"), "p"), ["dst", "other"]).groupBy("src", "own", "other").agg((F.sum("p") / 3).alias("s"))
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("s", 6)), "other"))
    return score.where("s > 0.05").withColumn("r", best).where("r = 1").select("src", F.col("own").cast("int").alias("own"), F.col("other").cast("int").alias("other"), r6("s").alias("s"))


FLIPS = f"WITH {_Q}, g AS (SELECT id, class AS g FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 6) DESC, class) AS r FROM prob) WHERE r = 1), e AS (SELECT src, a.g AS own, b.g AS other, sum(p.p) / 3 AS s FROM topk JOIN g a ON a.id = src JOIN g b ON b.id = dst JOIN prob p ON p.id = dst AND p.class = b.g WHERE rank <= 3 AND a.g <> b.g GROUP BY ALL) SELECT src, own::INT AS own, other::INT AS other, round(s + 3e-8, 6) + 0.0 AS s FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 6) DESC, other) AS r FROM e WHERE s > 0.05) WHERE r = 1"


def confident_fill(spark, d):
    """Unsure rows take 0.35 of themselves and 0.65 of the mean of sure neighbours within two places."""
    s = samples(spark, d).withColumn("c", F.col("value") / F.lit(500.0))
    w = Window.partitionBy("user_id").orderBy("idx").rowsBetween(-2, 2)
    sure = F.when(F.col("c") >= 0.6, F.col("c"))
    m = F.avg(sure).over(w)
    out = F.when((F.col("c") < 0.45) & m.isNotNull(), F.col("c") * 0.35 + m * 0.65).otherwise(F.col("c"))
    return s.select("user_id", "idx", r6(out).alias("c"))


FILL = f"WITH {SAMPLES}, s AS (SELECT user_id, idx, value / 500 AS c, avg(CASE WHEN value / 500 >= 0.6 THEN value / 500 END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM samples) SELECT user_id, idx, round(CASE WHEN c < 0.45 AND m IS NOT NULL THEN c * 0.35 + m * 0.65 ELSE c END + 3e-8, 6) + 0.0 AS c FROM s"


def session_prior(spark, d):
    """Log-probabilities plus half the log share of each class among the session's guesses."""
    p = tall(probabilities(spark, d)).select("session", "id", "class", "p")
    soft = p.groupBy("session", "class").agg(F.avg("p").alias("q"))
    s = p.join(soft, ["session", "class"]).withColumn("l", F.ln("p") + F.ln("q") * 0.5)
    w = Window.partitionBy("id")
    e = F.exp(F.col("l") - F.max("l").over(w))
    return s.withColumn("e", e).select("id", F.col("class").cast("int").alias("class"), r6(F.col("e") / F.sum("e").over(w)).alias("p"))


PRIOR = f"WITH {PROBS}, q AS (SELECT session, class, avg(p) AS q FROM prob GROUP BY ALL), l AS (SELECT id, class, ln(p) + ln(q) * 0.5 AS l FROM prob JOIN q USING (session, class)), e AS (SELECT id, class, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM l) SELECT id, class::INT AS class, round(e / sum(e) OVER (PARTITION BY id) + 3e-8, 6) + 0.0 AS p FROM e"

QUERIES = {
    "samples_imputed": (imputed, IMPUTED),
    "samples_shifted_labels": (shifted, SHIFTED),
    "windows_split": (split, SPLIT),
    "sampling_negatives": (negatives, NEGATIVES),
    "graph_link_smoothing": (link_smoothing, LINK_SMOOTHING),
    "graph_embedding_smoothing": (embedding_smoothing, EMBEDDING),
    "graph_neighbour_block": (neighbour_block, NEIGHBOURS),
    "decode_flips": (flips, FLIPS),
    "samples_confident_fill": (confident_fill, FILL),
    "fuse_session_prior": (session_prior, PRIOR),
}
