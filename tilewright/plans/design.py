"""Queries on folds, simulated tests, sweeps, vote sets, effects, and descriptive group-bys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import decode, design, fuse
from .classes import _H
from .common import PROBS, SAMPLES, TILED, VECTORS, probabilities, r6, samples, table, tall, tiled, vectors
from .vectors import LINKS, _fold_neighbours, top

_V = VECTORS + ", "
M = 2147483648


def R(sql: str, name: str) -> str:
    return f"round(({sql})::DOUBLE + 3e-8, 6) + 0.0 AS {name}"


def H(key: str, seed: int = 0) -> str:
    return f"({_H.format(f'({key} + {seed * 7919})')})"


_BEST = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({s}, 6) DESC, class) AS r FROM {source}) WHERE r = 1"


def contiguous(spark, d):
    """Every third sample with its contiguous fold and its half."""
    return design.contiguous(samples(spark, d), "user_id", "idx", 5, 16, F.col("user_id")).where("idx % 3 = 0").select("user_id", "idx", F.col("fold").cast("int").alias("fold"), F.col("half").cast("int").alias("half"))


CONTIGUOUS = f"WITH {SAMPLES} SELECT user_id, idx, fold, half FROM (SELECT user_id, idx, (ntile(5) OVER (PARTITION BY user_id ORDER BY idx) - 1)::INT AS fold, ({H('(user_id * 31 + idx // 16)')} // 65536 % 2)::INT AS half FROM samples) WHERE idx % 3 = 0"


def nested(spark, d):
    return design.nested(table(spark, d, "events"), "user_id", 5, 4)


NESTED = f"WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, o::INT AS \"outer\", (CASE WHEN {H('user_id')} // 65536 % 5 = o THEN -1 ELSE {H('user_id', 1)} // 65536 % 4 END)::INT AS \"inner\" FROM u, (SELECT unnest(range(0, 5)) AS o)"


def _moments(spark, d) -> DataFrame:
    """Four successive tiles of a user as the four limbs of a moment."""
    t = tiled(spark, d).groupBy("user_id", "t").agg(F.avg("value").alias("m"))
    return t.select("user_id", F.floor(F.col("t") / 4).cast("long").alias("moment"), (F.col("t") % 4).cast("int").alias("limb"), "m")


MOMENTS = f"{TILED}, mo AS (SELECT user_id, (t // 4)::BIGINT AS moment, (t % 4)::INT AS limb, avg(value) AS m FROM tiled GROUP BY user_id, t)"


def dropout(spark, d):
    m = _moments(spark, d)
    return design.dropout_copies(m, ["user_id", "moment"], "limb", m["user_id"] * 1000 + m["moment"], 3).select("user_id", "moment", "copy", "limb", "keep")


_C = f"{MOMENTS}, cp AS (SELECT user_id, moment, limb, copy, (user_id * 1000 + moment) * 4 + copy AS k FROM mo, (SELECT unnest(range(0, 3))::INT AS copy)), kp AS (SELECT *, CASE WHEN {H('k', 3)} / {M} < 0.30 THEN 1 WHEN {H('k', 3)} / {M} < 0.65 THEN 2 ELSE 3 END AS keep FROM cp)"
DROPOUT = f"WITH {_C} SELECT user_id, moment, copy, limb, keep FROM (SELECT *, row_number() OVER (PARTITION BY user_id, moment, copy ORDER BY {H('(k * 4 + limb)', 5)}, limb) AS r FROM kp) WHERE r <= keep"


def simulated(spark, d):
    """Users divisible by five as a shuffled test with one valid limb a moment."""
    m = _moments(spark, d).where("user_id % 5 = 0")
    return design.simulated(m, "user_id", "moment", "limb", F.col("m") > 20, m["user_id"] * 1000 + m["moment"]).select("user_id", "moment", "limb", F.col("place").cast("int").alias("place"), F.coalesce("next_place", F.lit(-1)).cast("int").alias("next_place"))


SIMULATED = f"WITH {MOMENTS}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, moment ORDER BY {H('((user_id * 1000 + moment) * 4 + limb)', 7)}, limb) AS r FROM mo WHERE user_id % 5 = 0 AND m > 20) WHERE r = 1), p AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY {H('(user_id * 1000 + moment)', 11)}, moment) - 1)::INT AS place FROM o) SELECT user_id, moment, limb, place, coalesce(lead(place) OVER (PARTITION BY user_id ORDER BY moment), -1)::INT AS next_place FROM p"


def noisy(spark, d):
    v = vectors(spark, d)
    true = v.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("session").orderBy("id")).alias("dst")).where("dst is not null")
    return design.noisy(true, top(spark, d).where("rank = 2"), 0.3)


NOISY = f"WITH {LINKS}, tr AS (SELECT id AS src, lead(id) OVER (PARTITION BY session ORDER BY id) AS dst FROM vec), j AS (SELECT tr.src, tr.dst, k.dst AS other, {H('tr.src', 13)} / {M} < 0.3 AND k.dst IS NOT NULL AS swapped FROM tr LEFT JOIN (SELECT src, dst FROM topk WHERE rank = 2) k USING (src) WHERE tr.dst IS NOT NULL) SELECT src, CASE WHEN swapped THEN other ELSE dst END AS dst, swapped FROM j"


def vote_sets(spark, d):
    """Five voters, the label with errors of their own; their sets of three."""
    v = vectors(spark, d)
    votes = v.select("id", "label", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("voter"))
    wrong = design.draw(F.col("id") * 8 + F.col("voter"), 17) < F.lit(0.1) * F.col("voter") + 0.1
    votes = votes.withColumn("vote", F.when(wrong, (F.col("label") + 1 + F.col("voter")) % 10).otherwise(F.col("label")).cast("int"))
    return design.vote_sets(votes, 3, 0.35).select("set", r6("spread").alias("spread"), r6("right").alias("right"))


VOTE_SETS = f"""WITH {VECTORS}, vt AS MATERIALIZED (SELECT id, label, k AS voter, CASE WHEN {H('(id * 8 + k)', 17)} / {M} < 0.1 * k + 0.1 THEN (label + 1 + k) % 10 ELSE label END AS vote FROM vec, (SELECT unnest(range(0, 5)) AS k)),
df AS (SELECT a.voter AS a, b.voter AS b, avg((a.vote <> b.vote)::INT) AS differ FROM vt a JOIN vt b USING (id) WHERE a.voter < b.voter GROUP BY ALL),
st AS (SELECT (row_number() OVER (ORDER BY a, b, c) - 1)::INT AS set, a, b, c FROM (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 5)) AS b), (SELECT unnest(range(0, 5)) AS c) WHERE a < b AND b < c),
sp AS (SELECT st.*, least(x.differ, y.differ, z.differ) AS spread FROM st JOIN df x ON x.a = st.a AND x.b = st.b JOIN df y ON y.a = st.a AND y.b = st.c JOIN df z ON z.a = st.b AND z.b = st.c),
w AS (SELECT set, spread, x.label, CASE WHEN y.vote = z.vote THEN y.vote ELSE x.vote END AS vote FROM sp JOIN vt x ON x.voter = a JOIN vt y ON y.voter = b AND y.id = x.id JOIN vt z ON z.voter = c AND z.id = x.id WHERE spread >= 0.35)
SELECT set, {R('any_value(spread)', 'spread')}, {R('avg((vote = label)::INT)', '"right"')} FROM w GROUP BY set"""


def vote_product(spark, d):
    """Probabilities times a smoothed one-hot vote, and three members put together 0.2, 0.5, 0.3."""
    p = tall(probabilities(spark, d)).select("session", "id", "class", "p")
    vote = (F.col("id") % 10).cast("int")
    x = p.withColumn("q", F.col("p") * F.pow(design.smoothed_one_hot(vote, F.col("class"), 10, 0.9), F.lit(0.7)))
    x = x.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy("id")))
    flat = decode.powered(p, 0.5).select("id", "class", F.col("p").alias("f"))
    j = x.join(flat, ["id", "class"])
    return j.select("id", F.col("class").cast("int").alias("class"), r6("q").alias("product"), r6(0.2 * F.col("p") + 0.5 * F.col("q") + 0.3 * F.col("f")).alias("blend"))


PRODUCT = f"WITH {PROBS}, x AS (SELECT id, class, p, p * (CASE WHEN id % 10 = class THEN 0.9 ELSE 0.1 / 9 END) ** 0.7 AS q, sqrt(greatest(p, 1e-12)) AS f FROM prob), y AS (SELECT id, class, p, q / sum(q) OVER (PARTITION BY id) AS q, f / sum(f) OVER (PARTITION BY id) AS f FROM x) SELECT id, class::INT AS class, {R('q', 'product')}, {R('0.2 * p + 0.5 * q + 0.3 * f', 'blend')} FROM y"


def families(spark, d):
    """Family first, then the variant inside it: the family's mass sharpened, variants by their share."""
    p = tall(probabilities(spark, d)).select("id", "class", "p")
    f = F.sum("p").over(Window.partitionBy("id", F.floor(F.col("class") / 2)))
    x = p.withColumns({"f": f}).withColumn("q", F.col("f") * F.col("f") * F.col("p") / F.col("f"))
    return x.select("id", F.col("class").cast("int").alias("class"), r6(F.col("p") / F.col("f")).alias("variant"), r6(F.col("q") / F.sum("q").over(Window.partitionBy("id"))).alias("p"))


FAMILIES = f"WITH {PROBS}, x AS (SELECT id, class, p, sum(p) OVER (PARTITION BY id, class // 2) AS f FROM prob) SELECT id, class::INT AS class, {R('p / f', 'variant')}, {R('f * p / sum(f * p) OVER (PARTITION BY id)', 'p')} FROM x"


def seeds(spark, d):
    """Class means refitted on three hashed halves; their probabilities averaged."""
    v = vectors(spark, d)
    x = v.select("id", F.posexplode("v").alias("k", "x"))
    parts = []
    for seed in (1, 2, 3):
        half = v.where(design.draw(F.col("id"), seed) < 0.5).select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
        dist = x.join(F.broadcast(half), "k").groupBy("id", F.col("label").alias("class")).agg((-2 * F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2))).alias("s"))
        parts.append(fuse.softmaxed(dist, "s").select("id", "class", "p"))
    out = reduce(DataFrame.unionByName, parts).groupBy("id", "class").agg(F.avg("p").alias("p"))
    return out.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


SEEDS = f"WITH {VECTORS}, x AS (SELECT id, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM vec), h AS (SELECT seed, label, k, avg(x) AS m FROM x JOIN vec USING (id) JOIN (SELECT unnest([1, 2, 3]) AS seed) ON {_H.format('(id + seed * 7919)')} / {M} < 0.5 GROUP BY ALL), s AS (SELECT seed, id, label AS class, -2 * sqrt(sum((x - m) ** 2)) AS s FROM x JOIN h USING (k) GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seed, id)) AS e FROM s), p AS (SELECT id, class, e / sum(e) OVER (PARTITION BY seed, id) AS p FROM e) SELECT id, class::INT AS class, {R('avg(p)', 'p')} FROM p GROUP BY id, class"


def sweep(spark, d):
    """A grid of settings as data: accuracy of the best class under each power and null factor."""
    grid = spark.createDataFrame([(a, b) for a in (0.5, 1.0, 2.0) for b in (0.25, 1.0, 4.0)], "power double, null_factor double")
    p = tall(probabilities(spark, d)).select("id", "label", "class", "p")
    x = p.crossJoin(F.broadcast(grid))  # nine rows
    s = F.pow("p", F.col("power")) * F.when(F.col("class") == 0, F.col("null_factor")).otherwise(1.0)
    r = F.row_number().over(Window.partitionBy("power", "null_factor", "id").orderBy(F.desc(F.round("s", 6)), "class"))
    best = x.withColumn("s", s).withColumn("r", r).where("r = 1")
    return best.groupBy("power", "null_factor").agg(r6(F.avg((F.col("class") == F.col("label")).cast("int"))).alias("right"), F.sum((F.col("class") == 0).cast("long")).alias("n_null"))


SWEEP = f"WITH {PROBS}, g AS (SELECT a AS power, b AS null_factor FROM (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS a), (SELECT unnest([0.25, 1.0, 4.0])::DOUBLE AS b)), s AS (SELECT power, null_factor, id, label, class, p ** power * CASE WHEN class = 0 THEN null_factor ELSE 1 END AS s FROM prob, g), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY power, null_factor, id ORDER BY round(s, 6) DESC, class) AS r FROM s) WHERE r = 1) SELECT power, null_factor, {R('avg((class = label)::INT)', '\"right\"')}, sum((class = 0)::INT)::BIGINT AS n_null FROM b GROUP BY ALL"


def neighbour_histogram(spark, d):
    """Each label's count and weight among the ten nearest of the other half, with mean distances at 5 and 10."""
    n = _fold_neighbours(spark, d, 10)
    v = vectors(spark, d).select(F.col("id").alias("dst"), "label")
    w = Window.partitionBy("src")
    n = n.withColumn("far", 1 - F.col("s")).withColumns({"d5": F.avg(F.when(F.col("rank") <= 5, F.col("far"))).over(w), "d10": F.avg("far").over(w)})
    return n.join(v, "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("n"), r6(F.sum(F.col("s") + 1)).alias("weight"), r6(F.first("d5")).alias("d5"), r6(F.first("d10")).alias("d10"))


HISTOGRAM = f"WITH {VECTORS}, kn AS (SELECT * FROM (SELECT a.id AS src, b.label, round(list_cosine_similarity(a.v, b.v), 6) AS s, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) AS r FROM vec a JOIN vec b ON a.id % 2 <> b.id % 2) WHERE r <= 10), q AS (SELECT *, avg(CASE WHEN r <= 5 THEN 1 - s END) OVER (PARTITION BY src) AS d5, avg(1 - s) OVER (PARTITION BY src) AS d10 FROM kn) SELECT src AS id, label, count(*) AS n, {R('sum(s + 1)', 'weight')}, {R('any_value(d5)', 'd5')}, {R('any_value(d10)', 'd10')} FROM q GROUP BY src, label"


def two_way(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 12).alias("g"), "event_type", "value")
    t = design.two_way(e, "g", "event_type", "value", 2)
    return t.select("g", "event_type", "n", r6("effect_a").alias("by_user"), r6("effect_b").alias("by_type"), r6(F.col("s") / F.col("n") - F.col("mean") - F.col("effect_a") - F.col("effect_b")).alias("left"))


def _back(k: int) -> str:
    a = f"a{k} AS (SELECT c.*, sum(s - n * (mean + eb)) OVER (PARTITION BY g) / sum(n) OVER (PARTITION BY g) AS ea FROM b{k - 1} c)"
    return a + f", b{k} AS (SELECT g, event_type, n, s, mean, ea AS ea{k}, sum(s - n * (mean + ea)) OVER (PARTITION BY event_type) / sum(n) OVER (PARTITION BY event_type) AS eb FROM a{k})"


TWO_WAY = f"WITH c AS (SELECT user_id % 12 AS g, event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL), b0 AS (SELECT g, event_type, n, s, sum(s) OVER () / sum(n) OVER () AS mean, 0.0::DOUBLE AS eb FROM c), {_back(1)}, {_back(2)} SELECT g, event_type, n, {R('ea2', 'by_user')}, {R('eb', 'by_type')}, {R('s / n - mean - ea2 - eb', '\"left\"')} FROM b2"


def paired(spark, d):
    """Two members against each other: in how many sessions, and rows, each is right alone."""
    p = tall(probabilities(spark, d)).select("session", "id", "label", "class", "p")
    a = decode.best(p).select("session", "id", "label", F.col("class").alias("a"))
    b = decode.best(p.withColumn("p", F.when(F.col("class") % 2 == 0, F.col("p") * 1.3).otherwise(F.col("p")))).select("id", F.col("class").alias("b"))
    j = a.join(b, "id")
    x, y = (F.col("a") == F.col("label")).cast("int"), (F.col("b") == F.col("label")).cast("int")
    s = j.groupBy("session").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.sum(x * (1 - y)).alias("wins"), F.sum(y * (1 - x)).alias("losses"))
    return s.agg(F.count("*").alias("sessions"), F.sum((F.col("x") > F.col("y")).cast("long")).alias("up"), F.sum((F.col("x") < F.col("y")).cast("long")).alias("down"), F.sum("wins").cast("long").alias("wins"), F.sum("losses").cast("long").alias("losses"))


PAIRED = f"WITH {PROBS}, a AS ({_BEST.format(cols='session, id, label, class AS a', by='id', s='p', source='prob')}), pb AS (SELECT id, class, CASE WHEN class % 2 = 0 THEN p * 1.3 ELSE p END AS p FROM prob), b AS ({_BEST.format(cols='id, class AS b', by='id', s='p', source='pb')}), s AS (SELECT session, avg((a = label)::INT) AS x, avg((b = label)::INT) AS y, sum((a = label AND b <> label)::INT) AS w, sum((b = label AND a <> label)::INT) AS l FROM a JOIN b USING (id) GROUP BY session) SELECT count(*) AS sessions, sum((x > y)::INT)::BIGINT AS up, sum((x < y)::INT)::BIGINT AS down, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses FROM s"


def runs_test(spark, d):
    return design.runs_test(samples(spark, d), "user_id", "idx", F.col("event_type").isin("click", "view")).select("user_id", "n1", "n0", "runs", r6("z").alias("z"))


RUNS = f"WITH {SAMPLES}, f AS (SELECT user_id, idx, (event_type IN ('click', 'view'))::INT AS f FROM samples), n AS (SELECT *, CASE WHEN lag(f) OVER (PARTITION BY user_id ORDER BY idx) = f THEN 0 ELSE 1 END AS new FROM f), g AS (SELECT user_id, sum(f)::DOUBLE AS a, sum(1 - f)::DOUBLE AS b, sum(new) AS r FROM n GROUP BY 1), v AS (SELECT *, 2 * a * b / (a + b) + 1 AS m, 2 * a * b * (2 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1)) AS v FROM g WHERE a > 0 AND b > 0 AND a + b > 2) SELECT user_id, a::BIGINT AS n1, b::BIGINT AS n0, r::BIGINT AS runs, {R('CASE WHEN v > 0 THEN (r - m) / sqrt(v) END', 'z')} FROM v"


def rolled_up(spark, d):
    """Totals by user group and type, with subtotals; deciles of the values beside them."""
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("g"), "event_type", "value", "user_id")
    e = e.withColumn("decile", F.ntile(10).over(Window.partitionBy("event_type").orderBy("value", "user_id")))
    r = e.rollup("g", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), r6(F.avg("value")).alias("mean"), F.sum((F.col("decile") == 10).cast("long")).alias("top_decile"), F.grouping_id().cast("int").alias("level"))
    return r


ROLLED = f"WITH e AS (SELECT user_id % 4 AS g, event_type, value, user_id, ntile(10) OVER (PARTITION BY event_type ORDER BY value, user_id) AS decile FROM events) SELECT g, event_type, count(*) AS n, count(DISTINCT user_id) AS users, {R('avg(value)', 'mean')}, sum((decile = 10)::INT)::BIGINT AS top_decile, GROUPING(g, event_type)::INT AS level FROM e GROUP BY ROLLUP (g, event_type)"


def minutes(spark, d):
    """Minutes per user and activity through a table of names; windows and participants per activity."""
    names = spark.createDataFrame([("view", "look", 0.5), ("click", "look", 0.25), ("purchase", "buy", 2.0), ("signup", "join", 5.0)], "event_type string, activity string, minutes double")
    e = table(spark, d, "events").join(F.broadcast(names), "event_type", "left")
    per = e.groupBy("user_id", F.coalesce("activity", F.lit("other")).alias("activity")).agg(F.sum(F.coalesce("minutes", F.lit(0.1))).alias("m"), F.count("*").alias("n"))
    w = Window.partitionBy("activity")
    return per.select("user_id", "activity", r6("m").alias("minutes"), F.sum("n").over(w).alias("windows"), F.count("*").over(w).alias("participants"))


MINUTES = f"WITH n AS (SELECT * FROM (VALUES ('view', 'look', 0.5), ('click', 'look', 0.25), ('purchase', 'buy', 2.0), ('signup', 'join', 5.0)) AS t(event_type, activity, minutes)), p AS (SELECT user_id, coalesce(activity, 'other') AS activity, sum(coalesce(minutes, 0.1)::DOUBLE) AS m, count(*) AS n FROM events LEFT JOIN n USING (event_type) GROUP BY ALL) SELECT user_id, activity, {R('m', 'minutes')}, sum(n) OVER (PARTITION BY activity)::BIGINT AS windows, count(*) OVER (PARTITION BY activity) AS participants FROM p"


def one_each(spark, d):
    """Groups by user and day: the first event of each type in each."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    r = F.row_number().over(Window.partitionBy("user_id", "day", "event_type").orderBy("ts", "event_id"))
    return e.withColumn("r", r).where("r = 1").groupBy("user_id", F.dayofmonth("day").alias("day")).agg(F.count("*").alias("types"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


ONE_EACH = "WITH r AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY ts, event_id) AS r FROM events) SELECT user_id, day(day)::INT AS day, count(*) AS types, min(event_id) AS first, max(event_id) AS last FROM r WHERE r = 1 GROUP BY user_id, day"


def majority_fill(spark, d):
    """Unsure rows take 0.65 of the mean of sure neighbours within two places, where there are some and
    three in five of them are of one type."""
    s = samples(spark, d).withColumn("c", F.col("value") / F.lit(500.0))
    w = Window.partitionBy("user_id").orderBy("idx").rowsBetween(-2, 2)
    sure = (F.col("c") >= 0.4) & (F.col("event_type") != "error")
    n = F.count(F.when(sure, 1)).over(w)
    most = F.greatest(*[F.count(F.when(sure & (F.col("event_type") == t), 1)).over(w) for t in ("signup", "click", "view", "purchase")])
    m = F.avg(F.when(sure, F.col("c"))).over(w)
    out = F.when((F.col("c") < 0.3) & (n > 0) & (most >= n * 0.6), F.col("c") * 0.35 + m * 0.65).otherwise(F.col("c"))
    return s.select("user_id", "idx", r6(out).alias("c"))


_SURE = "value / 500 >= 0.4 AND event_type <> 'error'"
FILL = f"WITH {SAMPLES}, s AS (SELECT user_id, idx, value / 500 AS c, count(*) FILTER ({_SURE}) OVER w AS n, avg(value / 500) FILTER ({_SURE}) OVER w AS m, greatest(" + ", ".join(f"count(*) FILTER ({_SURE} AND event_type = '{t}') OVER w" for t in ("signup", "click", "view", "purchase")) + f") AS most FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT user_id, idx, {R('CASE WHEN c < 0.3 AND n > 0 AND most >= n * 0.6 THEN c * 0.35 + m * 0.65 ELSE c END', 'c')} FROM s"

QUERIES = {
    "sampling_contiguous": (contiguous, CONTIGUOUS),
    "sampling_nested_folds": (nested, NESTED),
    "sampling_dropout_copies": (dropout, DROPOUT),
    "sampling_simulated_test": (simulated, SIMULATED),
    "sampling_noisy_links": (noisy, NOISY),
    "fuse_vote_sets": (vote_sets, VOTE_SETS),
    "fuse_vote_product": (vote_product, PRODUCT),
    "fuse_families": (families, FAMILIES),
    "models_seed_average": (seeds, SEEDS),
    "models_sweep": (sweep, SWEEP),
    "knn_histogram": (neighbour_histogram, HISTOGRAM),
    "metrics_two_way": (two_way, TWO_WAY),
    "metrics_paired": (paired, PAIRED),
    "metrics_runs_test": (runs_test, RUNS),
    "describe_rollup": (rolled_up, ROLLED),
    "describe_minutes": (minutes, MINUTES),
    "describe_one_each": (one_each, ONE_EACH),
    "samples_majority_fill": (majority_fill, FILL),
}
