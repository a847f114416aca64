"""Descriptive queries over the event stream and the star schema: totals, pivots, sets, strata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import tiling
from ..sources import files
from .common import SAMPLES, r6, samples, table
from .tiles import RUNS_CTE

TYPES = ["click", "error", "purchase", "signup", "view"]


def inventory(spark, d):
    """Per user: rows, minutes covered, share of views, distinct types, largest value."""
    e = table(spark, d, "events")
    views = F.col("event_type") == "view"
    minutes = (F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))) / 60
    return e.groupBy("user_id").agg(F.count("*").alias("n"), r6(minutes).alias("minutes"), r6(F.avg(views.cast("int"))).alias("view_share"), F.countDistinct("event_type").alias("types"), F.max("value").alias("most"), r6(F.sum(F.when(~views, F.col("value"))) / F.sum("value")).alias("other_share"))


INVENTORY = "SELECT user_id, count(*) AS n, round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60 + 3e-8, 6) + 0.0 AS minutes, round(avg((event_type = 'view')::INT) + 3e-8, 6) + 0.0 AS view_share, count(DISTINCT event_type) AS types, max(value) AS most, round(sum(value) FILTER (WHERE event_type <> 'view') / sum(value) + 3e-8, 6) + 0.0 AS other_share FROM events GROUP BY user_id"


def distribution(spark, d):
    """Share of each type in all values, largest first."""
    by = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return by.select("event_type", "n", r6(F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(0)))).alias("share"), F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"))).alias("place"))


DISTRIBUTION = "SELECT event_type, n, round(v / sum(v) OVER () + 3e-8, 6) + 0.0 AS share, (rank() OVER (ORDER BY n DESC))::INT AS place FROM (SELECT event_type, sum(value) AS v, count(*) AS n FROM events GROUP BY 1)"


def pivoted(spark, d):
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", TYPES).agg(F.count(F.lit(1)))
    return p.fillna(0, TYPES)


PIVOT = "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY user_id"


def margins(spark, d):
    """Counts by type and weekday with all totals."""
    e = table(spark, d, "events").withColumn("day", F.dayofweek("ts"))
    return e.cube("event_type", "day").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


MARGINS = "SELECT event_type, day::INT AS day, grouping(event_type, day)::INT AS level, count(*) AS n FROM (SELECT event_type, dayofweek(ts) + 1 AS day FROM events) GROUP BY CUBE (event_type, day)"


def zero_counts(spark, d):
    """Counts of every (user, type), also where there is none."""
    e = table(spark, d, "events")
    grid = e.select("user_id").distinct().withColumn("event_type", F.explode(F.array(*map(F.lit, TYPES))))
    return grid.join(e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id", "event_type"], "left").fillna(0, ["n"])


ZERO = f"WITH t AS (SELECT unnest({TYPES}) AS event_type), u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id, t.event_type, count(e.event_id) AS n FROM u CROSS JOIN t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY ALL"


def run_statistics(spark, d):
    r = tiling.label_runs(samples(spark, d), "user_id", "event_type")
    q = F.percentile("length", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return r.groupBy("event_type").agg(F.count("*").alias("n"), q.alias("q"), r6(F.avg((F.col("length") >= 2).cast("int"))).alias("long_share"), F.max("length").alias("most")).select("event_type", "n", r6(F.col("q")[0]).alias("p10"), r6(F.col("q")[1]).alias("median"), r6(F.col("q")[2]).alias("p90"), "long_share", "most")


RUN_STATS = f"WITH {RUNS_CTE} SELECT event_type, count(*) AS n, round(quantile_cont(length, 0.1) + 3e-8, 6) + 0.0 AS p10, round(quantile_cont(length, 0.5) + 3e-8, 6) + 0.0 AS median, round(quantile_cont(length, 0.9) + 3e-8, 6) + 0.0 AS p90, round(avg((length >= 2)::INT) + 3e-8, 6) + 0.0 AS long_share, max(length) AS most FROM runs GROUP BY 1"


def running_totals(spark, d):
    s = samples(spark, d)
    w = Window.partitionBy("user_id").orderBy("idx")
    return s.select("user_id", "idx", r6(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("total"), F.sum((F.col("event_type") == "click").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("clicks"), r6(F.col("value") - F.lag("value").over(w)).alias("step"), r6(F.percent_rank().over(Window.partitionBy("user_id").orderBy("value"))).alias("pr"), r6(F.cume_dist().over(Window.partitionBy("user_id").orderBy("value"))).alias("cd"))


RUNNING = f"WITH {SAMPLES} SELECT user_id, idx, round(sum(value) OVER w + 3e-8, 6) + 0.0 AS total, (sum((event_type = 'click')::INT) OVER w)::BIGINT AS clicks, round(value - lag(value) OVER w + 3e-8, 6) + 0.0 AS step, round(percent_rank() OVER v + 3e-8, 6) + 0.0 AS pr, round(cume_dist() OVER v + 3e-8, 6) + 0.0 AS cd FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY idx), v AS (PARTITION BY user_id ORDER BY value)"


def filled_sign(spark, d):
    """Sign of the change, zeros taking the last one that isn't."""
    w = Window.partitionBy("user_id").orderBy("idx")
    s = samples(spark, d).withColumn("s", F.signum(F.round(F.col("value") / 100 - F.lag("value").over(w) / 100, 0)))
    return s.select("user_id", "idx", F.last(F.when(F.col("s") != 0, F.col("s")), ignorenulls=True).over(w).cast("int").alias("sign"))


SIGN = f"WITH {SAMPLES}, s AS (SELECT user_id, idx, sign(round(value / 100 - lag(value) OVER (PARTITION BY user_id ORDER BY idx) / 100, 0)) AS s FROM samples) SELECT user_id, idx, (last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx))::INT AS sign FROM s"


def representatives(spark, d):
    """The longest run of each type, earliest on ties."""
    r = tiling.label_runs(samples(spark, d), "user_id", "event_type")
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("length"), "user_id", "start"))
    return r.withColumn("k", k).where("k <= 3").select("event_type", "k", "user_id", "start", "length")


REPRESENTATIVES = f"WITH {RUNS_CTE} SELECT event_type, k::INT AS k, user_id, start, length FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY length DESC, user_id, start) AS k FROM runs) WHERE k <= 3"


def long_form(spark, d):
    """Wide to long."""
    c = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("std"), F.max("c_acctbal").alias("most"))
    return c.unpivot(["c_mktsegment"], ["mean", "std", "most"], "figure", "v").select("c_mktsegment", "figure", r6("v").alias("v"))


LONG = "WITH c AS (SELECT c_mktsegment, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std, max(c_acctbal) AS most FROM customer GROUP BY 1) SELECT c_mktsegment, figure, round(v + 3e-8, 6) + 0.0 AS v FROM (UNPIVOT c ON mean, std, most INTO NAME figure VALUE v)"


def coverage(spark, d):
    """Orders by how many distinct suppliers serve them, and by the line of each supplier that is kept."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("s"), F.count("*").alias("n"))
    return n.agg(F.sum((F.col("s") == F.col("n")).cast("long")).alias("all_distinct"), F.sum((F.col("s") == 1).cast("long")).alias("single"), r6(F.avg((F.col("n") > 4).cast("int"))).alias("oversize"))


COVERAGE = "SELECT sum((s = n)::INT)::BIGINT AS all_distinct, sum((s = 1)::INT)::BIGINT AS single, round(avg((n > 4)::INT) + 3e-8, 6) + 0.0 AS oversize FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS s, count(*) AS n FROM lineitem GROUP BY 1)"


def set_operations(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    buyers, rich = o.select(F.col("o_custkey").alias("k")), c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    parts = {"union": buyers.union(rich).distinct(), "union_all": buyers.union(rich), "intersect": buyers.intersect(rich), "except": rich.exceptAll(buyers.distinct()), "semi": rich.join(buyers, "k", "left_semi"), "anti": rich.join(buyers, "k", "left_anti")}
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.sum("k").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


SETS = """WITH b AS (SELECT o_custkey AS k FROM orders), r AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000)
SELECT 'union' AS op, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT k FROM b UNION SELECT k FROM r) UNION ALL SELECT 'union_all', count(*), sum(k)::BIGINT FROM (SELECT k FROM b UNION ALL SELECT k FROM r)
UNION ALL SELECT 'intersect', count(*), sum(k)::BIGINT FROM (SELECT k FROM b INTERSECT SELECT k FROM r) UNION ALL SELECT 'except', count(*), sum(k)::BIGINT FROM (SELECT k FROM r EXCEPT SELECT k FROM b)
UNION ALL SELECT 'semi', count(*), sum(k)::BIGINT FROM r WHERE k IN (SELECT k FROM b) UNION ALL SELECT 'anti', count(*), sum(k)::BIGINT FROM r WHERE k NOT IN (SELECT k FROM b)"""


def template(spark, d):
    """Every customer with the priority of the dearest order, the default where there is none."""
    best = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("p"))
    return files.result(table(spark, d, "customer"), best, "c_custkey", "p", "none")


TEMPLATE = "SELECT c_custkey, coalesce(p, 'none') AS p FROM customer LEFT JOIN (SELECT o_custkey, p FROM (SELECT o_custkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1) ON o_custkey = c_custkey"


def cells(spark, d):
    """Numbers out of JSON and printed lists."""
    e = table(spark, d, "events")
    k = F.from_json("props", "k double")["k"]
    return e.select("event_id", k.alias("k"), A.parse_list(F.concat(F.lit("["), k.cast("string"), F.lit("  2, 3.5]"))).alias("cell")).select("event_id", "k", F.size("cell").alias("n"), r6(A.total(F.col("cell"))).alias("total"))


CELLS = "SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k, 3::INT AS n, round(json_extract(props, '$.k')::DOUBLE + 5.5 + 3e-8, 6) + 0.0 AS total FROM events"


def encoded(spark, d):
    e = files.encoded(table(spark, d, "events"), "event_type", ["view", "click", "error"], "view", strict=False)
    x = e.select("label_id", A.one_hot(F.col("label_id"), 3).alias("hot"))
    return x.groupBy("label_id").agg(F.count("*").alias("n"), F.sum(F.col("hot")[0]).alias("h0"), F.sum(F.col("hot")[1]).alias("h1"), F.sum(F.col("hot")[2]).alias("h2"))


ENCODED = "WITH e AS (SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS label_id FROM events) SELECT label_id, count(*) AS n, sum((label_id = 0)::INT)::BIGINT AS h0, sum((label_id = 1)::INT)::BIGINT AS h1, sum((label_id = 2)::INT)::BIGINT AS h2 FROM e GROUP BY 1"


def checks(spark, d):
    return files.checked(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"bad_discount": "l_discount between 0 and 0.1", "no_quantity": "l_quantity > 0"})


CHECKS = "SELECT sum(k)::BIGINT AS rows, sum(k - 1)::BIGINT AS repeated, sum(a)::BIGINT AS bad_discount, sum(b)::BIGINT AS no_quantity FROM (SELECT count(*) AS k, sum((NOT l_discount BETWEEN 0 AND 0.1)::INT) AS a, sum((NOT l_quantity > 0)::INT) AS b FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def star(spark, d):
    """Joins, a filter that reaches the scan, and grouped totals over the star schema."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    late = l.where("l_shipdate >= timestamp_ntz '1996-01-01 00:00:00'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    j = late.join(o.select("o_orderkey", "o_custkey"), late["l_orderkey"] == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"), F.count("*").alias("lines"), F.countDistinct("o_custkey").alias("buyers"))


STAR = "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines, count(DISTINCT o_custkey) AS buyers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY n_name"


def multi_rate(spark, d):
    """Frames at 3/5 of the sample rate, cropped to the middle of their tile."""
    s = samples(spark, d).withColumn("frame", F.floor(F.col("idx") * 3 / 5)).withColumn("t", F.floor(F.col("idx") / 10))
    return s.where((F.col("frame") % 6).between(1, 4)).groupBy("user_id", "t").agg(F.countDistinct("frame").alias("frames"), r6(F.avg("value")).alias("mean"))


RATES = f"WITH {SAMPLES}, f AS (SELECT *, idx * 3 // 5 AS frame, idx // 10 AS t FROM samples) SELECT user_id, t, count(DISTINCT frame) AS frames, round(avg(value) + 3e-8, 6) + 0.0 AS mean FROM f WHERE frame % 6 BETWEEN 1 AND 4 GROUP BY ALL"

QUERIES = {
    "describe_inventory": (inventory, INVENTORY),
    "describe_distribution": (distribution, DISTRIBUTION),
    "describe_pivot": (pivoted, PIVOT),
    "describe_margins": (margins, MARGINS),
    "describe_zero_counts": (zero_counts, ZERO),
    "describe_runs": (run_statistics, RUN_STATS),
    "describe_running": (running_totals, RUNNING),
    "describe_filled_sign": (filled_sign, SIGN),
    "describe_representatives": (representatives, REPRESENTATIVES),
    "describe_long_form": (long_form, LONG),
    "describe_coverage": (coverage, COVERAGE),
    "sets_all": (set_operations, SETS),
    "source_template": (template, TEMPLATE),
    "source_cells": (cells, CELLS),
    "source_encoded": (encoded, ENCODED),
    "source_checks": (checks, CHECKS),
    "star_revenue": (star, STAR),
    "windows_multi_rate": (multi_rate, RATES),
}
