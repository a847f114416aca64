"""Queries over tiles of the event stream: windows, features, normalisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import normalize, tiling
from .common import ARRAYS, SAMPLES, SIZE, TILED, r6, rounded, samples, table, tile_arrays, tiled

KEYS = ("user_id", "t")
X = "x"  # a name, so that importing needs no session


def _features(sql: str, **values):
    """A query of array functions over tiles, and its oracle ``sql`` (select list over ``arr``)."""

    def query(spark, d):
        return rounded(tile_arrays(spark, d), *KEYS, **{k: v() for k, v in values.items()})

    return query, f"WITH {ARRAYS} SELECT user_id, t, {sql} FROM arr"


def R(sql: str, name: str) -> str:
    return f"round(({sql})::DOUBLE + 3e-8, 6) + 0.0 AS {name}"


M = "list_avg(x)"
VAR = "list_var_pop(x)"
D = "list_transform(range(1, 8), lambda i: x[i + 1] - x[i])"


def _moment(k: int) -> str:
    return f"list_avg(list_transform(x, lambda v: (v - {M}) ** {k}))"


def flagship(spark, d):
    """Tiles of eight events: majority label, purity, amplitude features, z-scores within the user."""
    t = tiled(spark, d)
    features = t.groupBy("user_id", "t").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    label = tiling.majority(t, ["user_id", "t"], "event_type", 4)
    w = Window.partitionBy("user_id")
    z = (F.col("m") - F.avg("m").over(w)) / (F.stddev_pop("m").over(w) + F.lit(1e-3))
    joined = features.join(label, ["user_id", "t"])
    return joined.select("user_id", "t", "label", r6("purity").alias("purity"), "label_centre", r6("m").alias("mean"), r6("s").alias("std"), r6(F.col("hi") - F.col("lo")).alias("range"), r6(z).alias("z"))


FLAGSHIP = f"""WITH {TILED},
f AS (SELECT user_id, t, avg(value) AS m, stddev_pop(value) AS s, max(value) - min(value) AS g, max(CASE WHEN pos = 4 THEN event_type END) AS c FROM tiled GROUP BY ALL),
l AS (SELECT user_id, t, event_type AS label, n / 8.0 AS purity FROM (SELECT user_id, t, event_type, n, row_number() OVER (PARTITION BY user_id, t ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, t, event_type, count(*) AS n FROM tiled GROUP BY ALL)) WHERE r = 1)
SELECT user_id, t, label, round(purity + 3e-8, 6) + 0.0 AS purity, c AS label_centre, round(m + 3e-8, 6) + 0.0 AS mean, round(s + 3e-8, 6) + 0.0 AS std, round(g + 3e-8, 6) + 0.0 AS range,
round((m - avg(m) OVER (PARTITION BY user_id)) / (stddev_pop(m) OVER (PARTITION BY user_id) + 1e-3) + 3e-8, 6) + 0.0 AS z FROM f JOIN l USING (user_id, t)"""


def sliding(spark, d):
    w = tiling.sliding(samples(spark, d), "user_id", 8, 4)
    return w.groupBy("user_id", "w").agg(r6(F.avg("value")).alias("mean"), F.count("*").alias("n"), F.min("idx").alias("start"))


SLIDING = f"WITH {SAMPLES}, n AS (SELECT user_id, count(*) AS n FROM samples GROUP BY 1), w AS (SELECT user_id, unnest(range(0, (n - 8) // 4 + 1)) AS w FROM n WHERE n >= 8) SELECT user_id, w::INT AS w, round(avg(value) + 3e-8, 6) + 0.0 AS mean, count(*) AS n, min(idx) AS start FROM w JOIN samples USING (user_id) WHERE idx BETWEEN w * 4 AND w * 4 + 7 GROUP BY user_id, w"


def dense(spark, d):
    return tiling.dense_counts(samples(spark, d), "user_id", 8, F.col("event_type") == "click").select("user_id", "idx", "hits")


DENSE = f"WITH {SAMPLES}, c AS (SELECT user_id, idx, sum((event_type = 'click')::INT) OVER w AS hits, count(*) OVER w AS k FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) SELECT user_id, idx, hits::BIGINT AS hits FROM c WHERE k = 8"


def runs(spark, d):
    return tiling.label_runs(samples(spark, d), "user_id", "event_type").select("user_id", "run", "event_type", "start", "end", "length")


RUNS_CTE = f"{SAMPLES}, mk AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY idx) = event_type THEN 0 ELSE 1 END AS c FROM samples)), runs AS (SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, min(idx) AS start, max(idx) AS \"end\", count(*) AS length FROM mk GROUP BY user_id, run)"
RUNS = f"WITH {RUNS_CTE} SELECT * FROM runs"


def bouts(spark, d):
    return tiling.merged_sequence(tiling.label_runs(samples(spark, d), "user_id", "event_type"), "user_id", "event_type", "view")


BOUTS = f"WITH {RUNS_CTE}, k AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY start) AS p FROM runs WHERE event_type <> 'view') SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start)::INT AS bout, event_type, start FROM k WHERE p IS NULL OR p <> event_type"


def pure(spark, d):
    return tiling.pure_windows(tiling.label_runs(samples(spark, d), "user_id", "event_type"), 2, 2).select("user_id", "run", "event_type", "w_start")


PURE = f"WITH {RUNS_CTE} SELECT user_id, run, event_type, unnest(range(((start + 1) // 2) * 2, \"end\" - 1 + 1, 2)) AS w_start FROM runs"


def gaps(spark, d):
    s = samples(spark, d).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    return tiling.gap_blocks(s, "user_id", "sec").groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("idx").alias("start"))


GAPS = f"WITH {SAMPLES}, g AS (SELECT *, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY idx) AS gap FROM samples), q AS (SELECT user_id, quantile_cont(gap, 0.95) AS lim FROM g GROUP BY 1), b AS (SELECT user_id, idx, sum((coalesce(gap, 0) > lim)::INT) OVER (PARTITION BY user_id ORDER BY idx)::BIGINT AS block FROM g JOIN q USING (user_id)) SELECT user_id, block, count(*) AS n, min(idx) AS start FROM b GROUP BY ALL"


def pooling(spark, d):
    t = tiled(spark, d).groupBy("user_id", "t").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return tiling.pooled(t, "user_id", "m", "s", (7, 8)).select("user_id", "t", r6("pooled_mean").alias("pooled_mean"), r6("pooled_std").alias("pooled_std"))


POOLING = f"WITH {TILED}, f AS (SELECT user_id, t, avg(value) AS m, stddev_pop(value) AS s FROM tiled GROUP BY ALL), p AS (SELECT *, lead(m) OVER w AS m2, lead(s) OVER w AS s2 FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t)), q AS (SELECT user_id, t, (7 * m + 8 * m2) / 15 AS pm, (7 * (s * s + m * m) + 8 * (s2 * s2 + m2 * m2)) / 15 AS e FROM p WHERE m2 IS NOT NULL) SELECT user_id, t, round(pm + 3e-8, 6) + 0.0 AS pooled_mean, round(sqrt(greatest(e - pm * pm, 0)) + 3e-8, 6) + 0.0 AS pooled_std FROM q"


def interpolation(spark, d):
    s = samples(spark, d).withColumn("v", F.when(F.col("event_type").isin("view", "error"), None).otherwise(F.col("value")))
    return s.select("user_id", "idx", r6(tiling.interpolated(s, "user_id", "v")).alias("filled"))


INTERPOLATION = f"""WITH {SAMPLES}, g AS (SELECT *, CASE WHEN event_type NOT IN ('view', 'error') THEN value END AS v, CASE WHEN event_type NOT IN ('view', 'error') THEN idx END AS a FROM samples),
n AS (SELECT user_id, idx, v, max(a) OVER b AS i0, min(a) OVER f AS i1 FROM g WINDOW b AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
j AS (SELECT n.*, p.v AS x0, q.v AS x1 FROM n LEFT JOIN g p ON p.user_id = n.user_id AND p.idx = n.i0 LEFT JOIN g q ON q.user_id = n.user_id AND q.idx = n.i1)
SELECT user_id, idx, round(coalesce(CASE WHEN i1 > i0 THEN x0 + (x1 - x0) * (idx - i0) / (i1 - i0) ELSE x0 END, x0, x1, 0) + 3e-8, 6) + 0.0 AS filled FROM j"""


def session_windows(spark, d):
    """Event-time windows: tumbling days and sessions by a gap of six hours, per user."""
    e = table(spark, d, "events")
    days = e.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("v"))
    return days.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "v")


WINDOWS = "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(sum(value) + 3e-8, 6) + 0.0 AS v FROM events GROUP BY ALL"


def z_scores(spark, d):
    f = tiling.means(tiled(spark, d), ["user_id", "t"], "value", SIZE)
    f = f.withColumn("z", normalize.z_score(F.col("m"), ["user_id"], 1e-3)).withColumn("centred", normalize.centre(F.col("m"), ["user_id"]))
    robust = normalize.robust(f, "m", ["user_id"], 1e-3)
    q = robust.withColumns({"rank": normalize.percent_place("m", ["user_id"], "t"), "decile": F.ntile(10).over(Window.partitionBy("user_id").orderBy("m", "t"))})
    return q.select("user_id", "t", r6("z").alias("z"), r6("centred").alias("centred"), r6("robust").alias("robust"), r6("rank").alias("rank"), "decile")


Z = f"WITH {TILED}, f AS (SELECT user_id, t, avg(value) AS m FROM tiled GROUP BY ALL), q AS (SELECT user_id, median(m) AS md, quantile_cont(m, 0.75) - quantile_cont(m, 0.25) AS iqr FROM f GROUP BY 1) SELECT user_id, t, round((m - avg(m) OVER u) / (stddev_pop(m) OVER u + 1e-3) + 3e-8, 6) + 0.0 AS z, round(m - avg(m) OVER u + 3e-8, 6) + 0.0 AS centred, round((m - md) / (iqr + 1e-3) + 3e-8, 6) + 0.0 AS robust, round((row_number() OVER o - 0.5) / count(*) OVER u + 3e-8, 6) + 0.0 AS rank, (ntile(10) OVER o)::INT AS decile FROM f JOIN q USING (user_id) WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY m, t)"


def quantile_normalised(spark, d):
    f = tiling.means(tiled(spark, d), ["user_id", "t"], "value", SIZE)
    reference = f.where(F.col("user_id") % 3 == 0)
    return normalize.quantile_map(f, reference, "m", ["user_id"], "t", 100).select("user_id", "t", r6("mapped").alias("mapped"))


QNORM = f"""WITH {TILED}, f AS (SELECT user_id, t, avg(value) AS m FROM tiled GROUP BY ALL),
r AS (SELECT unnest(range(0, 101)) AS k, unnest(q) AS q FROM (SELECT quantile_cont(m, [{", ".join(str(k / 100) for k in range(101))}]) AS q FROM f WHERE user_id % 3 = 0)),
s AS (SELECT user_id, t, (row_number() OVER (PARTITION BY user_id ORDER BY m, t) - 0.5) / count(*) OVER (PARTITION BY user_id) * 100 AS u FROM f)
SELECT user_id, t, round(a.q + (b.q - a.q) * (u - floor(u)) + 3e-8, 6) + 0.0 AS mapped FROM s JOIN r a ON a.k = floor(u)::BIGINT JOIN r b ON b.k = least(floor(u)::BIGINT + 1, 100)"""



def _features_from_rows(spark, d):
    """The same moments by grouped aggregation instead of arrays: one pass, combined before the shuffle."""
    t = tiled(spark, d)
    g = t.groupBy("user_id", "t").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"), F.regr_slope("value", "pos").alias("slope"), F.percentile("value", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return rounded(g, *KEYS, mean=F.col("mean"), std=F.col("std"), skew=F.col("skew"), kurt=F.col("kurt"), slope=F.col("slope"), q10=F.col("q")[0], q90=F.col("q")[1])


FROM_ROWS = f"WITH {ARRAYS}, g AS (SELECT user_id, t, regr_slope(value, pos) AS sl, quantile_cont(value, 0.1) AS q1, quantile_cont(value, 0.9) AS q9 FROM tiled GROUP BY ALL) SELECT user_id, t, {R(M, 'mean')}, {R(f'sqrt({VAR})', 'std')}, {R(f'{_moment(3)} / {VAR} ** 1.5', 'skew')}, {R(f'{_moment(4)} / {VAR} ** 2 - 3', 'kurt')}, {R('sl', 'slope')}, {R('q1', 'q10')}, {R('q9', 'q90')} FROM arr JOIN g USING (user_id, t)"

_BASIS = "list_transform(range(0, 5), lambda k: list_dot_product(x, list_transform(range(0, 8), lambda s: cos(2 * pi() * k * s / 8))) ** 2 + list_dot_product(x, list_transform(range(0, 8), lambda s: sin(2 * pi() * k * s / 8))) ** 2)"
_SORTED = "list_sort(x)"


def _quant(q: float, of: str = _SORTED, n: int = 8) -> str:
    h = (n - 1) * q
    lo = int(h)
    return f"({of}[{lo + 1}] + ({of}[{min(lo + 2, n)}] - {of}[{lo + 1}]) * {h - lo})"


def _autocorr(lag: int) -> str:
    return f"list_sum(list_transform(range(1, {9 - lag}), lambda i: (x[i] - {M}) * (x[i + {lag}] - {M}))) / greatest(8 * {VAR}, 1e-12)"


def spectrum(spark, d):
    p = tile_arrays(spark, d).withColumn("x", A.centred(X)).select(*KEYS, A.power(F.col("x"), 8).alias("p")).withColumn("p", F.filter("p", lambda v: v.isNotNull()))
    p = p.withColumn("n", A.normalised(F.col("p"), 1e-9))
    n, raw = F.col("n"), F.col("p")
    return rounded(p, *KEYS, peak=A.argmax(raw), centroid=A.centroid(n), entropy=A.entropy(n), rolloff=A.rolloff(n), log_power=F.log1p(A.total(raw)), low=F.get(n, 1) + F.get(n, 2), high=F.get(n, 3) + F.get(n, 4), flux=A.mean(F.transform(A.diff(n), F.abs)))


_N = "list_transform(p, lambda v: v / greatest(list_sum(p), 1e-9))"
SPECTRUM = f"""WITH {ARRAYS}, c AS (SELECT user_id, t, list_transform(x, lambda v: v - {M}) AS x FROM arr), s AS (SELECT user_id, t, {_BASIS} AS p FROM c), q AS (SELECT *, {_N} AS n FROM s)
SELECT user_id, t, {R('list_position(p, list_max(p)) - 1', 'peak')}, {R('list_sum(list_transform(n, lambda v, i: v * (i - 1)))', 'centroid')}, {R('-list_sum(list_transform(n, lambda v: v * ln(greatest(v, 1e-12))))', 'entropy')},
{R('least(len(list_filter(range(1, 6), lambda i: list_sum(n[1:i]) < 0.95)), 4)', 'rolloff')}, {R('ln(1 + list_sum(p))', 'log_power')}, {R('n[2] + n[3]', 'low')}, {R('n[4] + n[5]', 'high')}, {R('list_avg(list_transform(range(1, 5), lambda i: abs(n[i + 1] - n[i])))', 'flux')} FROM q"""


def correlations(spark, d):
    """Neighbouring tiles of a user as two channels of one window."""
    w = Window.partitionBy("user_id").orderBy("t")
    p = tile_arrays(spark, d).withColumn("y", F.lead("x").over(w)).where("y is not null")
    return rounded(p, *KEYS, r=A.correlation(X, F.col("y")), magnitude=A.mean(F.zip_with("x", "y", lambda a, b: F.hypot(a, b))), angle=F.atan2(A.mean(X), A.mean(F.col("y"))), covariance=A.dot(A.centred(X), A.centred(F.col("y"))) / 7, z=A.dot(A.z_rows(X), A.z_rows(F.col("y"))))


CORRELATIONS = f"""WITH {ARRAYS}, p AS (SELECT user_id, t, x, lead(x) OVER (PARTITION BY user_id ORDER BY t) AS y FROM arr), q AS (SELECT *, list_sum(list_transform(range(1, 9), lambda i: (x[i] - list_avg(x)) * (y[i] - list_avg(y)))) AS c FROM p WHERE y IS NOT NULL)
SELECT user_id, t, {R('c / (8 * sqrt(list_var_pop(x)) * sqrt(list_var_pop(y)))', 'r')}, {R('list_avg(list_transform(range(1, 9), lambda i: sqrt(x[i] * x[i] + y[i] * y[i])))', 'magnitude')}, {R('atan2(list_avg(x), list_avg(y))', 'angle')}, {R('c / 7', 'covariance')}, {R('c / (8 * sqrt(list_var_pop(x)) * sqrt(list_var_pop(y)))', 'z')} FROM q"""


def smoothing(spark, d):
    t = tile_arrays(spark, d)
    avg, grad = A.moving_average(X, 5), A.gradient(X)
    return t.select(*KEYS, F.posexplode(F.arrays_zip(avg.alias("a"), grad.alias("g"), A.ema(X, 0.3).alias("e"))).alias("pos", "z")).select(*KEYS, "pos", r6("z.a").alias("average"), r6("z.g").alias("gradient"), r6("z.e").alias("ema"))


SMOOTHING = f"""WITH RECURSIVE {TILED}, e AS (SELECT user_id, t, pos, value AS ema FROM tiled WHERE pos = 0 UNION ALL SELECT x.user_id, x.t, x.pos, e.ema * 0.7 + x.value * 0.3 FROM e JOIN tiled x ON x.user_id = e.user_id AND x.t = e.t AND x.pos = e.pos + 1),
g AS (SELECT user_id, t, pos, sum(value) OVER (PARTITION BY user_id, t ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS a, value, lag(value) OVER w AS p, lead(value) OVER w AS n FROM tiled WINDOW w AS (PARTITION BY user_id, t ORDER BY pos))
SELECT user_id, t, pos::INT AS pos, round(a + 3e-8, 6) + 0.0 AS average, round(CASE WHEN p IS NULL THEN n - value WHEN n IS NULL THEN value - p ELSE (n - p) / 2 END + 3e-8, 6) + 0.0 AS gradient, round(ema + 3e-8, 6) + 0.0 AS ema FROM g JOIN e USING (user_id, t, pos)"""

_HIST = "list_filter(list_transform(range(0, 10), lambda b: len(list_filter(x, lambda v: (CASE WHEN list_max(x) > list_min(x) THEN least(floor((v - list_min(x)) / (list_max(x) - list_min(x)) * 10), 9) ELSE 0 END) = b)) / 8.0), lambda c: c > 0)"
_MD = _quant(0.5)


def peak_stats(spark, d):
    """Peaks, their heights and prominences."""
    t = tile_arrays(spark, d).select(*KEYS, "x", A.peaks(X).alias("at"), A.prominences(X).alias("prom"))
    height = F.transform("at", lambda i: F.get(X, i))
    return rounded(t, *KEYS, n=F.size("at"), height=F.when(F.size("at") > 0, A.mean(height)), interval=F.when(F.size("at") > 1, A.mean(A.diff(F.transform("at", lambda i: i.cast("double"))))), prominence=F.when(F.size("prom") > 0, F.array_max("prom")))


#: A side of a peak counts up to the first value above it.
_SIDE = "list_min(({side})[1 : coalesce(list_position(list_transform({side}, lambda u: u > x[i]), true), 9) - 1])"
_LEFT, _RIGHT = "list_reverse(list_slice(x, 1, i - 1))", "list_slice(x, i + 1, 8)"
PEAKS = f"WITH {ARRAYS}, p AS (SELECT *, list_filter(range(2, 8), lambda i: x[i] > x[i - 1] AND x[i] >= x[i + 1]) AS pk FROM arr), q AS (SELECT *, list_transform(pk, lambda i: x[i] - greatest(least(x[i], coalesce({_SIDE.format(side=_LEFT)}, x[i])), least(x[i], coalesce({_SIDE.format(side=_RIGHT)}, x[i])))) AS prom FROM p) SELECT user_id, t, {R('len(pk)', 'n')}, {R('list_avg(list_transform(pk, lambda i: x[i]))', 'height')}, {R('CASE WHEN len(pk) > 1 THEN (pk[len(pk)] - pk[1]) / (len(pk) - 1) END', '\"interval\"')}, {R('list_max(prom)', 'prominence')} FROM q"

_V1 = "list_transform(range(1, 8), lambda i: x[i + 1] - x[i])"
_V2 = "list_transform(range(1, 7), lambda i: x[i + 2] - 2 * x[i + 1] + x[i])"
_CH = f"len(list_filter(range(1, 7), lambda i: ({_V1})[i] * ({_V1})[i + 1] < 0))"
_LEN = f"greatest(list_sum(list_transform({_V1}, lambda v: abs(v))), 1e-12)"
_MOB = f"sqrt(list_var_pop({_V1}) / greatest({VAR}, 1e-12))"

QUERIES = {
    "tiles_flagship": (flagship, FLAGSHIP),
    "windows_sliding": (sliding, SLIDING),
    "windows_dense_counts": (dense, DENSE),
    "runs_of_labels": (runs, RUNS),
    "runs_merged_sequence": (bouts, BOUTS),
    "windows_label_pure": (pure, PURE),
    "windows_gap_blocks": (gaps, GAPS),
    "windows_pooled_pair": (pooling, POOLING),
    "samples_interpolated": (interpolation, INTERPOLATION),
    "windows_event_time": (session_windows, WINDOWS),
    "normalise_grouped": (z_scores, Z),
    "normalise_quantile_map": (quantile_normalised, QNORM),
    "features_from_rows": (_features_from_rows, FROM_ROWS),
    "features_spread": _features(
        ", ".join([R(M, "mean"), R(f"sqrt({VAR})", "std"), R("list_min(x)", "lo"), R("list_max(x)", "hi"), R("list_max(x) - list_min(x)", "range"), R("list_avg(list_transform(x, lambda v: v * v))", "energy"), R("sqrt(list_avg(list_transform(x, lambda v: v * v)))", "rms"), R(f"sqrt(list_avg(list_transform(x, lambda v: v * v))) / greatest(abs({M}), 1e-8)", "shape")]),
        mean=lambda: A.mean(X), std=lambda: A.std(X), lo=lambda: F.array_min(X), hi=lambda: F.array_max(X), range=lambda: F.array_max(X) - F.array_min(X), energy=lambda: A.energy(X), rms=lambda: A.rms(X), shape=lambda: A.shape_factor(X),
    ),
    "features_quantiles": _features(
        ", ".join([R(_quant(q), n) for q, n in ((0.1, "q10"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.9, "q90"))] + [R(f"{_quant(0.75)} - {_quant(0.25)}", "iqr"), R(f"list_avg(list_transform(x, lambda v: abs(v - {M})))", "mad_mean"), R(_quant(0.5, f"list_sort(list_transform(x, lambda v: abs(v - {_MD})))"), "mad_median")]),
        q10=lambda: A.quantile(X, 0.1), q25=lambda: A.quantile(X, 0.25), q50=lambda: A.median(X), q75=lambda: A.quantile(X, 0.75), q90=lambda: A.quantile(X, 0.9), iqr=lambda: A.quantile(X, 0.75) - A.quantile(X, 0.25), mad_mean=lambda: A.mean_abs_deviation(X), mad_median=lambda: A.median_abs_deviation(X),
    ),
    "features_shape": _features(
        ", ".join([R(f"{_moment(3)} / greatest({VAR}, 1e-12) ** 1.5", "skew"), R(f"{_moment(4)} / greatest({VAR}, 1e-12) ** 2 - 3", "kurt"), R(f"{_moment(4)} / greatest({VAR}, 1e-12) ** 2", "kurt_raw"), R(f"-list_sum(list_transform({_HIST}, lambda c: c * ln(c)))", "hist_entropy"), R(f"0.5 * ln(2 * pi() * exp(1) * greatest({VAR}, 1e-12))", "diff_entropy")]),
        skew=lambda: A.skewness(X), kurt=lambda: A.kurtosis(X), kurt_raw=lambda: A.kurtosis(X, excess=False), hist_entropy=lambda: A.histogram_entropy(X), diff_entropy=lambda: A.differential_entropy(X),
    ),
    "features_crossings": _features(
        ", ".join([R(f"len(list_filter(range(1, 8), lambda i: sign(round(x[i] - {M}, 0)) <> sign(round(x[i + 1] - {M}, 0))))", "signs"), R(f"len(list_filter(range(1, 8), lambda i: (x[i] - {M}) * (x[i + 1] - {M}) < 0))", "strict"), R(f"greatest(0, len(list_filter(range(1, len(list_filter(list_transform(x, lambda v: round(v - {M}, 0)), lambda v: v <> 0))), lambda i: sign(list_filter(list_transform(x, lambda v: round(v - {M}, 0)), lambda v: v <> 0)[i]) <> sign(list_filter(list_transform(x, lambda v: round(v - {M}, 0)), lambda v: v <> 0)[i + 1]))))", "filled")]),
        signs=lambda: A.sign_changes(F.transform(A.centred(X), lambda v: F.round(v, 0))), strict=lambda: A.strict_crossings(A.centred(X)), filled=lambda: A.filled_crossings(F.transform(A.centred(X), lambda v: F.round(v, 0))),
    ),
    "features_differences": _features(
        ", ".join([R(f"sqrt(list_var_pop({D}))", "jerk_std"), R(f"list_avg(list_transform({D}, lambda v: abs(v)))", "jerk_abs"), R(f"list_max(list_transform({D}, lambda v: abs(v)))", "jerk_max"), R(f"sqrt(list_avg(list_transform({D}, lambda v: v * v)))", "jerk_rms"), R(f"list_sum(list_transform({D}, lambda v: abs(v)))", "jerk_sum"), R("list_avg(list_transform(range(1, 6), lambda i: x[i + 3] - x[i]))", "lag3_mean"), R("sqrt(list_var_pop(list_transform(range(1, 6), lambda i: x[i + 3] - x[i])))", "lag3_std"), R(f"list_avg({_V2})", "second_mean")]),
        jerk_std=lambda: A.std(A.diff(X)), jerk_abs=lambda: A.mean(F.transform(A.diff(X), F.abs)), jerk_max=lambda: F.array_max(F.transform(A.diff(X), F.abs)), jerk_rms=lambda: A.rms(A.diff(X)), jerk_sum=lambda: A.total(F.transform(A.diff(X), F.abs)), lag3_mean=lambda: A.mean(A.diff(X, 3)), lag3_std=lambda: A.std(A.diff(X, 3)), second_mean=lambda: A.mean(A.diff(A.diff(X))),
    ),
    "features_trend": _features(
        ", ".join([R("list_sum(list_transform(x, lambda v, i: v * (i - 4.5))) / 42", "slope"), R(_autocorr(1), "auto1"), R(_autocorr(3), "auto3"), R("list_avg(x[7:8]) - list_avg(x[1:2])", "edge"), R("list_avg(x[5:8]) - list_avg(x[1:4])", "half_mean"), R("sqrt(list_var_pop(x[5:8])) - sqrt(list_var_pop(x[1:4]))", "half_std"), R("list_sum(list_transform(x[5:8], lambda v: v * v)) / greatest(list_sum(list_transform(x[1:4], lambda v: v * v)), 1e-12)", "half_energy")]),
        slope=lambda: A.slope(X), auto1=lambda: A.autocorrelation(X, 1), auto3=lambda: A.autocorrelation(X, 3), edge=lambda: A.mean(F.slice(X, 7, 2)) - A.mean(F.slice(X, 1, 2)), half_mean=lambda: A.mean(F.slice(X, 5, 4)) - A.mean(F.slice(X, 1, 4)), half_std=lambda: A.std(F.slice(X, 5, 4)) - A.std(F.slice(X, 1, 4)), half_energy=lambda: A.energy(F.slice(X, 5, 4)) / F.greatest(A.energy(F.slice(X, 1, 4)), F.lit(1e-12)),
    ),
    "features_spectrum": (spectrum, SPECTRUM),
    "features_complexity": _features(
        ", ".join([R(_MOB, "mobility"), R(f"sqrt(list_var_pop({_V2}) / greatest(list_var_pop({_V1}), 1e-12)) / greatest({_MOB}, 1e-12)", "complexity"), R(f"log10(8) / (log10(8) + log10(8 / (8 + 0.4 * {_CH})))", "petrosian"), R(f"log10({_LEN} / greatest({_LEN} / 7, 1e-12)) / (log10({_LEN} / greatest({_LEN} / 7, 1e-12)) + log10(greatest(list_max(list_transform(x, lambda v: abs(v - x[1]))), 1e-12) / {_LEN}))", "katz")]),
        mobility=lambda: A.mobility(X), complexity=lambda: A.complexity(X), petrosian=lambda: A.petrosian(X), katz=lambda: A.katz(X),
    ),
    "features_runs": _features(
        ", ".join([R(f"len(list_filter(range(1, 9), lambda i: x[i] > {M} AND (i = 1 OR x[greatest(i - 1, 1)] <= {M})))", "n_runs"), R(f"len(list_filter(x, lambda v: v > {M})) / len(list_filter(range(1, 9), lambda i: x[i] > {M} AND (i = 1 OR x[greatest(i - 1, 1)] <= {M})))", "mean_run")]),
        n_runs=lambda: F.size(A.runs(A.centred(X), lambda v: v > 0)), mean_run=lambda: A.mean(A.runs(A.centred(X), lambda v: v > 0).cast("array<double>")),
    ),
    "features_two_channels": (correlations, CORRELATIONS),
    "features_smoothing": (smoothing, SMOOTHING),
    "features_peaks": (peak_stats, PEAKS),
}
