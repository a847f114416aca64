"""Feature blocks of three-axis tiles and of frame sequences."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import blocks as B
from ..operators import tiling
from .common import TILED, VECTORS, r6, rounded, tile_arrays, tiled, vectors
from .tiles import KEYS, R

#: Three channels of a tile's events: the value, and two made from the event's number.
AXES = f"{TILED}, ax AS (SELECT user_id, t, list(value / 100 ORDER BY pos) AS x, list((event_id % 97) / 20.0 ORDER BY pos) AS y, list((event_id % 41) / 20.0 + 1 ORDER BY pos) AS z FROM tiled GROUP BY user_id, t)"


def axes(spark, d):
    t = tiled(spark, d).select("user_id", "t", "pos", (F.col("value") / 100).alias("a"), ((F.col("event_id") % 97) / F.lit(20.0)).alias("b"), ((F.col("event_id") % 41) / F.lit(20.0) + 1).alias("c"))
    return tiling.arrays(t, ["user_id", "t"], x="a", y="b", z="c")


def _sql(f: str, *args: str) -> str:
    """list_transform over 1..8 of ``f`` with the arguments' elements."""
    body = f
    for k, a in enumerate(args):
        body = body.replace(f"${k}", f"{a}[i]")
    return f"list_transform(range(1, 9), lambda i: {body})"


_COV = {f"c{a}{b}": f"list_sum({_sql(f'($0 - list_avg({a})) * ($1 - list_avg({b}))', a, b)}) / 8" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
_ADJ = "(cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)"


def products(spark, d):
    """Mean products of axes, eigenvalues of their covariance, direction of gravity and its angles."""
    x = axes(spark, d)
    for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"):
        x = x.withColumn(f"c{a}{b}", A.dot(A.centred(F.col(a)), A.centred(F.col(b))) / 8)
    e = B.eigenvalues3(*[F.col(f"c{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")])
    g = [A.mean(F.col(c)) for c in "xyz"]
    n = F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])
    pitch, roll = B.angles(*g)
    return rounded(x, *KEYS, xy=A.mean(F.zip_with("x", "y", lambda p, q: p * q)), yz=A.mean(F.zip_with("y", "z", lambda p, q: p * q)), e1=e[0], e2=e[1], e3=e[2], gx=g[0] / n, gy=g[1] / n, gz=g[2] / n, pitch=pitch, roll=roll)


PRODUCTS = f"""WITH {AXES}, c AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _COV.items())}, list_avg(x) AS mx, list_avg(y) AS my, list_avg(z) AS mz FROM ax),
q AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM c), p AS (SELECT *, sqrt(greatest(((cxx - q) ** 2 + (cyy - q) ** 2 + (czz - q) ** 2 + 2 * (cxy ** 2 + cxz ** 2 + cyz ** 2)) / 6, 1e-24)) AS p FROM q),
f AS (SELECT *, acos(greatest(least(({_ADJ}) / (2 * p ** 3), 1.0), -1.0)) / 3 AS phi FROM p)
SELECT user_id, t, {R(f"list_avg({_sql('$0 * $1', 'x', 'y')})", "xy")}, {R(f"list_avg({_sql('$0 * $1', 'y', 'z')})", "yz")}, {R("q + 2 * p * cos(phi)", "e1")}, {R("3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3))", "e2")}, {R("q + 2 * p * cos(phi + 2 * pi() / 3)", "e3")},
{R("mx / sqrt(mx * mx + my * my + mz * mz)", "gx")}, {R("my / sqrt(mx * mx + my * my + mz * mz)", "gy")}, {R("mz / sqrt(mx * mx + my * my + mz * mz)", "gz")}, {R("atan2(-mx, sqrt(my * my + mz * mz))", "pitch")}, {R("atan2(my, mz)", "roll")} FROM f"""


def vertical(spark, d):
    """Movement along gravity and across it: spread of both, the envelope's peak, phase of the strongest
    bin, log spectrum; and what an exponential low-pass calls gravity and body."""
    x = axes(spark, d)
    g = [A.mean(F.col(c)) for c in "xyz"]
    x = x.withColumns({"gx": g[0], "gy": g[1], "gz": g[2], "n": F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])})
    x = x.withColumns(dict(zip(("up", "flat"), B.vertical_horizontal(*[F.col(c) for c in ("x", "y", "z", "gx", "gy", "gz", "n")]), strict=True)))
    x = x.withColumns({"power": A.power(F.col("up"), 8), "low": A.ema(F.col("x"), 0.25)})
    x = x.withColumn("bin", A.argmax(F.slice("power", 2, 4)) + 1)
    body = F.zip_with("x", "low", lambda a, b: a - b)
    return rounded(x, *KEYS, up_std=A.std(F.col("up")), flat_mean=A.mean(F.col("flat")), flat_std=A.std(F.col("flat")), envelope=F.array_max(A.moving_average(F.transform("up", F.abs), 3)), bin=F.col("bin"), phase=B.phase(F.col("up"), 8, F.col("bin")), log1=F.log1p(F.get("power", F.lit(1))), log4=F.log1p(F.get("power", F.lit(4))), body_rms=A.rms(body), low_end=F.element_at("low", -1))


_TRIG = lambda f: "list_sum(" + _sql(f"$0 * {f}(2 * pi() * bin * (i - 1) / 8)", "up") + ")"
VERTICAL = f"""WITH RECURSIVE {AXES}, g AS (SELECT *, list_avg(x) AS gx, list_avg(y) AS gy, list_avg(z) AS gz, sqrt(list_avg(x) ** 2 + list_avg(y) ** 2 + list_avg(z) ** 2) AS n FROM ax),
u AS (SELECT *, {_sql("(($0 - gx) * gx + ($1 - gy) * gy + ($2 - gz) * gz) / n", "x", "y", "z")} AS up FROM g),
h AS (SELECT *, {_sql("sqrt(greatest(($0 - gx) ** 2 + ($1 - gy) ** 2 + ($2 - gz) ** 2 - $3 ** 2, 0))", "x", "y", "z", "up")} AS flat FROM u),
w AS (SELECT *, list_transform(range(0, 5), lambda k: list_sum(list_transform(range(1, 9), lambda i: up[i] * cos(2 * pi() * k * (i - 1) / 8))) ** 2 + list_sum(list_transform(range(1, 9), lambda i: up[i] * sin(2 * pi() * k * (i - 1) / 8))) ** 2) AS power FROM h),
b AS (SELECT *, list_position(power[2:5], list_max(power[2:5])) AS bin FROM w),
e AS (SELECT user_id, t, 1 AS i, x, x[1] AS low, [x[1]] AS lows FROM ax UNION ALL SELECT user_id, t, i + 1, x, low * 0.75 + x[i + 1] * 0.25, list_append(lows, low * 0.75 + x[i + 1] * 0.25) FROM e WHERE i < 8)
SELECT b.user_id, b.t, {R("sqrt(list_var_pop(up))", "up_std")}, {R("list_avg(flat)", "flat_mean")}, {R("sqrt(list_var_pop(flat))", "flat_std")}, {R("list_max(list_transform(range(1, 9), lambda i: list_sum(list_transform(up[greatest(i - 1, 1) : least(i + 1, 8)], lambda v: abs(v))) / 3))", "envelope")}, {R("bin", "bin")}, {R(f"atan2({_TRIG('-sin').replace('-sin(', '-1 * sin(')}, {_TRIG('cos')})", "phase")}, {R("ln(1 + power[2])", "log1")}, {R("ln(1 + power[5])", "log4")}, {R("sqrt(list_avg(list_transform(range(1, 9), lambda i: (b.x[i] - lows[i]) ** 2)))", "body_rms")}, {R("low", "low_end")}
FROM b JOIN e ON e.user_id = b.user_id AND e.t = b.t AND e.i = 8"""


def welch(spark, d):
    """Entropy of the mean spectrum of three Hann-weighted segments; extremes of the autocorrelation."""
    x = tile_arrays(spark, d)
    lags = F.array(*[A.autocorrelation(F.col("x"), k) for k in range(1, 7)])
    x = x.withColumns({"psd": B.welch(F.col("x"), 8, 4, 2), "ac": lags})
    best = F.round(F.array_max("ac"), 9)
    return rounded(x, *KEYS, entropy=A.entropy(A.normalised(F.col("psd"))), ac_max=F.array_max("ac"), ac_min=F.array_min("ac"), ac_lag=F.array_position(F.transform("ac", lambda v: F.round(v, 9)), best))


_SEG = "list_transform(range(1, 5), lambda j: (x[s + j] - list_avg(x[s + 1 : s + 4])) * (0.5 - 0.5 * cos(2 * pi() * (j - 1) / 4)))"
_AC = "list_transform(range(1, 7), lambda k: list_sum(list_transform(range(1, 9 - k), lambda i: (x[i] - list_avg(x)) * (x[i + k] - list_avg(x)))) / greatest(8 * list_var_pop(x), 1e-12))"
_SPEC = "list_transform(range(0, 3), lambda k: list_sum(list_transform(range(1, 5), lambda j: g[j] * cos(2 * pi() * k * (j - 1) / 4))) ** 2 + list_sum(list_transform(range(1, 5), lambda j: g[j] * sin(2 * pi() * k * (j - 1) / 4))) ** 2)"
WELCH = f"""WITH {TILED}, arr AS (SELECT user_id, t, list(value ORDER BY pos) AS x FROM tiled GROUP BY user_id, t), sg AS (SELECT user_id, t, {_SEG} AS g FROM arr, (SELECT unnest([0, 2, 4]) AS s)), sp AS (SELECT user_id, t, {_SPEC} AS p FROM sg),
m AS (SELECT user_id, t, list_transform([1, 2, 3], lambda k: list_avg(list_transform(ps, lambda q: q[k]))) AS p FROM (SELECT user_id, t, list(p) AS ps FROM sp GROUP BY ALL)), a AS (SELECT user_id, t, {_AC} AS ac FROM arr)
SELECT user_id, t, {R("-list_sum(list_transform(p, lambda v: v / greatest(list_sum(p), 1e-12) * ln(greatest(v / greatest(list_sum(p), 1e-12), 1e-12))))", "entropy")}, {R("list_max(ac)", "ac_max")}, {R("list_min(ac)", "ac_min")}, {R("list_position(list_transform(ac, lambda v: round(v, 9)), round(list_max(ac), 9))", "ac_lag")} FROM m JOIN a USING (user_id, t)"""


def differences(spark, d):
    """Eight statistics of the gradient, and means and spreads of differences at lags 1, 2 and 4."""
    g = A.gradient(F.col("x"))
    x = tile_arrays(spark, d).withColumn("g", g)
    c = F.col("g")
    more = {f"lag{k}_{n}": f(A.diff(F.col("x"), k)) for k in (1, 2, 4) for n, f in (("mean", A.mean), ("std", A.std))}
    return rounded(x, *KEYS, mean=A.mean(c), std=A.std(c), lo=F.array_min(c), hi=F.array_max(c), median=A.median(c), q25=A.quantile(c, 0.25), q75=A.quantile(c, 0.75), rms=A.rms(c), **more)


def _q(q: float) -> str:
    h = 7 * q
    return f"(list_sort(g)[{int(h) + 1}] + (list_sort(g)[{min(int(h) + 2, 8)}] - list_sort(g)[{int(h) + 1}]) * {h - int(h)})"


_LAG = lambda k: f"list_transform(range(1, {9 - k}), lambda i: x[i + {k}] - x[i])"
DIFFERENCES = f"WITH {TILED}, arr AS (SELECT user_id, t, list(value ORDER BY pos) AS x FROM tiled GROUP BY user_id, t), gr AS (SELECT *, list_transform(range(1, 9), lambda i: CASE WHEN i = 1 THEN x[2] - x[1] WHEN i = 8 THEN x[8] - x[7] ELSE (x[least(i + 1, 8)] - x[greatest(i - 1, 1)]) / 2 END) AS g FROM arr) SELECT user_id, t, {R('list_avg(g)', 'mean')}, {R('sqrt(list_var_pop(g))', 'std')}, {R('list_min(g)', 'lo')}, {R('list_max(g)', 'hi')}, {R(_q(0.5), 'median')}, {R(_q(0.25), 'q25')}, {R(_q(0.75), 'q75')}, {R('sqrt(list_avg(list_transform(g, lambda v: v * v)))', 'rms')}, " + ", ".join(f"{R(f'list_avg({_LAG(k)})', f'lag{k}_mean')}, {R(f'sqrt(list_var_pop({_LAG(k)}))', f'lag{k}_std')}" for k in (1, 2, 4)) + " FROM gr"


FRAMES = f"{VECTORS}, fr AS (SELECT id, (k - 1) // 8 AS f, (k - 1) % 8 AS dim, x FROM (SELECT id, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM vec))"


def _frames(spark, d):
    x = vectors(spark, d).select("id", F.posexplode("v").alias("k", "x"))
    return x.select("id", F.floor(F.col("k") / 8).cast("int").alias("f"), (F.col("k") % 8).cast("int").alias("dim"), "x")


def pooled_frames(spark, d):
    """Frames of a window pooled by dimension: mean, spread, last three less first three, first cosines."""
    x = _frames(spark, d)
    cos = [F.sum(F.col("x") * F.cos(F.lit(math.pi * k) * (2 * F.col("f") + 1) / 16)) for k in (1, 2, 3)]
    g = x.groupBy("id", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), (F.avg(F.when(F.col("f") >= 5, F.col("x"))) - F.avg(F.when(F.col("f") < 3, F.col("x")))).alias("drift"), *[c.alias(f"dct{k}") for k, c in enumerate(cos, 1)])
    return rounded(g, "id", "dim", **{c: F.col(c) for c in ("mean", "std", "drift", "dct1", "dct2", "dct3")})


POOLED = f"WITH {FRAMES} SELECT id, dim::INT AS dim, {R('avg(x)', 'mean')}, {R('stddev_pop(x)', 'std')}, {R('avg(x) FILTER (f >= 5) - avg(x) FILTER (f < 3)', 'drift')}, " + ", ".join(R(f"sum(x * cos(pi() * {k} * (2 * f + 1) / 16))", f"dct{k}") for k in (1, 2, 3)) + " FROM fr GROUP BY id, dim"


def motion(spark, d):
    """Mean step between frames, cosine of first and last, least cosine of neighbours, mean spread."""
    x = _frames(spark, d)
    f = x.groupBy("id", "f").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("u"))
    w = Window.partitionBy("id").orderBy("f")
    f = f.withColumns({"p": F.lag("u").over(w), "first": F.first("u").over(w)})
    step = A.norm(F.zip_with("u", "p", lambda a, b: a - b))
    m = f.groupBy("id").agg(F.avg(F.when(F.col("p").isNotNull(), step)).alias("step"), F.min(F.when(F.col("p").isNotNull(), A.cosine(F.col("u"), F.col("p")))).alias("least"), F.max(F.when(F.col("f") == 7, A.cosine(F.col("u"), F.col("first")))).alias("ends"))
    s = x.groupBy("id", "dim").agg(F.stddev_pop("x").alias("s")).groupBy("id").agg(F.avg("s").alias("spread"))
    return rounded(m.join(s, "id"), "id", step=F.col("step"), least=F.col("least"), ends=F.col("ends"), spread=F.col("spread"))


MOTION = f"WITH {FRAMES}, u AS (SELECT id, f, list(x ORDER BY dim) AS u FROM fr GROUP BY ALL), p AS (SELECT *, lag(u) OVER w AS p, first(u) OVER w AS o FROM u WINDOW w AS (PARTITION BY id ORDER BY f)), m AS (SELECT id, avg(list_distance(u, p)) AS step, min(CASE WHEN p IS NOT NULL THEN list_cosine_similarity(u, p) END) AS least, max(CASE WHEN f = 7 THEN list_cosine_similarity(u, o) END) AS ends FROM p GROUP BY id), s AS (SELECT id, avg(s) AS spread FROM (SELECT id, dim, stddev_pop(x) AS s FROM fr GROUP BY ALL) GROUP BY id) SELECT id, {R('step', 'step')}, {R('least', 'least')}, {R('ends', 'ends')}, {R('spread', 'spread')} FROM m JOIN s USING (id)"


def stacks(spark, d):
    """Channels of a tile as rows: z-scores, and differences at lags 1 and 2 with zeros before the start."""
    x = tile_arrays(spark, d)
    lagged = lambda k: F.concat(F.array_repeat(F.lit(0.0), k), A.diff(F.col("x"), k))
    channels = F.array(A.z_rows(F.col("x")), lagged(1), lagged(2))
    rows = x.select(*KEYS, F.posexplode(channels).alias("channel", "c")).select(*KEYS, "channel", F.posexplode("c").alias("pos", "v"))
    return rows.select(*KEYS, "channel", "pos", r6("v").alias("v"))


STACKS = f"WITH {TILED}, w AS (SELECT user_id, t, pos, value - avg(value) OVER u AS c, stddev_pop(value) OVER u AS s, value - lag(value, 1) OVER o AS d1, value - lag(value, 2) OVER o AS d2 FROM tiled WINDOW u AS (PARTITION BY user_id, t), o AS (PARTITION BY user_id, t ORDER BY pos)), a AS (SELECT user_id, t, 0 AS channel, pos, c / s / sqrt(8) AS v FROM w UNION ALL SELECT user_id, t, 1, pos, coalesce(d1, 0) FROM w UNION ALL SELECT user_id, t, 2, pos, coalesce(d2, 0) FROM w) SELECT user_id, t, channel, pos::INT AS pos, round(v + 3e-8, 6) + 0.0 AS v FROM a"


def limbs(spark, d):
    """Four successive tiles as four limbs of one moment: correlation of each pair's mirrored first axis."""
    x = axes(spark, d).withColumns({"moment": F.floor(F.col("t") / 4), "limb": (F.col("t") % 4).cast("int")})
    x = x.withColumn("x", F.transform("x", lambda v: B.mirrored(v, F.col("limb"), 0)))
    a = x.select("user_id", "moment", F.col("limb").alias("a"), F.col("x").alias("u"))
    b = x.select("user_id", "moment", F.col("limb").alias("b"), F.col("x").alias("w"))
    j = a.join(b, ["user_id", "moment"]).where("a < b")
    return j.select("user_id", F.col("moment").cast("long").alias("moment"), "a", "b", r6(A.correlation(F.col("u"), F.col("w"))).alias("r"))


LIMBS = f"WITH {AXES}, l AS (SELECT user_id, t // 4 AS moment, (t % 4)::INT AS limb, CASE WHEN t % 4 = 0 THEN list_transform(x, lambda v: -v) ELSE x END AS x FROM ax) SELECT a.user_id, a.moment::BIGINT AS moment, a.limb AS a, b.limb AS b, {R('list_sum(list_transform(range(1, 9), lambda i: (a.x[i] - list_avg(a.x)) * (b.x[i] - list_avg(b.x)))) / (8 * sqrt(list_var_pop(a.x)) * sqrt(list_var_pop(b.x)))', 'r')} FROM l a JOIN l b ON a.user_id = b.user_id AND a.moment = b.moment AND a.limb < b.limb"

#: A warp that mixes each sample with its neighbours, and its regularised inverse.
WARP = np.eye(8) * 0.7 + np.eye(8, k=1) * 0.2 + np.eye(8, k=-1) * 0.1
RESTORE = np.linalg.solve(WARP.T @ WARP + 1e-3 * np.eye(8), WARP.T)
#: What the warp never makes: here the direction of least gain.
NULL = np.linalg.svd(WARP)[0][:, -1:].T


def warped(spark, d):
    """A tile warped by a matrix, restored by its regularised inverse, and the share of its energy in the
    direction that the warp damps most, before and after: how a warped tile is told."""
    x = tile_arrays(spark, d)
    x = x.withColumn("w", B.applied(F.col("x"), WARP))
    x = x.withColumn("back", B.applied(F.col("w"), RESTORE))
    share = lambda c: F.pow(F.get(B.applied(F.col(c), NULL), F.lit(0)), F.lit(2.0)) / F.greatest(A.energy(F.col(c)) * 8, F.lit(1e-12))
    return rounded(x, *KEYS, energy=A.energy(F.col("w")), error=F.array_max(F.zip_with("x", "back", lambda a, b: F.abs(a - b))), plain=share("x"), warped=share("w"))


def _dot(row, of: str) -> str:
    return f"list_dot_product({of}, [{', '.join(repr(float(v)) for v in row)}]::DOUBLE[])"


def _by(matrix, of: str) -> str:
    return "[" + ", ".join(_dot(row, of) for row in matrix) + "]"


WARPED = f"WITH {TILED}, arr AS (SELECT user_id, t, list(value ORDER BY pos) AS x FROM tiled GROUP BY user_id, t), w AS (SELECT *, {_by(WARP, 'x')} AS w FROM arr), b AS (SELECT *, {_by(RESTORE, 'w')} AS back FROM w) SELECT user_id, t, {R('list_avg(list_transform(w, lambda v: v * v))', 'energy')}, {R('list_max(list_transform(range(1, 9), lambda i: abs(x[i] - back[i])))', 'error')}, {R(_dot(NULL[0], 'x') + ' ** 2 / greatest(list_dot_product(x, x), 1e-12)', 'plain')}, {R(_dot(NULL[0], 'w') + ' ** 2 / greatest(list_dot_product(w, w), 1e-12)', 'warped')} FROM b"


def augmented(spark, d):
    """Tiles scaled, jittered and turned about the third axis by draws from a hash of the tile; one axis
    dropped in some."""
    x = B.augmented(axes(spark, d), F.col("user_id") * 1009 + F.col("t"))
    return rounded(x, *KEYS, x=A.mean(F.col("x")), y=A.mean(F.col("y")), z=A.mean(F.col("z")), x_rms=A.rms(F.col("x")), last=F.element_at("y", -1))


_H = lambda seed: f"(((((user_id * 1009 + t + {seed * 7919}) % 2147483648 * 1103515245 + 12345) % 2147483648 % 2147483648 * 1103515245 + 12345) % 2147483648 + 0.5) / 2147483648)"
AUGMENTED = f"WITH {AXES}, h AS (SELECT *, 0.9 + 0.2 * {_H(1)} AS k, ({_H(2)} - 0.5) * pi() / 6 AS a, 0.02 * ({_H(3)} - 0.5) AS j, {_H(4)} < 0.2 AS gone FROM ax), n AS (SELECT user_id, t, gone, {_sql('k * (cos(a) * $0 - sin(a) * $1) + j * (-1.0) ** (i - 1)', 'x', 'y')} AS x, {_sql('k * (sin(a) * $0 + cos(a) * $1) + j * (-1.0) ** (i - 1)', 'x', 'y')} AS y, {_sql('CASE WHEN gone THEN 0 ELSE k * $0 + j * (-1.0) ** (i - 1) END', 'z')} AS z FROM h) SELECT user_id, t, {R('list_avg(x)', 'x')}, {R('list_avg(y)', 'y')}, {R('list_avg(z)', 'z')}, {R('sqrt(list_avg(list_transform(x, lambda v: v * v)))', 'x_rms')}, {R('y[8]', 'last')} FROM n"


def descriptor(spark, d):
    """A tile in one row: gravity and its angles, log magnitude, means and slopes of head and tail, bands."""
    x = axes(spark, d)
    g = [A.mean(F.col(c)) for c in "xyz"]
    pitch, roll = B.angles(*g)
    x = x.withColumn("m", F.zip_with(F.zip_with("x", "y", lambda a, b: a * a + b * b), "z", lambda s, c: F.sqrt(s + c * c)))
    x = x.withColumn("power", A.power(A.centred(F.col("m")), 8))
    head, tail = (lambda c: F.slice(c, 1, 3)), (lambda c: F.slice(c, 6, 3))
    ends = {f"{n}_{c}": A.mean(f(c)) for n, f in (("head", head), ("tail", tail)) for c in "xyz"}
    speed = {f"{n}_v{c}": (F.element_at(f(c), -1) - F.element_at(f(c), 1)) / 2 for n, f in (("head", head), ("tail", tail)) for c in "xyz"}
    bands = {f"band{k}": F.log1p(F.get("power", F.lit(k))) for k in range(1, 5)}
    return rounded(x, *KEYS, gx=g[0], gy=g[1], gz=g[2], pitch=pitch, roll=roll, log_m=F.log1p(A.mean(F.col("m"))), m_std=A.std(F.col("m")), **ends, **speed, **bands)


_E = ", ".join(R(f"list_avg({c}[{a}:{a + 2}])", f"{n}_{c}") + ", " + R(f"({c}[{a + 2}] - {c}[{a}]) / 2", f"{n}_v{c}") for n, a in (("head", 1), ("tail", 6)) for c in "xyz")
_P = "list_transform(range(0, 5), lambda k: list_sum(list_transform(range(1, 9), lambda i: (m[i] - list_avg(m)) * cos(2 * pi() * k * (i - 1) / 8))) ** 2 + list_sum(list_transform(range(1, 9), lambda i: (m[i] - list_avg(m)) * sin(2 * pi() * k * (i - 1) / 8))) ** 2)"
DESCRIPTOR = f"WITH {AXES}, m AS (SELECT *, list_avg(x) AS mx, list_avg(y) AS my, list_avg(z) AS mz, {_sql('sqrt($0 * $0 + $1 * $1 + $2 * $2)', 'x', 'y', 'z')} AS m FROM ax), p AS (SELECT *, {_P} AS p FROM m) SELECT user_id, t, {R('mx', 'gx')}, {R('my', 'gy')}, {R('mz', 'gz')}, {R('atan2(-mx, sqrt(my * my + mz * mz))', 'pitch')}, {R('atan2(my, mz)', 'roll')}, {R('ln(1 + list_avg(m))', 'log_m')}, {R('sqrt(list_var_pop(m))', 'm_std')}, {_E}, " + ", ".join(R(f"ln(1 + p[{k + 1}])", f"band{k}") for k in range(1, 5)) + " FROM p"


def filled_tiles(spark, d):
    """Gaps inside each tile and channel interpolated on their own; a channel without any value is 0."""
    t = tiled(spark, d).select("user_id", "t", F.col("pos").alias("idx"), F.when(~F.col("event_type").isin("view", "error", "click"), F.col("value")).alias("v"))
    return t.withColumn("filled", tiling.interpolated(t, ["user_id", "t"], "v")).select("user_id", "t", F.col("idx").cast("int").alias("pos"), r6("filled").alias("filled"))


FILLED = f"""WITH {TILED}, g AS (SELECT user_id, t, pos, CASE WHEN event_type NOT IN ('view', 'error', 'click') THEN value END AS v, CASE WHEN event_type NOT IN ('view', 'error', 'click') THEN pos END AS a FROM tiled),
n AS (SELECT *, max(a) OVER (PARTITION BY user_id, t ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0, min(a) OVER (PARTITION BY user_id, t ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM g),
j AS (SELECT n.*, p.v AS x0, q.v AS x1 FROM n LEFT JOIN g p ON p.user_id = n.user_id AND p.t = n.t AND p.pos = i0 LEFT JOIN g q ON q.user_id = n.user_id AND q.t = n.t AND q.pos = i1)
SELECT user_id, t, pos::INT AS pos, round(coalesce(CASE WHEN i1 > i0 THEN x0 + (x1 - x0) * (pos - i0) / (i1 - i0) ELSE x0 END, x0, x1, 0) + 3e-8, 6) + 0.0 AS filled FROM j"""

QUERIES = {
    "features_axes": (products, PRODUCTS),
    "features_vertical": (vertical, VERTICAL),
    "features_welch": (welch, WELCH),
    "features_gradient": (differences, DIFFERENCES),
    "features_descriptor": (descriptor, DESCRIPTOR),
    "features_stacks": (stacks, STACKS),
    "features_limb_pairs": (limbs, LIMBS),
    "features_warped": (warped, WARPED),
    "features_augmented": (augmented, AUGMENTED),
    "frames_pooled": (pooled_frames, POOLED),
    "frames_motion": (motion, MOTION),
    "samples_filled_tiles": (filled_tiles, FILLED),
}
