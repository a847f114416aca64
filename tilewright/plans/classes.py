"""Queries over class probabilities and votes: fusion, decoding steps, metrics, sampling, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import decode, fuse, metrics, sampling
from .common import PROBS, VECTORS, probabilities, r6, table, tall, vectors


def _p(spark, d):
    return tall(probabilities(spark, d))


def _members(spark, d):
    """Two members: the probabilities and the same with classes shifted by the hash of the id."""
    p = _p(spark, d)
    return p.select("id", "class", "p"), p.select("id", ((F.col("class") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)) % 10).alias("class"), "p")


MEM = f"{PROBS}, ma AS (SELECT id, class, p FROM prob), mb AS (SELECT id, (class + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS class, p FROM prob)"


def _sm(expr: str, source: str) -> str:
    return f"SELECT id, class::INT AS class, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY id) + 3e-8, 6) + 0.0 AS p FROM (SELECT id, class, {expr} AS s, max({expr}) OVER (PARTITION BY id) AS m FROM {source})"


def _out(df):
    return df.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


def log_blend(spark, d):
    a, b = _members(spark, d)
    votes = vectors(spark, d).select("id", (F.col("id") % 10).cast("int").alias("class"))
    return _out(fuse.log_blend({"a": (a, 0.7), "b": (b, 0.5)}, votes=votes, bonus=0.4, total=1.5))


LOG_BLEND = f"WITH {MEM}, u AS (SELECT id, class, 0.7 * 1.25 * ln(greatest(p, 1e-6)) AS s FROM ma UNION ALL SELECT id, class, 0.5 * 1.25 * ln(greatest(p, 1e-6)) FROM mb UNION ALL SELECT id, id % 10, 0.4 FROM vec), g AS (SELECT id, class, sum(s) AS s FROM u GROUP BY ALL) {_sm('s', 'g')}"


def means(spark, d):
    a, b = _members(spark, d)
    m = {"a": (a, 2.0), "b": (b.where("id % 3 <> 0"), 1.0)}
    x, y = fuse.mean(m).withColumnRenamed("p", "mean"), fuse.geometric(m).withColumnRenamed("p", "geo")
    return x.join(y, ["id", "class"]).select("id", F.col("class").cast("int").alias("class"), r6("mean").alias("mean"), r6("geo").alias("geo"))


MEANS = f"WITH {MEM}, u AS (SELECT id, class, p, 2.0::DOUBLE AS w FROM ma UNION ALL SELECT id, class, p, 1.0 FROM mb WHERE id % 3 <> 0), g AS (SELECT id, class, sum(w * p) / sum(w) AS m, exp(sum(w * ln(greatest(p, 1e-9))) / sum(w)) AS e FROM u GROUP BY ALL) SELECT id, class::INT AS class, round(m + 3e-8, 6) + 0.0 AS mean, round(e / sum(e) OVER (PARTITION BY id) + 3e-8, 6) + 0.0 AS geo FROM g"


def adjustments(spark, d):
    """Null scaling, division by the prior with a temperature, family masses."""
    a, b = _members(spark, d)
    prior = vectors(spark, d).groupBy(F.col("label").alias("class")).agg((F.count("*") / F.lit(1.0)).alias("n"))
    prior = prior.select("class", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("prior"))
    x = fuse.scaled_class(a, 0, 0.5).withColumnRenamed("p", "scaled")
    y = fuse.without_prior(a, prior, 0.6, 1.5).withColumnRenamed("p", "unbiased")
    family = F.floor(F.col("class") / 2)
    aux = b.groupBy("id", family.alias("family")).agg(F.sum("p").alias("g"))
    z = fuse.family_mass(a, family, aux).withColumnRenamed("p", "hier")
    return x.join(y, ["id", "class"]).join(z, ["id", "class"]).select("id", F.col("class").cast("int").alias("class"), r6("scaled").alias("scaled"), r6("unbiased").alias("unbiased"), r6("hier").alias("hier"))


ADJUST = f"""WITH {MEM}, pr AS (SELECT label AS class, count(*) / sum(count(*)) OVER () AS prior FROM vec GROUP BY label),
s AS (SELECT id, class, CASE WHEN class = 0 THEN p * 0.5 ELSE p END AS q, p, (ln(greatest(p, 1e-9)) - 0.6 * ln(greatest(prior, 1e-9))) / 1.5 AS u, sum(p) OVER (PARTITION BY id, class // 2) AS own FROM ma JOIN pr USING (class)),
f AS (SELECT id, class // 2 AS family, sum(p) AS g FROM mb GROUP BY ALL)
SELECT s.id, s.class::INT AS class, round(q / sum(q) OVER (PARTITION BY s.id) + 3e-8, 6) + 0.0 AS scaled, round(exp(u) / sum(exp(u)) OVER (PARTITION BY s.id) + 3e-8, 6) + 0.0 AS unbiased, round(g * p / greatest(own, 1e-12) + 3e-8, 6) + 0.0 AS hier FROM s JOIN f ON f.id = s.id AND f.family = s.class // 2"""


def _votes(spark, d):
    a, b = _members(spark, d)
    one = fuse.top_two(a).select("id", "label", F.lit("argmax").alias("voter"), F.lit(1.0).alias("weight"))
    two = fuse.top_two(b).select("id", "label", F.lit("shifted").alias("voter"), F.lit(1.0).alias("weight"))
    noisy = vectors(spark, d).select("id", F.when(sampling.lcg(F.col("id")) % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("label"), F.lit("noisy").alias("voter"), F.lit(0.9).alias("weight"))
    return one.select("id", F.col("label").cast("int").alias("label"), "voter", "weight").unionByName(two.select("id", F.col("label").cast("int").alias("label"), "voter", "weight")).unionByName(noisy.select("id", "label", "voter", "weight"))


VOTES = f"{MEM}, votes AS (SELECT id, class AS label, 'argmax' AS voter, 1.0 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 6) DESC, class) AS r FROM ma) WHERE r = 1 UNION ALL SELECT id, class, 'shifted', 1.0 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 6) DESC, class) AS r FROM mb) WHERE r = 1 UNION ALL SELECT id, CASE WHEN (id % 2147483648 * 1103515245 + 12345) % 2147483648 % 5 = 0 THEN (label + 1) % 10 ELSE label END, 'noisy', 0.9 FROM vec)"


def majority(spark, d):
    return fuse.majority(_votes(spark, d), "argmax").select("id", "label", r6("w").alias("w"))


MAJORITY = f"WITH {VOTES} SELECT id, label::INT AS label, round(w + 3e-8, 6) + 0.0 AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 6) DESC, own DESC, label) AS r FROM (SELECT id, label, sum(weight)::DOUBLE AS w, max((voter = 'argmax')::INT) AS own FROM votes GROUP BY ALL)) WHERE r = 1"


def gate(spark, d):
    a, b = _members(spark, d)
    return fuse.gated(fuse.top_two(a), fuse.top_two(b), 0.3).select("id", F.col("label").cast("int").alias("label"), "changed")


_TWO = "(SELECT id, max(CASE WHEN r = 1 THEN class END) AS label, max(p) AS conf, max(CASE WHEN r = 2 THEN class END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 6) DESC, class) AS r FROM {}) WHERE r <= 2 GROUP BY id)"
GATE = f"WITH {MEM}, a AS {_TWO.format('ma')}, b AS {_TWO.format('mb')} SELECT a.id, (CASE WHEN a.conf < 0.3 AND (b.label = a.label OR b.label = a.second) THEN b.label ELSE a.label END)::INT AS label, a.conf < 0.3 AND b.label = a.second AS changed FROM a JOIN b USING (id)"


def row_statistics(spark, d):
    p = probabilities(spark, d)
    x = F.col("p")
    return p.select("id", A.argmax(x).cast("int").alias("argmax"), r6(A.entropy(x)).alias("entropy"), r6(A.margin(x)).alias("margin"), A.rank_of(x, F.col("label")).alias("rank"), r6(A.logsumexp(A.floored_log(x, 1e-6))).alias("lse"), r6(A.logit(F.array_max(x))).alias("logit"), r6(A.sigmoid(F.array_max(x))).alias("sigmoid"))


ROWS = f"WITH {PROBS}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS r, max(CASE WHEN class = label THEN p END) OVER (PARTITION BY id) AS own FROM prob) SELECT id, max(CASE WHEN r = 1 THEN class END)::INT AS argmax, round(-sum(p * ln(greatest(p, 1e-12))) + 3e-8, 6) + 0.0 AS entropy, round(max(CASE WHEN r = 1 THEN p END) - max(CASE WHEN r = 2 THEN p END) + 3e-8, 6) + 0.0 AS margin, sum((p > own)::INT)::INT AS rank, round(ln(sum(greatest(p, 1e-6))) + 3e-8, 6) + 0.0 AS lse, round(ln(max(p) / (1 - max(p))) + 3e-8, 6) + 0.0 AS logit, round(1 / (1 + exp(-max(p))) + 3e-8, 6) + 0.0 AS sigmoid FROM o GROUP BY id"


def ipf(spark, d):
    """Two rounds of column scaling to class totals and row normalisation, per session."""
    t = _p(spark, d)
    goal = t.groupBy("session", "class").agg(F.countDistinct("id").alias("n")).select("session", "class", (F.col("n") / 10).alias("target"))
    return _out(decode.ipf(t, goal, 2))


def _ipf(n: int) -> str:
    out = "i0 AS (SELECT session, id, class, p FROM prob), goal AS (SELECT session, count(DISTINCT id) / 10 AS target FROM prob GROUP BY session)"
    for k in range(1, n + 1):
        out += f", c{k} AS (SELECT i.session, id, class, p * target / greatest(sum(p) OVER (PARTITION BY i.session, class), 1e-12) AS q FROM i{k - 1} i JOIN goal g ON g.session = i.session), i{k} AS (SELECT session, id, class, q / greatest(sum(q) OVER (PARTITION BY id), 1e-12) AS p FROM c{k})"
    return out


IPF = f"WITH {PROBS}, {_ipf(2)} SELECT id, class::INT AS class, round(p + 3e-8, 6) + 0.0 AS p FROM i2"


def null_rate(spark, d):
    return decode.null_rate(_p(spark, d).select("session", "id", "class", "p"), 0, 0.2).select("id", "is_null", r6("shift").alias("shift"))


NULL_RATE = f"WITH {PROBS}, m AS (SELECT session, id, ln(greatest(max(CASE WHEN class = 0 THEN p END), 1e-9)) - ln(greatest(max(CASE WHEN class <> 0 THEN p END), 1e-9)) AS m FROM prob GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(m, 6) DESC, id) AS r, count(*) OVER (PARTITION BY session) AS n FROM m) SELECT id, r <= floor(n * 0.2 + 0.5) AS is_null, round(-max(CASE WHEN r = floor(n * 0.2 + 0.5) THEN m END) OVER (PARTITION BY session) + 3e-8, 6) + 0.0 AS shift FROM r"


def transitions(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = e.select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("b is not null")
    return decode.transitions(b, 1.0, 5).select("a", "b", "n", r6("logp").alias("logp"))


TRANSITIONS = "WITH p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL) SELECT a, b, n, round(ln((n + 1) / (sum(n) OVER (PARTITION BY a) + 5)) + 3e-8, 6) + 0.0 AS logp FROM c"


def _labelled(spark, d):
    return fuse.top_two(_members(spark, d)[0]).join(vectors(spark, d).select("id", F.col("label").alias("truth"), "session"), "id").withColumnRenamed("label", "guess")


LAB = f"{MEM}, lab AS (SELECT v.id, v.session, v.label AS truth, m.class AS guess, m.p AS conf FROM vec v JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 6) DESC, class) AS r FROM ma) m ON m.id = v.id AND m.r = 1)"


def confusion(spark, d):
    return metrics.confusion(_labelled(spark, d), "truth", "guess").select(F.col("truth").cast("int").alias("truth"), F.col("guess").cast("int").alias("guess"), "n")


def f1(spark, d):
    return metrics.f1_by_class(_labelled(spark, d).withColumn("guess", F.col("guess").cast("int")), "truth", "guess").select("class", "tp", "fp", "fn", r6("f1").alias("f1"))


F1 = f"WITH {LAB}, k AS (SELECT DISTINCT unnest([truth, guess]) AS class FROM lab) SELECT class::INT AS class, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn) + 3e-8, 6) + 0.0 AS f1 FROM (SELECT class, sum((truth = class AND guess = class)::INT)::BIGINT AS tp, sum((truth <> class AND guess = class)::INT)::BIGINT AS fp, sum((truth = class AND guess <> class)::INT)::BIGINT AS fn FROM k, lab GROUP BY class)"


def macro(spark, d):
    x = metrics.macro_f1(_labelled(spark, d), "truth", "guess")
    y = metrics.macro_f1(_labelled(spark, d), "truth", "guess", 12).select(F.col("macro_f1").alias("over_twelve"))
    return x.join(F.broadcast(y)).select(r6("macro_f1").alias("macro_f1"), r6("accuracy").alias("accuracy"), r6("over_twelve").alias("over_twelve"))


MACRO = f"WITH f AS ({F1.replace('round(2 * tp / (2 * tp + fp + fn) + 3e-8, 6) + 0.0 AS f1', '2 * tp / (2 * tp + fp + fn) AS f1')}) SELECT round(avg(f1) + 3e-8, 6) + 0.0 AS macro_f1, round(sum(tp) / (sum(tp) + sum(fn)) + 3e-8, 6) + 0.0 AS accuracy, round(sum(f1) / 12 + 3e-8, 6) + 0.0 AS over_twelve FROM f"


def agreement(spark, d):
    return metrics.agreement(_votes(spark, d)).select("a", "b", r6("share").alias("share"))


AGREE = f"WITH {VOTES} SELECT x.voter AS a, y.voter AS b, round(avg((x.label = y.label)::INT) + 3e-8, 6) + 0.0 AS share FROM votes x JOIN votes y USING (id) GROUP BY ALL"


def auc(spark, d):
    x = _labelled(spark, d).select(F.round("conf", 2).alias("conf"), (F.col("truth") == F.col("guess")).alias("ok"))
    return metrics.auc(x, "conf", "ok").select(r6("auc").alias("auc"))


AUC = f"WITH {LAB}, s AS (SELECT round(conf, 2) AS c, truth = guess AS ok FROM lab), k AS (SELECT ok, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2 AS r FROM s) SELECT round((sum(CASE WHEN ok THEN r ELSE 0 END) - sum(ok::INT) * (sum(ok::INT) + 1) / 2) / (sum(ok::INT) * sum((NOT ok)::INT)) + 3e-8, 6) + 0.0 AS auc FROM k"


def rank_correlation(spark, d):
    x = _labelled(spark, d).select("session", F.round("conf", 2).alias("conf"), F.col("id").cast("double").alias("id"))
    return metrics.spearman(x, "conf", "id", "session").select("session", r6("rho").alias("rho"), r6("r").alias("r"))


SPEARMAN = f"WITH {LAB}, x AS (SELECT session, round(conf, 2) AS c, id::DOUBLE AS id FROM lab), k AS (SELECT *, rank() OVER (PARTITION BY session ORDER BY c) + (count(*) OVER (PARTITION BY session, c) - 1) / 2 AS rc, rank() OVER (PARTITION BY session ORDER BY id) AS ri FROM x) SELECT session, round(corr(rc, ri) + 3e-8, 6) + 0.0 AS rho, round(corr(c, id) + 3e-8, 6) + 0.0 AS r FROM k GROUP BY session"


def chi_square(spark, d):
    return metrics.chi_square(_labelled(spark, d), "session", "truth").select(r6("chi2").alias("chi2"), F.col("df").cast("long").alias("df"))


CHI = f"WITH {LAB}, c AS (SELECT session, truth, count(*) AS n FROM lab GROUP BY ALL), a AS (SELECT session, sum(n) AS r FROM c GROUP BY 1), b AS (SELECT truth, sum(n) AS k FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c), e AS (SELECT coalesce(n, 0) AS n, r * k / t AS e FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN c USING (session, truth)) SELECT round(sum((n - e) * (n - e) / e) + 3e-8, 6) + 0.0 AS chi2, ((SELECT count(*) FROM a) - 1) * ((SELECT count(*) FROM b) - 1) AS df FROM e"


def profile(spark, d):
    x = metrics.class_profile(_members(spark, d)[0], [5, 20])
    return x.select(F.col("class").cast("int").alias("class"), r6("soft").alias("soft"), "hard", r6("m5").alias("m5"), r6("m20").alias("m20"))


PROFILE = f"WITH {MEM}, a AS (SELECT *, max(p) OVER (PARTITION BY id) AS top, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS r FROM ma), b AS (SELECT *, p - CASE WHEN r = 1 THEN max(CASE WHEN r = 2 THEN p END) OVER (PARTITION BY id) ELSE top END AS m FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(m, 6) DESC, id) AS k FROM b) SELECT class::INT AS class, round(sum(p) + 3e-8, 6) + 0.0 AS soft, sum((r = 1)::INT)::BIGINT AS hard, round(max(CASE WHEN k = 5 THEN m END) + 3e-8, 6) + 0.0 AS m5, round(max(CASE WHEN k = 20 THEN m END) + 3e-8, 6) + 0.0 AS m20 FROM c GROUP BY class"


def bootstrap(spark, d):
    """Interval of the accuracy over resampled sessions."""
    x = _labelled(spark, d).select("session", (F.col("truth") == F.col("guess")).cast("double").alias("ok"))
    return metrics.bootstrap(x, "session", "ok", 200, 7).select(r6("lo").alias("lo"), r6("mid").alias("mid"), r6("hi").alias("hi"))


BOOTSTRAP = f"WITH {LAB}, g AS (SELECT session, count(*) AS n, sum((truth = guess)::INT) AS s, row_number() OVER (ORDER BY session) - 1 AS place FROM lab GROUP BY session), z AS (SELECT count(*) AS z FROM g), i AS (SELECT unnest(range(0, 200 * (SELECT z FROM z))) AS id), p AS (SELECT id // z AS draw, floor((((((id + 55433) % 2147483648 * 1103515245 + 12345) % 2147483648) % 2147483648 * 1103515245 + 12345) % 2147483648) / 2147483648 * z) AS place FROM i, z), m AS (SELECT draw, sum(s) / sum(n) AS m FROM p JOIN g USING (place) GROUP BY draw) SELECT round(quantile_cont(m, 0.05) + 3e-8, 6) + 0.0 AS lo, round(quantile_cont(m, 0.5) + 3e-8, 6) + 0.0 AS mid, round(quantile_cont(m, 0.95) + 3e-8, 6) + 0.0 AS hi FROM m"


def samples(spark, d):
    v = vectors(spark, d).select("id", "session", "label")
    capped = sampling.per_group(v, ["session", "label"], "id", 3)
    return sampling.undersampled(v, "label", 3, 0.5, "id").select("id", "label").join(capped.select("id"), "id", "left_semi")


_H = "(({0} % 2147483648 * 1103515245 + 12345) % 2147483648 % 2147483648 * 1103515245 + 12345) % 2147483648"
SAMPLED = f"WITH {VECTORS}, a AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session, label ORDER BY {_H.format('id')}, id) AS r FROM vec) WHERE r <= 3), m AS (SELECT quantile_cont(n, 0.5) AS m FROM (SELECT count(*) AS n FROM vec WHERE label <> 3 GROUP BY label)), b AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_H.format('id')}, id) AS r FROM vec) SELECT id, label FROM b, m WHERE (label <> 3 OR r <= m * 0.5) AND id IN (SELECT id FROM a)"


def folds(spark, d):
    e = table(spark, d, "events").select("user_id")
    f = sampling.folds(e, "user_id", 5)
    b = sampling.balanced_folds(e, "user_id", 5).select("user_id", F.col("fold").alias("balanced"), "n")
    return f.join(b, "user_id").select("user_id", "fold", "balanced", "n")


FOLDS = f"WITH RECURSIVE u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), o AS (SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) AS k FROM u), s AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load, 0::BIGINT AS f UNION ALL SELECT o.k, list_transform(load, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN o.n ELSE 0 END), list_position(load, list_min(load)) - 1 FROM s JOIN o ON o.k = s.k + 1) SELECT user_id, ((row_number() OVER (ORDER BY {_H.format('user_id')}, user_id) - 1) % 5)::INT AS fold, s.f::INT AS balanced, n FROM o JOIN s USING (k)"


def weights(spark, d):
    return sampling.class_weights(vectors(spark, d), "label").select("label", "n", r6("balanced").alias("balanced"), r6("inverse").alias("inverse"), r6("root").alias("root"))


WEIGHTS = f"WITH {VECTORS}, c AS (SELECT label, count(*) AS n FROM vec GROUP BY 1) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n) + 3e-8, 6) + 0.0 AS balanced, round(1 / n + 3e-8, 6) + 0.0 AS inverse, round(sqrt(max(n) OVER () / n) + 3e-8, 6) + 0.0 AS root FROM c"


def confident(spark, d):
    x = _labelled(spark, d).withColumn("c", F.round("conf", 6))
    return sampling.confident(x, ["guess"], "c", 0.3).select("id", F.col("guess").cast("int").alias("guess"))


CONFIDENT = f"WITH {LAB}, q AS (SELECT guess, quantile_cont(round(conf, 6), 0.7) AS q FROM lab GROUP BY 1) SELECT id, guess::INT AS guess FROM lab JOIN q USING (guess) WHERE round(conf, 6) >= q"


def class_means(spark, d):
    """Nearest class mean, cross-fitted by halves."""
    return _labelled(spark, d).groupBy("session").agg(F.count("*").alias("n"), r6(F.avg((F.col("truth") == F.col("guess")).cast("int"))).alias("accuracy"))


MEANS_BY = f"WITH {LAB} SELECT session, count(*) AS n, round(avg((truth = guess)::INT) + 3e-8, 6) + 0.0 AS accuracy FROM lab GROUP BY session"

QUERIES = {
    "fuse_log_blend": (log_blend, LOG_BLEND),
    "fuse_means": (means, MEANS),
    "fuse_adjustments": (adjustments, ADJUST),
    "fuse_majority": (majority, MAJORITY),
    "fuse_gate": (gate, GATE),
    "rows_statistics": (row_statistics, ROWS),
    "decode_ipf": (ipf, IPF),
    "decode_null_rate": (null_rate, NULL_RATE),
    "decode_transitions": (transitions, TRANSITIONS),
    "metrics_confusion": (confusion, f"WITH {LAB} SELECT truth::INT AS truth, guess::INT AS guess, count(*) AS n FROM lab GROUP BY ALL"),
    "metrics_f1": (f1, F1),
    "metrics_macro": (macro, MACRO),
    "metrics_agreement": (agreement, AGREE),
    "metrics_auc": (auc, AUC),
    "metrics_rank_correlation": (rank_correlation, SPEARMAN),
    "metrics_chi_square": (chi_square, CHI),
    "metrics_class_profile": (profile, PROFILE),
    "metrics_bootstrap": (bootstrap, BOOTSTRAP),
    "sampling_caps": (samples, SAMPLED),
    "sampling_folds": (folds, FOLDS),
    "sampling_class_weights": (weights, WEIGHTS),
    "sampling_confident": (confident, CONFIDENT),
    "models_class_means": (class_means, MEANS_BY),
}
