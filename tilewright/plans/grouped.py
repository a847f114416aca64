"""Queries whose core is sequential inside a session: matching, decoding, communities, models.

Where SQL can't express one, tests hold it against brute force and invariants.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode, graph, matching, models, normalize, spectral
from .common import PROBS, VECTORS, probabilities, r6, tall, vectors
from .vectors import CHAINS, EDGES, TOP, top


def _match(method, **options):
    def query(spark, d):
        m = matching.match(top(spark, d), method=method, **options)
        return m.select("session", "member", "src", "dst", r6("s").alias("s"))

    return query


def _chained(spark, d):
    p = probabilities(spark, d)
    return graph.chains(graph.one_to_one(top(spark, d)), p).join(p.select("id", "p"), "id")


def viterbi(spark, d):
    return decode.chains(_chained(spark, d), 1.5).select("id", "label")


def sticky(spark, d):
    return decode.chains(_chained(spark, d), 0.0, sticky=0.8).select("id", "label", r6("conf").alias("conf"))


def calibrated(spark, d):
    """Fifty rounds of proportional fitting to equal class totals."""
    t = tall(probabilities(spark, d))
    n = vectors(spark, d).count() / 50
    out = decode.ipf_grouped(t, dict.fromkeys(range(10), n))
    return out.select("session", "id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


def _groups(method):
    def query(spark, d):
        e = graph.symmetric(graph.kernel(top(spark, d), 0.1))
        return spectral.groups(e, method, 4).select("session", "id", "group", r6("place").alias("place"))

    return query


def propagated(spark, d):
    e = graph.row_normalised(graph.symmetric(graph.kernel(top(spark, d), 0.1)))
    f = graph.propagate_grouped(e, tall(probabilities(spark, d)).select("session", "id", "class", "p"), 0.8, 30)
    return f.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


def whitened(spark, d):
    w = normalize.whiten(vectors(spark, d), "session", "id", "v", 0.2)
    return w.select("session", "id", r6(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2"))


def regression(spark, d):
    v = vectors(spark, d).withColumn("fold", (F.col("id") % 2).cast("int"))
    out = models.cross_fitted(v, "fold", "v", "label", 2)
    return out.select("id", "label", F.transform("p", lambda x: F.round(x, 3)).alias("p"))


def nearest(spark, d):
    v = vectors(spark, d)
    a = models.nearest_mean(v.where("id % 2 = 0"), models.class_means(v.where("id % 2 = 1"), "v", "label"), "v", "label", "id")
    b = models.nearest_mean(v.where("id % 2 = 1"), models.class_means(v.where("id % 2 = 0"), "v", "label"), "v", "label", "id")
    return a.unionByName(b).select("id", "guess", r6("distance").alias("distance"))


NEAREST = f"WITH {VECTORS}, t AS (SELECT id % 2 AS f, label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM vec), m AS (SELECT f, label, d, avg(x) AS m FROM t GROUP BY ALL), c AS (SELECT f, label, list(m ORDER BY d) AS c FROM m GROUP BY ALL), s AS (SELECT id, c.label AS guess, round(list_distance(v, c.c), 6) AS distance FROM vec JOIN c ON c.f <> id % 2) SELECT id, guess, round(distance + 3e-8, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, guess) AS r FROM s) WHERE r = 1"


def covariance(spark, d):
    """Mergeable sums of each session, as covariances of all dimensions, a row for each pair i <= j."""
    g = normalize.gram(vectors(spark, d), "v", ["session"])
    size = F.size("s")
    rows = g.select("session", "n", "s", size.alias("d"), F.posexplode("g").alias("k", "x"))
    rows = rows.withColumns({"i": F.floor(F.col("k") / F.col("d")).cast("int"), "j": (F.col("k") % F.col("d")).cast("int")}).where("i <= j")
    c = (F.col("x") - F.get("s", F.col("i")) * F.get("s", F.col("j")) / F.col("n")) / (F.col("n") - 1)
    return rows.select("session", "n", "i", "j", r6(c).alias("c"))


COVARIANCE = f"WITH {VECTORS}, x AS (SELECT session, id, generate_subscripts(v, 1) - 1 AS k, unnest(v) AS x FROM vec) SELECT a.session, count(*) AS n, a.k::INT AS i, b.k::INT AS j, round(covar_samp(a.x, b.x) + 3e-8, 6) + 0.0 AS c FROM x a JOIN x b ON a.id = b.id AND a.k <= b.k GROUP BY a.session, a.k, b.k"

#: Rounds as recursion: every step reads the step before it only.
CALIBRATED = f"WITH RECURSIVE {PROBS}, n AS (SELECT count(*) / 50 AS t FROM vec), q AS (SELECT 0 AS k, session, id, class, p FROM prob UNION ALL SELECT k + 1, session, id, class, c / sum(c) OVER (PARTITION BY id) FROM (SELECT k, session, id, class, p * t / sum(p) OVER (PARTITION BY session, class) AS c FROM q, n WHERE k < 50)) SELECT session, id, class::INT AS class, round(p + 3e-8, 6) + 0.0 AS p FROM q WHERE k = 50"
PROPAGATED = f"WITH RECURSIVE {PROBS}, {EDGES.removeprefix(VECTORS + ', ')}, en AS MATERIALIZED (SELECT e.src, e.dst, e.w / deg.d AS w FROM sym e JOIN deg ON deg.src = e.src UNION ALL SELECT id, -1, 1.0 FROM vec), f AS (SELECT 0 AS k, id, class, p FROM prob UNION ALL SELECT k + 1, src, class, sum(CASE WHEN dst = -1 THEN 0.2 * p ELSE 0.8 * w * p END) FROM (SELECT f.k, en.src, en.dst, f.class, en.w, f.p FROM f JOIN en ON en.dst = f.id WHERE f.k < 30 UNION ALL SELECT f.k, f.id, -1, f.class, 1.0, prob.p FROM f JOIN prob ON prob.id = f.id AND prob.class = f.class WHERE f.k < 30) GROUP BY k, src, class) SELECT id, class::INT AS class, round(p + 3e-8, 6) + 0.0 AS p FROM f WHERE k = 30"


#: Each session's edges by falling score, one a step, with lists of the used ends and of every node's root.
GREEDY = f"WITH RECURSIVE {TOP}, e AS MATERIALIZED (SELECT session, src, dst, s, row_number() OVER (PARTITION BY session ORDER BY s DESC, src, dst) AS k FROM topk WHERE s >= 0.2), st AS (SELECT DISTINCT session, 0::BIGINT AS k, []::BIGINT[] AS us, []::BIGINT[] AS ud, range(0, (SELECT max(id) // 5 + 1 FROM vec))::BIGINT[] AS root FROM vec UNION ALL SELECT session, k, CASE WHEN ok THEN list_append(us, src) ELSE us END, CASE WHEN ok THEN list_append(ud, dst) ELSE ud END, CASE WHEN ok THEN list_transform(root, lambda r: CASE WHEN r = a THEN b ELSE r END) ELSE root END FROM (SELECT st.session, e.k, us, ud, root, src, dst, root[src // 5 + 1] AS a, root[dst // 5 + 1] AS b, NOT list_contains(us, src) AND NOT list_contains(ud, dst) AND root[src // 5 + 1] <> root[dst // 5 + 1] AS ok FROM st JOIN e ON e.session = st.session AND e.k = st.k + 1)), m AS (SELECT session, max(k) AS k FROM st GROUP BY 1), l AS (SELECT session, unnest(us) AS src, unnest(ud) AS dst FROM st JOIN m USING (session, k)) SELECT l.session, 0::INT AS member, l.src, l.dst, round(s + 3e-8, 6) + 0.0 AS s FROM l JOIN topk USING (session, src, dst)"

_WITH = "WITH RECURSIVE "
_EMIT = f"{_WITH}{PROBS}, {CHAINS.removeprefix(_WITH).removeprefix(VECTORS + ', ')}, em AS MATERIALIZED (SELECT chain, pos, id, list(ln(greatest(p, 1e-6)) ORDER BY class) AS s FROM chain JOIN prob USING (id) GROUP BY ALL), fin AS (SELECT chain, max(pos) AS pos FROM em GROUP BY 1)"
#: The best path to each class, a row of a chain at a time.
VITERBI = f"{_EMIT}, vit AS (SELECT chain, pos, s AS best, list_transform(range(0, 10), lambda c: [c]) AS path FROM em WHERE pos = 0 UNION ALL SELECT v.chain, e.pos, list_transform(range(1, 11), lambda c: greatest(best[c], list_max(best) - 1.5) + e.s[c]), list_transform(range(1, 11), lambda c: list_append(CASE WHEN best[c] >= list_max(best) - 1.5 THEN path[c] ELSE path[list_position(best, list_max(best))] END, c - 1)) FROM vit v JOIN em e ON e.chain = v.chain AND e.pos = v.pos + 1), w AS (SELECT chain, path[list_position(best, list_max(best))] AS path FROM vit JOIN fin USING (chain, pos)) SELECT id, path[pos + 1]::INT AS label FROM em JOIN w USING (chain)"
#: Forward and backward sums; a label stays with 0.8, each other one follows with 0.2 / 9.
_MOVE = 0.2 / 9
STICKY = f"{_EMIT}, ex AS MATERIALIZED (SELECT chain, pos, id, list_transform(s, lambda v: exp(v - list_max(s))) AS e FROM em), fw AS (SELECT chain, pos, list_transform(e, lambda v: v / list_sum(e)) AS f FROM ex WHERE pos = 0 UNION ALL SELECT chain, pos, list_transform(x, lambda v: v / list_sum(x)) FROM (SELECT fw.chain, ex.pos, list_transform(range(1, 11), lambda c: e[c] * (f[c] * {0.8 - _MOVE!r} + {_MOVE!r} * list_sum(f))) AS x FROM fw JOIN ex ON ex.chain = fw.chain AND ex.pos = fw.pos + 1)), bw AS (SELECT chain, pos, list_transform(range(0, 10), lambda c: 1.0::DOUBLE) AS b FROM fin UNION ALL SELECT chain, pos, list_transform(x, lambda v: v / list_sum(x)) FROM (SELECT chain, pos - 1 AS pos, list_transform(y, lambda v: v * {0.8 - _MOVE!r} + {_MOVE!r} * list_sum(y)) AS x FROM (SELECT bw.chain, bw.pos, list_transform(range(1, 11), lambda c: e[c] * b[c]) AS y FROM bw JOIN ex ON ex.chain = bw.chain AND ex.pos = bw.pos WHERE bw.pos > 0))), q AS (SELECT ex.id, list_transform(range(1, 11), lambda c: f[c] * b[c]) AS q FROM fw JOIN bw USING (chain, pos) JOIN ex USING (chain, pos)) SELECT id, (list_position(q, list_max(q)) - 1)::INT AS label, round(list_max(q) / list_sum(q) + 3e-8, 6) + 0.0 AS conf FROM q"


QUERIES = {
    "match_assignment": (_match("assignment"), None),
    "match_auction": (_match("auction"), None),
    "match_greedy": (_match("greedy", threshold=0.2), GREEDY),
    "match_bagged": (_match("assignment", members=3, tau=0.05), None),
    "decode_viterbi": (viterbi, VITERBI),
    "decode_sticky": (sticky, STICKY),
    "decode_calibrated": (calibrated, CALIBRATED),
    "graph_louvain": (_groups("louvain"), None),
    "graph_bisect": (_groups("bisect"), None),
    "graph_spectral": (_groups("spectral"), None),
    "graph_propagation_grouped": (propagated, PROPAGATED),
    "normalise_whiten": (whitened, None),
    "normalise_covariance": (covariance, COVARIANCE),
    "models_regression": (regression, None),
    "models_nearest_mean": (nearest, NEAREST),
}
