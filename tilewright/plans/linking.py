"""Queries on links between windows: boundary features, fusion of fits, evidence along chains, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import decode, graph, linking, sampling, tiling
from .common import PROBS, SAMPLES, VECTORS, probabilities, r6, samples, tall, vectors
from .vectors import CHAINS, LINKS, TOP, top

FRAME = 8
_WITH = "WITH RECURSIVE "
_V = VECTORS + ", "


def R(sql: str, name: str) -> str:
    return f"round(({sql})::DOUBLE + 3e-8, 6) + 0.0 AS {name}"


def _described(spark, d):
    v = vectors(spark, d).select("session", "id", (F.col("id") % 4).cast("int").alias("limb"), linking.frames(F.col("v"), FRAME).alias("f"))
    return linking.descriptors(v, "f", FRAME)


def _unit(x: str) -> str:
    return f"list_transform({x}, lambda q: q / (sqrt(list_dot_product({x}, {x})) + 1e-9))"


def _pool(x: str) -> str:
    return f"list_transform(range(1, {FRAME + 1}), lambda k: list_avg(list_transform({x}, lambda g: g[k])))"


DESCRIBED = f"""{VECTORS}, fr AS (SELECT session, id, (id % 4)::INT AS limb, list_transform(range(0, 8), lambda i: v[i * 8 + 1 : i * 8 + 8]) AS f FROM vec),
fu AS (SELECT *, list_transform(f, lambda g: list_transform(g, lambda q: q / (sqrt(list_dot_product(g, g)) + 1e-9))) AS u FROM fr),
fm AS (SELECT *, {_pool('u[6:8]')} AS mt, {_pool('u[1:3]')} AS mh, {_pool('u')} AS mp FROM fu),
des AS MATERIALIZED (SELECT session, id, limb, {_unit('mt')} AS tail, {_unit('mh')} AS head, u[8] AS last, u[1] AS "first", {_unit('mp')} AS pooled, f[8] AS "end", f[1] AS "begin", list_transform(range(1, 9), lambda k: 2 * f[8][k] - f[7][k]) AS ahead, list_transform(range(1, 9), lambda k: 2 * f[1][k] - f[2][k]) AS behind FROM fm)"""


def descriptors(spark, d):
    """Sums of the descriptors' components with signs, and of the extrapolations, one row a window."""
    x = _described(spark, d)
    signed = lambda c: F.aggregate(F.transform(c, lambda q, i: q * F.pow(F.lit(-1.0), i.cast("double"))), F.lit(0.0), lambda s, q: s + q)
    return x.select("id", *[r6(signed(c)).alias(f"{c}_sum") for c in ("tail", "head", "last", "first", "pooled", "end", "begin", "ahead", "behind")])


DESCRIPTORS = f"WITH {DESCRIBED} SELECT id, " + ", ".join(R(f"list_sum(list_transform(\"{c}\", lambda q, i: q * (-1.0) ** (i - 1)))", f"{c}_sum") for c in ("tail", "head", "last", "first", "pooled", "end", "begin", "ahead", "behind")) + " FROM des"


def boundary_features(spark, d):
    f = linking.pair_features(top(spark, d), _described(spark, d), "limb")
    return f.select("src", "dst", "same", *[r6(c).alias(c) for c in ("s_th", "s_11", "s_mp", "s_rev", "r_a", "r_b", "margin", "rank_a", "rank_b", "gap", "ext")])


PAIRS = f"""{DESCRIBED}, {TOP.removeprefix(_V)},
pf AS MATERIALIZED (SELECT t.src, t.dst, list_dot_product(a.tail, b.head) AS s_th, list_dot_product(a.last, b."first") AS s_11, list_dot_product(a.pooled, b.pooled) AS s_mp, list_dot_product(b.tail, a.head) AS s_rev, (a.limb = b.limb)::INT AS same, CASE WHEN a.limb = b.limb THEN ln(1 + list_distance(a."end", b."begin")) END AS gap, CASE WHEN a.limb = b.limb THEN ln(1 + list_distance(a.ahead, b."begin")) END AS ext FROM topk t JOIN des a ON a.id = src JOIN des b ON b.id = dst)"""
BOUNDARY = f"""WITH {PAIRS}, rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s_th, 9) DESC, dst) AS ra, row_number() OVER (PARTITION BY dst ORDER BY round(s_th, 9) DESC, src) AS rb, max(s_th) OVER (PARTITION BY src) AS mr, max(s_th) OVER (PARTITION BY dst) AS mc FROM pf), s2 AS (SELECT *, max(CASE WHEN ra = 2 THEN s_th END) OVER (PARTITION BY src) AS second FROM rk)
SELECT src, dst, same, {", ".join(R(c, c) for c in ("s_th", "s_11", "s_mp", "s_rev"))}, {R("s_th - mr", "r_a")}, {R("s_th - mc", "r_b")}, {R("mr - second", "margin")}, {R("ln(ra)", "rank_a")}, {R("ln(rb)", "rank_b")}, {R("gap", "gap")}, {R("ext", "ext")} FROM s2"""


def boundary_cost(spark, d):
    """Squared distance of both extrapolations, raw, scaled by the session's noise, and of its logarithm."""
    x = _described(spark, d)
    a, b = x.select("session", F.col("id").alias("src"), "end", "ahead"), x.select(F.col("id").alias("dst"), "begin", "behind")
    j = top(spark, d).select("src", "dst").join(a, "src").join(b, "dst")
    j = j.select("session", "src", "dst", ((linking.apart2("ahead", "begin") + linking.apart2("behind", "end")) / 2).alias("raw"))
    w = Window.partitionBy("session")
    noise = F.avg("raw").over(w)
    logs = F.ln(F.greatest("raw", F.lit(1e-9)))
    z = F.avg(logs).over(w)
    spread = F.avg(logs * logs).over(w) - z * z
    return j.select("src", "dst", r6("raw").alias("raw"), r6(F.col("raw") / (2 * noise) + 0.5 * F.ln(noise)).alias("nll"), r6((logs - z) * (logs - z) / (2 * spread) + 0.5 * F.ln(spread)).alias("nll_log"))


COST = f"WITH {DESCRIBED}, {TOP.removeprefix(_V)}, c AS (SELECT t.session, t.src, t.dst, (list_distance(a.ahead, b.\"begin\") ** 2 + list_distance(b.behind, a.\"end\") ** 2) / 2 AS raw FROM topk t JOIN des a ON a.id = src JOIN des b ON b.id = dst), l AS (SELECT *, avg(raw) OVER (PARTITION BY session) AS n, ln(greatest(raw, 1e-9)) AS g FROM c), z AS (SELECT *, avg(g) OVER (PARTITION BY session) AS z, avg(g * g) OVER (PARTITION BY session) AS z2 FROM l) SELECT src, dst, {R('raw', 'raw')}, {R('raw / (2 * n) + 0.5 * ln(n)', 'nll')}, {R('(g - z) * (g - z) / (2 * (z2 - z * z)) + 0.5 * ln(z2 - z * z)', 'nll_log')} FROM z"


def _fits(spark, d):
    """Two scorers of the candidates, as log-odds; the second lists fewer."""
    t = top(spark, d)
    p = lambda k, b: 1 / (1 + F.exp(-(F.col("s") - b) * k))
    return [t.select("src", "dst", linking.log_odds(p(8.0, 0.2)).alias("lo")), t.where("(src + dst) % 3 <> 0").select("src", "dst", linking.log_odds(p(12.0, 0.25)).alias("lo"))]


def _odds(k: float, b: float) -> str:
    p = f"least(greatest(1 / (1 + exp(-(s - {b}) * {k})), 1e-6), 1 - 1e-6)"
    return f"ln({p} / (1 - {p}))"


FITS = f"{TOP}, f1 AS (SELECT src, dst, {_odds(8.0, 0.2)} AS lo FROM topk), f2 AS (SELECT src, dst, {_odds(12.0, 0.25)} AS lo FROM topk WHERE (src + dst) % 3 <> 0)"


def averaged(spark, d):
    return linking.averaged(_fits(spark, d)).select("src", "dst", r6("lo").alias("lo"))


def fused(spark, d):
    """The union of two fits' candidates, and each row's three best of it."""
    a, b = _fits(spark, d)
    out = linking.fused([(a, 0.6), (b, 0.4)])
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("lo", 6)), "dst"))
    return out.withColumn("place", r).where("place <= 3").select("src", "dst", r6("lo").alias("lo"), "place")


FUSED = f"WITH {FITS}, u AS (SELECT src, dst FROM f1 UNION SELECT src, dst FROM f2), m1 AS (SELECT src, min(lo) - 1 AS f FROM f1 GROUP BY 1), m2 AS (SELECT src, min(lo) - 1 AS f FROM f2 GROUP BY 1), g AS (SELECT u.src, u.dst, 0.6 * coalesce(f1.lo, m1.f, -11) + 0.4 * coalesce(f2.lo, m2.f, -11) AS lo FROM u LEFT JOIN f1 USING (src, dst) LEFT JOIN f2 USING (src, dst) LEFT JOIN m1 ON m1.src = u.src LEFT JOIN m2 ON m2.src = u.src) SELECT src, dst, {R('lo', 'lo')}, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(lo, 6) DESC, dst) AS place FROM g) WHERE place <= 3"


def purity_weighted(spark, d):
    """Log-odds with the chance that both rows have one label taken in: logit(sigmoid(lo) p ** 0.5)."""
    a, _ = _fits(spark, d)
    p = probabilities(spark, d).select("id", "p")
    j = a.join(p.select(F.col("id").alias("src"), F.col("p").alias("x")), "src").join(p.select(F.col("id").alias("dst"), F.col("p").alias("y")), "dst")
    same = A.dot(F.col("x"), F.col("y"))
    return j.select("src", "dst", r6(same).alias("same"), r6(linking.log_odds(1 / (1 + F.exp(-F.col("lo"))) * F.sqrt(same))).alias("lo"))


_L = "least(greatest(1 / (1 + exp(-lo)) * sqrt(same), 1e-6), 1 - 1e-6)"
PURITY = f"WITH {PROBS}, {FITS.removeprefix(_V)}, j AS (SELECT src, dst, any_value(lo) AS lo, sum(a.p * b.p) AS same FROM f1 JOIN prob a ON a.id = src JOIN prob b ON b.id = dst AND b.class = a.class GROUP BY src, dst) SELECT src, dst, {R('same', 'same')}, {R(f'ln({_L} / (1 - {_L}))', 'lo')} FROM j"


def tile_votes(spark, d):
    a, b = _fits(spark, d)
    return linking.tile_votes([a, b], a, 0.5).select("src", "dst", r6("v").alias("v"))


VOTES = f"WITH {FITS}, u AS (SELECT src, dst, 0.5 / (1 + exp(-lo)) AS v FROM f1 UNION ALL SELECT src, dst, 0.5 / (1 + exp(-lo)) FROM f2 UNION ALL SELECT src, dst, 0.5 / (1 + exp(-lo)) FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(lo, 6) DESC, dst) AS r FROM f1) WHERE r <= 3) SELECT src, dst, {R('sum(v)', 'v')} FROM u GROUP BY src, dst"


def composed(spark, d):
    """Strong mutual links first, then one-to-one links that contradict none of them."""
    t = top(spark, d)
    one = graph.one_to_one(t)
    return linking.composed(one.where("s >= 0.3"), one.where("s < 0.3").unionByName(one.select("session", (F.col("src") + 5).alias("src"), "dst", "s")))


COMPOSED = f"WITH {LINKS}, a AS (SELECT src, dst FROM link WHERE s >= 0.3), b AS (SELECT src, dst FROM link WHERE s < 0.3 UNION ALL SELECT src + 5, dst FROM link) SELECT src, dst, 0 AS origin FROM a UNION ALL SELECT src, dst, 1 FROM b WHERE src NOT IN (SELECT src FROM a) AND dst NOT IN (SELECT dst FROM a)"


def _placed(spark, d):
    return graph.chains(graph.one_to_one(top(spark, d)), vectors(spark, d)).select("id", "chain", "pos")


def fragments(spark, d):
    links = graph.one_to_one(top(spark, d)).select(F.col("dst").alias("id"), "s")
    out = linking.fragments(_placed(spark, d).join(links, "id", "left"), F.col("s") >= 0.3)
    return out.select("id", "chain", F.col("fragment").cast("int").alias("fragment"), F.col("offset").cast("int").alias("offset"))


FRAGMENTS = f"{CHAINS}, f AS (SELECT id, chain, pos, sum(CASE WHEN pos > 0 AND NOT coalesce(s >= 0.3, false) THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY pos) AS fragment FROM chain LEFT JOIN link ON link.dst = id) SELECT id, chain, fragment::INT AS fragment, (row_number() OVER (PARTITION BY chain, fragment ORDER BY pos) - 1)::INT AS \"offset\" FROM f"


def chain_evidence(spark, d):
    """Candidate pairs with their support along both chains, and whether the chains' distance is the link's."""
    t = top(spark, d)
    placed = _placed(spark, d)
    s = linking.parallel_support(t, placed, 2)
    a, b = placed.select(F.col("id").alias("src"), F.col("chain").alias("ca"), F.col("pos").alias("pa")), placed.select(F.col("id").alias("dst"), F.col("chain").alias("cb"), F.col("pos").alias("pb"))
    j = s.join(a, "src").join(b, "dst")
    ahead = F.when(F.col("ca") == F.col("cb"), F.col("pb") - F.col("pa"))
    return j.select("src", "dst", "support", F.coalesce(ahead, F.lit(0)).cast("int").alias("ahead"), F.coalesce(ahead == 1, F.lit(False)).alias("consistent"))


EVIDENCE = f"{CHAINS}, p AS MATERIALIZED (SELECT src, dst, a.chain AS ca, a.pos AS pa, b.chain AS cb, b.pos AS pb FROM topk JOIN chain a ON a.id = src JOIN chain b ON b.id = dst), o AS (SELECT unnest([-2, -1, 1, 2]) AS o), s AS (SELECT p.src, p.dst, count(q.src) AS support FROM p, o LEFT JOIN p q ON q.ca = p.ca AND q.cb = p.cb AND q.pa = p.pa + o AND q.pb = p.pb + o GROUP BY ALL) SELECT src, dst, support, (CASE WHEN ca = cb THEN pb - pa ELSE 0 END)::INT AS ahead, coalesce(ca = cb AND pb - pa = 1, false) AS consistent FROM p JOIN s USING (src, dst)"


def limb_candidates(spark, d):
    """Pairs of one limb (id % 4) among the best three of the row or the best two of the column."""
    t = top(spark, d).where("src % 4 = dst % 4")
    row, col = Window.partitionBy("src"), Window.partitionBy("dst")
    t = t.withColumns({"place": F.row_number().over(row.orderBy(F.desc("s"), "dst")), "back": F.row_number().over(col.orderBy(F.desc("s"), "src")), "n_row": F.count("*").over(row), "lead": F.col("s") - F.max("s").over(row), "z": (F.col("s") - F.avg("s").over(row)) / (F.stddev_pop("s").over(row) + F.lit(1e-6))})
    return t.where("place <= 3 or back <= 2").select("src", "dst", "s", "place", "back", "n_row", r6("lead").alias("lead"), r6("z").alias("z"))


LIMB = f"WITH {TOP}, t AS (SELECT src, dst, s, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst)::INT AS place, row_number() OVER (PARTITION BY dst ORDER BY s DESC, src)::INT AS back, count(*) OVER (PARTITION BY src) AS n_row, s - max(s) OVER (PARTITION BY src) AS \"lead\", (s - avg(s) OVER (PARTITION BY src)) / (stddev_pop(s) OVER (PARTITION BY src) + 1e-6) AS z FROM topk WHERE src % 4 = dst % 4) SELECT src, dst, s, place, back, n_row, {R('\"lead\"', '\"lead\"')}, {R('z', 'z')} FROM t WHERE place <= 3 OR back <= 2"


def edge_features(spark, d):
    """Label-free features of links: score, rank, margin, whether mutual, divergence and agreement of guesses."""
    t = top(spark, d)
    links = graph.one_to_one(t).select("src", "dst")
    second = t.groupBy("src").agg(F.max("s").alias("m1"), F.max(F.when(F.col("rank") == 2, F.col("s"))).alias("m2"), F.avg("s").alias("mean"))
    back = t.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rank").alias("back"))
    p = probabilities(spark, d).select("id", "p")
    j = links.join(t, ["src", "dst"]).join(second, "src").join(back, ["src", "dst"], "left")
    j = j.join(p.select(F.col("id").alias("src"), F.col("p").alias("a")), "src").join(p.select(F.col("id").alias("dst"), F.col("p").alias("b")), "dst")
    a, b = F.col("a"), F.col("b")
    return j.select("src", "dst", "s", "rank", r6(F.col("m1") - F.col("m2")).alias("margin"), r6(F.col("s") - F.col("mean")).alias("above"), F.col("back").isNotNull().alias("mutual"), r6(A.l1(a, b)).alias("l1"), r6(A.dot(a, b)).alias("agree"), r6(F.array_max(a) - F.array_max(b)).alias("surer"))


EDGE = f"WITH {PROBS}, {LINKS.removeprefix(_V)}, m AS (SELECT src, max(s) AS m1, max(CASE WHEN rank = 2 THEN s END) AS m2, avg(s) AS mean FROM topk GROUP BY 1), q AS (SELECT link.src, link.dst, sum(abs(a.p - b.p)) AS l1, sum(a.p * b.p) AS agree, max(a.p) - max(b.p) AS surer FROM link JOIN prob a ON a.id = src JOIN prob b ON b.id = dst AND b.class = a.class GROUP BY ALL) SELECT l.src, l.dst, t.s, t.rank::INT AS rank, {R('m1 - m2', 'margin')}, {R('t.s - mean', 'above')}, k.src IS NOT NULL AS mutual, {R('l1', 'l1')}, {R('agree', 'agree')}, {R('surer', 'surer')} FROM link l JOIN topk t ON t.src = l.src AND t.dst = l.dst JOIN m ON m.src = l.src LEFT JOIN topk k ON k.src = l.dst AND k.dst = l.src JOIN q ON q.src = l.src AND q.dst = l.dst"


def link_quality(spark, d):
    """Links against the true successor (the next id of the session): precision, recall, the share of
    one label, coverage by score, all for low and high labels apart."""
    v = vectors(spark, d)
    links = graph.one_to_one(top(spark, d))
    a = v.select(F.col("id").alias("src"), F.col("label").alias("la"), F.lead("id").over(Window.partitionBy("session").orderBy("id")).alias("next"))
    j = a.join(links.select("src", "dst", "s"), "src", "left").join(v.select(F.col("id").alias("dst"), F.col("label").alias("lb")), "dst", "left")
    exact = F.coalesce(F.col("dst") == F.col("next"), F.lit(False)).cast("int")
    linked = F.count("dst")
    return j.groupBy((F.col("la") < 5).alias("low")).agg(F.count("*").alias("n"), linked.alias("linked"), r6(F.sum(exact) / F.greatest(linked, F.lit(1))).alias("precision"), r6(F.sum(exact) / F.count("next")).alias("recall"), r6(F.avg((F.col("la") == F.col("lb")).cast("int"))).alias("same"), r6(F.avg((F.coalesce("s", F.lit(0.0)) >= 0.3).cast("int"))).alias("covered30"), r6(F.avg((F.coalesce("s", F.lit(0.0)) >= 0.4).cast("int"))).alias("covered40"))


QUALITY = f"WITH {LINKS}, a AS (SELECT id AS src, label AS la, lead(id) OVER (PARTITION BY session ORDER BY id) AS nx FROM vec), j AS (SELECT a.*, l.dst, l.s, v.label AS lb FROM a LEFT JOIN link l USING (src) LEFT JOIN vec v ON v.id = l.dst) SELECT la < 5 AS low, count(*) AS n, count(dst) AS linked, {R('sum(coalesce(dst = nx, false)::INT) / greatest(count(dst), 1)', 'precision')}, {R('sum(coalesce(dst = nx, false)::INT) / count(nx)', 'recall')}, {R('avg((la = lb)::INT)', 'same')}, {R('avg((coalesce(s, 0) >= 0.3)::INT)', 'covered30')}, {R('avg((coalesce(s, 0) >= 0.4)::INT)', 'covered40')} FROM j GROUP BY 1"


def boundary_joins(spark, d):
    """Windows of eight with a stride of four: those whose second half is another's first half, and those
    whose last value is another's first, of one user."""
    w = tiling.sliding(samples(spark, d), "user_id", 8, 4)
    x = w.groupBy("user_id", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.round("value", 2).alias("x")))), lambda s: s["x"]).alias("x"))
    a = x.select("user_id", F.col("w").alias("a"), F.slice("x", 5, 4).alias("half"), F.get("x", F.lit(7)).alias("edge"))
    b = x.select("user_id", F.col("w").alias("b"), F.slice("x", 1, 4).alias("half"), F.get("x", F.lit(0)).alias("edge"))
    over = a.drop("edge").join(b.drop("edge"), ["user_id", "half"]).select("user_id", "a", "b", F.lit("overlap").alias("kind"))
    touch = a.drop("half").join(b.drop("half"), ["user_id", "edge"]).where("a <> b").select("user_id", "a", "b", F.lit("touch").alias("kind"))
    return over.unionByName(touch)


JOINS = f"WITH {SAMPLES}, n AS (SELECT user_id, count(*) AS n FROM samples GROUP BY 1), w AS (SELECT user_id, unnest(range(0, (n - 8) // 4 + 1)) AS w FROM n WHERE n >= 8), x AS (SELECT user_id, w::INT AS w, list(round(value, 2) ORDER BY idx) AS x FROM w JOIN samples USING (user_id) WHERE idx BETWEEN w * 4 AND w * 4 + 7 GROUP BY user_id, w) SELECT a.user_id, a.w AS a, b.w AS b, 'overlap' AS kind FROM x a JOIN x b ON a.user_id = b.user_id AND a.x[5:8] = b.x[1:4] UNION ALL SELECT a.user_id, a.w, b.w, 'touch' FROM x a JOIN x b ON a.user_id = b.user_id AND a.x[8] = b.x[1] AND a.w <> b.w"


def edge_context(spark, d):
    """Means of class 0 over up to three rows before and after each edge of a chain."""
    c = _placed(spark, d).join(tall(probabilities(spark, d)).where("class = 0").select("id", "p"), "id")
    w = Window.partitionBy("chain").orderBy("pos")
    out = c.withColumns({"next": F.lead("id").over(w), "before": F.avg("p").over(w.rowsBetween(-2, 0)), "after": F.avg("p").over(w.rowsBetween(1, 3)), "far": F.avg("p").over(w.rowsBetween(1, 8))})
    return out.where("next is not null").select("id", "next", r6("before").alias("before"), r6("after").alias("after"), r6("far").alias("far"))


EDGE_CONTEXT = f"{_WITH}{PROBS}, {CHAINS.removeprefix(_WITH).removeprefix(_V)}, c AS (SELECT chain, pos, id, p FROM chain JOIN prob USING (id) WHERE class = 0), e AS (SELECT id, lead(id) OVER w AS \"next\", avg(p) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS b, avg(p) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a, avg(p) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS f FROM c WINDOW w AS (PARTITION BY chain ORDER BY pos)) SELECT id, \"next\", {R('b', 'before')}, {R('a', 'after')}, {R('f', 'far')} FROM e WHERE \"next\" IS NOT NULL"


def drawn(spark, d):
    """For each event a type drawn from all events' shares, by the inverse of their running sum."""
    s = samples(spark, d)
    n = s.groupBy("event_type").agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(0))  # a row for each type
    cdf = n.withColumns({"hi": F.sum("n").over(one.orderBy("event_type")), "all": F.sum("n").over(one)}).select(F.col("event_type").alias("drawn"), ((F.col("hi") - F.col("n")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"))
    u = s.select("event_id", (sampling.lcg(F.col("event_id") + 7) / sampling.MOD).alias("u"))
    return u.join(F.broadcast(cdf), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("event_id", "drawn")


DRAWN = "WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), c AS (SELECT event_type AS drawn, (sum(n) OVER (ORDER BY event_type) - n) / sum(n) OVER () AS lo, sum(n) OVER (ORDER BY event_type) / sum(n) OVER () AS hi FROM n), u AS (SELECT event_id, (((event_id + 7) % 2147483648 * 1103515245 + 12345) % 2147483648) / 2147483648 AS u FROM events) SELECT event_id, drawn FROM u JOIN c ON u >= lo AND u < hi"

QUERIES = {
    "link_descriptors": (descriptors, DESCRIPTORS),
    "link_boundary_features": (boundary_features, BOUNDARY),
    "link_boundary_cost": (boundary_cost, COST),
    "link_averaged_odds": (averaged, f"WITH {FITS} SELECT src, dst, {R('(sum(lo) - 50 * (2 - count(*))) / 2', 'lo')} FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY src, dst"),
    "link_fused_fits": (fused, FUSED),
    "link_purity_weighted": (purity_weighted, PURITY),
    "link_tile_votes": (tile_votes, VOTES),
    "link_composed": (composed, COMPOSED),
    "link_fragments": (fragments, FRAGMENTS),
    "link_chain_evidence": (chain_evidence, EVIDENCE),
    "link_limb_candidates": (limb_candidates, LIMB),
    "link_edge_features": (edge_features, EDGE),
    "link_quality": (link_quality, QUALITY),
    "link_edge_context": (edge_context, EDGE_CONTEXT),
    "windows_boundary_joins": (boundary_joins, JOINS),
    "sampling_drawn_types": (drawn, DRAWN),
}
