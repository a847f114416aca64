"""The graph decoder: two-graph propagation, self-training, ensembles of settings, finishing, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import config
from ..operators import decode, graph
from .common import CLASSES, PROBS, VECTORS, probabilities, r6, tall, vectors
from .vectors import CHAINS, COMPONENTS, EDGES, LINKS, TOP, same_label_components, top

_WITH = "WITH RECURSIVE "
_T = 0.1  # temperature of the links' sigmoid


def _rest(sql: str, *known: str) -> str:
    for k in (_WITH, *known):
        sql = sql.removeprefix(k)
    return sql


_V = VECTORS + ", "
_GRAPH = f"{PROBS}, {_rest(EDGES, _V)}, {LINKS.removeprefix(TOP + ', ')}"


def _parts(spark, d):
    t = top(spark, d)
    return graph.symmetric(graph.kernel(t, 0.1)), graph.one_to_one(t), tall(probabilities(spark, d)).select("session", "id", "class", "p")


def _targets(p):
    n = p.select("session", "id").distinct()
    return decode.default_targets(n, 8.0, 0.05, CLASSES)


TARGETS = "cnt AS (SELECT session, count(DISTINCT id)::DOUBLE AS n FROM prob GROUP BY 1), tgt AS (SELECT session, c AS class, CASE WHEN c = 0 THEN greatest(n - 72, n * 0.05) ELSE (n - greatest(n - 72, n * 0.05)) / 9 END AS target FROM cnt, (SELECT unnest(range(0, 10)) AS c))"


def _mixed_edges(name: str, bias: float, beta: float, mode: str) -> str:
    gate = f"{beta} * least(d / 2, 1.0)" if mode == "abs" else f"{beta}"
    return (
        f"{name}_l AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1 / (1 + exp(-(s - {bias}) / {_T})) AS w FROM link UNION ALL SELECT dst, src, 1 / (1 + exp(-(s - {bias}) / {_T})) FROM link) GROUP BY ALL), "
        f"{name}_g AS (SELECT src, d, {gate} AS b FROM (SELECT src, sum(w) AS d FROM {name}_l GROUP BY 1)), "
        f"{name} AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT e.src, e.dst, e.w / deg.d * (1 - coalesce(g.b, 0)) AS w FROM sym e JOIN deg ON deg.src = e.src LEFT JOIN {name}_g g ON g.src = e.src UNION ALL SELECT l.src, l.dst, l.w / g.d * g.b FROM {name}_l l JOIN {name}_g g ON g.src = l.src) GROUP BY ALL)"
    )


def _spread(name: str, edges: str, start: str, alpha: float, rounds: int) -> str:
    """``name``: (session, id, class, p) after the rounds from ``start``, normalised."""
    out = [f"{name}_0 AS (SELECT session, id, class, p FROM {start})"]
    for k in range(1, rounds + 1):
        out.append(f"{name}_{k} AS MATERIALIZED (SELECT z.session, z.id, z.class, {alpha} * coalesce(m, 0) + {1 - alpha:.6g} * z.p AS p FROM {start} z LEFT JOIN (SELECT e.src AS id, f.class, sum(e.w * f.p) AS m FROM {edges} e JOIN {name}_{k - 1} f ON f.id = e.dst GROUP BY ALL) y ON y.id = z.id AND y.class = z.class)")
    out.append(f"{name} AS MATERIALIZED (SELECT session, id, class, p / sum(p) OVER (PARTITION BY id) AS p FROM {name}_{rounds})")
    return ", ".join(out)


def _fitted(name: str, source: str, power: float, rounds: int) -> str:
    out = [f"{name}_0 AS (SELECT session, id, class, greatest(p, 1e-12) ** {power} / sum(greatest(p, 1e-12) ** {power}) OVER (PARTITION BY id) AS p FROM {source})"]
    for k in range(1, rounds + 1):
        out.append(f"{name}_c{k} AS (SELECT z.session, id, z.class, z.p * target / greatest(sum(z.p) OVER (PARTITION BY z.session, z.class), 1e-12) AS p FROM {name}_{k - 1} z JOIN tgt ON tgt.session = z.session AND tgt.class = z.class)")
        out.append(f"{name}_{k} AS MATERIALIZED (SELECT session, id, class, p / greatest(sum(p) OVER (PARTITION BY id), 1e-12) AS p FROM {name}_c{k})")
    out.append(f"{name} AS (SELECT * FROM {name}_{rounds})")
    return ", ".join(out)


def _normal(p):
    return p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("id")))


def _propagated(edges, start, alpha, rounds):
    f = graph.propagate(edges, start.drop("session"), alpha, rounds)
    return _normal(start.select("session", "id", "class").join(f, ["id", "class"]))


def gated(spark, d):
    """Neighbours and links, under both ways to take the gate."""
    knn, links, p = _parts(spark, d)
    w = graph.link_weights(links, 0.2, _T)
    a, b = (_propagated(graph.gated(knn, w, 0.8, mode), p, 0.9, 2) for mode in ("row", "abs"))
    j = a.select("id", "class", F.col("p").alias("a")).join(b.select("id", "class", F.col("p").alias("b")), ["id", "class"])
    return j.select("id", F.col("class").cast("int").alias("class"), r6("a").alias("by_row"), r6("b").alias("by_weight"))


GATED = f"WITH {_GRAPH}, {_mixed_edges('ea', 0.2, 0.8, 'row')}, {_mixed_edges('eb', 0.2, 0.8, 'abs')}, {_spread('fa', 'ea', 'prob', 0.9, 2)}, {_spread('fb', 'eb', 'prob', 0.9, 2)} SELECT id, class::INT AS class, round(fa.p + 3e-8, 6) + 0.0 AS by_row, round(fb.p + 3e-8, 6) + 0.0 AS by_weight FROM fa JOIN fb USING (id, class)"

ROUNDS, FITS = 2, 1  # propagation and proportional fitting, in each round of self-training


def decoded(knn, links, p, c: config.Propagation):
    """One setting: gated propagation, then rounds on ``p`` mixed with count-calibrated pseudo-labels."""
    edges = graph.settle(graph.gated(knn, graph.link_weights(links, c.bias, _T), c.gate, c.mode))
    f = _propagated(edges, p, c.alpha, ROUNDS)
    for _ in range(c.rounds - 1):
        q = decode.ipf(decode.powered(graph.settle(f), 2.0), _targets(p), FITS)
        f = _propagated(edges, decode.mixed(p, q, c.mixing), c.alpha, ROUNDS)
    return f


def _decoded_sql(name: str, c: config.Propagation) -> str:
    out = [_mixed_edges(f"{name}e", c.bias, c.gate, c.mode), _spread(f"{name}1", f"{name}e", "prob", c.alpha, ROUNDS)]
    for k in range(2, c.rounds + 1):
        out.append(_fitted(f"{name}q{k}", f"{name}{k - 1}", 2.0, FITS))
        out.append(f"{name}m{k} AS MATERIALIZED (SELECT session, id, class, m / sum(m) OVER (PARTITION BY id) AS p FROM (SELECT p.session, p.id, p.class, greatest(p.p, 1e-12) ** {1 - c.mixing:.6g} * greatest(q.p, 1e-12) ** {c.mixing} AS m FROM prob p JOIN {name}q{k} q ON q.id = p.id AND q.class = p.class))")
        out.append(_spread(f"{name}{k}", f"{name}e", f"{name}m{k}", c.alpha, ROUNDS))
    return ", ".join(out)


SETTINGS = ("g0/abs0.8/b0.2/a0.95/r2w0.5", "g0/row0.5/b0.1/a0.9/r1w0.5")


def self_training(spark, d):
    f = decoded(*_parts(spark, d), config.parse("g0/abs0.8/b0.2/a0.95/r3w0.7"))
    return f.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


SELF_TRAINING = f"WITH {_GRAPH}, {TARGETS}, {_decoded_sql('s', config.parse('g0/abs0.8/b0.2/a0.95/r3w0.7'))} SELECT id, class::INT AS class, round(p + 3e-8, 6) + 0.0 AS p FROM s3"


def ensemble(spark, d):
    """Mean of the settings' results; the settings are data."""
    parts = _parts(spark, d)
    out = reduce(lambda a, b: a.unionByName(b), (decoded(*parts, config.parse(s)) for s in SETTINGS))
    return out.groupBy("id", "class").agg(F.avg("p").alias("p")).select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


ENSEMBLE = f"WITH {_GRAPH}, {TARGETS}, {', '.join(_decoded_sql(f's{k}x', config.parse(s)) for k, s in enumerate(SETTINGS))} SELECT id, class::INT AS class, round(avg(p) + 3e-8, 6) + 0.0 AS p FROM (SELECT * FROM s0x2 UNION ALL SELECT * FROM s1x1) GROUP BY ALL"


def finished(spark, d):
    """Default targets, sharpening, proportional fitting, best class."""
    p = tall(probabilities(spark, d)).select("session", "id", "class", "p")
    out = decode.finish(p, _targets(p), 0.5, 3)
    return out.select("session", "id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


_BEST = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({s}, 6) DESC, class) AS r FROM {source}) WHERE r = 1"
FINISHED = f"WITH {PROBS}, {TARGETS}, {_fitted('q', 'prob', 2.0, 3)} {_BEST.format(cols='session, id, class::INT AS class, round(p + 3e-8, 6) + 0.0 AS p', by='id', s='p', source='q')}"


def _banded(step: float, below: float, above: float, rounds: int):
    def query(spark, d):
        p = tall(probabilities(spark, d)).select("session", "id", "class", "p")
        bands = _targets(p).select("session", "class", (F.col("target") - below).alias("lo"), (F.col("target") + above).alias("hi"))
        out = decode.count_bands(p.select("session", "id", "class", F.ln(F.greatest("p", F.lit(1e-9))).alias("s")), bands, step, rounds)
        return out.select("session", "id", F.col("class").cast("int").alias("class"), r6("s").alias("s"))

    ctes = [f"b0 AS (SELECT session, class, target - {below} AS lo, target + {above} AS hi, 0.0::DOUBLE AS bias FROM tgt)", "sc AS (SELECT session, id, class, ln(greatest(p, 1e-9)) AS s FROM prob)"]
    for k in range(rounds + 1):
        ctes.append(f"t{k} AS (SELECT sc.session, id, sc.class, s + bias AS s FROM sc JOIN b{k} b ON b.session = sc.session AND b.class = sc.class)")
        ctes.append(f"l{k} AS MATERIALIZED ({_BEST.format(cols='session, id, class, s', by='id', s='s', source=f't{k}')})")
        if k < rounds:
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT session, class, lo, hi, bias + CASE WHEN coalesce(n, 0) < lo THEN {step} WHEN coalesce(n, 0) > hi THEN -{step} ELSE 0 END AS bias FROM b{k} LEFT JOIN (SELECT session, class, count(*) AS n FROM l{k} GROUP BY ALL) USING (session, class))")
    return query, f"WITH {PROBS}, {TARGETS}, {', '.join(ctes)} SELECT session, id, class::INT AS class, round(s + 3e-8, 6) + 0.0 AS s FROM l{rounds}"


def hybrid(spark, d):
    """Cosine plus half of the dot product of the roots of two rows' distributions."""
    p = tall(probabilities(spark, d)).select("id", "class", F.sqrt("p").alias("q"))
    t = top(spark, d)
    dots = t.select("src", "dst").join(p.withColumnRenamed("id", "src"), "src").join(p.select(F.col("id").alias("dst"), "class", F.col("q").alias("q2")), ["dst", "class"]).groupBy("src", "dst").agg(F.sum(F.col("q") * F.col("q2")).alias("agree"))
    out = t.join(dots, ["src", "dst"]).withColumn("h", F.col("s") + 0.5 * F.col("agree"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("h", 5)), "dst"))
    return out.select("src", "dst", r6("h").alias("h"), rank.alias("place"))


HYBRID = f"WITH {PROBS}, {TOP.removeprefix(_V)}, h AS (SELECT src, dst, any_value(s) + 0.5 * sum(sqrt(a.p) * sqrt(b.p)) AS h FROM topk JOIN prob a ON a.id = src JOIN prob b ON b.id = dst AND b.class = a.class GROUP BY src, dst) SELECT src, dst, round(h + 3e-8, 6) + 0.0 AS h, row_number() OVER (PARTITION BY src ORDER BY round(h, 5) DESC, dst)::INT AS place FROM h"


def link_union(spark, d):
    """Links, mutual neighbours and a little of the whole neighbour graph as one weighted graph."""
    knn, links, _ = _parts(spark, d)
    t = top(spark, d)
    back = t.select("session", F.col("dst").alias("src"), F.col("src").alias("dst")).join(t, ["session", "src", "dst"])
    e = graph.united([(graph.link_weights(links, 0.2, _T), 1.0), (graph.link_weights(back.where("src < dst").select("session", "src", "dst", "s"), 0.3, _T), 0.5), (graph.row_normalised(knn), 0.3)])
    return e.select("src", "dst", r6("w").alias("w"))


def _weights(source: str, bias: float) -> str:
    w = f"1 / (1 + exp(-(s - {bias}) / {_T}))"
    return f"SELECT src, dst, {w} AS w FROM {source} UNION ALL SELECT dst, src, {w} FROM {source}"


LINK_UNION = f"WITH {EDGES}, {LINKS.removeprefix(TOP + ', ')}, mu AS (SELECT a.src, a.dst, a.s FROM topk a JOIN topk b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst), u AS (SELECT src, dst, w FROM ({_weights('link', 0.2)}) UNION ALL SELECT src, dst, w * 0.5 FROM ({_weights('mu', 0.3)}) UNION ALL SELECT e.src, e.dst, 0.3 * e.w / deg.d FROM sym e JOIN deg ON deg.src = e.src) SELECT src, dst, round(sum(w) + 3e-8, 6) + 0.0 AS w FROM u GROUP BY src, dst"


def _confident_links(spark, d):
    return graph.one_to_one(top(spark, d)).select("src", "dst", (1 / (1 + F.exp(-(F.col("s") - 0.2) / _T))).alias("conf"))


CONF = f"{LINKS}, cl AS (SELECT src, dst, 1 / (1 + exp(-(s - 0.2) / {_T})) AS conf FROM link)"
WALK = f"{CONF}, wk AS (SELECT src, dst, conf, 1 AS hop FROM cl UNION ALL SELECT dst, src, conf, -1 FROM cl), w2 AS (SELECT a.src, b.dst, a.conf * b.conf AS conf, sign(a.hop)::INT * 2 AS hop FROM wk a JOIN wk b ON b.src = a.dst AND b.hop = a.hop), w3 AS (SELECT a.src, b.dst, a.conf * b.conf AS conf, sign(a.hop)::INT * 3 AS hop FROM w2 a JOIN wk b ON b.src = a.dst AND b.hop = sign(a.hop)), walk AS (SELECT * FROM wk UNION ALL SELECT src, dst, conf, hop FROM w2 UNION ALL SELECT src, dst, conf, hop FROM w3)"


def chain_walk(spark, d):
    """Up to three links ahead and back, with the product of the links' confidences."""
    return graph.walk(_confident_links(spark, d), 3).select("src", "dst", "hop", r6("conf").alias("conf"))


def confident_context(spark, d):
    """Each row's distribution averaged with its chain's, weighted by confidence squared and distance."""
    w = graph.walk(_confident_links(spark, d), 2).select("src", "dst", (F.pow("conf", F.lit(2.0)) * F.pow(F.lit(0.5), F.abs("hop"))).alias("w"))
    p = tall(probabilities(spark, d)).select("id", "class", "p")
    own = p.select(F.col("id").alias("src"), "class", "p", F.lit(1.0).alias("w"))
    near = w.join(p.withColumnRenamed("id", "dst"), "dst").select("src", "class", "p", "w")
    out = own.unionByName(near).groupBy(F.col("src").alias("id"), "class").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))
    return out.select("id", F.col("class").cast("int").alias("class"), r6("p").alias("p"))


CONTEXT = f"WITH {PROBS}, {WALK.removeprefix(_V)}, u AS (SELECT id, class, p, 1.0 AS w FROM prob UNION ALL SELECT src, class, p, conf ** 2 * 0.5 ** abs(hop) FROM walk JOIN prob ON prob.id = dst WHERE abs(hop) <= 2) SELECT id, class::INT AS class, round(sum(p * w) / sum(w) + 3e-8, 6) + 0.0 AS p FROM u GROUP BY id, class"


def hop_shares(spark, d):
    """Share of rows whose label is the row's own, by hop from -2 to 2, within each row's chain."""
    v = vectors(spark, d)
    w = graph.walk(_confident_links(spark, d), 2)
    j = w.join(v.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    same = (F.col("a") == F.col("b")).cast("int")
    return j.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), r6(F.avg(same)).alias("share"), r6(F.coalesce(F.avg(F.when(F.col("hop") > 0, same)), F.lit(0.0))).alias("ahead"))


HOP_SHARES = f"WITH {WALK}, j AS (SELECT src AS id, hop, (x.label = y.label)::INT AS same FROM walk JOIN vec x ON x.id = src JOIN vec y ON y.id = dst WHERE abs(hop) <= 2) SELECT id, count(*) AS n, round(avg(same) + 3e-8, 6) + 0.0 AS share, round(coalesce(avg(CASE WHEN hop > 0 THEN same END), 0) + 3e-8, 6) + 0.0 AS ahead FROM j GROUP BY id"


def prototypes(spark, d):
    """Cosine to the own session's class means, and the label's share among the 3 and 10 nearest."""
    v = vectors(spark, d)
    x = v.select("session", "label", F.posexplode("v").alias("k", "x")).groupBy("session", "label", "k").agg(F.avg("x").alias("m"))
    e = v.select("session", "id", "label", F.posexplode("v").alias("k", "x")).join(x, ["session", "label", "k"])
    cos = e.groupBy("id", "label").agg((F.sum(F.col("x") * F.col("m")) / F.sqrt(F.sum(F.col("x") ** 2) * F.sum(F.col("m") ** 2))).alias("c"))
    n = top(spark, d).join(v.select(F.col("id").alias("dst"), F.col("label").alias("near")), "dst")
    j = cos.join(n.withColumnRenamed("src", "id"), "id")
    same = (F.col("near") == F.col("label")).cast("int")
    return j.groupBy("id").agg(r6(F.first("c")).alias("cosine"), r6(F.avg(F.when(F.col("rank") <= 3, same))).alias("share3"), r6(F.avg(same)).alias("share10"))


PROTOTYPES = f"WITH {TOP}, e AS (SELECT session, id, label, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM vec), m AS (SELECT session, label, k, avg(x) AS m FROM e GROUP BY ALL), c AS (SELECT id, label, sum(x * m) / sqrt(sum(x * x) * sum(m * m)) AS c FROM e JOIN m USING (session, label, k) GROUP BY ALL) SELECT c.id, round(any_value(c.c) + 3e-8, 6) + 0.0 AS cosine, round(avg((y.label = c.label)::INT) FILTER (rank <= 3) + 3e-8, 6) + 0.0 AS share3, round(avg((y.label = c.label)::INT) + 3e-8, 6) + 0.0 AS share10 FROM c JOIN topk ON src = c.id JOIN vec y ON y.id = dst GROUP BY c.id"


def clusters(spark, d):
    """One label per cluster where its members' guesses are pure enough, by majority and by summed logs."""
    p = tall(probabilities(spark, d)).select("id", "class", "p")
    c = same_label_components(spark, d)
    own = decode.best(p).select("id", F.col("class").alias("g"))
    votes = c.join(own, "id").groupBy("root", F.col("g").alias("class")).agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy("root"))
    major = decode.best(votes.withColumn("purity", F.col("n") / size), "n", "root").select("root", F.col("class").alias("majority"), "purity")
    logs = c.join(p, "id").groupBy("root", "class").agg(F.sum(F.ln(F.greatest("p", F.lit(1e-9)))).alias("l"))
    summed = decode.best(logs, "l", "root").select("root", F.col("class").alias("summed"))
    out = c.join(own, "id").join(major, "root").join(summed, "root")
    label = F.when(F.col("purity") >= 0.6, F.col("majority")).otherwise(F.col("g"))
    return out.select("id", "root", F.col("g").cast("int").alias("own"), label.cast("int").alias("label"), F.col("summed").cast("int").alias("summed"), r6("purity").alias("purity"))


_REACH = "SELECT id, min(seen) AS root FROM reach GROUP BY id"
CLUSTERS = f"{_WITH}{PROBS}, {_rest(COMPONENTS, _V).removesuffix(' ' + _REACH)}, c AS ({_REACH}), g AS ({_BEST.format(cols='id, class AS g', by='id', s='p', source='prob')}), vt AS (SELECT root, class, n, n / sum(n) OVER (PARTITION BY root) AS purity FROM (SELECT root, g AS class, count(*) AS n FROM c JOIN g USING (id) GROUP BY ALL)), mj AS ({_BEST.format(cols='root, class AS majority, purity', by='root', s='n', source='vt')}), lg AS (SELECT root, class, sum(ln(greatest(p, 1e-9))) AS l FROM c JOIN prob USING (id) GROUP BY ALL), sm AS ({_BEST.format(cols='root, class AS summed', by='root', s='l', source='lg')}) SELECT id, root, g::INT AS own, (CASE WHEN purity >= 0.6 THEN majority ELSE g END)::INT AS label, summed::INT AS summed, round(purity + 3e-8, 6) + 0.0 AS purity FROM c JOIN g USING (id) JOIN mj USING (root) JOIN sm USING (root)"


def families(spark, d):
    """The best family by log-sum-exp, then the best class inside it; and with a penalty on the others."""
    p = tall(probabilities(spark, d)).select("session", "id", "class", "p")
    x = decode.family_scores(p, F.floor(F.col("class") / 2))
    top_f = F.max(F.round("f", 6)).over(Window.partitionBy("id"))
    hard = decode.best(x.withColumn("top", top_f).where("round(f, 6) = top")).select("id", F.col("class").alias("hard"))
    soft = decode.best(x.withColumn("s", F.ln(F.greatest("p", F.lit(1e-9))) + 0.5 * F.col("f")), "s").select("id", F.col("class").alias("soft"), "s")
    return hard.join(soft, "id").select("id", F.col("hard").cast("int").alias("hard"), F.col("soft").cast("int").alias("soft"), r6("s").alias("score"))


FAMILIES = f"WITH {PROBS}, x AS (SELECT id, class, p, ln(sum(p) OVER (PARTITION BY id, class // 2)) AS f FROM prob), t AS (SELECT *, max(round(f, 6)) OVER (PARTITION BY id) AS top, ln(greatest(p, 1e-9)) + 0.5 * f AS s FROM x), h AS (SELECT * FROM t WHERE round(f, 6) = top), a AS ({_BEST.format(cols='id, class AS hard', by='id', s='p', source='h')}), b AS ({_BEST.format(cols='id, class AS soft, s', by='id', s='s', source='t')}) SELECT id, hard::INT AS hard, soft::INT AS soft, round(s + 3e-8, 6) + 0.0 AS score FROM a JOIN b USING (id)"


def group_mask(spark, d):
    """A chain's mean distribution as a soft mask of its rows, taken only where it flips the best class;
    the strength is the better one on the other fold."""
    v = vectors(spark, d).select("id", "label", (F.col("id") % 2).alias("fold"))
    p = tall(probabilities(spark, d)).select("id", "class", "p")
    c = graph.chains(graph.one_to_one(top(spark, d)), vectors(spark, d)).select("id", "chain")
    q = c.join(p, "id").groupBy("chain", "class").agg(F.avg("p").alias("q"))
    j = c.join(p, "id").join(q, ["chain", "class"])
    own = decode.best(j).select("id", F.col("class").alias("own"))
    out = None
    for strength in (0.5, 2.0):
        m = decode.best(j.withColumn("s", F.ln(F.greatest("p", F.lit(1e-9))) + strength * F.ln(F.greatest("q", F.lit(1e-9)))), "s").select("id", F.col("class").alias("masked"), F.lit(strength).alias("strength"))
        out = m if out is None else out.unionByName(m)
    out = out.join(own, "id").join(v, "id")
    right = (F.col("masked") == F.col("label")).cast("int")
    score = out.groupBy("fold", "strength").agg(F.avg(right).alias("a"))
    r = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(F.round("a", 6)), "strength"))
    chosen = score.withColumn("r", r).where("r = 1").select((1 - F.col("fold")).alias("fold"), "strength")
    return out.join(chosen, ["fold", "strength"]).select("id", F.col("own").cast("int").alias("own"), F.col("masked").cast("int").alias("label"), (F.col("own") != F.col("masked")).alias("flipped"), "strength")


MASK = f"{_WITH}{PROBS}, {_rest(CHAINS, _V)}, q AS (SELECT chain, class, avg(p) AS q FROM chain JOIN prob USING (id) GROUP BY ALL), j AS (SELECT id, class, p, q FROM chain JOIN prob USING (id) JOIN q USING (chain, class)), o AS ({_BEST.format(cols='id, class AS own', by='id', s='p', source='j')}), st AS (SELECT unnest([0.5, 2.0])::DOUBLE AS strength), sj AS (SELECT id || ':' || strength AS k, id, class, strength, ln(greatest(p, 1e-9)) + strength * ln(greatest(q, 1e-9)) AS s FROM j, st), m AS ({_BEST.format(cols='id, class AS masked, strength', by='k', s='s', source='sj')}), a AS (SELECT id % 2 AS fold, strength, avg((masked = label)::INT) AS a FROM m JOIN vec USING (id) GROUP BY ALL), ch AS (SELECT 1 - fold AS fold, strength FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(a, 6) DESC, strength) AS r FROM a) WHERE r = 1) SELECT m.id, own::INT AS own, masked::INT AS label, own <> masked AS flipped, m.strength FROM m JOIN o ON o.id = m.id JOIN ch ON ch.fold = m.id % 2 AND ch.strength = m.strength"

QUERIES = {
    "graph_gated_propagation": (gated, GATED),
    "graph_self_training": (self_training, SELF_TRAINING),
    "graph_settings_ensemble": (ensemble, ENSEMBLE),
    "graph_hybrid_similarity": (hybrid, HYBRID),
    "graph_link_union": (link_union, LINK_UNION),
    "graph_prototypes": (prototypes, PROTOTYPES),
    "chain_walk": (chain_walk, f"WITH {WALK} SELECT src, dst, hop, round(conf + 3e-8, 6) + 0.0 AS conf FROM walk"),
    "chain_confident_context": (confident_context, CONTEXT),
    "chain_hop_shares": (hop_shares, HOP_SHARES),
    "decode_finish": (finished, FINISHED),
    "decode_count_bands": _banded(0.25, 4.0, 4.0, 3),
    "decode_soft_counts": _banded(0.3, 15.0, 15.0, 2),
    "decode_clusters": (clusters, CLUSTERS),
    "decode_families": (families, FAMILIES),
    "decode_group_mask": (group_mask, MASK),
}
