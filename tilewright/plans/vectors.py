"""Queries over embeddings: similarity joins, rank features, graphs, chains, votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import graph, pairs
from .common import PROBS, VECTORS, probabilities, r6, tall, vectors

K = 10
ALL = f"{VECTORS}, allp AS (SELECT a.session, a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS s FROM vec a JOIN vec b ON a.session = b.session AND a.id <> b.id)"
TOP = f"{ALL}, topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rank FROM allp) WHERE rank <= {K})"


def top(spark, d, k: int = K):
    v = vectors(spark, d)
    return pairs.topk(v, v, k)


def topk(spark, d):
    return top(spark, d).select("session", "src", "dst", "s", "rank")


def rank_features(spark, d):
    p = pairs.ranks(top(spark, d).drop("rank"))
    return p.select("src", "dst", "rank_row", "rank_col", r6("dom_row").alias("dom_row"), r6("dom_col").alias("dom_col"), r6("margin").alias("margin"), r6("dual").alias("dual"))


RANKS = f"""WITH {TOP}, a AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rank_row, row_number() OVER (PARTITION BY dst ORDER BY s DESC, src) AS rank_col, max(s) OVER (PARTITION BY src) AS mr, max(s) OVER (PARTITION BY dst) AS mc FROM topk),
b AS (SELECT *, max(CASE WHEN rank_row = 2 THEN s END) OVER (PARTITION BY src) AS s2, ln(sum(exp((s - mr) / 0.05)) OVER (PARTITION BY src)) + mr / 0.05 AS lr, ln(sum(exp((s - mc) / 0.05)) OVER (PARTITION BY dst)) + mc / 0.05 AS lc FROM a)
SELECT src, dst, rank_row::INT AS rank_row, rank_col::INT AS rank_col, round(s - mr + 3e-8, 6) + 0.0 AS dom_row, round(s - mc + 3e-8, 6) + 0.0 AS dom_col, round(mr - s2 + 3e-8, 6) + 0.0 AS margin, round(2 * s / 0.05 - lr - lc + 3e-8, 6) + 0.0 AS dual FROM b"""


def mutual(spark, d):
    return pairs.mutual(top(spark, d)).select("session", "src", "dst", "s")


MUTUAL = f"WITH {TOP} SELECT a.session, a.src, a.dst, a.s FROM topk a JOIN topk b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst"


def candidate_union(spark, d):
    t = top(spark, d)
    near = t.where("rank <= 5")
    back = t.where("rank <= 3").select("session", F.col("dst").alias("src"), F.col("src").alias("dst"), "s")
    close = t.where("s > 0.3")
    return pairs.candidates({"near": near, "back": back, "close": close}, 6).select("session", "src", "dst", "n_src", "s", "rank")


CANDIDATES = f"""WITH {TOP}, u AS (SELECT session, src, dst, s, 'near' AS source FROM topk WHERE rank <= 5 UNION ALL SELECT session, dst, src, s, 'back' FROM topk WHERE rank <= 3 UNION ALL SELECT session, src, dst, s, 'close' FROM topk WHERE s > 0.3),
g AS (SELECT session, src, dst, count(DISTINCT source) AS n_src, max(s) AS s FROM u GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n_src DESC, s DESC, dst)::INT AS rank FROM g) WHERE rank <= 6"""


def _fold_neighbours(spark, d, k: int = 5):
    """Nearest rows of the other half, across sessions."""
    v = vectors(spark, d).withColumn("session", F.lit(0))
    even, odd = v.where("id % 2 = 0"), v.where("id % 2 = 1")
    return pairs.topk(even, odd, k).unionByName(pairs.topk(odd, even, k))


def knn_vote(spark, d):
    n = _fold_neighbours(spark, d)
    v = vectors(spark, d).select(F.col("id").alias("dst"), "label")
    votes = n.join(v, "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("n"), F.sum(F.col("s") + 1).alias("w"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), F.desc(F.round("w", 4)), "label"))
    share = F.sum("w").over(Window.partitionBy("id"))
    return votes.withColumns({"r": best, "share": F.col("w") / share}).where("r = 1").select("id", F.col("label").alias("vote"), "n", r6("share").alias("share"))


FOLD = f"{VECTORS}, kn AS (SELECT * FROM (SELECT a.id AS src, b.id AS dst, b.label, round(list_cosine_similarity(a.v, b.v), 6) AS s, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.id) AS r FROM vec a JOIN vec b ON a.id % 2 <> b.id % 2) WHERE r <= 5), vo AS (SELECT src AS id, label, count(*) AS n, sum(s + 1) AS w FROM kn GROUP BY ALL), be AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, round(w, 4) DESC, label) AS r, w / sum(w) OVER (PARTITION BY id) AS share FROM vo)"
KNN = f"WITH {FOLD} SELECT id, label AS vote, n, round(share + 3e-8, 6) + 0.0 AS share FROM be WHERE r = 1"


def graph_weights(spark, d):
    e = graph.symmetric(graph.kernel(top(spark, d), 0.1))
    row = graph.row_normalised(e).withColumnRenamed("w", "row")
    deg = graph.degree_normalised(e).withColumnRenamed("w", "deg")
    return row.join(deg, ["session", "src", "dst"]).select("src", "dst", r6("row").alias("row"), r6("deg").alias("deg"))


EDGES = f"{TOP}, ker AS (SELECT session, src, dst, exp((s - max(s) OVER (PARTITION BY src)) / 0.1) AS w FROM topk), sym AS (SELECT session, src, dst, max(w) AS w FROM (SELECT * FROM ker UNION ALL SELECT session, dst, src, w FROM ker) GROUP BY ALL), deg AS (SELECT src, sum(w) AS d FROM sym GROUP BY 1)"
WEIGHTS = f'WITH {EDGES} SELECT e.src, e.dst, round(w / a.d + 3e-8, 6) + 0.0 AS "row", round(w / sqrt(a.d * b.d) + 3e-8, 6) + 0.0 AS deg FROM sym e JOIN deg a ON a.src = e.src JOIN deg b ON b.src = e.dst'


def _seed(spark, d):
    return tall(probabilities(spark, d)).select("session", "id", "class", "p")


def label_propagation(spark, d):
    e = graph.row_normalised(graph.symmetric(graph.kernel(top(spark, d), 0.1)))
    anchors = vectors(spark, d).where("id % 7 = 0").select("id")
    f = graph.propagate(e, _seed(spark, d).drop("session"), 0.8, 3, anchors)
    return f.select("id", "class", r6("p").alias("p"))


def _iterate(n: int, alpha: float) -> str:
    out = "f0 AS (SELECT id, class, p FROM prob)"
    for k in range(1, n + 1):
        out += f", f{k} AS (SELECT z.id, z.class, CASE WHEN z.id % 7 = 0 THEN z.p ELSE {alpha} * coalesce(m, 0) + {1 - alpha:.6g} * z.p END AS p FROM f0 z LEFT JOIN (SELECT e.src AS id, f.class, sum(e.w / g.d * f.p) AS m FROM sym e JOIN deg g ON g.src = e.src JOIN f{k - 1} f ON f.id = e.dst GROUP BY ALL) y ON y.id = z.id AND y.class = z.class)"
    return out


PROPAGATION = f"WITH {PROBS}, {EDGES.removeprefix(VECTORS + ', ')}, {_iterate(3, 0.8)} SELECT id, class::INT AS class, round(p + 3e-8, 6) + 0.0 AS p FROM f3"


def same_label_components(spark, d):
    v = vectors(spark, d)
    m = pairs.mutual(top(spark, d))
    a, b = v.select(F.col("id").alias("src"), F.col("label").alias("la")), v.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    e = m.join(a, "src").join(b, "dst").where("la = lb")
    c = graph.components(e, v)
    return c.select("id", "root")


COMPONENTS = f"WITH RECURSIVE {TOP}, m AS (SELECT a.src, a.dst FROM topk a JOIN topk b ON a.src = b.dst AND a.dst = b.src JOIN vec x ON x.id = a.src JOIN vec y ON y.id = a.dst WHERE x.label = y.label), reach AS (SELECT id, id AS seen FROM vec UNION SELECT r.id, m.dst FROM reach r JOIN m ON m.src = r.seen) SELECT id, min(seen) AS root FROM reach GROUP BY id"


def cluster_purity(spark, d):
    c = same_label_components(spark, d)
    v = vectors(spark, d).select("id", (F.col("id") % 4).alias("k"))
    n = c.join(v, "id").groupBy("root", "k").agg(F.count("*").alias("n"))
    return n.groupBy("root").agg(F.sum("n").alias("size"), r6(F.max("n") / F.sum("n")).alias("purity"))


PURITY = f"{COMPONENTS.replace('SELECT id, min(seen) AS root FROM reach GROUP BY id', 'SELECT root, sum(n)::BIGINT AS size, round(max(n) / sum(n) + 3e-8, 6) + 0.0 AS purity FROM (SELECT root, id % 4 AS k, count(*) AS n FROM (SELECT id, min(seen) AS root FROM reach GROUP BY id) GROUP BY ALL) GROUP BY root')}"

LINKS = f"{TOP}, up AS (SELECT * FROM (SELECT session, src, dst, s, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM topk WHERE src < dst) WHERE r = 1), link AS (SELECT session, src, dst, s FROM (SELECT session, src, dst, s, row_number() OVER (PARTITION BY dst ORDER BY s DESC, src) AS r FROM up) WHERE r = 1)"
CHAINS = f"WITH RECURSIVE {LINKS}, chain AS (SELECT id, id AS chain, 0 AS pos FROM vec WHERE id NOT IN (SELECT dst FROM link) UNION ALL SELECT l.dst, c.chain, c.pos + 1 FROM chain c JOIN link l ON l.src = c.id)"


def _chained(spark, d):
    return graph.chains(graph.one_to_one(top(spark, d)), vectors(spark, d))


def chain_positions(spark, d):
    return _chained(spark, d).select("id", "chain", "pos")


def chain_vote(spark, d):
    c = _chained(spark, d)
    p = _seed(spark, d).drop("session")
    s = c.join(p, "id").groupBy("chain", "class").agg(F.sum(F.ln(F.greatest("p", F.lit(1e-9)))).alias("l"))
    r = F.row_number().over(Window.partitionBy("chain").orderBy(F.desc(F.round("l", 6)), "class"))
    return s.withColumn("r", r).where("r = 1").select("chain", "class", r6("l").alias("score"))


_WITH = "WITH RECURSIVE"
CHAIN_VOTE = f"{_WITH} {PROBS}, {CHAINS.removeprefix(_WITH + ' ' + VECTORS + ', ')} SELECT chain, class::INT AS class, round(l + 3e-8, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY round(l, 6) DESC, class) AS r FROM (SELECT chain, class, sum(ln(greatest(p, 1e-9))) AS l FROM chain JOIN prob USING (id) GROUP BY ALL)) WHERE r = 1"


def chain_context(spark, d):
    c = _chained(spark, d).join(_seed(spark, d).where("class = 0").select("id", "p"), "id")
    return graph.chain_context(c, "p", 2, 0.5).select("id", r6("context").alias("context"))


CHAIN_CONTEXT = f"{_WITH} {PROBS}, {CHAINS.removeprefix(_WITH + ' ' + VECTORS + ', ')}, c AS (SELECT id, chain, pos, p FROM chain JOIN prob USING (id) WHERE class = 0) SELECT a.id, round(sum(b.p * 0.5 ** abs(a.pos - b.pos)) / sum(0.5 ** abs(a.pos - b.pos)) + 3e-8, 6) + 0.0 AS context FROM c a JOIN c b ON a.chain = b.chain AND abs(a.pos - b.pos) <= 2 GROUP BY a.id"


def chain_hops(spark, d):
    links = graph.one_to_one(top(spark, d))
    v = vectors(spark, d)
    h = graph.hops(links, 4)
    a, b = v.select(F.col("id").alias("src"), F.col("label").alias("la")), v.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    return h.join(a, "src").join(b, "dst").groupBy("hop").agg(F.count("*").alias("n"), r6(F.avg((F.col("la") == F.col("lb")).cast("int"))).alias("same"))


HOPS = f"WITH RECURSIVE {LINKS}, h AS (SELECT src, dst, 1 AS hop FROM link UNION ALL SELECT h.src, l.dst, hop + 1 FROM h JOIN link l ON l.src = h.dst WHERE hop < 4) SELECT hop, count(*) AS n, round(avg((x.label = y.label)::INT) + 3e-8, 6) + 0.0 AS same FROM h JOIN vec x ON x.id = src JOIN vec y ON y.id = dst GROUP BY hop"


def label_changes(spark, d):
    """Along chains: where the label changes, and each row's distance to the nearest change."""
    c = _chained(spark, d).join(vectors(spark, d).select("id", "label"), "id")
    w = Window.partitionBy("chain").orderBy("pos")
    at = c.withColumn("changed", F.when(F.lag("label").over(w).isNotNull() & (F.lag("label").over(w) != F.col("label")), F.col("pos")))
    back = F.last("changed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("changed", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return at.select("id", "label", F.col("changed").isNotNull().alias("is_change"), F.least(F.col("pos") - back, ahead - F.col("pos"), F.lit(20)).alias("distance"))


CHANGES = f"{CHAINS}, c AS (SELECT id, chain, pos, label, CASE WHEN lag(label) OVER (PARTITION BY chain ORDER BY pos) <> label THEN pos END AS ch FROM chain JOIN vec USING (id)) SELECT id, label, ch IS NOT NULL AS is_change, least(pos - max(ch) OVER (PARTITION BY chain ORDER BY pos), min(ch) OVER (PARTITION BY chain ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - pos, 20)::INT AS distance FROM c"


def twins(spark, d):
    v = vectors(spark, d)
    noisy = v.withColumn("v", F.transform("v", lambda x: x + F.lit(1e-9)))
    return pairs.twins(v, noisy, "v").select("session", "a_id", "b_id")


TWINS = f"WITH {VECTORS} SELECT a.session, a.id AS a_id, b.id AS b_id FROM vec a JOIN vec b ON a.session = b.session AND list_max(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))) < 5e-7"


def score_bins(spark, d):
    v = vectors(spark, d)
    a, b = v.select(F.col("id").alias("src"), F.col("label").alias("la")), v.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    p = top(spark, d).join(a, "src").join(b, "dst")
    t = pairs.log_odds_by_bin(p, "s", F.col("la") == F.col("lb"), [0.1, 0.2, 0.3, 0.4])
    return pairs.binned(p, "s", [0.1, 0.2, 0.3, 0.4], t).groupBy("bin").agg(F.count("*").alias("n"), r6(F.max("llr")).alias("llr"))


BINS = f"WITH {TOP}, p AS (SELECT (s >= 0.1)::INT + (s >= 0.2)::INT + (s >= 0.3)::INT + (s >= 0.4)::INT AS bin, x.label = y.label AS same FROM topk JOIN vec x ON x.id = src JOIN vec y ON y.id = dst), c AS (SELECT bin, sum(same::INT) AS p, sum((NOT same)::INT) AS q, count(*) AS n FROM p GROUP BY bin) SELECT bin, n, round(ln((p + 1) / (sum(p) OVER () + 5) / ((q + 1) / (sum(q) OVER () + 5))) + 3e-8, 6) + 0.0 AS llr FROM c"


def distribution_pairs(spark, d):
    """Divergences between the distributions of linked rows."""
    p = probabilities(spark, d).select("id", "p")
    links = graph.one_to_one(top(spark, d))
    j = links.join(p.withColumnRenamed("id", "src").withColumnRenamed("p", "a"), "src").join(p.withColumnRenamed("id", "dst").withColumnRenamed("p", "b"), "dst")
    a, b = F.col("a"), F.col("b")
    return j.select("src", "dst", r6(A.jensen_shannon(a, b)).alias("js"), r6(A.bhattacharyya(a, b)).alias("bc"), r6(A.l1(a, b)).alias("l1"), r6(A.dot(a, b)).alias("agree"))


DIVERGENCE = f"WITH {PROBS}, {LINKS.removeprefix(VECTORS + ', ')}, j AS (SELECT src, dst, a.p AS a, b.p AS b FROM link JOIN prob a ON a.id = src JOIN prob b ON b.id = dst AND b.class = a.class) SELECT src, dst, round(sum((a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2) + 3e-8, 6) + 0.0 AS js, round(sum(sqrt(a * b)) + 3e-8, 6) + 0.0 AS bc, round(sum(abs(a - b)) + 3e-8, 6) + 0.0 AS l1, round(sum(a * b) + 3e-8, 6) + 0.0 AS agree FROM j GROUP BY ALL"

QUERIES = {
    "pairs_topk": (topk, f"WITH {TOP} SELECT session, src, dst, s, rank::INT AS rank FROM topk"),
    "pairs_rank_features": (rank_features, RANKS),
    "pairs_mutual": (mutual, MUTUAL),
    "pairs_candidate_union": (candidate_union, CANDIDATES),
    "pairs_twins": (twins, TWINS),
    "pairs_score_bins": (score_bins, BINS),
    "pairs_divergence": (distribution_pairs, DIVERGENCE),
    "knn_vote": (knn_vote, KNN),
    "graph_weights": (graph_weights, WEIGHTS),
    "graph_label_propagation": (label_propagation, PROPAGATION),
    "graph_components": (same_label_components, COMPONENTS),
    "graph_cluster_purity": (cluster_purity, PURITY),
    "chain_positions": (chain_positions, f"{CHAINS} SELECT id, chain, pos FROM chain"),
    "chain_vote": (chain_vote, CHAIN_VOTE),
    "chain_context": (chain_context, CHAIN_CONTEXT),
    "chain_hops": (chain_hops, HOPS),
    "chain_label_changes": (label_changes, CHANGES),
}
