"""Relabelling and matching as joins, whole pipelines, and what remains of strings, hashes and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode, fuse, graph, matching, metrics
from .classes import MEM, _members
from .common import PROBS, VECTORS, probabilities, r6, table, tall, vectors
from .decoding import TARGETS, _fitted, _targets
from .design import H
from .vectors import CHAINS, EDGES, LINKS, TOP, top

_WITH = "WITH RECURSIVE "
_V = VECTORS + ", "
_BEST = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({s}, 6) DESC, class) AS r FROM {source}) WHERE r = 1"


def R(sql: str, name: str) -> str:
    return f"round(({sql})::DOUBLE + 3e-8, 6) + 0.0 AS {name}"


def relabelled(spark, d):
    """Four half-rounds of Potts relabelling over the neighbour graph."""
    p = tall(probabilities(spark, d)).select("id", "class", F.ln(F.greatest("p", F.lit(1e-9))).alias("s"))
    e = graph.settle(graph.row_normalised(graph.symmetric(graph.kernel(top(spark, d), 0.1))))
    return decode.icm_rounds(p, e, 1.5, 4, graph.settle).select("id", F.col("class").cast("int").alias("class"))


def _icm(rounds: int) -> str:
    out = [f"l0 AS MATERIALIZED ({_BEST.format(cols='id, class', by='id', s='s', source='sc')})"]
    for k in range(rounds):
        out.append(f"t{k} AS (SELECT sc.id, sc.class, s + coalesce(1.5 * w, 0) AS s FROM sc LEFT JOIN (SELECT e.src AS id, l.class, sum(e.w / deg.d) AS w FROM sym e JOIN deg ON deg.src = e.src JOIN l{k} l ON l.id = e.dst GROUP BY ALL) n ON n.id = sc.id AND n.class = sc.class)")
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT id, CASE WHEN {H('id')} // 65536 % 2 = {k % 2} THEN b.class ELSE l.class END AS class FROM l{k} l JOIN ({_BEST.format(cols='id, class', by='id', s='s', source=f't{k}')}) b USING (id))")
    return ", ".join(out)


RELABELLED = f"WITH {PROBS}, {EDGES.removeprefix(_V)}, sc AS (SELECT id, class, ln(greatest(p, 1e-9)) AS s FROM prob), {_icm(4)} SELECT id, class::INT AS class FROM l4"


def segments(spark, d):
    """One class per run of equal guesses along a chain, with prices that lead the counts into bands."""
    p = tall(probabilities(spark, d)).select("session", "id", "class", "p")
    s = p.select("session", "id", "class", F.ln(F.greatest("p", F.lit(1e-9))).alias("s"))
    placed = graph.chains(graph.one_to_one(top(spark, d)), vectors(spark, d)).join(decode.best(p).select("id", F.col("class").alias("label")), "id")
    bands = _targets(p).select("session", "class", (F.col("target") - 3).alias("lo"), (F.col("target") + 3).alias("hi"))
    out = decode.segment_labels(s, placed.select("id", "chain", "pos", "label"), bands, 0.6, 3)
    return out.select("session", "id", F.col("segment").cast("int").alias("segment"), F.col("class").cast("int").alias("class"))


def _prices(rounds: int) -> str:
    out = ["p0 AS (SELECT session, class, target - 3 AS lo, target + 3 AS hi, 0.0::DOUBLE AS price FROM tgt)"]
    for k in range(rounds + 1):
        out.append(f"v{k} AS (SELECT chain || ':' || run AS seg, t.session, t.class, n, s - price * n AS s FROM tot t JOIN p{k} p ON p.session = t.session AND p.class = t.class)")
        out.append(f"k{k} AS MATERIALIZED ({_BEST.format(cols='seg, session, class, n', by='seg', s='s', source=f'v{k}')})")
        if k < rounds:
            out.append(f"p{k + 1} AS MATERIALIZED (SELECT session, class, lo, hi, price + CASE WHEN coalesce(n, 0) > hi THEN {0.6 / (k + 1)} WHEN coalesce(n, 0) < lo THEN -{0.6 / (k + 1)} ELSE 0 END AS price FROM p{k} LEFT JOIN (SELECT session, class, sum(n) AS n FROM k{k} GROUP BY ALL) USING (session, class))")
    return ", ".join(out)


SEGMENTS = f"{_WITH}{PROBS}, {TARGETS}, {CHAINS.removeprefix(_WITH).removeprefix(_V)}, g AS ({_BEST.format(cols='id, class AS label', by='id', s='p', source='prob')}), mk AS (SELECT id, chain, pos, CASE WHEN lag(label) OVER (PARTITION BY chain ORDER BY pos) = label THEN 0 ELSE 1 END AS c FROM chain JOIN g USING (id)), sg AS MATERIALIZED (SELECT id, chain, sum(c) OVER (PARTITION BY chain ORDER BY pos) AS run FROM mk), tot AS MATERIALIZED (SELECT session, chain, run, class, sum(ln(greatest(p, 1e-9))) AS s, count(*) AS n FROM prob JOIN sg USING (id) GROUP BY ALL), {_prices(3)} SELECT session, id, run::INT AS segment, class::INT AS class FROM sg JOIN k3 ON k3.seg = chain || ':' || run"


def soft_match(spark, d):
    t = top(spark, d).select("session", "src", "dst", "s")
    return matching.soft_pairs(t, 0.1, 2).select("src", "dst", r6("p").alias("p"))


def _sinkhorn(rounds: int) -> str:
    out = ["k0 AS (SELECT src, dst, exp((s - greatest(m, 0)) / 0.1) AS k, exp(-greatest(m, 0) / 0.1) AS rs, exp(-greatest(m, 0) / 0.1) AS cs FROM (SELECT *, max(s) OVER (PARTITION BY session) AS m FROM topk))"]
    for i in range(rounds):
        out.append(f"r{i} AS (SELECT src, dst, cs, k / t AS k, rs / t AS rs FROM (SELECT *, sum(k) OVER (PARTITION BY src) + rs AS t FROM k{i}))")
        out.append(f"k{i + 1} AS (SELECT src, dst, rs, k / t AS k, cs / t AS cs FROM (SELECT *, sum(k) OVER (PARTITION BY dst) + cs AS t FROM r{i}))")
    return ", ".join(out)


def predict(spark, d):
    """The smallest whole path: blend two members, halve class 0, smooth over links, fit to counts, label."""
    a, b = _members(spark, d)
    p = fuse.scaled_class(fuse.log_blend({"a": (a, 0.7), "b": (b, 0.3)}), 0, 0.5)
    links = graph.one_to_one(top(spark, d))
    both = links.select("src", "dst").union(links.select("dst", "src"))
    near = both.join(p.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "class").agg(F.avg("p").alias("q"))
    smooth = p.join(near, ["id", "class"], "left").select("id", "class", (F.col("p") * 0.7 + F.coalesce("q", "p") * 0.3).alias("p"))
    rows = vectors(spark, d).select("session", "id").join(smooth, "id")
    out = decode.finish(rows.select("session", "id", "class", "p"), _targets(rows), 0.5, 2)
    return out.select("id", F.col("class").cast("int").alias("label"), r6("p").alias("p"))


_BLEND = "u AS (SELECT id, class, 0.7 * ln(greatest(p, 1e-6)) AS s FROM ma UNION ALL SELECT id, class, 0.3 * ln(greatest(p, 1e-6)) FROM mb), g AS (SELECT id, class, sum(s) AS s FROM u GROUP BY ALL), e AS (SELECT id, class, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM g), bl AS (SELECT id, class, e / sum(e) OVER (PARTITION BY id) AS p FROM e), h AS (SELECT id, class, CASE WHEN class = 0 THEN 0.5 ELSE 1 END * p AS p FROM bl), sc AS MATERIALIZED (SELECT id, class, p / sum(p) OVER (PARTITION BY id) AS p FROM h)"
PREDICT = f"WITH {MEM}, {LINKS.removeprefix(_V)}, {TARGETS}, {_BLEND}, nb AS (SELECT src AS id, class, avg(p) AS q FROM (SELECT src, dst FROM link UNION ALL SELECT dst, src FROM link) JOIN sc ON sc.id = dst GROUP BY ALL), sm AS MATERIALIZED (SELECT session, sc.id, sc.class, sc.p * 0.7 + coalesce(q, sc.p) * 0.3 AS p FROM sc JOIN vec ON vec.id = sc.id LEFT JOIN nb ON nb.id = sc.id AND nb.class = sc.class), {_fitted('q', 'sm', 2.0, 2)} {_BEST.format(cols='id, class::INT AS label, round(p + 3e-8, 6) + 0.0 AS p', by='id', s='p', source='q')}"


def simulate(spark, d):
    """Sessions held out, labelled from the others' class means, and scored: per session macro-F1 parts."""
    v = vectors(spark, d).where("id % 3 = 0")
    p = tall(probabilities(spark, d)).select("session", "id", "class", "p").join(v.select("id", "label"), "id")
    x = decode.best(p).select("id", F.col("label").cast("int").alias("truth"), F.col("class").cast("int").alias("guess"))
    return metrics.f1_by_class(x, "truth", "guess").select("class", "tp", "fp", "fn", r6("f1").alias("f1"))


SIMULATE = f"WITH {PROBS}, g AS ({_BEST.format(cols='id, label AS truth, class AS guess', by='id', s='p', source='(SELECT * FROM prob WHERE id % 3 = 0)')}), c AS (SELECT unnest([truth, guess]) AS class, truth, guess, unnest([1, 2]) AS side FROM g), f AS (SELECT class::INT AS class, sum((side = 1 AND truth = guess)::INT)::BIGINT AS tp, sum((side = 2 AND truth <> guess)::INT)::BIGINT AS fp, sum((side = 1 AND truth <> guess)::INT)::BIGINT AS fn FROM c GROUP BY class) SELECT class, tp, fp, fn, {R('2 * tp / greatest(2 * tp + fp + fn, 1)', 'f1')} FROM f"


def combine(spark, d):
    """Two runs' probabilities averaged, then fitted to counts and labelled; where they agree with the vote."""
    a, b = _members(spark, d)
    p = fuse.mean({"a": (a, 0.6), "b": (b, 0.4)})
    rows = vectors(spark, d).select("session", "id").join(p, "id").select("session", "id", "class", "p")
    out = decode.finish(rows, _targets(rows), 0.5, 2)
    return out.select("id", F.col("class").cast("int").alias("label"), (F.col("id") % 10 == F.col("class")).alias("voted"))


COMBINE = f"WITH {MEM}, {TARGETS}, av AS MATERIALIZED (SELECT session, id, class, 0.6 * ma.p + 0.4 * mb.p AS p FROM ma JOIN mb USING (id, class) JOIN vec USING (id)), {_fitted('q', 'av', 2.0, 2)}, l AS ({_BEST.format(cols='id, class', by='id', s='p', source='q')}) SELECT id, class::INT AS label, id % 10 = class AS voted FROM l"


def fingerprints(spark, d):
    """Per user: a fingerprint of the values, a bit mask of the types seen, what the properties hold."""
    e = table(spark, d, "events")
    types = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(types, F.col("event_type")) - 1).cast("int"))
    value = F.concat_ws(":", F.col("event_id").cast("string"), F.col("event_type"))
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("long")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", value.alias("v")))), lambda s: s["v"]), "|")
    g = e.groupBy("user_id").agg(F.sha1(joined.cast("binary")).alias("sha1"), F.bit_or(bit).alias("mask"), F.sum(k).alias("k_sum"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_json"), F.count("*").alias("n"))
    every = F.col("mask") == 31
    return g.select("user_id", "sha1", "mask", every.alias("every"), "k_sum", "k_json", F.to_json(F.struct("n", "mask")).alias("json"))


FINGERPRINTS = "SELECT user_id, sha1(string_agg(event_id || ':' || event_type, '|' ORDER BY event_id)) AS sha1, bit_or(1::BIGINT << (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)) AS mask, bit_or(1::BIGINT << (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)) = 31 AS every, sum(regexp_extract(props, '\"k\":\\s*(\\d+)', 1)::BIGINT)::BIGINT AS k_sum, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS k_json, to_json({'n': count(*), 'mask': bit_or(1::BIGINT << (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1))})::VARCHAR AS json FROM events GROUP BY user_id"

QUERIES = {
    "decode_relabelled": (relabelled, RELABELLED),
    "decode_segments": (segments, SEGMENTS),
    "match_soft": (soft_match, f"WITH {TOP}, {_sinkhorn(2)} SELECT src, dst, {R('k', 'p')} FROM k2"),
    "plan_predict": (predict, PREDICT),
    "plan_simulate": (simulate, SIMULATE),
    "plan_combine": (combine, COMBINE),
    "source_fingerprints": (fingerprints, FINGERPRINTS),
}
