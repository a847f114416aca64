"""Expressions and joins against NumPy and plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import __main__ as cli
from tilewright.functions import arrays as A
from tilewright.functions import blocks as B
from tilewright.operators import decode, design, linking, matching, metrics, models, pairs, sampling
from tilewright.sources import files


def test_eigenvalues_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(20):
        m = rng.normal(size=(3, 3))
        m = m @ m.T if k else np.eye(3)
        rows.append((k, *(float(m[i, j]) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))), [float(x) for x in np.linalg.eigvalsh(m)[::-1]]))
    df = spark.createDataFrame(rows, "k int, xx double, yy double, zz double, xy double, xz double, yz double, e array<double>")
    got = df.select("e", F.array(*B.eigenvalues3(*[F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")])).alias("g")).collect()
    assert all(np.allclose(r.e, r.g, atol=1e-7) for r in got)


def test_welch_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=8)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(4) / 4)
    expected = np.mean([np.abs(np.fft.rfft((x[s : s + 4] - x[s : s + 4].mean()) * hann)) ** 2 for s in (0, 2, 4)], 0)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    r = df.select(B.welch(F.col("x"), 8, 4, 2).alias("p"), B.phase(F.col("x"), 8, F.lit(3)).alias("a"), B.applied(F.col("x"), np.eye(8)[::-1]).alias("r")).first()
    assert np.allclose(r.p, expected) and math.isclose(r.a, np.angle(np.fft.fft(x)[3])) and np.allclose(r.r, x[::-1])


def test_padded_decoding_against_single_chains(spark):
    rng = np.random.default_rng(3)
    sizes = [1, 7, 3, 40, 2, 40]
    rows, expected, sticky = [], {}, {}
    for chain, n in enumerate(sizes):
        p = rng.dirichlet(np.ones(4), n)
        ids = [chain * 100 + i for i in range(n)]
        rows += [(chain, i, ids[i], p[i].tolist(), 0.3 + 0.1 * (i % 3)) for i in range(n)]
        cost = np.array([0.3 + 0.1 * (i % 3) for i in range(n)])
        expected |= dict(zip(ids, decode.viterbi(np.log(p), cost).tolist(), strict=True))
        sticky |= dict(zip(ids, decode.posterior(np.log(p), 0.7), strict=True))
    df = spark.createDataFrame(rows, "chain long, pos int, id long, p array<double>, cost double").repartition(3)
    assert {r.id: r.label for r in decode.chains(df, "cost").collect()} == expected
    got = {r.id: r.conf for r in decode.chains(df, 0.0, sticky=0.7).collect()}
    assert all(math.isclose(got[i], q.max(), rel_tol=1e-9) for i, q in sticky.items()) and decode.chains(df.limit(0), 1.0).count() == 0


def test_auc_and_places(spark):
    rng = np.random.default_rng(4)
    rows = [(float(round(x, 2)), bool(y)) for x, y in zip(rng.normal(size=500), rng.random(500) < 0.4, strict=True)]
    wins = sum((a > b) + 0.5 * (a == b) for a, p in rows if p for b, q in rows if not q)
    expected = wins / (sum(p for _, p in rows) * sum(not p for _, p in rows))
    assert metrics.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first().auc == pytest.approx(expected)
    assert metrics.auc(spark.createDataFrame([(1.0, True), (1.0, False)], "s double, y boolean"), "s", "y").first().auc == 0.5
    g = spark.range(300).select(F.col("id").alias("g"))
    places = sorted((r.place, r.g) for r in sampling.hashed_place(g, "g").collect())
    assert [p for p, _ in places] == list(range(300)) and [x for _, x in places] != list(range(300))
    folds = [r["count"] for r in sampling.folds(g, "g", 4).groupBy("fold").count().collect()]
    assert folds == [75] * 4


def test_twins_of_equal_and_constant_arrays(spark):
    rows = [(0, 1, [0.0] * 4), (0, 2, [0.0] * 4), (0, 3, [1.0, -1.0, 1.0, -1.0]), (1, 4, [0.0] * 4), (0, 5, [1e-7] * 4), (0, 6, [5.0, 0.0, -5.0, 0.0])]
    df = spark.createDataFrame(rows, "session int, id long, v array<double>")
    got = sorted((r.a_id, r.b_id) for r in pairs.twins(df, df, "v").collect())
    expected = sorted((a, b) for s, a, x in rows for t, b, y in rows if s == t and max(abs(p - q) for p, q in zip(x, y, strict=True)) < 1e-6)
    assert got == expected


def test_links_fused_against_a_plain_version(spark):
    a = {(0, 1): 2.0, (0, 2): -1.0, (1, 2): 0.5}
    b = {(0, 2): 3.0, (2, 0): 1.0}
    df = [spark.createDataFrame([(*k, v) for k, v in x.items()], "src long, dst long, lo double") for x in (a, b)]
    got = {(r.src, r.dst): r.lo for r in linking.fused([(df[0], 0.75), (df[1], 0.25)]).collect()}
    least = lambda x, s: min((v for (i, _), v in x.items() if i == s), default=-10.0) - 1
    assert got == pytest.approx({k: 0.75 * a.get(k, least(a, k[0])) + 0.25 * b.get(k, least(b, k[0])) for k in a.keys() | b.keys()})
    composed = {(r.src, r.dst): r.origin for r in linking.composed(df[0].limit(1).select("src", "dst"), df[1].select("src", "dst")).collect()}
    assert composed == {(0, 1): 0, (2, 0): 1}


def test_effects_are_additive(spark):
    rows = [(a, b, 10.0 * a + b) for a in range(3) for b in range(4) for _ in range(2)]
    got = design.two_way(spark.createDataFrame(rows, "a long, b long, v double"), "a", "b", "v", 2).collect()
    assert all(math.isclose(r.effect_a + r.effect_b + r["mean"], 10.0 * r.a + r.b, abs_tol=1e-9) for r in got)


def test_command_line(spark, sf, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "tiles_flagship" in capsys.readouterr().out
    assert cli.main(["run", "describe_rollup", "--data", sf, "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > 10


def test_model_is_stored_and_read_again(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([([float(i % 3), float(i)], i % 2) for i in range(40)], "x array<double>, label long").withColumn("features", array_to_vector("x"))
    model = LogisticRegression(maxIter=5).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = LogisticRegressionModel.load(str(tmp_path / "m"))
    assert again.transform(df).select("prediction").collect() == model.transform(df).select("prediction").collect()
    assert A.mean("x") is not None


def test_ridge_strength_by_leaving_one_out():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(25, 4)), rng.normal(size=25)
    alphas = [0.1, 3.0, 50.0]
    plain = []
    for alpha in alphas:
        errors = []
        for i in range(25):
            keep = np.arange(25) != i
            a = np.column_stack([x[keep], np.ones(24)])
            w = np.linalg.solve(a.T @ a + alpha * np.diag([1, 1, 1, 1, 0]), a.T @ y[keep])
            errors.append((y[i] - np.append(x[i], 1) @ w) ** 2)
        plain.append(np.mean(errors))
    best, _, errors = models.ridge_loo(x, y, alphas)
    assert np.allclose(errors, plain) and best == alphas[int(np.argmin(plain))]
    precision, density = models.residual_density(x, shrink=0.0)
    c = x.T @ x / len(x)
    assert np.allclose(precision @ c, np.eye(4)) and np.isclose(density[0], -0.5 * (x[0] @ np.linalg.inv(c) @ x[0] + np.log(np.linalg.det(2 * np.pi * c))))


def test_roles_of_columns(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert files.roles(e.select("user_id", "ts", "event_type", "value")) == {"subject": "user_id", "time": "ts", "limb": "event_type"}
    assert files.roles(e.select(F.col("user_id").alias("a"), F.col("event_id").alias("b"), F.col("event_type").alias("c"))) == {"limb": "c", "time": "b", "subject": "a"}
    assert files.roles(e.select(F.col("user_id").alias("sbj_id"), F.lit("x").alias("sensor_location"), F.lit(1).alias("frame"))) == {"subject": "sbj_id", "limb": "sensor_location", "time": "frame"}


def test_links_of_shuffled_chunks_are_found(spark):
    """Rows of a smooth walk, dealt in random order: the assignment finds each one's successor."""
    rng = np.random.default_rng(6)
    place = np.cumsum(rng.normal(size=(40, 6)) * 0.2 + 0.4, axis=0)
    order = rng.permutation(40)
    apart = ((place[:, None] + 0.4 - place[None]) ** 2).sum(2)
    rows = [(0, int(order[i]), int(order[j]), float(max(-apart[i, j], -3.0))) for i in range(40) for j in range(40) if i != j]
    got = {r.src: r.dst for r in matching.match(spark.createDataFrame(rows, "session int, src long, dst long, s double")).collect()}
    assert sum(got.get(int(order[i])) == int(order[i + 1]) for i in range(39)) >= 37


def test_swaps_gain_what_rows_say(spark):
    rows = [(0, i, c, p) for i, (a, b) in enumerate([(0.6, 0.4), (0.55, 0.45), (0.3, 0.7)]) for c, p in ((0, a), (1, b))]
    got = decode.swap_gains(spark.createDataFrame(rows, "session int, id long, class int, p double")).first()
    plain = sum(math.log(b / a) for a, b in [(0.6, 0.4), (0.55, 0.45)]) + math.log(0.3 / 0.7)
    assert (got.a, got.b, got.n) == (0, 1, 3) and got.gain == pytest.approx(plain)
