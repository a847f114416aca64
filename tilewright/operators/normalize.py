"""Normalisation within groups, and linear algebra from mergeable sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle


def z_score(x: Column, by: list[str], eps: float) -> Column:
    w = Window.partitionBy(*by)
    return (x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + F.lit(eps))


def centre(x: Column, by: list[str]) -> Column:
    return x - F.avg(x).over(Window.partitionBy(*by))


def robust(df: DataFrame, column: str, by: list[str], eps: float) -> DataFrame:
    """Adds ``robust``: (x - median) / (interquartile range + eps)."""
    q = df.groupBy(*by).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"))
    out = df.join(q, by)
    return out.withColumn("robust", (F.col(column) - F.col("__q")[1]) / (F.col("__q")[2] - F.col("__q")[0] + F.lit(eps))).drop("__q")


def percent_place(column: str, by: list[str], tie: str) -> Column:
    """(rank - 1/2) / n within the group."""
    return (F.row_number().over(Window.partitionBy(*by).orderBy(column, tie)) - F.lit(0.5)) / F.count("*").over(Window.partitionBy(*by))


def quantile_map(df: DataFrame, reference: DataFrame, column: str, by: list[str], tie: str, steps: int) -> DataFrame:
    """Adds ``mapped``: the reference's quantile at each row's place in its group. The reference is
    reduced to ``steps`` + 1 quantiles, which every task gets."""
    shares = F.array(*[F.lit(k / steps) for k in range(steps + 1)])
    q = reference.agg(F.percentile(column, shares).alias("__q"))
    u = percent_place(column, by, tie) * steps
    out = df.withColumn("__u", u).join(F.broadcast(q))
    lo = F.floor("__u").cast("int")
    a, b = F.element_at("__q", lo + 1), F.element_at("__q", F.least(lo + 2, F.lit(steps + 1)))
    return out.withColumn("mapped", a + (b - a) * (F.col("__u") - lo)).drop("__u", "__q")


#: Rows of a session that meet its matrix together; sessions whose sizes are sent to all tasks at most.
GROUP, SENT = 20_000, 100_000


def gram(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """Mergeable sums for covariances: n, sums s and the flattened sum g of outer products, one row
    per group and per task at most before they are added. A held-out group is a difference."""

    def part(batches):
        held: dict[tuple, list] = {}
        for pdf in batches:
            for key, g in pdf.groupby(by, sort=False):
                x = np.stack(g[vector].to_numpy()).astype(float)
                n, s, o = held.get(key, [0, 0.0, 0.0])
                held[key] = [n + len(x), s + x.sum(0), o + x.T @ x]
        if held:
            yield pd.DataFrame([(*k, n, s.tolist(), o.ravel().tolist()) for k, (n, s, o) in held.items()], columns=[*by, "n", "s", "g"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", n long, s array<double>, g array<double>"

    def added(left: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*[left[b].iloc[0] for b in by], int(left.n.sum()), np.sum(np.stack(left.s.to_numpy()), 0).tolist(), np.sum(np.stack(left.g.to_numpy()), 0).tolist())], columns=left.columns)

    return df.select(*by, vector).mapInPandas(part, schema).groupBy(*by).applyInPandas(added, schema)


def covariance(n: int, s: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Sample covariance (n - 1) from ``gram``'s sums."""
    d = len(s)
    return (np.asarray(g).reshape(d, d) - np.outer(s, s) / n) / max(n - 1, 1)


def ridge(n: int, gram_xx: np.ndarray, gram_xy: np.ndarray, alpha: float) -> np.ndarray:
    """Weights of ridge regression; the last row of x is the bias and isn't penalised."""
    penalty = np.full(len(gram_xx), alpha)
    penalty[-1] = 0
    return np.linalg.solve(gram_xx + np.diag(penalty), gram_xy)


def whiten(df: DataFrame, session: str, key: str, vector: str, shrink: float = 0.1, power: float = 0.5, fit: DataFrame | None = None) -> DataFrame:
    """(session, key, w): centred vectors times (shrunk covariance) ** -power of their own session.
    The covariance comes from mergeable sums, of ``fit``'s rows where given; only d x d numbers per
    session meet the vectors again."""
    sums = gram(df if fit is None else fit, vector, [session])

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples(index=False):
            c = covariance(r.n, np.asarray(r.s), np.asarray(r.g))
            c = (1 - shrink) * c + shrink * np.trace(c) / len(c) * np.eye(len(c))
            values, axes = np.linalg.eigh(c)
            w = (axes * np.maximum(values, 1e-12) ** -power) @ axes.T
            rows.append((getattr(r, session), (np.asarray(r.s) / r.n).tolist(), w.ravel().tolist()))
        return pd.DataFrame(rows, columns=[session, "mean", "w"])

    kind = dict(df.dtypes)[session]
    models = sums.groupBy(session).applyInPandas(transform, f"{session} {kind}, mean array<double>, w array<double>")

    def apply(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({session: [], key: [], "w": []})
        m = np.asarray(model["mean"].iloc[0])
        x = np.stack(rows[vector].to_numpy()).astype(float) - m
        out = x @ np.asarray(model["w"].iloc[0]).reshape(len(m), -1).T
        return pd.DataFrame({session: rows[session], key: rows[key], "w": list(out)})

    # a session is dealt into groups of bounded size; each gets the matrix once
    models = settle(models)
    groups = df.groupBy(session).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("__g"))
    sizes = F.broadcast(groups) if models.count() <= SENT else groups
    dealt = df.select(session, key, vector).join(sizes, session).select(session, key, vector, F.pmod(F.xxhash64(key), F.col("__g")).cast("int").alias("__s"))
    again = groups.select(session, F.explode(F.sequence(F.lit(0), F.col("__g") - 1)).alias("__s"))
    each = models.join(again, session).select(F.col(session).alias("__session"), F.col("__s").alias("__t"), "mean", "w")
    return dealt.groupBy(session, "__s").cogroup(each.groupBy("__session", "__t")).applyInPandas(apply, f"{session} {kind}, {key} long, w array<double>")


def pca(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k first principal axes (rows; the greatest component of each is positive)."""
    r = gram(df.withColumn("__all", F.lit(0)), vector, ["__all"]).first()
    c = covariance(r.n, np.asarray(r.s), np.asarray(r.g))
    _, axes = np.linalg.eigh(c)
    axes = axes[:, ::-1][:, :k].T
    return np.asarray(r.s) / r.n, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
