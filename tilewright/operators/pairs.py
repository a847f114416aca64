"""Similarity joins in blocks, candidate tables and their rank features.

A pair table is tall: (session, src, dst, s). Scores are rounded to six digits before they are
ranked and ties go to the smaller id, so a result doesn't depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def _blocks(df: DataFrame, by: str, name: str) -> DataFrame:
    """Deals each group's rows into blocks of about BLOCK rows by a hash of the id."""
    sizes = df.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__b"))
    return df.join(sizes, by).withColumn(name, F.pmod(F.xxhash64("id"), F.col("__b")).cast("int"))


def topk(left: DataFrame, right: DataFrame, k: int, *, metric: str = "cosine") -> DataFrame:
    """(session, src, dst, s, rank): for each left row its k most similar right rows of the session.

    Both sides have columns session, id, v. Blocks of rows meet block by block in a matrix product;
    only k rows per source and block leave it.
    """
    a, b = _blocks(left.select("session", "id", "v"), "session", "i"), _blocks(right.select(*[F.col(c).alias(c) for c in ("session", "id", "v")]), "session", "j")
    na = a.groupBy("session").agg(F.max("__b").alias("na"))
    nb = b.groupBy("session").agg(F.max("__b").alias("nb"))
    a = a.join(nb, "session").select("session", "id", "v", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    b = b.join(na, "session").select("session", "id", "v", "j", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"))
    kind = dict(left.dtypes)["session"]

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        x = flat.reshape(len(t), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        empty = pa.table({"session": x["session"].slice(0, 0) if len(x) else y["session"].slice(0, 0), "src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        if not len(x) or not len(y):
            return empty
        ids, others = x["id"].to_numpy(), y["id"].to_numpy()
        u, v = matrix(x), matrix(y)
        s = u @ v.T if metric != "distance" else -np.sqrt(np.maximum((u**2).sum(1)[:, None] + (v**2).sum(1) - 2 * u @ v.T, 0))
        s = np.round(s, 6) + 0.0
        rows, cols = [], []
        for r in range(len(ids)):
            near = s[r]
            if len(others) > k + 1:  # the k + 1 best and all that tie with the last of them
                some = np.flatnonzero(near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1])
                order = some[np.lexsort((others[some], -near[some]))]
            else:
                order = np.lexsort((others, -near))
            order = order[others[order] != ids[r]][:k]
            rows.append(np.full(len(order), r))
            cols.append(order)
        r, c = np.concatenate(rows), np.concatenate(cols)
        return pa.table({"session": x["session"].combine_chunks().take(pa.array(r)), "src": ids[r], "dst": others[c], "s": s[r, c]})

    met = a.groupBy("session", "i", "j").cogroup(b.groupBy("session", "i", "j")).applyInArrow(meet, f"session {kind}, src long, dst long, s double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("s"), "dst"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def ranks(pairs: DataFrame, tau: float = 0.05) -> DataFrame:
    """Row and column ranks, dominance, margin and the dual log-softmax of a score table."""
    row, col = Window.partitionBy("src"), Window.partitionBy("dst")
    best = F.max("s").over(row)
    first = F.row_number().over(row.orderBy(F.desc("s"), "dst"))
    out = pairs.withColumns({"rank_row": first, "rank_col": F.row_number().over(col.orderBy(F.desc("s"), "src")), "dom_row": F.col("s") - best, "dom_col": F.col("s") - F.max("s").over(col)})
    second = F.max(F.when(F.col("rank_row") == 2, F.col("s"))).over(row)
    x = F.col("s") / tau

    def lse(w):
        m = F.max(x).over(w)
        return m, w

    out = out.withColumns({"margin": best - second, "__r": lse(row)[0], "__c": lse(col)[0]})
    out = out.withColumns({"__lr": F.col("__r") + F.ln(F.sum(F.exp(x - F.col("__r"))).over(row)), "__lc": F.col("__c") + F.ln(F.sum(F.exp(x - F.col("__c"))).over(col))})
    return out.withColumn("dual", x * 2 - F.col("__lr") - F.col("__lc")).drop("__r", "__c", "__lr", "__lc")


def mutual(pairs: DataFrame) -> DataFrame:
    """Pairs whose reverse is there as well, once each (src < dst)."""
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.join(back, ["src", "dst"], "left_semi").where("src < dst")


def candidates(sources: dict[str, DataFrame], cap: int) -> DataFrame:
    """Union of candidate tables (session, src, dst, s): number of sources, best score, at most
    ``cap`` candidates per source, those of most sources first."""
    tall = None
    for name, df in sources.items():
        one = df.select("session", "src", "dst", "s", F.lit(name).alias("source"))
        tall = one if tall is None else tall.unionByName(one)
    by = tall.groupBy("session", "src", "dst").agg(F.countDistinct("source").alias("n_src"), F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n_src"), F.desc("s"), "dst"))
    return by.withColumn("rank", rank).where(F.col("rank") <= cap)


def twins(a: DataFrame, b: DataFrame, value: str, apart: float = 1e-6) -> DataFrame:
    """(session, a_id, b_id) of rows of one session whose arrays differ by less than ``apart`` everywhere.

    Two sums with different signs differ by less than n * apart each, so it is enough to compare rows
    that are in the same or neighbouring bins of that width by both: an equi-join, confirmed by the
    difference. Rows of equal arrays meet once, by their arrays: copies are only expanded at the end.
    """
    def forms(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("session", F.col(value).alias(name)).agg(F.min("id").alias(f"{name}id"))

    def bins(c: str):
        plain = F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        turned = F.aggregate(F.transform(c, lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x)
        return [F.floor(t / (F.size(c) * apart)) for t in (plain, turned)]

    left, right = forms(a, "__x"), forms(b, "__y")
    k, j = bins("__x")
    left = left.withColumn("__k", F.explode(F.array(k - 1, k, k + 1))).withColumn("__j", F.explode(F.array(j - 1, j, j + 1)))
    k, j = bins("__y")
    right = right.withColumns({"__k": k, "__j": j})
    most = F.array_max(F.zip_with("__x", "__y", lambda x, y: F.abs(x - y)))
    met = left.join(right, ["session", "__k", "__j"]).where(most < apart).select("session", "__x", "__y")
    first = a.select("session", F.col("id").alias("a_id"), F.col(value).alias("__x")).join(met, ["session", "__x"])
    return first.join(b.select("session", F.col("id").alias("b_id"), F.col(value).alias("__y")), ["session", "__y"]).select("session", "a_id", "b_id")


def binned(df: DataFrame, value: str, edges: list[float], table: DataFrame, bin_column: str = "bin") -> DataFrame:
    """Looks values up in a table of bins: bin = number of edges not above the value."""
    n = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(value)))
    return df.withColumn(bin_column, n).join(F.broadcast(table), bin_column, "left")


def log_odds_by_bin(df: DataFrame, value: str, positive: Column, edges: list[float]) -> DataFrame:
    """(bin, llr): add-one smoothed histogram log-likelihood ratio."""
    n = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(value)))
    counts = df.groupBy(n.alias("bin")).agg(F.sum(positive.cast("int")).alias("p"), F.sum((~positive).cast("int")).alias("q"))
    k = len(edges) + 1
    total = counts.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    full = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0, ["p", "q"])
    return full.join(F.broadcast(total)).select("bin", F.ln((F.col("p") + 1) / (F.col("tp") + k) / ((F.col("q") + 1) / (F.col("tq") + k))).alias("llr"))
