"""Graphs as edge tables (session, src, dst, w): normalisation, propagation, components, chains.

Iterations are joins and grouped sums; ``checkpoint`` cuts the lineage every few rounds where a
checkpoint directory is set.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, where the session names one."""
    context = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if named and context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, the greater weight of the two."""
    back = edges.select("session", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("session", "src", "dst", "w").unionByName(back).groupBy("session", "src", "dst").agg(F.max("w").alias("w"))


def kernel(pairs: DataFrame, tau: float) -> DataFrame:
    """w = exp((s - best of the source) / tau)."""
    best = F.max("s").over(Window.partitionBy("src"))
    return pairs.select("session", "src", "dst", F.exp((F.col("s") - best) / tau).alias("w"))


def row_normalised(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))


def degree_normalised(edges: DataFrame) -> DataFrame:
    """D^-1/2 W D^-1/2 for a symmetric table."""
    d = edges.groupBy("src").agg(F.sum("w").alias("d"))
    a, b = d.withColumnRenamed("d", "ds"), d.select(F.col("src").alias("dst"), F.col("d").alias("dd"))
    return edges.join(a, "src").join(b, "dst").select("session", "src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))


def propagate(edges: DataFrame, start: DataFrame, alpha: float, rounds: int, anchors: DataFrame | None = None) -> DataFrame:
    """F <- alpha W F + (1 - alpha) F0 on tall tables (id, class, p); anchored ids keep their start."""
    now = start
    for k in range(rounds):
        moved = edges.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "class").agg(F.sum(F.col("w") * F.col("p")).alias("m"))
        now = start.withColumnRenamed("p", "p0").join(moved, ["id", "class"], "left").select("id", "class", (F.coalesce("m", F.lit(0.0)) * alpha + F.col("p0") * (1 - alpha)).alias("p"), "p0")
        if anchors is not None:
            now = now.join(anchors.select("id", F.lit(True).alias("fixed")), "id", "left").withColumn("p", F.when(F.col("fixed"), F.col("p0")).otherwise(F.col("p"))).drop("fixed")
        now = now.drop("p0")
        if k % 4 == 3:
            now = settle(now)
    return now


def propagate_grouped(edges: DataFrame, start: DataFrame, alpha: float, rounds: int) -> DataFrame:
    """The same per session in memory, for many rounds over sessions that fit a task.

    ``start`` has session, id, class, p.
    """

    def run(key, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame({"id": [], "class": [], "p": []})
        f = s.pivot(index="id", columns="class", values="p").fillna(0.0)
        place = {k: i for i, k in enumerate(f.index)}
        x, f0 = f.to_numpy(), f.to_numpy()
        src, dst = (np.array([place[k] for k in e[c]], int) for c in ("src", "dst"))
        w = e["w"].to_numpy()[:, None]
        for _ in range(rounds):
            moved = np.zeros_like(x)
            np.add.at(moved, src, w * x[dst])
            x = alpha * moved + (1 - alpha) * f0
        n, c = x.shape
        return pd.DataFrame({"id": np.repeat(f.index.to_numpy(), c), "class": np.tile(f.columns.to_numpy(), n), "p": x.ravel()})

    kinds = dict(start.dtypes)
    return edges.groupBy("session").cogroup(start.groupBy("session")).applyInPandas(run, f"id {kinds['id']}, class {kinds['class']}, p double")


def components(edges: DataFrame, nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, root): least id of each connected component; labels spread and jump until none changes.
    They only ever fall, so this ends; where ``rounds`` are given and not enough, it is an error."""
    both = settle(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    now = settle(nodes.select("id", F.col("id").alias("root")))
    for _ in count() if rounds is None else range(rounds):
        near = both.join(now.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("m"))
        spread = now.join(near, "id", "left").select("id", F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = spread.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = settle(spread.join(jump, "root", "left").select("id", F.least("root", F.coalesce("far", "root")).alias("root")))
        if not new.join(now.withColumnRenamed("root", "old"), "id").where("root <> old").limit(1).count():
            return new
        now = new
    raise ValueError("components did not settle")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Links with one successor and one predecessor each that run from a smaller to a greater id: the
    best destination of each source, then the best source of each destination. Never cyclic."""
    up = pairs.where("src < dst")
    best = up.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("s"), "dst"))).where("r = 1").drop("r")
    return best.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("s"), "src"))).where("r = 1").select("session", "src", "dst", "s")


def chains(links: DataFrame, nodes: DataFrame, rounds: int = 32) -> DataFrame:
    """(id, chain, pos): pointer doubling over unique predecessors; chain is its head, pos from 0."""
    now = nodes.select("id").join(links.select(F.col("dst").alias("id"), F.col("src").alias("up")), "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("pos"))
    for _ in range(rounds):
        far = now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("pos").alias("pos2"))
        new = settle(now.join(far, "up").select("id", F.col("up2").alias("up"), (F.col("pos") + F.col("pos2")).alias("pos")))
        if not new.join(now.select("id", F.col("up").alias("was")), "id").where("up <> was").limit(1).count():
            return new.withColumnRenamed("up", "chain")
        now = new
    raise ValueError("links have a cycle")


def hops(links: DataFrame, k: int) -> DataFrame:
    """(src, dst, hop): successors at distances 1..k."""
    step = links.select("src", "dst")
    out, now = step.withColumn("hop", F.lit(1)), step
    for h in range(2, k + 1):
        now = now.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"))
        out = out.unionByName(now.withColumn("hop", F.lit(h)))
    return out


def chain_context(placed: DataFrame, value: str, width: int, decay: float) -> DataFrame:
    """(id, context): mean of the chain's values within ``width`` places, weighted by decay ** distance."""
    w = Window.partitionBy("chain").orderBy("pos")
    num = den = F.lit(0.0)
    for d in range(-width, width + 1):
        x = F.lead(value, d).over(w) if d > 0 else F.lag(value, -d).over(w) if d < 0 else F.col(value)
        weight = decay ** abs(d)
        num = num + F.coalesce(x * weight, F.lit(0.0))
        den = den + F.when(x.isNotNull(), weight).otherwise(0.0)
    return placed.select("id", (num / den).alias("context"))


def link_weights(links: DataFrame, bias: float, temperature: float) -> DataFrame:
    """Links as edges in both directions: sigmoid((s - bias) / temperature), summed over repeats."""
    w = 1 / (1 + F.exp(-(F.col("s") - bias) / temperature))
    one = links.select("session", "src", "dst", w.alias("w"))
    both = one.unionByName(one.select("session", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("session", "src", "dst").agg(F.sum("w").alias("w"))


def united(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Edge tables as one: weights times each table's factor, summed."""
    out = None
    for edges, factor in parts:
        one = edges.select("session", "src", "dst", (F.col("w") * factor).alias("w"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("session", "src", "dst").agg(F.sum("w").alias("w"))


def gated(knn: DataFrame, links: DataFrame, beta: float, mode: str = "row") -> DataFrame:
    """One row-normalised edge table of two: (1 - b) of the neighbours', b of the links'. b is ``beta`` in
    rows that have links (mode ``row``), or ``beta`` times their weight up to 2, halved (``abs``)."""
    degree = links.groupBy("src").agg(F.sum("w").alias("d"))
    gate = degree.select("src", (F.lit(beta) * (F.least(F.col("d") / 2, F.lit(1.0)) if mode == "abs" else F.lit(1.0))).alias("b"), "d")
    near = row_normalised(knn).join(gate.drop("d"), "src", "left").select("session", "src", "dst", (F.col("w") * (1 - F.coalesce("b", F.lit(0.0)))).alias("w"))
    far = links.join(gate, "src").select("session", "src", "dst", (F.col("w") / F.col("d") * F.col("b")).alias("w"))
    return near.unionByName(far).groupBy("session", "src", "dst").agg(F.sum("w").alias("w"))


def walk(links: DataFrame, steps: int) -> DataFrame:
    """(src, dst, hop, conf): up to ``steps`` links ahead and back; conf is the product of the links' on
    the way. ``links`` has src, dst, conf."""
    step = links.select("src", "dst", "conf")
    sides = []
    for sign, one in ((1, step), (-1, step.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "conf"))):
        now = one
        sides.append(now.withColumn("hop", F.lit(sign)))
        for h in range(2, steps + 1):
            ahead = one.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("conf").alias("more"))
            now = now.join(ahead, "dst").select("src", F.col("far").alias("dst"), (F.col("conf") * F.col("more")).alias("conf"))
            sides.append(now.withColumn("hop", F.lit(sign * h)))
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out
