"""Approximate nearest neighbours by multi-index hashing, reranked by exact cosine.

Codes are 64 bits: the sample's principal axes, turned by an iteratively learned rotation, give a
sign each. A code is split into substrings of 8 bits, each with an index of its own. A code within
Hamming radius r of a query is, by the pigeonhole principle, within r // 8 of it in some substring,
so probing all substring values that near retrieves every code within r; codes farther away are
dropped and the rest is reranked on the original vectors in double precision.

Every distinct vector is indexed once and stands for all its ids; of these only the ``k + 1``
smallest can be in a result. Vectors are dealt into shards and queries into blocks of bounded size;
a task holds the index of one shard and answers one block. So each vector is copied once for every
``block_rows`` queries, and each query once for every ``shard_rows`` vectors.

The rotation and the radius are fitted on at most ``sample`` vectors (the first by a hash); the
radius covers 97 % of the sample's own nearest neighbours. Where it retrieves fewer than are asked
for, the shard is scanned.

Edge cases: vectors that are null, zero, hold null or non-finite components or differ in length from
the sample's take no part, neither as queries nor as candidates; repeated ids are one; ties go to
the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesbuf import ragged
from .shared import cut

PARTS, BITS = 8, 8
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NEAR = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


@dataclass
class Codes:
    mean: np.ndarray
    turn: np.ndarray  # (dimensions, bits)
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        x = _scaled(x)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        signs = (unit - self.mean) @ self.turn > 0
        full = np.zeros((len(x), PARTS * BITS), bool)
        full[:, : signs.shape[1]] = signs
        return np.packbits(full, axis=1)


def fit(x: np.ndarray, k: int, turns: int = 40, coverage: float = 0.97) -> Codes:
    x = _scaled(x)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(0)
    c = x - mean
    bits = min(PARTS * BITS, x.shape[1])
    values, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, ::-1][:, :bits]
    v = c @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((bits, bits)))
    for _ in range(turns):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    out = Codes(mean, axes @ turn, PARTS * BITS)
    asked = min(512, len(x))
    sims = x[:asked] @ x.T
    sims[np.arange(asked), np.arange(asked)] = -2
    codes = out.of(x)
    near = np.argsort(-sims, axis=1)[:, : min(k, len(x) - 1)]
    away = _POP[codes[:asked, None, :] ^ codes[near]].sum(2)
    out.radius = int(np.quantile(away, coverage)) if away.size else PARTS * BITS
    return out


class Shard:
    """Substring indexes over the codes of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, p], kind="stable") for p in range(PARTS)]
        self.heads = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, p], minlength=256))]) for p in range(PARTS)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius: exactly those."""
        each, more = divmod(radius, PARTS)
        flag = np.zeros(len(self.codes), bool)
        for p in range(PARTS):
            reach = each if p <= more else each - 1
            if reach < 0:
                continue
            values = np.flatnonzero(_NEAR[code[p]] <= reach)
            head = self.heads[p]
            flag[self.order[p][ragged(head[values], head[values + 1] - head[values])]] = True
        rows = np.flatnonzero(flag)
        return rows[_POP[self.codes[rows] ^ code].sum(1, dtype=np.int64) <= radius]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would not be finite, or would vanish, by a power of two; others as they are."""
    most = np.abs(x).max(1)
    odd = (most > 2.0**400) | (most < 2.0**-400)
    return np.where(odd[:, None], np.ldexp(x, -np.frexp(most)[1][:, None]), x) if odd.any() else x


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def search(vectors: DataFrame, is_query, *, k: int = 5, key: str = "vec_id", vector: str = "embedding", sample: int = 4096, shard_rows: int = 16_000, block_rows: int = 8_000) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where the column ``is_query`` holds, against all
    other rows."""
    x = F.col(vector).cast("array<double>")
    good = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))) & F.exists("v", lambda a: a != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), F.col("v"))})
    one = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("asks").alias("asks"), F.first("v").alias("v")))
    picked = np.array([r.v for r in one.orderBy(F.xxhash64("rep"), "rep").select("v", F.size("v").alias("d")).limit(sample).collect() if r.v], object)
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(picked):
        return empty
    lengths = [len(v) for v in picked]
    size = max(set(lengths), key=lambda d: (lengths.count(d), d))
    model = fit(np.array([v for v in picked if len(v) == size], float), k)
    one = one.where(F.size("v") == size)
    n, asking = one.agg(F.count("*"), F.sum(F.col("asks").cast("int"))).first()
    if not asking:
        return empty
    shards, blocks = -(-n // shard_rows), -(-asking // block_rows)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    index = one.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = one.where("asks").select("rep", "v", F.pmod(F.xxhash64(F.lit(1), "rep"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    schema = "qrep long, crep long, score double"

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_c, out_s = [], [], []
        if len(left) and len(right):
            model = shared.value
            ids, v = left["rep"].to_numpy(), _matrix(left["v"])
            queries, q = right["rep"].to_numpy(), _matrix(right["v"])
            v, q = _scaled(v), _scaled(q)
            norm, qnorm = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
            shard, codes = Shard(model.of(v)), model.of(q)
            want = min(k + 1, len(ids))
            for i in range(len(queries)):
                found = shard.within(codes[i], model.radius)
                if len(found) < want:
                    found = np.arange(len(ids))
                score = (v[found] @ q[i]) / (norm[found] * qnorm[i])
                if len(found) > want:
                    floor = np.partition(score, len(score) - want)[len(score) - want]
                    near = np.flatnonzero(score >= floor)
                    found, score = found[near], score[near]
                top = np.lexsort((ids[found], -score))[:want]
                out_q.append(np.full(len(top), queries[i]))
                out_c.append(ids[found[top]])
                out_s.append(score[top])
        cols = [np.concatenate(o) if o else np.zeros(0, t) for o, t in ((out_q, np.int64), (out_c, np.int64), (out_s, np.float64))]
        return pa.table({"qrep": pa.array(cols[0], pa.int64()), "crep": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(cell, schema)
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("qrep").orderBy(F.desc("score"), "crep"))).where(F.col("r") <= k + 1).drop("r")
    slim = rows.select("id", "h1", "h2", "asks").distinct()
    member = slim.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    members = member.join(one.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("rep").alias("crep"), F.col("id").alias("vec_id"))
    wide = top.join(members, "crep").withColumn("r", F.row_number().over(Window.partitionBy("qrep").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    # a query's vector may be a third of all queries': gather its few neighbours, then join them once
    lists = wide.groupBy("qrep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), "vec_id", "score"))).alias("near"))
    asks = slim.where("asks").join(one.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("id").alias("query_id"), F.col("rep").alias("qrep"))
    near = asks.join(lists, "qrep").select("query_id", F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return near.select("query_id", F.posexplode("near").alias("p", "s")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "s.vec_id", "s.score")


