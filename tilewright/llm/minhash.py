"""Near-duplicates by ProbMinHash: signatures for probability Jaccard, banding, verification.

Shingles are five consecutive words (A-Z lower-cased); a shorter text is one shingle of all its
words. A shingle's weight is how often it occurs. The similarity of two texts is the probability
Jaccard similarity of their weighted shingles, and 0.8 or more makes a link.

Signature: each shingle is a Poisson process whose rate is its weight; its arrivals land on random
registers, and a register keeps the earliest. A process ends as soon as its next arrival comes after
the latest of all registers, so most shingles of a long text stop after one or two arrivals.

Groups: texts with the same word sequence are one *form* (exact copies and copies that differ in
case or punctuation), and only forms are compared. Bands put forms into buckets. In a bucket every
member is compared with the bucket's hub first. Where that leaves several groups in a bucket, long
signatures of its members are compared in blocks, and near pairs are verified like all others. So
no pair of a bucket that could join two groups is skipped, and only near pairs are ever emitted.

Edge cases: documents with null ids or null text are groups of their own, and so are texts without
words unless the text is the same; repeated rows share a group; ties go to the smaller doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesbuf import U64, mix, ragged, words
from .shared import cut, long, per_text, swept

M, BANDS = 128, 32
ROWS = M // BANDS
SHINGLE = 5
#: Registers of the signatures that are compared with each other.
LONG = 512
#: Edges of a graph whose components are found in the driver (16 bytes each, 10 MB or so with its arrays).
SMALL = 100_000
_GOLD = U64(0x9E3779B97F4A7C15)
_MULT = mix(np.arange(11, 11 + SHINGLE, dtype=U64) * _GOLD) | U64(1)


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of all documents in a row, and where each document's begin."""
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    out = np.concatenate([[0], np.cumsum(count)])
    if not out[-1]:
        return np.zeros(0, U64), out
    padded = np.concatenate([hashes, np.zeros(SHINGLE, U64)])
    at = ragged(first[:-1], count)
    mixed = np.zeros(len(at), U64)
    size = np.repeat(n, count)
    for k in range(SHINGLE):
        mixed += np.where(k < size, padded[at + k], U64(0)) * _MULT[k]
    return mix(mixed), out


def weighted(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their counts; sorted within it."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((sh, doc))
    s, d = sh[order], doc[order]
    head = np.ones(len(s), bool)
    head[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    where = np.flatnonzero(head)
    return s[where], np.diff(np.append(where, len(s))), np.concatenate([[0], np.cumsum(np.bincount(d[where], minlength=len(at) - 1))])


def signatures(sh: np.ndarray, weight: np.ndarray, at: np.ndarray, m: int = M) -> np.ndarray:
    """(documents, m) shingles that own the registers; 0 in a document without shingles."""
    n = len(at) - 1
    q, z = np.full(n * m, np.inf), np.zeros(n * m, U64)
    doc = np.repeat(np.arange(n), np.diff(at))
    active, time = np.arange(len(sh)), np.zeros(len(sh))
    rate = weight.astype(float)
    step = 0
    while len(active):
        step += 1
        r = mix(sh[active] + U64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        u = (r >> U64(11)).astype(float) * 2.0**-53 + 2.0**-54
        time = time - np.log(u) / rate[active]
        slot = doc[active] * m + (mix(r) % U64(m)).astype(np.int64)
        np.minimum.at(q, slot, time)
        won = q[slot] == time
        z[slot[won]] = sh[active[won]]
        latest = q.reshape(n, m).max(1)
        going = time < latest[doc[active]]
        active, time = active[going], time[going]
    return z.reshape(n, m)


def form_hash(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each document's word sequence, as two numbers; they mark a form."""
    n = np.diff(first)
    place = ragged(np.zeros(len(n), np.int64), n).astype(U64)
    out = []
    for salt in (3, 5):
        x = mix((hashes ^ U64(salt * 0x5851F42D4C957F2D & (1 << 64) - 1)) + place * _GOLD)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(x)])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + n.astype(U64)))
    return out[0], out[1]


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact, for sorted distinct shingles with weights: the sum over common ones of
    1 / sum over all of max(x / x_d, y / y_d)."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    xa, xb = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    # max(x/x_d, y/y_d) is x/x_d where x/y > x_d/y_d: one sort by the ratio serves every d
    ratio = xa / xb
    order = np.argsort(ratio, kind="stable")
    ca, cb = np.concatenate([[0], np.cumsum(xa[order])]), np.concatenate([[0], np.cumsum(xb[order])])
    k = np.searchsorted(ratio[order], ratio, "right")
    total = (only_a + ca[-1] - ca[k]) / xa + (only_b + cb[k]) / xb
    return float((1 / total).sum())


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, f1, f2 (its form), worded, bands (a hash each): one pass over the texts."""
    fields = [long("f1"), long("f2"), long("n_words"), T.StructField("bands", T.ArrayType(T.LongType()))]

    def make():
        salts = mix(np.arange(1, BANDS + 1, dtype=U64) * _GOLD)

        def kernel(data, offsets):
            _, _, _, hashes, first = words(data, offsets)
            f1, f2 = form_hash(hashes, first)
            sig = signatures(*weighted(*shingles(hashes, first)))
            parts = sig.reshape(len(sig), BANDS, ROWS)
            h = np.zeros(parts.shape[:2], U64)
            for r in range(ROWS):
                h = mix(h * _GOLD + parts[:, :, r])
            h = mix(h ^ salts)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * BANDS), pa.array(h.view(np.int64).ravel()))
            return [f1.view(np.int64), f2.view(np.int64), np.diff(first), bands]

        return kernel

    source = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("copy"), text)
    worded = F.col("n_words") > 0
    return per_text(source, text, ["id", "copy"], fields, make).select("id", F.when(worded, F.col("f1")).otherwise(F.col("copy")).alias("f1"), F.when(worded, F.col("f2")).otherwise(F.lit(-1)).alias("f2"), worded.alias("worded"), "bands")


def _shingled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, sh, w: distinct shingles, shortened to 32 bits, and their weights (none if all are 1), as
    bytes. Two of a text's n shingles fall together with a probability of n**2 / 2**33."""

    def make():
        def kernel(data, offsets):
            _, _, _, hashes, first = words(data, offsets)
            s, at = shingles(hashes, first)
            s, w, at = weighted(s >> U64(32), at)
            s, w = s.astype(np.uint32), np.minimum(w, np.iinfo(np.int32).max).astype(np.int32)
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            return [pa.array([s[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([b"" if (w[a:b] == 1).all() else w[a:b].tobytes() for a, b in spans], pa.binary())]

        return kernel

    source = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), text)
    return per_text(source, text, ["id"], [T.StructField("sh", T.BinaryType()), T.StructField("w", T.BinaryType())], make)


def _read(sh: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(sh, np.uint32)
    return s, np.frombuffer(w, np.int32) if w else np.ones(len(s), np.int32)


def _verified(pairs: DataFrame, content: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of similarity ``least`` or more. Both joins can be split where u or v is hot."""
    a = content.select(F.col("id").alias("u"), F.col("sh").alias("su"), F.col("w").alias("wu"))
    b = content.select(F.col("id").alias("v"), F.col("sh").alias("sv"), F.col("w").alias("wv"))
    wide = pairs.join(b, "v").join(a, "u").select("u", "v", "su", "wu", "sv", "wv")

    def run(batches):
        for batch in batches:
            su, wu, sv, wv = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [probability_jaccard(*_read(p, q), *_read(r, s)) >= least - 1e-9 for p, q, r, s in zip(su, wu, sv, wv, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return wide.mapInArrow(run, "u long, v long")


def _joined(u: np.ndarray, v: np.ndarray) -> pa.Table:
    """(id, root) of the edges' vertices, in arrays: roots hang on smaller ones until no edge has two."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return pa.table({"id": pa.array(ids, pa.int64()), "root": pa.array(ids[root], pa.int64())})
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, rounds: int = 40, small: int = SMALL) -> DataFrame:
    """(id, root) for every vertex of the edges (u, v): root is the smallest id of its component.

    Up to ``small`` edges are joined in the driver: planning the rounds of a small graph takes more
    of its memory than the edges. More edges alternate large-star and small-star steps until none
    changes; every step is a grouped minimum (combined before the shuffle) joined back to the edges.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if e.count() <= small:
        arrays = e.toArrow()
        return e.sparkSession.createDataFrame(_joined(arrays["u"].to_numpy(), arrays["v"].to_numpy()))
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        less = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        e = cut(less)
        n, total = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id").union(e.select("v", F.col("v").alias("root")).distinct())


def _near(open_: DataFrame, content: DataFrame, bands: DataFrame, least: float, block: int) -> DataFrame:
    """Distinct pairs of different roots that share an open bucket and whose long signatures (one byte
    of each of ``LONG`` registers) say a similarity of nearly ``least``.

    The signatures of a bucket are compared in blocks of rows and only near pairs are emitted, each
    by the first of the buckets that it shares; a bucket of more than ``block`` rows is compared by
    several tasks, two of its blocks in each.
    """

    def sign(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                each = [_read(sh, w) for sh, w in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                at = np.concatenate([[0], np.cumsum([len(s) for s, _ in each])])
                sig = signatures(mix(np.concatenate([s for s, _ in each]).astype(U64) + U64(1)), np.concatenate([w for _, w in each]), at, LONG)
                low = (mix(sig) & U64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "sig"])

    needed = open_.select("id").distinct()
    signs = content.dropDuplicates(["id"]).join(needed, "id", "left_semi").mapInArrow(sign, "id long, sig binary").join(bands.select("id", "bands").dropDuplicates(["id"]), "id")
    sizes = open_.groupBy("h").agg((F.floor((F.count("*") - 1) / block) + 1).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = open_.join(sizes, "h").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("h", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "root")
    floor = least - 4 * (least * (1 - least) / LONG) ** 0.5

    def compare(table: pa.Table) -> pa.Table:
        ids, roots, mine = (table[c].to_numpy() for c in ("id", "root", "mine"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, LONG)
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        i, j, h = (table[c][0].as_py() for c in ("i", "j", "h"))
        rows, cols = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        if i == j:  # members of the largest group need no turn of their own
            groups, n = np.unique(roots[rows], return_counts=True)
            rows = rows[roots[rows] != groups[n.argmax()]]
        us, vs = [], []
        for at in range(0, len(rows), 16):
            part = rows[at : at + 16]
            same = (sig[part][:, None, :] == sig[cols][None, :, :]).sum(2) / LONG
            same = (same - 1 / 256) / (1 - 1 / 256)
            x, y = np.nonzero((same >= floor) & (roots[part][:, None] != roots[cols][None, :]))
            a, b = part[x], cols[y]
            own = np.where(bands[a] == bands[b], bands[a], np.iinfo(np.int64).max).min(1) == h
            us.append(ids[a[own]])
            vs.append(ids[b[own]])
        u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
        return pa.table({"u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})

    return dealt.join(signs, "id").groupBy("h", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 0.8, few: int = 2000, block: int = 10_000) -> DataFrame:
    """(id, root) for the documents that share a group with another id; root is the group's smallest id.

    The first hub of a bucket is the member that shares most buckets' rows: in a cloud of copies of
    one text, that text. ``few``: as soon as buckets with several groups hold at most that many pairs
    across groups for each row, these are compared in blocks; until then other hubs take turns. A
    bucket whose groups became fewer by less than a tenth in its turn takes no more hubs, and when
    none takes any, all that are still open are compared in blocks.
    """
    with swept(docs.sparkSession):
        roots = _classes(docs, key, text, least, few, block)
    return roots.select("id", "root")


def _classes(docs: DataFrame, key: str, text: str, least: float, few: int, block: int) -> DataFrame:
    sig = cut(signed(docs, key, text))
    by_form = sig.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("id").alias("far"))
    copies = sig.select("id", "f1", "f2").join(by_form.where("rep <> far"), ["f1", "f2"]).where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v")).distinct()
    reps = sig.where("worded").join(by_form.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    rows = reps.select("id", F.explode("bands").alias("h"))
    shared = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("h", "n")
    buckets = cut(rows.join(shared, "h"))
    mass = buckets.groupBy("id").agg(F.sum("n").alias("mass"))
    hubs = buckets.join(mass, "id").groupBy("h").agg(F.max(F.struct("mass", (-F.col("id")).alias("m"))).alias("x")).select("h", (-F.col("x.m")).alias("hub"))
    tested = cut(buckets.join(hubs, "h").where("id <> hub").select(F.least("hub", "id").alias("u"), F.greatest("hub", "id").alias("v")).distinct())
    content = cut(_shingled(docs.join(mass.select("id"), docs[key].cast("long") == mass["id"], "left_semi"), key, text))
    edges = cut(_verified(tested, content, least).union(copies))
    turn, going = 0, None
    while True:
        roots = components(edges)
        turn += 1
        rooted = buckets.where("n > 2").join(roots, "id", "left").select("h", "id", F.coalesce("root", "id").alias("root"))
        split = rooted.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
        open_ = cut(rooted.join(split, "h"))
        counts = open_.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("cross"), F.sum("c").alias("n"), F.count("*").alias("groups"))
        if going is not None:
            counts = counts.join(going.select("h", F.col("groups").alias("before")), "h").where("groups <= 0.9 * before").drop("before")
        going = cut(counts)
        cross, n = going.agg(F.coalesce(F.sum("cross"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if cross <= few * n:
            if open_.isEmpty():
                return roots
            near = cut(_near(open_, content, sig, least, block))
            return components(edges.union(_verified(near, content, least)))
        order = F.xxhash64("id", F.lit(turn))
        hub = open_.join(going.select("h"), "h", "left_semi").groupBy("h").agg(F.min(F.struct(order.alias("o"), "id", "root")).alias("x"))
        pairs = open_.join(hub, "h").where("root <> x.root").select(F.least("id", "x.id").alias("u"), F.greatest("id", "x.id").alias("v")).distinct()
        edges = cut(edges.union(_verified(pairs, content, least)))


def membership(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """One row per document: its id, class_id (the smallest id of its group) and whether it is kept."""
    roots = classes(docs, key=key, text=text, least=least)
    ids = docs.select(F.col(key).alias(key), F.col(key).cast("long").alias("id"))
    out = ids.join(roots, "id", "left").select(key, F.coalesce("root", "id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("class_id"), F.lit(True)))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """Columns as they are; the document of each group with the smallest id stays, once."""
    gone = classes(docs, key=key, text=text, least=least).where("id <> root").select(F.col("id").alias("__gone"))
    left = docs.join(gone, docs[key].cast("long") == gone["__gone"], "left_anti")
    known = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    if known.groupBy(key).count().where("count > 1").limit(1).count():  # repeated ids: one row of each stays
        number = left.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text))))
        left = number.where(F.col(key).isNull() | F.col(text).isNull() | (F.col("__n") == 1)).drop("__n")
    return left
