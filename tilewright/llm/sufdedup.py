"""Exact removal of repeated passages by threshold-bounded interval expansion on a BWT.

A byte goes if a string of ``least`` (100) bytes that covers it also starts earlier in the corpus.

1. Anchors. In every 100-byte string the leftmost 37-byte piece of least hash is its anchor; equal
   strings have equal anchors at equal places. So it is enough to compare strings around equal
   anchors. Each anchor comes with the range of string starts it stands for.
2. Contexts. Anchors that occur once are dropped; for the others the bytes their strings cover are
   sent to the anchor's partition.
3. Interval expansion. A partition's contexts are taken in slices of whole anchor groups. Of each
   slice the Burrows-Wheeler transform is built, and backward extension of intervals, breadth
   first, derives common-prefix lengths by increasing value; it stops at 100. What is still
   undivided then is a class of equal strings, and all of a class but the earliest are repeats.
4. The repeats' byte ranges are gathered for each document, which drops them.

Exact copies of a whole text aren't compared: all but the first are repeats throughout. Anchors so
frequent that their group would not fit a task (an estimate from a sample decides; it changes the
way, not the result) are compared by 128-bit hashes of each string in a distributed aggregation.

Periodic texts have one anchor at every period. Equal anchors in a row share a context of up to ``RUN``
starts, which has starts beyond its first anchor's place and so may hold repeats on its own, and a context that repeats an earlier one of its document goes without its bytes. So the bytes
sent are few times the text's, whatever the text.

Edge cases: null text is empty; texts under 100 bytes stay whole; very long ones of few characters, see above; documents are ordered by doc_id,
null first, and rows of one doc_id by a hash of the text; repeated rows: one stays, the rest are
copies; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesbuf import U64, mix, prefix, ragged, substring_hash
from .shared import cut, stored, text_slices

LEAST = 100
WINDOW = 64  # anchors' places in a string; a power of two
PIECE = LEAST - WINDOW + 1
SLICE = 3 << 20
#: String starts that one context holds at most where an anchor comes again and again (a run of one
#: character, or of a short period).
RUN = 1 << 17
#: An anchor with more occurrences than this doesn't go to one task.
GROUP = 200_000
SAMPLE = 64
CHUNK = 1 << 20


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, anchor's hash, its place in the document, first and last start it stands for.

    Where an anchor is followed by the same one, as in periodic text, up to ``RUN`` starts are one entry
    with the place of the first. Only such an entry has starts beyond its place.
    """
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < LEAST:
        return none
    sums = prefix(data)
    at = np.arange(n - PIECE + 1)
    h = substring_hash(sums, at, at + PIECE)
    bits = U64(max(22, int(n).bit_length()))
    key = (h >> bits << bits) | at.astype(U64)
    step = 1
    while step < WINDOW:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    size = np.diff(offsets)
    doc = np.flatnonzero(size >= LEAST)
    count = size[doc] - LEAST + 1
    start = ragged(offsets[doc], count)
    if not len(start):
        return none
    place = (key[start] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    head = np.ones(len(start), bool)
    head[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    head[np.cumsum(count)[:-1]] = True
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start)) - 1
    owner = np.repeat(doc, count)[first]
    base = offsets[owner]
    found, place, first, last = h[place[first]], place[first] - base, start[first] - base, start[last] - base
    again = np.concatenate([[False], (found[1:] == found[:-1]) & (owner[1:] == owner[:-1])])
    if again.any():
        run = np.cumsum(~again) - 1
        begin = first[~again][run]
        head = ~again | np.concatenate([[False], (first[1:] - begin[1:]) // RUN != (first[:-1] - begin[:-1]) // RUN])
        at = np.flatnonzero(head)
        last = last[np.append(at[1:], len(last)) - 1]
        owner, found, place, first = owner[at], found[at], place[at], first[at]
    return owner, found.view(np.int64), place, first, last


def bwt_classes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations in order, and for each a class: equal numbers mark rotations that agree in their
    first ``least`` bytes.

    The order is by the first 128 bytes or more (prefix doubling). Then backward extension: level l
    holds intervals of strings of length l; a child's right border that is not set yet gets the
    value l, and the child is enqueued. Borders unset after level least - 1 have a value of least
    or more.
    """
    n = len(text)
    wide = np.concatenate([text, np.resize(text, 8)]).astype(U64)
    key = np.zeros(n, U64)
    for k in range(8):
        key = (key << U64(8)) | wide[k : n + k]
    order, rank, groups = _ranked(key)
    depth = 8
    while depth < least and groups < n:
        order, rank, groups = _ranked(rank.astype(U64) * U64(n) + np.roll(rank, -depth).astype(U64))
        depth *= 2
    bwt = text[order - 1]
    by_char = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_char] = np.arange(n)
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = bwt[by_char[1:]] == bwt[by_char[:-1]]
    after[by_char[:-1][same]] = by_char[1:][same]
    before[by_char[1:][same]] = by_char[:-1][same]
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    left, right = np.array([0]), np.array([n - 1])
    for _ in range(least):
        if not len(left):
            break
        size = right - left + 1
        at = ragged(left, size)
        ends = np.sort(lf[at[after[at] > np.repeat(right, size)]])
        starts = np.sort(lf[at[before[at] < np.repeat(left, size)]])
        new = unset[ends + 1]
        left, right = starts[new], ends[new]
        unset[right + 1] = False
    return order, np.cumsum(~unset[:n])


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    order = np.argsort(key)
    sorted_key = key[order]
    step = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
    rank = np.empty(len(key), np.int64)
    rank[order] = step
    return order, rank, int(step[-1]) + 1


def repeats(h: np.ndarray, rank: np.ndarray, start: np.ndarray, left: np.ndarray, span: np.ndarray, body: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of whole anchor groups, earliest by (rank of the document, start).
    Returns (context, from, to): byte ranges in the document that repeat an earlier string.

    Of equal contexts all but the earliest are repeats throughout. Different contexts of one anchor
    then meet in the transform.
    """
    order = np.lexsort((start, rank))
    new = np.ones(len(order), bool)  # the same row twice is one
    new[1:] = (rank[order][1:] != rank[order][:-1]) | (start[order][1:] != start[order][:-1])
    order = order[new]
    code = body.dictionary_encode().indices.to_numpy()[order]
    first = np.zeros(len(order), bool)
    first[np.unique(code, return_index=True)[1]] = True
    copies, u = order[~first], order[first]
    out = [(copies, start[copies], start[copies] + span[copies] + LEAST)]
    _, inverse, n = np.unique(h[u], return_inverse=True, return_counts=True)
    run = np.zeros(len(n), bool)  # a context of several anchors may repeat itself, or any place of it
    run[inverse[span[u] > left[u]]] = True
    some = (n[inverse] > 1) | run[inverse]
    u, run = u[some], run[inverse][some]
    if len(u):
        u = u[run | _shared(h[u], left[u], span[u], body.take(pa.array(u)))]
    if len(u):
        data, offsets = _bytes(body.take(pa.array(u)))
        size = np.diff(offsets)
        head = np.cumsum(size + 1) - size - 1
        text = np.full(int(size.sum()) + len(u), 0xFF, np.uint8)
        text[ragged(head, size)] = data
        turn, cls = bwt_classes(text, LEAST)
        when = np.full(len(text), np.iinfo(np.int64).max)
        count = span[u] + 1
        when[ragged(head, count)] = (np.repeat(rank[u], count) << 40) + ragged(start[u], count)
        sorted_when = when[turn]
        borders = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        least = np.repeat(np.minimum.reduceat(sorted_when, borders), np.diff(np.append(borders, len(text))))
        late = np.zeros(len(text) + 1, bool)
        late[turn] = (sorted_when > least) & (sorted_when < np.iinfo(np.int64).max)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], late.view(np.int8)])))
        a, b = edge[::2], edge[1::2]
        owner = np.searchsorted(head, a, "right") - 1
        out.append((u[owner], start[u[owner]] + a - head[owner], start[u[owner]] + b - 1 - head[owner] + LEAST))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _bytes(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    return np.frombuffer(bodies.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _key():
    return F.xxhash64("doc_id", "text")


def _anchored(docs: DataFrame) -> DataFrame:
    """h, r, place (place << 24 | starts before it << 18 | further starts): one row per anchor."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, data, offsets in text_slices(batch.column(2)):
                doc, h, place, first, last = anchors(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(keys[lo + doc]), pa.array(place << 24 | (place - first) << 18 | (last - first))], names=["h", "r", "place"])

    # all columns of the texts' shuffle, so that it is made once
    return docs.select("r", "doc_id", "text").mapInArrow(run, "h long, r long, place long")


def _alike(data: np.ndarray, sums: tuple[np.ndarray, np.ndarray], owner: np.ndarray, h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Contexts that repeat an earlier one of their document and anchor, byte by byte."""
    keys = [mix(substring_hash(x, start, start + size) ^ U64(k)) for k, x in enumerate(sums)]
    order = np.lexsort((start, keys[1], keys[0], h, owner))
    same = np.ones(len(order) - 1, bool)
    for x in (owner, h, *keys, size):
        same &= x[order][1:] == x[order][:-1]
    again = order[1:][same]
    head = order[np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))][1:][same]
    out = np.zeros(len(order), bool)
    ends = np.cumsum(size[again])
    for lo, hi in _pieces(ends, CHUNK):  # held against the bytes
        a, b = again[lo:hi], head[lo:hi]
        equal = data[ragged(start[a], size[a])] == data[ragged(start[b], size[b])]
        out[a] = np.minimum.reduceat(equal, np.cumsum(size[a]) - size[a])
    return out


def _pieces(ends: np.ndarray, limit: int):
    """Ranges of rows of about ``limit`` bytes, from the rows' summed sizes."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, hi
        lo = hi


def _contexts(joined: DataFrame) -> DataFrame:
    """Rows (h, doc_id, r, start, left, span, body) from rows (r, doc_id, text, marks): the bytes that
    an anchor's strings cover, where they start, how far before the anchor, and further starts. The
    body is empty where it is that of an earlier context of the document and the anchor."""

    def run(batches):
        names = ["h", "doc_id", "r", "start", "left", "span", "body"]
        for batch in batches:
            rs, ids, marks = batch.column(0), batch.column(1), batch.column(3)
            for lo, hi, data, offsets in text_slices(batch.column(2), CHUNK):
                part = marks.slice(lo, hi - lo)
                count = np.diff(part.offsets.to_numpy())
                inner = part.flatten()
                place = inner.field(1).to_numpy(zero_copy_only=False)
                h = inner.field(0).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(hi - lo), count)
                left, span = place >> 18 & 63, place & (1 << 18) - 1
                start, size = (place >> 24) - left, span + LEAST
                if not len(start):
                    continue
                again = _alike(data, (prefix(data), prefix(data ^ np.uint8(0x5A))), owner, h, offsets[owner] + start, size)
                size = np.where(again, 0, size)
                for a, b in _pieces(np.cumsum(size + 16), CHUNK):
                    body = data[ragged(offsets[owner[a:b]] + start[a:b], size[a:b])]
                    ends = np.concatenate([[0], np.cumsum(size[a:b])]).astype(np.int32)
                    bodies = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(body)])
                    take = pa.array(lo + owner[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(h[a:b]), ids.take(take), rs.take(take), pa.array(start[a:b]), pa.array(left[a:b]), pa.array(span[a:b]), bodies], names=names)

    return joined.mapInArrow(run, "h long, doc_id long, r long, start long, left long, span long, body binary")


def _shared(h: np.ndarray, left: np.ndarray, span: np.ndarray, bodies: pa.Array) -> np.ndarray:
    """Contexts that can hold a repeat. A string reaches 32 bytes or more before its anchor, or 32 or
    more beyond the anchor's piece; so some other context of the anchor must agree in one of these."""
    data, offsets = _bytes(bodies)
    at = offsets[:-1] + left
    sums = prefix(data)
    out = np.zeros(len(h), bool)
    half = WINDOW // 2
    for rows, a, b in ((np.flatnonzero(left >= half), -half, PIECE), (np.flatnonzero(left - span < half), 0, PIECE + half)):
        key = mix(substring_hash(sums, at[rows] + a, at[rows] + b) ^ h[rows].view(U64))
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        out[rows[n[inverse] > 1]] = True
    return out


_RANGE = "r long, lo long, hi long"


def _held(part: pa.RecordBatch) -> int:
    """Bytes of a part's contexts, with something for each row."""
    return (pc.sum(pc.binary_length(part.column(6))).as_py() or 0) + 32 * part.num_rows



def _compared(contexts: DataFrame) -> DataFrame:
    """Repeated ranges (r, lo, hi): partitions by anchor, whole groups, slices of bounded size."""

    def take(parts: list[pa.RecordBatch], upto: int | None = None):
        t = pa.Table.from_batches(parts)
        t = (t if upto is None else t.slice(0, upto)).combine_chunks()
        if not len(t):
            return
        copy = pc.equal(pc.binary_length(t["body"]), 0)
        lone = t.filter(copy)
        if len(lone):
            start = lone["start"].to_numpy()
            yield pa.RecordBatch.from_arrays([lone["r"].combine_chunks(), pa.array(start), pa.array(start + lone["span"].to_numpy() + LEAST)], names=["r", "lo", "hi"])
        t = t.filter(pc.invert(copy)).combine_chunks()
        h = t["h"].to_numpy()
        same = h[1:] == h[:-1]
        t = t.filter(pa.array((np.concatenate([same, [False]]) | np.concatenate([[False], same]))[: len(h)] | (t["span"].to_numpy() > t["left"].to_numpy()))).combine_chunks()
        if not len(t):
            return
        ids = pc.fill_null(t["doc_id"], np.iinfo(np.int64).min).to_numpy()
        r = t["r"].to_numpy()
        order = np.lexsort((r, ids))
        fresh = np.concatenate([[0], (ids[order][1:] != ids[order][:-1]) | (r[order][1:] != r[order][:-1])])
        rank = np.empty(len(r), np.int64)
        rank[order] = np.cumsum(fresh)
        which, lo, hi = repeats(t["h"].to_numpy(), rank, t["start"].to_numpy(), t["left"].to_numpy(), t["span"].to_numpy(), t["body"].chunk(0))
        if len(which):
            yield pa.RecordBatch.from_arrays([pa.array(r[which]), pa.array(lo), pa.array(hi)], names=["r", "lo", "hi"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                parts.append(piece)
                size += _held(piece)
                if size >= SLICE:
                    h = np.concatenate([p.column(0).to_numpy() for p in parts])
                    end = int(np.searchsorted(h, h[-1], "left")) if len(h) else 0
                    if end:
                        yield from take(parts, end)
                        rest = pa.Table.from_batches(parts).slice(end).combine_chunks()
                        parts = rest.to_batches()
                        size = sum(map(_held, parts))
        if parts:
            yield from take(parts)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, _RANGE)


def _hashed(contexts: DataFrame) -> DataFrame:
    """The same for anchors of too many contexts, in distributed aggregations. Equal contexts are first
    reduced to their earliest; strings of what is left meet by 128-bit hashes."""

    def run(batches):
        for batch in batches:
            ids, rs = batch.column(0), batch.column(1)
            first, span = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for lo, hi, data, offsets in text_slices(batch.column(4), CHUNK):
                n = span[lo:hi] + 1
                s = ragged(offsets[:-1], n)
                a = substring_hash(prefix(data), s, s + LEAST)
                b = mix(substring_hash(prefix(data ^ np.uint8(0x5A)), s, s + LEAST) ^ U64(0xA5A5))
                take = pa.array(np.repeat(np.arange(lo, hi), n))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), ids.take(take), rs.take(take), pa.array(ragged(first[lo:hi], n))], names=["a", "b", "doc_id", "r", "start"])

    copies = contexts.where(F.octet_length("body") == 0).select("r", F.col("start").alias("lo"), (F.col("start") + F.col("span") + LEAST).alias("hi"))
    contexts = contexts.where(F.octet_length("body") > 0)
    keyed = contexts.withColumns({"k1": F.xxhash64("body"), "k2": F.xxhash64(F.lit(5), F.col("body"))})
    firsts = keyed.groupBy("h", "k1", "k2").agg(F.min(F.struct("doc_id", "r", "start", "span", "body")).alias("f"))
    slim = keyed.select("h", "k1", "k2", "r", "start", "span").join(firsts.select("h", "k1", "k2", F.col("f.r").alias("fr"), F.col("f.start").alias("fs")), ["h", "k1", "k2"])
    whole = slim.where("not (r = fr and start = fs)").select("r", F.col("start").alias("lo"), (F.col("start") + F.col("span") + LEAST).alias("hi"))
    each = firsts.select("f.*").mapInArrow(run, "a long, b long, doc_id long, r long, start long")
    first = each.groupBy("a", "b").agg(F.min(F.struct("doc_id", "r", "start")).alias("f"))
    late = each.join(first, ["a", "b"]).where("not (r = f.r and start = f.start)").select("r", F.col("start").alias("lo"), (F.col("start") + LEAST).alias("hi"))
    return whole.unionByName(late).unionByName(copies)


def dropped(docs: DataFrame, *, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    # without an alias where none is needed: it would make the uses of the texts' shuffle look different
    named = F.col(key) if (key, dict(docs.dtypes)[key]) == ("doc_id", "bigint") else F.col(key).cast("long").alias("doc_id")
    docs = docs.select(named, F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = docs.select("doc_id", _key().alias("r"), F.sha2("text", 256).alias("th"), F.octet_length("text").cast("long").alias("n_bytes"))
    slim = cut(slim.groupBy("doc_id", "r", "th", "n_bytes").agg(F.count("*").alias("copies")))
    mark = F.struct("doc_id", "r")
    first = slim.groupBy("th").agg(F.min(mark).alias("f"), F.count("*").alias("ids")).where("ids > 1").select("th", F.col("f.r").alias("first"))
    placed = slim.join(first, "th", "left").withColumn("copy", F.coalesce(F.col("r") != F.col("first"), F.lit(False)))
    copies = placed.where("copy").select("r")
    # texts of 100 bytes or more, a row for each that isn't a copy; partitioned by r for all that follows
    source = docs.where(F.octet_length("text") >= LEAST).select(_key().alias("r"), "doc_id", "text").join(copies, "r", "left_anti")
    sample = source.where(F.pmod(F.xxhash64(F.lit(3), "r"), F.lit(SAMPLE)) == 0)
    most = max(2, group // SAMPLE)
    hot = stored(_anchored(sample).groupBy("h").count().where(F.col("count") >= most).select("h"))
    crowded = hot.count()
    # as many as the sample's anchors over ``most``; sent while that is few
    hot = None if not crowded else F.broadcast(hot) if crowded <= 1_000_000 else hot
    marks = _anchored(source)
    # an anchor's rows are at most about ``group``, or it is known to be crowded and dealt out
    crowd = F.lit(False) if hot is None else F.coalesce("crowd", F.lit(False))
    again = marks if hot is None else marks.join(hot.withColumn("crowd", F.lit(True)), "h", "left")
    again = again.withColumn("crowd", crowd).withColumn("salt", F.when(F.col("crowd"), F.pmod(F.xxhash64("r"), F.lit(256))).otherwise(0))
    several = F.col("place").bitwiseAND((1 << 18) - 1) > F.shiftright("place", 18).bitwiseAND(WINDOW - 1)
    again = again.withColumn("n", F.count("*").over(Window.partitionBy("h", "salt"))).where(F.col("crowd") | (F.col("n") > 1) | several).select("h", "r", "place")
    listed = again.groupBy("r").agg(F.collect_list(F.struct("h", "place")).alias("marks"))
    contexts = _contexts(source.join(listed, "r").select("r", "doc_id", "text", "marks"))
    if hot is None:
        ranges = _compared(contexts)
    else:
        ranges = _compared(contexts.join(hot, "h", "left_anti").select(*contexts.columns)).unionByName(_hashed(contexts.join(hot, "h", "left_semi").select(*contexts.columns)))
    per_doc = ranges.groupBy("r").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    changed = _applied(source.join(per_doc, "r").select("r", "doc_id", "text", "ranges"))
    whole = F.col("copy") & (F.col("n_bytes") >= LEAST)
    empty = hashlib.sha256(b"").hexdigest()
    out = placed.join(changed, "r", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept", "th")).alias("kept_sha256"),
        "copies",
    )
    if slim.where("copies > 1").limit(1).count():  # repeated rows: one as it is, the others copies of it
        more = out.where("copies > 1").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))))
        long_ = F.col("n_bytes") >= LEAST
        more = more.select("doc_id", "n_bytes", F.when(long_, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"), F.when(long_, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"), F.when(long_, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"), "copies")
        out = out.unionByName(more)
    return out.drop("copies")


def cut_out(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal runs removed."""
    kept, done, spans, removed = [], 0, 0, 0
    for lo, hi in sorted(ranges):
        if lo > done or not spans:
            kept.append(raw[done:lo])
            spans += 1
            removed += hi - lo
        elif hi > done:
            removed += hi - done
        done = max(done, hi)
    return b"".join([*kept, raw[done:]]), removed, spans


def _applied(joined: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                left, removed, spans = cut_out(text.encode(), [(x["lo"], x["hi"]) for x in ranges])
                rows.append((removed, spans, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["r", "d", "n_removed", "n_spans", "kept"])

    # doc_id goes along so that both joins with the texts read the same shuffle
    return joined.mapInArrow(run, "r long, d long, n_removed long, n_spans long, kept string")
