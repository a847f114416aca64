"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``size`` consecutive words of a benchmark item (a shorter item is one
window). The text is read as a sequence of words. A shift table over blocks of two words tells how
far the search may jump; where a block ends some pattern (shift 0) its bucket lists the patterns to
compare, chosen by their first block and then held against the bytes themselves.

The tables are arrays, about twelve bytes for each byte of benchmark text, made once and sent to all
tasks. A benchmark of more than ``PART_BYTES`` takes several passes, one table at a time; the rows are
then numbered first, so results are the same.

Edge cases: null or empty text has no words and is never hit; null items and items without words
have no window; a very long text is one step of its own; repeated items count once by ``item_id``; items whose id is null still hit, but are
not listed; a document column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesbuf import U64, Known, mix, ragged, words
from .shared import keep_rows, long, per_text, stored

_PAIR = U64(0x9FB21C651E98DF25)
#: Bytes of benchmark text searched for in one pass; a larger benchmark takes several passes.
PART_BYTES = 8 << 20


def _paired(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * _PAIR + hashes[1:])


class WuManber:
    """Tables for windows of one length, in words; windows alike are one."""

    def __init__(self, m: int, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray, owner: np.ndarray):
        self.m, self.low, self.starts, self.ends = m, low, starts, ends
        self.block = min(2, m)
        self.n = m - self.block + 1  # blocks of a window
        a, b = np.zeros(len(first), U64), np.zeros(len(first), U64)
        for k in range(m):
            a, b = a * _PAIR + hashes[first + k], mix(b + hashes[first + k])
        order = np.lexsort((owner, b, a))
        a, b, first, owner = a[order], b[order], first[order], owner[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        again = np.concatenate([[False], (owner[1:] == owner[:-1]) & ~new[1:]])
        window = np.cumsum(new) - 1
        self.owners, window, first = owner[~again], window[~again], first[new]
        self.at = np.searchsorted(window, np.arange(len(first) + 1))
        blocks = self.blocks(hashes)
        keys, away = np.zeros(0, U64), np.zeros(0, np.uint8)
        for back in range(self.n):  # a block's shift is its least distance from the end of a window
            more = np.setdiff1d(blocks[first + self.n - 1 - back], keys)
            keys, away = np.concatenate([keys, more]), np.concatenate([away, np.full(len(more), back, np.uint8)])
        self.shift = Known(keys, away)
        # a bucket holds the windows of one last block; within it they are found by their first one
        self.bucket = Known(_both(blocks[first + self.n - 1], blocks[first]), np.arange(len(first), dtype=np.int32))
        self.first = first

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        return hashes if self.block == 1 else _paired(hashes)

    def raw(self, window: int) -> bytes:
        return _joined(self.low, self.starts, self.ends, self.first[window], self.m)

    def search(self, low, starts, ends, hashes, bounds):
        """Yield (document, first word, items' places) for occurrences; ``bounds``: the documents' first words."""
        if len(hashes) < self.m:
            return
        blocks = self.blocks(hashes)
        place = self.shift.find(blocks)
        steps = np.where(place >= 0, self.shift.values[place], self.n).astype(np.int64)
        stops = np.flatnonzero(steps == 0)
        stops = stops[stops >= self.n - 1]
        found = np.full(len(blocks), -1, np.int32)
        found[stops] = self.bucket.find(_both(blocks[stops], blocks[stops - self.n + 1]))
        docs = np.unique(np.searchsorted(bounds, stops[found[stops] >= 0], "right") - 1)
        for d in docs.tolist():
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            step, place = steps[lo:hi].tolist(), found[lo:hi].tolist()
            pos, stop = self.n - 1, hi - lo - self.block + 1
            while pos < stop:
                if step[pos]:
                    pos += step[pos]
                    continue
                j = place[pos]
                if j >= 0:
                    first = lo + pos - self.n + 1
                    here, key = _joined(low, starts, ends, first, self.m), self.bucket.keys[j]
                    while j < len(self.bucket.keys) and self.bucket.keys[j] == key:
                        window = self.bucket.values[j]
                        if self.raw(window) == here:
                            yield d, first, self.owners[self.at[window] : self.at[window + 1]]
                        j += 1
                pos += 1


def _both(last: np.ndarray, head: np.ndarray) -> np.ndarray:
    return mix(last + head * _PAIR)


def _joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, m: int) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(starts[first : first + m].tolist(), ends[first : first + m].tolist(), strict=True))


class Searcher:
    """The windows of some items: ``size`` words, or all words of a shorter item."""

    def __init__(self, items: list[tuple[object, str]], size: int):
        self.ids = [None if item is None else str(item) for item, _ in items]
        raw = [text.encode() for _, text in items]
        low, starts, ends, hashes, first = words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]))
        n = np.diff(first)
        length = np.minimum(n, size)
        self.tables = []
        for m in np.unique(length[length > 0]).tolist():
            mine = np.flatnonzero(length == m)
            count = n[mine] - m + 1
            self.tables.append(WuManber(m, low, starts, ends, hashes, ragged(first[mine], count), np.repeat(mine, count)))

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Each document's first word (one more at the end), hit words as a mask, ids found by document
        (None for those without)."""
        low, starts, ends, hashes, first = words(data, offsets)
        hit = np.zeros(len(starts) + 1, np.int32)
        items: dict[int, set] = {}
        for table in self.tables:
            for d, i, owners in table.search(low, starts, ends, hashes, first):
                hit[i] += 1
                hit[i + table.m] -= 1
                items.setdefault(d, set()).update(owners.tolist())
        return first, np.cumsum(hit[:-1]) > 0, {d: {self.ids[k] for k in found} for d, found in items.items()}


def _parts(bench: DataFrame, item: str, text: str) -> tuple[int, Iterator[list[tuple[object, str]]]]:
    """How many parts of bounded size the benchmark has, usually one, and the parts; an item is whole."""
    bench = bench.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull()).distinct()
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_BYTES))

    def each():
        for k in range(parts):
            part = bench if parts == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
            yield [(r.item, r.text) for r in part.collect()]

    return parts, each()


def _ids(found: set) -> list[str]:
    return sorted(str(x) for x in found if x is not None)


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SPANS = T.ArrayType(T.StructType([long("start"), long("end")]))


def find(docs: DataFrame, bench: DataFrame, *, size: int = 10, keep: list[str] | None = None, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep`` columns with n_words, spans (hit word ranges, end exclusive) and items (ids as sorted strings)."""
    spark = docs.sparkSession
    fields = [long("n_words"), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    keep = [c for c in keep or [c for c in docs.columns if c != text] if c not in {f.name for f in fields}]
    parts, blocks = _parts(bench, item, item_text)
    if parts > 1:  # every row has a number of its own, fixed before the passes
        docs = stored(docs.select(*keep, F.col(f"`{text}`").alias("__text")).withColumn("__row", F.monotonically_increasing_id()))
    passes = []
    for block in blocks:
        shared = spark.sparkContext.broadcast(Searcher(block, size))

        def make(shared=shared):
            def kernel(data, offsets):
                first, mask, items = shared.value.scan(data, offsets)
                n = np.diff(first)
                rows = range(len(n))
                return [n, [_spans(mask[first[d] : first[d + 1]]) if d in items else [] for d in rows], [_ids(items.get(d, set())) for d in rows]]

            return kernel

        if parts == 1:
            return per_text(docs, text, keep, fields, make)
        passes.append(stored(per_text(docs, "__text", ["__row"], fields, make)))
        shared.destroy()
    tall = passes[0]
    for p in passes[1:]:
        tall = tall.union(p.where(F.size("items") + F.size("spans") > 0))
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast(_SPANS),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    found = tall.groupBy("__row").agg(F.max("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return docs.select(*keep, "__row").join(found, "__row").drop("__row")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find``'s."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame, *, size: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents that hold no window of the benchmark, columns as they are."""
    parts, blocks = _parts(bench, item, "text")
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(Searcher(block, size))

        def make(shared=shared):
            def kernel(data, offsets):
                _, _, items = shared.value.scan(data, offsets)
                keep = np.ones(len(offsets) - 1, bool)
                keep[list(items)] = False
                return keep

            return kernel

        docs = keep_rows(docs, text, make)
        if parts > 1:
            docs = stored(docs)
            shared.destroy()
    return docs
