"""Language-model scoring with a probabilistic suffix tree over tokens, beside a smoothed unigram model.

Base: tokens are runs of anything but white space (A-Z lower-cased) and one end per document, each
scored by log10((c + 0.1) / (N + 0.1 (V + 1))) with counts over all training documents.

Model: a probabilistic suffix tree whose symbols are the tokens; a mark before each text counts as
its oldest token. Its root is the base model. A context of d tokens that occurs ``least`` times or
more is tested if its newest d - 1 tokens are a state and its oldest d - 1 were tested; depth has no
bound. T is how often it occurs, n how often a token follows it, p(x) a successor's probability in
the parent. Successors that follow more than ``discount`` times, occur ``least`` times at all and differ
from the parent by n ln((n - discount) / (T p(x))) of ``odds`` nats or more are held, and D is T less what
they follow beyond the discount. The distribution is smoothed towards the parent's p (that of the newest d - 1 tokens) by

    p(x | context) = ((n - discount, if x is held) + D p(x)) / T

which adds up to one. The context is retained if the divergence from its parent, times T, is ``gain``
nats or more; it is estimated by leaving each occurrence out in turn, so that chance alone never
retains one. A token is scored in the state of the longest suffix of its history.

Scoring adds up: each state on the way to the longest one adds log10(D / T), and a held successor
the rest of log10(its probability / its parent's). So the model is a table of keys with what they add.
``least`` doesn't rise with the corpus: the states grow with it in number and in depth.

The most frequent keys are sent to all tasks, ``common`` at most, and so are those of the most frequent
tokens; the others are joined, a slice of the keys after another, where a filter of bounded size says that a key may be in the table.

Counting takes a pass over the training texts for the tokens, one for contexts of one token, one for those of
2, one for those of 3, one for those of 4 to 7, of 8 to 15 and so on, until no context is tested or none of a depth is retained (of the longer ones of a pass only
those come that have no untested part as long as its shortest). Tokens, contexts and keys are told apart by
64-bit hashes; while pairs are counted the most frequent ones, ``SENT`` at most, have numbers. Tables that
nothing reads any more are removed.

Edge cases: null text is empty and has its end token alone; without training documents every count is
0; a null doc_id is training; repeated rows count as often as they occur and are scored each; a very
long text is one step of its own; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesbuf import TOKEN, U64, Known, mix, ragged, words
from .shared import dropped, long, per_text, stored, swept, text_slices

#: The hash that stands for the end token, and that of the mark before a text.
END_TOKEN, START = 0x454E44, 0x53544152
#: Places held until their distinct pairs are handed on; places a part of the pairs comes from; rows of
#: a table that is sent to all tasks at most; slices, a power of two, in which the keys that weren't sent are joined.
HELD, PART, SENT, SLICES = 600_000, 500_000, 500_000, 4
_ODD = U64(0xD6E8FEB86659FD93)
_STATE, _ENTRY = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_WORD = (1 << 64) - 1


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def state_key(ctx: np.ndarray, depth: int) -> np.ndarray:
    return mix(ctx + U64(depth * _STATE & _WORD))


def entry_key(ctx: np.ndarray, nxt: np.ndarray, depth: int) -> np.ndarray:
    return mix(ctx * _ODD + nxt + U64(depth * _ENTRY & _WORD))


class Places:
    """The places of a slice's tokens, with their contexts, which grow by one token at a time.

    The context t1 ... td, td the newest, has the number td + td-1 * ODD + td-2 * ODD**2 ...
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        _, _, _, hashes, first = words(data, offsets, TOKEN)
        n = np.diff(first)
        at = np.concatenate([[0], np.cumsum(n + 2)])
        self.sym = np.empty(at[-1], U64)
        self.sym[at[:-1]], self.sym[at[1:] - 1] = START, END_TOKEN
        self.sym[ragged(at[:-1] + 1, n)] = hashes
        place = np.arange(at[-1]) - np.repeat(at[:-1], n + 2)
        self.pos = np.flatnonzero(place > 0)
        self.room = place[self.pos]
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        self.ctx = np.zeros(len(self.pos), U64)
        self.depth = 0

    def nxt(self) -> np.ndarray:
        return self.sym[self.pos]

    def keep(self, which: np.ndarray) -> None:
        self.pos, self.room, self.doc, self.ctx = self.pos[which], self.room[which], self.doc[which], self.ctx[which]

    def longer(self) -> None:
        """Places without so long a past are left out."""
        self.keep(self.room > self.depth)
        power = U64(pow(int(_ODD), self.depth, 1 << 64))
        self.depth += 1
        self.ctx = self.ctx + self.sym[self.pos - self.depth] * power


class Filter:
    """Two bits of a word for the top bits of each key: false says that a key isn't there."""

    def __init__(self, bits: int, at: np.ndarray, masks: np.ndarray):
        self.shift, self.second = U64(64 - bits), U64(58 - bits)
        self.words = np.zeros(1 << (bits - 6), U64)
        self.words[at] = masks.view(U64)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        i = keys >> self.shift
        word = self.words[(i >> U64(6)).astype(np.int64)]
        return (word >> (i & U64(63)) & word >> (keys >> self.second & U64(63)) & U64(1)).astype(bool)


def filtered(keys: DataFrame, n: int) -> Filter:
    """Over the column ``key``; 2**28 bits at most (beyond that more keys pass that aren't there)."""
    bits = min(28, max(16, (n << 5).bit_length()))
    i, j = F.shiftrightunsigned("key", 64 - bits), F.shiftrightunsigned("key", 58 - bits)
    one, two = (F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int")) for x in (i, j))
    got = keys.select(F.shiftright(i, 6).alias("w"), one.bitwiseOR(two).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    return Filter(bits, got["w"].to_numpy(), got["m"].to_numpy())


def _token_counts(batches):
    """Rows (token, n): each distinct token once for every ``HELD`` tokens or so, and ends."""
    held, rows, ends = [], 0, 0

    def counted():
        u, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.append(u.view(np.int64), END_TOKEN)), pa.array(np.append(n, ends))], names=["token", "n"])

    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(0)):
            _, _, _, hashes, _ = words(data, offsets, TOKEN)
            held.append(hashes)
            rows, ends = rows + len(hashes), ends + hi - lo
            if rows >= HELD:
                yield counted()
                held, rows, ends = [], 0, 0
    if held:
        yield counted()


def counted_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(token, n)"""
    return docs.select(text).mapInArrow(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Numbers:
    """Numbers of the most frequent hashes, the most frequent first: smaller on disk than the hashes."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        self.known, self.n = Known(hashes[order], order, ordered=True), len(hashes)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where a hash has none."""
        at = self.known.find(hashes)
        out = np.full(len(at), -1, np.int64)
        out[at >= 0] = self.known.values[at[at >= 0]]
        return out


def _most_frequent_first(table: DataFrame, n: int) -> np.ndarray:
    """The column ``key`` of (key, n), ``SENT`` rows at most."""
    got = (table.where(_most_frequent(table, SENT)) if n > SENT else table).toArrow()
    keys = got["key"].to_numpy().view(U64)
    return keys[np.lexsort((keys, -got["n"].to_numpy()))]


def _squeezed(columns: list[np.ndarray]) -> bytes:
    """Columns with their first, second, ... bytes side by side, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in columns), codec="zstd", asbytes=True)


def _spread(data: bytes, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    """Inverse of ``_squeezed``, from the columns' kinds and lengths."""
    sizes = [np.dtype(kind).itemsize * n for kind, n in kinds]
    body, at, out = np.frombuffer(pa.decompress(data, sum(sizes), codec="zstd", asbytes=True), np.uint8), 0, []
    for (kind, n), size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(body[at : at + size].reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += size
    return out


def _steps(x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Differences from the value before, the value itself where ``fresh``."""
    out = np.diff(x, prepend=0)
    out[fresh] = x[fresh]
    return out.astype(np.uint32)


def _summed_steps(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Inverse of ``_steps`` over groups of these sizes."""
    sums = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    return sums - np.repeat(sums[first] - steps[first], sizes)


def _packed(depth: int, held: list[tuple[np.ndarray, ...]], parts: int, contexts: Numbers, tokens: Numbers):
    """Rows (depth, part, data) from (context, successor, part's salt) of places: each distinct pair
    once, sorted by context. Pairs whose context and successor have numbers are written by steps of these, the others by hashes."""
    ctx, nxt, salt = (np.concatenate(x) for x in zip(*held, strict=True))
    _, at, n = np.unique(ctx * _ODD + nxt, return_index=True, return_counts=True)
    ctx, nxt, n = ctx[at], nxt[at], n.astype(np.uint32)
    part = (mix(ctx + salt[at]) % U64(parts)).astype(np.int64)
    c, t = contexts.of(ctx), tokens.of(nxt)
    where, data = [], []
    for numbered in (True, False):
        which = np.flatnonzero(((c >= 0) & (t >= 0)) == numbered)
        if not len(which):
            continue
        which = which[np.argsort((part[which] * contexts.n + c[which]) * tokens.n + t[which]) if numbered else np.lexsort((ctx[which], part[which]))]
        at, one, other, times = part[which], (c if numbered else ctx)[which], (t if numbered else nxt)[which], n[which]
        fresh = np.concatenate([[True], at[1:] != at[:-1]])
        edge = np.append(np.flatnonzero(fresh), len(at))
        head = fresh | np.concatenate([[True], one[1:] != one[:-1]])
        if numbered:
            one, other = _steps(one, fresh), _steps(other, head)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            first = np.flatnonzero(head[lo:hi])
            sizes = np.diff(np.append(first, hi - lo)).astype(np.uint32)
            data.append(np.array([numbered, len(first), hi - lo]).tobytes() + _squeezed([one[lo:hi][first], sizes, other[lo:hi], times[lo:hi]]))
        where.append(at[edge[:-1]])
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), depth, np.int32)), pa.array(np.concatenate(where)), pa.array(data, pa.binary())], names=["depth", "part", "data"])


def _unpacked(data: bytes, contexts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    numbered, k, m = np.frombuffer(data, np.int64, 3).tolist()
    kind = np.uint32 if numbered else U64
    one, sizes, other, n = _spread(data[24:], [(kind, k), (np.uint32, k), (kind, m), (np.uint32, m)])
    if numbered:
        one, other = contexts[np.cumsum(one, dtype=np.int64)], tokens[_summed_steps(other, sizes)]
    return np.repeat(one, sizes), other, n


def _summed(discount: int, names: Broadcast):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of one part that occur more than ``discount`` times."""
        ctx, nxt, n = (np.concatenate(x) for x in zip(*[_unpacked(x, *names.value) for x in table["data"].to_pylist()], strict=True))
        order = np.lexsort((nxt, ctx))
        ctx, nxt, n = ctx[order], nxt[order], n[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (nxt[1:] != nxt[:-1])]))
        n = np.add.reduceat(n, head)
        head, n = head[n > discount], n[n > discount]
        depth = np.full(len(n), table["depth"][0].as_py(), np.int32)
        return pa.table([pa.array(depth), *[pa.array(x[head].view(np.int64)) for x in (ctx, nxt)], pa.array(n)], names=["depth", "ctx", "nxt", "n"])

    return run


def _counted(docs: DataFrame, text: str, depth: int, deepest: int, shared: Broadcast, names: Broadcast, parts: int, discount: int) -> DataFrame:
    """(depth, ctx, nxt, n): what follows contexts of ``depth`` tokens that pass the filter more than
    ``discount`` times; and what follows longer ones, up to ``deepest``, all of whose parts of ``depth`` tokens pass.

    Pairs go to a part by their context, those of the most frequent contexts by their successor too.
    """

    def run(batches):
        vocabulary, tested, hot = shared.value
        numbers = [Numbers(x) for x in names.value]
        held: dict[int, list] = {d: [] for d in range(depth, deepest + 1)}
        rows = dict.fromkeys(held, 0)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                places = Places(data, offsets)
                for _ in range(depth):
                    places.longer()
                passed = np.zeros(len(places.sym), bool)
                passed[places.pos] = tested.maybe(state_key(places.ctx, depth))
                places.keep(passed[places.pos])
                places.keep(vocabulary.maybe(places.nxt()))
                salt = np.zeros(len(places.sym), U64)
                salt[places.pos] = np.where(hot.find(places.ctx) >= 0, places.nxt(), U64(0))
                while len(places.pos):
                    d = places.depth
                    held[d].append((places.ctx, places.nxt(), salt[places.pos]))
                    rows[d] += len(places.pos)
                    most = max(rows, key=rows.get)
                    if rows[most] >= HELD or sum(rows.values()) >= 2 * HELD:
                        yield from _packed(most, held[most], parts, *numbers)
                        held[most], rows[most] = [], 0
                    if d == deepest:
                        break
                    places.longer()
                    places.keep(passed[places.pos - (places.depth - depth)])
        for d, some in held.items():
            if some:
                yield from _packed(d, some, parts, *numbers)

    packed = docs.select(text).mapInArrow(run, "depth int, part long, data binary")
    return packed.groupBy("depth", "part").applyInArrow(_summed(discount, names), "depth int, ctx long, nxt long, n long")


def _sent(df: DataFrame, n: int) -> DataFrame:
    """A side of a join, sent to all tasks where it is known to be small."""
    return F.broadcast(df) if n <= SENT else df


def _keyed(df: DataFrame, depth: int, kind: str) -> DataFrame:
    """``key`` beside the columns: of a state, or of a context's successor (kinds state and entry)."""

    def run(batches):
        for batch in batches:
            ctx = batch.column("ctx").to_numpy().view(U64)
            key = state_key(ctx, depth) if kind == "state" else entry_key(ctx, batch.column("nxt").to_numpy().view(U64), depth)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], names=[*batch.schema.names, "key"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, long("key")]))


def _grown(pairs: DataFrame) -> DataFrame:
    """Contexts longer by their successor, as (ctx, up, all): ``up`` is without the oldest token."""

    def run(batches):
        for batch in batches:
            nxt = batch.column("nxt").to_numpy().view(U64)
            ctx, up = (batch.column(c).to_numpy().view(U64) * _ODD + nxt for c in ("ctx", "up"))
            yield pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array(up.view(np.int64)), batch.column("n")], names=["ctx", "up", "all"])

    return pairs.select("ctx", "up", "nxt", "n").mapInArrow(run, "ctx long, up long, all long")


def tree(train: DataFrame, tokens: DataFrame, total: int, distinct: int, *, text: str, least: int, gain: float, deepest: int | None, discount: int, odds: float) -> tuple[DataFrame, int, int]:
    """(key, value, n): what a key adds to a score and how often it is met; the tree's depth,
    and its states."""
    spark = train.sparkSession
    often = tokens.where(F.col("n") >= least)
    n_often = often.count()
    vocabulary = filtered(often.select(F.col("token").alias("key")), n_often)
    parents, n_parents = often.select(F.lit(0).cast("long").alias("up"), F.col("token").alias("nxt"), ((F.col("n") + 0.1) / (total + 0.1 * (distinct + 1))).alias("p")), n_often
    mark = F.when(F.col("token") == END_TOKEN, F.lit(START)).otherwise(F.col("token"))  # as many texts begin as end
    tested, n_tested = often.select(mark.alias("ctx"), F.lit(0).cast("long").alias("up"), F.col("n").alias("all")), n_often
    names = _most_frequent_first(often.select(F.col("token").alias("key"), "n"), n_often)
    out, depth, counted, n_states, counts = spark.createDataFrame([], "key long, value double, n long"), 0, 0, 0, None
    while n_tested and depth != deepest:
        depth += 1
        if depth > counted:  # several depths at once where contexts are few
            counted = depth if depth < 4 else 2 * depth - 1
            counted = counted if deepest is None else min(counted, deepest)
            hot = tested.where(F.col("all") > total / 1000).toArrow()["ctx"].to_numpy().view(U64)  # a few thousand at most
            shared = spark.sparkContext.broadcast((vocabulary, filtered(_keyed(tested.select("ctx"), depth, "state"), n_tested), Known(hot, hot)))
            numbered = spark.sparkContext.broadcast((_most_frequent_first(tested.select(F.col("ctx").alias("key"), F.col("all").alias("n")), n_tested), names))
            counts = stored(_counted(train, text, depth, counted, shared, numbered, max(1, total // PART), discount))
            for sent in (shared, numbered):
                sent.destroy()  # else executors hold it until the driver happens to collect its garbage
        pairs = counts.where(F.col("depth") == depth).drop("depth")
        pairs = pairs.join(_sent(tested, n_tested), "ctx").join(_sent(parents, n_parents), ["up", "nxt"])
        pairs = stored(pairs.withColumn("held", F.col("n") * F.log((F.col("n") - discount) / (F.col("all") * F.col("p"))) >= odds))
        if depth > 1:
            dropped(parents, tested)
        if depth == counted:
            dropped(counts)
        n, d, p, every, is_held = F.col("n"), F.col("d"), F.col("p"), F.col("all"), F.col("held")
        held = pairs.where(is_held).groupBy("ctx", "all").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
        held = held.select("ctx", (F.col("k") * discount + F.col("all") - F.col("m")).alias("d"), "m")
        apart = n * (F.log(n - discount - 1 + d * p) - F.log(p) - F.log(every - 1))
        once = F.when(every > F.col("m"), (every - F.col("m")) * F.log((d - 1) / (every - 1))).otherwise(0.0)
        gained = pairs.where(is_held).join(_sent(held, n_tested), "ctx").groupBy("ctx", "all", "d", "m").agg(F.sum(apart).alias("apart")).where(F.col("apart") + once >= gain)
        states = stored(_keyed(gained.select("ctx", "all", "d", F.log10(d / every).alias("value")), depth, "state"))
        found = states.count()
        if not found:
            dropped(pairs)
            break
        n_states += found
        own = pairs.join(_sent(states.select("ctx", "d"), found), "ctx")
        own = own.withColumn("q", (F.when(is_held, n - discount).otherwise(0) + d * p) / every)
        own = stored(own.select("ctx", "nxt", F.when(is_held, n).alias("n"), F.col("q").alias("p"), F.when(is_held, F.log10(F.col("q") / p) - F.log10(d / every)).alias("value")))
        entries = stored(_keyed(own.where("n is not null").select("ctx", "nxt", "value", "n"), depth, "entry").select("key", "value", "n"))
        out = out.union(states.select("key", "value", every.alias("n"))).union(entries)
        if depth != deepest:
            parents, n_parents = own.select(F.col("ctx").alias("up"), "nxt", "p"), own.count()
            grown = _grown(pairs.where((n >= least) & (F.col("nxt") != END_TOKEN)))
            tested = stored(grown.join(_sent(states.select(F.col("ctx").alias("up")), found), "up", "left_semi").select("ctx", "up", "all"))
            n_tested = tested.count()
        dropped(pairs)
    if depth < counted:
        dropped(counts)
    if n_states:
        dropped(own)
    return out, depth, n_states


def _most_frequent(table: DataFrame, common: int):
    """A condition on ``n`` that ``common`` rows at most meet: whole eighths of octaves."""
    octave = F.floor(F.log2("n") * 8).cast("int")  # a few hundred values at most
    places, held = table.groupBy(octave.alias("b")).count().collect(), 0
    floor = max((r.b for r in places), default=0) + 1
    for r in sorted(places, key=lambda r: -r.b):
        held += r["count"]
        if held > common:
            break
        floor = r.b
    return octave >= floor


def _ordered(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


class Scorer:
    """Sums per document from the keys that were sent, and the keys to be looked up elsewhere."""

    def __init__(self, tokens: Known, values: Known, rare: Filter, depth: int):
        self.tokens, self.values, self.rare, self.depth = tokens, values, rare, depth

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list:
        places, docs = Places(data, offsets), len(offsets) - 1
        doc, token = places.doc, places.nxt()
        n_tokens = np.bincount(doc, minlength=docs)
        at = self.tokens.find(token)
        known = at >= 0
        base = np.bincount(doc[known], self.tokens.values[at[known]], docs)
        n_known = np.bincount(doc[known], minlength=docs)
        away = [(doc[~known], token[~known])]
        more = np.zeros(docs)

        def add(keys: np.ndarray) -> np.ndarray:
            nonlocal more
            at = self.values.find(keys)
            known = at >= 0
            more += np.bincount(places.doc[known], self.values.values[at[known]], docs)
            left = np.flatnonzero(~known)
            left = left[self.rare.maybe(keys[left])]
            away.append((places.doc[left], keys[left]))
            known[left] = True
            return known

        while places.depth < self.depth and len(places.pos):
            places.longer()
            places.keep(add(state_key(places.ctx, places.depth)))
            add(entry_key(places.ctx, places.nxt(), places.depth))
        d, t = (np.concatenate(x) for x in zip(*away, strict=True))
        order = np.lexsort((t, d))
        d, t = d[order], t[order].view(np.int64)
        head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])) if len(t) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(t)))
        ends = np.concatenate([[0], np.cumsum(np.bincount(d[head], minlength=docs))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(t[head]), pa.array(times.astype(np.int64))], names=["key", "times"]))
        return [n_tokens, n_known, base, more, lists]


def score(docs: DataFrame, is_held, *, key: str = "doc_id", text: str = "text", floor: int = 30, gain: float = 10.0, odds: float = 5.0, deepest: int | None = None, discount: int = 2, common: int = 2_000_000) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_states."""
    spark = docs.sparkSession
    train = docs.where(~is_held)
    with swept(spark):
        tokens = stored(counted_tokens(train, text))
        total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        values, depth, n_states = tree(train, tokens, total, distinct, text=text, least=floor, gain=gain, deepest=deepest, discount=discount, odds=odds)
    weight = F.log10(F.col("n") + 0.1) + 1  # over that of an unknown token
    sent, sent_tokens = _most_frequent(values, common), _most_frequent(tokens, common // 4)
    rare = values.where(~sent)
    some, some_tokens = values.where(sent).select("key", "value").toArrow(), tokens.where(sent_tokens).select("token", weight.alias("value")).toArrow()
    arrays = [_ordered(t[c].to_numpy().view(U64), t["value"].to_numpy()) for t, c in ((some_tokens, "token"), (some, "key"))]
    del some, some_tokens
    with swept(spark):
        shared = spark.sparkContext.broadcast((*arrays, filtered(rare, rare.count())))
    del arrays  # the driver has little room for the plans that follow
    pa.default_memory_pool().release_unused()
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    fields = [long("n_tokens"), long("n_known"), T.StructField("base", T.DoubleType()), T.StructField("more", T.DoubleType()), T.StructField("away", T.ArrayType(T.StructType([long("key"), long("times")])))]

    def make():
        frequent, keys, maybe = shared.value
        return Scorer(Known(*frequent, ordered=True), Known(*keys, ordered=True), maybe, depth)

    made = stored(per_text(docs.withColumn("__held", is_held), text, [key, "__held"], fields, make).withColumnsRenamed({key: "__key"}).withColumn("__row", F.monotonically_increasing_id()))
    shared.destroy()
    zero = F.lit(0.0)
    elsewhere = tokens.where(~sent_tokens).select(F.col("token").alias("key"), weight.alias("w"), F.lit(1).alias("seen"), zero.alias("value")).union(rare.select("key", zero, F.lit(0), "value"))
    sums, slices = [F.sum(F.col("times") * F.col(c)).alias(c) for c in ("w", "seen", "value")], []
    with swept(spark):  # a slice of the keys after another, so that the disk holds the rows of one
        for i in range(SLICES):
            one = F.col("key").bitwiseAND(SLICES - 1) == i
            # a key that wasn't sent is met seldom, so none is hot here
            slices.append(stored(made.select("__row", F.inline("away")).where(one).join(elsewhere.where(one), "key").groupBy("__row").agg(*sums)))
    joined = reduce(DataFrame.union, slices).groupBy("__row").agg(*[F.sum(c).alias(c) for c in ("w", "seen", "value")])
    base = F.col("base") + F.coalesce("w", zero) - F.col("n_tokens") * (1 + norm)
    out = made.drop("away").join(joined, "__row", "left").withColumn("base_score", base)
    return out.select(F.col("__key").alias(key), F.col("__held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("more") + F.coalesce("value", zero)).alias("score"), F.lit(n_states).cast("long").alias("n_states"))
