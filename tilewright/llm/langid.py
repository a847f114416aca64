"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased and mapped to 63 classes: the most frequent letters of the training texts
have one each, and every other letter is given one of the 63 by a hash, so that n-grams of any script
are told apart (as in feature hashing, some fall together); all that is no letter is the boundary class
0. Features are n-grams of one to three classes. A text's TF is an n-gram's share of its positions; document
frequencies are counted over all training documents. Weights are fitted by follow-the-regularised-
leader with elastic-net penalties on a bounded sample of the labelled documents (``per_lang`` for
each language), and a temperature is then fitted on a fifth of that sample, kept apart.

Edge cases: a text that is null or without letters is ``und`` with score 0; with no labelled
document everything is ``und``; null languages train nothing; repeated rows count as often as they
occur; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import keep_rows, per_text, string, text_slices

CLASSES = 64
GRAMS = CLASSES**3
SIZE = GRAMS + CLASSES**2 + CLASSES
UND = "und"
_POINTS = 0x110000

_folded: dict[str, np.ndarray] = {}


def _fold() -> np.ndarray:
    """Code point to its lower-case letter, 0 for what is no letter."""
    if not _folded:
        table = np.zeros(_POINTS, np.uint32)
        for cp in range(_POINTS):
            c = chr(cp)
            if c.isalpha():
                table[cp] = ord(c.lower()[0])
        _folded["t"] = table
    return _folded["t"]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters (0: none) of all documents in a row, and offsets in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return _fold()[points], heads[offsets]


@dataclass
class Model:
    alphabet: np.ndarray  # folded letter to class
    langs: list[str]
    weights: np.ndarray  # (languages, GRAMS): what a position adds, all its n-grams together
    bias: np.ndarray
    temperature: float


def classes(folded: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    return alphabet[folded]


def trigrams(cls: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the class trigram that ends at each position, with boundary before a text; runs of
    boundary classes are one. Returns codes and offsets."""
    keep = np.ones(len(cls), bool)
    if len(cls):
        keep[1:] = (cls[1:] != 0) | (cls[:-1] != 0)
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        keep[starts] = True
    where = np.concatenate([[0], np.cumsum(keep)])
    offsets = where[offsets]
    c = cls[keep].astype(np.int32)
    one, two = np.zeros(len(c), np.int32), np.zeros(len(c), np.int32)
    one[1:], two[2:] = c[:-1], c[:-2]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    one[starts] = two[starts] = 0
    after = starts + 1
    two[after[after < len(c)]] = 0
    return (two * CLASSES + one) * CLASSES + c, offsets


def _alphabet(docs: DataFrame, text: str) -> np.ndarray:
    """Classes 1-63 for the most frequent letters (ties: smaller code point), one by a hash for the others."""

    def run(batches):
        total = np.zeros(_POINTS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                folded, _ = letters(data, offsets)
                total += np.bincount(folded, minlength=_POINTS)
        total[0] = 0
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["letter", "n"])

    counts = docs.select(text).mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "letter").limit(CLASSES - 1).collect()
    alphabet = ((np.arange(_POINTS, dtype=np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(CLASSES - 1) + np.uint32(1)).astype(np.uint8)
    alphabet[0] = 0
    for k, r in enumerate(top, 1):
        alphabet[r.letter] = k
    return alphabet


def _gathered(docs: DataFrame, text: str, alphabet: np.ndarray) -> DataFrame:
    """Rows (lang, key, code, n): without key, in how many documents an n-gram occurs; with key, how
    often it occurs in a document of the sample. One pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(alphabet)

    def run(batches):
        df = np.zeros(SIZE + 1, np.int64)
        names = ["lang", "key", "code", "n"]
        for batch in batches:
            sample, langs, keys = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for lo, hi, data, offsets in text_slices(batch.column(0)):
                folded, at = letters(data, offsets)
                codes, at = trigrams(shared.value[folded], at)
                df[SIZE] += hi - lo
                for d in range(hi - lo):
                    mine = codes[at[d] : at[d + 1]]
                    if sample[lo + d]:
                        u, n = np.unique(mine, return_counts=True)
                        f, x = _orders(u, n)
                        df[f] += 1
                        k = len(f)
                        yield pa.RecordBatch.from_arrays([pa.array([langs[lo + d]] * k, pa.string()), pa.array(np.full(k, keys[lo + d])), pa.array(f.astype(np.int64)), pa.array(x.astype(np.int64))], names=names)
                    else:
                        u = np.unique(mine)
                        df[u] += 1
                        df[GRAMS + np.unique(u % CLASSES**2)] += 1
                        df[GRAMS + CLASSES**2 + np.unique(u % CLASSES)] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.string()), pa.nulls(len(seen), pa.int64()), pa.array(seen), pa.array(df[seen])], names=names)

    return docs.select(text, "__sample", "__lang", "__key").mapInArrow(run, "lang string, key long, code long, n long")


def _orders(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of one text: trigrams, then bigrams (offset GRAMS), then single classes."""
    two, n2 = np.unique(codes % CLASSES**2, return_inverse=True)
    one, n1 = np.unique(codes % CLASSES, return_inverse=True)
    return np.concatenate([codes, GRAMS + two, GRAMS + CLASSES**2 + one]), np.concatenate([counts, np.bincount(n2, counts, len(two)), np.bincount(n1, counts, len(one))])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, size: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for multinomial logistic loss; weights whose |z| stays within l1 are exactly 0."""
    z, n = np.zeros((size + 1, n_labels)), np.zeros((size + 1, n_labels))

    def weights(f):
        held = z[f]
        w = -(held - np.sign(held) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2)
        return np.where(np.abs(held) <= l1, 0.0, w)

    order = np.arange(len(rows))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            f, x = rows[k]
            f, x = np.append(f, size), np.append(x, 1.0)
            w = weights(f)
            g = softmax(x @ w)
            g[labels[k]] -= 1
            g = x[:, None] * g
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 300, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.5, epochs: int = 4) -> Model:
    """Fit on the rows of ``train`` whose language isn't null. ``per_lang`` bounds the fitted sample
    (the first by a hash of the key); alphabet and document frequencies cover every row."""
    train = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("__text"), F.col(lang).alias("__lang"), F.col(key).cast("long").alias("__key"))
    alphabet = _alphabet(train, "__text")
    by = Window.partitionBy("__lang").orderBy(F.xxhash64("__key"), "__key")
    chosen = train.select("__lang", "__key").where(F.col("__key").isNotNull()).withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= per_lang)
    chosen = chosen.select("__key", "__lang").distinct().withColumn("__sample", F.lit(True))
    marked = train.join(F.broadcast(chosen), ["__key", "__lang"], "left").withColumn("__sample", F.coalesce("__sample", F.lit(False)))
    summed = _gathered(marked, "__text", alphabet).groupBy("lang", "key", "code").agg(F.sum("n").alias("n")).toArrow()
    of_doc = summed["key"].is_valid().to_numpy()
    code, n = (summed[c].to_numpy() for c in ("code", "n"))
    df = np.zeros(SIZE + 1)
    df[code[~of_doc]] = n[~of_doc]
    idf = np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1
    picked = summed.filter(pa.array(of_doc)).sort_by([("key", "ascending"), ("lang", "ascending"), ("code", "ascending")])
    if not len(picked):
        return Model(alphabet, [], np.zeros((0, GRAMS)), np.zeros(0), 1.0)
    named = picked["lang"].combine_chunks().dictionary_encode()
    name = named.indices.to_numpy()
    key, code, n = (picked[c].to_numpy() for c in ("key", "code", "n"))
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])]))
    spelled = named.dictionary.to_pylist()
    langs = sorted(spelled)
    labels = np.array([langs.index(x) for x in spelled])[name[heads]]
    rows = []
    for a, b in zip(heads, [*heads[1:], len(key)], strict=True):
        x = n[a:b].astype(float)
        rows.append((code[a:b].astype(np.int32), x / x[code[a:b] < GRAMS].sum() * idf[code[a:b]] * SCALE))
    del summed, picked, named, key, code, n, of_doc, name
    pa.default_memory_pool().release_unused()  # the driver goes on to other work
    held = np.array([k % 5 == 4 for k in range(len(rows))]) & (len(rows) >= 5 * len(langs))
    fitted = [k for k in range(len(rows)) if not held[k]]
    w, b = ftrl([rows[k] for k in fitted], labels[fitted], len(langs), SIZE, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    apart = np.flatnonzero(held)
    logits = np.array([rows[k][1] @ w[rows[k][0]] + b for k in apart]) if len(apart) else np.zeros((0, len(langs)))
    w = (w * idf[:, None] * SCALE).T
    codes = np.arange(GRAMS)
    whole = w[:, :GRAMS] + w[:, GRAMS + codes % CLASSES**2] + w[:, GRAMS + CLASSES**2 + codes % CLASSES]
    return Model(alphabet, langs, np.ascontiguousarray(whole), b, calibrate(logits, labels[apart]))


#: Shares of positions are small numbers; this brings a text's features to the order of 1.
SCALE = 10.0


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the best language's place (-1: und) and its calibrated probability."""
    folded, at = letters(data, offsets)
    n = len(at) - 1
    best, score = np.full(n, -1), np.zeros(n)
    seen = np.concatenate([[0], np.cumsum(folded != 0)])
    known = seen[at[1:]] > seen[at[:-1]]
    if model.langs and known.any():
        codes, at = trigrams(model.alphabet[folded], at)
        full = np.flatnonzero(at[1:] > at[:-1])
        sums = np.stack([np.add.reduceat(w[codes], at[full]) for w in model.weights], axis=1)
        p = softmax((sums / np.diff(at)[full, None] + model.bias) / model.temperature)
        best[full], score[full] = p.argmax(1), p.max(1)
        best[~known], score[~known] = -1, 0.0
    return best, score


def predict(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        names = np.array([*model.langs, UND], object)

        def kernel(data, offsets):
            best, score = scores(model, data, offsets)
            return [pa.array(names[best], pa.string()), score]

        return kernel

    return per_text(docs, text, keep, [string("lang_pred"), T.StructField("score", T.DoubleType())], make)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def accepted(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, columns as they are, that are in one of the learned languages with calibrated
    probability ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def kernel(data, offsets):
            best, score = scores(shared.value, data, offsets)
            return (best >= 0) & (score >= least)

        return kernel

    return keep_rows(docs, text, make)
