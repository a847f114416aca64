"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes *marked words*: a space mark is put before the text, each space becomes a mark, and a
word is a run of marks with what follows up to the next mark. No piece of the vocabulary reaches
over such a border (this is checked when it is loaded), so the best segmentation of a text is made
of its words' best segmentations. The distinct words of a slice of texts are sorted; walked in that
order they are the depth-first traversal of their trie, and the forward scores of the prefix that a
word shares with the one before are reused.

The segmentation is the one of greatest total score, as unigram models define it: ties go to the
longer last piece; a character without a piece costs ten below the least score and is written as
its UTF-8 byte pieces.

Edge cases: null and empty texts have no ids; a U+2581 in a text is read as a space, so it
comes back as one; a vocabulary without byte pieces gives its unknown piece instead of bytes.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytesbuf import prefix, ragged, substring_hash
from .shared import long, per_text, string

MARK = "▁"
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
UNKNOWN_PENALTY = 10.0


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message; 32-bit values as bytes."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: dict[str, float]
    ids: dict[str, int]
    bytes_: list[int]  # ids of the byte pieces, or none
    unknown: int
    dummy_prefix: bool
    longest: int
    floor: float

    @classmethod
    def parse(cls, raw: bytes) -> Vocabulary:
        pieces, scores, ids, of_byte, unknown, dummy = [], {}, {}, {}, 0, True
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = float(np.frombuffer(v, np.float32)[0])
                    elif k == 3:
                        kind = v
                if kind in (_NORMAL, _USER):
                    scores[piece], ids[piece] = score, len(pieces)
                elif kind == _BYTE:
                    of_byte[int(piece[3:5], 16)] = len(pieces)
                elif kind == _UNKNOWN:
                    unknown = len(pieces)
                pieces.append(piece)
            elif number == 3:
                dummy = bool(dict(_fields(value)).get(3, 1))
        for p in ids:
            if MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} reaches over a word border")
        return cls(pieces, scores, ids, [of_byte[b] for b in range(256)] if len(of_byte) == 256 else [], unknown, dummy, max(map(len, ids), default=1), min(scores.values(), default=0.0) - UNKNOWN_PENALTY)


class Encoder:
    """Best segmentations of sorted distinct words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        #: Every ending of a piece, with the piece's score if it is one itself: a look back from a
        #: position stops where no piece can begin any more.
        self.endings: dict[str, float | None] = {}
        for p in vocabulary.ids:
            for k in range(1, len(p)):
                self.endings.setdefault(p[k:], None)
        self.endings.update(vocabulary.scores)

    def all(self, words: list[str]) -> list[list[int]]:
        """``words`` sorted; what is shared with the word before isn't computed again."""
        endings, floor = self.endings, self.v.floor
        missing = object()
        best, back = [0.0], [0]
        before, out = "", []
        for word in words:
            n, shared = len(word), 0
            top = min(n, len(before))
            if word[:top] == before[:top]:
                shared = top
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for j in range(shared + 1, n + 1):
                start = i = j - 1
                s = endings.get(word[i:j], missing)
                most = best[i] + (floor if s is missing or s is None else s)
                while s is not missing and i:
                    i -= 1
                    s = endings.get(word[i:j], missing)
                    if s is not None and s is not missing and best[i] + s >= most:
                        most, start = best[i] + s, i
                best.append(most)
                back.append(start)
            before = word
            out.append(self.path(word, back))
        return out

    def path(self, word: str, back: list[int]) -> list[int]:
        ids, j = [], len(word)
        while j:
            i = back[j]
            p = self.v.ids.get(word[i:j])
            if p is not None:
                ids.append(p)
            elif self.v.bytes_:
                ids.extend(self.v.bytes_[b] for b in reversed(word[i:j].encode()))
            else:
                ids.append(self.v.unknown)
            j = i
        return ids[::-1]

    def text(self, text: str) -> list[int]:
        """One text, plainly; what ``encode`` gives for each row."""
        words = split(text, self.v.dummy_prefix)
        known = dict(zip(u := sorted(set(words)), self.all(u), strict=True))
        return [i for w in words for i in known[w]]


def split(text: str, dummy_prefix: bool = True) -> list[str]:
    if not text:
        return []
    marked = (MARK if dummy_prefix else "") + text.replace(" ", MARK)
    cuts = [0, *[i for i in range(1, len(marked)) if marked[i] == MARK and marked[i - 1] != MARK], len(marked)]
    return [marked[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Decoder:
    def __init__(self, v: Vocabulary):
        self.raw = [p.replace(MARK, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.bytes_):
            self.raw[i] = bytes([b])
        self.dummy = v.dummy_prefix
        self.size = np.array([len(r) for r in self.raw])
        self.head = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def gives(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the ids of each text decode to its bytes; all texts of a slice at once."""
        size = self.size[ids]
        out = self.flat[ragged(self.head[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        n, skip = np.diff(ends), np.zeros(len(at) - 1, np.int64)
        some = np.flatnonzero(n > 0)
        if self.dummy:
            skip[some] = out[ends[some]] == 32
        same = n - skip == np.diff(offsets)
        rows = np.flatnonzero(same & (n > skip))
        length = (n - skip)[rows]
        differs = out[ragged(ends[rows] + skip[rows], length)] != data[ragged(offsets[rows], length)]
        if len(rows):
            same[rows] = ~np.logical_or.reduceat(differs, np.cumsum(length) - length)
        return same

    def text(self, ids) -> str:
        out = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.dummy and out.startswith(" ") else out


class SliceEncoder:
    """Encodes slices of texts; keeps the segmentations of words met before, up to a bound."""

    def __init__(self, raw: bytes, remember: int = 600_000):
        self.v = Vocabulary.parse(raw)
        self.encoder, self.decoder, self.remember = Encoder(self.v), Decoder(self.v), remember
        self.known: dict[bytes, bytes] = {}

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """Marked words of all texts, in bytes: starts and ends in ``body`` and each text's first.

        Marks are written as spaces here. The dummy prefix is a space put before each text.
        """
        if MARK.encode() in data.tobytes():
            texts = [data[a:b].tobytes().replace(MARK.encode(), b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        size = np.diff(offsets)
        if self.v.dummy_prefix:
            extra = (size > 0).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size + extra)])
            body = np.full(at[-1], 32, np.uint8)
            body[ragged(at[:-1] + extra, size)] = data
        else:
            at, body = offsets, data
        space = body == 32
        cut = np.zeros(len(body), bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(cut)
        return body, starts, np.append(starts[1:], len(body)), np.searchsorted(starts, at)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and offsets."""
        body, starts, ends, first = self.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        hashes = substring_hash(prefix(body), starts, ends)
        _, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = body.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        known = self.known
        new = sorted((k.decode("utf-8", "replace").replace(" ", MARK), k) for k in keys if k not in known)
        fresh = {k: array("i", i).tobytes() for (_, k), i in zip(new, self.encoder.all([w for w, _ in new]), strict=True)}
        got = [known[k] if k in known else fresh[k] for k in keys]
        if len(known) + len(fresh) <= self.remember:
            known.update(fresh)
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat, head = np.frombuffer(b"".join(got), np.int32), np.cumsum(size) - size
        count = size[inverse]
        ids = flat[ragged(head[inverse], count)]
        return ids, np.concatenate([[0], np.cumsum(count)])[first]


def encode(docs: DataFrame, model: bytes, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``ids``."""
    return _made(docs, model, keep, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], lambda coder, ids, at, data, offsets: [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))])


def encode_checked(docs: DataFrame, model: bytes, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the number of ids, their digest (SHA-256 of the ids, comma-joined), and whether
    decoding them gives the text back."""

    def make(coder, ids, at, data, offsets):
        names, bounds = coder.names, at.tolist()
        every = ids.tolist()
        digests = [hashlib.sha256(b",".join([names[i] for i in every[a:b]])).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [np.diff(at), digests, coder.decoder.gives(ids, at, data, offsets)]

    return _made(docs, model, keep, text, [long("n_ids"), string("ids_sha256"), T.StructField("round_trip", T.BooleanType())], make)


def _made(docs, model, keep, text, fields, result):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        coder = SliceEncoder(shared.value)
        coder.names = [b"%d" % i for i in range(len(coder.v.pieces))]

        def kernel(data, offsets):
            ids, at = coder.encode(data, offsets)
            return result(coder, ids, at, data, offsets)

        return kernel

    return per_text(docs, text, keep, fields, make)


def decode(rows: DataFrame, model: bytes, *, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``text``, from a column of ids; null ids give null text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [k for k in keep if k != "text"]
    source = rows.select(*[rows[f"`{k}`"] for k in keep], rows[f"`{ids}`"].alias("__ids"))
    schema = T.StructType([*[source.schema[k] for k in keep], string("text")])

    def run(batches):
        decoder = Decoder(Vocabulary.parse(shared.value))
        for batch in batches:
            texts = [None if x is None else decoder.text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)
