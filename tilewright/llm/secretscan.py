"""Secret scanning with corpus-wide ownership frequency.

Candidates are found by pattern. Each candidate's value is hashed, and the hashes are counted over
the whole corpus by distinct repositories and owners: a value that several owners hold, in
``shared_repos`` repositories or more, is a widely copied example; one that stays with a single owner
and looks random is taken for a live credential, in however many of the owner's repositories it is.

Edge cases: null text is empty; repeated rows give repeated results and add nothing to the distinct
counts; a null owner or repository counts as one of its own; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, long, string, to_arrow

#: Base kinds in the order in which ties of start are listed; least lengths of the value.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more: shorter runs fail either way
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Kinds beside the base ones: private key blocks, prefixed service tokens, three-part web tokens.
_MORE = {
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----"), "-----BEGIN "),
    "prefixed": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}"), None),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), "eyJ"),
}
KINDS = ("assign", "access", "hex", *_MORE)

CANDIDATE = T.StructType([string("kind"), long("start"), long("end"), string("value_hash"), T.StructField("random", T.BooleanType())])


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind's place in KINDS, end, value), sorted; code points, end exclusive."""
    text = text or ""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), 3, m.end(), m[0]) for m in _MORE["pem"][0].finditer(text)]
    if "gh" in text and "_" in text or "xox" in text:
        found += [(m.start(), 4, m.end(), m[0]) for m in _MORE["prefixed"][0].finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 5, m.end(), m[0]) for m in _MORE["jwt"][0].finditer(text)]
    return sorted(found)


def looks_random(value: str) -> bool:
    """Enough entropy for a credential: 2.5 bits a character, and a digit somewhere."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= 2.5 and any(c.isdigit() for c in value)


def _joined(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found)


def scan(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, counts of the base kinds, their digest, all spans, and the candidates."""
    fields = [long("n_assign"), long("n_access"), long("n_hex"), string("base_sha256"), string("spans"), T.StructField("candidates", T.ArrayType(CANDIDATE))]
    keep = [k for k in keep if k not in {f.name for f in fields}]
    source = docs.select(*[docs[f"`{k}`"] for k in keep], docs[f"`{text}`"].alias("__text"))
    schema = T.StructType([source.schema[k] for k in keep] + fields)
    types = [to_arrow(f.dataType) for f in fields]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(len(keep)):
                found = find(text.as_py())
                base = [x for x in found if x[1] < 3]
                kinds = Counter(x[1] for x in base)
                rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), [{"kind": KINDS[k], "start": s, "end": e, "value_hash": hashlib.sha256(v.encode()).hexdigest(), "random": looks_random(v)} for s, k, e, v in found]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=[*keep, *[f.name for f in fields]])

    return source.mapInArrow(run, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repos from rows (value_hash, owner, repo): all of them counted exactly.

    Both counts are made in two steps, so that a value held by a third of all rows is first reduced
    to its distinct owners and repositories on the map side.
    """
    c = candidates.select("value_hash", F.sha2(F.to_json(F.struct("owner")), 256).alias("owner"), F.sha2(F.to_json(F.struct("owner", "repo")), 256).alias("repo"))
    by_owner = c.groupBy("value_hash", "owner").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.sum("one").alias("n_owners"))
    by_repo = c.groupBy("value_hash", "repo").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.sum("one").alias("n_repos"))
    return by_owner.join(by_repo, "value_hash")


def assess(docs: DataFrame, *, owner: str = "source", repo: str = "doc_id", text: str = "text", keep: list[str] | None = None, shared_owners: int = 2, shared_repos: int = 3) -> DataFrame:
    """``scan`` with each row's n_live and n_example, and the greatest n_owners and n_repos of its values.

    A candidate that ``shared_owners`` or more owners hold in ``shared_repos`` or more repositories is an
    example; one of fewer owners that looks random is live; the rest are neither.
    """
    keep = list(dict.fromkeys([*(keep or []), owner, repo]))
    rows = cut(scan(docs, keep=keep, text=text).withColumn("__row", F.monotonically_increasing_id()))
    flat = rows.where(F.size("candidates") > 0).select("__row", F.col(f"`{owner}`").alias("owner"), F.col(f"`{repo}`").alias("repo"), F.explode("candidates").alias("c")).select("__row", "owner", "repo", "c.value_hash", "c.random")
    judged = flat.select("__row", "value_hash", "random").join(ownership(flat), "value_hash")
    several = F.col("n_owners") >= shared_owners
    example = several & (F.col("n_repos") >= shared_repos)
    per_row = judged.groupBy("__row").agg(F.sum((~several & F.col("random")).cast("long")).alias("n_live"), F.sum(example.cast("long")).alias("n_example"), F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos"))
    return rows.drop("n_live", "n_example", "n_owners", "n_repos").join(per_row, "__row", "left").drop("__row", "candidates").fillna(0, ["n_live", "n_example", "n_owners", "n_repos"])


def digest(assessed: DataFrame) -> DataFrame:
    return assessed.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "n_owners", "n_repos")


def without_live(docs: DataFrame, *, owner: str = "source", repo: str = "doc_id", text: str = "text", length: str = "n_chars", shared_owners: int = 2, mask: str = "[secret]") -> DataFrame:
    """Columns as they are; in each text the live-looking credentials are replaced by ``mask``, and the
    column ``length``, if there is one, is brought up to date in these rows.

    The values' counts are gathered first; then the live values found again in a text are those
    whose hash is in its row's own list, so no list of all values is sent around.
    """
    found = scan(docs.select(owner, repo, text), keep=[owner, repo], text=text)
    flat = cut(found.where(F.size("candidates") > 0).select(F.col(f"`{owner}`").alias("owner"), F.col(f"`{repo}`").alias("repo"), F.explode("candidates").alias("c")).select("owner", "repo", "c.value_hash", "c.random"))
    live = flat.where("random").join(ownership(flat).where(F.col("n_owners") < shared_owners), "value_hash").groupBy(F.col("repo").alias("__repo"), F.col("owner").alias("__owner")).agg(F.collect_set("value_hash").alias("__live"))
    joined = docs.join(live, docs[f"`{repo}`"].eqNullSafe(F.col("__repo")) & docs[f"`{owner}`"].eqNullSafe(F.col("__owner")), "left").drop("__repo", "__owner")
    at = docs.columns.index(text)
    sized = docs.columns.index(length) if dict(docs.dtypes).get(length) in ("int", "bigint") else None

    def run(batches):
        for batch in batches:
            columns, lists = list(batch.columns[:-1]), batch.column(batch.num_columns - 1)
            if lists.null_count < len(lists):
                known = lists.to_pylist()
                texts = [redact(t, set(k)) if k else t for t, k in zip(columns[at].to_pylist(), known, strict=True)]
                columns[at] = pa.array(texts, columns[at].type)
                if sized is not None:
                    sizes = [len(t) if k and t is not None else n for t, k, n in zip(texts, known, columns[sized].to_pylist(), strict=True)]
                    columns[sized] = pa.array(sizes, columns[sized].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i) for i in range(batch.num_columns - 1)]))

    def redact(value: str | None, hashes: set[str]) -> str | None:
        if value is None:
            return None
        out, done = [], 0
        for s, _, e, v in find(value):
            if hashlib.sha256(v.encode()).hexdigest() in hashes:
                at = value.find(v, s, e)
                if at >= done:
                    out += [value[done:at], mask]
                    done = at + len(v)
        return "".join([*out, value[done:]])

    return joined.mapInArrow(run, docs.schema)
