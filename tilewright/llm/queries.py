"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, lm, minhash, secretscan, spm, sufdedup, warc
from .shared import table

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TILEWRIGHT_TOKENIZERS", "/opt/tokenizers")
PIECES = "piece_bpe_32k.model"


def pieces(folder: str = TOKENIZERS) -> bytes:
    return (Path(folder) / PIECES).read_bytes()


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.membership(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out()
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.dropped(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.assess(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), lm.held_out())


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces(), keep=["doc_id"])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(table(spark, sf_dir, "conversations"), chat.SCHEMAS)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.find(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


_OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""


_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS f FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (1 + 5 * i)::INT, 5))::BIGINT >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to, true AS verified
FROM d
"""


#: No message of these tables holds a call; fixtures in the tests do.
_OP9 = """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ord, role,
  to_json({'content': coalesce(text, ''), 'role': role, 'turn': turn})::VARCHAR AS json, 0::BIGINT AS n_calls, 0::BIGINT AS n_invalid, false AS linked
FROM conversations
"""


def queries() -> dict:
    found = {
        "op1_warc": op1,
        "op2_minhash_groups": op2,
        "op3_nearest_vectors": op3,
        "op4_language_id": op4,
        "op5_suffix_array": op5,
        "op6_secret_scan": op6,
        "op7_suffix_tree_lm": op7,
        "op8_sentencepiece": op8,
        "op9_chat_format": op9,
        "op10_decontamination": op10,
    }
    return found


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _OP1, "op9_chat_format": _OP9, "op10_decontamination": _OP10}
