"""WARC archives: writing with segmentation and deduplication, reading with segment reassembly.

A page becomes a WARC/1.1 response record whose HTTP block is in chunked transfer framing. A block
longer than ``SEGMENT`` bytes is cut into a first record and continuation records, which name their
origin, their number and, in the last one, the total length. Of pages with equal payloads the one
with the smallest page_id is the response and the others are revisit records that refer to it.

Reading parses whole files record by record. Records that aren't segmented are decoded at once; the
segments of the others are grouped by origin identifier, ordered by number, checked against the
total length and then decoded. Digests and lengths of responses are computed from the decoded payload
and held against the headers (``verified``); those of revisits, which carry no payload, are their headers',
held against the response that WARC-Refers-To names, whose page they refer to. Records that are cut
short, have no length or identifier, broken framing or incomplete segments end nothing: reading goes on
at the next record, and they are given apart where asked for.

Archives are written by Spark's text sink (gzip, records end with the format's own separator), so a
lost executor's files are written again by another and only committed files are read. A file holds
at most ``FILE_RECORDS`` records of at most ``SEGMENT`` bytes, which bounds what a reader holds.

Edge cases: null html is an empty payload; null page_ids are grouped as one more id after all
others; of repeated rows (same id and payload) one is the response and the rest revisit it; a null
or odd url is written percent-encoded; extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, long, shared_dir, string, to_arrow

SEGMENT = 8 << 10
CHUNK = 2 << 10
FILE_RECORDS = 4000
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def b32sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions after a size and trailers after the end are skipped."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:eol].split(b";")[0].strip() or b"-", 16)
        if not size:
            return b"".join(out)
        piece = body[eol + 2 : eol + 2 + size]
        if len(piece) < size or body[eol + 2 + size : eol + 4 + size] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(piece)
        at = eol + 4 + size


def record(kind: str, identifier: str, block: bytes, **fields: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def identifier(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}:{copy}>"


def page_records(page_id: int | None, url: str | None, html: bytes, copy: int, first: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page; ``first``: the page_id of the response of its group of equal payloads."""
    digest = b32sha1(html)
    own = identifier(page_id, digest, copy)
    common = {"WARC_Target_URI": quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~-._"), "WARC_Date": "1970-01-01T00:00:00Z", "WARC_Payload_Digest": f"sha1:{digest}", "X_Page_ID": page_id}
    if page_id != first or copy > 1:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
        yield record("revisit", own, head, **common, WARC_Profile=_PROFILE, WARC_Refers_To=identifier(first, digest, 1), X_Refers_To_Page_ID=first, Content_Type="application/http;msgtype=response")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html)
    kind = "application/http;msgtype=response"
    if len(block) <= segment:
        yield record("response", own, block, **common, Content_Type=kind)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record("response", own, parts[0], **common, Content_Type=kind, WARC_Segment_Number=1)
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC_Segment_Total_Length": len(block)} if k == len(parts) else {}
        yield record("continuation", f"{own[:-1]}:{k}>", part, WARC_Date=common["WARC_Date"], WARC_Target_URI=common["WARC_Target_URI"], WARC_Segment_Origin_ID=own, WARC_Segment_Number=k, **last)


def _plain(raw: bytes) -> bytes:
    """What gzip members hold, one or many; a broken member yields what could be read of it, and what
    follows up to the next member's head is skipped."""
    if raw[:2] != GZIP[:2]:
        return raw
    out, rest = [], raw
    while rest:
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(rest) + d.flush())
            rest = d.unused_data.lstrip(b"\0")
        except zlib.error:
            more = rest.find(GZIP, 1)
            rest = rest[more:] if more > 0 else b""
    return b"".join(out)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """(headers by lower-cased name, block) of the records of a file, gzipped or not.

    What is no whole record, up to the next line that begins one, comes as (None, those bytes)."""
    raw, at = _plain(raw), 0
    while at < len(raw):
        stop = raw.find(END, at)
        fields, size = None, None
        if stop >= 0 and raw[at : at + 5] == b"WARC/":
            head = re.sub(r"\r\n[ \t]+", " ", raw[at:stop].decode("utf-8", "replace"))
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.split("\r\n")[1:])}
            stated = fields.get("content-length", "")
            size = int(stated) if stated.isascii() and stated.isdigit() and len(stated) < 16 else None
        if size is None or stop + 4 + size > len(raw) or raw[stop + 4 + size : stop + 6 + size] not in (b"\r\n", b""):
            more = raw.find(b"\r\nWARC/", at)
            more = len(raw) if more < 0 else more + 2
            yield None, raw[at:more]
            at = more
            continue
        yield fields, raw[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        while raw[at : at + 2] == b"\r\n":
            at += 2


def payload(block: bytes) -> tuple[bytes, dict[str, str]]:
    """An HTTP message's payload, out of its transfer framing, and its headers."""
    head, _, body = block.partition(END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
    return (unchunked(body) if fields.get("transfer-encoding", "").lower().endswith("chunked") else body), fields


def write(pages: DataFrame, path: str, *, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archive the pages under ``path``. Payloads under ``least`` bytes are never revisits."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html")).withColumn("same", F.sha2("html", 256))
    slim = rows.groupBy("page_id", "same").agg(F.count("*").alias("n"), F.max(F.length("html")).alias("size"))
    first = slim.where(F.col("size") >= least).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("ids"))
    known = slim.where((F.col("size") >= least)).join(first, "same").where("n > 1 or ids > 1").select(F.col("page_id").alias("k"), F.col("same").alias("s"), "first", "n")
    joined = rows.join(known, rows["page_id"].eqNullSafe(known["k"]) & (rows["same"] == known["s"]), "left")
    single = joined.where("n is null or n = 1").withColumn("copy", F.lit(1)).select("page_id", "url", "html", "copy", F.when(F.col("n").isNull(), F.col("page_id")).otherwise(F.col("first")).alias("first"))
    again = joined.where("n > 1").withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "same").orderBy("url"))).select("page_id", "url", "html", "copy", "first")
    decided = single.unionByName(again) if slim.where(F.col("n") > 1).limit(1).count() else single

    def run(batches):
        for batch in batches:
            out = []
            for page_id, url, html, copy, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out.extend(page_records(page_id, url, html, copy, first))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = decided.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


#: What can be wrong with a record that is whole: no number, no identifier, or a broken framing.
MALFORMED = (ValueError, KeyError, OverflowError)

_FOUND = T.StructType([string("record_id"), long("page_id"), string("record_type"), string("refers_id"), long("refers_to"), string("stated_digest"), long("payload_bytes"), string("payload_digest"), T.StructField("verified", T.BooleanType()), long("segment"), long("total"), T.StructField("block", T.BinaryType())])


def _number(fields: dict, name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _row(fields: dict[str, str], block: bytes) -> tuple | None:
    kind, segment = fields.get("warc-type"), _number(fields, "warc-segment-number")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    head = (_number(fields, "x-page-id"), kind, fields.get("warc-refers-to"), _number(fields, "x-refers-to-page-id"), stated)
    if kind == "continuation":
        return (fields["warc-segment-origin-id"], *head, None, None, None, segment, _number(fields, "warc-segment-total-length"), block)
    if kind not in ("response", "revisit"):
        return None
    if segment is not None:
        return (fields["warc-record-id"], *head, None, None, None, segment, None, block)
    body, http = payload(block)
    if kind == "revisit":
        return (fields["warc-record-id"], *head, int(http.get("content-length", 0)), stated, None, None, None, None)
    digest = b32sha1(body)
    return (fields["warc-record-id"], *head, len(body), digest, stated in (None, digest), None, None, None)


def _malformed(block: bytes) -> tuple:
    return (None, None, "malformed", None, None, None, len(block), b32sha1(block), False, None, None, None)


def read(spark: SparkSession, path: str, *, malformed: bool = False) -> DataFrame:
    """A row per response or revisit record of the archives under ``path``. ``malformed``: also one for
    each record that can't be read (type malformed, not verified), with length and digest of its bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    types = [to_arrow(f.dataType) for f in _FOUND]
    names = [f.name for f in _FOUND]

    def batch_of(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for fields, block in parse(raw.as_py()):
                    try:
                        row = _row(fields, block) if fields else _malformed(block)
                    except MALFORMED:
                        row = _malformed(block)
                    rows += [row] * (row is not None)
                yield batch_of(rows)

    found = cut(files.mapInArrow(run, _FOUND))

    def whole(batches):
        for batch in batches:
            rows = []
            for identity, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.sort(key=lambda p: p["segment"])
                head, block = parts[0], b"".join(p["block"] for p in parts)
                try:
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != parts[-1]["total"]:
                        raise ValueError(f"segments of {identity} are incomplete")
                    body, _ = payload(block)
                except MALFORMED:
                    rows.append(_malformed(block))
                    continue
                digest = b32sha1(body)
                rows.append((identity, head["page_id"], head["record_type"], head["refers_id"], head["refers_to"], head["stated_digest"], len(body), digest, head["stated_digest"] in (None, digest), None, None, None))
            yield batch_of(rows)

    part = F.struct("segment", "block", "total", "page_id", "record_type", "refers_id", "refers_to", "stated_digest")
    # a group is the segments of one record, which was one row when written
    joined = found.where("segment is not null").groupBy("record_id").agg(F.collect_list(part).alias("parts")).mapInArrow(whole, _FOUND)
    full = found.where("segment is null").unionByName(joined).drop("segment", "total", "block")
    target = full.where("record_type = 'response'").select(F.col("record_id").alias("t_id"), F.col("page_id").alias("t_page"), F.col("payload_bytes").alias("t_bytes"), F.col("payload_digest").alias("t_digest"))
    target = target.dropDuplicates(["t_id"])
    revisit = full.where("record_type = 'revisit'").join(target, F.col("refers_id") == F.col("t_id"), "left").withColumn("refers_to", F.coalesce("t_page", "refers_to"))
    checked = revisit.withColumn("verified", F.coalesce((F.col("t_bytes") == F.col("payload_bytes")) & (F.col("t_digest") == F.col("payload_digest")), F.lit(False)))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    plain = full.where("record_type = 'response'" + (" or record_type = 'malformed'" if malformed else ""))
    return plain.select(columns).unionByName(checked.select(columns))


def archive(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """Write the pages to new archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least=least)
    return read(spark, path)
