"""Archives, vector search, chats and the pipeline on small tables that hold the awkward cases."""

import base64
import gzip
import hashlib
import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import ann, chat, warc
from tilewright.llm.shared import shared_dir

PAGES = "page_id long, url string, html string, record_type string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é end\r\n\r\nWARC/1.1\r\n" * 12000
    rows = [(5, "http://a/ b?x=ü", "same"), (3, None, "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (7, "u", big), (8, "u", big), (4, "u", "0\r\n\r\n"), (6, "u", "x" * 8192), (6, "u", "x" * 8192), (None, "u", "none"), (None, "u", "none"), (10, "u", "none"), (11, "u", "汉" * 30000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)


def test_archive_against_plain(spark, pages):
    rows = pages.collect()
    groups, expected = {}, []
    for r in rows:
        groups.setdefault((r.html or "").encode(), []).append(r.page_id)
    for payload, ids in groups.items():
        known = [i for i in ids if i is not None]
        first = min(known) if known else None
        response = False
        for i in sorted(ids, key=lambda i: (i != first, i is None, i or 0)):
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if not response:
                expected.append((i, len(payload), digest, "response", None))
                response = True
            else:
                expected.append((i, len(payload), digest, "revisit", first))
    got = warc.archive(pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r.verified for r in got)
    assert warc.archive(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.archive(pages, least=10**9).collect()} == {"response"}


def test_reader_takes_other_archives(spark, tmp_path):
    body = b"hello " * 40000
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"5;x=y\r\nhello\r\n" + warc.chunked(body)
    parts = [block[i : i + 70000] for i in range(0, len(block), 70000)]
    records = [warc.record("response", "<urn:a>", parts[0], WARC_Segment_Number=1), warc.record("warcinfo", "<urn:i>", b"software: x")]
    records += [warc.record("continuation", f"<urn:a:{k}>", p, WARC_Segment_Origin_ID="<urn:a>", WARC_Segment_Number=k, **({"WARC_Segment_Total_Length": len(block)} if k == len(parts) else {})) for k, p in enumerate(parts[1:], 2)]
    for k, r in enumerate(reversed(records)):  # a gzip member per record, segments in any file and order
        with open(tmp_path / f"{k % 2}.warc.gz", "ab") as f:
            f.write(gzip.compress(r + b"\r\n\r\n"))
    got = warc.read(spark, str(tmp_path)).collect()
    assert [(r.payload_bytes, r.payload_digest) for r in got] == [(len(body) + 5, warc.b32sha1(b"hello" + body))]
    (tmp_path / "0.warc.gz").unlink()
    assert warc.read(spark, str(tmp_path)).count() == 0
    assert [(r.record_type, r.verified) for r in warc.read(spark, str(tmp_path), malformed=True).collect()] == [("malformed", False)]


def test_reader_goes_on_after_malformed_records(spark, tmp_path):
    def whole(k, **more):
        return warc.record("response", f"<urn:{k}>", b"HTTP/1.1 200 OK\r\n\r\n" + b"body%d" % k, X_Page_ID=k, **more) + b"\r\n\r\n"

    broken = [
        b"junk before the first record\r\n", whole(1).replace(b"Content-Length: 24", b"Content-Length: 9999999"), whole(2).replace(b"Content-Length: 24", b"Content-Length: x"),
        whole(3).replace(b"WARC-Record-ID", b"Other"), whole(4, WARC_Segment_Number="one"), warc.record("response", "<urn:5>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n") + b"\r\n\r\n",
        warc.record("continuation", "<urn:6>", b"alone", WARC_Segment_Number=2) + b"\r\n\r\n",
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(b + whole(10 + k) for k, b in enumerate(broken)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole(20))[:-12] + gzip.compress(whole(21)))
    revisit = warc.record("revisit", "<urn:x>", b"HTTP/1.1 200 OK\r\nContent-Length: 6\r\n\r\n", WARC_Refers_To="<urn:10>", WARC_Payload_Digest="sha1:" + warc.b32sha1(b"body10"))
    (tmp_path / "c.warc").write_bytes(revisit)
    got = warc.read(spark, str(tmp_path)).collect()
    assert {10, *range(11, 17), 21} <= {r.page_id for r in got} and {r.page_id for r in got} <= {None, *range(10, 17), 20, 21}
    assert [(r.refers_to, r.verified) for r in got if r.record_type == "revisit"] == [(10, True)]
    assert warc.read(spark, str(tmp_path), malformed=True).where("record_type = 'malformed'").count() >= len(broken)


@pytest.mark.parametrize("shard", [40, 4000])
def test_search_against_every_vector(spark, shard):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = np.repeat(centres, 30, axis=0) + 0.3 * rng.normal(size=(360, 16))
    x[50:90] = x[50]
    rows = [(i, v.astype(np.float32).tolist(), "clash") for i, v in enumerate(x)]
    rows += [(400, None, ""), (450, [0.0] * 16, ""), (500, [None] + [1.0] * 15, ""), (550, [float("nan")] * 16, ""), (600, [1.0] * 3, ""), (650, [float("inf")] * 16, ""), (0, rows[0][1], "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, k=5, shard_rows=shard, block_rows=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    m = np.array([r[1] for r in rows[:360]])
    n = np.linalg.norm(m, axis=1)
    assert sorted(got) == list(range(0, 360, 50))
    hit = 0
    for q, found in got.items():
        found.sort()
        s = (m @ m[q]) / (n * n[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in [f[1] for f in found]
        assert all(abs(s[v] - score) < 1e-12 for _, v, score in found)
        order = [i for i in np.lexsort((np.arange(360), -np.round(s, 12))) if i != q][:5]
        hit += len(set(order) & {f[1] for f in found})
    assert hit / (5 * len(got)) >= 0.95
    assert [f[1] for f in sorted(got[50])] == [51, 52, 53, 54, 55]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    few = ann.search(df.where("vec_id in (0, 1, 50)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    far = spark.createDataFrame([(i, [1e300 * (i + 1), 1e300, -1e300 * i]) for i in range(4)] + [(9, [1e-300, -1e-300, 3e-300])], "vec_id long, embedding array<double>")
    plain = far.select("vec_id", F.transform("embedding", lambda v: v / F.when(F.col("vec_id") == 9, 1e-300).otherwise(1e300)).alias("embedding"))
    got, expected = ([(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in ann.search(x, F.lit(True)).orderBy("query_id", "rank").collect()] for x in (far, plain))
    assert got == expected and len(got) == 20


def test_radius_probing_is_exact():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    shard = ann.Shard(codes)
    for radius in (0, 5, 8, 19, 27, 64):
        q = codes[radius] ^ rng.integers(0, 2, 8).astype(np.uint8)
        away = np.unpackbits(codes ^ q, axis=1).sum(1)
        assert shard.within(q, radius).tolist() == np.flatnonzero(away <= radius).tolist()


def test_tool_calls(spark):
    def call(i, name="add", **arguments):
        return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": arguments}) + "</tool_call>"

    def result(i, content):
        return json.dumps({"tool_call_id": i, "content": content})

    rows = [
        (1, 0, "user", "Add é\n"), (1, 1, "tool", result("c1", {"b": 1, "a": 2})), (1, 2, "assistant", "So " + call("c1", x=1, y="2")), (1, 3, "tool", result("c1", "again")), (1, 4, "tool", result("none", 0)),
        (2, 0, "assistant", call("c1", x=1, y=2) + call("c2")), (2, 1, "tool", result("c1", 3)), (2, 2, "tool", "not json"), (2, 3, "assistant", "<tool_call>{</tool_call>"), (None, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""),
    ]
    rows += [(9, t, "user", f"t{t}") for t in range(600)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, ord string").repartition(3)
    schema = {"add": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}, "required": ["x", "y"], "additionalProperties": False}}
    got = chat.linked(df, schema).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.ord): r for r in got}
    assert [json.loads(by[1, k].json)["turn"] for k in range(5)] == [0, 2, 1, 3, 4]
    first = by[1, 1]
    assert first.json == '{"content":"So ","role":"assistant","tool_calls":[{"answered":true,"arguments":{"x":1,"y":"2"},"id":"c1","name":"add","problems":["$.y: not of type integer"]}],"turn":2}'
    assert first.n_invalid == 1 and first.linked and by[1, 2].linked and not by[1, 3].linked and not by[1, 4].linked
    assert by[1, 2].json == '{"content":{"a":2,"b":1},"role":"tool","tool_call_id":"c1","turn":1}'
    assert by[1, 0].json == '{"content":"Add é\\n","role":"user","turn":0}'
    assert by[2, 0].n_calls == 2 and by[2, 0].n_invalid == 1 and not by[2, 0].linked
    assert by[2, 3].n_invalid == 1 and "<tool_call>" in by[2, 3].json and by[2, 2].json.count("not json") == 1
    assert [json.loads(by[9, k].json)["turn"] for k in range(600)] == list(range(600))
    assert chat.linked(df.limit(0)).count() == 0
    assert chat.problems([1, "x"], {"type": "array", "items": {"type": "number", "maximum": 0}}) == ["$[0]: out of range", "$[1]: not of type number"]


def test_broken_calls_stay_text(spark):
    deep = "[" * 200_000
    bad = ["[1]", "null", deep, '{"id": 1, "name": "add", "arguments": ' + deep + "}", '{"id": "1", "name": "add", "arguments": {"x": "\\ud800"}}', '{"id": "\\udfff", "name": "add"}', '{"id": 1, "name": "add", "arguments": {"x": NaN}}', '{"name": "add"}', ""]
    good = ['{"id": 1, "name": "add", "arguments": {"x": ' + "9" * 400 + "}}", '{"id": 2, "name": "add", "arguments": {"x": 1e400}}', '{"id": 3, "name": "other", "arguments": ' + "[" * 300 + "]" * 300 + "}"]
    rows = [(k, 0, "assistant", f"<tool_call>{x}</tool_call>") for k, x in enumerate(bad + good)] + [(100 + k, 0, "tool", x) for k, x in enumerate(bad)] + [(200, 0, "user", "x" * 3_000_000)]
    got = {r.conv_id: r for r in chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"add": {"properties": {"x": {"type": "integer"}}}}).collect()}
    for k, text in enumerate(bad):
        assert (got[k].n_calls, got[k].n_invalid) == (0, 1) and json.loads(got[k].json)["content"] == rows[k][3]
        assert json.loads(got[100 + k].json) == {"content": text, "role": "tool", "turn": 0}
    assert (got[9].n_calls, got[9].n_invalid) == (1, 0) and got[10].n_invalid == 1 and got[11].n_calls == 1
    assert len(got[200].json) > 3_000_000


def test_many_tool_calls_against_a_plain_version(spark):
    """Thousands of calls and results, out of order, some without a partner or with wrong arguments."""
    rng, rows = np.random.default_rng(8), []
    for conv in range(40):
        turns = rng.permutation(120).tolist()
        for k in range(60):
            x = {"query": "q" * int(rng.integers(0, 3)), "limit": int(rng.integers(0, 120))} if k % 3 else {"query": "a", "more": 1}
            ident = f"c{int(rng.integers(0, 50))}"
            rows.append((conv, turns[2 * k], "assistant", "<tool_call>" + json.dumps({"id": ident, "name": "search", "arguments": x}) + "</tool_call>"))
            rows.append((conv, turns[2 * k + 1], "tool", json.dumps({"tool_call_id": f"c{int(rng.integers(0, 60))}", "content": [k, {"b": k, "a": "é"}]}, ensure_ascii=True)))
    expected = {}
    for conv in range(40):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        call_at, answer_at = {}, {}
        for _, turn, role, text in mine:
            if role == "assistant":
                call_at.setdefault(json.loads(text[11:-12])["id"], turn)
            else:
                answer_at.setdefault(json.loads(text)["tool_call_id"], turn)
        links = {i: (call_at[i], answer_at[i]) for i in call_at if i in answer_at}
        place = {}
        for _, turn, role, text in mine:
            of = next((c for c, a in links.values() if a == turn and role == "tool"), None)
            place[turn] = (max(turn, -1 if of is None else of), of is not None, turn)
        for o, turn in enumerate(sorted(place, key=place.get)):
            _, _, role, text = next(r for r in mine if r[1] == turn)
            if role == "tool":
                x = json.loads(text)
                expected[conv, turn] = (o, {"content": x["content"], "role": role, "tool_call_id": x["tool_call_id"], "turn": turn}, place[turn][1], 0)
            else:
                x = json.loads(text[11:-12])
                wrong = [f"$.{k}: not allowed" for k in x["arguments"] if k == "more"] + ["$.query: bad length"] * (not x["arguments"]["query"]) + ["$.limit: out of range"] * (not 1 <= x["arguments"].get("limit", 1) <= 100)
                answered = x["id"] in links and links[x["id"]][0] == turn
                call = {"answered": answered, **x} | ({"problems": wrong} if wrong else {})
                expected[conv, turn] = (o, {"content": "", "role": role, "tool_calls": [call], "turn": turn}, answered, int(bool(wrong)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.linked(df, chat.SCHEMAS).collect()
    assert len(got) == len(expected) and sum(e[2] for e in expected.values()) > 500 and sum(e[3] for e in expected.values()) > 500
    for r in got:
        o, message, joined, invalid = expected[r.conv_id, r.turn]
        assert (r.ord, r.linked, r.n_invalid) == (o, joined, invalid)
        x = json.loads(r.json)
        assert [sorted(c.pop("problems", [])) for c in x.get("tool_calls", [])] == [sorted(c.pop("problems", [])) for c in message.get("tool_calls", [])]
        assert x == message


def test_pipeline_against_its_operators(spark, sf):
    """run() against the stages' plain meaning on the smallest tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    now, counts = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{folder}/{k}")
        before, now = now, spark.read.parquet(f"{folder}/{k}")
        counts.append((name, now.count()))
        if k < 4:
            assert now.columns == docs.columns
            assert now.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert [n for n, _ in counts] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "sentencepiece"]
    n = dict(counts)
    assert n["language_id"] >= 0.97 * docs.count()
    assert n["secret_scan"] == n["decontamination"] == n["sentencepiece"] > 0.6 * docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, now.collect()))


def test_stages_take_awkward_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.limit(20)
    long_ = "".join(f"word{i % 977} " for i in range(60_000))
    rows = [(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "😀 12", "en", None, 4), (None, "the and of " * 20, "en", "s", 220), (9004, long_, "en", "s", len(long_)), (9004, long_, "en", "s", len(long_)), (9005, "z" * 100_000, "en", "s", 100_000)]
    odd = some.unionByName(spark.createDataFrame(rows, docs.schema)).unionByName(some.limit(3)).withColumns({c: F.lit("clash") for c in ("held_out", "score", "n_live", "spans", "id", "root", "items", "__row")})
    for start, columns in ((odd, odd.columns), (docs.limit(0), docs.columns)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            path = f"{shared_dir(spark)}/odd-{uuid.uuid4().hex}"
            stage(spark, now, sf).write.parquet(path)
            now = spark.read.parquet(path)
            if name != "sentencepiece":
                assert now.columns == columns
            if start is odd:
                ids = [r.doc_id for r in now.select("doc_id").collect()]
                assert 9001 not in ids and 9002 not in ids and 9003 not in ids  # no language
        assert (now.count() > 15) == (start is odd)
    assert ids.count(9004) == 1


