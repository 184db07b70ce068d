import base64
import gzip
import hashlib
import json
import zlib

import pytest

from tidewell.llm import transport_stream as ts
from tidewell.llm import warc
from tidewell.llm.scratch import new_dir


@pytest.mark.parametrize("n", [0, 1, 64, 155, 156, 157, 169, 170, 171, 184, 8191, 8192, 8193, 40_000, 300_001])
def test_stream_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    media = ts.build(data)
    s = ts.parse(media)
    assert len(media) % 188 == 0 and s.payload == data and not (s.gaps or s.repeats or s.broken)
    assert s.programs == {1: {ts.DATA_PID: ts.STREAM_TYPE}} and len(s.points) == max(1, -(-n // ts.UNIT))
    assert [p[0] for p in s.points] == [k * ts.TICKS for k in range(len(s.points))] and [p[3] for p in s.points] == [k % ts.RANDOM_EVERY == 0 for k in range(len(s.points))]
    last = s.points[-1]
    assert ts.read_from(media, s.points, last[0]) == data[max(p[2] for p in s.points if p[3]) :]


def test_stream_faults_are_seen():
    data = bytes(range(256)) * 200
    media = ts.build(data)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = b"".join([*packets[:10], packets[9], *packets[10:]])
    s = ts.parse(twice)
    assert s.payload == data and s.repeats == 1 and not s.gaps
    cut = ts.parse(b"".join(packets[:10] + packets[11:]))
    assert cut.gaps == 1 and cut.broken == 1 and cut.payload == data[ts.UNIT :]
    damaged = bytearray(media)
    damaged[10] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ts.parse(bytes(damaged))
    with pytest.raises(ValueError, match="sync"):
        ts.parse(b"\x00" + media[1:])
    with pytest.raises(ValueError, match="whole"):
        ts.parse(media[:-1])


def test_op5(docs, rows, none):
    want = {}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        p = ts.padded(raw)
        want.setdefault(d, set()).add((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(ts.build(p)).hexdigest()))
    got = ts.digest(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) in want[r.doc_id] for r in got)
    assert ts.digest(none).isEmpty()
    back = ts.demux(ts.mux(docs.selectExpr("doc_id", "cast(text as binary) payload", "'x' media", "'y' points"))).collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(bytes(r.payload) == (texts[r.doc_id] or "").encode() and r.points[0].random for r in back if r.doc_id is not None)


PAGES = "page_id long, url string, html string, file string, keeper string"


def pages(spark):
    same, other = "<p>same é</p>", "<i>" + "y" * 300_000 + "</i>"
    rows = [(i, f"http://a/{i}\n", same if i % 3 else f"<b>{i}</b>\r\n\r\nWARC/1.1", "f", "k") for i in range(30)]
    rows += [(30, None, None, None, None), (31, "u", "", "f", "k"), (32, "u", other, "f", "k"), (33, "u", other, "f", "k"), (None, "n", same, None, None), (None, None, "alone", None, None), (29, "again", same, "f", "k")]
    return rows, spark.createDataFrame(rows, PAGES).repartition(4)


@pytest.mark.parametrize("groups", [0, 1000])
def test_op3(spark, groups, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)
    rows, df = pages(spark)
    best = {}
    for i, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        top = best[h or ""]
        response = top < 0 or i == top
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else top))
    got = [tuple(r) for r in warc.digest(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.digest(df.limit(0)).isEmpty()


def test_normaliser(spark, tmp_path):
    _, df = pages(spark)
    folder = new_dir(spark, "t")
    files = warc.write(warc.marked(df), f"{folder}/mono")
    listed = warc.normalise(files, f"{folder}/norm").collect()
    for r in listed:
        data = open(r["file"].removeprefix("file://"), "rb").read()
        index = [json.loads(x) for x in open(r["index"].removeprefix("file://"))]
        assert len(index) == r.n_records and sum(x[1] for x in index) == len(data)
        for offset, length, ident, kind in index:
            headers, _ = warc.member(r["file"], offset, length)
            assert headers["WARC-Record-ID"] == ident and headers["WARC-Type"] == kind
    one = files.first()["file"].removeprefix("file://")
    raw = gzip.decompress(open(one, "rb").read())
    assert b"".join(warc.records(iter([raw]))) == raw == b"".join(warc.records(warc.inflated(iter([gzip.compress(raw[:50]) + gzip.compress(raw[50:])]))))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.inflated(iter([gzip.compress(raw)[:-9]])))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(iter([raw[:-20]])))


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read(warc.archive(df, least=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
