from __future__ import annotations

import hashlib
import io

import pytest

from viewtrail.llm import warc_bundle as w
from viewtrail.llm._common import scratch


def bundle(records, frame_bytes=300):
    out = io.BytesIO()
    writer = w.BundleWriter(out.write, frame_bytes)
    for name, payload in records:
        writer.add(w._id(name), w.record(name, "http://a/ b\n", payload, hashlib.sha256(payload).hexdigest(), None, False, "2024-01-01T00:00:00Z"))
    writer.finish()
    return out


def test_random_access_and_plain_decompression():
    import zstandard

    records = [(i, bytes([i]) * (i * 37 % 500)) for i in range(40)]
    out = bundle(records)
    reader = w.BundleReader(out)
    index = reader.index()
    assert len(index) == 40 and len(reader.frames) > 10
    for name, payload in records[::-1]:
        ((frame, offset, _),) = index[w._id(name)]
        head, block = reader.record(frame, offset)
        assert head["WARC-Record-ID"] == w._id(name) and block == w.HTTP_HEAD + payload and head["WARC-Target-URI"] == "http://a/%20b%0A"
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 40  # any reader skips the two closing frames


def test_damage_is_found():
    data = bytearray(bundle([(1, b"x" * 900)]).getvalue())
    data[20] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(w.BundleReader(io.BytesIO(bytes(data))).records())
    with pytest.raises(ValueError):
        w.BundleReader(io.BytesIO(bytes(data[:-3])))


def test_round_trip_and_defined_cases(spark):
    long = "é" * 60
    rows = [(5, "u", long, 1), (3, None, long, 1), (9, "u", long, 1), (1, "u", "short", 1), (2, "u", "short", 1), (4, "u", None, 1), (None, "u", long, 1), (3, None, long, 1), (7, "u", "z" * 99, 1), (8, "u", "z" * 99, 1), (10, "u", "y" * 100, 1), (11, "u", "y" * 100, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted((((r["page_id"] or 0), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in w.read(w.write(pages, scratch(spark, "t"), bundle_bytes=400, frame_bytes=200)).collect()), key=lambda g: g[0])
    revisits = [(0, 120, "revisit", 3), (5, 120, "revisit", 3), (9, 120, "revisit", 3), (11, 100, "revisit", 10)]
    responses = [(1, 5), (2, 5), (3, 120), (3, 120), (4, 0), (7, 99), (8, 99), (10, 100)]
    assert got == sorted([*revisits, *((p, n, "response", None) for p, n in responses)], key=lambda g: g[0])
    assert [g for g in got if g[0] in (3, 5, 11)] == [(3, 120, "response", None), (3, 120, "response", None), (5, 120, "revisit", 3), (11, 100, "revisit", 10)]
    assert w.read(w.write(pages.filter("false"), scratch(spark, "t"))).collect() == []
