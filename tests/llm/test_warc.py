"""WARC bundles against plain Python, the public frame format and round trips."""

import base64
import hashlib
import io
import os
import random
import struct
from collections import defaultdict

import pytest
import zstandard

from parley.llm import warc_bundles as W

SCHEMA = "page_id long, url string, html string, key string, salt int, tied boolean, bundle string, top long"


def page(i, url, html):
    return (i, url, html, "k", 1, False, "b", 3)


def pages():
    rng = random.Random(5)
    texts = ["".join(rng.choice("<p>é🙂 \r\n: ") for _ in range(rng.randrange(0, 3000))) for _ in range(60)]
    out = [page(k, f"http://x.example/{k}?q=ü \r\nX: y", rng.choice(texts[:20] + ["", None]) if k % 2 else texts[k % 60]) for k in range(300)]
    out += [page(7, "http://a", "same"), page(7, "http://b", "same"), page(7, None, "same"), page(3, "http://c", "same")]   # equal ids
    out += [page(9, "u", "twin")] * 5 + [page(None, "u", "none")] * 2 + [page(None, None, "only"), page(None, None, None)]
    out += [page(1000, "u", "long" * 300_000), page(1001, "u", "long" * 300_000), page(1002, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]
    rng.shuffle(out)
    return out


def b32(t):
    return base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()


def expected(rows, least=0):
    by = defaultdict(list)
    for i, url, html, *_ in rows:
        by[html or ""].append((i is not None, i or 0, url is not None, url or ""))
    out = []
    for t, found in by.items():
        found.sort()
        top = found[-1][1] if found[-1][0] else None
        for k, (known, i, *_rest) in enumerate(found):
            revisit = k < len(found) - 1 and len(t.encode()) >= least
            out.append((i if known else None, len(t.encode()), b32(t), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=key)


def key(r):
    return tuple((v is not None, v) for v in r)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=key)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(pages(), SCHEMA).repartition(4).cache()


@pytest.mark.parametrize("frame,bundle,shared", [(256 << 10, 8 << 20, 500_000), (5_000, 40_000, 500_000), (1, 1, 0)])
def test_records(table, monkeypatch, frame, bundle, shared):
    monkeypatch.setattr(W, "FRAME_BYTES", frame)
    monkeypatch.setattr(W, "BUNDLE_BYTES", bundle)
    monkeypatch.setattr(W, "SHARED_ROWS", shared)
    assert got(W.warc_records(table)) == expected(pages())


def test_short_payloads_are_all_responses(table):
    assert got(W.warc_records(table, min_bytes=100)) == expected(pages(), 100)


def test_empty_table(spark):
    assert W.warc_records(spark.createDataFrame([], SCHEMA)).collect() == []


def test_files_are_plain_zstandard_of_plain_records(table, monkeypatch, tmp_path):
    monkeypatch.setattr(W, "FRAME_BYTES", 20_000)
    monkeypatch.setattr(W, "BUNDLE_BYTES", 200_000)
    bundles = W.write_bundles(table)
    assert bundles.count() > 4
    sizes = {r["bundle"]: r["bytes"] for r in W.extract(bundles, str(tmp_path)).collect()}
    assert {n: os.path.getsize(tmp_path / n) for n in os.listdir(tmp_path)} == sizes
    payloads, ids = [], set()
    for name in sizes:
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / name).read_bytes()), read_across_frames=True).read()
        at = 0
        while at < len(raw):                            # a reader of its own
            assert raw.startswith(b"WARC/1.1\r\n", at)
            head = raw[at:raw.index(b"\r\n\r\n", at)].decode("ascii").split("\r\n")
            fields = dict(x.split(": ", 1) for x in head[1:])
            start = at + len("\r\n".join(head)) + 4
            block = raw[start:start + int(fields["Content-Length"])]
            at = start + len(block) + 4
            assert raw[at - 4:at] == b"\r\n\r\n"
            assert fields["WARC-Record-ID"] not in ids
            ids.add(fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "response":
                payloads.append(block.split(b"\r\n\r\n", 1)[1].decode())
            else:
                assert block.endswith(b"\r\n\r\n") and "WARC-Refers-To" in fields
    assert sorted(payloads) == sorted({r[2] or "" for r in pages()})
    assert len(ids) == len(pages())


def test_lookup_unpacks_single_frames(spark, table, monkeypatch):
    monkeypatch.setattr(W, "FRAME_BYTES", 5_000)
    bundles = W.write_bundles(table)
    plan = W.index(bundles)._jdf.queryExecution().executedPlan().toString()
    assert "data" not in plan.split("ReadSchema")[1].split("\n")[0]
    want = [4, 6, 9, 1000, 1001, 5_000_000]
    found = W.lookup(bundles, spark.createDataFrame([(i,) for i in want], "page_id long")).collect()
    assert sorted(r["page_id"] for r in found) == sorted(r[0] for r in pages() if r[0] in want)
    text = {b32(r[2] or ""): r[2] or "" for r in pages()}
    for r in found:
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]).decode() == text[r["payload_digest"]]


def test_damage_is_found():
    w = W.BundleWriter()
    for k in range(10):
        w.add(k, W.record(k, "u", b"payload %d" % k, True, None, "", "1970-01-01T00:00:00Z"))
        w._frame()
    data, entries = w.finish()
    assert [W.parse(W.Bundle(data).frame(f), at)[0]["page_id"] for _, f, at, _ in entries] == list(range(10))
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1 and len(W.Bundle(data).sizes) == 10
    for at in (20, len(data) - 1, len(data) - 30):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, zstandard.ZstdError)):
            bundle = W.Bundle(bytes(bad))
            for k in range(10):
                bundle.frame(k)
