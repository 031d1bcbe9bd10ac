"""WARC records of pages in seekable Zstandard bundles.

A bundle is one ``.warc.zst`` file: independent Zstandard frames, each of whole WARC
records of about ``FRAME_BYTES``, then the seek table of the public seekable format in a
skippable frame (sizes and a checksum for each frame, footer with the frame count).
Any Zstandard reader reads a bundle from its start; with the seek table and an index
entry (record id, frame, offset within the unpacked frame, length) one frame is enough.

1. ``responses`` finds the payloads that several pages have, by SHA-256 of the payload:
   partial aggregates of narrow rows, no text is shuffled.
2. ``write_bundles`` maps over the pages as they are scanned. One page of equal payloads,
   that with the largest page_id, is written as ``response``, the others as ``revisit``:
   the headers, the payload's length and digest, and the response they refer to.
3. ``read_bundles`` reads the bundles back, frame by frame; ``lookup`` takes the records
   of given pages through the index, unpacking only the frames they lie in.

Bundles are rows (bundle, n_records, data, entries) of a Parquet table that Spark's
committer writes, as tasks can't open files in a store that only Spark reads; the index
reads ``entries`` alone. ``extract`` writes the files themselves to a mounted folder.

Null html is an empty payload, a null url leaves out the target, a null page_id is
smaller than any other. Pages with equal page_id and payload: the greatest url (null
least) is the response, and of wholly equal rows one. A record is never split: a page
longer than a frame or a bundle is a frame or a bundle of its own. An empty table gives
no bundle and no rows. Other columns of the pages are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parley.llm.common import tidy
from parley.plans.sizing import broadcast_if_small
from parley.session import cut_lineage

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
#: Payloads of several pages that may be broadcast; beyond, they are joined.
SHARED_ROWS = 500_000
#: Parts of a joined payload's pages, so that no task gets all of them.
SALTS = 64
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Fixed values of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLE = "bundle string, n_records long, data binary, entries array<struct<page_id:long,frame:int,offset:long,length:long>>"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long"
UNSAFE = re.compile(r"[^\x21\x23-\x3B\x3D\x3F-\x5B\x5D\x5F\x61-\x7A\x7E]")


def responses(pages: DataFrame) -> DataFrame:
    """key, top, n_top, top_url of payloads that several pages have: the response's
    page_id, how many pages have that id, and the greatest of their urls."""
    per = pages.groupBy("key", "page_id").agg(F.count("*").alias("c"), F.max("url").alias("u"))
    return (per.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("page_id", "c", "u")).alias("m"))
            .where("n > 1").select("key", F.col("m.page_id").alias("top"), F.col("m.c").alias("n_top"), F.col("m.u").alias("top_url")))


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, response (boolean), refers_to: one response for each payload
    of at least ``min_bytes``; shorter ones are all responses."""
    c = lambda name: F.col(f"`{name}`")
    rows = pages.select(c("page_id").alias("page_id"), c("url").alias("url"), F.coalesce(c("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    shared = cut_lineage(responses(rows.where(F.octet_length("html") >= min_bytes).select("key", "page_id", "url")), "shared-payloads")
    side, small = broadcast_if_small(shared, "payloads of several pages", SHARED_ROWS)
    if small:
        met = rows.join(side, "key", "left")
    else:
        side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(side, ["key", "salt"], "left").drop("salt")
    first = F.col("n_top").isNull() | F.col("page_id").eqNullSafe(F.col("top"))
    tied = F.coalesce(F.col("n_top") > 1, F.lit(False)) & first
    out = met.withColumn("tied", tied).withColumn("response", first)
    one = ["page_id", "url", "html", "response", F.when(~F.col("response"), F.col("top")).alias("refers_to")]
    if shared.where("n_top > 1").isEmpty():
        return out.select(*one)
    # pages with the response's id and payload: equal rows are counted, one of them is the response
    ties = (out.where("tied").groupBy("key", "page_id", "url", "top_url").agg(F.count("*").alias("c"), F.max("html").alias("html"))
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("c"))))
            .withColumn("response", (F.col("k") == 1) & F.col("url").eqNullSafe(F.col("top_url"))))
    ties = ties.select("page_id", "url", "html", "response", F.when(~F.col("response"), F.col("page_id")).alias("refers_to"))
    return out.where("not tied").select(*one).unionByName(ties)


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """A response's id follows from its page and payload; a revisit's also from its place."""
    return f"urn:page:{'-' if page_id is None else page_id}:{digest}{place}"


def record(page_id, url, payload: bytes, response: bool, refers_to, place: str, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers of its payload, not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    kind = "response" if response else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest, '' if response else place)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8")), url))
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames; ``finish`` gives the file and the record entries."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.files, self.table, self.held, self.size = [], [], [], 0
        self.entries, self.raw = [], 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.held and self.size + len(data) > FRAME_BYTES:
            self._frame()
        self.entries.append((page_id, len(self.table), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        self.raw += len(data)

    def _frame(self) -> None:
        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.files.append(packed)
        self.table.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def finish(self) -> tuple[bytes, list[tuple]]:
        if self.held:
            self._frame()
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE_MAGIC)
        return b"".join([*self.files, struct.pack("<II", SKIPPABLE_MAGIC, len(table)), table]), self.entries


def write_bundles(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The written table of bundles of all pages (see ``BUNDLE``)."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no, out = TaskContext.get().partitionId(), 0, BundleWriter()
        schema = pa.schema([("bundle", pa.string()), ("n_records", pa.int64()), ("data", pa.binary()),
                            ("entries", pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])

        def row(name: str) -> pa.RecordBatch:
            data, entries = out.finish()
            keys = ("page_id", "frame", "offset", "length")
            return pa.RecordBatch.from_pylist([{"bundle": name, "n_records": len(entries), "data": data, "entries": [dict(zip(keys, e)) for e in entries]}], schema)
        name = lambda: f"{task:06d}-{no:06d}.warc.zst"
        for batch in batches:
            # one row at a time: a batch of long pages isn't copied whole into Python objects
            for i in range(batch.num_rows):
                page_id, url, html, response, refers_to = (c[i].as_py() for c in batch.columns)
                data = record(page_id, url, html.encode("utf-8"), response, refers_to, f":{name()}:{len(out.entries)}", date)
                if out.entries and out.raw + len(data) > BUNDLE_BYTES:
                    yield row(name())
                    no, out = no + 1, BundleWriter()
                    data = record(page_id, url, html.encode("utf-8"), response, refers_to, f":{name()}:0", date)
                out.add(page_id, data)
        if out.entries:
            yield row(name())
    return cut_lineage(decided(pages, min_bytes).mapInArrow(tidy(write), BUNDLE), "warc-bundles")


class Bundle:
    """A bundle's frames by number, through its seek table."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        count, flags, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table of the known form")
        at = len(data) - 9 - 12 * count
        if struct.unpack("<II", self.data[at - 8:at]) != (SKIPPABLE_MAGIC, 12 * count + 9):
            raise ValueError("the seek table's frame is damaged")
        self.sizes = list(struct.iter_unpack("<III", self.data[at:len(data) - 9]))
        self.starts = [0]
        for packed, _, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        if self.starts[-1] != at - 8:
            raise ValueError("frames and seek table don't agree")
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        packed, size, check = self.sizes[k]
        raw = self.unpacker.decompress(self.data[self.starts[k]:self.starts[k] + packed], max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])


def _page_of(uri: str) -> int | None:
    page = uri.strip("<>").split(":")[2]
    return None if page == "-" else int(page)


def parse(raw: bytes, at: int) -> tuple[dict, bytes, int]:
    """(what a record says, its payload, where it ends) of the record at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    if raw[at:at + 10] != b"WARC/1.1\r\n":
        raise ValueError(f"no record at {at}")
    head = _fields(raw[at:end])
    block = raw[end + 4:end + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n")
    payload, size = block[cut + 4:], int(_fields(block[:cut])["Content-Length"])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    response = head["WARC-Type"] == "response"
    if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    return {"page_id": _page_of(head["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"],
            "refers_to": None if response else _page_of(head["WARC-Refers-To"]), "url": head.get("WARC-Target-URI")}, payload, end + 4 + len(block) + 4


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Per record, as the archives have it: see ``RECORD``. Each frame is unpacked once,
    each response's payload is hashed again, and each record must lie where the index says."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, data, entries = (batch.column(c)[i].as_py() for c in ("bundle", "data", "entries"))
                bundle, rows = Bundle(data), []
                for k in range(len(bundle.sizes)):
                    raw, at = bundle.frame(k), 0
                    while at < len(raw):
                        row, _, end = parse(raw, at)
                        if entries[len(rows)] != {"page_id": row["page_id"], "frame": k, "offset": at, "length": end - at}:
                            raise ValueError(f"{name}: record {len(rows)} is not where the index has it")
                        rows.append([*(row[x] for x in names[:5]), name, k, at])
                        at = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], names=names)
    return bundles.select("bundle", "data", "entries").mapInArrow(tidy(read), RECORD)


def index(bundles: DataFrame) -> DataFrame:
    """page_id, bundle, frame, offset, length of every record; the bundles' data is not read."""
    return bundles.select("bundle", F.explode("entries").alias("e")).select("e.page_id", "bundle", "e.frame", "e.offset", "e.length")


def lookup(bundles: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_digest, refers_to, payload of the records of
    ``pages`` (page_id): only the frames they lie in are unpacked. A revisit's payload
    is null; look its ``refers_to`` up."""
    wanted = (index(bundles).join(pages.select("page_id").distinct(), "page_id", "left_semi")
              .groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "offset"))).alias("places")))
    schema = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary"

    def read(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                bundle, held, raw = Bundle(batch.column(0)[r].as_py()), None, b""
                for place in batch.column(1)[r].as_py():
                    if place["frame"] != held:
                        held, raw = place["frame"], bundle.frame(place["frame"])
                    row, payload, _ = parse(raw, place["offset"])
                    row["payload"] = payload if row["record_type"] == "response" else None
                    yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("page_id", "url", "record_type", "payload_digest", "refers_to", "payload")}],
                                                     pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                                                                ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))
    return bundles.select("bundle", "data").join(wanted, "bundle").select("data", "places").mapInArrow(tidy(read), schema)


def extract(bundles: DataFrame, folder: str) -> DataFrame:
    """Write every bundle as a file of ``folder``, one that all executors have mounted;
    a retried task writes the same bytes again, and a reader never sees part of a file."""
    def write(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                part = os.path.join(folder, f".{name}.{TaskContext.get().taskAttemptId()}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, name))
                yield pa.RecordBatch.from_pydict({"bundle": [name], "bytes": pa.array([len(data)], pa.int64())})
    return bundles.select("bundle", "data").mapInArrow(write, "bundle string, bytes long")


def warc_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, and the place of
    each page's record, read back from the bundles written."""
    return read_bundles(write_bundles(pages, min_bytes))
