"""Token-id store: static range asymmetric numeral system over shared frequency tables.

The store is a folder of three tables, all written by Spark's committer, so a
lost task leaves no half-written part:

``symbols``  one row per id that occurs: its share of 2^SCALE (all blocks use it)
``blocks``   one row per block: shard, block, the position of its first id in the
             shard, the rows it holds ids of (doc_id, row in the shard, count), and
             the payload
``shards``   the position of each shard's first id among all ids

A payload is independent of all others: header, checksums, checkpoints, words.
Its ids are dealt over LANES interleaved coders; id k belongs to lane k % LANES.
All lanes advance together as numpy arrays. Every CHECKPOINT steps the states of
all lanes and the place in the word stream are kept, so a reader can start there.

Ids are those of the tokenizers library, made by ``pieces`` (the library, run
over every whole text, takes more than this operator's whole budget; the tests
compare the ids with it).

Shards are ranges of doc_id, in ascending order, and blocks follow one another in
a shard; a null doc_id comes first. Rows with the same doc_id keep the order of
their ids. An empty or null text has its end id alone.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm.byte_bpe import ByteBPE
from parley.llm.common import ragged, slices, text_rows, tidy
from parley.llm.pieces import PieceEncoder
from parley.session import checkpoint_dir

SCALE = 20
LOWER = np.uint64(1 << 31)
LANES = 2048
BLOCK = LANES * 256
CHECKPOINT = 128
SHARD_IDS = 1 << 23
TIE_BYTES = 64                        # of a row's ids, by which rows of one doc_id are dealt
MAGIC = 0x31534E41


def id_type(n_ids: int):
    return np.dtype("<u2") if n_ids <= 1 << 16 else np.dtype("<u4")


def _token_rows(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids) rows, and per task the counts of its ids in rows without ids."""
    schema = "doc_id long, n long, ids binary, id array<int>, seen array<long>"
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("id", pa.list_(pa.int32())), ("seen", pa.list_(pa.int64()))])

    def run(batches):
        enc, seen = None, None
        for batch in batches:
            for part in slices(batch):
                if enc is None:
                    enc = PieceEncoder(tokenizer_path)
                    kind = id_type(max(enc.bpe.size, end_id + 1))
                    seen = np.zeros(max(enc.bpe.size, end_id + 1), np.int64)
                ids, counts = enc.encode(part.column(1))
                size = counts + 1
                ends = np.cumsum(size)
                full = np.full(int(size.sum()), end_id, kind)
                full[ragged(ends - size, counts)] = ids
                seen += np.bincount(full, minlength=len(seen))
                off = np.concatenate([[0], ends * kind.itemsize]).astype(np.int32)
                col = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(full.tobytes())])
                null = pa.nulls(len(size))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(size), col, null.cast(arrow.types[3]), null.cast(arrow.types[4])], schema=arrow)
        if enc is not None:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({"doc_id": [None], "n": [None], "ids": [None], "id": [at.tolist()], "seen": [seen[at].tolist()]}, schema=arrow)
    return df.mapInArrow(tidy(run), schema)


# -- frequency table -------------------------------------------------------------

def quantise(seen: np.ndarray) -> np.ndarray:
    """Shares that sum to 2^SCALE; every id that occurs keeps 1 at least."""
    freq = np.zeros(len(seen), np.int64)
    at = np.flatnonzero(seen)
    if not len(at):
        return freq
    total = 1 << SCALE
    spare = total - len(at)
    share = seen[at] * (spare / seen[at].sum())
    freq[at] = 1 + np.floor(share).astype(np.int64)
    rest = total - int(freq.sum())
    freq[at[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]]] += 1
    return freq


class Tables:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


# -- blocks -------------------------------------------------------------------------

def encode_block(ids: np.ndarray, t: Tables) -> bytes:
    """Header (magic, ids, words, checkpoints, CRC-32 of the ids, CRC-32 of the
    rest), checkpoints (place in the words, states), words."""
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, LOWER, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    shift = np.uint64(63 - SCALE)
    for k in range(steps - 1, -1, -1):
        s = ids[k * LANES:(k + 1) * LANES]
        m = len(s)
        x, f = state[:m], t.freq[s]
        full = x >= f << shift
        if full.any():
            out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            written += len(out)
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:m] = (q << np.uint64(SCALE)) + (x - q * f) + t.cum[s]
        if k % CHECKPOINT == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    body = b"".join(np.uint64(written - w).astype("<u8").tobytes() + s.astype("<u8").tobytes() for w, s in marks[::-1]) + stream.tobytes()
    head = np.array([MAGIC, n, written, len(marks), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)], "<u4")
    return head.tobytes() + body


def decode_block(payload: bytes, t: Tables, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The block's ids from ``start`` to ``stop``, begun at the checkpoint before ``start``."""
    magic, n, n_words, n_marks, crc, body_crc = np.frombuffer(payload, "<u4", 6).tolist()
    body = memoryview(payload)[24:]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    each = 8 * (LANES + 1)
    mark = start // (LANES * CHECKPOINT)
    at = int(np.frombuffer(body, "<u8", 1, mark * each)[0])
    state = np.frombuffer(body, "<u8", LANES, mark * each + 8).copy()
    words = np.frombuffer(body, "<u4", n_words, n_marks * each)
    first = mark * LANES * CHECKPOINT
    out = np.empty(-(-(stop - first) // LANES) * LANES, np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    got = 0
    for k in range(first // LANES, -(-stop // LANES)):
        m = min(LANES, n - k * LANES)
        x = state[:m]
        low = x & mask
        s = t.slot[low]
        x = t.freq[s] * (x >> np.uint64(SCALE)) + low - t.cum[s]
        need = np.flatnonzero(x < LOWER)
        if len(need):
            x[need] = x[need] << np.uint64(32) | words[at:at + len(need)].astype(np.uint64)
            at += len(need)
        state[:m] = x
        out[got:got + m] = s
        got += m
    if first == 0 and stop == n and zlib.crc32(out[:n].astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block")
    return out[start - first:stop - first]


def _symbol_tables(spark: SparkSession, path: str) -> Tables:
    """The shared table: one row per vocabulary id at most, a size fixed by the vocabulary."""
    rows = spark.read.parquet(f"{path}/symbols").select("id", "share").toArrow()
    freq = np.zeros((max(rows["id"].to_pylist()) + 1) if rows.num_rows else 1, np.int64)
    freq[rows["id"].to_numpy()] = rows["share"].to_numpy()
    return Tables(freq)


def write_store(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the store to ``path`` (a folder all executors see)."""
    spark = df.sparkSession
    scratch = f"{checkpoint_dir(spark).rstrip('/')}/tables/ids-{uuid.uuid4().hex}"
    _token_rows(text_rows(df, id_col, text_col), tokenizer_path, end_id).write.parquet(scratch)
    rows = spark.read.parquet(scratch)
    seen = (rows.where("id is not null").select(F.explode(F.arrays_zip("id", "seen")).alias("x"))
            .groupBy("x.id").agg(F.sum("x.seen").alias("seen")).toArrow())  # at most the vocabulary
    count = np.zeros(max(seen["id"].to_pylist(), default=0) + 1, np.int64)
    count[seen["id"].to_numpy()] = seen["seen"].to_numpy()
    freq = quantise(count)
    at = np.flatnonzero(freq)
    spark.createDataFrame(pa.table({"id": pa.array(at, pa.int32()), "share": pa.array(freq[at], pa.int64())}), "id int, share long").coalesce(1).write.parquet(f"{path}/symbols")
    bpe_size = len(freq)
    shards = max(1, -(-int(count.sum()) // SHARD_IDS))
    share = spark.sparkContext.broadcast(freq)
    width = id_type(max(ByteBPE(tokenizer_path).size, end_id + 1)).str
    schema = "shard int, block int, first long, n int, docs binary, rows binary, counts binary, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def blocks(batches):
        t = Tables(share.value)
        shard = TaskContext.get().partitionId()
        held: list[np.ndarray] = []       # ids not yet in a block
        owner: list[list[int]] = []       # [doc_id, row, ids held]
        state = {"row": 0, "block": 0, "first": 0, "held": 0}

        def take(n: int) -> pa.RecordBatch:
            ids = np.concatenate(held)
            now, rest = ids[:n], ids[n:]
            held[:] = [rest] if len(rest) else []
            state["held"] = len(rest)
            docs, left = [], n
            while left:
                doc, row, have = owner[0]
                use = min(have, left)
                docs.append((doc, row, use))
                left -= use
                owner[0][2] -= use
                if not owner[0][2]:
                    owner.pop(0)
            cols = [np.array(c, np.int64).astype("<i8").tobytes() for c in zip(*docs)]
            out = [shard, state["block"], state["first"], n, *cols, encode_block(now, t)]
            state["block"] += 1
            state["first"] += n
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4))], names=names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(ids, width)
                held.append(ids)
                owner.append([NULL_ID if doc is None else doc, state["row"], len(ids)])
                state["row"] += 1
                state["held"] += len(ids)
                while state["held"] >= BLOCK:
                    yield take(BLOCK)
        if state["held"]:
            yield take(state["held"])
    (rows.where("ids is not null").select("doc_id", "ids")
     # rows of one id are dealt by the heads of their ids, in the order of the sort
     .repartitionByRange(shards, "doc_id", F.substring("ids", 1, TIE_BYTES)).sortWithinPartitions("doc_id", "ids")
     .mapInArrow(tidy(blocks), schema).write.option("compression", "none").parquet(f"{path}/blocks"))
    ids = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()  # one row a shard
    at, starts = 0, []
    for r in ids:
        starts.append((r["shard"], at))
        at += r["n"]
    spark.createDataFrame(starts, "shard int, start long").coalesce(1).write.parquet(f"{path}/shards")


#: Stands for a null doc_id in a block's list of documents.
NULL_ID = -(1 << 63)


def crc_join(a: int, b: int, n: int) -> int:
    """CRC-32 of two strings one after another, from their CRCs and the second's length."""
    def times(m, v):
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= m[k]
            v >>= 1
            k += 1
        return out

    m = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        m = [times(m, x) for x in m]                # one zero byte
    while n:
        if n & 1:
            a = times(m, a)
        n >>= 1
        if n:
            m = [times(m, x) for x in m]
    return a ^ b


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the store alone: doc_id, start, n_tokens, ids_crc32."""
    shares = _symbol_tables(spark, path).freq.astype(np.int64)
    share = spark.sparkContext.broadcast(shares)
    schema = "shard int, row long, doc_id long, block int, at long, n long, crc long"

    def decode(batches):
        t = None
        for batch in batches:
            t = t or Tables(share.value)
            for r in batch.to_pylist():
                ids = decode_block(r["payload"], t).astype("<u4")
                docs, rows, counts = (np.frombuffer(r[c], "<i8") for c in ("docs", "rows", "counts"))
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                k = len(docs)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([r["shard"]] * k, pa.int32()), "row": rows,
                                                  "doc_id": pa.array(docs, mask=docs == NULL_ID), "block": pa.array([r["block"]] * k, pa.int32()),
                                                  "at": r["first"] + ends - counts, "n": counts, "crc": pa.array(crc, pa.int64())})
    parts = spark.read.parquet(f"{path}/blocks").select("shard", "block", "first", "docs", "rows", "counts", "payload").mapInArrow(tidy(decode), schema)
    # a row's parts lie in neighbouring blocks; most rows have one
    whole = (parts.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
                                               F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("parts")))

    def join(batches):
        for batch in batches:
            crcs = []
            for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = crc_join(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    starts = F.broadcast(spark.read.schema("shard int, start long").parquet(f"{path}/shards"))  # one row a shard
    return (whole.join(starts, "shard").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "parts")
            .mapInArrow(tidy(join), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def stored_ids(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``df`` to a store in the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stores/ids-{uuid.uuid4().hex}"
    write_store(df, path, tokenizer_path, end_id)
    return read_store(spark, path)
