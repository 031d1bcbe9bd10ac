"""Removal of repeated 50-byte strings by a suffix array over what repeats.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with
a smaller doc_id. Sorting all suffixes of a corpus in one place is out of the
question, so the work is divided without loss:

1. Texts are packed into blocks of bytes (a bucketed table). Every window of 50
   bytes names its least 25-byte substring by a hash, its anchor: equal windows
   have equal anchors in equal places. Neighbouring windows with the same anchor
   are one context, of 50 to 75 bytes.
2. Blocks send (anchor, context hash, document) to shards by anchor, for each
   context its least document of the block: the block's others drop it whole. Where
   an anchor is in one document alone, nothing repeats. Where all documents have the
   same context, all but the least drop it whole: there are no two strings to
   order. Other contexts wait for step 3. An anchor with more than ``HOT_CONTEXTS``
   contexts is divided first: each of its windows is a context by itself, under the
   hash of its bytes, so they spread over the shards.
3. One copy of every distinct waiting context goes to its shard. What all contexts
   of an anchor share around it becomes one symbol; then the suffixes of all
   contexts are put in order (``lyndon_sort``), and windows that agree over their
   whole length, next to each other in that order, form a class with a least
   document. Each occurrence learns which of its windows have a smaller one. An
   anchor with more symbols than a sort takes is sorted in parts: its windows by
   their place before the anchor and the hash of their bytes.
4. Each block marks the bytes of its windows and hashes what is left.

Blocks hold a bounded number of bytes, and shards as much on average. A string
sends one entry of 13 bytes for each block it is in, however many documents have it;
an anchor's contexts in one task are at most ``HOT_CONTEXTS`` and one for each block. The list of
anchors over that is broadcast; the limit rises where the list could have over ``HOT_ANCHORS``.
Anchors are compared by 40 bits of their hash and, where contexts differ, by their
bytes; contexts by 48 bits more.

A null or empty text has no bytes. Rows without a doc_id count as the greatest
id; rows with the same id don't remove one another's bytes.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parley.llm.common import flat, gathered, pack, ragged, segment_sums, text_rows, tidy, unpack
from parley.llm.hashing import R_INV, mix, powers, prefix_sums
from parley.llm.lyndon_sort import suffix_array
from parley.session import checkpoint_dir, cut_lineage

LENGTH, ANCHOR = 50, 25
SPREAD = LENGTH - ANCHOR + 1          # anchors a window can choose from
BLOCK_BYTES = 3 << 20
STEP = 1 << 21                        # windows worked on at a time
SHARD_BYTES = 16 << 20                # text bytes a shard
SORT_SYMBOLS = 150_000                # symbols of one suffix sort, whole anchors
HOT_CONTEXTS = 20_000                 # contexts of one anchor that stay together
HOT_ANCHORS = 1 << 23                 # anchors in the broadcast list, 64 MB
BUCKET_BYTES = 32 << 20               # text bytes a bucket of the block table
MAX_BUCKETS = 100_000                 # the most that Spark takes by default
LOCAL = np.iinfo(np.uint32).max       # shard of a context that its block decides
NO_ID = np.iinfo(np.int64).max
LAYOUT, CODES, WAITING, CONTEXTS, COPIES, MASKS = range(6)
NOTHING, DROP, WAIT, WAIT_AND_SEND = range(4)

_PLACES = np.random.default_rng(50).integers(0, 1 << 64, (2, LENGTH), np.uint64) | np.uint64(1)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts in text order: document, first byte, windows, anchor's place, hash of the anchor, hash of the context."""
    found = []
    total = max(0, len(raw) - LENGTH + 1)
    with np.errstate(over="ignore"):
        for a in range(0, total, STEP):
            part = raw[a:a + STEP + LENGTH - 1]
            n = len(part) - LENGTH + 1
            sums = prefix_sums(part)
            back = powers(R_INV, len(part))
            value = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * back[:len(part) - ANCHOR + 1])
            least, at = value, np.arange(len(value), dtype=np.int32)

            def leftmost(step, least, at, width):
                one, two = least[:width], least[step:step + width]
                later = two < one
                return np.where(later, two, one), np.where(later, at[step:step + width], at[:width])
            seen = 1
            while seen * 2 <= SPREAD:
                least, at = leftmost(seen, least, at, len(least) - seen)
                seen *= 2
            if seen < SPREAD:
                least, at = leftmost(SPREAD - seen, least, at, n)
            # windows that end in their text
            low, high = np.clip(offsets[:-1], a, a + n), np.clip(offsets[1:] - LENGTH + 1, a, a + n)
            per = np.maximum(high - low, 0)
            inside, doc = ragged(low - a, per), np.repeat(np.arange(len(per)), per)
            at = at[inside]
            new = np.ones(len(inside), bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            windows = np.diff(np.append(first, len(inside)))
            begin, end = inside[first], inside[first] + windows + LENGTH - 1
            place = at[first].astype(np.int64)
            context = mix((sums[end] - sums[begin]) * back[begin] + ((end - begin) * 64 + place - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            found.append((doc[first], begin + a, windows, place + a, value[place], context))
    if not found:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _often(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors with several distinct contexts in a block, and how many."""
    _, _, _, _, value, context = anchors(raw, offsets)
    order = np.lexsort((context, value))
    v, c = value[order], context[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    v = v[new]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(v)))
    return v[first][n > 1], n[n > 1]


def _divided(raw: np.ndarray, found: tuple[np.ndarray, ...], hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, windows, anchor, context) with every window of a hot anchor as a context by itself."""
    doc, begin, windows, _, value, context = found
    if not len(hot) or not len(value):
        return doc, windows, value, context
    at = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value
    n = np.where(at, windows, 1)
    of = np.repeat(np.arange(len(n)), n)
    single = np.flatnonzero(at[of])
    start = ragged(begin[at], windows[at])
    value, context, windows = value[of], context[of], windows[of]
    with np.errstate(over="ignore"):
        for k in range(0, len(single), STEP):
            one, two = np.zeros((2, len(single[k:k + STEP])), np.uint64)
            for b in range(LENGTH):
                byte = raw[start[k:k + STEP] + b].astype(np.uint64)
                one += byte * _PLACES[0, b]
                two += byte * _PLACES[1, b]
            value[single[k:k + STEP]], context[single[k:k + STEP]] = mix(one), mix(two)
    windows[single] = 1
    return doc[of], windows, value, context


def _least(doc: np.ndarray, value: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence in the least document of each occurrence's context, whether its own document is that one)."""
    # the sort is stable: where ids ascend already, they need no key
    order = np.lexsort((context, value) if np.all(doc[1:] >= doc[:-1]) else (doc, context, value))
    v, c = value[order], context[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    rep = np.empty(len(v), np.int64)
    rep[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(v) else order
    return rep, doc == doc[rep]


def _narrow(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = x.reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _row(**x) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "block": pa.int64(), "kind": pa.int32(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([x[k]], t) for k, t in kinds.items()], names=list(kinds))


_ROWS = "shard int, block long, kind int, data binary"


def _block_table(docs: DataFrame, total: int) -> tuple[DataFrame, int]:
    """(blocks by number in a bucketed table, buckets: as many as ``total`` text bytes need)."""
    spark = docs.sparkSession

    def to_blocks(batches):
        task, no = TaskContext.get().partitionId(), 0
        for big in gathered(batches, limit=BLOCK_BYTES):
            for k in range(0, big.num_rows, 60_000):
                part = big.slice(k, 60_000)
                raw, off = flat(part)
                ids, null = part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False)
                hot, count = _often(raw, off)
                yield pa.RecordBatch.from_pydict({"block": pa.array([task << 32 | no], pa.int64()), "often": [pack([hot.astype("<u8"), count.astype("<i8")])], "head": [pack([ids.astype("<i8"), null.astype("u1"), np.diff(off).astype("<i8")])], "raw": pa.array([raw.tobytes()], pa.binary())})
                no += 1
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    name = f"parley_blocks_{uuid.uuid4().hex}"
    (docs.mapInArrow(tidy(to_blocks), "block long, often binary, head binary, raw binary").write.format("parquet").option("compression", "zstd")
     .option("path", f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}").bucketBy(buckets, "block").saveAsTable(name))
    return spark.table(name), buckets


def _head(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(unpack(data, ["<i8", "u1", "<i8"]))


def _hot_anchors(blocks: DataFrame, total: int) -> np.ndarray:
    """Sorted anchors with more than HOT_CONTEXTS contexts, at most HOT_ANCHORS of them: there are
    no more contexts than ``total`` text bytes, so not more anchors have a share of ``total / HOT_ANCHORS``."""
    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                anchor, count = unpack(data, ["<u8", "<i8"])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view("<i8")), pa.array(count)], names=["anchor", "n"])
    counts = blocks.select("often").mapInArrow(tidy(run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > max(HOT_CONTEXTS, -(-total // HOT_ANCHORS))).select("anchor").toArrow()
    return np.sort(found["anchor"].to_numpy().astype(np.int64).view(np.uint64))


def _sender(shards: int, hot):
    """``_send`` with the broadcast list of hot anchors."""
    return lambda batches: _send(shards, hot.value)(batches)


def _send(shards: int, hot: np.ndarray):
    """Blocks to (anchor, context, document) entries by shard, and the block's layout."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, null, sizes = _head(r["head"])
                off = np.concatenate([[0], np.cumsum(sizes)])
                raw = np.frombuffer(r["raw"], np.uint8)
                doc, windows, value, context = _divided(raw, anchors(raw, off), hot)
                known = np.where(null.astype(bool), NO_ID, ids)
                rep, least = _least(known[doc], value, context)
                sent = rep == np.arange(len(rep))
                again = np.flatnonzero(least & ~sent)       # the same document has the context again
                shard = np.where(sent, (value % np.uint64(shards)).astype(np.int64), LOCAL)
                yield _row(shard=r["block"] % shards, block=r["block"], kind=LAYOUT, data=pack([windows.astype("u1"), shard.astype("<u4"), again.astype("<u4"), rep[again].astype("<u4")]))
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    at = order[cut[s]:cut[s + 1]]
                    # entries are in document order; a row has the ids of its own documents only
                    head = np.diff(doc[at], prepend=-1) != 0
                    yield _row(shard=s, block=r["block"], kind=CODES, data=pack([_narrow(value[at] >> np.uint64(24), 5), _narrow(context[at], 6), (np.cumsum(head) - 1).astype("<u2"), np.diff(known[doc[at[head]]], prepend=0).astype("<i8")]))
    return run


def _by_shard(solve, passing: int | None = None):
    """Run ``solve(shard, rows)`` over the rows of each shard, which lie together; rows of kind ``passing`` go through."""
    def run(batches):
        shard, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == passing:
                    yield _row(**r)
                    continue
                if r["shard"] != shard and held:
                    yield from solve(shard, held)
                    held = []
                shard = r["shard"]
                held.append(r)
        if held:
            yield from solve(shard, held)
    return run


def _decide(shard, rows):
    """Codes for the entries of each block; the waiting occurrences and contexts of the shard."""
    parts = [unpack(r["data"], ["u1", "u1", "<u2", "<i8"]) for r in rows]
    size = [len(p[2]) for p in parts]
    anchor = np.concatenate([_wide(p[0], 5) for p in parts])
    context = np.concatenate([_wide(p[1], 6) for p in parts])
    doc = np.concatenate([np.cumsum(p[3])[p[2]] for p in parts])
    order = np.lexsort((context, anchor))
    a, c, d = anchor[order], context[order], doc[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_c = new_a.copy()
    new_c[1:] |= c[1:] != c[:-1]
    first_a, first_c = np.flatnonzero(new_a), np.flatnonzero(new_c)
    group = np.cumsum(new_a) - 1
    least, most = np.minimum.reduceat(d, first_a), np.maximum.reduceat(d, first_a)
    several = np.bincount(group[first_c], minlength=len(first_a)) > 1
    shared = least < most
    wait = (shared & several)[group]
    code = np.where(wait, WAIT, np.where(shared[group] & (d > least[group]), DROP, NOTHING)).astype("u1")
    code[first_c] += wait[first_c]
    # contexts that wait, numbered in order
    waiting = wait[first_c]
    number_of = np.cumsum(waiting) - 1
    number = number_of[np.cumsum(new_c) - 1]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    at = 0
    for r, n in zip(rows, size):
        mine = back[at:at + n]
        w = wait[mine]
        numbers = number[mine][w].astype("<u4")
        yield _row(shard=shard, block=r["block"], kind=CODES, data=pack([code[mine], numbers]))
        if w.any():
            yield _row(shard=shard, block=r["block"], kind=WAITING, data=pack([numbers, d[mine][w].astype("<i8")]))
        at += n
    if waiting.any():
        per_context = np.minimum.reduceat(d, first_c)[waiting]
        yield _row(shard=shard, block=-1, kind=CONTEXTS, data=pack([group[first_c][waiting].astype("<u4"), per_context.astype("<i8")]))


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """The shards' rows of each block in one row; together they are as long as the block has contexts."""
    return rows.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "data")).alias("answers"))


def _codes(answers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict, np.ndarray, np.ndarray]:
    """(windows, code and shard of each context, number of each waiting one, answers by kind and shard,
    contexts the same document has again, where it has them first)."""
    by = {(x["kind"], x["shard"]): x["data"] for x in answers if x["kind"] != LAYOUT}
    windows, shard, again, first = unpack(next(x["data"] for x in answers if x["kind"] == LAYOUT), ["u1", "<u4", "<u4", "<u4"])
    code, number = np.full(len(windows), DROP, np.uint8), np.zeros(len(windows), np.int64)
    order = np.argsort(shard, kind="stable")
    order = order[:np.count_nonzero(shard != LOCAL)]
    sides = np.flatnonzero(np.append(np.diff(shard[order].astype(np.int64)), 1)) + 1 if len(order) else []
    at = 0
    for end in sides:
        mine = order[at:end]
        got, numbers = unpack(by[CODES, int(shard[mine[0]])], ["u1", "<u4"])
        code[mine] = got
        number[mine[got >= WAIT]] = numbers
        at = end
    code[again] = np.minimum(code[first], WAIT)
    return windows.astype(np.int64), code, shard, number, by, again, first


def _starts(windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First byte of each context: the windows of a text follow one another."""
    per = np.maximum(sizes - LENGTH + 1, 0)
    off = np.concatenate([[0], np.cumsum(sizes)])
    first = np.cumsum(windows) - windows                  # among all windows of the block
    ends = np.cumsum(per)
    doc = np.searchsorted(ends, first, "right")
    return off[doc] + first - (ends - per)[doc]


def _copies(batches):
    """The bytes of the contexts that a shard asks this block for."""
    for batch in batches:
        for r in batch.to_pylist():
            if not r["answers"]:
                continue
            windows, code, shard, number, *_ = _codes(r["answers"])
            want = np.flatnonzero(code == WAIT_AND_SEND)
            if not len(want):
                continue
            raw = np.frombuffer(r["raw"], np.uint8)
            start = _starts(windows, _head(r["head"])[2])
            want = want[np.argsort(shard[want], kind="stable")]
            cut = np.flatnonzero(np.append(True, np.diff(shard[want].astype(np.int64)) != 0))
            for mine in np.split(want, cut[1:]):
                size = windows[mine] + LENGTH - 1
                yield _row(shard=int(shard[mine[0]]), block=r["block"], kind=COPIES, data=pack([number[mine].astype("<u4"), size.astype("u1"), raw[ragged(start[mine], size)]]))


def classes(contexts: list[list[tuple[bytes, int]]]) -> list[list[np.ndarray]]:
    """For each anchor's contexts (bytes, anchor's place), the class of every window:
    windows of an anchor have the same class if their bytes are the same."""
    symbols: list[int] = []
    pieces = []                                            # per context: where it starts in symbols, left size, common sides
    for g, group in enumerate(contexts):
        left = [t[:p] for t, p in group]
        right = [t[p + ANCHOR:] for t, p in group]
        same_left = len(os.path.commonprefix([x[::-1] for x in left]))
        same_right = len(os.path.commonprefix(right))
        shared = len(contexts) + 257 + g                   # stands for what all contexts of the anchor share
        for x, y in zip(left, right):
            pieces.append((g, len(symbols), len(x), same_left, same_right, len(x) + ANCHOR + len(y)))
            symbols += [b + 2 for b in x[:len(x) - same_left]]
            symbols.append(shared)
            symbols += [b + 2 for b in y[same_right:]]
            symbols.append(1)
    symbols.append(0)
    rank = np.empty(len(symbols), np.int64)
    rank[suffix_array(symbols)] = np.arange(len(symbols))
    text = np.array(symbols + [0] * (LENGTH + 2), np.int64)
    g, at, place, same_left, same_right, size = np.array(pieces, np.int64).T
    windows = size - LENGTH + 1
    ctx = np.repeat(np.arange(len(g)), windows)
    offset = np.arange(len(ctx)) - np.repeat(np.cumsum(windows) - windows, windows)
    before = place[ctx] - offset                           # bytes of the window before the anchor
    own = np.maximum(before - same_left[ctx], 0)           # of those, not shared by all
    need = own + 1 + np.maximum(LENGTH - ANCHOR - before - same_right[ctx], 0)
    start = at[ctx] + place[ctx] - same_left[ctx] - own
    order = np.lexsort((rank[start], before, g[ctx]))
    same = (g[ctx][order][1:] == g[ctx][order][:-1]) & (before[order][1:] == before[order][:-1])
    x, y, n = start[order][:-1], start[order][1:], need[order][1:]
    live = np.flatnonzero(same)
    k = 0
    while len(live):                                       # neighbours in the order agree over the whole window?
        live = live[n[live] > k]
        differ = text[x[live] + k] != text[y[live] + k]
        same[live[differ]] = False
        live = live[~differ]
        k += 1
    number = np.cumsum(np.append(True, ~same)) - 1
    out = np.empty(len(ctx), np.int64)
    out[order] = number
    return np.split(out, np.cumsum(windows)[:-1])


def _parts(groups: list[list[int]], text: list[bytes], place: list[int]):
    """(context, first byte, end) lists whose windows are compared with one another, and
    the symbols a sort takes for each: an anchor's contexts, or where these are more than
    a sort holds, its windows by their place before the anchor and the hash of their bytes."""
    for ns in groups:
        size = sum(len(text[n]) for n in ns)
        if size <= SORT_SYMBOLS:
            yield [(n, 0, len(text[n])) for n in ns], size
            continue
        for before in range(SPREAD):
            same: dict[int, list[tuple[int, int, int]]] = {}
            for n in ns:
                a = place[n] - before
                if 0 <= a <= len(text[n]) - LENGTH:
                    same.setdefault(zlib.crc32(text[n][a:a + LENGTH]), []).append((n, a, a + LENGTH))
            for part in same.values():
                yield part, 2 * len(part)                  # what all share is one symbol


def _order(shard, rows):
    """Masks of the windows that go, for the waiting occurrences of each block."""
    info = next(r for r in rows if r["kind"] == CONTEXTS)
    group, least = unpack(info["data"], ["<u4", "<i8"])
    text: list[bytes] = [b""] * len(group)
    for r in rows:
        if r["kind"] == COPIES:
            number, size, raw = unpack(r["data"], ["<u4", "u1", "u1"])
            data, ends = raw.tobytes(), np.cumsum(size.astype(np.int64)).tolist()
            for n, a, b in zip(number.tolist(), [0, *ends], ends):
                text[n] = data[a:b]
    # anchors by their bytes: hashes of two anchors may agree
    place = _cores(text)
    by: dict[tuple[int, bytes], list[int]] = {}
    for n, (g, t, p) in enumerate(zip(group.tolist(), text, place)):
        by.setdefault((g, t[p:p + ANCHOR]), []).append(n)
    goes = np.zeros((len(group), SPREAD), np.int64)        # least document of each window's class
    turn: list[list[tuple[int, int, int]]] = []            # groups of contexts, or of parts of them
    total = 0

    def flush():
        flatten = [x for part in turn for x in part]
        found = classes([[(text[n][a:b], place[n] - a) for n, a, b in part] for part in turn])
        size = np.array([len(f) for f in found])
        every, owner = np.concatenate(found), np.repeat(least[[n for n, _, _ in flatten]], size)
        best = np.full(int(every.max()) + 1, NO_ID, np.int64)
        np.minimum.at(best, every, owner)
        for (n, a, _), f in zip(flatten, found):
            goes[n, a:a + len(f)] = best[f]
    for part, symbols in _parts(list(by.values()), text, place):
        if len(part) == 1:                                 # nothing to compare with
            n, a, b = part[0]
            goes[n, a:b - LENGTH + 1] = least[n]
            continue
        turn.append(part)
        total += symbols
        if total >= SORT_SYMBOLS:
            flush()
            turn, total = [], 0
    if turn:
        flush()
    count = np.array([len(t) - LENGTH + 1 for t in text])
    bits = np.int64(1) << np.arange(SPREAD)
    for r in rows:
        if r["kind"] == WAITING:
            number, doc = unpack(r["data"], ["<u4", "<i8"])
            drop = (goes[number] < doc[:, None]) & (np.arange(SPREAD) < count[number][:, None])
            yield _row(shard=shard, block=r["block"], kind=MASKS, data=pack([(drop * bits).sum(1).astype("<u4")]))


def _cores(texts: list[bytes]) -> list[int]:
    """Anchor's place in each context (all of a context's windows have the same)."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    off = np.concatenate([[0], ends])
    doc, _, _, place, _, _ = anchors(raw, off)
    first = np.searchsorted(doc, np.arange(len(texts)))
    return (place[first] - off[:-1]).tolist()


def _finish(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids, null, sizes = _head(r["head"])
            raw = np.frombuffer(r["raw"], np.uint8)
            off = np.concatenate([[0], np.cumsum(sizes)])
            covered = np.zeros(len(raw) + 1, np.int32)
            if r["answers"]:
                windows, code, shard, number, by, again, rep = _codes(r["answers"])
                goes = np.repeat(code == DROP, windows)
                wait = np.flatnonzero(code >= WAIT)
                if len(wait):
                    first = np.cumsum(windows) - windows
                    mask = np.zeros(len(code), np.uint32)
                    asked = wait[shard[wait] != LOCAL]
                    asked = asked[np.argsort(shard[asked], kind="stable")]
                    mask[asked] = np.concatenate([unpack(by[MASKS, int(s)], ["<u4"])[0] for s in np.unique(shard[asked])])
                    mask[again] = mask[rep]
                    n = windows[wait]
                    bit = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    goes[ragged(first[wait], n)] = (np.repeat(mask[wait], n) >> bit.astype(np.uint32)) & 1 == 1
                # windows to bytes
                start = np.flatnonzero(goes)
                per = np.maximum(sizes - LENGTH + 1, 0)
                ends = np.cumsum(per)
                doc = np.searchsorted(ends, start, "right")
                byte = off[doc] + start - (ends - per)[doc]
                covered += np.bincount(byte, minlength=len(covered)).astype(np.int32)
                covered -= np.bincount(byte + LENGTH, minlength=len(covered)).astype(np.int32)
            gone = np.cumsum(covered[:-1]) > 0
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            some = off[:-1][sizes > 0]
            head[some] = gone[some]
            removed, spans = segment_sums(gone, off), segment_sums(head, off)
            kept = raw[~gone].tobytes()
            at = np.concatenate([[0], np.cumsum(sizes - removed)]).tolist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, mask=null.astype(bool)), "n_bytes": sizes, "n_removed": removed, "n_spans": spans,
                "kept_sha256": [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at, at[1:])]})


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = text_rows(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = _block_table(rows, total)
    shards = max(1, -(-total // SHARD_BYTES))
    hot = blocks.sparkSession.sparkContext.broadcast(_hot_anchors(blocks, total))
    entries = blocks.select("block", "head", "raw").mapInArrow(tidy(_sender(shards, hot)), _ROWS)
    decided = cut_lineage(entries.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(tidy(_by_shard(_decide, LAYOUT)), _ROWS), "repeats")
    codes = decided.where(F.col("kind").isin(LAYOUT, CODES))
    copies = blocks.select("block", "head", "raw").join(_grouped(codes, buckets), "block").select("head", "raw", "block", "answers").mapInArrow(tidy(_copies), _ROWS)
    waiting = decided.where(F.col("kind").isin(WAITING, CONTEXTS))
    masks = cut_lineage(waiting.unionByName(copies).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(tidy(_by_shard(_order)), _ROWS), "masks")
    return (blocks.select("block", "head", "raw").join(_grouped(codes.unionByName(masks), buckets), "block", "left").select("head", "raw", "answers")
            .mapInArrow(tidy(_finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
