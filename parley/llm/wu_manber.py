"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items become lower-cased words between single spaces. A
pattern is a window of an item's words with a space on either side, so a match is
one of whole words. Patterns of similar length form a group with its block shift
table, made on the driver from a slice of the benchmark of bounded size: the last
block of a group's shortest pattern length decides how far a position may move
on; at shift 0 the block's hash selects patterns, which are compared byte by byte.
Many positions of a slice of texts move on at once as numpy arrays.

A benchmark beyond ``SLICE_CHARS`` characters is dealt by hash into slices, written
once, and searched for slice by slice: one slice at a time passes through the driver
and is broadcast, the narrow hits are written, and the hits of a document united.
Items over an eighth of a slice are dealt in pieces that overlap by a window less
one word, so their windows stay whole.

Null or empty texts and items have no words. An item of fewer than ``window``
words is one pattern. Items with a null id count as one item with an empty id.
Repeated item ids are one item.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parley.llm.common import flat, map_batches, rows_kept, text_rows
from parley.session import checkpoint_dir, cut_lineage

SLICE_CHARS = 4 << 20
LANE = 512
PAD = 16
SPACE, BREAK = 0x20, 0x0A
_LUT = np.full(256, SPACE, np.uint8)
for _a, _b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _LUT[_a:_b + 1] = np.arange(_a, _b + 1)
_LUT[0x41:0x5B] = np.arange(0x61, 0x7B)
_ITEM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a number (``raw`` is padded)."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def words_text(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(" <break> w w w <break> w …" of all texts, the place of the space before
    each word, words per text)."""
    n = len(offsets) - 1
    mapped = np.full(len(raw) + n + 1, BREAK, np.uint8)
    breaks = np.append(offsets[:-1] + np.arange(n), len(raw) + n)
    held = np.ones(len(mapped), bool)
    held[breaks] = False
    mapped[held] = _LUT[raw]
    word = (mapped != SPACE) & held
    lead = ~held
    lead[1:] |= word[1:] & ~word[:-1]
    sel = np.flatnonzero(word | ~held)
    lead = lead[sel]
    place = np.arange(len(sel)) + np.cumsum(lead)
    out = np.full(len(sel) + int(lead.sum()) + PAD, SPACE, np.uint8)
    out[place] = mapped[sel]
    out[-PAD:] = 0
    is_break = out[place] == BREAK
    before = place[lead & ~is_break] - 1
    per = np.diff(np.searchsorted(before, place[is_break]))
    return out, before, per


class Patterns:
    """Wu-Manber tables of the windows of a slice of items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[bytes, set[str]] = defaultdict(set)
        size: dict[bytes, int] = {}
        for item, text in items:
            words = _ITEM_WORD.findall(text.encode().lower())
            for k in range(max(1, len(words) - window + 1) if words else 0):
                part = words[k:k + window]
                key = b" " + b" ".join(part) + b" "
                owners[key].add(item)
                size[key] = len(part)
        keys = sorted(owners, key=len)
        self.items = [sorted(owners[k]) for k in keys]
        self.words = np.array([size[k] for k in keys], np.int64)
        self.length = np.array([len(k) for k in keys], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(keys) + bytes(PAD), np.uint8)
        self.groups = []
        at = 0
        while at < len(keys):
            to = int(np.searchsorted(self.length, 2 * self.length[at], "left"))
            self.groups.append(self._group(np.arange(at, to)))
            at = to

    def _group(self, ids: np.ndarray) -> dict:
        m = int(self.length[ids[0]])
        block = min(8, m)
        spots = m - block + 1
        bits = int(min(22, max(12, np.ceil(np.log2(len(ids) * spots)) + 4)))
        g = {"m": m, "block": block, "bits": bits}
        shift = np.full(1 << bits, min(spots, 255), np.uint8)
        for j in range(spots):                   # later blocks allow smaller shifts
            shift[self._hash(self.raw, self.start[ids] + j, g)] = min(spots - 1 - j, 255)
        last = self._hash(self.raw, self.start[ids] + spots - 1, g)
        order = np.argsort(last, kind="stable")
        return g | {"shift": shift, "last": last[order], "ids": ids[order]}

    @staticmethod
    def _hash(raw: np.ndarray, at: np.ndarray, g: dict) -> np.ndarray:
        return (((_at(raw)[at] & _MASK[g["block"]]) * _MIX) >> np.uint64(64 - g["bits"])).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of every occurrence."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for g in self.groups:
            end = len(text) - PAD - g["m"] + 1
            if end <= 0:
                continue
            pos = np.arange(0, end, LANE)
            stop = np.minimum(pos + LANE, end)
            step = g["m"] - g["block"]
            spots, hashes = [], []
            while len(pos):
                h = self._hash(text, pos + step, g)
                move = g["shift"][h]
                hit = move == 0
                if hit.any():
                    spots.append(pos[hit])
                    hashes.append(h[hit])
                pos = pos + np.maximum(move, 1)
                live = pos < stop
                if not live.all():
                    pos, stop = pos[live], stop[live]
            if spots:
                found.append(self._compare(text, np.concatenate(spots), np.concatenate(hashes), g))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _compare(self, text, spot, h, g):
        lo, hi = np.searchsorted(g["last"], h, "left"), np.searchsorted(g["last"], h, "right")
        out = []
        for a in range(0, len(spot), 100_000):   # a block of candidates at a time
            n = (hi - lo)[a:a + 100_000]
            s = np.repeat(spot[a:a + 100_000], n)
            ends = np.cumsum(n)
            p = g["ids"][np.arange(len(s)) + np.repeat(lo[a:a + 100_000] - (ends - n), n)]
            k = 0
            while len(s):
                left = self.length[p] - k
                # beyond the text's end there is only padding, which no pattern has
                there = np.minimum(s + k, len(text) - 8)
                same = ((_at(text)[there] ^ _at(self.raw)[self.start[p] + k]) & _MASK[np.minimum(left, 8)]) == 0
                same &= s + self.length[p] <= len(text) - PAD
                s, p, left = s[same], p[same], left[same]
                over = left <= 8
                out.append((s[over], p[over]))
                s, p = s[~over], p[~over]
                k += 8
        return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (spot[:0], spot[:0])


def hits(patterns: Patterns, batch: pa.RecordBatch) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """Per text: words, spans of hit words (first word, words), items found."""
    raw, offsets = flat(batch)
    text, before, per = words_text(raw, offsets)
    place, pattern = patterns.search(text)
    spans: list[list[dict]] = [[] for _ in per]
    items: list[list[str]] = [[] for _ in per]
    if len(place):
        ends = np.cumsum(per)
        first = np.searchsorted(before, place)
        mark = np.zeros(len(before) + 1, np.int64)
        np.add.at(mark, first, 1)
        np.add.at(mark, first + patterns.words[pattern], -1)
        hit = np.cumsum(mark[:-1]) > 0
        # runs of hit words, cut at texts' ends
        edge = hit.copy()
        edge[1:] = hit[1:] & ~hit[:-1]
        starts = ends - per
        heads = starts[(per > 0)]
        edge[heads] |= hit[heads]
        begin = np.flatnonzero(edge)
        runs = np.add.reduceat(hit, begin)  # no unhit word counts
        doc = np.searchsorted(ends, begin, "right")
        for d, a, n in zip(doc.tolist(), (begin - starts[doc]).tolist(), runs.tolist()):
            spans[d].append({"first": a, "words": n})
        pairs = np.unique(np.searchsorted(ends, first, "right") << 32 | pattern)
        named: dict[int, set[str]] = defaultdict(set)
        for d, p in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()):
            named[d].update(patterns.items[p])
        for d, names in named.items():
            items[d] = sorted(names)
    return per, spans, items


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))


def pieces(text: str, window: int, limit: int) -> list[str]:
    """The text, or where it is over ``limit`` characters runs of its words, each of at least
    ``window`` words (all, if it has fewer); a run begins ``window - 1`` words before the last one's end."""
    if len(text) <= limit:
        return [text]
    raw = np.frombuffer(text.encode(), np.uint8)
    word = np.concatenate([[False], _LUT[raw] != SPACE, [False]])
    start, end = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    out, at = [], 0
    while at < len(start):
        to = min(len(start), max(at + window, int(np.searchsorted(end, start[at] + limit, "right"))))
        out.append(raw[start[at]:end[to - 1]].tobytes().decode())
        at = to - window + 1 if to < len(start) else to
    return out


def _slices(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> tuple[int, Iterator]:
    """(number of slices, broadcast lists of (item, text)); a slice comes from about SLICE_CHARS characters.
    Each broadcast is gone when the next one is made, so what reads it must be written by then;
    one that is the only one stays."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n, limit = max(1, -(-chars // SLICE_CHARS)), max(1, SLICE_CHARS // 8)

    def broadcast(rows: DataFrame):
        return spark.sparkContext.broadcast([(r["item"], r["text"]) for r in rows.collect()])
    if n == 1:
        return 1, iter([broadcast(items)])

    def cut():
        def work(batch):
            found = [(i, x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in pieces(t, window, limit)]
            return {"item": pa.array([i for i, _ in found], pa.string()), "text": pa.array([x for _, x in found], pa.string())}
        return work
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/slices-{uuid.uuid4().hex}"
    dealt = map_batches(items, "item string, text string", cut).withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    dealt.repartition("slice").write.partitionBy("slice").parquet(path)
    stored = spark.read.schema("item string, text string, slice long").parquet(path)

    def each():
        for k in range(n):
            held = broadcast(stored.where(F.col("slice") == k).select("item", "text"))
            yield held
            held.destroy()
    return n, each()


def _maker(items, window: int):
    def make():
        return Patterns(items.value, window)
    return make


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, spans (hit words: first, words), items (ids found, sorted as strings)."""
    n, parts = _slices(benchmark, window, item_col, item_text_col)
    rows = text_rows(docs, id_col, text_col)
    schema = "doc_id long, n_words long, spans array<struct<first:long,words:long>>, items array<string>"

    def scan(items) -> DataFrame:
        make = _maker(items, window)

        def work_of():
            patterns = make()

            def work(batch):
                per, spans, found = hits(patterns, batch)
                return {"doc_id": batch.column(0), "n_words": per.astype(np.int64), "spans": pa.array(spans, _SPANS), "items": pa.array(found, pa.list_(pa.string()))}
            return work
        return work_of

    if n == 1:
        return map_batches(rows, schema, scan(next(parts)))
    # several slices: the same text's rows of all slices meet by its digest; only narrow rows move,
    # all of the first slice's and those with hits of the others
    def with_digest(items):
        make = scan(items)

        def run():
            work = make()
            return lambda batch: work(batch) | {"digest": batch.column(2)}
        return run
    keyed = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    scanned = None
    for k, items in enumerate(parts):
        part = map_batches(keyed, schema + ", digest string", with_digest(items)).withColumn("slice", F.lit(k))
        part = cut_lineage(part.where(F.size("items") > 0) if k else part, "hits")
        scanned = part if scanned is None else scanned.unionByName(part)
    each = scanned.groupBy("doc_id", "digest", "slice").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"))
    whole = each.groupBy("doc_id", "digest").agg(F.max("copies").alias("copies"), F.first("n_words").alias("n_words"),
                                                 F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # unite overlapping spans, in order of their first words
    united = F.expr("""aggregate(spans, cast(array() as array<struct<first:bigint,words:bigint>>), (a, s) ->
        case when size(a) > 0 and s.first <= element_at(a, -1).first + element_at(a, -1).words
             then concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first,
                  'words', greatest(element_at(a, -1).words, s.first + s.words - element_at(a, -1).first))))
             else concat(a, array(s)) end)""")
    return whole.withColumn("spans", united).withColumn("n", F.explode(F.expr("array_repeat(0, int(copies))"))).select("doc_id", "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``contamination``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, of documents without a hit word. Map-only; for a benchmark of several
    slices an anti join with the digests of the texts that have hits."""
    n, parts = _slices(benchmark, window, "item_id", "text")

    def judge_of(items, column: str, hit: bool):
        make = _maker(items, window)

        def judge():
            patterns = make()

            def keep(batch):
                _, spans, _ = hits(patterns, batch.select([column]).rename_columns(["text"]))
                return np.array([bool(s) == hit for s in spans], bool)
            return keep
        return judge
    if n == 1:
        return rows_kept(docs, judge_of(next(parts), text_col, False))
    text = docs.select(F.col(f"`{text_col}`").alias("text"))
    found = None
    for items in parts:
        part = cut_lineage(rows_kept(text, judge_of(items, "text", True)).select(F.sha2("text", 256).alias("digest")).distinct(), "hits")
        found = part if found is None else found.unionByName(part)
    found = found.distinct()
    return docs.join(found, F.sha2(docs[f"`{text_col}`"], 256) == found["digest"], "left_anti")
