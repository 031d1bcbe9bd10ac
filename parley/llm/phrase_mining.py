"""Phrase collocations: frequent phrases of up to four words, scored by their weakest cut.

1. ``word_counts`` counts words per language (distinct words of a block, then a sum).
2. Every word starts a suffix of at most four words that ends with its piece. A block of
   text sends each distinct suffix once, with its count, to a shard chosen by its leading
   words: the first word alone, or, where that is a hot one (``hot_words``), all words up
   to the first that isn't. So the suffixes a shard gets for one route are bounded by the
   occurrences of a word that isn't hot, or are equal and one row a block.
3. A shard sorts suffix pointers by multikey three-way quicksort, all segments of a depth
   at once (``quicksort``): the size of an equal partition is its phrase's count, and a
   partition that holds less than the least count is abandoned. Counts of phrases of hot
   words alone come from several shards and are summed.
4. Scores, containment and ranks are DataFrame operations over the frequent phrases.

Words are carried as strings and compared as such; hashes only choose shards, so counts
are exact. Scores use decimals: products may pass 64 bits.

A null text is empty, a null language is ``und`` (as the text ``und`` is). A text without
words gives nothing; whole rows that repeat count each time; ids and other columns are not
read, whatever their names. A text longer than ``BLOCK_BYTES`` is a block of its own, and
a task holds about 40 bytes for each of its words. Ties of score and count go by the
phrase's UTF-8 bytes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from parley.llm.common import flat, gathered, pack, ragged, tidy, unpack
from parley.llm.hashing import LOW, R, mix
from parley.plans.sizing import broadcast_if_small
from parley.session import cut_lineage

WORDS = 4
BLOCK_BYTES = 8 << 20
SHARD_TOKENS = 1 << 20
#: Words with more occurrences than this, and than a millionth of all, are hot: their
#: number is below a million whatever the input.
HOT_TOKENS, HOT_WORDS = 1 << 18, 1_000_000
#: Frequent phrases that may be broadcast as the parts of others; beyond, they are joined.
PART_ROWS = 500_000
#: Parts in which a language's best are found first.
RANK_PARTS = 64
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
BREAK = PIECE.copy()
BREAK[[0x20, 0x09]] = True
END = -1
MAX_PARTS = 20_000
BLOB = ["u1", "u1", "<u2", "u1", "<u4", "<u8"]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def words_of(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(symbols, number of each word's symbol, number of its piece) of (lang, text) rows.
    A symbol is ``lang word``: words of two languages never meet."""
    raw, offsets = flat(batch, "text")
    low = LOW[raw]
    word = ~BREAK[raw]
    filled = np.diff(offsets) > 0
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    lead, tail = word.copy(), word.copy()
    lead[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    lead[first], tail[last] = word[first], word[last]
    starts, ends = np.flatnonzero(lead), np.flatnonzero(tail) + 1
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(PIECE[raw], dtype=np.int64)[starts] + doc     # either grows where a piece ends
    names = _binary(low[word], ends - starts).dictionary_encode()
    langs = batch.column(batch.schema.get_field_index("lang")).fill_null("und").dictionary_encode()
    many = len(names.dictionary)
    both = langs.indices.to_numpy().astype(np.int64)[doc] * many + names.indices.to_numpy()
    if many * len(langs.dictionary) <= 1 << 24:
        there = np.zeros(many * len(langs.dictionary), bool)
        there[both] = True
        used = np.flatnonzero(there)
        number = (np.cumsum(there) - 1)[both]
    else:
        used, number = np.unique(both, return_inverse=True)
    name, lang = names.dictionary.to_pylist(), [x.encode("utf-8") for x in langs.dictionary.to_pylist()]
    return [b"%b %b" % (lang[u // many], name[u % many]) for u in used.tolist()], number, piece


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("`lang`").cast("string").alias("lang"), F.col("`text`").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """symbol (``lang word``), f: occurrences of every word."""
    def count(batches):
        for block in gathered(batches, limit=BLOCK_BYTES):
            symbols, number, _ = words_of(block)
            if symbols:
                yield pa.RecordBatch.from_pydict({"symbol": pa.array([s.decode("utf-8") for s in symbols]),
                                                  "n": pa.array(np.bincount(number), pa.int64())})
    return _rows(docs).mapInArrow(tidy(count), "symbol string, n long").groupBy("symbol").agg(F.sum("n").alias("f"))


def _hashes(symbols: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, symbols), np.uint64, len(symbols))


def suffixes(number: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes (rows of up to ``WORDS`` numbers, then END) in order, and counts."""
    rows = np.full((len(number), WORDS), END, np.int32)
    for k in range(WORDS):
        m = len(number) - k
        if m > 0:
            rows[:m, k] = np.where(piece[k:] == piece[:m], number[k:], END)
    keys = [(rows[:, k].astype(np.int64) + 1) << 32 | (rows[:, k + 1] + 1) for k in range(0, WORDS, 2)]
    order = np.lexsort(keys[::-1])
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return rows[at], np.diff(np.append(at, len(rows)))


def route(rows: np.ndarray, hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A hash of each suffix's leading words, up to the first that isn't hot."""
    out = hashes[rows[:, 0]]
    on = np.flatnonzero(hot[rows[:, 0]])
    for k in range(1, WORDS):
        on = on[rows[on, k] != END]
        out[on] = mix(out[on] * R + hashes[rows[on, k]])
        on = on[hot[rows[on, k]]]
    return out


def quicksort(symbols: np.ndarray, weight: np.ndarray, least: int, hot_from: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Multikey three-way quicksort of suffix pointers, to depth ``WORDS``.

    ``symbols`` has a suffix's symbols at ``WORDS`` times its number, END after the last.
    All segments are partitioned around pivots of their own in one round: the smaller
    and larger parts stay at their depth, the equal part goes one deeper. Yields
    (first pointers, weights, length) of the phrases that equal parts are: those of at
    least ``least``, and, however few, those shorter than ``WORDS`` of symbols from
    ``hot_from`` on alone, of which other shards have more. Other parts below ``least``
    are abandoned."""
    order = np.arange(len(weight), dtype=np.int64)
    start, size = np.array([0], np.int64), np.array([len(weight)], np.int64)
    depth, shared = np.zeros(1, np.int64), np.ones(1, bool)    # shared: hot words alone lead here
    if not len(weight):
        return
    while len(start):
        n = len(start)
        at = ragged(start, size)
        seg = np.repeat(np.arange(n), size)
        pointer = order[at]
        s = symbols[pointer * WORDS + depth[seg]]
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        three = np.sort(np.stack([s[base], s[base + size // 2], s[base + size - 1]]), axis=0)
        pivot = three[1]
        part = np.sign(s - pivot[seg]) + 1
        key = seg * 3 + part
        many = np.bincount(key, minlength=3 * n).reshape(n, 3)
        total = np.rint(np.bincount(key, weight[pointer], minlength=3 * n)).astype(np.int64).reshape(n, 3)
        warm = np.bincount(key, s >= hot_from, minlength=3 * n).reshape(n, 3) > 0
        to = np.stack([start, start + many[:, 0], start + many[:, 0] + many[:, 1]], axis=1)
        for c in range(3):
            order[ragged(to[:, c], many[:, c])] = pointer[part == c]
        # equal parts: phrases one word longer
        word, hot = pivot != END, shared & (pivot >= hot_from)
        for d in range(WORDS):
            found = word & (depth == d) & ((total[:, 1] >= least) | hot & (d + 1 < WORDS))
            if d and found.any():
                yield order[to[found, 1]], total[found, 1], d + 1
        deeper = word & (depth + 1 < WORDS) & ((total[:, 1] >= least) | hot)
        aside = [(many[:, c] > 0) & ((total[:, c] >= least) | shared & warm[:, c]) for c in (0, 2)]
        start = np.concatenate([to[aside[0], 0], to[deeper, 1], to[aside[1], 2]])
        size = np.concatenate([many[aside[0], 0], many[deeper, 1], many[aside[1], 2]])
        shared = np.concatenate([shared[aside[0]], hot[deeper], shared[aside[1]]])
        depth = np.concatenate([depth[aside[0]], depth[deeper] + 1, depth[aside[1]]])


def _packed(rows: np.ndarray, counts: np.ndarray, symbols: list[bytes]) -> bytes:
    """Suffixes with the symbols they use. Places in these lie column by column, their
    low and high bytes apart, as sorted columns pack well; counts of 1 are left out."""
    used, local = np.unique(rows, return_inverse=True)
    own = [symbols[u] for u in used[int(used[0] == END):].tolist()]
    local = (local.reshape(rows.shape).T + int(used[0] != END)).astype("<u4")
    often = np.flatnonzero(counts > 1)
    return pack([np.frombuffer(b"\n".join(x.replace(b"\\", b"\\b").replace(b"\n", b"\\n") for x in own), np.uint8), (local & 255).astype("u1"),
                 (local >> 8 & 65535).astype("<u2"), (local >> 24).astype("u1"), often.astype("<u4"), counts[often].astype("<u8")])


def _unpacked(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(symbols, rows of places in them from 1 on, 0 for END; counts) of a blob."""
    own, low, middle, high, often, many = unpack(blob, BLOB)
    names = [x.replace(b"\\n", b"\n").replace(b"\\b", b"\\") for x in own.tobytes().split(b"\n")]
    rows = (low | middle.astype(np.int64) << 8 | high.astype(np.int64) << 24).reshape(WORDS, -1).T
    counts = np.ones(len(rows))
    counts[often] = many
    return names, rows, counts


def _blobs(rows: np.ndarray, counts: np.ndarray, shard: np.ndarray, symbols: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(shard, its suffixes)."""
    order = np.argsort(shard, kind="stable")
    rows, counts, shard = rows[order], counts[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(shard[a]), _packed(rows[a:b], counts[a:b], symbols)


def phrase_counts(docs: DataFrame, total: int, hot: np.ndarray, least: int) -> DataFrame:
    """lang, phrase, size, f of all phrases of 2 to ``WORDS`` words with f >= ``least``.
    ``total`` is the number of words, ``hot`` the hashes of the hot ones."""
    shards = max(1, -(-total // SHARD_TOKENS))
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    def send(batches):
        for block in gathered(batches, limit=BLOCK_BYTES):
            symbols, number, piece = words_of(block)
            if not symbols:
                continue
            rows, counts = suffixes(number, piece)
            hashes = _hashes(symbols)
            shard = (route(rows, hashes, np.isin(hashes, shared.value)) % np.uint64(shards)).astype(np.int64)
            held, bytes_held = [], 0
            for blob in _blobs(rows, counts, shard, symbols):
                held.append(blob)
                bytes_held += len(blob[1])
                if bytes_held > 1 << 20:
                    yield _batch(held)
                    held, bytes_held = [], 0
            if held:
                yield _batch(held)

    def count(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table.column("data").to_pylist()]
        coded = pa.array([x for p in parts for x in p[0]], pa.large_binary()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        warm = np.isin(_hashes(names), shared.value)
        place = np.empty(len(names), np.int64)              # hot symbols get the last numbers
        place[np.argsort(warm, kind="stable")] = np.arange(len(names))
        code, at, numbers = place[coded.indices.to_numpy()], 0, []
        for own, rows, _ in parts:
            mine = np.concatenate([[END], code[at:at + len(own)]])
            at += len(own)
            numbers.append(mine[rows].reshape(-1))
        symbols, weight = np.concatenate(numbers), np.concatenate([p[2] for p in parts])
        named = dict(zip(place.tolist(), names))
        lang, phrase, sizes, f = [], [], [], []
        for first, weights, size in quicksort(symbols, weight, least, len(names) - int(warm.sum())):
            for row, w in zip(symbols[first[:, None] * WORDS + np.arange(size)].tolist(), weights.tolist()):
                split = [named[x].decode("utf-8").rsplit(" ", 1) for x in row]
                lang.append(split[0][0])
                phrase.append(" ".join(x[1] for x in split))
                sizes.append(size)
                f.append(w)
        return pa.table({"lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.string()),
                         "size": pa.array(sizes, pa.int32()), "f": pa.array(f, pa.int64())})
    sent = _rows(docs).mapInArrow(tidy(send), "shard long, data binary")
    counted = sent.repartition(min(shards, MAX_PARTS), "shard").groupBy("shard").applyInArrow(count, "lang string, phrase string, size int, f long")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    shard, data = zip(*rows)
    return pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int64()), "data": pa.array(data, pa.binary())})


def hot_words(words: DataFrame, total: int) -> np.ndarray:
    """Hashes of the words with more than ``HOT_TOKENS`` occurrences, and than a
    millionth of all: fewer than a million, as their counts sum to at most all."""
    found = words.where(F.col("f") > max(HOT_TOKENS, total // HOT_WORDS)).select("symbol")
    return _hashes([r["symbol"].encode("utf-8") for r in found.toLocalIterator()])


def frequent_phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f of all phrases of 1 to ``WORDS`` words with f >= ``least``;
    lang, n: all words of a language)."""
    words = cut_lineage(word_counts(docs), "word-counts")
    total = words.agg(F.sum("f")).first()[0] or 0
    phrases = phrase_counts(docs, total, hot_words(words, total), least)
    # a symbol's language may hold blanks, its word not
    word = F.substring_index("symbol", " ", -1)
    words = words.withColumn("word", word).withColumn("lang", F.expr("left(symbol, length(symbol) - length(word) - 1)"))
    single = words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")
    return cut_lineage(phrases.unionByName(single), "phrases"), words.groupBy("lang").agg(F.sum("f").alias("n"))


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of every phrase of several words, by its lowest-scoring cut."""
    parts = phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    parts, _ = broadcast_if_small(parts, "frequent phrases", PART_ROWS)
    words = F.split("phrase", " ")
    cut = (phrases.where("size >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
           .withColumn("left", F.array_join(F.slice(words, 1, F.col("k")), " "))
           .withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(parts, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).withColumnRenamed("_f", name).drop("_lang", "_part")
    exact = F.expr("(2000000BD * cast(f AS decimal(20,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    best = cut.groupBy("lang", "phrase", "size", "f").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "size", F.col("f").alias("a"), "b.l", "b.r", "b.score")


def independent(found: DataFrame, percent: int = 80) -> DataFrame:
    """Phrases of which no longer one that contains them has ``percent`` of their count."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longest = (found.where("size >= 3").select(F.col("lang").alias("_lang"), F.explode(inner).alias("_phrase"), "a")
               .groupBy("_lang", "_phrase").agg(F.max("a").alias("_most")))
    out = found.join(longest, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    share = f"100BD * cast(_most AS decimal(20,0)) >= {percent}BD * cast(a AS decimal(20,0))"
    return out.where(F.expr(f"_most IS NULL OR NOT ({share})")).drop("_lang", "_phrase", "_most")


def first_of_each(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each language with their rank: first in parts of a
    language, then over what these leave, at most ``RANK_PARTS`` times the limit."""
    order = "ORDER BY score DESC, a DESC, phrase"
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("_part")
    near = found.select("*", part).withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY lang, _part {order})")).where(F.col("_k") <= limit)
    return near.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).where(F.col("rank") <= limit).drop("_part", "_k")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, limit: int = 2000) -> DataFrame:
    """Per language its best phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, least)
    best = first_of_each(independent(scored(phrases), percent), limit)
    totals = totals.withColumnRenamed("lang", "_lang")
    return best.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
