"""Language-model scoring: Elias-Fano n-gram tries, one per shard of the words.

The model is a bigram with Dirichlet smoothing over the add-one unigram,
``p(w | c) = (count(c, w) + MU p(w)) / (count(c) + MU)``, which sums to 1 over the
known words and one unknown. In logarithms it falls apart into a part of the pair,
looked up under the word, and a part of the context alone, looked up under the
context as a word. So each token is scored in two places, each of which knows all
it needs, and neither counts nor texts ever meet in one place:

1. one pass counts the training tokens by word, for N, V and the words and pairs
   that are hot;
2. each block of documents sends, to every shard, its distinct (word, context)
   pairs with their training counts and the documents of their tokens;
3. a shard sums the counts, builds its trie (words; pointers; contexts relative to
   their word; quantised log probabilities), memory-maps it, looks all pairs up and
   returns sums per document; a distinct pair is looked up once, between its word's pointers;
4. the sums of a document are added up.

A word with many tokens is dealt over shards by its contexts, its count sent along;
pairs with many tokens are scored in the blocks, by a trie of theirs sent to all tasks.
Both lists are bounded by the number of shards, which grows with the input.

Words are 64-bit hashes, contexts under a word 40-bit ones. Capitals A-Z are folded.
A null or empty text has its end token alone. A row without a doc_id takes the
remainder of an empty text.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parley.llm.common import flat, gathered, pack, ragged, tidy, unpack
from parley.llm.elias_fano import EliasFano
from parley.llm.hashing import R, mix, word_hashes
from parley.session import cut_lineage

FOLDS, HELD_OUT = 7, 2
MU = 1000.0
BLOCK_BYTES = 8 << 20
SHARD_TOKENS = 1_500_000
MAX_PARTS = 20_000
END, BEGIN = np.uint64(0x3C2F733E3C2F733E), np.uint64(0x3C733E3C733E3C73)
CONTEXT = np.uint64((1 << 40) - 1)


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, hash of the word before, document) of every token; the last of a document is END."""
    hashed, per = word_hashes(*flat(batch))
    n = len(per)
    size = per + 1
    last = np.cumsum(size) - 1
    word = np.empty(int(size.sum()), np.uint64)
    word[ragged(last + 1 - size, per)] = hashed
    word[last] = END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[last + 1 - size] = BEGIN
    return word, before, np.repeat(np.arange(n), size)


def context_of(before: np.ndarray) -> np.ndarray:
    return mix(before) & CONTEXT


def pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(word * R + context)


def _blocks(batches):
    return gathered(batches, limit=BLOCK_BYTES)


def _training_counts(rows: DataFrame) -> DataFrame:
    """(pair, w, c, n): training tokens by word (pair false), and the pairs frequent in some block."""
    def run(batches):
        for part in _blocks(batches):
            word, before, doc = tokens(part)
            train = ~part.column(2).to_numpy(zero_copy_only=False)[doc]
            word, before = word[train], before[train]
            if not len(word):
                continue
            w, n = np.unique(word, return_counts=True)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(np.zeros(len(w), bool)), "w": w.view(np.int64), "c": np.zeros(len(w), np.int64), "n": n})
            often = w[n >= max(64, len(word) // 2000)]
            some = np.isin(word, often)
            key, first, m = np.unique(pair_key(word[some], context_of(before[some])), return_index=True, return_counts=True)
            keep = m >= max(64, len(word) // 2000)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(np.ones(int(keep.sum()), bool)), "w": word[some][first[keep]].view(np.int64),
                                              "c": context_of(before[some][first[keep]]).view(np.int64), "n": m[keep]})
    return rows.mapInArrow(tidy(run), "pair boolean, w long, c long, n long").groupBy("pair", "w", "c").agg(F.sum("n").alias("n"))


def _pair_counts(rows: DataFrame, pairs: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Exact training counts of a bounded list of pairs."""
    spark = rows.sparkSession
    names = list(pairs)
    keys = pair_key(np.array([w for w, _ in names], np.uint64), np.array([c for _, c in names], np.uint64))
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast(keys[order])

    def run(batches):
        known = shared.value
        for part in _blocks(batches):
            word, before, doc = tokens(part)
            train = ~part.column(2).to_numpy(zero_copy_only=False)[doc]
            key = pair_key(word[train], context_of(before[train]))
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            n = np.bincount(at[known[at] == key], minlength=len(known))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"k": some, "n": n[some]})
    got = {r["k"]: r["n"] for r in rows.mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # bounded by the list
    return {names[i]: got.get(k, 0) for k, i in enumerate(order.tolist())}


class Trie:
    """Words, pointers to their contexts, contexts relative to their word, log10 values in 16 bits."""

    @staticmethod
    def build(words: np.ndarray, word_of_pair: np.ndarray, context: np.ndarray, counts: np.ndarray, word_counts: np.ndarray, n: int, v: int) -> bytes:
        """Words sorted; pairs sorted by word and context."""
        names = np.unique(context)
        pointers = np.concatenate([[0], np.cumsum(np.bincount(word_of_pair, minlength=len(words)))])
        # a word's contexts rise from one above the last context of the words before it
        name = np.searchsorted(names, context).astype(np.int64)
        filled = np.flatnonzero(np.diff(pointers))
        step_up = np.zeros(len(words) + 1, np.int64)
        step_up[filled + 1] = name[pointers[filled + 1] - 1] + 1
        relative = np.cumsum(step_up)[word_of_pair] + name
        share = MU * (word_counts + 1) / (n + v + 1)
        value = np.concatenate([np.log10(counts + share[word_of_pair]), np.log10(share)])
        low = float(value.min()) if len(value) else 0.0
        step = (float(value.max()) - low) / 65535 or 1.0 if len(value) else 1.0
        code = np.rint((value - low) / step).astype("<u2")
        parts = [EliasFano.build(words, 1 << 64), EliasFano.build(pointers, int(pointers[-1]) + 1), EliasFano.build(names, 1 << 40),
                 EliasFano.build(relative, int(relative[-1]) + 1 if len(relative) else 1), code.tobytes(), word_counts.astype("<i8").tobytes()]
        sizes = [-(-len(p) // 8) * 8 for p in parts]
        head = np.array([len(words), len(relative), *np.cumsum(sizes) - sizes], "<i8").tobytes() + np.array([low, step], "<f8").tobytes()
        return head + b"".join(p.ljust(s, b"\0") for p, s in zip(parts, sizes))

    def __init__(self, buf: np.ndarray):
        n_words, n_pairs, *at = np.frombuffer(buf[:64].tobytes(), "<i8").tolist()
        self.low, self.step = np.frombuffer(buf[64:80].tobytes(), "<f8").tolist()
        body = buf[80:]
        self.words, self.pointers, self.names, self.contexts = (EliasFano.open(body[a:b]) for a, b in zip(at, at[1:5]))
        self.code = body[at[4]:at[4] + 2 * (n_pairs + n_words)].view("<u2")
        self.counts = body[at[5]:at[5] + 8 * n_words].view("<i8")
        self.n_pairs = n_pairs
        pointer = self.pointers.get(np.arange(n_words + 1)).astype(np.int64)
        self.start, self.end = pointer[:-1], pointer[1:]
        self.base = np.zeros(n_words, np.uint64)              # one above the contexts of the words before
        after = self.start > 0
        self.base[after] = self.contexts.get(self.start[after] - 1) + np.uint64(1)

    def places(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Place of each pair's context between its word's pointers, -1 where it isn't
        there: the successor of the context relative to its word."""
        name = self.names.find(context)
        at = np.full(len(word), -1, np.int64)
        some = np.flatnonzero(name >= 0)
        w = word[some]
        at[some] = self.contexts.find(self.base[w] + name[some].astype(np.uint64), self.start[w], self.end[w])
        return at

    def value(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10(count(c, w) + MU p(w)) of pairs at these places."""
        return self.low + self.step * self.code[np.where(at >= 0, at, self.n_pairs + word)].astype(np.float64)

    def lookup(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self.value(self.places(word, context), word)

    @classmethod
    def mapped(cls, raw: bytes) -> Trie:
        """The trie in anonymous mapped memory, given back when the trie goes."""
        held = mmap.mmap(-1, len(raw))
        held.write(raw)
        return cls(np.frombuffer(held, np.uint8))


PAIRS = ["<u8", "<u4", "u1", "<u4", "<u4", "<u2"]  # words; pairs of each; contexts (5 bytes each); counts; tokens of each; documents
SUMS = ["<u2", "<f8", "<f8", "<i8"]                # documents; score, base, known of each
DOCS = ["<i8", "u1", "<i8", "u1"]                  # ids; null ids; tokens; held out


def _sums(doc, score, base, known, n_docs):
    """Packed sums of the documents that occur."""
    some = np.flatnonzero(np.bincount(doc, minlength=n_docs))
    add = lambda x: np.bincount(doc, x, minlength=n_docs)[some]
    return pack([some.astype("<u2"), add(score), add(base), np.rint(add(known)).astype("<i8")])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("held", held_out())
    counted = cut_lineage(_training_counts(rows), "word-counts")
    total = counted.where("not pair").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("w") == int(END.astype(np.int64)), F.col("n"))).alias("docs")).first()
    n, v, train_docs = total["n"] or 0, total["v"], total["docs"] or 0
    shards = max(1, -(-n * FOLDS // (FOLDS - 1) // SHARD_TOKENS))
    # counts sum to n, so each list has at most 8 entries a shard
    often = counted.where(F.col("n") * (8 * shards) > n)
    unsigned = lambda x: x & 0xFFFFFFFFFFFFFFFF
    hot_words = {unsigned(r["w"]): r["n"] for r in often.where("not pair").select("w", "n").collect()} if shards > 1 else {}
    hot_pairs = {(unsigned(r["w"]), unsigned(r["c"])): r["n"] for r in often.where("pair").select("w", "c", "n").collect()} if shards > 1 else {}
    hot_pairs = _pair_counts(rows, {p: k for p, k in hot_pairs.items() if p[0] in hot_words}) if hot_pairs else {}
    # hot pairs are scored in the blocks, by a trie of their own
    w_keys = np.array(sorted(hot_words), np.uint64)
    w_counts = np.array([hot_words[int(w)] for w in w_keys], np.int64)
    pairs = sorted(hot_pairs.items())
    hot_trie = Trie.build(w_keys, np.searchsorted(w_keys, np.array([w for (w, _), _ in pairs], np.uint64)), np.array([c for (_, c), _ in pairs], np.uint64),
                          np.array([k for _, k in pairs], np.int64), w_counts, n, v)
    shared = spark.sparkContext.broadcast((hot_trie, w_keys, w_counts, n, v, shards))

    def send(batches):
        hot_trie, w_keys, w_counts, n, v, shards = shared.value
        hot_trie = Trie.mapped(hot_trie)
        task, no = TaskContext.get().partitionId(), 0
        names = ["shard", "block", "kind", "data"]
        row = lambda shard, block, kind, data: pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=names)
        for big in _blocks(batches):
            for k in range(0, big.num_rows, 60_000):       # documents of a block have 16-bit numbers
                part = big.slice(k, 60_000)
                word, before, doc = tokens(part)
                context = context_of(before)
                held = part.column(2).to_numpy(zero_copy_only=False)
                block = task << 32 | no
                no += 1
                ids = part.column(0)
                yield row(block % shards, block, 0, pack([ids.fill_null(0).to_numpy().astype("<i8"), ids.is_null().to_numpy(zero_copy_only=False).astype("u1"),
                                                        np.bincount(doc, minlength=len(held)).astype("<i8"), held.astype("u1")]))
                hot = np.zeros(len(word), bool)
                at_w = np.minimum(np.searchsorted(w_keys, word), max(len(w_keys) - 1, 0))
                if len(w_keys):
                    hot = w_keys[at_w] == word
                if hot.any():
                    at = np.flatnonzero(hot)
                    place = hot_trie.places(at_w[at], context[at])
                    here, place = at[place >= 0], place[place >= 0]
                    count = w_counts[at_w[here]]
                    as_context = np.where(word[here] == END, 0.0, -np.log10(count + MU))
                    if len(here):
                        yield row(block % shards, block, 2, _sums(doc[here], hot_trie.value(place, at_w[here]) + as_context, np.log10(count + 1.0), (count > 0).astype(float), len(held)))
                    rest = np.ones(len(word), bool)
                    rest[here] = False
                    word, context, doc, hot = word[rest], context[rest], doc[rest], hot[rest]
                key = pair_key(word, context)
                shard = (np.where(hot, key, mix(word)) % np.uint64(shards)).astype(np.int64)
                # pairs by shard, word, context, each by its leading bits: a pair of which
                # others come between is sent twice, and the shard adds its counts up
                wide = max(1, int(shards - 1).bit_length())
                order = np.argsort(shard.astype(np.uint64) << np.uint64(64 - wide) | (word >> np.uint64(wide + 24)) << np.uint64(24) | context >> np.uint64(16))
                word, context, doc, shard = word[order], context[order], doc[order], shard[order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (shard[1:] != shard[:-1])
                first = np.flatnonzero(new)
                if not len(first):
                    continue
                size = np.diff(np.append(first, len(word)))
                count = np.add.reduceat((~held[doc]).astype(np.int64), first)
                w, s = word[first], shard[first]
                new_word = np.ones(len(w), bool)
                new_word[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
                fw = np.flatnonzero(new_word)
                pairs_of = np.diff(np.append(fw, len(w)))
                raw_context = context[first].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                token_at = np.append(first, len(word))
                cut_p = np.searchsorted(s, np.arange(shards + 1))
                cut_w = np.searchsorted(s[fw], np.arange(shards + 1))
                for x in np.flatnonzero(np.diff(cut_p)).tolist():
                    a, b, wa, wb = cut_p[x], cut_p[x + 1], cut_w[x], cut_w[x + 1]
                    yield row(x, block, 1, pack([w[fw[wa:wb]].astype("<u8"), pairs_of[wa:wb].astype("<u4"), np.ascontiguousarray(raw_context[a:b]).reshape(-1),
                                                count[a:b].astype("<u4"), size[a:b].astype("<u4"), doc[token_at[a]:token_at[b]].astype("<u2")]))

    def answer(batches):
        _, w_keys, w_counts, n, v, shards = shared.value

        def solve(held: list[tuple[int, bytes]]):
            parts = [unpack(d, PAIRS) for _, d in held]
            words = np.unique(np.concatenate([p[0] for p in parts]))
            place = [np.repeat(np.searchsorted(words, p[0]), p[1]) for p in parts]
            contexts = []
            for p in parts:
                wide = np.zeros((len(p[3]), 8), np.uint8)
                wide[:, :5] = p[2].reshape(-1, 5)
                contexts.append(wide.reshape(-1).view("<u8"))
            pw, pc = np.concatenate(place), np.concatenate(contexts)
            order = np.lexsort((pc, pw)) if len(words) >= 1 << 24 else np.argsort(pw.astype(np.uint64) << np.uint64(40) | pc)
            w, c = pw[order], pc[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(new)
            number = np.empty(len(w), np.int64)              # each entry's distinct pair
            number[order] = np.cumsum(new) - 1
            pn = np.add.reduceat(np.concatenate([p[3] for p in parts])[order].astype(np.int64), first)
            pw, pc = w[first], c[first]
            seen = pn > 0
            counts = np.rint(np.bincount(pw, pn, minlength=len(words))).astype(np.int64)
            if len(w_keys):                                  # hot words lie in many shards: their counts are known
                at = np.minimum(np.searchsorted(w_keys, words), len(w_keys) - 1)
                counts = np.where(w_keys[at] == words, w_counts[at], counts)
            trie = Trie.mapped(Trie.build(words, pw[seen], pc[seen], pn[seen], counts, n, v))
            found = trie.words.find(words)
            count_of = np.asarray(trie.counts)[found]
            as_context = np.where(words == END, 0.0, -np.log10(count_of + MU))
            base, known = np.log10(count_of + 1.0), (count_of > 0).astype(float)
            value = trie.lookup(found[pw], pc) + as_context[pw]   # each distinct pair once
            end = 0
            for (block, _), p, w in zip(held, parts, place):
                mine = number[end:end + len(w)]
                end += len(w)
                doc, w = p[5].astype(np.int64), np.repeat(w, p[4])
                yield block, 2, _sums(doc, np.repeat(value[mine], p[4]), base[w], known[w], int(doc.max()) + 1)

        def out(rows):
            block, kind, data = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["block", "kind", "data"])
        shard, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] != 1:
                    yield out([(r["block"], r["kind"], r["data"])])
                    continue
                if r["shard"] != shard and held:
                    for x in solve(held):
                        yield out([x])
                    held = []
                shard = r["shard"]
                held.append((r["block"], r["data"]))
        if held:
            for x in solve(held):
                yield out([x])

    def total_up(batches):
        """Rows of a block lie together, its documents (kind 0) first."""
        n, v = shared.value[3:5]
        now, meta, score, base, known = None, None, None, None, None

        def done():
            ids, null, size, held = meta
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": size, "n_known": known,
                "train_tokens": np.full(len(ids), n, np.int64), "base_score": base - size * np.log10(n + v + 1.0), "score": score - np.log10(train_docs + MU)})
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if meta is not None:
                        yield done()
                    now, meta = r["block"], unpack(r["data"], DOCS)
                    k = len(meta[0])
                    score, base, known = np.zeros(k), np.zeros(k), np.zeros(k, np.int64)
                else:
                    assert r["block"] == now
                    at, s, b, c = unpack(r["data"], SUMS)
                    score[at] += s
                    base[at] += b
                    known[at] += c
        if meta is not None:
            yield done()
    sent = rows.mapInArrow(tidy(send), "shard int, block long, kind int, data binary")
    parts = min(shards, MAX_PARTS)              # a task solves its shards one after another
    answers = sent.repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("shard").mapInArrow(tidy(answer), "block long, kind int, data binary")
    return (answers.repartition(parts, "block").sortWithinPartitions("block", "kind")
            .mapInArrow(tidy(total_up), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
