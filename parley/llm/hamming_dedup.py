"""Near-duplicate groups: b-bit MinHash signatures in a multi-index Hamming join.

A document is its set of word shingles (64-bit hashes). Documents with the same
set are one class. A class has a signature of ``SLOTS`` minima, 16 bits of each.
Two sets at the similarity threshold differ in more than T slots with probability
at most ``MISS``, which fixes T. By pigeonhole, of M chunks of a signature pair at
distance T = M r + a, one of the first a + 1 has at most r errors or one of the
others at most r - 1; the join enumerates the errors by leaving out each choice of
r slots of a chunk, so every pair within T meets under at least one key.

Buckets never emit all their pairs:

1. star: every member is compared with its bucket's least class, and the links
   found are joined to components;
2. buckets of at most ``CAP`` members give their pairs across components;
3. classes of larger buckets go through an exact prefix join over their whole sets
   (rarest shingles first, length and position bounds), again across components
   only, so that the cap loses nothing.

Links are confirmed on full sets. Exact copies and links inside a component need
no further comparison, as they change no component.

A null or empty text, or one without words, has an empty set and no links. Rows
with the same doc_id are one node of the link graph. A row without a doc_id
belongs to its class, whose component the others name; it is kept only if all of
its class have no id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from parley.llm.binomial import tail
from parley.llm.common import flat, map_batches, ragged, text_rows, tidy
from parley.llm.graph import components
from parley.llm.hashing import RNG, R, mix, word_hashes
from parley.session import cut_lineage

SHINGLE, PERCENT = 5, 85
SLOTS, CHUNK, MISS = 128, 4, 1e-6
CAP = 50
#: Ids are sent to all tasks up to this many (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 2_000_000

_PLACE = RNG.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_MUL = RNG.integers(0, 1 << 32, (2, SLOTS), np.uint32) | np.uint32(1)


def shingles(batch: pa.RecordBatch, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    n = batch.num_rows
    word, per = word_hashes(*flat(batch))
    with np.errstate(over="ignore"):
        long = np.maximum(per - size + 1, 0)
        first = np.cumsum(per) - per
        hash_at = ragged(first, long)
        value = np.zeros(len(hash_at), np.uint64)
        for k in range(size):
            value += word[hash_at + k] * _PLACE[k]
        value = mix(value)
        out = []
        cut = np.concatenate([[0], np.cumsum(long)]).tolist()
        for d in range(n):
            if long[d]:
                out.append(np.unique(value[cut[d]:cut[d + 1]]))
            elif per[d]:                                        # fewer words: the whole sequence
                w = word[first[d]:first[d] + per[d]]
                out.append(mix(np.array([(w * _PLACE[:len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """16 bits of the least hash under each of SLOTS functions."""
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(values), 4096):
        h = low[k:k + 4096, None] * _MUL[0] + high[k:k + 4096, None] * _MUL[1]
        np.minimum(least, h.min(0), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def distance_threshold(percent: int = PERCENT) -> int:
    """Least T that pairs at the threshold exceed with probability at most MISS."""
    p = 1 - percent / 100
    return next(t for t in range(SLOTS) if 1 - tail(t, SLOTS, p) <= MISS)


def key_plan(threshold: int) -> list[tuple[int, ...]]:
    """Slots of each key."""
    chunks = [tuple(range(k, k + CHUNK)) for k in range(0, SLOTS, CHUNK)]
    r, a = divmod(threshold, len(chunks))
    out = []
    for k, c in enumerate(chunks):
        errors = r if k <= a else r - 1
        if errors >= 0:
            out += combinations(c, CHUNK - min(errors, CHUNK - 1))
    return out


def _digests(sets: list[np.ndarray]) -> dict:
    """n, d1, d2 of each set."""
    with np.errstate(over="ignore"):
        one = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
        two = [int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
    return {"n": pa.array([len(s) for s in sets], pa.int64()), "d1": pa.array(one, pa.int64()), "d2": pa.array(two, pa.int64())}


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, digest of the set, signature."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = shingles(batch)
            sig = [signature(s).tobytes() if len(s) else None for s in sets]
            return {"doc_id": batch.column(0)} | _digests(sets) | {"sig": pa.array(sig, pa.binary())}
        return work
    return map_batches(text_rows(docs, id_col, text_col), "doc_id long, n long, d1 long, d2 long, sig binary", make)


def _keys(classes: DataFrame, plan: list[tuple[int, ...]]) -> DataFrame:
    """(key, rep) rows."""
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for k in range(0, batch.num_rows, 4096):
                    part = batch.slice(k, 4096)
                    sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, SLOTS).astype(np.uint64)
                    rep = part.column(0)
                    for n, slots in enumerate(plan):
                        key = np.full(len(sig), n + 1, np.uint64) * R
                        for s in slots:
                            key = mix(key + sig[:, s])
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rep], names=["key", "rep"])
    return classes.select("rep", "sig").mapInArrow(tidy(run), "key long, rep long")


def _within(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose signatures differ in at most ``threshold`` slots."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                part = batch.slice(k, 8192)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, SLOTS) for c in (2, 3))
                near = (a != b).sum(1) <= threshold
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(near))
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), "a long, b long")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an id in ``ids`` (doc_id)."""
    ids = cut_lineage(ids.distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, n, set) of the documents with an id in ``ids``; the set as sorted 64-bit hashes."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = shingles(batch)
            return {"rep": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "set": pa.array([s.tobytes() for s in sets], pa.binary())}
        return work
    return map_batches(_only(docs, ids), "rep long, n long, set binary", make)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links, by their full sets."""
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ok = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    inter = int((both[1:] == both[:-1]).sum())
                    ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long")


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    named = lambda x: comp.select(F.col("node").alias(x), F.col("label").alias(f"c{x}"))
    return (pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
            .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))


def _prefix_pairs(docs: DataFrame, hot: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Exact candidate pairs among the classes ``hot`` (doc_id): the all-pairs prefix join."""
    t = percent
    rows = map_batches(_only(docs, hot), "rep long, n long, shingle array<long>", lambda: lambda batch: _exploded(batch))
    rows = cut_lineage(rows.select("rep", "n", F.explode("shingle").alias("shingle")), "hot-sets")
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one set alone come first and match nothing: they only move the others back
    shared = rows.join(often, "shingle")
    alone = F.col("n") - F.count("*").over(W.partitionBy("rep", "n"))
    place = F.row_number().over(W.partitionBy("rep", "n").orderBy("df", "shingle")) - 1
    ranked = shared.withColumn("pos", alone + place).join(comp.select(F.col("node").alias("rep"), "label"), "rep", "left")
    ranked = ranked.select("rep", "n", "shingle", "pos", F.coalesce("label", "rep").alias("c"))
    ceil = lambda top, bottom: F.floor((top + (bottom - 1)) / F.lit(bottom))
    probe = ranked.where(F.col("pos") < F.col("n") - ceil(F.col("n") * t, 100) + 1)
    probe = cut_lineage(probe, "hot-prefixes")
    # a shingle of one component alone can give no pair, however many rows have it
    mixed = probe.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("shingle")
    probe = cut_lineage(probe.join(mixed, "shingle", "left_semi"), "mixed-prefixes")
    index = probe.where(F.col("pos") < F.col("n") - ceil(F.col("n") * 2 * t, 100 + t) + 1)
    x, y = probe.alias("x"), index.alias("y")
    need = ceil((F.col("x.n") + F.col("y.n")) * t, 100 + t)
    joined = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.c") != F.col("y.c"))
                    & ((F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.rep") < F.col("x.rep"))))
                    & (100 * F.col("y.n") >= t * F.col("x.n"))
                    & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= need))
    return joined.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _exploded(batch: pa.RecordBatch) -> dict:
    sets = shingles(batch)
    return {"rep": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "shingle": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}


def _labelled(docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, d1, d2) of each row, (d1, d2, rep, component) of each class)."""
    rows = text_rows(docs, id_col, text_col)
    found = cut_lineage(signed(docs, id_col, text_col), "signatures")
    whole = found.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut_lineage(whole, "classes")
    known = classes.where("rep is not null")
    threshold = distance_threshold(percent)
    keys = _keys(known, key_plan(threshold))
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(keys.join(hubs, "key"), "buckets")

    star = members.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    star = cut_lineage(_within(star, known, threshold), "star")
    hot = cut_lineage(members.where(F.col("size") > CAP).select(F.col("rep").alias("doc_id")).distinct(), "hot")

    used = star.select(F.col("a").alias("doc_id")).unionByName(star.select(F.col("b").alias("doc_id")))
    links = cut_lineage(_confirmed(star, cut_lineage(_sets(rows, used), "sets"), percent), "links")
    comp = components(links)

    small = members.where(F.col("size") <= CAP).join(comp.select(F.col("node").alias("rep"), "label"), "rep", "left")
    small = small.select("key", F.struct(F.coalesce("label", "rep").alias("c"), "rep").alias("m"))
    bucket = small.groupBy("key").agg(F.sort_array(F.collect_set("m")).alias("m"), F.min("m.c").alias("lo"), F.max("m.c").alias("hi")).where("lo != hi")
    pairs = F.expr("""filter(flatten(transform(sequence(1, size(m) - 1), i -> transform(slice(m, i + 1, size(m)), y ->
                   named_struct('a', least(m[i - 1].rep, y.rep), 'b', greatest(m[i - 1].rep, y.rep), 'same', m[i - 1].c = y.c)))), p -> not p.same)""")
    cross = bucket.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct().join(star, ["a", "b"], "left_anti")
    cross = _within(cross, known, threshold)
    if not hot.isEmpty():
        cross = cross.unionByName(_prefix_pairs(rows, hot, comp, percent)).distinct().join(star, ["a", "b"], "left_anti")
    cross = cut_lineage(cross, "cross")
    if not cross.isEmpty():
        used = cross.select(F.col("a").alias("doc_id")).unionByName(cross.select(F.col("b").alias("doc_id")))
        more = cut_lineage(_confirmed(cross, cut_lineage(_sets(rows, used), "sets"), percent), "links")
        if not more.isEmpty():
            comp = components(links.unionByName(more))
    label = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "rep", F.coalesce("label", "rep").alias("component"))
    return found.drop("sig"), label


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return _verdicts(*_labelled(docs, percent, id_col, text_col))


def _verdicts(found: DataFrame, label: DataFrame) -> DataFrame:
    # every class of a set has one row here; documents without words have none
    out = found.join(label, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def first_of_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group.

    Rows whose doc_id is null or not theirs alone are judged one by one, by the
    digest of their set: of a class that stays, one row does. Different texts of a
    repeated doc_id that stays all stay, and so do rows without words."""
    found, label = _labelled(docs, percent)
    gone = _verdicts(found, label).where("not kept and doc_id is not null").select("doc_id").distinct()
    several = cut_lineage(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "several")
    gone = cut_lineage(gone.unionByName(several.where("doc_id is not null")).distinct(), "gone")
    sent = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    alone = docs.join(sent(gone), "doc_id", "left_anti").select(docs.columns)
    if several.isEmpty():
        return alone
    odd = docs.join(sent(several), docs["doc_id"].eqNullSafe(several["doc_id"]), "left_semi")
    odd = odd.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text"))

    def make():
        return lambda batch: {"row": batch.column(0), "id": batch.column(1)} | _digests(shingles(batch))
    schema = T.StructType([odd.schema["row"], *(T.StructField(c, T.LongType()) for c in ("id", "n", "d1", "d2"))])
    judged = map_batches(odd, schema, make)
    judged = cut_lineage(judged, "repeated-ids")
    stays = label.where("rep is null or rep = component")
    # one row of a class, picked in each task before the shuffle
    one = (judged.where("n > 0").join(stays, ["d1", "d2"]).where(F.col("id").eqNullSafe(F.col("rep")))
           .groupBy("d1", "d2").agg(F.first("row").alias("row")).select("row.*"))
    alone = alone.where("doc_id is not null")
    return alone.unionByName(one).unionByName(judged.where("n = 0").select("row.*"))
