"""Merkle manifest of a dataset: leaves, subroots per language, root, and a proof per row.

DataFrame functions only. Each tree is folded by a nested-struct rollup:

1. a leaf's rank in its tree comes from one range sort and counts per (range, tree);
2. the rank's digits (base 16) become columns; the lowest is grouped away first, a
   group's children nest in their parent's struct, then the next digit; ``DIGITS`` of
   them make a block of 256 leaves, so no row ever nests more than a block;
3. the blocks' hashes are the leaves of the next tier, until each tree has one node;
   the trees' hashes (subroots), ordered by language, form one more tree;
4. from the root down, a tier's upper path meets its nested blocks in a group of two
   rows (a block and its path), and a transform and an explode emit every child with
   its own path. Nothing is joined there.

A path is an array of (left, right), one for each level: the sibling's hash on its
side, both null for a node without sibling. Every tier is written to the checkpoint
folder, so that a lost executor repeats tasks of one tier only.

Nulls in any column are hashed as ``-``; rows without a language are a tree of their
own, the first; rows without an id come first in their tree and count as untampered.
Rows with equal ids are ordered by leaf hash; whole equal rows are interchangeable and
each keeps its own place. An empty text is ``0:``. A text is hashed whole, in the JVM,
whatever its length. An empty table gives no rows. Columns beyond the five that are
hashed are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parley.plans.sizing import broadcast_if_small
from parley.session import cut_lineage

#: Leaves of a nested group, as bits of the rank, and groups nested in a block.
BITS, DIGITS = 4, 2
BLOCK_BITS = BITS * DIGITS
#: Tampering adds 1 to n_chars where this divides the id's crc32.
TAMPER_EVERY = 7
IN_PARTITION = (1 << 33) - 1
PATH = "array<struct<left:string,right:string>>"


def H(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated strings; a null part adds nothing."""
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as ``length:value`` in UTF-8 bytes, null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, tampered: the leaf as it would be after tampering (else null)."""
    c = lambda name: F.col(f"`{name}`")
    hashed = lambda n_chars: H(*[field(x) for x in (c("doc_id"), c("source"), c("lang"), n_chars, c("text"))])
    touched = (F.crc32(c("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0) & c("n_chars").isNotNull()
    return docs.select(c("doc_id").alias("doc_id"), c("lang").alias("lang"), hashed(c("n_chars")).alias("leaf"),
                       F.when(touched, hashed(c("n_chars").cast("decimal(20,0)") + 1)).alias("tampered"))


def ranked(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (place in its tree, from 0) and ``n`` (leaves of its tree).

    A tree may hold all rows: the rows are cut into ranges of (tree, order), and a
    row's place is its place in the range plus the tree's rows in earlier ranges."""
    keys = [F.col(tree).asc_nulls_first(), *[F.col(x).asc_nulls_first() for x in order]]
    held = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .withColumn("_row", F.monotonically_increasing_id()), name)
    held = held.withColumn("_part", F.shiftright("_row", 33)).withColumn("_row", F.col("_row").bitwiseAND(IN_PARTITION))
    runs = held.groupBy(tree, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    # one row for each tree and range: at most ranges + trees of them
    runs = runs.selectExpr(
        f"{tree} AS _tree", "_part AS _range", f"sum(_rows) OVER (PARTITION BY {tree}) AS n",
        f"sum(_rows) OVER (PARTITION BY {tree} ORDER BY _part) - _rows - _first AS _shift")
    runs, _ = broadcast_if_small(cut_lineage(runs, f"{name}-runs"), "ranges of the leaves", 200_000)
    return (held.join(runs, (F.col("_part") == F.col("_range")) & F.col(tree).eqNullSafe(F.col("_tree")))
            .withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_tree", "_range", "_shift"))


def _paired(level: int, below: Column) -> Column:
    """The next level's hashes. A level is paired only while its tree has more than
    one node there (n > 2^level); the last of an odd number is hashed alone."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(below) - 1, F.lit(2)), lambda i: H(F.get(below, i), F.get(below, i + 1)))
    return F.when(F.col("n") > F.lit(1 << level), pairs).otherwise(below)


def _path(node: Column, digit: Column, level: int, n: Column) -> Column:
    """(left, right) of the child ``digit`` of a node at its ``BITS`` levels."""
    steps = []
    for k in range(BITS):
        at = F.shiftright(digit, k)
        here, odd = node["levels"][k], at % 2 == 1
        steps.append(F.when(n > F.lit(1 << level + k), F.struct(F.when(odd, F.get(here, at - 1)).alias("left"),
                                                                F.when(~odd, F.get(here, at + 1)).alias("right"))))
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def nested(rows: DataFrame, tree: str, tier: int) -> DataFrame:
    """Blocks of a tier: tree, n, block, node (nested structs), h (the block's hash).

    ``rows`` has tree, n, pos, h and ``item`` (what a leaf carries). The digits of the
    rank are grouped away, lowest first; all groups of a block lie in one partition."""
    level = tier * BLOCK_BITS
    digit = lambda k: F.shiftright("pos", k * BITS).bitwiseAND((1 << BITS) - 1).cast("int")
    keys = [tree, "n", "block"]
    out = rows.select(tree, "n", F.shiftright("pos", BLOCK_BITS).alias("block"), *[digit(k).alias(f"d{k}") for k in range(DIGITS)],
                      "h", F.col("item").alias("body")).repartition(tree, "block")
    for k in range(DIGITS):
        out = out.groupBy(*keys, *[f"d{j}" for j in range(k + 1, DIGITS)]).agg(
            F.array_sort(F.collect_list(F.struct(f"d{k}", "h", "body"))).alias("kids"))
        out = out.withColumn("_l0", F.transform("kids", lambda c: c["h"]))
        for j in range(BITS):                    # a column each: nested expressions would be computed many times
            out = out.withColumn(f"_l{j + 1}", _paired(level + k * BITS + j, F.col(f"_l{j}")))
        out = out.select(*keys, *[f"d{j}" for j in range(k + 1, DIGITS)], F.get(F.col(f"_l{BITS}"), F.lit(0)).alias("h"),
                         F.struct("kids", F.array(*[f"_l{j}" for j in range(BITS)]).alias("levels")).alias("body"))
    return out.select(tree, "n", "block", "h", F.col("body").alias("node"))


def emitted(blocks: DataFrame, tree: str, tier: int, upper: DataFrame | None) -> DataFrame:
    """One row for each leaf of the blocks: tree, pos, item, path (from the leaf up), top.

    ``upper`` has tree, pos (the block's number), path and top, the path from the block
    up; without it the blocks are whole trees, and their hash is the top."""
    level = tier * BLOCK_BITS
    if upper is None:
        met = blocks.select(tree, "n", "block", "node", F.array().cast(PATH).alias("path"), F.struct(F.col("h").alias("subroot")).alias("top"))
    else:
        up = upper.select(F.col(tree), F.col("pos").alias("block"), "path", "top")
        both = blocks.select(tree, "n", "block", "node").unionByName(up, allowMissingColumns=True)
        met = both.groupBy(tree, "block").agg(*[F.first(x, ignorenulls=True).alias(x) for x in ("n", "node", "path", "top")])

    def children(node: Column, k: int, above: Column) -> Column:
        """(digits above it, item, path) of all leaves below a node at digit ``k``."""
        def one(c: Column) -> Column:
            path = F.concat(_path(node, c[f"d{k}"], level + k * BITS, F.col("n")), above)
            if k == 0:
                return F.array(F.struct(c["d0"].cast("long").alias("at"), c["body"].alias("item"), path.alias("path")))
            inner = children(c["body"], k - 1, path)
            return F.transform(inner, lambda x: F.struct((F.shiftleft(c[f"d{k}"].cast("long"), k * BITS) + x["at"]).alias("at"), x["item"].alias("item"), x["path"].alias("path")))
        return F.flatten(F.transform(node["kids"], one))
    out = met.select(tree, "block", "top", F.explode(children(F.col("node"), DIGITS - 1, F.col("path"))).alias("leaf"))
    return out.select(tree, (F.shiftleft("block", BLOCK_BITS) + F.col("leaf.at")).alias("pos"), F.col("leaf.item").alias("item"), F.col("leaf.path").alias("path"), "top")


def forest(rows: DataFrame, tree: str, name: str) -> list[DataFrame]:
    """The written tiers of blocks over ``rows`` (tree, n, pos, h, item), lowest first;
    the last has one block for each tree."""
    tiers: list[DataFrame] = []
    most = rows.agg(F.max("n")).first()[0] or 0
    while True:
        tiers.append(cut_lineage(nested(rows, tree, len(tiers)), f"{name}-tier{len(tiers)}"))
        if most <= 1 << len(tiers) * BLOCK_BITS:
            return tiers
        rows = tiers[-1].select(tree, "n", F.col("block").alias("pos"), "h", F.struct("block").alias("item"))


def unfolded(tiers: list[DataFrame], tree: str, upper: DataFrame | None = None) -> DataFrame:
    """tree, pos, item, path, top of all leaves, from the last tier down."""
    for tier in reversed(range(len(tiers))):
        upper = emitted(tiers[tier], tree, tier, upper)
    return upper


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, leaf, tampered, path (from the leaf up), subroot, root."""
    rows = cut_lineage(leaves(docs).withColumn("tie", F.monotonically_increasing_id()), "leaves")
    rows = ranked(rows, "lang", ["doc_id", "leaf", "tie"], "ranked")
    low = forest(rows.select("lang", "n", "pos", F.col("leaf").alias("h"), F.struct("doc_id", "leaf", "tampered").alias("item")), "lang", "manifest")
    # the trees' hashes are the leaves of one tree over all of them
    subroots = ranked(low[-1].select(F.lit(0).alias("trees"), "lang", "h"), "trees", ["lang"], "subroots")
    high = forest(subroots.select("trees", "n", "pos", "h", F.struct("lang", "h").alias("item")), "trees", "root")
    tops = unfolded(high, "trees").select(F.col("item.lang").alias("lang"), F.lit(0).cast("long").alias("pos"), "path",
                                        F.struct(F.col("item.h").alias("subroot"), F.col("top.subroot").alias("root")).alias("top"))
    return unfolded(low, "lang", tops).select("item.doc_id", "lang", "item.leaf", "item.tampered", "path", "top.subroot", "top.root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: H(s["left"], h, s["right"]))


def verification(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (per row of ``docs``)."""
    siblings = F.transform("path", lambda s: F.coalesce(s["left"], s["right"], F.lit("")))
    out = manifest(docs).select("doc_id", "leaf", "subroot", "root", H(F.array_join(siblings, "")).alias("proof_sha256"),
                                folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
