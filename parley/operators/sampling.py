"""Exact, reproducible per-class sampling and stratified splitting.

Rows are ordered inside their class by ``md5(salt:source:id)`` (then id). A
class's first ``q`` rows in that order are found without a window over the
whole class (which would put a class — possibly a third of all rows — into
one task):

1. the (class, key, id) rows, without the text, are written once;
2. count rows per (class, first 3 hex digits), a partial aggregate; a running sum
   gives the bucket in which the class's quota ends;
3. that bucket is narrowed by 3 more digits at a time until it is small, and
   ``row_number`` over it gives the key of the quota's last row;
4. one map-only filter keeps, of the whole rows, those up to that key.

The result is identical to ``row_number() over (partition by class order by
hash, id) <= q``, which is what the oracle computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import cut_lineage

SEED = "42"
PREFIX_HEX = 3
KEY_HEX = 32
# Most rows (key and tie alone) of the boundary bucket that one task sorts.
BUCKET_ROWS = 1_000_000
MAX_CLASSES = 64


def order_key(salt: str, source: Column, ident: Column) -> Column:
    """A row's place in the order of its class; a null counts as empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(salt + ":"), part(source), F.lit(":"), part(ident)))


def _boundaries(counts: DataFrame, group: str, quotas: dict) -> dict:
    """Per group with a quota inside its rows: (bucket that the quota's last row is in,
    rows still wanted of it, its size). ``counts``: (group, _b, _c); only one row a
    group reaches the driver."""
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("_c").over(w))
    room = F.lit(None).cast("long")
    for g, quota in quotas.items():
        room = F.when(F.col(group) == g, F.lit(quota) - F.col("_upto") + F.col("_c")).otherwise(room)
    hit = upto.withColumn("_room", room).where((F.col("_room") > 0) & (F.col("_room") <= F.col("_c")))
    return {r[group]: (r["_b"], r["_room"], r["_c"]) for r in hit.select(group, "_b", "_room", "_c").collect()}


def cutoffs(keys: DataFrame, group: str, key: str, tie: str, quotas: dict,
            bucket_rows: int = BUCKET_ROWS) -> dict:
    """``{group: (key, tie, wanted, all)}`` of the last row within each group's quota,
    how many rows of that key and tie are wanted, and how many there are; a group
    whose rows all are wanted has none. The bucket of keys that holds it is narrowed to
    longer prefixes until it has at most ``bucket_rows`` rows (or all of the key is
    used), so the only sort is of that many (key, tie) pairs."""
    digits = PREFIX_HEX
    counts = keys.groupBy(group, F.substring(key, 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    found = _boundaries(counts, group, quotas)
    while digits < KEY_HEX and any(c > bucket_rows for _, _, c in found.values()):
        inside = _inside(group, key, found)
        digits += PREFIX_HEX
        counts = keys.where(inside).groupBy(group, F.substring(key, 1, digits).alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"))
        found = _boundaries(counts, group, {g: room for g, (_, room, _) in found.items()})
    if not found:
        return {}
    # equal rows are counted, not sorted one by one: their number has no bound
    equal = keys.where(_inside(group, key, found)).groupBy(group, key, tie).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(group).orderBy(key, tie).rowsBetween(Window.unboundedPreceding, 0)
    last = F.lit(False)
    for g, (_, room, _) in found.items():
        last = last | ((F.col(group) == g) & (F.col("_upto") >= room) & (F.col("_upto") - F.col("_n") < room))
    rows = equal.withColumn("_upto", F.sum("_n").over(order)).where(last).collect()
    return {r[group]: (r[key], r[tie], found[r[group]][1] - r["_upto"] + r["_n"], r["_n"]) for r in rows}


def _inside(group: str, key: str, found: dict):
    inside = F.lit(False)
    for g, (bucket, _, _) in found.items():
        inside = inside | ((F.col(group) == g) & F.col(key).startswith(bucket))
    return inside


def flag_first_n(df: DataFrame, group: str, key: str, tie: str, quotas, flag: str,
                 keep_only: bool = False) -> DataFrame:
    """Add boolean ``flag``: row is among the first ``quota`` rows of its group
    in (key, tie) order. ``quotas`` has columns (group, quota), or makes them of the
    (group, key, tie) rows. Those narrow rows are written once; the rows of ``df`` are
    read once more, by a filter that moves nothing. Groups without a quota go."""
    keys = cut_lineage(df.select(group, key, tie), "keys")
    table = quotas(keys) if callable(quotas) else quotas
    wanted = {r[0]: r[1] for r in table.select(group, "quota").limit(MAX_CLASSES + 1).collect()}
    if len(wanted) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    last = cutoffs(keys, group, key, tie, {g: n for g, n in wanted.items() if n > 0})
    within, at_cut, split = F.lit(None).cast("boolean"), F.lit(False), {}
    for g, quota in wanted.items():
        ok = F.lit(quota > 0)
        if g in last:
            k, t, some, every = last[g]
            before = F.col(tie).isNull() if t is None else F.col(tie).isNull() | (F.col(tie) <= t)
            ok = (F.col(key) < k) | ((F.col(key) == k) & before)
            if some < every:
                split[g] = some
                at_cut = at_cut | ((F.col(group) == g) & (F.col(key) == k) & F.col(tie).eqNullSafe(F.lit(t)))
        within = F.when(F.col(group) == g, ok).otherwise(within)
    out = df.withColumn(flag, within)
    if split:
        # the quota ends among rows of one key and tie: they alone get numbers, which order them
        ties = cut_lineage(df.where(at_cut).withColumn("_no", F.monotonically_increasing_id()), "ties").withColumn(
            "_no_key", F.md5(F.col("_no").cast("string")))
        table = df.sparkSession.createDataFrame(list(split.items()), table.select(group, "quota").schema)
        flagged = flag_first_n(ties, group, "_no_key", "_no", table, flag).drop("_no", "_no_key")
        out = out.where(~at_cut).unionByName(flagged.select(out.columns))
    return out.where(F.col(flag) if keep_only else F.col(flag).isNotNull())


def flag_first_n_window(df: DataFrame, group: str, key: str, tie: str,
                        quotas: DataFrame, flag: str) -> DataFrame:
    """Reference form of ``flag_first_n`` (one window per class); used in tests."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(key, tie))
    return df.join(F.broadcast(quotas), group).withColumn(flag, rn <= F.col("quota")).drop("quota")


def balanced_quotas(df: DataFrame, label: str = "label") -> DataFrame:
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return per.select(label, F.min("n").over(Window.partitionBy()).alias("quota"))


def balanced_sample(corpus: DataFrame, label: str = "label") -> DataFrame:
    """Exactly ``n = min(class sizes)`` rows of every class, without
    replacement, reproducible (seed 42)."""
    keyed = corpus.withColumn("_k", order_key(SEED, F.col("source"), F.col("id")))
    out = flag_first_n(keyed, label, "_k", "id", lambda keys: balanced_quotas(keys, label),
                       "_keep", keep_only=True)
    return out.drop("_k", "_keep")


def split_quotas(df: DataFrame, label: str = "label", test_size: float = 0.2) -> DataFrame:
    """Per-class test quota of a stratified split. Test size is
    ``ceil(test_size * N)`` in double arithmetic; the train size is spread over
    the classes proportionally, remainders going to the largest fractional
    parts first (ties: smaller label first); each class's test quota is the
    rest of the class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    everything = Window.partitionBy()
    n_all = F.sum("c").over(everything)
    n_test = F.ceil(F.lit(float(test_size)) * n_all.cast("double"))
    per = per.withColumn("_cont", F.col("c").cast("double") / n_all * (n_all - n_test))
    per = per.withColumn("_floor", F.floor("_cont"))
    per = per.withColumn("_need", (n_all - n_test) - F.sum("_floor").over(everything))
    per = per.withColumn("_pos", F.row_number().over(
        Window.partitionBy().orderBy(F.desc(F.col("_cont") - F.col("_floor")), F.col(label))))
    train_q = F.col("_floor") + F.when(F.col("_pos") <= F.col("_need"), 1).otherwise(0)
    return per.select(label, (F.col("c") - train_q).cast("long").alias("quota"))


def stratified_split(corpus: DataFrame, label: str = "label",
                     test_size: float = 0.2) -> DataFrame:
    """Adds ``split`` = 'test' | 'train'; classes keep their proportions."""
    keyed = corpus.withColumn("_k", order_key(SEED + ":split", F.col("source"), F.col("id")))
    out = flag_first_n(keyed, label, "_k", "id", lambda keys: split_quotas(keys, label, test_size), "_test")
    return (out.withColumn("split", F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train")))
            .drop("_k", "_test"))


def training_split(corpus: DataFrame, label: str = "label", test_size: float = 0.2) -> DataFrame:
    """corpus -> balanced sample -> stratified split. Each step reads its input
    twice (keys, whole rows), so the balanced
    sample (2n rows) is materialised once."""
    balanced = cut_lineage(balanced_sample(corpus, label), "balanced")
    return stratified_split(balanced, label, test_size)
