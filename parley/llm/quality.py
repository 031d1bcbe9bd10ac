"""Quality rules with risk-controlled cutoffs.

``features`` counts, per whole text, what the rules look at (one map-only pass).
``cutoffs`` picks each rule's cutoff per stratum (language) from labelled rows:

- labelled documents are split by the CRC of their id into a *pick* and a
  *holdout* part;
- on the pick part a rule's candidates are the cutoffs that reject more bad than
  good documents, from the laxest to the strictest;
- on the holdout part the candidates are tested in that order by the exact
  binomial tail: a cutoff passes if, were its true false-rejection rate above
  ``risk / rules``, so few rejected good documents would have a probability of
  at most ``doubt / (rules * strata)``. Testing stops at the first failure, so
  the order needs no further correction, and Bonferroni covers rules and strata.

With confidence ``1 - doubt`` no stratum then loses more than ``risk`` of its
good documents to the rules. A stratum with too few labelled documents to show
that has no cutoff and rejects none. All labelled rows count; only counts by
(stratum, rule, value) leave the aggregation, and only one row per stratum and
rule the selection.

A null or empty text has no words. A null language is in the stratum of the empty one. Labels
that are null are no labels; of repeated label rows of a document the lowest counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parley.llm.binomial import tail
from parley.llm.common import flat, map_batches, rows_kept, segment_sums
from parley.session import cut_lineage

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: rule -> its value in [0, 1], rejected from the cutoff upwards
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
}
GRID = 256
RISK, DOUBT = 0.05, 0.05
#: Cutoffs are broadcast up to this many (stratum, rule) rows.
BROADCAST_ROWS = 20_000

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    key = (ids[:-2] * len(number) + ids[1:-1]) if len(number) < 1 << 20 else None
    if key is None or len(number) ** 3 >= 1 << 62:  # a key of three would not fit: number the pairs first
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * len(number) + ids[2:] if n * len(number) < 1 << 62 else np.unique(np.stack([pair[:-1], ids[2:]]), axis=1, return_inverse=True)[1]
    else:
        key = key * len(number) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k:n - 2 + k] |= twice
    return int(mark.sum())


def count_features(batch: pa.RecordBatch, column: str = "text") -> dict[str, np.ndarray]:
    raw, off = flat(batch, column)
    brk = _BREAK[raw]
    lead = ~brk
    lead[1:] &= brk[:-1]
    # a text's first byte starts a word even after the former text's last
    at = off[:-1][np.diff(off) > 0]
    lead[at] = ~brk[at]
    first = (raw & 0xC0) != 0x80
    cap = _CAPITAL[raw]
    two = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.zeros(0, np.int64)
    cap[two] |= (raw[two + 1] >= 0x80) & (raw[two + 1] <= 0x9E)
    out = {"n_words": segment_sums(lead, off), "word_chars": segment_sums(first & ~brk, off),
           "n_symbols": segment_sums(_SYMBOL[raw], off), "n_capitals": segment_sums(cap, off)}
    n = len(off) - 1
    dup, lines, repeat = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    data, ends = raw.tobytes(), off.tolist()
    for k in range(n):
        text = data[ends[k]:ends[k + 1]]
        words = text.split()
        repeat[k] = repeat_words(words)
        if b"\n" in text:
            with_word = [x for x in text.split(b"\n") if x.strip()]
            lines[k] = len(with_word)
            dup[k] = len(with_word) - len(set(with_word))
        elif words:
            lines[k] = 1
    return out | {"n_dup_lines": dup, "n_lines": lines, "n_repeat_words": repeat}


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per document: doc_id, stratum and the counts of ``COUNTS``."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{stratum_col}`"), F.lit("")).alias("stratum"))

    def make():
        return lambda batch: {"doc_id": batch.column(0), "stratum": batch.column(2)} | {c: v for c, v in count_features(batch).items()}
    found = map_batches(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_capitals long, n_dup_lines long, n_lines long, n_repeat_words long", make)
    return found.select("doc_id", "stratum", *COUNTS)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _step(top: str, bottom: str):
    """A rule's value as a step of the grid."""
    return F.least(F.lit(GRID), F.floor(F.lit(GRID) * F.col(top) / F.greatest(F.col(bottom), F.lit(1)))).cast("int")


def choose(counts, rules: int, strata: int, risk: float, doubt: float) -> list[tuple[str, int]]:
    """(rule, first rejected step) of one stratum from a pandas table of counts by rule and step:
    pick_good, pick_bad, hold_good, hold_bad."""
    out = []
    for rule, part in counts.groupby("rule"):
        steps = np.zeros((4, GRID + 1), np.int64)
        for c, name in enumerate(("pick_good", "pick_bad", "hold_good", "hold_bad")):
            np.add.at(steps[c], part["step"].to_numpy(), part[name].to_numpy())
        above = steps[:, ::-1].cumsum(1)[:, ::-1]
        n_good = int(above[2, 0])
        best = None
        for step in range(GRID, 0, -1):
            good, bad = int(above[0, step]), int(above[1, step])
            if bad + good == 0 or steps[:, step].sum() == 0:
                continue
            if good > risk / rules * above[0, 0]:
                break                                     # stricter cutoffs lose more
            if good > bad:
                continue                                  # no candidate; a stricter cutoff may be one
            if n_good == 0 or tail(int(above[2, step]), n_good, risk / rules) > doubt / (rules * strata):
                break
            best = step
        if best is not None:
            out.append((str(rule), best))
    return out


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(stratum, symbols, capitals, …): each rule's first rejected step, null where none is certified."""
    label = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    hold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    good = F.col("quality") == 1
    rows = found.where(~base_failed()).join(label, "doc_id").select(
        "stratum", F.explode(F.create_map(*[x for r, (a, b) in RULES.items() for x in (F.lit(r), _step(a, b))])).alias("rule", "step"),
        (~hold & good).cast("long").alias("pick_good"), (~hold & ~good).cast("long").alias("pick_bad"),
        (hold & good).cast("long").alias("hold_good"), (hold & ~good).cast("long").alias("hold_bad"))
    names = ("pick_good", "pick_bad", "hold_good", "hold_bad")
    counts = cut_lineage(rows.groupBy("stratum", "rule", "step").agg(*[F.sum(n).alias(n) for n in names]), "quality-counts")
    strata = counts.select("stratum").distinct().count()
    rules = len(RULES)

    def pick(part):
        import pandas as pd
        got = dict(choose(part, rules, strata, risk, doubt))
        return pd.DataFrame([[part["stratum"].iloc[0], *[got.get(r) for r in RULES]]], columns=["stratum", *RULES])
    schema = "stratum string, " + ", ".join(f"{r} double" for r in RULES)
    # a stratum's group holds a row per rule and step: bounded
    return counts.groupBy("stratum").applyInPandas(pick, schema)


def judged(found: DataFrame, cuts: DataFrame) -> DataFrame:
    """``found`` with base_failed, the rules that reject, and kept."""
    cuts = cut_lineage(cuts, "quality-cutoffs").select(F.col("stratum"), *[F.col(r).alias(f"cut_{r}") for r in RULES])
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts
    failing = F.array_compact(F.array(*[F.when(_step(a, b) >= F.col(f"cut_{r}"), F.lit(r)) for r, (a, b) in RULES.items()]))
    return (found.join(cuts, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("failed_rules", failing)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, failed_rules, stratum."""
    found = cut_lineage(features(docs), "quality-features")   # narrow; used for the cutoffs and the verdicts
    out = judged(found, cutoffs(found, labels, risk, doubt))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules", "stratum")


def kept_rows(docs: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep. The texts are read
    twice (cutoffs, then verdicts) and never shuffled; the cutoffs, a row per
    language, go to the tasks."""
    found = features(docs)
    cuts = cutoffs(cut_lineage(found, "quality-features"), labels, risk, doubt)
    rows = cuts.limit(BROADCAST_ROWS + 1).collect()           # one per stratum
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("more strata than cutoffs can be sent to the tasks")
    table = {r["stratum"]: {rule: r[rule] for rule in RULES} for r in rows}

    def make():
        def keep(batch: pa.RecordBatch) -> np.ndarray:
            c = count_features(batch)
            ok = ~((c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]))
            lang = [x or "" for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()]
            for rule, (a, b) in RULES.items():
                step = np.minimum(GRID, np.floor(GRID * (c[a] / np.maximum(c[b], 1))))
                cut = np.array([np.inf if (v := table.get(s, {}).get(rule)) is None else v for s in lang])
                ok &= step < cut
            return ok
        return keep
    return rows_kept(docs, make)
