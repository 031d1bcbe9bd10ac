"""Translation by a phrase lattice: the best path over all segmentations of a text.

A table of weighted entries ``(src, tgt, phrase, translation, score)`` gives the edges:
an entry whose phrase stands at a place of the text, whatever overlaps it, and for each
token an edge that passes it on as it is, at the score ``PASS``. A path's score is the
sum of its edges' scores and of the target bigrams' scores along its words, ``UNSEEN``
for a pair that the table ``(tgt, prev, next, score)`` lacks; a text begins and ends
with the word ``""``. Scores are whole numbers (thousandths of natural logarithms), so
sums are exact. Of equal paths to a place and last word the one with fewer edges stays,
then by the word before, the shorter last edge, and its translation.

Tokens are runs of letters, marks, digits and underscores, or single other characters,
each with the blanks before it; case doesn't count. An output has ``limit`` words at most.

The entries at a text's places and the pairs a path may take are found by joins, so both
tables may be of any size (Spark broadcasts one that is small); a written table gives
every row a number of its own, so ids may repeat or be null. What is joined back is one
array a row, of a length bounded by its text. Python decodes row by row in Arrow batches.

A null text has neither output nor error; an unsupported language is the row's error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.operators.translate import language_error
from parley.session import cut_lineage

PASS, UNSEEN = -8000, -12000
BLANK = r"[ \t\n\r\f]"
TOKEN = rf"{BLANK}*(?:[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_ \t\n\r\f])"


def tokens(text: Column) -> Column:
    """The text's tokens, blanks before a token as one space."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda t: F.regexp_replace(t, f"^{BLANK}+", " "))


def word(token: Column) -> Column:
    return F.lower(F.ltrim(token))


def words(text: Column) -> Column:
    """The ``word`` of each of the text's tokens, found without cutting them again."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"{BLANK}*({TOKEN.removeprefix(BLANK + '*')})"), 1), F.lower)


def _key(part: Column) -> Column:
    """What a run of tokens is looked up by."""
    return word(F.array_join(part, ""))


def entries(table: DataFrame) -> DataFrame:
    """``(src, tgt, phrase, translation)`` with scores: a phrase's translations are equally likely."""
    each = table.select("src", "tgt", "phrase", "translation").distinct()
    many = each.groupBy("src", "tgt", "phrase").agg(F.collect_list("translation").alias("all"))
    return many.select("src", "tgt", "phrase", F.explode("all").alias("translation"),
                       F.round(F.log(1 / F.size("all")) * 1000).cast("long").alias("score"))


def bigram_scores(texts: DataFrame, tgt: str, text: str = "text") -> DataFrame:
    """``(tgt, prev, next, score)`` of the pairs in the texts of a language."""
    w = F.concat(F.array(F.lit("")), words(F.col(text)), F.array(F.lit("")))
    pairs = (texts.where(F.col(text).isNotNull()).select(w.alias("w"))
             .select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("prev"), F.slice("w", 2, F.size("w") - 1).alias("next"))).alias("p"))
             .groupBy("p.prev", "p.next").agg(F.count("*").alias("n")))
    before = pairs.groupBy(F.col("prev").alias("_prev")).agg(F.sum("n").alias("_all"))
    return pairs.join(before, F.col("prev") == F.col("_prev")).select(
        F.lit(tgt).alias("tgt"), "prev", "next", F.round(F.log(F.col("n") / F.col("_all")) * 1000).cast("long").alias("score"))


def _scored_entries(table: DataFrame, bigrams: DataFrame) -> DataFrame:
    """src, tgt, key, size (tokens), out (words as written), first, last, score with the bigrams inside."""
    e = table.select("src", "tgt", "score", tokens(F.col("phrase")).alias("p"), F.split(F.trim("translation"), r"\s+").alias("out"))
    e = e.select("src", "tgt", "score", _key(F.col("p")).alias("key"), F.size("p").alias("size"), "out", F.transform("out", F.lower).alias("w"))
    e = e.where("size > 0").withColumn("_entry", F.xxhash64("src", "tgt", "key", F.array_join("out", " ")))
    inner = (e.where("size(w) > 1").select("_entry", "tgt", F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("prev"), F.slice("w", 2, F.size("w") - 1).alias("next"))).alias("p"))
             .select("_entry", "tgt", "p.prev", "p.next").join(bigrams.withColumnRenamed("score", "lm"), ["tgt", "prev", "next"], "left")
             .groupBy("_entry").agg(F.sum(F.coalesce("lm", F.lit(UNSEEN))).alias("_inner")))
    return e.join(inner, "_entry", "left").select(
        "src", "tgt", "key", "size", "out", F.col("w")[0].alias("first"), F.element_at("w", -1).alias("last"),
        (F.col("score") + F.coalesce("_inner", F.lit(0))).alias("score"))


def _runs(rows: DataFrame, most: int) -> DataFrame:
    """``_row, _src, _tgt, i, r`` (size, key): the runs of 1 to ``most`` tokens from each place i. A
    place takes along those few tokens, not its row's."""
    place = rows.select("_row", "_src", "_tgt", "_tokens", F.posexplode_outer("_tokens").alias("i", "_token")).where("i IS NOT NULL")
    span = place.select("_row", "_src", "_tgt", "i", F.slice("_tokens", F.col("i") + 1, F.lit(most)).alias("_span"))
    return span.select("_row", "_src", "_tgt", "i", F.explode_outer(F.transform(
        F.sequence(F.lit(1), F.size("_span")), lambda m: F.struct(m.alias("size"), _key(F.slice("_span", F.lit(1), m)).alias("key")))).alias("r"))


def lattices(rows: DataFrame, table: DataFrame, bigrams: DataFrame) -> DataFrame:
    """``rows`` (_row, _src, _tgt, _tokens) with ``edges`` and ``pairs``, a row's entries and bigrams."""
    found = cut_lineage(_scored_entries(table, bigrams), "lattice-entries")
    most = found.agg(F.max("size")).first()[0] or 0
    runs = _runs(rows, max(most, 1))
    edges = (runs.select("_row", "_src", "_tgt", "i", "r.key", "r.size")
             .join(found.withColumnsRenamed({"src": "_src", "tgt": "_tgt"}), ["_src", "_tgt", "key", "size"])
             .groupBy("_row").agg(F.collect_list(F.struct("i", "size", "out", "first", "last", "score")).alias("edges")))
    held = rows.join(edges, "_row", "left").withColumn("edges", F.coalesce("edges", F.expr("array()").cast(edges.schema["edges"].dataType)))
    held = cut_lineage(held, "lattice-edges")
    words = F.concat(F.array(F.lit("")), F.transform("_tokens", word), F.array(F.lit("")))        # token i is at i + 1
    pair = lambda a, b: F.struct(a.alias("prev"), b.alias("next"))
    adjacent = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), pair)
    into = F.transform("edges", lambda e: pair(F.get("w", e["i"]), e["first"]))
    out_of = F.transform("edges", lambda e: pair(e["last"], F.get("w", e["i"] + e["size"] + 1)))
    ends = F.map_from_entries(F.transform(F.array_distinct(F.transform("edges", lambda e: e["i"])), lambda i: F.struct(
        i, F.transform(F.filter("edges", lambda e: e["i"] == i), lambda e: e["first"]))))
    both = F.flatten(F.transform("edges", lambda e: F.transform(F.coalesce(F.try_element_at("_starts", e["i"] + e["size"]), F.array().cast("array<string>")), lambda f: pair(e["last"], f))))
    wanted = (held.select("_row", "_tgt", "edges", words.alias("w"), ends.alias("_starts"))
              .select("_row", "_tgt", F.explode(F.array_distinct(F.concat(adjacent, into, out_of, both))).alias("p"))
              .select("_row", F.col("_tgt").alias("tgt"), "p.prev", "p.next"))
    scores = (wanted.join(bigrams, ["tgt", "prev", "next"]).groupBy("_row")
              .agg(F.collect_list(F.struct("prev", "next", "score")).alias("pairs")))
    return held.join(scores, "_row", "left")


def decode(toks: list[str], edges: list, pairs: list, limit: int) -> tuple[str, int, bool]:
    """(output, score, whether it was cut at ``limit`` words) of the best path."""
    lm = {(p["prev"], p["next"]): p["score"] for p in pairs}
    starts: list[list] = [[(1, t.lstrip(" ").lower(), t.lstrip(" ").lower(), PASS, [t.lstrip(" ")])] for t in toks]
    for e in edges:
        starts[e["i"]].append((e["size"], e["first"], e["last"], e["score"], list(e["out"])))
    best: list[dict] = [{} for _ in range(len(toks) + 1)]
    best[0][""] = (0, 0, "", 0, [], None)                   # -score, edges, word before, size, out, place before
    for i, around in enumerate(starts):
        for before, state in best[i].items():
            for size, first, last, score, out in around:
                path = (state[0] - score - lm.get((before, first), UNSEEN), state[1] + 1, before, size, out)
                known = best[i + size].get(last)
                if known is None or path < known[:5]:
                    best[i + size][last] = (*path, i)
    total, _, last = min((s[0] - lm.get((w, ""), UNSEEN), s[1], w) for w, s in best[-1].items())
    parts, i = [], len(toks)
    while i:
        _, _, before, _, out, start = best[i][last]
        parts.append((toks[start].startswith(" "), out))
        i, last = start, before
    text, left = "", limit
    for blank, out in reversed(parts):
        text += (" " if blank and text else "") + " ".join(out[:left])
        left -= len(out)
        if left <= 0:
            break
    return text, -total, left < 0 or left == 0 and sum(len(o) for _, o in parts) > limit


def translated(df: DataFrame, src: str, tgt: str, text: str, table: DataFrame, bigrams: DataFrame,
               limit: int = fv.TRANSLATE_MAX_LENGTH) -> DataFrame:
    """Append ``translation``, ``path_score``, ``truncated`` and ``error``."""
    numbered = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "lattice-rows")
    wrong = F.when(F.col(text).isNotNull(), language_error(F.col(src), F.col(tgt)))
    rows = (numbered.where(F.col(text).isNotNull() & wrong.isNull())
            .select("_row", F.col(src).alias("_src"), F.col(tgt).alias("_tgt"), tokens(F.col(text)).alias("_tokens")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [decode(list(t), list(e), [] if p is None else list(p), limit) for t, e, p in zip(b["_tokens"], b["edges"], b["pairs"])]
            yield pd.DataFrame({"_row": b["_row"], "translation": [f[0] for f in found], "path_score": [f[1] for f in found], "truncated": [f[2] for f in found]})
    done = lattices(rows, table, bigrams).select("_row", "_tokens", "edges", "pairs").mapInPandas(
        run, "_row long, translation string, path_score long, truncated boolean")
    return numbered.withColumn("error", wrong).join(done, "_row", "left").select(
        *df.columns, "translation", "path_score", "truncated", "error")
