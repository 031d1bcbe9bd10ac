"""Whole-word, case-insensitive, leftmost-longest term replacement.

Used by the offline rewrite backend (glossary: technical term -> plain words)
and by phrase-table translation. The term table is compiled on the driver
into one regex whose alternatives form a prefix tree (so matching costs the
term length per position, not the number of terms) and a lookup map; the
rewrite is then a map-only column expression:

    parts = split(text, re)            # text between matches
    found = regexp_extract_all(text, re)
    text' = parts[0] || concat_i(plain(found[i]) || parts[i+1])

At one start position the prefix tree tries longer continuations before
ending, so the longest whole-word term wins; scanning is left to right and
matches do not overlap (leftmost-longest).

Both forms read a term table alike: case and runs of white space don't count, a
repeated term takes its smallest plain text, and rows with a null or with a term that
does not start and end with a letter, mark, digit or underscore match nothing.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.functions.fixed_values import GLOSSARY, PY_WHITESPACE_CLASS
from parley.functions.text import let
from parley.plans.sizing import broadcast_if_small
from parley.session import cut_lineage

# A combining mark belongs to the word it stands in.
WORD_CHARS = fv.WORD_CHARS + r"\p{M}"

# Largest term table compiled into a single expression (regex + map literal).
MAX_COMPILED_TERMS = 5_000
# Hashes of terms that candidates are tested against before they become rows.
MAX_BIT_TERMS = 20_000

_END = f"(?![{WORD_CHARS}])"
_START = f"(?<![{WORD_CHARS}])"


def _escape(ch: str) -> str:
    if ch.isascii() and not ch.isalnum():
        return "\\" + ch
    return ch


def trie_pattern(terms: list[str]) -> str:
    """Regex matching any of ``terms`` (lower case) as whole words, longest
    first at each position. Java regex syntax."""
    trie: dict = {}
    for t in terms:
        node = trie
        for ch in t:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        alts = [_escape(ch) + emit(node[ch]) for ch in sorted(k for k in node if k)]
        if "" in node:
            alts.append(_END)          # ending here is tried last -> longest wins
        return alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"

    return "(?iu)" + _START + emit(trie)


def compile_terms(table: list[tuple[str, str]]):
    """``(pattern, mapping column)`` for a term table of at most
    ``MAX_COMPILED_TERMS`` rows."""
    if len(table) > MAX_COMPILED_TERMS:
        raise ValueError(f"term table has {len(table)} rows; the compiled form takes at most "
                         f"{MAX_COMPILED_TERMS} (use rewrite_joined for larger tables)")
    norm = {}
    for term, plain in table:
        if term is None or plain is None:
            continue
        term = " ".join(term.lower().split())
        if term and all(c == "_" or unicodedata.category(c)[0] in "LMN" for c in (term[0], term[-1])):
            norm[term] = min(plain, norm.get(term, plain))
    pattern = trie_pattern(sorted(norm))
    mapping = F.create_map(*[F.lit(x) for kv in sorted(norm.items()) for x in kv])
    return pattern, mapping


def rewrite_counted(text: Column, table: list[tuple[str, str]] = GLOSSARY) -> Column:
    """Struct ``(text, n)``: the rewritten text and the number of replaced terms."""
    pattern, mapping = compile_terms(table)
    return replaced(text, F.lit(pattern), mapping)


def replaced(text: Column, pattern: Column, mapping: Column) -> Column:
    """Struct ``(text, n)`` by a compiled pattern and its map, both columns. The text is
    scanned twice (split, extract), each once."""
    def build(b):
        parts, found = b["parts"], b["found"]
        plain = F.transform(found, lambda m: F.coalesce(F.try_element_at(mapping, F.lower(m)), m))
        rest = F.zip_with(plain, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                          lambda a, c: F.concat(a, c))
        return F.struct(F.concat(F.element_at(parts, 1), F.array_join(rest, "")).alias("text"),
                        F.size(found).cast("long").alias("n"))
    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, pattern, 0).alias("found"))
    return let(both, build)


def rewrite(text: Column, table: list[tuple[str, str]] = GLOSSARY) -> Column:
    """Column expression replacing every whole-word term of ``table``."""
    return rewrite_counted(text, table)["text"]


# -- beyond the compiled size: the same rewrite with joins ---------------------

_MATCH = "array<struct<i:int,e:int,plain:string>>"


def normalize_table(table: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Lower-case terms with single spaces; one row per term and ``on`` (smallest
    plain text if a term repeats); unusable rows go."""
    ws = PY_WHITESPACE_CLASS
    term = F.lower(F.regexp_replace(F.regexp_replace(F.col("term"), f"^{ws}+|{ws}+$", ""), f"{ws}+", " "))
    return (table.select(*on, term.alias("term"), "plain")
            .where(F.col("term").rlike(f"^[{WORD_CHARS}](.*[{WORD_CHARS}])?$") & F.col("plain").isNotNull())
            .groupBy(*on, "term").agg(F.min("plain").alias("plain")))


def _segments(text: Column) -> Column:
    """The text cut into alternating word / non-word runs (covers every char)."""
    return F.regexp_extract_all(text, F.lit(f"[{WORD_CHARS}]+|[^{WORD_CHARS}]+"), 0)


def _bit_test(hashes: list[int]):
    """A test whether columns' hash may be one of these: a bit map of 16 bits or more a
    hash, as one constant."""
    size = max(64, 1 << (16 * max(len(hashes), 1) - 1).bit_length())
    words = [0] * (size // 64)
    for h in hashes:
        at = h & (size - 1)
        words[at >> 6] |= 1 << (at & 63)
    signed = ",".join(str(w - (1 << 64) if w >> 63 else w) for w in words)
    bits = F.split(F.lit(signed), ",").cast("array<bigint>")

    def test(*cols: Column) -> Column:
        at = F.xxhash64(*cols).bitwiseAND(F.lit(size - 1).cast("long"))
        return F.bit_get(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
    return test


def _test_of(hashes: DataFrame):
    """``_bit_test`` of a one-column table, None where it has over ``MAX_BIT_TERMS`` rows."""
    found = hashes.distinct().limit(MAX_BIT_TERMS + 1).collect()
    return _bit_test([r[0] for r in found]) if len(found) <= MAX_BIT_TERMS else None


def _start(first_word: Column) -> Column:
    """A lower-cased word as it is looked up: a sigma's form depends on what follows."""
    return F.replace(first_word, F.lit("ς"), F.lit("σ"))


def _candidates(rows: DataFrame, text_col: str, on: tuple[str, ...], max_words: int, may_start=None, may_match=None) -> DataFrame:
    """``_row, on, i, e, term``: for word run i and k = 1..max_words, the end run and the
    lower-cased phrase of k words with their separators. Runs become rows of their own at
    once, and those go whose word no term begins with; what is left takes along the few runs
    that a phrase may have, not its text. (An outer explode of an array that is never
    empty is the plain one, without a filter that computes the array again.)"""
    cols = ["_row", *on]
    cut = rows.select(*cols, _segments(F.col(text_col)).alias("_segs"),
                      F.col(text_col).rlike(f"^[{WORD_CHARS}]").cast("int").alias("_even"))
    each = cut.select(*cols, "_segs", "_even", F.posexplode_outer("_segs").alias("_at", "_seg"))
    words = each.where((F.col("_at") + F.col("_even")) % 2 == 1)         # runs alternate
    if may_start:
        words = words.where(may_start(*on, _start(F.lower("_seg"))))
    spans = words.select(*cols, (F.col("_at") + 1).alias("i"),
                         F.slice("_segs", F.col("_at") + 1, F.lit(2 * max_words - 1)).alias("_span"))

    def phrases(k):
        return F.struct((F.col("i") + 2 * k - 2).alias("e"), F.lower(F.array_join(F.slice("_span", F.lit(1), 2 * k - 1), "")).alias("term"))
    ks = F.sequence(F.lit(1), F.floor((F.size("_span") + 1) / 2).cast("int"))
    found = spans.select(*cols, "i", F.explode_outer(F.transform(ks, phrases)).alias("c")).select(*cols, "i", "c.e", "c.term")
    return found.where(may_match(*on, F.col("term"))) if may_match else found


def _leftmost_longest(matches: DataFrame) -> DataFrame:
    """``_row, _kept``: the matches that stand, in order. A text's matches fall into
    runs that no match reaches across; a run is resolved by a fold of its own, so
    the cost is linear where matches stand side by side."""
    w = Window.partitionBy("_row").orderBy("i", F.desc("e"))
    reach = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = (matches.withColumn("_new", (F.col("i") > reach).cast("long"))
            .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    fold0 = F.struct(F.lit(0).alias("last"), F.array().cast(_MATCH).alias("kept"))
    ordered = F.array_sort(F.collect_list(F.struct("i", (-F.col("e")).alias("ne"), "e", "plain")))
    kept = F.aggregate("ms", fold0, lambda acc, m: F.when(m["i"] > acc["last"], F.struct(
        m["e"].alias("last"),
        F.concat(acc["kept"], F.array(F.struct(m["i"].alias("i"), m["e"].alias("e"),
                                               m["plain"].alias("plain")))).alias("kept")))
        .otherwise(acc))["kept"]
    return (runs.groupBy("_row", "_run").agg(ordered.alias("ms"))
            .select("_row", kept.alias("kept"))
            .groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("kept"))).alias("_kept")))


def rewrite_joined(df: DataFrame, text_col: str, table: DataFrame, out: str, on: tuple[str, ...] = ()) -> DataFrame:
    """``rewrite`` for term tables of any size. The rows get numbers in a written table,
    so their own keys may repeat or be null. Candidates (word runs x phrase
    lengths) are joined to the table on the phrase and the columns ``on`` that both
    sides have (AQE splits a hot phrase); before that, words that begin no term and
    candidates that are none go, by bit maps of hashes where those are few enough, else by
    a broadcast of the terms' hashes. A table that fits the bit map is broadcast, too. Matches are
    resolved per text, and the text is rebuilt from its runs in one pass."""
    t = normalize_table(table, on)
    max_words = t.select(F.max(F.regexp_count("term", F.lit(f"[{WORD_CHARS}]+")))).first()[0] or 1
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "rewrite-rows")
    hashes, small = broadcast_if_small(t.select(F.xxhash64(*on, "term").alias("_h")).distinct(), "term hashes")
    test = _test_of(hashes)
    starts = _test_of(t.select(F.xxhash64(*on, _start(F.regexp_extract("term", f"^[{WORD_CHARS}]+", 0)))))
    cands = _candidates(rows, text_col, on, max_words, starts, test)
    if small and not test:
        cands = cands.join(hashes, F.xxhash64(*on, "term") == F.col("_h"), "left_semi")
    kept = _leftmost_longest(cands.join(F.broadcast(t) if test else t, [*on, "term"]).select("_row", "i", "e", "plain"))
    joined = rows.join(kept, "_row", "left")

    def rebuild(b):
        ks = b["kept"]

        def upto(m, idx):                               # null: the run stays as it is
            prev = F.when(idx == 0, F.lit(0)).otherwise(F.element_at(ks, idx)["e"])
            return F.concat(F.array_repeat(F.lit(None).cast("string"), m["i"] - prev - 1), F.array(m["plain"]),
                            F.array_repeat(F.lit(""), m["e"] - m["i"]))
        put = F.zip_with(b["segs"], F.flatten(F.transform(ks, upto)), lambda run, new: F.coalesce(new, run))
        return F.array_join(put, "")

    # array functions that copy a slice go through all of its array each time, so none is used per match
    both = F.struct(_segments(F.col(text_col)).alias("segs"), F.col("_kept").alias("kept"))
    rebuilt = F.when(F.col("_kept").isNull(), F.col(text_col)).otherwise(let(both, rebuild))
    return joined.withColumn(out, rebuilt).drop("_kept", "_row")
