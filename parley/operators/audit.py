"""Output audits for the contracts the rewrite and translation steps must keep.

All are column expressions over a (source text, output text) pair: map-only.

* negation — every ``no`` / ``not`` / ``without`` of the source is still there;
* numbers — numbers with their units, glued or after a blank, are unchanged (as a multiset);
* script — share of letters in the target language's script;
* length — word counts, ratio, empty output, and whether the output reaches
  the decode cap (possible truncation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.functions.text import is_nonblank, let, tokens, word_count


def _negation_counts(text: Column) -> Column:
    """Struct of per-word counts, tokenising the text once."""
    return let(tokens(text), lambda u: F.struct(*[
        F.size(F.filter(u, lambda t: t == F.lit(w))).cast("long").alias(w)
        for w in fv.NEGATION_WORDS]))


def negation(df: DataFrame, src: str, out: str) -> DataFrame:
    d = df.select("*", _negation_counts(F.col(src)).alias("_a"), _negation_counts(F.col(out)).alias("_b"))
    cols, ok = [], F.lit(True)
    for w in fv.NEGATION_WORDS:
        a, b = F.col(f"_a.{w}"), F.col(f"_b.{w}")
        cols += [a.alias(f"{w}_src"), b.alias(f"{w}_out")]
        ok = ok & (b >= a)
    return d.select(*df.columns, *cols, ok.alias("negations_kept"))


def numbers(text: Column) -> Column:
    """Sorted numbers with their units, without the blanks between: what is
    glued to a number is its unit, a word after blanks only if it is a known one."""
    def normal(x):
        number = F.regexp_extract(x, r"^[0-9]+(?:[.,][0-9]+)*", 0)
        rest = F.regexp_replace(x, r"^[0-9]+(?:[.,][0-9]+)*", "")
        unit = F.regexp_replace(rest, r"^[ \t\x{A0}]+", "")
        return F.concat(number, F.when((rest == unit) | unit.isin(fv.UNITS), unit).otherwise(F.lit("")))
    found = F.regexp_extract_all(F.lower(text), F.lit(fv.NUMBER_PATTERN), 0)
    return F.sort_array(F.transform(found, normal))


def number_check(df: DataFrame, src: str, out: str) -> DataFrame:
    found = let(F.struct(numbers(F.col(src)).alias("a"), numbers(F.col(out)).alias("b")), lambda n: F.struct(
        F.size(n["a"]).cast("long").alias("numbers_src"), F.size(n["b"]).cast("long").alias("numbers_out"), (n["a"] == n["b"]).alias("numbers_kept")))
    return df.select("*", found.alias("_n")).select(*df.columns, "_n.*")


def script_share(df: DataFrame, out: str, script_col: str) -> DataFrame:
    """Letters in ``out``, letters in the expected script, and their share."""
    letters = F.regexp_count(F.col(out), F.lit(r"\p{L}")).cast("long")
    branch = None
    for name, rx in fv.SCRIPT_JAVA.items():
        e = F.regexp_count(F.col(out), F.lit(rx))
        branch = (F.when(F.col(script_col) == name, e) if branch is None
                  else branch.when(F.col(script_col) == name, e))
    in_script = branch.cast("long")
    return df.select("*", letters.alias("letters"), in_script.alias("in_script"),
                     F.when(letters > 0, in_script / letters).alias("script_share"))


def length_check(df: DataFrame, src: str, out: str, cap: int) -> DataFrame:
    # each count is bound once: as a projected column it would be computed where it is used
    counts = let(F.struct(word_count(F.col(src)).alias("a"), word_count(F.col(out)).alias("b")), lambda n: F.struct(
        n["a"].alias("words_src"), n["b"].alias("words_out"), F.when(n["a"] > 0, n["b"] / n["a"]).alias("length_ratio"), (n["b"] >= cap).alias("at_cap")))
    done = df.select("*", counts.alias("_n"), (~F.coalesce(is_nonblank(F.col(out)), F.lit(False))).alias("empty_output"))
    return done.select(*df.columns, "_n.words_src", "_n.words_out", "_n.length_ratio", "empty_output", "_n.at_cap")
