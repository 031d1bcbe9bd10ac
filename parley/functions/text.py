"""Scalar text functions as Spark column expressions.

Each function returns a ``Column`` built from built-in functions, so it stays
inside whole-stage codegen; none of them calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and pass it to ``fn`` as a lambda variable.

    Catalyst may inline a projected array into every place it is used (and into
    filters it infers for ``explode``), re-running an expensive regex per use.
    Binding through a one-element array keeps a single evaluation."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


# -- predicates -------------------------------------------------------------

def is_nonempty(c: Column) -> Column:
    """Python truthiness of a string field: drops null and ``""``, keeps blanks."""
    return c.isNotNull() & (F.length(c) > 0)


def is_nonblank(c: Column) -> Column:
    """``bool(s.strip())`` with Python's whitespace set (``trim`` strips only
    U+0020 and is not the same thing)."""
    return c.isNotNull() & ~c.rlike(fv.BLANK_PATTERN)


def py_strip(c: Column) -> Column:
    """``s.strip()`` with Python's whitespace set."""
    ws = fv.PY_WHITESPACE_CLASS
    return F.regexp_replace(c, f"^{ws}+|{ws}+$", "")


# -- tokenising and n-grams -------------------------------------------------

def tokens(c: Column) -> Column:
    """Lower-cased word tokens of two or more characters: the maximal runs of
    letters, digits and underscore (``[\\p{L}\\p{N}_]{2,}``), found by
    splitting on the non-word runs — the same tokens as extracting the runs,
    and faster in the JVM."""
    parts = F.split(F.lower(c), f"[^{fv.WORD_CHARS}]+", -1)
    return F.filter(parts, lambda t: F.length(t) >= 2)


def with_bigrams(tok: Column) -> Column:
    """Unigrams followed by bigrams of neighbouring tokens (one space)."""
    def build(u):
        n1 = F.greatest(F.size(u) - 1, F.lit(0))
        return F.concat(u, F.zip_with(F.slice(u, 1, n1), F.slice(u, 2, n1),
                                      lambda a, b: F.concat(a, F.lit(" "), b)))
    return let(tok, build)


def terms(c: Column) -> Column:
    """Unigram + bigram terms of a text (the feature vocabulary space)."""
    return with_bigrams(tokens(c))


def ws_tokens(c: Column) -> Column:
    """Whitespace-separated pieces (``str.split()``)."""
    return F.regexp_extract_all(c, F.lit(fv.WS_TOKEN_PATTERN), 0)


def word_count(c: Column) -> Column:
    """Number of ``str.split()`` pieces; null for a null text (whatever the
    session's ANSI / size-of-null settings)."""
    return F.when(c.isNull(), F.lit(None).cast("long")).otherwise(F.size(ws_tokens(c)).cast("long"))


def preview(c: Column, n: int = fv.PREVIEW_CHARS) -> Column:
    """First ``n`` characters (code points), like ``s[:n]``."""
    return F.substring(c, 1, n)


# -- classifier outputs -----------------------------------------------------

def is_positive(margin: Column) -> Column:
    """Predicted label: strictly positive margin."""
    return margin > 0


def confidence(margin: Column) -> Column:
    """Probability of the predicted class under a sigmoid of the margin, in
    [0.5, 1]. ``1/(1+exp(-|m|))`` equals ``sigmoid(m)`` for m>0 and
    ``1-sigmoid(m)`` otherwise, and cannot overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.abs(margin)))


def tag(medical: Column, conf: Column) -> Column:
    """Annotation ``médico · 99% conf.``; no tag without a classification, no
    suffix without a confidence. Half-even rounding as Python's format."""
    pct = F.bround(conf * 100, 0).cast("long").cast("string")
    suffix = F.when(conf.isNull(), F.lit("")).otherwise(
        F.concat(F.lit(" · "), pct, F.lit("% conf.")))
    label = F.when(medical, F.lit(fv.TAG_MEDICAL)).otherwise(F.lit(fv.TAG_NOT_MEDICAL))
    return F.when(medical.isNull(), F.lit(None).cast("string")).otherwise(F.concat(label, suffix))


# -- export -----------------------------------------------------------------

def html_escape(c: Column) -> Column:
    """``html.escape(s, quote=True)``: ``&`` first, then ``< > " '``."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#x27;"))


def chat_messages(text: Column) -> Column:
    """System instruction followed by the user's text, as chat messages."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(fv.SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), text.alias("content")),
    )
