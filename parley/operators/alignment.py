"""Audits of a rewrite by aligning its tokens with the source's.

``align`` is a longest common subsequence of tokens, by a banded edit table whose band
doubles until no path outside it can be better; equal tokens at both ends go first. The
table keeps one bit a cell.

* A negation of the source is *kept* where its token is aligned and governs the same
  word, *moved* where it is aligned and governs another, *lost* where it isn't aligned.
  It governs the first content word after it in its clause. Two governed words are the
  same if they are aligned with each other, or both replaced at one place: between the
  same aligned neighbours.
* A content word of the output is *added* where it is aligned with nothing, the source
  doesn't lack it at another place (it was moved then), and no glossary entry whose term
  stands in the source has it in its plain form.

Map-only: a row's two texts are compared in one task, whatever its keys. A null text has
no tokens. Case doesn't count.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import fixed_values as fv
from parley.operators.lattice import words
from parley.operators.rewrite import MAX_COMPILED_TERMS

BAND = 32
AUDIT = ("negations int, negations_lost int, negations_moved int, governed array<struct<negation:string,governs:string,status:string>>, "
         "added_words int, added array<string>")


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence of two arrays of token numbers.
    Of several, the first place of ``a`` is left out before the first of ``b``."""
    same = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:same] == b[:same], False)))
    tail = int(np.argmin(np.append(a[::-1][:same - head] == b[::-1][:same - head], False)))
    inner_a, inner_b = a[head:len(a) - tail], b[head:len(b) - tail]
    out = [(k, k) for k in range(head)]
    out += [(i + head, j + head) for i, j in _banded(inner_a, inner_b)]
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _banded(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    if not n or not m:
        return []
    wide = BAND
    while True:
        low, high = min(0, m - n) - wide, max(0, m - n) + wide
        found, down = _table(a, b, low, high)
        # a path that leaves the band has at least this many tokens that aren't aligned
        if n + m - 2 * found <= abs(m - n) + 2 * wide or wide > n + m:
            break
        wide *= 2
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif down[i][(j - i - low) >> 3] >> (7 - (j - i - low & 7)) & 1:
            i += 1
        else:
            j += 1
    return out


def _table(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, list[np.ndarray]]:
    """(length of the longest common subsequence in the band, bits: leave a's token out)
    over suffixes; cell d of row i is for b from ``i + low + d`` on."""
    n, m, size = len(a), len(b), high - low + 1
    outside = -(n + m + 1)
    d = np.arange(size)
    padded = np.concatenate([np.full(max(0, -low), -1), b, np.full(max(0, n + high - m) + 1, -1)])   # b from its place low on
    below = np.where((n + low + d >= 0) & (n + low + d <= m), 0, outside)
    down = [np.zeros(0, np.uint8)] * n
    for i in range(n - 1, -1, -1):
        j = i + low + d
        inside = (j >= 0) & (j <= m)
        under = np.concatenate([[outside], below[:-1]])                 # the same b, a from i + 1
        at = i + low + max(0, -low)
        best = np.maximum(under, np.where(padded[at:at + size] == a[i], below + 1, outside))
        best = np.where(inside, np.maximum(best, np.where(j == m, 0, outside)), outside)
        row = np.maximum.accumulate(best[::-1])[::-1]
        row = np.where(inside, row, outside)
        right = np.concatenate([row[1:], [outside]])
        down[i] = np.packbits(under >= right)
        below = row
    return int(below[-low]), down


def _governs(words: list[str], k: int) -> int:
    """Place of the first content word after place ``k`` in its clause, -1 if there is none."""
    for j in range(k + 1, len(words)):
        if words[j] in fv.CLAUSE_ENDS:
            return -1
        if words[j] not in fv.FUNCTION_WORDS and words[j] not in fv.NEGATION_WORDS and words[j][0].isalnum():
            return j
    return -1


def compare(a: list[str], b: list[str], glossary: dict[str, list[tuple[list[str], list[str]]]]) -> tuple:
    """What ``AUDIT`` says of source tokens ``a`` and output tokens ``b``."""
    number = {t: k for k, t in enumerate({*a, *b})}
    pairs = align(np.array([number[t] for t in a], np.int64), np.array([number[t] for t in b], np.int64))
    to, back = dict(pairs), {j: i for i, j in pairs}
    left, right = [i for i, _ in pairs], [j for _, j in pairs]
    governed = []
    for k, t in enumerate(a):
        if t not in fv.NEGATION_WORDS:
            continue
        g = _governs(a, k)
        status = "lost"
        if k in to:
            h = _governs(b, to[k])
            replaced = g >= 0 and h >= 0 and g not in to and h not in back and bisect_left(left, g) == bisect_left(right, h)
            status = "kept" if g < 0 and h < 0 or to.get(g, -1) == h >= 0 or replaced else "moved"
        governed.append((t, a[g] if g >= 0 else None, status))
    licensed = {w for k, t in enumerate(a) for term, plain in glossary.get(t, ()) if a[k:k + len(term)] == term for w in plain}
    spare = Counter(t for i, t in enumerate(a) if i not in to)
    added = []
    for j, t in enumerate(b):
        if j in back or not t[0].isalnum() or t in fv.FUNCTION_WORDS or t in fv.NEGATION_WORDS or t in licensed:
            continue
        if spare[t]:
            spare[t] -= 1                               # moved here from elsewhere
        else:
            added.append(t)
    count = [s for *_, s in governed]
    return len(governed), count.count("lost"), count.count("moved"), governed, len(added), added


def audit(df: DataFrame, src: str, out: str, glossary: list[tuple[str, str]] = fv.GLOSSARY) -> DataFrame:
    """Append the columns of ``AUDIT``; ``glossary`` (term, plain) is sent to all tasks."""
    if len(glossary) > MAX_COMPILED_TERMS:
        raise ValueError(f"{len(glossary)} terms; at most {MAX_COMPILED_TERMS} are sent to the tasks")
    split = lambda x: words(F.coalesce(x, F.lit("")))
    line = lambda x: F.array_join(split(x), " ")
    both = df.sparkSession.createDataFrame([(t, p) for t, p in glossary], "t string, p string").select(split(F.col("t")).alias("t"), split(F.col("p")).alias("p"))
    known: dict = {}
    for r in both.collect():                                             # bounded by the check above
        if r["t"]:
            known.setdefault(r["t"][0], []).append((r["t"], r["p"]))
    names = [x.split()[0] for x in AUDIT.replace("struct<", "").split(", ")]

    @F.pandas_udf(AUDIT)
    def found(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        # tokens hold no blanks; only the two texts compared are cut into lists of them
        cut = lambda x: x.split(" ") if x else []
        rows = [compare(cut(x), cut(y), known) for x, y in zip(a, b)]
        out = {n: [r[k] for r in rows] for k, n in enumerate(names)}
        out["governed"] = [[dict(zip(("negation", "governs", "status"), g)) for g in x] for x in out["governed"]]
        return pd.DataFrame(out)
    done = df.select("*", found(line(F.col(src)), line(F.col(out))).alias("_audit"))
    return done.select(*[F.col(f"`{c}`") for c in df.columns], "_audit.*")
