"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm import phrase_mining as P
from tests.llm.rows import low

SCHEMA = "doc_id long, text string, lang string, f long, phrase string, shard int, n string, rank int"


def counts(rows, words=4):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(r[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f, n


def expected(rows, least=30, percent=80, limit=2000):
    f, n = counts(rows)
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        drop = {p[i:i + m] for p, a in cands.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                if 100 * a >= percent * cands[p[i:i + m]]}
        best = []
        for p, a in cands.items():
            if p not in drop:
                score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def documents(n=400, seed=2):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "a", "é", "naïve", "x" * 40, "new", "york", "city", "hall", "\x1c", "it's", "-", "🙂"]
    weight = [30, 10, 20, 10, 5, 4, 2, 6, 6, 3, 2, 1, 2, 1, 2]
    out = []
    for k in range(n):
        words = rng.choices(vocab, weight, k=rng.randrange(0, 60))
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", " new york city hall "]) for w in words)
        out.append((k, text, rng.choice(["en", "en", "en", "de", None, "und", "a b", ""]), k, "p", 1, "n", 2))
    out += [(5, None, "en", 1, "p", 1, "n", 2), (None, "", None, None, None, None, None, None), (7, " .,;\n", "en", 1, "p", 1, "n", 2)]
    out += [(6, "one hot line of five words. " * 40, "en", 1, "p", 1, "n", 2)] * 3 + [(8, "only one language here " * 29, "xx", 1, "p", 1, "n", 2)]
    return out


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block,shard,hot,parts", [(8 << 20, 1 << 19, 1 << 18, 500_000), (3_000, 500, 100, 0), (1, 200, 10, 500_000)])
def test_collocations(spark, monkeypatch, block, shard, hot, parts):
    for name, value in (("BLOCK_BYTES", block), ("SHARD_TOKENS", shard), ("HOT_TOKENS", hot), ("PART_ROWS", parts)):
        monkeypatch.setattr(P, name, value)
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(P.collocations(docs)) == expected(rows)
    assert len(expected(rows)) > 50


def test_limits_and_ties(spark):
    rows = [(k, f"tie{k % 9} pair{k % 9}. some other words{k % 5}", "en", 1, "p", 1, "n", 2) for k in range(360)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for limit in (1, 4, 2000):
        assert got(P.collocations(docs, limit=limit)) == expected(rows, limit=limit)


def test_very_long_text(spark):
    rng = np.random.default_rng(1)
    text = " ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 1_300_000), 5000))
    assert len(text) > 4 << 20
    rows = [(0, text, "en", 1, "p", 1, "n", 2)]
    assert got(P.collocations(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_empty_tables(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert P.collocations(spark.createDataFrame([(1, None, None, 1, "p", 1, "n", 2)], SCHEMA)).collect() == []


def test_quicksort_counts_equal_partitions():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, top = rng.integers(1, 200), rng.integers(2, 12)
        rows = rng.integers(0, top, (n, P.WORDS))
        for k in range(1, P.WORDS):
            rows[(rng.random(n) < 0.2) | (rows[:, k - 1] == P.END), k] = P.END
        weight = rng.integers(1, 5, n)
        least, hot = int(rng.integers(1, 20)), int(rng.integers(0, top + 1))
        real = Counter()
        for row, w in zip(rows.tolist(), weight.tolist()):
            for k in range(2, P.WORDS + 1):
                if P.END not in row[:k]:
                    real[tuple(row[:k])] += w
        want = {p: w for p, w in real.items() if w >= least or len(p) < P.WORDS and min(p) >= hot}
        flat = rows.reshape(-1)
        found = Counter()
        for first, weights, size in P.quicksort(flat, weight.astype(float), least, hot):
            for x, w in zip(first.tolist(), weights.tolist()):
                found[tuple(flat[x * P.WORDS:x * P.WORDS + size].tolist())] += w
        assert found == want
