"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from parley.llm import merkle_manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, path string, n int, block string, root string"


def H(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, add=0):
    i, text, lang, source, n = r[:5]
    return H("".join(map(field, (i, source, lang, None if n is None else n + add, text))))


def tree(nodes):
    """All levels of a tree, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H("".join(below[k:k + 2])) for k in range(0, len(below), 2)])
    return levels


def expected(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by_lang[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = tree([leaf(r) for r in by_lang[x]])
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for x in langs:
        for k, r in enumerate(by_lang[x]):
            i, add = r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            proof, h = "", leaf(r, add)
            for levels, at in ((trees[x], k), (top, langs.index(x))):
                for level in levels[:-1]:
                    run = level[at // 2 * 2:at // 2 * 2 + 2]
                    proof += "".join(v for j, v in enumerate(run) if j != at % 2)
                    run[at % 2] = h
                    h = H("".join(run))
                    at //= 2
            out.append((i, leaf(r), trees[x][-1][0], top[-1][0], H(proof), h, h == top[-1][0]))
    return sorted(out, key=key)


def key(r):
    return tuple((v is not None, v) for v in r)


def rows(n, langs, seed=3):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice("ab é:-\n🙂") for _ in range(rng.randrange(0, 40)))
    out = [(k, text(), rng.choice(langs), rng.choice(["web", "", None]), rng.choice([0, 7, None, -3])) for k in range(n)]
    rng.shuffle(out)
    return [(*r, 1, "p", 2, "b", "r") for r in out]


def got(df):
    return sorted((tuple(r[:7]) for r in M.verification(df).collect()), key=key)


@pytest.mark.parametrize("n,langs", [(1, [None]), (3, ["a", "b"]), (300, ["en", "de", None, ""]), (40, [f"l{k}é" for k in range(30)])])
def test_manifest(spark, n, langs):
    data = rows(n, langs)
    found = got(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert found == expected(data)
    assert all(ok == (zlib.crc32(str(i).encode()) % 7 != 0 or dict((r[0], r[4]) for r in data)[i] is None) for i, *_, ok in found)


def test_blocks_of_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(M, "BITS", 2)
    monkeypatch.setattr(M, "BLOCK_BITS", 4)
    data = rows(700, ["en", "en", "en", None, "de"]) + [(None, "no id", "en", "s", 1, 1, "p", 2, "b", "r")] * 2
    data += [(5, "again", "en", "s", 1, 1, "p", 2, "b", "r"), data[0], data[0], (9_000, None, None, None, None, None, None, None, None, None),
             (9_001, "x" * 3_000_000, "en", "s", (1 << 63) - 1, 1, "p", 2, "b", "r")]
    assert got(spark.createDataFrame(data, SCHEMA).repartition(7)) == expected(data)


def test_a_tree_of_equal_rows(spark):
    data = rows(1, ["en"]) * 600
    assert got(spark.createDataFrame(data, SCHEMA).repartition(3)) == expected(data)


def test_empty_table(spark):
    assert M.verification(spark.createDataFrame([], SCHEMA)).collect() == []
