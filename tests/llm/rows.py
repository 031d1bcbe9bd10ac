"""Small documents with the odd cases, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_ID = (1 << 63) - 1


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def documents(seed=1, n=80):
    """(doc_id, text, lang, extra columns that clash with the operators' own names)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    prose = lambda k: " ".join(rng.choice([word(), word(), "The", "of,"]) for _ in range(k))
    base = prose(300)
    texts = [prose(rng.randrange(1, 120)) for _ in range(n)]
    for k in range(0, n, 4):                              # near and exact copies
        words = base.split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = word()
        texts[k] = " ".join(words)
    texts += [base, base, None, "", " \n\t", "x", "one two three", "one two three", "\n" * 5 + "a b c d e f\nq\n",
              "ab" * 3000, prose(4000), "mail bob.x@mail.example.com or +1 (988) 555-2485, 10.0.0.1 and 4111 1111 1111 1111 end",
              "### $$$ %%% " * 60, "<|endoftext|> x <|endoftext|>", "naïve 🙂 你好 \x1c \x85 it's"]
    rows = [(k, t, rng.choice(["en", "de", None]), k % 3, "p", -1) for k, t in enumerate(texts)]
    rows += [(5, texts[5], "en", 1, "p", -1), (None, base, "en", 1, "p", -1), (None, None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, n int, kept string, rep long"


def repeated(rows, length=50):
    key = lambda i: NO_ID if i is None else i
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in data:
        for x in range(len(b) - length + 1):
            w = b[x:x + length]
            first[w] = min(first.get(w, NO_ID), key(i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for x in range(len(b) - length + 1):
            if first[b[x:x + length]] < key(i):
                gone[x:x + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def quality(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(w, w[1:], w[2:]))
    marked = {j for k in range(len(w) - 2) if tri[tuple(w[k:k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(marked)


def shingle_set(t, size=5):
    w = WORD.findall(low(t))
    return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def groups(rows, percent=85):
    """doc_id -> least doc_id reachable."""
    sets = defaultdict(list)
    for i, t, *_ in rows:
        sets[i].append(shingle_set(t))
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def contaminated(docs, items, window=10):
    owners = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall(low(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[k:k + window])].add("" if i is None else str(i))
    out = []
    for t in docs:
        w, hit, found = ITEM_WORD.findall(low(t)), set(), set()
        for size in {len(p) for p in owners}:
            for k in range(len(w) - size + 1):
                p = tuple(w[k:k + size])
                if p in owners:
                    hit.update(range(k, k + size))
                    found |= owners[p]
        out.append((len(w), len(hit), sorted(found)))
    return out
