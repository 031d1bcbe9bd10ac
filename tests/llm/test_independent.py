"""Earlier operators against versions written from the contracts alone, and very long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from parley.llm import crf_pii, hamming_dedup, ngram_lm, nnpu_toxicity, phrase_mining, quality, rans_store, sentencepiece_bpe, suffix_dedup, token_counts
from parley.llm.common import table
from parley.llm.queries import tokenizer_file
from tests.conftest import SF_MID, SF_SMALL
from tests.llm import rows as R

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    def luhn(d):
        doubled = [int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])]
        return sum(doubled) % 10 == 0

    def holds(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
                "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p in PATTERNS for m in re.finditer(p, text) if holds(kind, m[0])]


def odd_texts():
    rng = random.Random(8)
    parts = ["bob@x.org", "a.b@c", "@x.y.z", "me@a-b.co.uk.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "41111111111111111111", "+1 (988) 555-2485", "+49.30.1234567", "+1 2", "++12345678", "é", " ", ",", "x@y@z.com", "5500005555555559", "\n"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]


def test_base_spans_of_personal_data(spark):
    rows = [(k, t) for k, (t,) in enumerate(duckdb.sql(f"select text from '{SF_SMALL}/documents.parquet'").fetchall() + [(t,) for t in odd_texts()] + [(None,), ("",)])]
    got = {r["doc_id"]: r for r in crf_pii.digest(crf_pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    seen = Counter()
    for k, t in rows:
        want = base_spans(t or "")
        seen.update(w.split(":")[0] for w in want)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(got[k]["spans"].split(",")) | {""}
    assert len(seen) == 4 and min(seen.values()) > 20


def test_added_spans_of_personal_data_by_recall_and_precision(spark):
    """Formats that the base patterns miss, put into prose, beside look-alikes that aren't personal data."""
    rng = random.Random(12)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    forms = [lambda: f"({rng.randrange(200, 999)}) {d(3)}-{d(4)}", lambda: f"{rng.randrange(200, 999)}-{d(3)}-{d(4)}"]
    plain = [lambda: f"{rng.randrange(1990, 2030)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", lambda: f"${d(3)}.{d(2)}", lambda: f"v{d(1)}.{d(1)}.{d(1)}", lambda: d(5)]
    rows, planted = [], {}
    for k in range(300):
        form = rng.choice(forms if k % 2 else plain)()
        rows.append((k, f"please call {form} before noon" if k % 2 else f"the value {form} was noted"))
        planted[k] = (rows[-1][1].index(form), rows[-1][1].index(form) + len(form)) if k % 2 else None
    got = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s]
           for r in crf_pii.digest(crf_pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    caught = sum(any(a < p[1] and b > p[0] for a, b in got[k]) for k, p in planted.items() if p)
    false = sum(len(got[k]) for k, p in planted.items() if not p)
    assert caught / 150 >= 0.9 and false / 150 <= 0.05, (caught, false)


def kept_by_rules(rows, label, risk, doubt):
    """doc_id -> kept, by the method's description: holdouts by the id's CRC, exact binomial tails."""
    counts = {}
    for i, t, lang in rows:
        n_words, word_chars, symbols, dup, repeat = R.quality(t)
        lines = [x for x in (t or "").split("\n") if R.WORD.search(x)]
        capitals = sum("A" <= c <= "Z" for c in t or "")
        share = {"symbols": (symbols, word_chars), "capitals": (capitals, word_chars), "dup_lines": (dup, len(lines)), "repeat_words": (repeat, n_words)}
        counts[i] = (n_words < 50 or 100 * repeat > 50 * n_words, lang or "", {r: min(256, 256 * a // max(b, 1)) for r, (a, b) in share.items()})
    strata = {lang for i, (failed, lang, _) in counts.items() if not failed and i in label}
    cut = {}
    for s in strata:
        ids = [i for i, (failed, lang, _) in counts.items() if not failed and lang == s and i in label]
        hold = [i for i in ids if zlib.crc32(str(i).encode()) % 2 == 0]
        pick = [i for i in ids if i not in set(hold)]
        for rule in ("symbols", "capitals", "dup_lines", "repeat_words"):
            at = lambda part, q, step: sum(counts[i][2][rule] >= step and label[i] == q for i in part)
            for step in sorted({counts[i][2][rule] for i in ids} - {0}, reverse=True):
                good, bad = at(pick, 1, step), at(pick, 0, step)
                n = at(hold, 1, 0)
                if not good + bad:
                    continue
                if good > risk / 4 * at(pick, 1, 0):
                    break
                if good > bad:
                    continue
                k, p = at(hold, 1, step), risk / 4
                if not n or sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1)) > doubt / (4 * len(strata)):
                    break
                cut[s, rule] = step
    return {i: not failed and all(v < cut.get((lang, r), 999) for r, v in steps.items()) for i, (failed, lang, steps) in counts.items()}, cut


def test_quality_verdicts_with_enough_labels(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    rows, label = [], {}
    for k in range(1600):
        bad = rng.random() < 0.25
        text = [rng.choice(words) for _ in range(60)]
        for j in range(60):
            if rng.random() < (0.5 if bad else 0.01):
                text[j] = "###" if k % 3 else text[j].upper() + "ABC"
        rows.append((k, " ".join(text), rng.choice(["en", "en", None])))
        label[k] = 0 if bad else 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, q, 0) for k, q in label.items()], "doc_id long, quality int, toxic int")
    want, cut = kept_by_rules(rows, label, 0.2, 0.2)
    assert len(cut) >= 2
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, labels, 0.2, 0.2).collect()}
    assert got == want and 100 < sum(not v for v in want.values()) < 600
    assert {r["doc_id"] for r in quality.kept_rows(docs, labels, 0.2, 0.2).collect()} == {k for k, v in want.items() if v}


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_toxicity_steps_equal_a_plain_loop(monkeypatch, prior):
    """The risk, its clipped step and Adam, sample by sample."""
    monkeypatch.setattr(nnpu_toxicity, "RATE", 0.4)
    rng = random.Random(5)
    toxic, plain = [b"bad", b"vile", b"rot"], [b"walk", b"tree", b"sun", b"sea"]
    pos = [{*rng.sample(toxic, 2), rng.choice(plain)} for _ in range(30)]
    unl = [{rng.choice(plain), rng.choice(plain), *([rng.choice(toxic)] if rng.random() < 0.2 else [])} for _ in range(90)]
    # at the start the intercept's gradient is zero but for rounding, which Adam scales up:
    # that one value is taken from the first step
    monkeypatch.setattr(nnpu_toxicity, "STEPS", 1)
    moved = (math.log(prior / (1 - prior)) - nnpu_toxicity.fit(pos, unl, prior).intercept) / nnpu_toxicity.RATE
    monkeypatch.setattr(nnpu_toxicity, "STEPS", 25)
    got = nnpu_toxicity.fit(pos, unl, prior)
    words = list(got.weights)
    assert words
    w = {x: 0.0 for x in words} | {None: math.log(prior / (1 - prior))}
    m1, m2 = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0)
    clipped = 0
    for step in range(1, nnpu_toxicity.STEPS + 1):
        f = lambda s: w[None] + sum(w[x] for x in words if x in s)
        sig = lambda v: 1 / (1 + math.exp(-v))
        soft = lambda v: math.log1p(math.exp(v))
        negative = sum(soft(f(s)) for s in unl) / len(unl) - prior * sum(soft(f(s)) for s in pos) / len(pos)
        clipped += negative < 0
        for x in w:
            has = lambda s: 1.0 if x is None or x in s else 0.0  # noqa: E731, B023
            up = prior * sum((sig(f(s)) - 1) * has(s) for s in pos) / len(pos)
            down = sum(sig(f(s)) * has(s) for s in unl) / len(unl) - prior * sum(sig(f(s)) * has(s) for s in pos) / len(pos)
            g = (up + down if negative >= 0 else -down) + (nnpu_toxicity.PENALTY * w[x] if x is not None else 0)
            if step == 1 and x is None:
                assert abs(g) < 1e-9
                g = moved * 1e-8 / (1 - min(abs(moved), 0.999))
            m1[x], m2[x] = 0.9 * m1[x] + 0.1 * g, 0.999 * m2[x] + 0.001 * g * g
        for x in w:
            w[x] -= nnpu_toxicity.RATE * (m1[x] / (1 - 0.9 ** step)) / (math.sqrt(m2[x] / (1 - 0.999 ** step)) + 1e-8)
    assert clipped > 0 if prior > 0.5 else True
    assert [got.weights[x] for x in words] == pytest.approx([w[x] for x in words], abs=2e-3) and got.intercept == pytest.approx(w[None], abs=2e-3)


def test_token_store_equals_the_library_on_all_documents(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = duckdb.sql(f"select doc_id, text from '{SF_MID}/documents.parquet' order by doc_id").fetchall()
    got = {r["doc_id"]: r for r in rans_store.stored_ids(table(spark, SF_MID, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0).collect()}
    at = 0
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())), i
        at += len(ids)


@pytest.mark.parametrize("cap", [50, 2])
def test_near_duplicates_on_all_documents(spark, monkeypatch, cap):
    monkeypatch.setattr(hamming_dedup, "CAP", cap)
    rows = duckdb.sql(f"select doc_id, text from '{SF_MID}/documents.parquet'").fetchall()
    sets = {i: R.shingle_set(t) for i, t in rows}
    owners = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    shared = Counter((a, b) for ids in owners.values() for k, a in enumerate(ids) for b in ids[k + 1:])
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x
    links = 0
    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            links += 1
            a, b = sorted((root(a), root(b)))
            least[b] = a
    assert links > 50
    got = {r["doc_id"]: r["component_id"] for r in hamming_dedup.near_duplicates(table(spark, SF_MID, "documents")).collect()}
    assert got == {i: root(i) for i in sets}


def test_a_text_of_nine_megabytes(spark):
    rng = np.random.default_rng(2)
    vocab = np.array(["".join(rng.choice(list("abcdefghij"), 3 + k % 6)) + str(k) for k in range(4000)])
    words = vocab[np.minimum(rng.zipf(1.2, 1_250_000) - 1, 3999)].tolist()
    passage = "this passage of more than fifty bytes stands in both documents, once in each"
    unique = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 3_000_000))
    rows = [(0, "start " + passage, "en"), (1, unique[:1_500_000] + passage + unique[1_500_000:], "en"), (2, " ".join(words), "en")]
    assert all(len(t.encode()) > 8 << 20 for _, t, _ in rows[1:])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_bytes(docs.where("doc_id < 2")).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"]) == (len(passage), 1)
    assert got[1]["kept_sha256"] == hashlib.sha256(unique.encode()).hexdigest() and got[0]["n_removed"] == 0
    long = docs.where("doc_id = 2")
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ids = np.array([*lib.encode(rows[2][1], add_special_tokens=False).ids, 0], "<u4")
    assert token_counts.token_counts(long, tokenizer_file("byte_bpe_50k.json"), limit=512).first()["n_tokens"] == len(ids) - 1
    r = rans_store.stored_ids(long, tokenizer_file("byte_bpe_50k.json"), end_id=0).first()
    assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = sp.encode(rows[2][1])
    r = sentencepiece_bpe.encode_decode(long, tokenizer_file("piece_bpe_32k.model")).first()
    assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
    count = Counter(words)
    r = ngram_lm.score_documents(long).first()
    n, v = len(words) + 1, len(count) + 1
    assert (r["n_tokens"], r["train_tokens"], r["n_known"], r["held_out"]) == (n, n, n, False)
    assert r["base_score"] == pytest.approx(sum(k * math.log10((k + 1) / (n + v + 1)) for k in [*count.values(), 1]), rel=1e-9)
    best = phrase_mining.collocations(long, limit=5).collect()
    assert best[0]["n"] == len(words) and all(b["a"] >= 30 for b in best)
