"""Every operator on the odd rows, against brute force, the libraries or a round trip."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from parley.llm import crf_pii, hamming_dedup, ngram_lm, nnpu_toxicity, quality, rans_store, sentencepiece_bpe, suffix_dedup, token_counts, wu_manber
from parley.llm.elias_fano import EliasFano
from parley.llm.lyndon_sort import suffix_array
from parley.llm.queries import tokenizer_file
from tests.llm import rows as R

ROWS = R.documents()
KEY = lambda r: tuple((v is None, v) for v in r)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, R.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], R.SCHEMA)


def collected(df):
    return sorted(map(tuple, df.collect()), key=KEY)


def test_suffix_array_is_the_sorted_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(500):
        s = [*rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)).tolist(), 0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("block,shard,sort", [(3 << 20, 16 << 20, 150_000), (2000, 3000, 400)])
def test_repeated_bytes(docs, empty, monkeypatch, block, shard, sort):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "SORT_SYMBOLS", sort)
    assert collected(suffix_dedup.repeated_bytes(docs)) == sorted(R.repeated(ROWS), key=KEY)
    assert suffix_dedup.repeated_bytes(empty).collect() == []


@pytest.mark.parametrize("hot,sort", [(20_000, 400), (10, 150_000), (10, 400)])
def test_a_passage_after_different_texts_is_divided(spark, monkeypatch, hot, sort):
    rng = np.random.default_rng(8)
    foot = " ".join(f"foot{k}" for k in range(20))
    rows = [(k if k % 9 else None, "".join(rng.choice(list("abcd "), rng.integers(1, 90))) + foot + "xyz"[:k % 4] + foot * (k % 5 == 0), "en", 0, "p", 0) for k in range(120)]
    most = [0, 0]
    sort_of, decide = suffix_dedup.suffix_array, suffix_dedup._decide

    def sorted_(symbols):
        most[0] = max(most[0], len(symbols))
        return sort_of(symbols)

    def decided(shard, held):
        for r in held:
            anchor = suffix_dedup._wide(suffix_dedup.unpack(r["data"], ["u1", "u1", "<u2", "<i8"])[0], 5)
            most[1] = max(most[1], int(np.unique(anchor, return_counts=True)[1].max()))
        return decide(shard, held)
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "SORT_SYMBOLS", sort)
    assert collected(suffix_dedup.repeated_bytes(spark.createDataFrame(rows, R.SCHEMA).repartition(3))) == sorted(R.repeated(rows), key=KEY)
    # the same steps in this process, to see what a task holds
    monkeypatch.setattr(suffix_dedup, "suffix_array", sorted_)
    raw = "".join(r[1] for r in rows).encode()
    off = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
    anchor, count = suffix_dedup._often(np.frombuffer(raw, np.uint8), off)
    hots = np.sort(anchor[count > hot])
    assert len(hots) or hot > 10
    block = {"block": 0, "raw": raw, "head": suffix_dedup.pack([np.arange(120, dtype="<i8"), np.zeros(120, "u1"), np.diff(off).astype("<i8")])}
    import pyarrow as pa
    sent = [r for b in suffix_dedup._send(1, hots)([pa.RecordBatch.from_pylist([block])]) for r in b.to_pylist()]
    held = [r for b in decided(0, [r for r in sent if r["kind"] == suffix_dedup.CODES]) for r in b.to_pylist()]
    assert most[1] <= (10 if hot == 10 else 200)
    wait = [r for r in held if r["kind"] in (suffix_dedup.WAITING, suffix_dedup.CONTEXTS)]
    lay = [r for r in sent if r["kind"] == suffix_dedup.LAYOUT] + [r for r in held if r["kind"] == suffix_dedup.CODES]
    copies = [r for b in suffix_dedup._copies([pa.RecordBatch.from_pylist([block | {"answers": lay}])]) for r in b.to_pylist()]
    if wait:
        list(suffix_dedup._order(0, wait + copies))
    assert most[0] <= 2 * sort + 200


def test_quality_counts_and_verdicts(spark, docs, empty):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = collected(quality.quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = [(i, *(c := R.quality(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t, *_ in ROWS]
    assert got == sorted(want, key=KEY)
    assert quality.quality_rules(empty, labels.limit(0)).collect() == []
    stays = quality.kept_rows(docs, labels)
    assert stays.columns == docs.columns
    assert stays.count() == sum(not w[-1] for w in want)   # nothing is certified from so few labels


def test_cutoffs_hold_their_risk():
    import pandas as pd
    # good documents up to step 9, bad ones from step 20: the cutoff lies between
    part = pd.DataFrame([("r", s, 100, 0, 100, 0) for s in range(10)] + [("r", s, 0, 30, 0, 30) for s in range(20, 30)], columns=["rule", "step", "pick_good", "pick_bad", "hold_good", "hold_bad"])
    assert quality.choose(part, 4, 3, 0.05, 0.05) == [("r", 20)]
    assert quality.choose(part.assign(hold_good=0), 4, 3, 0.05, 0.05) == []
    assert quality.tail(0, 100, 0.05) == pytest.approx(0.95 ** 100)
    assert quality.tail(2, 10, 0.3) == pytest.approx(sum(math.comb(10, k) * 0.3 ** k * 0.7 ** (10 - k) for k in range(3)))


def test_a_good_outlier_does_not_end_the_search():
    import pandas as pd
    names = ["rule", "step", "pick_good", "pick_bad", "hold_good", "hold_bad"]
    rows = [("r", s, 100, 0, 100, 0) for s in range(10)] + [("r", s, 0, 30, 0, 30) for s in range(20, 30)]
    assert quality.choose(pd.DataFrame([*rows, ("r", 250, 1, 0, 0, 0)], columns=names), 4, 3, 0.05, 0.05) == [("r", 20)]
    # a failed risk bound or test still ends it
    assert quality.choose(pd.DataFrame([*rows, ("r", 250, 50, 0, 0, 0)], columns=names), 4, 3, 0.05, 0.05) == []
    assert quality.choose(pd.DataFrame([*rows, ("r", 250, 1, 2, 60, 0)], columns=names), 4, 3, 0.05, 0.05) == []


def test_risk_is_kept_on_new_documents():
    import pandas as pd
    rng, lost = np.random.default_rng(5), 0
    for _ in range(60):
        def draw(n):
            return np.bincount(np.minimum(rng.geometric(0.08, n), quality.GRID), minlength=quality.GRID + 1)
        good_p, good_h, bad = draw(1500), draw(1500), draw(600) * 0 + np.bincount(rng.integers(30, 200, 600), minlength=quality.GRID + 1)
        part = pd.DataFrame({"rule": "r", "step": range(quality.GRID + 1), "pick_good": good_p, "pick_bad": bad, "hold_good": good_h, "hold_bad": bad})
        for _, step in quality.choose(part, 1, 1, 0.05, 0.05):
            lost += 0.92 ** (step - 1) > 0.05            # the true rate of rejected good ones
    assert lost <= 8                                       # 5 % of 60 runs, with room for chance


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    n = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ROWS]
    want = [(i, len((t or "").encode()), k, k > 512) for (i, t, *_), k in zip(ROWS, n)]
    assert collected(token_counts.token_counts(docs, tokenizer_file("byte_bpe_50k.json"), 512)) == sorted(want, key=KEY)
    assert token_counts.token_counts(empty, tokenizer_file("byte_bpe_50k.json"), 512).collect() == []


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, u in ((0, 9), (1, 1), (700, 1 << 40), (700, 1 << 64), (3000, 4000)):
        v = np.unique(rng.integers(0, u, n, np.uint64))
        e = EliasFano.open(np.frombuffer(EliasFano.build(v, u), np.uint8))
        place = {int(x): k for k, x in enumerate(v)}
        ask = np.concatenate([v, rng.integers(0, u, 100, np.uint64)])
        assert e.find(ask).tolist() == [place.get(int(x), -1) for x in ask]
        assert (e.get(np.arange(len(v))) == v).all()


@pytest.mark.parametrize("shard,parts", [(1_500_000, 20_000), (300, 20_000), (300, 3)])
def test_language_model(docs, empty, monkeypatch, shard, parts):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
    monkeypatch.setattr(ngram_lm, "MAX_PARTS", parts)
    texts = [(i, R.WORD.findall(R.low(t)) + [None], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t, *_ in ROWS]
    one, two = Counter(), Counter()
    for _, w, held in texts:
        if not held:
            one.update(w)
            two.update(zip(["\0", *w], w))
    n, v, first = sum(one.values()), len(one), sum(not h for *_, h in texts)
    prob = lambda c, x: (two[c, x] + ngram_lm.MU * (one[x] + 1) / (n + v + 1)) / ((first if c == "\0" else one[c]) + ngram_lm.MU)
    want = sorted([(i, h, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w),
                    sum(math.log10(prob(c, x)) for c, x in zip(["\0", *w], w))) for i, w, h in texts], key=KEY)
    got = collected(ngram_lm.score_documents(docs))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-8)
        assert g[6] == pytest.approx(w[6], abs=1e-4 * w[2])   # 16-bit quantisation
    assert ngram_lm.score_documents(empty).collect() == []


def test_trie_looks_between_its_pointers():
    rng = np.random.default_rng(11)
    words = np.unique(rng.integers(0, 1 << 64, 50, np.uint64))
    pairs = np.unique(np.stack([rng.integers(0, len(words) - 3, 400), rng.integers(0, 60, 400)], axis=1), axis=0)
    pw, pc = pairs[:, 0], pairs[:, 1].astype(np.uint64) << np.uint64(30)
    n = rng.integers(1, 50, len(pw))
    raw = ngram_lm.Trie.build(words, pw, pc, n, np.bincount(pw, n, minlength=len(words)).astype(np.int64), 5000, len(words))
    trie = ngram_lm.Trie.mapped(raw)
    place = {p: k for k, p in enumerate(zip(pw.tolist(), pc.tolist()))}
    ask = [(w, c << 30) for w in range(len(words)) for c in range(62)]
    w, c = np.array([x for x, _ in ask]), np.array([x for _, x in ask], np.uint64)
    want = [place.get(x, -1) for x in ask]
    assert trie.places(w, c).tolist() == want
    trie.start, trie.end = np.roll(trie.start, 1), np.roll(trie.end, 1)     # pointers that are wrong are noticed
    assert trie.places(w, c).tolist() != want
    moved = ngram_lm.Trie.__new__(ngram_lm.Trie)
    with pytest.MonkeyPatch.context() as m:
        get = EliasFano.get
        m.setattr(EliasFano, "get", lambda self, at: np.maximum(get(self, at).astype(np.int64) - (len(at) == len(words) + 1), 0).astype(np.uint64))
        moved.__init__(np.frombuffer(raw, np.uint8))
    assert moved.places(w, c).tolist() != want


def test_rans_blocks_round_trip_and_find_damage():
    rng = np.random.default_rng(3)
    for n in (1, 7, rans_store.LANES, 300_000):
        ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint16)
        t = rans_store.Tables(rans_store.quantise(np.bincount(ids)))
        block = rans_store.encode_block(ids, t)
        assert (rans_store.decode_block(block, t) == ids).all()
        assert (rans_store.decode_block(block, t, n // 2, n // 2 + 9) == ids[n // 2:n // 2 + 9]).all()
        with pytest.raises(ValueError):
            rans_store.decode_block(block[:-1] + bytes([block[-1] ^ 1]), t)


@pytest.mark.parametrize("shard,block", [(1 << 23, 2048 * 256), (6000, 2048)])
def test_token_store(docs, empty, monkeypatch, shard, block):
    from tokenizers import Tokenizer
    monkeypatch.setattr(rans_store, "SHARD_IDS", shard)
    monkeypatch.setattr(rans_store, "BLOCK", block)
    lib = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = []
    for i, t, *_ in ROWS:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0])
        rows.append((i, ids.astype("<u2").tobytes(), ids.astype("<u4").tobytes()))
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, _, wide in rows:
        want.append((i, at, len(wide) // 4, zlib.crc32(wide)))
        at += len(wide) // 4
    assert collected(rans_store.stored_ids(docs, tokenizer_file("byte_bpe_50k.json"), 0)) == sorted(want, key=KEY)
    assert rans_store.stored_ids(empty, tokenizer_file("byte_bpe_50k.json"), 0).collect() == []


@pytest.mark.parametrize("cap", [50, 2])
def test_near_duplicates(docs, empty, monkeypatch, cap):
    monkeypatch.setattr(hamming_dedup, "CAP", cap)
    least = R.groups(ROWS)
    same = {}
    for i, t, *_ in ROWS:
        if i is not None and R.shingle_set(t):
            same[R.shingle_set(t)] = least[i]
    want = []
    for i, t, *_ in ROWS:
        s = R.shingle_set(t)
        c = least[i] if i is not None else same.get(s)
        want.append((i, len(s), c, c == i))
    assert collected(hamming_dedup.near_duplicates(docs)) == sorted(want, key=KEY)
    assert hamming_dedup.near_duplicates(empty).collect() == []
    stays = hamming_dedup.first_of_groups(docs)
    assert stays.columns == docs.columns
    assert {r["doc_id"] for r in stays.collect()} - {None} == set(least.values())


def test_one_row_of_each_group_stays(spark):
    text = lambda k: " ".join(f"w{k}.{j}" for j in range(40))
    rows = [(1, text(1)), (None, text(1)), (None, text(1)), (2, text(2)), (2, text(2)), (None, text(3)), (None, text(3)),
            (4, text(4)), (5, text(4)), (5, text(4)), (6, text(6)), (6, text(7)), (None, None), (None, ""), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", k, "p", -1) for k, (i, t) in enumerate(rows)], R.SCHEMA).repartition(4)
    stays = hamming_dedup.first_of_groups(docs)
    assert stays.columns == docs.columns
    got = sorted([(r["doc_id"], r["text"]) for r in stays.collect()], key=lambda r: (r[0] or 0, r[1] or ""))
    want = [(1, text(1)), (2, text(2)), (None, text(3)), (4, text(4)), (6, text(6)), (6, text(7)), (None, None), (None, ""), (8, ""), (8, "")]
    assert got == sorted(want, key=lambda r: (r[0] or 0, r[1] or ""))


def test_hamming_keys_meet_every_pair_within_the_threshold():
    t = hamming_dedup.distance_threshold()
    plan, rng = hamming_dedup.key_plan(t), np.random.default_rng(4)
    for _ in range(2000):
        wrong = set(rng.choice(hamming_dedup.SLOTS, t, replace=False).tolist())
        assert any(not wrong & set(slots) for slots in plan)


def test_sentencepiece(docs, empty):
    import sentencepiece
    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t, *_ in ROWS:
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert collected(sentencepiece_bpe.encode_decode(docs, path)) == sorted(want, key=KEY)
    assert sentencepiece_bpe.encode_decode(empty, path).collect() == []
    model, rng = sentencepiece_bpe.Model(path), np.random.default_rng(6)
    for _ in range(300):
        ids = np.where(rng.random(8) < 0.5, rng.integers(0, 32_000, 8), rng.integers(3, 259, 8))
        assert model.decode(ids, np.array([8])) == [lib.decode(ids.tolist())]


def test_toxicity_finds_marked_words(spark, empty):
    rng = np.random.default_rng(7)
    plain = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 8 == 0
        words = rng.choice(plain, 40).tolist() + (["badword", "worseword"] if toxic else [])
        rows.append((i, " ".join(words), "en", 0, "", 0))
        marks.append((i, 1, int(toxic)))
    rows += [(None, None, None, None, None, None), (901, "", "en", 0, "", 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in nnpu_toxicity.toxicity(spark.createDataFrame(rows, R.SCHEMA), labels).collect()}
    held = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i, *_ in marks)
    assert np.mean([got[i]["predicted"] == (i % 8 == 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values()) and len(got) == len(rows)
    assert nnpu_toxicity.toxicity(empty, labels.limit(0)).collect() == []


def test_personal_data(docs, empty):
    found = {}
    for r in crf_pii.digest(crf_pii.personal_data(docs)).collect():
        found.setdefault(r["doc_id"], r)
    for i, t, *_ in ROWS:
        base = crf_pii.base_spans(t or "")
        assert found[i]["base_sha256"] == hashlib.sha256(crf_pii.spell(base).encode()).hexdigest() or i in (None, 5)
        assert [found[i][f"n_{k}"] for k in crf_pii.KINDS] == [sum(s[0] == k for s in base) for k in crf_pii.KINDS] or i is None
        assert set(crf_pii.spell(base).split(",")) <= set(found[i]["spans"].split(",")) or i is None
    assert crf_pii.personal_data(empty).collect() == []
    masked = {r["doc_id"]: r for r in crf_pii.masked(docs).collect()}
    i = next(r[0] for r in ROWS if r[1] and r[1].startswith("mail bob"))
    assert masked[i]["text"] == "mail [EMAIL] or [PHONE], [IP] and [CARD] end"
    assert crf_pii.masked(docs).columns == docs.columns


def test_crf_reads_formats_the_base_patterns_miss():
    model = crf_pii.trained()
    right = total = 0
    for words, labels in crf_pii.labelled_table(300, seed=99):           # rows it was not trained on
        shapes = [crf_pii.shape(w) for w in words]
        scores = model.scores([(shapes[k - 1] if k else "", s, shapes[k + 1] if k + 1 < len(shapes) else "") for k, s in enumerate(shapes)])
        at = 0
        while at < len(words):
            end = at
            while end < len(words) and crf_pii.admissible(words[end]):
                end += 1
            if end > at:
                got = model.decode(scores[at:end], np.array([end - at]))
                right += sum(crf_pii.LABELS[g] == x for g, x in zip(got, labels[at:end]))
                total += end - at
            at = max(end, at + 1)
    assert right / total > 0.97


def test_contamination(spark, docs, empty, monkeypatch):
    words = R.ITEM_WORD.findall(R.low(ROWS[0][1]))
    items = [(1, " ".join(words[20:35])), (2, " ".join(words[28:50])), (2, "x"), (30, "two three"), (None, "one"), (7, None), (8, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for (i, *_), (n, hit, found) in zip(ROWS, R.contaminated([r[1] for r in ROWS], items)):
        want.append((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    want.sort(key=KEY)
    for size in (wu_manber.SLICE_CHARS, 60):              # one slice, several
        monkeypatch.setattr(wu_manber, "SLICE_CHARS", size)
        assert collected(wu_manber.digest(wu_manber.contamination(docs, bench))) == want
        clean = wu_manber.clean_rows(docs, bench)
        assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    assert wu_manber.contamination(empty, bench).collect() == []
    assert not any(r["spans"] for r in wu_manber.contamination(docs, bench.limit(0)).collect())


def test_pieces_of_a_long_item_hold_its_windows():
    def windows(text):
        w = R.ITEM_WORD.findall(R.low(text))
        return {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 9, 10, 11, 300):
        words = ["".join(rng.choice(list("abéZ9"), rng.integers(1, 40))) for _ in range(n)]
        text = "".join(w + str(rng.choice([" ", ", ", "\n- "])) for w in words)
        want = windows(text)
        for limit in (1, 60, 500, 1 << 20):
            parts = wu_manber.pieces(text, 10, limit)
            assert set().union(*map(windows, parts)) == want
            assert limit < 1 << 20 or parts == [text]
            if limit == 500:
                assert all(len(p) <= 500 + 10 * 40 for p in parts)
