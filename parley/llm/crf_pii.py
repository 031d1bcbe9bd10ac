"""Personal data: base patterns, and a linear-chain CRF over word shapes.

The base patterns give exact spans of emails, IP addresses, card numbers and
phone numbers. The CRF reads the words around them: its features are shapes
(digits, letters and marks of a word and of its neighbours, never the word
itself), its labels B/I of each kind and O. It is trained on the driver from a
small labelled table made by rule (``labelled_table``: formats of each kind the
base patterns know and don't know, and look-alikes such as dates, versions, keys,
prices), by gradient ascent of the penalised log-likelihood with exact
forward-backward sums. Only words with a digit or ``@`` can have a label other
than O, so the chain falls apart into runs of such words; the runs of a slice are
decoded by Viterbi together, as numpy arrays over all runs.

A run's span is kept if it passes its kind's check (``_holds``) and touches no
base span; base spans always stay. A null or empty text has no spans.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parley.llm.common import WORD, flat, map_batches, segment_sums, text_rows, texts, tidy

KINDS = ("email", "ip", "card", "phone")
#: The base patterns of the contract.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
LABELS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
TABLE_ROWS, SEED, STEPS, PENALTY = 600, 7, 100, 0.02


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points."""
    out = []
    at = last = 0
    while (at := text.find("@", at)) >= 0:
        # everything the local part may hold stands left of the @, so a match starts where that run starts
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = max(at + 1, last)
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# -- the labelled table --------------------------------------------------------

#: Formats by kind; 9 is a digit, a a small letter, A a capital, h a hex digit, L makes the digits pass Luhn.
FORMATS = {
    "email": ["aaaa.aaaaa@aaaaaa.aaa", "aaaaa@aaaa.aaa", "aaa_aaa@aaaa-aaa.aa", "aaaaa99@aaaa.aa.aa", "aaaaa.99@aaaa9.aaaaaaa.aaa", "Aaaa.Aaaa@Aaaaa.aaa", "aaaa+aaaa@aaaa.aaa", "aaaa@aaaaaaaaa", "a.aaaa@aaaa", "<aaaa@aaaaa.aaa>", "(aaaaa@aaaa.aa)"],
    "ip": ["99.99.99.99", "192.168.9.99", "9.9.9.9", "10.9.9.99", "99.199.99.19:9999", "[199.99.9.9]", "199.19.99.199", "99.144.39.199"],
    "card": ["L999999999999999", "L999-9999-9999-9999", "L999 9999 9999 9999", "L99 999999 99999", "L99-999999-99999", "L99999999999999", "L999999999999"],
    "phone": ["+9 (999) 999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "+99 99 9999999", "+99 999 999 9999", "099 999 9999", "0099 99 9999 9999", "+9-999-999-9999", "(999)999-9999", "09999 999999", "+99 (9) 99 99 99 99"],
    None: ["9.", "9.9.", "9.9", "v9.9.9", "9.9.9", "2099-09-19", "19/09/2019", "19.09.2019", "99:99", "9,999.99", "$99", "99%", "99", "1999", "2019,", "AAAA9AA9AA99A9AAAAAA", "password=99h9h9hh99h9hhh999", 'token = "hhhh9999hhhh9999hhhh9999hhhh9999hhhhhhhh"', "#99999", "1999-2019", "ISBN 999-9-99-999999-9", "aaa9", "a9", "A9", "9a", "9999999", "99999", "@aaaaa", "@Aaaa9", "9x9", "99-99", "9.9.9.9.9.9", "(9)", "[99]", "99.", "9)", "aaaa_9999", "9e9", "0x9h9h", "aaa-999999", "99 999 999", "9 999", "pp. 99-99", "99.99", "999999999", "9999 99 99"],
}


def _fill(form: str, rng: random.Random) -> str:
    out = []
    for c in form:
        out.append(rng.choice("0123456789") if c == "9" else rng.choice("abcdefghijklmnopqrstuvwxyz") if c == "a"
                   else rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c == "A" else rng.choice("0123456789abcdef") if c == "h" else rng.choice("3456") if c == "L" else c)
    s = "".join(out)
    if "L" in form:
        last = max(k for k, c in enumerate(s) if c.isdigit())
        for d in "0123456789":
            t = s[:last] + d + s[last + 1:]
            if luhn(re.sub("[^0-9]", "", t)):
                return t
    return s


def labelled_table(rows: int = TABLE_ROWS, seed: int = SEED) -> list[tuple[list[str], list[str]]]:
    """Small labelled table: (words, labels) rows, every format in turn among plain words."""
    rng = random.Random(seed)
    forms = [(k, f) for k, fs in FORMATS.items() for f in fs]
    plain = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(1, 9)))
    out = []
    for n in range(rows):
        words, labels = [], []
        for part in range(2 + n % 2):
            for _ in range(rng.randrange(0 if part else 1, 4)):
                w = plain()
                words.append(rng.choice([w, w, w, w.capitalize(), w + ",", w + ".", w + ":"]))
                labels.append("O")
            if part and rng.random() < 0.7 and labels[-1] != "O":
                words.append(plain())
                labels.append("O")
            kind, form = forms[n % len(forms)] if part == 0 else rng.choice(forms)
            got = (_fill(form, rng) + rng.choice(["", "", "", ",", "."])).split(" ")
            words += got
            labels += [f"{'I' if k else 'B'}-{kind}" if kind else "O" for k in range(len(got))]
        for _ in range(rng.randrange(0, 3)):
            words.append(plain())
            labels.append("O")
        out.append((words, labels))
    return out


# -- features --------------------------------------------------------------------

def shape(word: str) -> str:
    """Digits 9, capitals A, other letters a, marks as they are; very long words by their ends."""
    if len(word) > 48:
        word = word[:40] + word[-8:]
    return "".join("9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c if c < "\x7f" else "?" for c in word)


_RUN = re.compile(r"(.)\1+")


def short(s: str) -> str:
    return _RUN.sub(r"\1", s)


def bare(s: str) -> str:
    return s.strip(".,;:!?<>[]\"'")


@functools.lru_cache(100_000)
def _own(s: str) -> tuple[str, ...]:
    b = bare(s)
    digits = b.count("9")
    letters = b.count("a") + b.count("A")
    groups = "-".join(str(min(len(g), 20)) for g in re.findall("9+", b)[:6])
    return (f"w{b}", f"s{short(b)}", f"d{min(digits, 20)}{'l' if letters else ''}", f"g{groups}{'l' if letters else ''}",
            f"@{b.count('@')}{'.' in b.rpartition('@')[2]}", f".{min(b.count('.'), 5)}{digits > 0}{letters > 0}", f"p{b[:2]}", f"e{b[-2:]}", f"m{''.join(sorted(set(b) - set('9aA')))}{letters > 0}")


def word_features(before: str, s: str, after: str) -> list[str]:
    own = _own(s)
    b, a = short(bare(before)) if before else "^", short(bare(after)) if after else "$"
    if not set("9@") & set(b):
        b = "x"
    if not set("9@") & set(a):
        a = "x"
    return [*own, f"<{b}", f">{a}", f"<{b}|{own[1]}", f">{a}|{own[1]}", f"<{_own(before)[3] if before else '^'}|{own[3]}", f">{own[3]}|{_own(after)[3] if after else '$'}"]


def admissible(word: str) -> bool:
    return any("0" <= c <= "9" or c == "@" for c in word)


# -- the model -----------------------------------------------------------------------

def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class CRF:
    """Weights: per feature and label, and per pair of neighbouring labels."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, trans: np.ndarray):
        self.index, self.emit, self.trans = index, emit, trans

    @staticmethod
    def allowed() -> np.ndarray:
        """Pairs a chain may have: I follows B or I of its kind."""
        ok = np.zeros((len(LABELS), len(LABELS)), bool)
        for i, a in enumerate(LABELS):
            for j, b in enumerate(LABELS):
                ok[i, j] = b[0] != "I" or a[2:] == b[2:]
        return ok

    @classmethod
    def fit(cls, table: list[tuple[list[str], list[str]]], steps: int = STEPS, penalty: float = PENALTY) -> CRF:
        n, length, k = len(table), max(len(w) for w, _ in table), len(LABELS)
        index: dict[str, int] = {}
        rows, cells, gold = [], [], np.zeros((n, length), np.int64)
        valid, free = np.zeros((n, length), bool), np.zeros((n, length), bool)
        for i, (words, labels) in enumerate(table):
            shapes = [shape(w) for w in words]
            for t, s in enumerate(shapes):
                valid[i, t], free[i, t], gold[i, t] = True, admissible(words[t]), LABELS.index(labels[t])
                if free[i, t]:
                    for f in word_features(shapes[t - 1] if t else "", s, shapes[t + 1] if t + 1 < len(shapes) else ""):
                        rows.append(index.setdefault(f, len(index)))
                        cells.append(i * length + t)
        rows, cells = np.array(rows), np.array(cells)
        emit, trans = np.zeros((len(index), k)), np.zeros((k, k))
        barred = np.where(cls.allowed(), 0.0, -1e9)
        only_o = np.full(k, -1e9)
        only_o[0] = 0
        gold_emit = np.zeros_like(emit)
        np.add.at(gold_emit, rows, np.eye(k)[gold.reshape(-1)[cells]])
        both = valid[:, 1:] & valid[:, :-1]
        gold_trans = np.zeros_like(trans)
        np.add.at(gold_trans, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        square_e, square_t = np.full_like(emit, 1e-3), np.full_like(trans, 1e-3)
        start_bar = np.array([-1e9 if x[0] == "I" else 0.0 for x in LABELS])
        for _ in range(steps):
            scores = np.zeros((n * length, k))
            for c in range(k):
                scores[:, c] = np.bincount(cells, emit[rows, c], minlength=n * length)
            scores = scores.reshape(n, length, k) + np.where(free[:, :, None], 0.0, only_o)
            step = trans + barred
            alpha, beta = np.empty((n, length, k)), np.zeros((n, length, k))
            alpha[:, 0] = scores[:, 0] + start_bar
            for t in range(1, length):
                a = _logsum(alpha[:, t - 1][:, :, None] + step, 1) + scores[:, t]
                alpha[:, t] = np.where(valid[:, t, None], a, alpha[:, t - 1])
            total = _logsum(alpha[:, -1], 1)
            for t in range(length - 2, -1, -1):
                b = _logsum(step + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(valid[:, t + 1, None], b, 0.0)
            node = np.exp(alpha + beta - total[:, None, None]) * valid[:, :, None]
            pair = np.zeros_like(trans)
            for t in range(1, length):
                p = np.exp(alpha[:, t - 1][:, :, None] + step + (scores[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
                pair += (p * both[:, t - 1, None, None]).sum(0)
            flat_node = node.reshape(-1, k)
            model_emit = np.stack([np.bincount(rows, flat_node[cells, c], minlength=len(index)) for c in range(k)], 1)
            for weight, grad, square in ((emit, gold_emit - model_emit - penalty * emit, square_e), (trans, gold_trans - pair - penalty * trans, square_t)):
                square += grad * grad
                weight += 0.5 * grad / np.sqrt(square)
        return cls(index, emit, trans + barred)

    def scores(self, words: list[tuple[str, str, str]]) -> np.ndarray:
        """Label scores of (shape before, shape, shape after) triples."""
        out = np.zeros((len(words), len(LABELS)))
        for k, w in enumerate(words):
            rows = [i for f in word_features(*w) if (i := self.index.get(f)) is not None]
            if rows:
                out[k] = self.emit[rows].sum(0)
        return out

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of chains that lie one after another; O stands before and after each."""
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        out = np.zeros(len(scores), np.int64)
        if not len(size):
            return out
        best = scores[starts] + self.trans[0]
        back: list[np.ndarray] = []
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, "left"))          # chains longer than t
            reach = best[:live, :, None] + self.trans
            back.append(reach.argmax(1).astype(np.uint8))
            best[:live] = reach.max(1) + scores[starts[:live] + t]
        # the O after a chain
        label = (best + self.trans[:, 0]).argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            out[starts[:live] + t] = label[:live]
            if t:
                label[:live] = back[t - 1][np.arange(live), label[:live]]
        return out


@functools.lru_cache(4)
def trained(rows: int = TABLE_ROWS, seed: int = SEED) -> CRF:
    return CRF.fit(labelled_table(rows, seed))


def _holds(kind: str, s: str) -> bool:
    """The exact check of a span the CRF gives."""
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        return bool(re.fullmatch(r"[^@\s]*[A-Za-z0-9]@[A-Za-z0-9][^@\s]*", s))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]{1,5})?", s)) and all(int(p) <= 255 for p in s.split(":")[0].split("."))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9 -]+", s)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[+(]?[0-9(][0-9(). -]*[0-9]", s)) and 9 <= len(digits) <= 15


_TRIM = {"email": (re.compile(r"^[^A-Za-z0-9]+"), re.compile(r"[^A-Za-z0-9]+$")), "phone": (re.compile(r"^[^0-9+(]+"), re.compile(r"[^0-9]+$"))}
_TRIM_DIGITS = (re.compile(r"^[^0-9]+"), re.compile(r"[^0-9]+$"))


class Finder:
    def __init__(self, model: CRF):
        self.model = model
        self.seen: dict[tuple[str, str, str], np.ndarray] = {}

    def added(self, batch: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Spans of the CRF that touch no base span, for each text."""
        if len(self.seen) > 200_000:
            self.seen.clear()
        words, lengths, place = [], [], []      # of all runs: shapes, run lengths, (text, start, end)
        for k, text in enumerate(batch):
            tokens = [(m.start(), m.end()) for m in WORD.finditer(text)]
            run = 0
            shaped: dict[int, str] = {}

            def at(i, tokens=tokens, shaped=shaped, text=text):
                if not 0 <= i < len(tokens):
                    return ""
                if i not in shaped:
                    shaped[i] = shape(text[tokens[i][0]:tokens[i][1]])
                return shaped[i]

            free = sorted({i for i in _anchored(text, tokens)})
            for j, i in enumerate(free):
                run += 1
                words.append((at(i - 1), at(i), at(i + 1)))
                place.append((k, *tokens[i]))
                if j + 1 == len(free) or free[j + 1] != i + 1:
                    lengths.append(run)
                    run = 0
        out: list[list[tuple[str, int, int]]] = [[] for _ in batch]
        if not words:
            return out
        new = list(dict.fromkeys(w for w in words if w not in self.seen))
        self.seen.update(zip(new, self.model.scores(new)))
        labels = self.model.decode(np.array([self.seen[w] for w in words]), np.array(lengths)).tolist()
        begin = None
        for n, (k, a, b) in enumerate(place):
            name = LABELS[labels[n]]
            if name[0] == "B":
                begin = (name[2:], a)
            follows = n + 1 < len(place) and place[n + 1][0] == k and LABELS[labels[n + 1]][0] == "I"
            if name != "O" and begin and not follows:
                kind, start = begin
                span = self._trim(kind, batch[k], start, b)
                if _holds(kind, batch[k][span[0]:span[1]]) and not any(span[0] < e and s < span[1] for _, s, e in base[k]):
                    out[k].append((kind, *span))
                begin = None
        return out

    @staticmethod
    def _trim(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
        head, tail = _TRIM.get(kind, _TRIM_DIGITS)
        s = text[a:b]
        if m := head.match(s):
            a += m.end()
        if m := tail.search(text[a:b]):
            b = a + m.start()
        return a, b


_ANCHOR = re.compile(r"[0-9@]")


def _anchored(text: str, tokens: list[tuple[int, int]]):
    """Numbers of the words with a digit or @."""
    i = 0
    for m in _ANCHOR.finditer(text):
        p = m.start()
        while tokens[i][1] <= p:
            i += 1
        yield i


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_ANCHOR_BYTE = np.zeros(256, bool)
_ANCHOR_BYTE[[*range(0x30, 0x3A), 0x40]] = True


def _finder(model):
    finder = Finder(model.value)

    def find(batch: pa.RecordBatch) -> tuple[list[list], list[list]]:
        """(base spans, added spans) of each text."""
        raw, off = flat(batch)
        some = np.flatnonzero(segment_sums(_ANCHOR_BYTE[raw], off)).tolist()
        base: list[list] = [[]] * batch.num_rows
        more: list[list] = [[]] * batch.num_rows
        if some:
            col = batch.column(batch.schema.get_field_index("text"))
            part = [col[k].as_py() for k in some]
            found = [base_spans(t) for t in part]
            for k, b, a in zip(some, found, finder.added(part, found)):
                base[k], more[k] = b, a
        return base, more
    return find


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, base and added spans (kind, start, end), both by kind then start. Map-only."""
    model = docs.sparkSession.sparkContext.broadcast(trained())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        find = _finder(model)

        def work(batch: pa.RecordBatch) -> dict:
            base, more = find(batch)
            as_rows = lambda found: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], span)
            return {"doc_id": batch.column(0), "base": as_rows(base), "added": as_rows(more)}
        return work
    s = "array<struct<kind:string,start:long,end:long>>"
    return map_batches(text_rows(docs, id_col, text_col), f"doc_id long, base {s}, added {s}", make)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``personal_data``."""
    def joined(spans):
        rank = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("name")))
        return F.array_join(F.transform(F.array_sort(rank), lambda s: F.concat_ws(":", s["name"], s["a"].cast("string"), s["b"].cast("string"))), ",")
    def of_kind(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base", "added")
    return found.select("doc_id", *map(of_kind, KINDS),
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, personal data in ``text`` masked; ``n_chars``,
    where there is one, follows the text."""
    model = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns

    def run(batches):
        find = _finder(model)
        from parley.llm.common import slices
        for batch in batches:
            for part in slices(batch):
                base, more = find(part)
                k = names.index("text")
                old = part.column(k).to_pylist()
                new = [mask(t, [*b, *m]) if b or m else t for t, b, m in zip(old, base, more)]
                part = part.set_column(k, part.schema.field(k), pa.array(new, part.schema.field(k).type))
                if "n_chars" in names:
                    c = names.index("n_chars")
                    size = [len(t) if b or m else n for t, b, m, n in zip(new, base, more, part.column(c).to_pylist())]
                    part = part.set_column(c, part.schema.field(c), pa.array(size, part.schema.field(c).type))
                yield part
    return docs.mapInArrow(tidy(run), docs.schema)
