"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read here (its pieces, scores and flags); the library itself
is not used. Text becomes words that start with the space mark; where the
vocabulary has no piece with a mark after another character (checked on load),
no merge crosses a word's start, so each distinct word of a slice is merged once
(``bpe.merge``) and its ids serve all its occurrences. Characters outside the
vocabulary become byte pieces.

Null and empty texts have no ids and decode to an empty text. Texts of any
length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.bpe import PairTable, merge
from parley.llm.common import SLICE_BYTES, map_batches, ragged, segment_sums, text_rows, texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct words a task keeps between slices; beyond it the cache starts anew.
CACHE_WORDS = 200_000
WITH_IDS_BYTES = 1 << 20


def _fields(buf: bytes):
    """(number, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, kind, buf[at:at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, kind, buf[at:at + n]
            at += n


class Model:
    """A BPE model file: pieces, merge table, byte pieces, decode table."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, self.scores, self.types = [], [], []
        trainer, norm = {}, {}
        for no, _, value in _fields(raw):
            if no == 1:
                p = {n: v for n, _, v in _fields(value)}
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.types.append(p.get(3, NORMAL))
            elif no == 2:
                trainer = {n: v for n, _, v in _fields(value)}
            elif no == 3:
                norm = {n: v for n, _, v in _fields(value)}
        if trainer.get(3, 1) != 2 or norm.get(2) or norm.get(4, 1) or USER in self.types or UNUSED in self.types:
            raise ValueError("only BPE models with identity normalisation, kept white space and plain pieces")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("a piece crosses a word's start")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk = self.types.index(UNKNOWN)
        self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.byte_ids = np.full(256, self.unk, np.int32)
        normal = {}
        for i, (p, t) in enumerate(zip(self.pieces, self.types)):
            if t == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
            elif t == NORMAL:
                normal[p] = i
        # characters of pieces that are no piece themselves get ids after the vocabulary
        self.char_ids = {c: normal[c] for p in normal for c in p if c in normal}
        extra = sorted({c for p in normal for c in p} - self.char_ids.keys())
        self.extra = extra
        self.char_ids |= {c: len(self.pieces) + k for k, c in enumerate(extra)}
        symbol = dict(normal) | {c: i for c, i in self.char_ids.items()}
        order = {s: k for k, s in enumerate(sorted({self.scores[i] for i in normal.values()}, reverse=True))}
        rows = [(symbol[p[:k]], symbol[p[k:]], order[self.scores[i]], i)
                for p, i in normal.items() for k in range(1, len(p))
                if p[:k] in symbol and p[k:] in symbol]
        self.table = PairTable(*zip(*rows))
        self._lut = np.full(0x110000, -1, np.int32)
        for c, i in self.char_ids.items():
            self._lut[ord(c)] = i
        # decode table: bytes of each id, flat
        parts = []
        for p, t in zip(self.pieces, self.types):
            parts.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL
                         else self.unk_surface.encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
        self.piece_len = np.array([len(x) for x in parts], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.marked = np.array([p[:1] == MARK and t == NORMAL for p, t in zip(self.pieces, self.types)])
        self.is_byte = np.array([t == BYTE for t in self.types])

    def encode_words(self, joined: str, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given one after another with their lengths: flat, and their number per word."""
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self._lut[code]
        sym = np.where(sym < 0, -1 - code.astype(np.int64), sym).astype(np.int32)  # keeps the character
        ids, counts = merge(sym, counts, self.table)
        odd = (ids < 0) | (ids >= len(self.pieces))
        if not odd.any():
            return ids, counts
        word = np.repeat(np.arange(len(counts)), counts)
        where = np.flatnonzero(odd)
        spelt = []
        for s in ids[where].tolist():
            c = chr(-1 - s) if s < 0 else self.extra[s - len(self.pieces)]
            spelt.append(self.byte_ids[list(c.encode("utf-8", "surrogatepass"))] if self.byte_fallback else np.array([self.unk], np.int32))
        size = np.ones(len(ids), np.int64)
        size[where] = [len(x) for x in spelt]
        out = np.empty(int(size.sum()), np.int32)
        at = np.cumsum(size) - size
        out[at[~odd]] = ids[~odd]
        out[ragged(at[where], size[where])] = np.concatenate(spelt)
        return out, np.bincount(np.repeat(word, size), minlength=len(counts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids: pieces one after another, byte pieces as
        UTF-8 (a byte that fits nowhere is U+FFFD), the first space dropped."""
        size = self.piece_len[ids]
        raw = self.piece_bytes[ragged(self.piece_at[ids], size)].tobytes()
        begin = np.cumsum(counts) - counts
        at = np.concatenate([[0], np.cumsum(size)])
        first, last = at[begin].tolist(), at[begin + counts].tolist()
        out = []
        for k, (a, b) in enumerate(zip(first, last)):
            part = raw[a:b]
            try:
                s = part.decode()
            except UnicodeDecodeError:
                s = self._decode_bytes(ids[begin[k]:begin[k] + counts[k]])
            if self.dummy_prefix and s[:1] == " " and self.marked[ids[begin[k]]]:
                s = s[1:]
            out.append(s)
        return out

    def _decode_bytes(self, ids: np.ndarray) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at:at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids.tolist():
            part = self.piece_bytes[self.piece_at[i]:self.piece_at[i] + self.piece_len[i]].tobytes()
            if self.is_byte[i]:
                run += part
            else:
                flush()
                out.append(part.decode())
        flush()
        return "".join(out)


_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


class Encoder:
    """Encodes texts by their distinct words; the words seen are kept for later slices."""

    def __init__(self, path: str):
        self.model = Model(path)
        self._start()

    def _start(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        """Words without their mark where every word has just one, else with all marks."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " " or not self.model.dummy_prefix:
            marked = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
            head = re.match(f"[^{MARK}]*", marked)[0]
            return ([head] if head else []) + _WORDS.findall(marked)
        return text.split(" ")

    def run(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and their number per text."""
        if len(self.words) > CACHE_WORDS:
            self._start()
        known = self.words
        split = [self.split(t) for t in batch]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        new = list(set(flat) - known.keys())
        if new:
            lengths = np.fromiter(map(len, new), np.int64, len(new))
            if self.model.dummy_prefix:  # a word without its mark gets it; words that have theirs come last
                new.sort(key=lambda w: w[:1] == MARK)
                plain = next((k for k, w in enumerate(new) if w[:1] == MARK), len(new))
                lengths = np.fromiter(map(len, new), np.int64, len(new))
                lengths[:plain] += 1
                joined = (MARK + MARK.join(new[:plain]) if plain else "") + "".join(new[plain:])
            else:
                joined = "".join(new)
            ids, counts = self.model.encode_words(joined, lengths)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        word = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        starts = np.cumsum(self.counts) - self.counts
        ids = self.ids[ragged(starts[word], self.counts[word])]
        return ids, segment_sums(self.counts[word], np.concatenate([[0], np.cumsum(sizes)]))


class Decimals:
    """Ids of a text in decimal, joined by commas."""

    def __init__(self, size: int):
        parts = [b"%d," % i for i in range(size)]
        self.size = np.array([len(x) for x in parts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(parts), np.uint8)

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        raw = self.raw[ragged(self.at[ids], size)].tobytes()
        ends = np.cumsum(segment_sums(size, np.concatenate([[0], np.cumsum(counts)]))).tolist()
        return [raw[a:max(a, b - 1)] for a, b in zip([0, *ends], ends)]


def encode_decode(df: DataFrame, model_path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, ids, decoded`` (``with_ids``), else
    ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Map-only."""
    def make():
        enc = Encoder(model_path)
        decimals = Decimals(len(enc.model.pieces))

        def work(batch: pa.RecordBatch) -> dict:
            ids, counts = enc.run(texts(batch))
            back = enc.model.decode(ids, counts)
            if with_ids:
                return {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32())), "decoded": back}
            return {"doc_id": batch.column(0), "n_tokens": counts,
                    "ids_sha256": [hashlib.sha256(s).hexdigest() for s in decimals.join(ids, counts)],
                    "decoded_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in back]}
        return work
    schema = "doc_id long, ids array<int>, decoded string" if with_ids else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    # ids and texts go back whole: slices are smaller, for the memory beside the ids
    return map_batches(text_rows(df, id_col, text_col), schema, make, limit=WITH_IDS_BYTES if with_ids else SLICE_BYTES)
