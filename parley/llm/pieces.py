"""Ids of texts by their distinct pieces, with Arrow's hash tables instead of Python's.

Texts are cut at single spaces, the pieces of a slice numbered by Arrow's
dictionary encoding, and those not seen before pre-tokenised and merged together
as flat arrays. See ``byte_bpe.unsafe`` for where such cuts hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from parley.llm.byte_bpe import PATTERN, ByteBPE, unsafe
from parley.llm.common import ragged, segment_sums

#: Distinct pieces a task keeps between slices; beyond it the cache starts anew.
CACHE_PIECES = 300_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


def char_classes() -> np.ndarray:
    """Class of every code point, by the same properties as the pre-token pattern."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    everything = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            out[points[m.start():m.end()]] = kind
    return out


class Known:
    """Numbers of pieces seen so far, and the ids of each."""

    def __init__(self):
        self.values = pa.array([], pa.large_string())
        self.ids, self.counts = np.zeros(0, np.uint16), np.zeros(0, np.int64)

    def number(self, pieces: pa.Array, encode) -> np.ndarray:
        """The number of each piece; ``encode`` gives (ids, counts) of the new ones."""
        coded = pc.dictionary_encode(pieces)
        distinct = coded.dictionary
        at = pc.index_in(distinct, value_set=self.values)
        missing = pc.is_null(at).to_numpy(zero_copy_only=False)
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if missing.any():
            new = distinct.filter(pa.array(missing))
            ids, counts = encode(new.to_pylist())
            place[missing] = len(self.values) + np.arange(len(new))
            self.values = pa.concat_arrays([self.values, new])
            self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype if ids.max(initial=0) < 1 << 16 and self.ids.dtype == np.uint16 else np.uint32)])
            self.counts = np.concatenate([self.counts, counts])
        return place[coded.indices.to_numpy(zero_copy_only=False)]


class PieceEncoder:
    def __init__(self, path: str):
        self.bpe = ByteBPE(path)
        self.classes = char_classes()
        self._start()

    def _start(self) -> None:
        self.heads, self.tails = Known(), Known()

    def _pieces(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, each after a space (``lead``) or at a text's start;
        an unsafe piece has count -1 and no ids."""
        odd = set(unsafe(pieces))
        safe = [p for p in pieces if p not in odd] if odd else pieces
        out = np.full(len(pieces), -1, np.int64)
        if not safe:
            return np.zeros(0, np.uint32), out
        joined = lead + lead.join(safe)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, safe), np.int64, len(safe)) + len(lead)
        begin = np.cumsum(sizes) - sizes
        kind = self.classes[code]
        if lead:
            kind[begin] = kind[begin + 1]                # the space goes with what follows it
        start = np.ones(len(code), bool)
        start[1:] = kind[1:] != kind[:-1]
        start[begin] = True
        # contractions and runs of white space: by the pattern itself
        hard = (code == ord("'"))
        hard[1:] |= (kind[1:] == SPACE) & (kind[:-1] == SPACE)
        for k in np.flatnonzero(np.logical_or.reduceat(hard, begin)).tolist():
            a = begin[k]
            start[a:a + sizes[k]] = False
            start[a + np.cumsum([0] + [len(t) for t in PATTERN.findall(lead + safe[k])][:-1])] = True
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        words = np.flatnonzero(start)
        ids, counts = self.bpe.merge_all_flat(np.frombuffer(joined.encode(), np.uint8), np.add.reduceat(width, words))
        got = np.add.reduceat(counts, np.searchsorted(words, begin))
        if odd:
            out[np.fromiter((p not in odd for p in pieces), bool, len(pieces))] = got
        else:
            out = got
        return ids, out

    def _slow(self, text: str) -> np.ndarray:
        parts = []
        for k, s in enumerate(self.bpe.segments(text)):
            if k % 2:
                parts.append(np.array([self.bpe.special[s]], np.uint32))
            elif s:
                parts.append(self.bpe.merge_all([t.encode() for t in PATTERN.findall(s)])[0].astype(np.uint32))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and their number per text; a null is empty."""
        if len(self.tails.values) + len(self.heads.values) > CACHE_PIECES:
            self._start()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        split = pc.split_pattern(texts, " ")
        off = split.offsets.to_numpy().astype(np.int64)
        flat = split.flatten()
        off = off - off[0]
        first = np.zeros(len(flat), bool)
        first[off[:-1]] = True
        heads = self.heads.number(flat.filter(pa.array(first)), lambda p: self._pieces(p, ""))
        tails = self.tails.number(flat.filter(pa.array(~first)), lambda p: self._pieces(p, " "))
        n_tails = np.diff(off) - 1
        bounds = np.concatenate([[0], np.cumsum(n_tails)])
        head_n, tail_n = self.heads.counts[heads], self.tails.counts[tails]
        special = np.zeros(n, bool)
        for s in self.bpe.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        slow = ((head_n < 0) | (segment_sums(tail_n < 0, bounds) > 0) | special) & ~empty
        whole = {int(k): self._slow(texts[int(k)].as_py()) for k in np.flatnonzero(slow)}
        off_text = slow | empty
        head_n = np.where(off_text, 0, head_n)
        tail_n = np.where(np.repeat(off_text, n_tails), 0, tail_n)
        slow_n = np.zeros(n, np.int64)
        for k, ids in whole.items():
            slow_n[k] = len(ids)
        per_tail = segment_sums(tail_n, bounds)
        counts = head_n + per_tail + slow_n
        out = np.empty(int(counts.sum()), np.uint32)
        at = np.cumsum(counts) - counts
        for known, number, size, to in ((self.heads, heads, head_n, at), (self.tails, tails, tail_n, None)):
            have = np.maximum(known.counts, 0)
            ids = known.ids[ragged((np.cumsum(have) - have)[number], size)]
            out[ragged(at, head_n) if to is not None else ragged(at + head_n, per_tail)] = ids
        for k, ids in whole.items():
            out[at[k]:at[k] + len(ids)] = ids
        return out, counts
