"""Token counts with a whole-token shortcut.

Before the scan, the merges are run over the bytes of every vocabulary string;
those that end as their own single token are proven whole. In the scan a
pre-token that is such a string counts one; only the rest are merged, all of a
slice at once (``bpe.merge``), and their counts kept for later slices.

A null or empty text has 0 bytes and 0 tokens. The string of a special token in
a text counts as that one token, as in the library's default.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.byte_bpe import PATTERN, ByteBPE, unsafe
from parley.llm.common import flat, map_batches, segment_sums, text_rows, texts

#: Distinct pieces a task keeps between slices; beyond it the cache starts anew.
CACHE_PIECES = 300_000
#: Makes the sum over a text with an unsafe piece negative.
UNSAFE = -1 << 60


class Counter:
    def __init__(self, path: str):
        self.bpe = ByteBPE(path)
        self.whole = self.bpe.whole_tokens()
        self._start()

    def _start(self) -> None:
        self.first: dict[str, int] = {}                 # pieces at a text's start
        self.spaced: dict[str, int] = {}                # pieces after a space
        self.known = dict.fromkeys(self.whole, 1)       # pre-tokens: the whole ones, and the merged ones so far

    def _count_new(self, pretokens: list[str]) -> np.ndarray:
        rest = list(set(pretokens) - self.known.keys())
        if rest:
            _, counts = self.bpe.merge_all([t.encode() for t in rest])
            self.known.update(zip(rest, counts.tolist()))
        return np.fromiter(map(self.known.__getitem__, pretokens), np.int64, len(pretokens))

    def _add(self, cache: dict[str, int], pieces: list[str], lead: str) -> None:
        """Counts of new pieces; UNSAFE marks an unsafe one. All safe pieces go through
        the pattern as one text, where each starts at a pre-token with a space."""
        odd = set(unsafe(pieces))
        cache.update(dict.fromkeys(odd, UNSAFE))
        safe = [p for p in pieces if p not in odd] if odd else pieces
        if not safe:
            return
        if lead:
            pre = PATTERN.findall(" " + " ".join(safe))
            starts = np.flatnonzero(np.fromiter((t[0] == " " for t in pre), bool, len(pre)))
            counts = np.add.reduceat(self._count_new(pre), starts).tolist()
        else:
            split = [PATTERN.findall(p) for p in safe]
            each = self._count_new([t for s in split for t in s])
            counts = segment_sums(each, np.concatenate([[0], np.cumsum([len(s) for s in split])])).tolist()
        cache.update(zip(safe, counts))

    def _slow(self, text: str) -> int:
        n = 0
        for k, part in enumerate(self.bpe.segments(text)):
            n += 1 if k % 2 else int(self._count_new(PATTERN.findall(part)).sum())
        return n

    def count(self, batch: list[str]) -> list[int]:
        if len(self.spaced) + len(self.known) > 2 * CACHE_PIECES:
            self._start()
        special = tuple(self.bpe.special)
        out, todo, split = [0] * len(batch), [], []
        for k, t in enumerate(batch):
            if not t:
                continue
            if any(s in t for s in special):
                out[k] = self._slow(t)
            else:
                todo.append(k)
                split.append(t.split(" "))
        heads = [s[0] for s in split]
        tails = [s[1:] for s in split]
        self._add(self.first, list(set(heads) - self.first.keys()), "")
        self._add(self.spaced, list(set().union(*tails) - self.spaced.keys()), " ")
        first, spaced = self.first, self.spaced.__getitem__
        for k, h, tail in zip(todo, heads, tails):
            n = first[h] + sum(map(spaced, tail))
            out[k] = n if n >= 0 else self._slow(batch[k])
        return out


def token_counts(df: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). Map-only."""
    def make():
        counter = Counter(tokenizer_path)

        def work(batch: pa.RecordBatch) -> dict:
            n = counter.count(texts(batch))
            _, off = flat(batch)
            return {"doc_id": batch.column(0), "n_bytes": np.diff(off), "n_tokens": pa.array(n, pa.int64()), "over_limit": [x > limit for x in n]}
        return work
    return map_batches(text_rows(df, id_col, text_col), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
