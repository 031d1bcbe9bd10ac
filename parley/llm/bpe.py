"""Byte-pair merges in vectorised rounds over flat symbol arrays.

All words of a batch lie one after another in one array. Every neighbouring
pair has its rank. A round takes each word's smallest rank, merges its leftmost
pair of that rank in every word at once, compacts the arrays, and looks up the
pairs next to the merges; words without a known pair leave. The rounds end when no word is left. A word takes as
many rounds as it has merges, so words beyond ``LONG`` symbols, whose rounds
would cost the square of their length, go through a heap instead.
"""

from __future__ import annotations

import heapq

import numpy as np

from parley.llm.common import ragged

LONG = 200
NONE = np.iinfo(np.int32).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from a pair of symbols to (rank, merged symbol)."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.bits = max(8, int(np.ceil(np.log2(len(left) + 1))) + 3)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.zeros(size, np.int32)
        self.merged = np.zeros(size, np.int32)
        todo, slot = np.arange(len(left)), self._slot(left << 32 | right)
        key = left << 32 | right
        rank, merged = np.asarray(rank), np.asarray(merged)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]] = key[todo[put]]
            self.rank[slot[put]] = rank[todo[put]]
            self.merged[slot[put]] = merged[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & (size - 1)
        self.pairs = None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, -1 where it is not in the table."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, slot, -1)
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (held >= 0)]
        return out

    def one(self, left: int, right: int):
        if self.pairs is None:
            at = np.flatnonzero(self.keys >= 0)
            self.pairs = dict(zip(self.keys[at].tolist(), zip(self.rank[at].tolist(), self.merged[at].tolist())))
        return self.pairs.get(left << 32 | right) if left >= 0 and right >= 0 else None


def merge(symbols: np.ndarray, counts: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of all words, flat, and their number per word. A negative
    symbol never merges."""
    symbols, counts = symbols.astype(np.int32), counts.astype(np.int64)
    n = len(counts)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, counts, symbols
    starts = np.cumsum(counts) - counts
    long = np.flatnonzero(counts > LONG)
    for w in long:
        got = _merge_long(symbols[starts[w]:starts[w] + counts[w]].tolist(), table)
        done.append((np.array([w]), np.array([len(got)]), np.array(got, np.int32)))
    live = np.flatnonzero((counts <= LONG) & (counts > 1))
    short = np.flatnonzero(counts <= 1)
    done.append((short, counts[short], symbols[ragged(starts[short], counts[short])]))
    cur, cnt = symbols[ragged(starts[live], counts[live])], counts[live]
    end = np.zeros(len(cur), bool)
    end[np.cumsum(cnt) - 1] = True                       # last symbol of its word
    rank = np.full(len(cur), NONE, np.int32)             # of the pair (i, i + 1)
    into = np.zeros(len(cur), np.int32)

    def rate(at: np.ndarray) -> None:
        left, right = cur[at], cur[at + 1]
        ok = (left >= 0) & (right >= 0)
        at = at[ok]
        slot = table.find(left[ok], right[ok])
        hit = slot >= 0
        rank[at] = np.where(hit, table.rank[slot], NONE)
        into[at] = table.merged[slot]

    if len(cur):
        rate(np.flatnonzero(~end))
    while len(live):
        # rank and place in one number: the smallest is the leftmost pair of the smallest rank
        best = np.minimum.reduceat(rank.astype(np.int64) << 32 | np.arange(len(cur)), np.cumsum(cnt) - cnt)
        more = (best >> 32) < NONE
        at = best[more] & 0xFFFFFFFF
        cur[at] = into[at]
        end[at] = end[at + 1]
        keep = np.ones(len(cur), bool)
        keep[at + 1] = False
        if not more.all():
            member = np.repeat(more, cnt)
            over = ~more
            done.append((live[over], cnt[over], cur[~member]))
            keep &= member
            at = np.cumsum(keep)[at] - 1
            live, cnt = live[more], cnt[more]
        else:
            at = at - np.arange(len(at))
        cur, end, rank, into, cnt = cur[keep], end[keep], rank[keep], into[keep], cnt - 1
        rank[at] = NONE
        before = at - 1
        rate(np.concatenate([at[~end[at]], before[(at > 0) & ~end[before]]]))
    words = np.concatenate([x[0] for x in done])
    sizes = np.concatenate([x[1] for x in done])
    flat = np.concatenate([x[2] for x in done])
    out_counts = np.zeros(n, np.int64)
    out_counts[words] = sizes
    begin = np.empty(n, np.int64)
    begin[words] = np.cumsum(sizes) - sizes
    return flat[ragged(begin, out_counts)], out_counts


def _merge_long(syms: list[int], table: PairTable) -> list[int]:
    n = len(syms)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n)) + [-1]
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j >= 0 and (got := table.one(syms[i], syms[j])):
            heapq.heappush(heap, (got[0], i, syms[i], syms[j], got[1]))

    for i in range(n - 1):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = nxt[i]
        if gone[i] or j < 0 or syms[i] != a or syms[j] != b:
            continue
        syms[i] = merged
        gone[j] = 1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return [s for s, g in zip(syms, gone) if not g]
