"""Byte-level BPE of a ``tokenizers`` JSON file: pieces, pre-tokens, merges.

``pieces`` cuts a text at single spaces. Such a cut is always a pre-token border
when neither neighbour is white space, so every distinct piece is worked out once
and reused; texts where that doesn't hold, and texts with the string of an added
special token, take the pre-token pattern over the whole text.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from parley.llm.bpe import PairTable, merge

#: Fixed value: the pre-token pattern of the byte-level pre-tokeniser.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE files without a normaliser or prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        to_char = byte_chars()
        back = {c: b for b, c in to_char.items()}
        self.byte_ids = np.array([vocab[to_char[b]] for b in range(256)], np.int32)
        rows = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            rows.append((vocab[a], vocab[b], rank, vocab[a + b]))
        self.table = PairTable(*zip(*rows))
        self.token_bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        #: ids whose bytes start with a space
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for i, s in self.token_bytes.items() if s[:1] == b" "]] = True

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and their number per word."""
        return self.merge_all_flat(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def merge_all_flat(self, raw: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words given as bytes one after another with their lengths."""
        return merge(self.byte_ids[raw], counts, self.table)

    def whole_tokens(self) -> set[str]:
        """The vocabulary strings proven to encode alone as their one token: the
        merges, run over the bytes of every vocabulary string, leave one symbol."""
        ids = list(self.token_bytes)
        flat, counts = self.merge_all([self.token_bytes[i] for i in ids])
        begin = np.cumsum(counts) - counts
        out = set()
        for i, n, first in zip(ids, counts.tolist(), flat[begin].tolist()):
            if n == 1 and first == i:
                try:
                    out.add(self.token_bytes[i].decode())
                except UnicodeDecodeError:
                    pass  # part of a character: never a pre-token
        return out

    def segments(self, text: str) -> list[str]:
        """The text between the strings of special tokens; the strings themselves are in odd places."""
        if not any(s in text for s in self.special):
            return [text]
        out, at = [], 0
        for m in self.special_cut.finditer(text):
            out += [text[at:m.start()], m[0]]
            at = m.end()
        return [*out, text[at:]]


def unsafe(pieces: list[str]) -> list[str]:
    """The pieces next to which the cut at a space may not be a pre-token border."""
    return [p for p in pieces if not p or len(p.strip()) != len(p)]
