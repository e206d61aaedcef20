"""Pre-tokens of many texts at once, and a table of the token ids that are known of them.

Texts of a slice are one array of code points. Borders of pre-tokens are where the class of characters (white space,
letters, numbers, others) changes, shifted by a leading space and by contractions: a few NumPy operations for all
texts together, equal to the tokenizer's pattern. A pre-token of up to 23 bytes is its own key (its bytes and their
number in three words of 64 bits), looked up in a table by a hash and compared in full; those not known are told
apart and encoded once. Longer ones are kept by their text. The table is of arrays, so that what it takes is known
and is given back; it is emptied when it has grown past its limit.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

BLANK, LETTER, NUMBER, OTHER, END = range(5)
#: Bytes of the longest pre-token that is kept in the table.
KEY = 23
BITS = 20
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
MASKS = np.array([[(1 << 8 * min(8, max(0, size - 8 * k))) - 1 for k in range(3)] for size in range(KEY + 1)], np.uint64)
QUOTE, SHORT, LONG = ord("'"), np.array([ord(c) for c in "stmd"], np.uint32), [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]


@functools.cache
def kinds(space: str) -> np.ndarray:
    """The class of every code point; space: the pattern's white space, as inside a set of characters."""
    out = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):  # surrogates are no characters
        every = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, f"[{space}]+")):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = kind
    return out


def cut(texts: list[str], space: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of the texts, each followed by a byte; first byte and size of each pre-token; places of those that are these ends (size 1)."""
    whole = "\n".join([*texts, ""])
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = kinds(space)[code]
    kind[ends] = END
    begins = np.ones(len(code), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[ends], begins[ends[:-1] + 1] = True, True
    # the last of white space before a word stands alone, or is the word's if it is a space
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & (kind[1:] != END))
    begins[last] = True
    begins[last[code[last] == 32] + 1] = False
    mark = np.flatnonzero((code[:-2] == QUOTE) & begins[:-2])
    one, two = code[mark + 1], code[mark + 2]
    short = mark[np.isin(one, SHORT)]
    begins[short + 1], begins[short + 2] = False, True
    long = mark[functools.reduce(np.logical_or, [(one == a) & (two == b) for a, b in LONG])]
    begins[long + 1], begins[long + 3] = False, True
    raw, at = whole.encode(), np.flatnonzero(begins)
    closes = np.flatnonzero(kind[at] == END)
    if len(raw) > len(code):
        width = (code >= 0x80).astype(np.int64)
        width += code >= 0x800
        width += code >= 0x10000
        width += 1
        at = (np.cumsum(width) - width)[at]
    return raw, at, np.diff(at, append=len(raw)), closes


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n rows at least."""
    if n <= len(x):
        return x
    out = np.zeros((max(n, 2 * len(x)), *x.shape[1:]), x.dtype)
    out[: len(x)] = x
    return out


class Known:
    """Ids of known pre-tokens; encode(bytes, at, size) gives those of distinct words in order of size, one after the other, and how many each has."""

    def __init__(self, space: str, encode, limit: int = 480_000):
        self.space, self.encode, self.limit = space, encode, limit
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(1 << BITS, np.int32)
        self.entries, self.used = 1, 0  # entry 0 is no word: its size is 0
        self.keys, self.first, self.n = np.zeros((1 << 12, 3), np.uint64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.long: dict[str, int] = {}  # entries of words beyond KEY bytes
        self.held = 0  # their characters

    def _add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """New entries for words with these keys."""
        low, self.entries = self.entries, self.entries + len(n)
        self.keys, self.first, self.n = (grown(x, self.entries) for x in (self.keys, self.first, self.n))
        self.ids = grown(self.ids, self.used + len(ids))
        self.keys[low : self.entries], self.n[low : self.entries] = keys, n
        self.first[low : self.entries] = self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return np.arange(low, self.entries)

    def _learn(self, byte: np.ndarray, at: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Entries of distinct words that were not known."""
        order, out = np.argsort(size, kind="stable"), np.empty(len(at), np.int64)
        out[order] = self._add(keys[order], *self.encode(byte, at[order], size[order]))
        return out

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.entries > self.limit or self.used > 16 * self.limit or self.held > 16 * self.limit:
            self.clear()
        if not texts:
            return []
        raw, at, size, closes = cut(texts, self.space)
        byte = np.frombuffer(raw + bytes(KEY + 1), np.uint8)
        entry = np.zeros(len(at), np.int64)
        short = size <= KEY
        short[closes] = False
        short = np.flatnonzero(short)
        key = np.lib.stride_tricks.sliding_window_view(byte, KEY + 1)[at[short]].view("<u8")
        key &= MASKS[size[short]]
        key[:, 2] |= size[short].astype(np.uint64) << np.uint64(56)
        a, b, c, last = MULTIPLIERS
        mixed = key[:, 0] * a ^ (key[:, 1] + b) * b ^ (key[:, 2] + c) * c
        mixed ^= mixed >> np.uint64(32)
        mixed *= last
        slot = (mixed >> np.uint64(64 - BITS)).astype(np.int64)
        found = self.slots[slot].astype(np.int64)
        there = self.keys[found]
        miss = np.flatnonzero((there[:, 0] != key[:, 0]) | (there[:, 1] != key[:, 1]) | (there[:, 2] != key[:, 2]))
        while len(miss):  # once, unless different words agree in all bits of their hash
            _, one, group = np.unique(mixed[miss], return_index=True, return_inverse=True)
            one = miss[one]
            new = self._learn(byte, at[short[one]], size[short[one]], key[one])
            self.slots[slot[one]] = new
            same = (key[miss] == key[one[group]]).all(1)
            found[miss[same]] = new[group[same]]
            miss = miss[~same]
        entry[short] = found
        for i in np.flatnonzero(size > KEY).tolist():
            word = raw[at[i] : at[i] + size[i]].decode()
            if word not in self.long:
                self.long[word] = int(self._add(np.zeros((1, 3), np.uint64), *self.encode(byte, at[i : i + 1], size[i : i + 1]))[0])
                self.held += len(word)
            entry[i] = self.long[word]
        n = self.n[entry]
        upto = np.cumsum(n)
        place = np.repeat(self.first[entry] - upto + n, n)
        place += np.arange(len(place))
        ids, borders = self.ids[place].astype("<u4").tobytes(), [0, *(4 * upto[closes]).tolist()]
        return [ids[x:y] for x, y in zip(borders, borders[1:])]
