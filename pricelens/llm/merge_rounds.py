"""Encoding of many distinct words at once, for operators that need token ids but have no method for them.

Words of equal length in bytes are rows of a matrix. In each round every row merges its pair of lowest rank (the leftmost of
equal ones), so a round is a few NumPy operations for all words together. Long words, for which rounds would cost the square
of the length, take the trie walk.
"""

from __future__ import annotations

import numpy as np

from .bpe import Bpe

#: Bytes up to which a word takes part in rounds.
SHORT = 40
NONE = np.int32(2**31 - 1)
BITS = 18
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class RoundsBpe(Bpe):
    """A tokenizer whose words are merged in rounds."""

    def __init__(self, definition: str, limit: int = 400_000):
        super().__init__(definition, limit)
        special = set(self.special.values())
        whole = {b: i for i, b in self.bytes_of.items() if i not in special}
        self.first = np.array([whole.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = np.array(list(self.merge), np.uint64)
        self.ranks = np.array(list(self.merge.values()), np.int32)
        self.made = np.full(int(self.ranks.max(initial=0)) + 1, -1, np.int32)
        for pair, rank in self.merge.items():
            self.made[rank] = whole[self.bytes_of[pair >> 32] + self.bytes_of[pair & 0xFFFFFFFF]]
        # open addressing; a free slot holds the largest key
        bits = max(BITS, len(pairs).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots, self.slot_rank = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, NONE)
        left, at = np.arange(len(pairs)), self._home(pairs)
        while len(left):
            free = self.slots[at] == ~np.uint64(0)
            _, once = np.unique(at, return_index=True)
            take = np.zeros(len(left), bool)
            take[once] = True
            take &= free
            self.slots[at[take]], self.slot_rank[at[take]] = pairs[left[take]], self.ranks[left[take]]
            left, at = left[~take], (at[~take] + 1) & self.mask

    def _home(self, pair: np.ndarray) -> np.ndarray:
        return ((pair * SPREAD) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; NONE where they do not merge."""
        pair = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._home(pair)
        seen = self.slots[at]
        out = np.where(seen == pair, self.slot_rank[at], NONE)
        open_ = np.flatnonzero((seen != pair) & (seen != ~np.uint64(0)))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.slots[at[open_]]
            hit = seen == pair[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (seen != ~np.uint64(0))]
        return out

    def _rows(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are rows of bytes, one after the other; how many each has."""
        n, size = raw.shape
        token = self.first[raw]
        if token.min(initial=0) < 0:
            raise ValueError("the vocabulary lacks a byte")
        token, alive = np.ascontiguousarray(token), np.ones((n, size), bool)
        rank = np.full((n, size), NONE)  # of the pair that begins at a place
        if size > 1:
            rank[:, :-1] = self._rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, size - 1)
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, size - 1, dtype=np.int32), (n, 1))
        # flat views, so that a place is one number
        token_, alive_, rank_, after_, before_ = (x.reshape(-1) for x in (token, alive, rank, after, before))
        row = np.arange(n)
        while True:
            at = (rank if len(row) == n else rank[row]).argmin(1)
            base = row * size
            here = base + at
            least = rank_[here]
            busy = least != NONE
            if not busy.all():
                row, at, base, here, least = row[busy], at[busy], base[busy], here[busy], least[busy]
            if not len(row):
                break
            gone = base + after_[here]
            far = after_[gone]
            token_[here] = self.made[least]
            alive_[gone], rank_[gone] = False, NONE
            after_[here] = far
            back = before_[here]
            has_far, has_back = np.flatnonzero(far < size), np.flatnonzero(back >= 0)
            right, left = base[has_far] + far[has_far], base[has_back] + back[has_back]
            before_[right] = at[has_far]
            rank_[here] = NONE
            both = self._rank(np.concatenate((token_[here[has_far]], token_[left])), np.concatenate((token_[right], token_[here[has_back]])))
            rank_[here[has_far]], rank_[left] = both[: len(has_far)], both[len(has_far) :]
        return token[alive].astype(np.uint32), alive.sum(1)

    def encode_bytes(self, byte: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        borders = [*np.flatnonzero(np.diff(size, prepend=-1)).tolist(), len(size)]
        out = []
        for a, b in zip(borders, borders[1:]):
            n = int(size[a])
            out.append(self._rows(byte[at[a:b, None] + np.arange(n)]) if n <= SHORT else super(RoundsBpe, self).encode_bytes(byte, at[a:b], size[a:b]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def encode_words(self, words) -> dict[str, bytes]:
        words = sorted(words, key=lambda w: len(w.encode()))
        raw = list(map(str.encode, words))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        some = np.flatnonzero(size)  # an empty one has no ids
        out = dict.fromkeys(words, b"")
        if len(some):
            ids, n = self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(size) - size)[some], size[some])
            ids, upto = ids.astype("<u4").tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
            out.update((words[i], ids[a:b]) for i, a, b in zip(some.tolist(), upto, upto[1:]))
        return out
