"""Byte n-gram statistics shared by the two language models of this subpackage.

A gram packs `order` context bytes and the byte that follows them into one unsigned 64-bit
integer, oldest byte highest. A text starts with `order` zero bytes as its context, so every
byte of a text has a gram and none crosses two texts.
"""

from __future__ import annotations

import numpy as np

CHUNK_BYTES = 1 << 20


def chunks(texts, limit=CHUNK_BYTES):
    """Split encoded texts into runs of about `limit` bytes; yields (first index, list of bytes)."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= limit:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def grams(encoded, order):
    """Grams of all bytes of the encoded texts, and the number of them in each text."""
    pad = b"\0" * order
    raw = np.frombuffer(b"".join(pad + t for t in encoded), np.uint8).astype(np.uint64)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(encoded), np.int64)
    code = raw.copy()
    for i in range(1, order + 1):
        code[i:] |= raw[:-i] << np.uint64(8 * i)
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    starts = np.cumsum(lengths + order) - lengths
    keep = np.ones(len(raw), bool)
    for i in range(1, order + 1):
        keep[starts - i] = False
    return code[keep], lengths


def mask(n_bytes):
    return np.uint64((1 << (8 * n_bytes)) - 1)


def summed(keys, counts):
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def found(table, keys):
    """Positions of keys in a sorted table, and which of them are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class ContextTree:
    """Byte contexts of order 0 to `order` with the symbols that followed them (method C escapes).

    The statistics are frozen. A symbol's code length starts at the longest context that was seen;
    a context that never saw the symbol escapes to its suffix, where the symbols already ruled out
    are excluded. Every symbol seen after a context was seen after its suffix too, so what is ruled
    out depends on the longer context alone, and one number for it gives the exact denominator.
    """

    def __init__(self, keys, counts, order):
        self.order, self.levels = order, []
        for k in range(order + 1):
            symbols, n = summed(keys & mask(k + 1), counts)
            contexts, first = np.unique(symbols >> np.uint64(8), return_index=True)
            total = np.add.reduceat(n, first) if len(first) else n
            distinct = np.diff(np.r_[first, len(symbols)])
            left, left_kinds = np.zeros(len(contexts)), np.zeros(len(contexts))
            if k:
                below = self.levels[-1]
                owner = np.repeat(np.arange(len(contexts)), distinct)
                at, _ = found(below["symbols"], symbols & mask(k))
                ruled = np.bincount(owner, below["n"][at], len(contexts))
                up, _ = found(below["contexts"], contexts & mask(k - 1))
                left = below["total"][up] - ruled
                left_kinds = (below["distinct"][up] - distinct).astype(float)
            self.levels.append({"symbols": symbols, "n": n.astype(float), "contexts": contexts, "total": total.astype(float), "distinct": distinct.astype(float), "left": left, "left_kinds": left_kinds})

    def bits(self, keys):
        """Exact code length of each gram's last byte after its context."""
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        total = kinds = None
        begun = np.zeros(len(keys), bool)
        after_total, after_kinds = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            at, there = found(level["contexts"], (keys >> np.uint64(8)) & mask(k))
            live = open_ & there
            if not len(level["contexts"]):
                continue
            total = np.where(begun, after_total, level["total"][at])
            kinds = np.where(begun, after_kinds, level["distinct"][at])
            pos, seen = found(level["symbols"], keys & mask(k + 1))
            hit, miss = live & seen, live & ~seen & (kinds > 0)
            out[hit] += np.log2((total + kinds)[hit] / level["n"][pos][hit])
            out[miss] += np.log2((total + kinds)[miss] / kinds[miss])
            open_ &= ~hit
            begun |= live
            after_total = np.where(live, level["left"][at], after_total)
            after_kinds = np.where(live, level["left_kinds"][at], after_kinds)
        rest = 256 - (len(self.levels[0]["symbols"]) if self.levels else 0)
        out[open_] += np.log2(max(rest, 1))
        return out


class KneserNey:
    """Interpolated Kneser-Ney over bytes for several classes with shared low orders.

    Contexts longer than `shared` bytes have counts of their own in each class; from there down
    all classes back off to one table of continuation counts.
    """

    def __init__(self, keys, counts, order, shared, discount=0.75):
        """counts: one array of counts for each class, aligned with keys."""
        self.order, self.shared, self.discount = order, shared, discount
        self.base = self._table(keys, sum(counts), shared)
        self.own = [self._table(keys[n > 0], n[n > 0], order, shared + 1) for n in counts]

    def _table(self, keys, counts, top, low=0):
        levels = {}
        for k in range(low, top + 1):
            if k == self.order:
                symbols, n = summed(keys, counts)
            else:  # how many different bytes came before
                longer = np.unique(keys & mask(k + 2))
                symbols, n = summed(longer & mask(k + 1), np.ones(len(longer)))
            contexts, first = np.unique(symbols >> np.uint64(8), return_index=True)
            total = np.add.reduceat(n, first) if len(first) else n
            levels[k] = (symbols, n.astype(float), contexts, total.astype(float), np.diff(np.r_[first, len(symbols)]).astype(float))
        return levels

    def _mix(self, levels, ks, keys, p):
        for k in ks:
            symbols, n, contexts, total, kinds = levels[k]
            if not len(contexts):
                continue
            at, there = found(contexts, (keys >> np.uint64(8)) & mask(k))
            pos, seen = found(symbols, keys & mask(k + 1))
            c = np.where(seen, np.maximum(n[pos] - self.discount, 0), 0)
            p = np.where(there, (c + self.discount * kinds[at] * p) / total[at], p)
        return p

    def nats(self, keys):
        """Log probabilities of the grams' last bytes: one row for each class."""
        p = self._mix(self.base, range(self.shared + 1), keys, np.full(len(keys), 1 / 256))
        return np.stack([np.log(self._mix(own, range(self.shared + 1, self.order + 1), keys, p)) for own in self.own])


class GramScores:
    """Scores of grams by a model, each distinct gram once; remembers at most `limit` of them."""

    def __init__(self, score, width, limit=600_000):
        self.score, self.width, self.limit = score, width, limit
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((width, 0), np.float32)

    def __call__(self, keys):
        at, there = found(self.keys, keys)
        if there.all() and len(self.keys):
            return self.values[:, at]
        out = self.values[:, at] if len(self.keys) else np.zeros((self.width, len(keys)), np.float32)
        new = keys[~there]
        out[:, ~there] = fresh = self.score(new)
        if len(self.keys) + len(new) <= self.limit:
            both = np.concatenate([self.keys, new])
            order = np.argsort(both, kind="stable")
            self.keys, self.values = both[order], np.concatenate([self.values, fresh.astype(np.float32)], axis=1)[:, order]
        return out

    def per_text(self, encoded, order):
        """Sums of the scores over each text's bytes: an array (width, texts)."""
        out = np.zeros((self.width, len(encoded)))
        for start, part in chunks(encoded):
            code, lengths = grams(part, order)
            if not len(code):
                continue
            distinct, place = np.unique(code, return_inverse=True)
            values = self(distinct)
            ends = np.cumsum(lengths)
            for row in range(self.width):
                run = np.r_[0.0, np.cumsum(values[row][place], dtype=np.float64)]
                out[row, start : start + len(part)] = run[ends] - run[ends - lengths]
        return out
