"""Removal of repeated byte strings with longest-previous-factor arrays (operator 1).

A byte goes if a string of `least` bytes around it also starts in a document with a smaller id. Documents
are dealt to blocks of about BLOCK_BYTES by a hash. Every window of `least` bytes has an anchor, the 25-byte gram
of lowest hash that starts in it, so equal windows have equal anchors, and the windows of one anchor form a run.

1. A text that equals a whole earlier one goes whole and takes no further part.
2. Each block sends the keys of its anchors, each once with the number of its different runs. Keys that two
   blocks sent go back to them.
3. Each block sends the runs of shared anchors (bytes, smallest document), equal runs once; the later
   documents of an equal run lose all its windows on the spot. Anchors with more than MANY runs send their
   windows one by one, under a hash of the first PREFIX bytes, so that no group holds a hot anchor whole.
4. Each shard settles equal runs likewise. Of what then differs under one key it sorts the suffixes, takes
   for each one the previous and the next in suffix order that belong to a smaller document, and keeps the
   longer common prefix: the longest previous factor, cut at `least` bytes. Windows that reach it are dropped.
5. Each block cuts the dropped stretches out of its texts.

Hashes only propose: bytes are compared before a run is taken for equal to another (whole texts go by SHA-256).
Null and empty texts have no bytes and lose none, as do texts under `least` bytes. Texts are treated whole; one
longer than a block is a block's only one or shares it. Rows with equal ids are separate documents, neither
smaller (a tie removes nothing); null ids are larger than all others. An empty table gives an empty table. Other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, table, written
from .ngrams import found

LEAST = 50
GRAM = 25
#: An anchor with more different runs than this, over all blocks, sends single windows by their first bytes.
MANY, PREFIX = 4096, 40
#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20
PIECE = 1 << 19
SUFFIXES = 400_000
NO_ID = np.iinfo(np.int64).max
RANDOM = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
LOW = np.uint64((1 << 24) - 1)
#: Anchors are known by 48 bits of their hash; what shares them is compared byte by byte.
KEY = np.uint64((1 << 48) - 1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 25 bytes from each place on."""
    h = RANDOM[raw]
    for k, c in zip((1, 2, 4, 8), C):
        h = h[:-k] * c + h[k:]
    h = h[:-9] * C[4] + h[9:]
    h ^= h >> np.uint64(31)
    h *= C[1]
    h ^= h >> np.uint64(29)
    return h


def window_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Maximal runs of windows with one anchor inside the texts [starts, ends) of raw: first window, windows, hash."""
    n = len(raw) - LEAST + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    h = gram_hashes(raw)
    key = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    low, span = key, 1
    while span < 16:  # lowest of 2, 4, 8, 16 grams, the leftmost of equal ones
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:-10], low[10:])
    good = np.zeros(n + 1, np.int32)  # windows inside one text
    fits = ends - starts >= LEAST
    np.add.at(good, starts[fits], 1)
    np.add.at(good, ends[fits] - LEAST + 1, -1)
    good = np.cumsum(good[:n]) > 0
    anchor = (low & LOW).astype(np.int64)
    border = np.zeros(n, bool)
    border[starts[fits]] = True
    head = good & (border | np.r_[True, anchor[1:] != anchor[:-1]] | np.r_[True, ~good[:-1]])
    first = np.flatnonzero(head)
    count = np.add.reduceat(good, first) if len(first) else first
    return first, count.astype(np.int64), h[anchor[first]]


class Block:
    """The texts of one block, smallest document first; copies of earlier whole texts are set aside."""

    def __init__(self, pdf: pd.DataFrame, copies: pd.DataFrame | None = None):
        prints, no_id = pdf.print.to_numpy(), pdf.no_id.to_numpy()
        texts = [t.encode() if t else b"" for t in pdf.text]
        known = pdf["rank"].to_numpy()
        order = sorted(range(len(texts)), key=lambda i: (known[i], texts[i]))
        self.ids, self.rank = [None if no_id[i] else int(known[i]) for i in order], known[order]
        self.texts = [texts[i] for i in order]
        gone = set(copies.print.dropna()) if copies is not None else set()
        self.copy = [prints[i] in gone for i in order]
        self.raw = b"".join(t for t, c in zip(self.texts, self.copy) if not c)
        lengths = np.array([0 if c else len(t) for t, c in zip(self.texts, self.copy)], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def runs(self):
        """first window (place in raw), windows, anchor key, row - of all runs, in the order of raw."""
        raw = np.frombuffer(self.raw, np.uint8)
        found = []
        for at in range(0, max(len(raw) - LEAST + 1, 0), PIECE):
            part = raw[at : at + PIECE + LEAST - 1]
            lo, hi = np.searchsorted(self.ends, at, "right"), np.searchsorted(self.starts, at + len(part), "left")
            starts, ends = np.maximum(self.starts[lo:hi] - at, 0), np.minimum(self.ends[lo:hi] - at, len(part))
            first, count, h = window_runs(part, starts, ends)
            found.append((first + at, count, h & KEY))
        first, count, key = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*found)) or [(), (), ()]))
        return first, count, key.astype(np.uint64), np.searchsorted(self.ends, first, "right")


def split(key: np.ndarray, shards: int) -> np.ndarray:
    return (key % np.uint64(shards)).astype(np.int64)


def text_hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, start + length) of raw; lengths are at most 80."""
    out = np.empty(len(start), np.uint64)
    padded = np.concatenate([raw, np.zeros(80, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 80)
    for a in range(0, len(start), 1 << 16):
        s, n = start[a : a + (1 << 16)], length[a : a + (1 << 16)]
        words = np.where(np.arange(80) < n[:, None], view[s], 0).view(np.uint64)
        h = n.astype(np.uint64) * C[0]
        for j in range(words.shape[1]):
            h = (h ^ words[:, j]) * C[1 + j % 4]
            h ^= h >> np.uint64(32)
        out[a : a + len(s)] = h
    return out


def same_as_before(raw: np.ndarray, start: np.ndarray, length: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Whether the bytes of each item that is asked for are those of the item before it; lengths are at most 80."""
    out = np.zeros(len(start), bool)
    padded = np.concatenate([raw, np.zeros(80, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 80)
    which = np.flatnonzero(ask)
    for a in range(0, len(which), 1 << 16):
        i = which[a : a + (1 << 16)]
        differ = (view[start[i]] != view[start[i - 1]]) & (np.arange(80) < length[i][:, None])
        out[i] = (length[i] == length[i - 1]) & ~differ.any(axis=1)
    return out


def cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    n = len(sorted_values)
    return np.r_[np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), n] if n else np.zeros(1, np.int64)


def low_bytes(keys: np.ndarray, n: int = 6) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :n]


def from_low_bytes(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(np.uint64).ravel()


def packed(target: np.ndarray, rows: np.ndarray) -> tuple[list, list]:
    order = np.argsort(target, kind="stable")
    at = cuts(target[order])
    return target[order][at[:-1]].tolist(), [rows[order[i:j]].tobytes() for i, j in zip(at[:-1], at[1:])]


def anchors(pdf: pd.DataFrame, copies: pd.DataFrame, shards: int) -> pd.DataFrame:
    """shard, block, data: the block's distinct anchor keys, six bytes each, and how many runs they have (one byte, at most 255)."""
    if not len(pdf):
        return pd.DataFrame({"shard": [], "block": [], "data": []})
    key, n = np.unique(Block(pdf, copies).runs()[2], return_counts=True)
    shard, data = packed(split(key, shards), np.concatenate([low_bytes(key), np.minimum(n, 255).astype(np.uint8)[:, None]], axis=1))
    return pd.DataFrame({"shard": shard, "block": int(pdf.block.iloc[0]), "data": data})


def shared_anchors(pdf: pd.DataFrame, most: int = MANY) -> pd.DataFrame:
    """block, data: for each block its keys that other blocks have too; a seventh byte says whether they have more than `most` runs."""
    rows = np.frombuffer(b"".join(pdf.data), np.uint8).reshape(-1, 7)
    key, runs = from_low_bytes(rows[:, :6]), rows[:, 6].astype(np.int64)
    block = np.repeat(pdf.block.to_numpy(), [len(d) // 7 for d in pdf.data])
    order = np.argsort(key, kind="stable")
    key, block, runs = key[order], block[order], runs[order]
    at = cuts(key)
    size = np.diff(at)
    n, total = np.repeat(size, size), np.repeat(np.add.reduceat(runs, at[:-1]) if len(runs) else size, size)
    rows = np.concatenate([low_bytes(key[n > 1]), (total[n > 1] > most).astype(np.uint8)[:, None]], axis=1)
    target, data = packed(block[n > 1], rows)
    return pd.DataFrame({"block": target, "data": data})


def candidate_runs(pdf: pd.DataFrame, hits: pd.DataFrame, shards: int) -> pd.DataFrame:
    """shard, block, heads, texts, done: runs to compare with other blocks, and stretches settled here.

    hits holds keys (data) and copies (print). heads has columns of equal length, one after another:
    key, document, row, offset in the text, windows, and for bytes that were sent before the place of that run.
    done has row, start, end.
    """
    if not len(pdf):
        return pd.DataFrame({"shard": [], "block": [], "heads": [], "texts": [], "done": []})
    known = np.frombuffer(b"".join(d for d in hits.data if d is not None), np.uint8).reshape(-1, 7)
    foreign = from_low_bytes(known[:, :6])
    order = np.argsort(foreign)
    foreign, many = foreign[order], known[order, 6]
    block = Block(pdf, hits)
    raw = np.frombuffer(block.raw, np.uint8)
    first, count, key, row = block.runs()
    doc = block.rank[row]
    order = np.argsort(key, kind="stable")  # rows, so documents, stay in order
    at = cuts(key[order])
    several = np.zeros(len(key), bool)
    several[order] = np.repeat(doc[order][at[:-1]] != doc[order][at[1:] - 1], np.diff(at)) if len(key) else False
    place, there = found(foreign, key)
    pick = np.flatnonzero(there | several)
    single = (there[pick] & (many[place[pick]] > 0)) if len(foreign) else np.zeros(len(pick), bool)
    one = pick[single]  # hot anchors: windows of their own
    inner = np.arange(count[one].sum()) - np.repeat(np.cumsum(count[one]) - count[one], count[one])
    plain = pick[~single]
    start = np.concatenate([first[plain], np.repeat(first[one], count[one]) + inner])
    n = np.concatenate([count[plain], np.ones(len(inner), np.int64)])
    r = np.concatenate([row[plain], np.repeat(row[one], count[one])])
    text = text_hashes(raw, start, n + LEAST - 1)
    alone = start[len(plain) :]
    k = np.concatenate([key[plain], text_hashes(raw, alone, np.full(len(alone), PREFIX)) & KEY])
    order = np.lexsort((start, text, k))
    start, n, r, k, text = start[order], n[order], r[order], k[order], text[order]
    alike = np.r_[False, (text[1:] == text[:-1]) & (k[1:] == k[:-1])] if len(k) else np.zeros(0, bool)
    head = ~same_as_before(raw, start, n + LEAST - 1, alike)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
    d, offset = block.rank[r], start - block.starts[r]
    later = d > d[lead]
    done = merged(np.stack([r[later], offset[later], (offset + n + LEAST - 1)[later]], axis=1).astype(np.int64))
    stay = np.flatnonzero(~later)
    lead_of = np.searchsorted(stay, lead[stay])
    target = split(k[stay], shards)
    order = np.lexsort((start[stay], stay != lead[stay], target))
    at = cuts(target[order])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    pack = zstandard.ZstdCompressor(level=1).compress
    b, out = int(pdf.block.iloc[0]), []
    for i, j in zip(at[:-1], at[1:]):
        rows = stay[order[i:j]]
        again = back[lead_of[order[i:j]]] - i
        leads = int((again == np.arange(j - i)).sum())
        length = n[rows[:leads]] + LEAST - 1
        bytes_at = np.repeat(start[rows[:leads]] - np.cumsum(length) + length, length) + np.arange(length.sum())
        columns = [low_bytes(k[rows]).tobytes(), np.diff(d[rows], prepend=0).tobytes(), np.diff(r[rows], prepend=0).astype(np.int64).tobytes(), offset[rows].astype(np.int64).tobytes(), n[rows].astype(np.uint8).tobytes(), again[leads:].astype(np.int64).tobytes()]
        out.append((int(target[order[i]]), b, np.int64(j - i).tobytes() + pack(b"".join(columns)), pack(raw[bytes_at].tobytes()), b""))
    if len(done):
        out.append((b % shards, b, b"", b"", done.tobytes()))
    return pd.DataFrame(out, columns=["shard", "block", "heads", "texts", "done"])


def unpacked(heads: bytes) -> tuple[np.ndarray, ...]:
    """key, document, row, offset, windows, place of the run with the bytes."""
    m = int(np.frombuffer(heads[:8], np.int64)[0])
    data = zstandard.ZstdDecompressor().decompress(heads[8:])
    wide = np.frombuffer(data[6 * m : 30 * m], np.int64).reshape(3, m)
    again = np.frombuffer(data[31 * m :], np.int64)
    key = from_low_bytes(np.frombuffer(data[: 6 * m], np.uint8).reshape(m, 6))
    return key, np.cumsum(wide[0]), np.cumsum(wide[1]), wide[2], np.frombuffer(data[30 * m : 31 * m], np.uint8).astype(np.int64), np.r_[np.arange(m - len(again)), again]


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (row, start, end), sorted, with touching and overlapping ones joined."""
    if not len(spans):
        return spans.reshape(0, 3)
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    row = spans[:, 0]
    new_row = np.r_[True, row[1:] != row[:-1]]
    base = np.cumsum(new_row) * (spans[:, 2].max() + 1)  # rows apart, so one running maximum serves all
    reach = np.maximum.accumulate(spans[:, 2] + base) - base
    head = np.r_[True, (spans[1:, 1] > reach[:-1]) | new_row[1:]]
    first = np.flatnonzero(head)
    return np.stack([row[first], spans[first, 1], np.maximum.reduceat(spans[:, 2], first)], axis=1)


def previous_factors(windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, cut at the width of windows: bytes shared with one of a smaller document.

    windows: one row of bytes for each suffix. In suffix order (equal ones by document), the nearest row on
    either side with a smaller document shares the most; its common prefix is the least of those between.
    """
    m, width = windows.shape
    order = np.lexsort((doc, *[c for c in np.ascontiguousarray(np.pad(windows, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64).T[::-1]]))
    w, d = windows[order], doc[order]
    shared = np.zeros(m, np.int64)  # with the one before in suffix order
    if m > 1:
        differ = w[1:] != w[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    best = np.zeros(m, np.int64)
    for step in (-1, 1):
        at = np.arange(m) + step
        inside = (at >= 0) & (at < m)
        reach = np.where(inside, shared[np.clip(np.arange(m) + (step > 0), 0, m - 1)], 0)
        walk = np.flatnonzero(inside & (reach > 0))
        while len(walk):  # past neighbours that are no smaller
            smaller = d[at[walk]] < d[walk]
            best[walk[smaller]] = np.maximum(best[walk[smaller]], reach[walk[smaller]])
            walk = walk[~smaller]
            nxt = at[walk] + step
            ok = (nxt >= 0) & (nxt < m)
            walk, nxt = walk[ok], nxt[ok]
            reach[walk] = np.minimum(reach[walk], shared[nxt + (step < 0)] if step < 0 else shared[nxt])
            at[walk] = nxt
            walk = walk[reach[walk] == width]  # shorter prefixes do not matter here
    out = np.empty(m, np.int64)
    out[order] = best
    return out


def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """block, data: stretches (row, start, end) to drop, from the runs of one shard."""
    settled = pdf[pdf.done.str.len() > 0]
    out = [pd.DataFrame({"block": settled.block, "data": settled.done})]
    sent = pdf[pdf.heads.str.len() > 0]
    if len(sent):
        parts = [unpacked(h) for h in sent.heads]
        raw = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(t) for t in sent.texts), np.uint8)
        sizes = np.array([len(p[0]) for p in parts])
        key, doc, row, offset, n = (np.concatenate([p[i] for p in parts]) for i in range(5))
        again = np.concatenate([p[5] + base for p, base in zip(parts, np.cumsum(sizes) - sizes)])
        block = np.repeat(sent.block.to_numpy(), sizes)
        length = np.where(again == np.arange(len(key)), n + LEAST - 1, 0)
        start = (np.cumsum(length) - length)[again]
        spans = compared(raw, key, doc, row, offset, n, start, block)
        order = np.argsort(spans[:, 0], kind="stable")
        at = cuts(spans[order, 0])
        for i, j in zip(at[:-1], at[1:]):
            out.append(pd.DataFrame({"block": [spans[order[i], 0]], "data": [merged(spans[order[i:j], 1:]).tobytes()]}))
    return pd.concat(out, ignore_index=True)


def compared(raw, key, doc, row, offset, n, start, block) -> np.ndarray:
    """block, row, start, end of repeated stretches. Equal runs are settled by their smallest document; where an
    anchor has different runs, the suffixes of one run of each kind get their longest previous factors."""
    text = text_hashes(raw, start, n + LEAST - 1)
    order = np.lexsort((doc, text, key))
    k, t = key[order], text[order]
    head = ~same_as_before(raw, start[order], (n + LEAST - 1)[order], np.r_[False, (t[1:] == t[:-1]) & (k[1:] == k[:-1])])
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
    whole = order[doc[order] > doc[lead]]
    done = [np.stack([block[whole], row[whole], offset[whole], offset[whole] + n[whole] + LEAST - 1], axis=1)]
    kinds = order[head]
    size = np.diff(cuts(key[kinds]))
    mixed = kinds[np.repeat(size > 1, size)]
    upto, a = np.cumsum(n[mixed]), 0
    flags: dict[int, list[int]] = {}  # windows that repeat, of the runs that stand for their kinds
    while a < len(mixed):
        b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SUFFIXES, "right")), a + 1)
        while b < len(mixed) and key[mixed[b]] == key[mixed[b - 1]]:
            b += 1
        part = mixed[a:b]
        owner = np.repeat(np.arange(len(part)), n[part])
        inner = np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        windows = np.lib.stride_tricks.sliding_window_view(raw, LEAST)[start[part][owner] + inner]
        hit = np.flatnonzero(previous_factors(windows, doc[part][owner]) >= LEAST)
        for o, i in zip(owner[hit].tolist(), inner[hit].tolist()):
            flags.setdefault(int(part[o]), []).append(i)
        a = b
    if flags:
        # runs of the same kind and document repeat where the one that stands for them does
        same = order[(doc[order] == doc[lead]) & np.isin(lead, np.fromiter(flags, np.int64, len(flags)))]
        lead_of = np.empty(len(order), np.int64)
        lead_of[order] = lead
        rows = [(block[x], row[x], offset[x] + i, offset[x] + i + LEAST) for x in same.tolist() for i in flags[int(lead_of[x])]]
        done.append(np.array(rows, np.int64).reshape(-1, 4))
    return np.concatenate(done).astype(np.int64)


def cut_out(pdf: pd.DataFrame, drops: pd.DataFrame) -> pd.DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each text of the block."""
    fields = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    if not len(pdf):
        return pd.DataFrame({f: [] for f in fields})
    block = Block(pdf, drops)
    spans = merged(np.frombuffer(b"".join(d for d in drops.data if d is not None), np.int64).reshape(-1, 3))
    bounds = np.searchsorted(spans[:, 0], np.arange(len(block.texts) + 1))
    rows = []
    for i, (doc_id, t, copy) in enumerate(zip(block.ids, block.texts, block.copy)):
        own = [[0, len(t)]] if copy and len(t) >= LEAST else spans[bounds[i] : bounds[i + 1], 1:].tolist()
        kept, at = [], 0
        for s, e in own:
            kept.append(t[at:s])
            at = e
        kept.append(t[at:])
        rows.append((doc_id, len(t), sum(e - s for s, e in own), len(own), b"".join(kept)))
    return pd.DataFrame(rows, columns=fields).astype({"doc_id": "Int64"})


def whole_copies(docs: DataFrame) -> DataFrame:
    """print (id and hash of the text) of documents whose whole text is that of a document with a smaller id."""
    light = docs.select("doc_id", "print", "block", F.sha2("text", 256).alias("digest")).where("doc_id is not null and digest is not null")
    firsts = light.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.select("digest", "first"), "firsts")
    return written(light.join(firsts, "digest").where("doc_id > first").select("print", "block"), "copies")


def removed(docs: DataFrame, shards: int | None = None, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row of docs (doc_id, text)."""
    if shards is None:  # from the bytes, so that a task's share does not grow with the table
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(partitions(docs.sparkSession), -(-size // (2 * BLOCK_BYTES)))
    block = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("doc_id").isNull(), F.xxhash64("text")), F.lit(3)), F.lit(2 * shards)).cast("int").alias("block")
    doc_id = F.col("doc_id").cast("long")
    rank = F.coalesce(doc_id, F.lit(NO_ID))  # pandas has no whole numbers with nulls
    docs = docs.select(doc_id.alias("doc_id"), rank.alias("rank"), doc_id.isNull().alias("no_id"), "text", F.concat_ws(":", doc_id, F.hex(F.xxhash64("text"))).alias("print"), block)
    copies = whole_copies(docs)

    def with_copies(df):
        data, name = F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("print")
        return df.select("block", "data", name).unionByName(copies.select("block", data, "print")).groupBy("block")

    texts = docs.select("rank", "no_id", "text", "print", "block").repartition(2 * shards, "block")
    one = texts.groupBy("block").cogroup(copies.groupBy("block")).applyInPandas(lambda a, b: anchors(a, b, shards), "shard long, block int, data binary")
    two = one.groupBy("shard").applyInPandas(lambda p: shared_anchors(p, many), "block int, data binary")
    runs = texts.groupBy("block").cogroup(with_copies(two)).applyInPandas(lambda a, b: candidate_runs(a, b, shards), "shard long, block int, heads binary, texts binary, done binary")
    drops = runs.groupBy("shard").applyInPandas(repeated, "block int, data binary")
    return texts.groupBy("block").cogroup(with_copies(drops)).applyInPandas(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_substring_dedup(spark, sf_dir):
    out = removed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
