"""Byte-level BPE encoding and decoding by prefix-sharing traversal of a trie (operator 6).

Let s be a prefix of a word. The encoding of s is the encoding of a shorter prefix plus one last token, and a
token t may stand last exactly if merging would keep the border between the token before it and t. So the
last tokens of all prefixes determine the encodings. The distinct words of a run of texts go through a trie
depth first - in sorted order, keeping the path of the word before - and the last token of every prefix is
found once, however many words share it.

Texts are cut at special tokens and then, all of a slice at once, into pre-tokens as the tokenizer's pattern has
them; each that is not known is encoded once (known_words). The
tokenizer file is read on the driver and sent to the tasks (its size does not depend on the data); nothing is
trained. Null and empty texts have no ids and give an empty text back. Texts are encoded whole; a very long word
costs its length (each prefix keeps its last token alone). Repeated rows are rows of their own; columns of docs
named like the results are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import in_worker, table, with_columns
from .known_words import Known

#: White space as in Unicode, and the pattern that cuts text before merges.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PIECES = regex.compile(PATTERN)


#: Bytes before the end of a prefix by which the tokens that end there are remembered.
TAIL = 4


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in byte-level vocabulary files: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """The tokens of a vocabulary file, and encoding and decoding with them."""

    def __init__(self, definition: str, limit: int = 400_000):
        spec = json.loads(definition)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        n = max(vocab.values(), default=-1) + 1
        self.rank, self.left, self.right, self.merge = [-1] * n, [-1] * n, [-1] * n, {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[left << 32 | right] = r
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, left, right
        self.by_bytes = {}
        for i in vocab.values():
            if self.rank[i] < 0 or self._apart(self.left[i], self.right[i], self.rank[i]):
                self.by_bytes[self.bytes_of[i]] = i
        #: Every suffix of a token; those that are tokens have their id, others -1.
        self.suffixes = {t[i:]: -1 for t in self.by_bytes for i in range(len(t))} | self.by_bytes
        known = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)]
        self.token_bytes = np.frombuffer(b"".join(known), np.uint8)
        self.token_length = np.array(list(map(len, known)), np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.length_of = self.token_length.tolist()
        self.joins: dict[int, bool] = {}
        self.tails: dict[bytes, tuple[list[tuple[int, int]], bool]] = {}
        self.ids: dict[str, bytes] = {}
        self.limit = limit
        self.held = 0  # characters of what is in ids
        self.known = Known(SPACE, self.encode_bytes)

    def _apart(self, a: int, b: int, before: int) -> bool:
        """Whether merges of a rank under `before` leave the border between tokens a and b alone.

        The merges that made a and b are undone from the latest; at each state the two tokens at the border
        must not merge before the later of them was made. Equal ranks merge from the left.
        """
        rank, merge = self.rank, self.merge.get
        while True:
            found = merge(a << 32 | b)
            if found is not None and found < before:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                a = self.right[a]
                if ra < before:
                    before = ra
            elif rb < 0:
                return True
            else:
                b = self.left[b]
                if rb < before:
                    before = rb + 1

    def _follows(self, a: int, b: int) -> bool:
        known = self._apart(a, b, 1 << 60)
        if len(self.joins) > self.limit // 2:
            self.joins.clear()
        self.joins[a << 32 | b] = known
        return known

    def _ends(self, tail: bytes) -> tuple[list[tuple[int, int]], bool]:
        """(length, token) of the tokens that end a tail, longest first; whether longer ones may end a longer path."""
        tokens, start = [], len(tail) - 1
        while start >= 0 and (token := self.suffixes.get(tail[start:])) is not None:
            if token >= 0:
                tokens.append((len(tail) - start, token))
            start -= 1
        if len(self.tails) > self.limit:
            self.tails.clear()
        self.tails[tail] = found = (tokens[::-1], start < 0 and len(tail) == TAIL)
        return found

    def encode_words(self, words) -> dict[str, bytes]:
        """Ids of distinct words, four bytes each: one walk over their trie, each shared prefix once."""
        tails, suffixes, joins, ends, follows, packed, length_of = self.tails.get, self.suffixes.get, self.joins.get, self._ends, self._follows, self.packed, self.length_of
        out, path, last = {}, b"", []
        for word in sorted(words):  # the order of a depth-first walk
            raw = word.encode()
            top = min(len(path), len(raw))
            differ = int.from_bytes(path[:top]) ^ int.from_bytes(raw[:top])
            shared = top - (differ.bit_length() + 7 >> 3)
            del last[shared:]
            for end in range(shared + 1, len(raw) + 1):
                tail = raw[end - TAIL : end] if end > TAIL else raw[:end]
                tokens, more = tails(tail) or ends(tail)
                if more:
                    n = TAIL + 1
                    while n <= end and (token := suffixes(raw[end - n : end])) is not None:
                        if token >= 0:
                            tokens = [(n, token), *tokens]
                        n += 1
                for length, token in tokens:  # exactly one fits
                    if length < end:
                        before = last[end - length - 1]
                        fits = joins(before << 32 | token)
                        if not (follows(before, token) if fits is None else fits):
                            continue
                    last.append(token)
                    break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            path, end, ids = raw, len(raw), []
            while end:  # a prefix holds its last token alone; the ids of a word are read off backwards
                token = last[end - 1]
                ids.append(packed[token])
                end -= length_of[token]
            out[word] = b"".join(reversed(ids))
        return out

    def learn_pieces(self, pieces) -> None:
        """Make the ids of these pre-tokens known; earlier ones are forgotten past a limit in entries or (16 an entry) characters."""
        ids = self.ids
        if len(ids) > self.limit or self.held > 16 * self.limit:
            ids.clear()
            self.held = 0
        new = {p for p in pieces if p not in ids}
        if new:
            ids.update(self.encode_words(new))
            self.held += sum(map(len, new))

    @property
    def runs(self) -> dict[str, int]:
        """Long pre-tokens that are known."""
        return self.known.long

    def encode_bytes(self, byte: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, given by their first bytes and sizes, one after the other; how many each has."""
        words = [byte[a : a + n].tobytes().decode() for a, n in zip(at.tolist(), size.tolist())]
        ids = list(map(Bpe.encode_words(self, words).__getitem__, words))
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.cut.split(t) if self.cut and self.cut.search(t) else [t] for t in texts]
        ids = iter(self.known.of([p for ps in parts for p in ps if p not in self.special]))
        return [b"".join(self.packed[self.special[p]] if p in self.special else next(ids) for p in ps) for ps in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes([ids])[0].decode("utf-8", "replace")

    def decode_bytes(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that the ids of each text stand for."""
        n = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
        code = np.frombuffer(b"".join(ids), "<u4")
        length = self.token_length[code]
        ends = np.cumsum(length)
        place = np.repeat(self.token_start[code] - ends + length, length) + np.arange(length.sum())
        raw, upto = self.token_bytes[place].tobytes(), np.r_[0, ends][np.r_[0, np.cumsum(n)]].tolist()
        return [raw[a:b] for a, b in zip(upto, upto[1:])]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_bpe(spark, path: str | None = None, kind: type[Bpe] = Bpe):
    """A function that gives the tasks' tokenizer, made once in each worker for all frames with the same file.

    Held by the file's content: a second frame does not hold a second one beside the first. The file's size does not depend on the data.
    """
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        text = f.read()
    definition, key = spark.sparkContext.broadcast(text), f"{kind.__name__} {hashlib.sha256(text.encode()).hexdigest()}"
    return lambda: in_worker(key, lambda: kind(definition.value))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids, a binary column of little-endian unsigned 32-bit token ids."""
    bpe = shared_bpe(docs.sparkSession, path)
    return with_columns(docs, lambda texts: [bpe().encode([t or "" for t in texts])], "ids binary")


def decoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (with ids and text) with decoded, the text of the ids."""
    bpe = shared_bpe(docs.sparkSession, path)
    return with_columns(docs, lambda ids: [[b.decode("utf-8", "replace") for b in bpe().decode_bytes([i or b"" for i in ids])]], "decoded string", text="ids")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256."""
    bpe = shared_bpe(docs.sparkSession, path)

    def make(texts):
        ids = bpe().encode([t or "" for t in texts])
        back = (b.decode("utf-8", "replace").encode() for b in bpe().decode_bytes(ids))
        return [[len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(b).hexdigest() for b in back]]

    return with_columns(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", limit=1 << 19)


def op6_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
