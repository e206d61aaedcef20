"""Edit-aware token counts (operator 5).

A document's pre-tokens lie in blocks; a segment tree over the blocks holds sums of characters and tokens.
An edit replaces a stretch of characters. Only pre-tokens from two characters before it (as far as the
pattern looks ahead) up to the first border that old and new text share after it are cut and encoded again;
their blocks change, and so do the sums above them. Everything else keeps its counts.

The text itself lies in the blocks, piece by piece; a block that outgrows twice its size is split. So an edit
costs its own length, that of the pre-tokens it touches, and a path of the tree.

Edits of a document are applied in the order of the array, each to the text that the one before left.
Bounds outside the text are moved into it; a null text counts as empty, null edits as none (and a null
text in an edit as an empty one). Special tokens in a text count as plain text here, since edits make and break
them, while op6 knows them. Rows that repeat an id are texts of their own; other columns do not matter.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, shared_bpe
from .common import slices, table
from .spans import spans_of

BLOCK = 64


class CountTree:
    """Token counts of one text under edits. count(list of pre-tokens) gives their numbers of tokens."""

    def __init__(self, text: str, count, pieces: list[str] | None = None):
        self.count, self.encoded = count, 0
        pieces = PIECES.findall(text) if pieces is None else pieces
        self.blocks, self.width, self.chars, self.tokens = [], 1, [0, 0], [0, 0]
        self._grow(0, 0, pieces, count(pieces))

    def _grow(self, first: int, last: int, pieces: list[str], tokens: list[int]) -> None:
        """Put pieces, cut into blocks, in the place of the blocks first to last (exclusive), and sum up anew; empty blocks go."""
        step = -(-len(pieces) // max(-(-len(pieces) // BLOCK), 1)) or 1
        cut = [(pieces[i : i + step], tokens[i : i + step]) for i in range(0, len(pieces), step)]
        sums = list(zip(self.chars[self.width :], self.tokens[self.width :]))
        rows = [*zip(self.blocks[:first], sums[:first]), *((b, (sum(map(len, b[0])), sum(b[1]))) for b in cut), *zip(self.blocks[last:], sums[last:])]
        rows = [r for r in rows if r[0][0]] or [(([], []), (0, 0))]
        self.blocks = [b for b, _ in rows]
        self.width = 1 << (len(rows) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (_, (n, t)) in enumerate(rows):
            self.chars[self.width + i], self.tokens[self.width + i] = n, t
        for i in range(self.width - 1, 0, -1):
            self._add_up(i)

    def _add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(p for pieces, _ in self.blocks for p in pieces)

    def _block_at(self, offset: int) -> tuple[int, int]:
        """The block that holds a character, and where that block starts."""
        i, base = 1, 0
        while i < self.width:
            left = self.chars[2 * i]
            i, base = (2 * i, base) if offset < base + left else (2 * i + 1, base + left)
        return min(i - self.width, len(self.blocks) - 1), base

    def _set(self, i: int, pieces: list[str], tokens: list[int]) -> None:
        self.blocks[i] = (pieces, tokens)
        at = self.width + i
        self.chars[at], self.tokens[at] = sum(map(len, pieces)), sum(tokens)
        while at > 1:
            at //= 2
            self._add_up(at)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put new in the place of characters start to end (exclusive)."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first, at = self._block_at(min(max(start - 2, 0), max(size - 1, 0))) if size else (0, 0)
        pieces, tokens = self.blocks[first]
        keep = 0
        while keep < len(pieces) and at + len(pieces[keep]) <= start - 2:
            at += len(pieces[keep])
            keep += 1
        block, place = first, keep  # the next old piece to read

        def read() -> str | None:
            nonlocal block, place
            while block < len(self.blocks) and place >= len(self.blocks[block][0]):
                block, place = block + 1, 0
            if block == len(self.blocks):
                return None
            place += 1
            return self.blocks[block][0][place - 1]

        old, reached = [], at
        while reached < end:
            old.append(read())
            reached += len(old[-1])
        old = "".join(old)
        buffer = old[: start - at] + new + old[end - at :]
        borders = deque([(len(buffer), block, place)])  # old borders from the end of the edit on, in the buffer
        changed, pos, made, ahead, more = start - at + len(new), 0, [], 8, True

        def extend() -> None:
            nonlocal buffer, ahead, more
            parts, n = [], len(buffer)
            for _ in range(ahead):
                piece = read()
                if piece is None:
                    more = False
                    break
                parts.append(piece)
                n += len(piece)
                borders.append((n, block, place))
            buffer += "".join(parts)
            ahead *= 2

        while True:
            while borders[0][0] < pos and (len(borders) > 1 or more):
                if len(borders) == 1:
                    extend()
                    if len(borders) == 1:
                        break
                borders.popleft()
            if pos >= changed and borders[0][0] == pos:
                break
            piece = PIECES.match(buffer, pos)
            while more and (piece is None or piece.end() + 2 > len(buffer)):  # as far as the pattern looks ahead
                extend()
                piece = PIECES.match(buffer, pos)
            if piece is None:
                break
            made.append(piece.group())
            pos = piece.end()
        _, last, place = borders[0]
        n = self.count(made)
        self.encoded += len(made)
        rest = self.blocks[last] if last < len(self.blocks) else ([], [])
        joined = (pieces[:keep] + made + rest[0][place:], tokens[:keep] + n + rest[1][place:])
        if len(joined[0]) > 2 * BLOCK:
            self._grow(first, last + 1, *joined)
            return
        self._set(first, *joined)
        for i in range(first + 1, min(last + 1, len(self.blocks))):
            self._set(i, [], [])


def counted(docs: DataFrame, edits: str = "edits", path: str | None = None) -> DataFrame:
    """doc_id, n_edits, n_pieces, tokens_before, tokens_after, n_encoded for rows of doc_id, text and edits.

    edits: array of struct<start: int, end: int, text: string>, in code points. n_encoded counts the
    pre-tokens that edits had encoded again, n_pieces those of the text before.
    """
    bpe = shared_bpe(docs.sparkSession, path)
    fields = ["doc_id", "n_edits", "n_pieces", "tokens_before", "tokens_after", "n_encoded"]

    def run(batches):
        for batch in batches:
            ids, texts, edit_lists = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices(texts, 1 << 20):
                tokenizer = bpe()
                pieces = [PIECES.findall(t or "") for t in texts[a:b]]
                tokenizer.learn_pieces({p for ps in pieces for p in ps})

                def count(some):
                    tokenizer.learn_pieces(some)
                    return [len(tokenizer.ids[p]) // 4 for p in some]

                rows = []
                for doc_id, text, ps, todo in zip(ids[a:b], texts[a:b], pieces, edit_lists[a:b]):
                    tree = CountTree(text or "", count, ps)
                    before = tree.total
                    for e in todo or []:
                        tree.replace(e["start"], e["end"], e["text"] or "")
                    rows.append((doc_id, len(todo or []), len(ps), before, tree.total, tree.encoded))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", edits).mapInArrow(run, ", ".join(f"{f} long" for f in fields))


#: What the query masks: mail addresses and numbers of four digits or more.
MASKED = r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|[0-9]{4,}"


def masking_edits(docs: DataFrame) -> DataFrame:
    """docs with edits: a paragraph break at the middle of the text, and a mask for each match, last match first."""
    found = F.transform(spans_of(F.col("text"), MASKED), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("[masked]").alias("text")))
    middle = F.expr("cast(length(text) div 2 as int)")
    middle = F.struct(middle.alias("start"), middle.alias("end"), F.lit("\n\n").alias("text"))
    return docs.withColumn("edits", F.when(F.col("text").isNotNull(), F.concat(F.reverse(found), F.array(middle))))


def op5_edit_token_counts(spark, sf_dir):
    return counted(masking_edits(table(spark, sf_dir, "documents").select("doc_id", "text")))
