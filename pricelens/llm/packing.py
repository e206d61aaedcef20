"""Packing documents into sequences by sums of squares (operator 12).

A document is its token ids and an end id. One that is longer than a sequence is cut from its end into whole sequences;
what is left is its first piece. Pieces below a whole sequence are placed one by one: of all residual gaps that
have an open sequence, and of a new sequence, a piece takes the one after which the sum over gaps of the squared
number of open sequences is smallest (ties: the tightest gap, an open sequence before a new one).

The rule looks at counts per gap alone, so pieces are dealt at random into shards of bounded size (their number comes from
the count) and a shard keeps two small arrays. Each shard is packed in several orders - the largest nine tenths
shuffled and the rest by size, all by size - and the one with fewest sequences stays. Sequences that a shard leaves
open are opened again and their pieces meet those of other shards in a further round, until one shard holds what is
left; so what is lost to sharding is what one shard loses.

A null or empty text is its end id alone. Very long texts are encoded whole. Pieces are rows of their own, also for
repeated rows and null ids; columns of docs besides doc_id and text are not kept; an empty table gives an empty table.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import shared_bpe
from .common import slices, table, written
from .merge_rounds import RoundsBpe

#: Pieces of a shard, about.
SHARD = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, size: int = 2048, end: int = 0, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document's pieces."""
    bpe = shared_bpe(docs.sparkSession, path, RoundsBpe)
    last = end.to_bytes(4, "little")

    def run(batches):
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                out: list[tuple] = []
                for i, ids in zip(doc_ids[lo:hi], bpe().encode([t or "" for t in texts[lo:hi]])):
                    ids += last
                    n = len(ids) // 4
                    borders = [0, *range((n - 1) % size + 1, n + 1, size)]
                    out += [(i, k, a, z - a, ids[4 * a : 4 * z]) for k, (a, z) in enumerate(zip(borders, borders[1:]))]
                cols = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def placed(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Of pieces in this order: sequence (from 0) and offset of each, and the gap that each sequence keeps."""
    n = np.zeros(size + 1, np.int64)  # open sequences by gap; a full one counts as none
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    gaps: list[int] = []
    at, offset = [], []
    never = np.int64(1) << 40
    for s in lengths:
        had = n[s:size]
        cost = n[: size - s] - had  # half the change of the sum, less one; gaps 0 and `size` are not counted
        if len(cost):
            cost[0] = -had[0]
            cost = 2 * cost + 2
            cost[0] -= 1
            cost[had == 0] = never
            g = int(cost.argmin())
            least = int(cost[g])
        else:
            g, least = 0, int(never)
        if least < never and least <= 2 * int(n[size - s]) + 1:
            g += s
            k = open_[g].pop()
            n[g] -= 1
        else:
            g, k = size, len(gaps)
            gaps.append(size)
        at.append(k)
        offset.append(size - g)
        gaps[k] = rest = g - s
        if rest:
            open_[rest].append(k)
            n[rest] += 1
    return at, offset, gaps


def orders(lengths: np.ndarray, seed: int) -> list[list[int]]:
    """Orders in which a shard is packed: places of its pieces."""
    down = np.argsort(-lengths, kind="stable").tolist()
    most = len(down) * 9 // 10
    mixed = down[:most]
    random.Random(seed).shuffle(mixed)
    return [mixed + down[most:], down]


def packed_shard(t: pa.Table, size: int) -> pa.Table:
    """Sequence (the smallest row in it), offset and gap for the pieces of a shard, by the order that needs fewest sequences."""
    by_row = np.argsort(t["row"].to_numpy(), kind="stable")
    rows, lengths = t["row"].to_numpy()[by_row], t["length"].to_numpy()[by_row]
    best = None
    for order in orders(lengths, len(rows)):
        at, offset, gaps = placed(lengths[order].tolist(), size)
        if best is None or len(gaps) < len(best[3]):
            best = order, at, offset, gaps
    order, at, offset, gaps = best
    row, at = rows[order], np.array(at)
    name = np.full(len(gaps), np.iinfo(np.int64).max)
    np.minimum.at(name, at, row)
    return pa.table({"row": pa.array(row), "length": pa.array(lengths[order]), "sequence_id": pa.array(name[at]), "offset": pa.array(offset, pa.int64()), "gap": pa.array(np.array(gaps, np.int64)[at])})


def packed(parts: DataFrame, size: int = 2048, shard: int = SHARD) -> DataFrame:
    """parts (with length, 1 to size) with sequence_id and offset; parts is written once."""
    parts = written(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = parts.where(F.col("length") == size).select(F.col("_row").alias("row"), F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = parts.where(F.col("length") < size).select(F.col("_row").alias("row"), F.col("length").cast("long"))
    done, n, turn = [whole], left.count(), 0
    while n:
        shards = -(-n // shard)
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)))
        out = written(dealt.groupBy("shard").applyInArrow(lambda t: packed_shard(t, size), "row long, length long, sequence_id long, offset long, gap long"), "packed")
        again = out.where("gap > 0").count() if shards > 1 else 0
        final = out if shards == 1 or -(-again // shard) >= shards else out.where("gap = 0")
        done.append(final.select("row", "sequence_id", "offset"))
        if final is out:
            break
        left, n, turn = out.where("gap > 0").select("row", "length"), again, turn + 1
    placed_rows = done[0]
    for x in done[1:]:
        placed_rows = placed_rows.unionByName(x)
    return parts.join(placed_rows, parts["_row"] == placed_rows["row"]).drop("_row", "row")


def assembled(packed_parts: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids of each sequence; a sequence is bounded by its size."""
    each = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed_parts.groupBy("sequence_id").agg(each.alias("parts"))
    return rows.select("sequence_id", F.expr("aggregate(parts.ids, cast('' as binary), (a, b) -> concat(a, b))").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op12_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
