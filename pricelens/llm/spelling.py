"""Spelling variants of words by hashed deletions (operator 11).

Two words are one replacement apart if they are equal without the character at one position, and one insertion apart
if the longer one without a character is the shorter. So every word gives an integer key for each of its deletions,
made by NumPy from prefix and suffix sums of a polynomial in its characters (modulo 2^64), and one for itself. Keys
are dealt by their leading bits and sorted; of equal keys those remain that share the position too, or that meet a
whole word. Then strings decide: the remaining rows get their word, whose deletion as text is the group, so that equal
hashes of different strings separate. A group is never expanded into pairs: counts are its size, and the best
partner is its largest word, or the second for the largest itself.

Words are counted over all documents, within tasks before the shuffle. Every pair of near words meets in exactly one
group: equal neighbours ("aab") give the same deletion, of which insertions use the first alone. A group holds at
most one word for each letter of the alphabet and position. Chains of forms at least double n each step, and are
followed by doubling jumps.

Null and empty texts have no words. A null id counts as an empty text in the hash that picks deletions. Very long runs
are words like others (their rows carry numbers, not copies of the string); very long texts are read in pieces that
end between words. Repeated rows count again; further columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, slices, table, written

#: Letters of a run in UTF-8 after lower-casing A-Z, and a byte that ends any run.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BREAK = re.compile(rb"[\x00-\x60\x7b-\x7f]")
PIECE = 4 << 20
#: Keys that a task sorts at once, about.
SORTED = 500_000
ODD = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1
#: The polynomial's base and its inverse modulo 2^64.
BASE = 0xD1342543DE82EF95
BACK = pow(BASE, -1, 1 << 64)


def pieces(raw: bytes):
    """A text in pieces of a few million bytes, cut where no run is."""
    start = 0
    while len(raw) - start > PIECE:
        m = BREAK.search(raw, start + PIECE)
        end = m.end() if m else len(raw)
        yield raw[start:end]
        start = end
    yield raw[start:] if start else raw


def counted_runs(doc_id, raw: bytes, out: Counter, drop: int) -> None:
    """Add a document's runs to out; where drop divides the crc32 of "<id>:<run>", the run loses a character."""
    head = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for part in pieces(raw.lower()):
        for run, n in Counter(RUN.findall(part)).items():
            h = zlib.crc32(run, head)
            if h % drop == 0:
                s = run.decode()
                i = h % len(s)
                run = (s[:i] + s[i + 1 :]).encode()
            out[run] += n


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3, drop: int = 97) -> DataFrame:
    """word and n for the words of at least `shortest` characters with at least `least` occurrences."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                found: Counter = Counter()
                for i, t in zip(ids[lo:hi], texts[lo:hi]):
                    if t:
                        counted_runs(i, t, found, drop)
                kept = [(w.decode(), n) for w, n in found.items() if len(w) - w.count(b"\xc3") >= shortest]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    runs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letters() -> np.ndarray:
    """A 64-bit number for each of the 256 characters."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)


LETTERS = letters()


def mixed(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes with the length in them and their bits spread, as signed integers."""
    h = h + length.astype(np.uint64) * np.uint64(ODD)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def deletion_keys(words: list[str]):
    """For words one after the other: word (its place), pos, key of its deletion there, whether it is the first such; pos -1 is the word itself."""
    size = np.array(list(map(len, words)), np.int64)
    code = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    end = np.cumsum(size)
    begin = end - size
    word = np.repeat(np.arange(len(words)), size)
    pos = np.arange(len(code)) - begin[word]
    power = np.cumprod(np.r_[np.uint64(1), np.full(max(int(size.max(initial=0)) - 1, 0), BASE, np.uint64)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        upto = np.r_[np.uint64(0), np.cumsum(LETTERS[code] * power[pos], dtype=np.uint64)]  # prefix sums; differences of them are those of any part
        before = upto[:-1] - upto[begin][word]
        after = (upto[end][word] - upto[1:]) * np.uint64(BACK)
        keys = np.r_[mixed(before + after, size[word] - 1), mixed(upto[end] - upto[begin], size)]
    first = np.r_[True, code[1:] != code[:-1]] | (pos == 0) if len(code) else np.zeros(0, bool)
    return np.r_[word, np.arange(len(words))], np.r_[pos, np.full(len(words), -1)], keys, np.r_[first, np.zeros(len(words), bool)]


def keyed(words: DataFrame, bits: int) -> DataFrame:
    """radix (the leading bits), key, pos, id and first of every deletion of every word, and of the word (pos -1)."""

    def run(batches):
        for b in batches:
            ids, texts = np.array(b.column(0).to_pylist(), np.int64), b.column(1).to_pylist()
            for lo, hi in slices(texts, 500_000):
                word, pos, key, first = deletion_keys(texts[lo:hi])
                own = ids[lo:hi]
                for a in range(0, len(key), 1_000_000):
                    c = slice(a, a + 1_000_000)
                    radix = (key[c].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key[c]), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(radix), pa.array(key[c]), pa.array(pos[c].astype(np.int32)), pa.array(own[word[c]]), pa.array(first[c])], ["radix", "key", "pos", "id", "first"])

    return words.select("id", "word").mapInArrow(run, "radix int, key long, pos int, id long, first boolean")


def meeting(t: pa.Table) -> pa.Table:
    """Of the keys of one radix: the rows that share key and position with another, or a key with a whole word."""
    key, pos, first = t["key"].to_numpy(), t["pos"].to_numpy(), t["first"].to_numpy(zero_copy_only=False)
    order = np.lexsort((pos, key))
    k, p = key[order], pos[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new = new_key | np.r_[True, p[1:] != p[:-1]]
    group, whole = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    replaced = (np.bincount(group)[group] > 1) & (p >= 0)
    holds = np.bincount(whole, p < 0)[whole] > 0
    child = holds & first[order]
    holder = (p < 0) & (np.bincount(whole, child)[whole] > 0)
    keep = replaced | child | holder
    return t.take(pa.array(order[keep])).select(["pos", "id", "first"])


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, and the near word with the largest n (ties: the first by code points) of each written word (id, word, n) that has one."""
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(0, (max(partitions(words.sparkSession), -(-total // SORTED)) - 1).bit_length())
    met = keyed(words, bits).groupBy("radix").applyInArrow(meeting, "pos int, id long, first boolean")
    rows = met.join(words, "id").withColumn("rest", F.expr("case when pos < 0 then word else concat(substring(word, 1, pos), substring(word, pos + 2)) end"))
    rows = written(rows, "deletions")
    best = lambda w: F.struct((-w.n).alias("order"), w.word.alias("word"))

    by = Window.partitionBy("rest", "pos")
    ranked = by.orderBy(F.col("n").desc(), "word")
    every = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = rows.where("pos >= 0").select("id", F.count(F.lit(1)).over(by).alias("size"), F.row_number().over(ranked).alias("place"), F.nth_value(best(rows), 1).over(every).alias("top"), F.nth_value(best(rows), 2).over(every).alias("second"))
    replaced = other.where("size > 1").select("id", (F.col("size") - 1).alias("near"), F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top")).alias("best"))

    group = Window.partitionBy("rest")
    is_whole = F.col("pos") < 0
    met_whole = rows.where(is_whole | F.col("first")).select(
        "id", is_whole.alias("whole"), F.max(F.when(is_whole, best(rows))).over(group).alias("holder"), F.sum(F.when(~is_whole, 1).otherwise(0)).over(group).alias("children"), F.min(F.when(~is_whole, best(rows))).over(group).alias("child")
    )
    longer = met_whole.where("not whole and holder is not null").select("id", F.lit(1).cast("long").alias("near"), F.col("holder").alias("best"))
    shorter = met_whole.where("whole and children > 0").select("id", F.col("children").alias("near"), F.col("child").alias("best"))
    return replaced.unionByName(longer).unionByName(shorter).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")).select("id", "n_near", F.col("best.word").alias("near_word"), (-F.col("best.order")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """word and root of each link (word, form), following forms to the last; links have no cycles."""
    jump = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = jump.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        jump = written(jump.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if jump.where("moved").isEmpty():
            return jump.select("word", "root")
        jump = jump.select("word", "root")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, drop: int = 97, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of docs (doc_id, text)."""
    words = written(word_counts(docs, shortest, least, drop).withColumn("id", F.monotonically_increasing_id()), "words")
    out = words.join(near_words(words), "id", "left")
    takes = F.col("near_n") >= ratio * F.col("n")
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("near_word")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")), "variants")
    last = roots(out.where("form is not null")).withColumnRenamed("word", "_word")
    return out.join(last, F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")
