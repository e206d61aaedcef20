"""Near-duplicate documents by an LSH forest of MinHash signatures (operator 4).

A document's set holds its distinct 5-word shingles (as 64-bit hashes). Equal sets become one node. A node's
signature has 160 minima; each of 40 trees orders the nodes by the signature rotated to begin at four minima
of the tree's own. Nodes that agree in those four lie together in a region of the order. Two nodes with
similarity 0.75 share a region in a tree with probability 0.32, so in none with probability 3e-7.

Depth adapts to the region. In a small one (at most SMALL nodes) every two nodes are candidates. In a dense
one a node's candidates are its neighbours in the order of the whole rotated signature, which share the
longest prefixes (the order is cut into ranges, so one region may lie in many tasks); where its nodes still are
in several components after that, those outside the largest one are compared with all on their full sets, in
blocks, for the first few trees and then, with what these joined, for the others. Candidates whose signatures agree too little are
dropped (two bits of each minimum; at similarity 0.75 a chance of about 1e-5 for a pair), the rest are confirmed on the full sets.

A region never gets shallower than four minima: what agrees in fewer is below the threshold but for a chance that
the 40 trees make up for. Texts are shingled whole, a very long one's minima in parts.

Texts without words, empty and null texts are linked with nothing. Rows that share an id count as one document; of
sets whose smallest id is the same, the one with the smallest digest stands for it. A row with a null id is
linked with nothing, has a null component and is kept. An empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, sliced, table, written
from .components import components

WIDTH = 5
SHARE = 75
TREES, DEPTH = 40, 4
SMALL = 8
NEAR = 3
#: Rows of a block in a dense region, at most about: nodes outside the largest component, and others.
CHUNK, REST = 512, 256
#: Trees whose dense regions are compared first.
EARLY = 4
#: Ids that are broadcast at most.
FEW = 1_000_000
AGREE = 108
WORD = re.compile(rb"[^ \t-\r]+")
_SEEDS = np.random.default_rng(20240229)
MULTIPLY = _SEEDS.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _SEEDS.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; A-Z are lower-cased, a text of under 5 words is one shingle."""
    words = [WORD.findall(t.encode().lower()) if t else [] for t in texts]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in {w for ws in words for w in ws}}
    out = []
    for ws in words:
        h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        n = min(WIDTH, len(h))
        if n:
            m, s = len(h) - n + 1, np.zeros(len(h) - n + 1, np.uint64)
            for j in range(n):
                s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
            h = np.unique(mixed(s + np.uint64(n)))
        out.append(h)
    return out


def digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):  # a long text's set in parts
        low = np.minimum(low, mixed_minima(s[at : at + 4096]))
    return low


def mixed_minima(s: np.ndarray) -> np.ndarray:
    return ((s[None, :] ^ ADD[:, None]) * MULTIPLY[:, None]).min(axis=1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id, prefixes (one key for each tree), minima (two bits of each, four in a byte)."""
    fields = ["doc_id", "n_shingles", "set_id", "prefixes", "minima"]
    tree = mixed(np.arange(1, TREES + 1, dtype=np.uint64))

    def run(batches):
        forget()
        for part in sliced(batches, 1):
            sets = shingle_sets(part.column(1).to_pylist())
            set_ids, prefixes, minima = [], [], []
            for s in sets:
                if not len(s):
                    set_ids.append(None), prefixes.append(None), minima.append(None)
                    continue
                low = signature(s)
                first = low.reshape(TREES, DEPTH)
                key = tree.copy()
                for j in range(DEPTH):
                    key = mixed(key * np.uint64(31) + first[:, j])
                set_ids.append(digest(s.tobytes()))
                prefixes.append(key.view(np.int64))
                two = ((mixed(low) >> np.uint64(32)) & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
                minima.append((two << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(set_ids, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(minima, pa.binary())], fields
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, prefixes array<long>, minima binary")


def grouped_batches(batches):
    """Runs of rows with whole keys (first column), from batches sorted by it; yields tables."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        key = held.column(0)
        if key[0].as_py() == key[-1].as_py() and held.num_rows < 1 << 20:
            continue
        keys = key.to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None:
        yield held


def followers(key: np.ndarray, node: np.ndarray, bits: np.ndarray, reach: int) -> np.ndarray:
    """Pairs a < b (two rows) of nodes of one key at most `reach` places apart whose signatures agree enough."""
    low = np.stack([(bits >> shift) & 3 for shift in (6, 4, 2, 0)], axis=2).reshape(len(key), -1)
    found = [np.zeros((2, 0), np.int64)]
    for step in range(1, reach + 1):
        i = np.flatnonzero(key[step:] == key[:-step])
        for at in range(0, len(i), 1 << 16):
            x = i[at : at + (1 << 16)]
            x = x[(low[x] == low[x + step]).sum(axis=1) >= AGREE]
            found.append(np.stack([np.minimum(node[x], node[x + step]), np.maximum(node[x], node[x + step])]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[:, pairs[0] < pairs[1]]


def columns_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(t.num_rows, -1)
    return t.column(0).to_numpy(), t.column(1).to_numpy(), bits


def paired(ordered: DataFrame) -> DataFrame:
    """Pairs a, b of rows (key, node, deep) that lie within NEAR in their task's order, and each task's first and
    last NEAR rows as a (the node), null, key and deep."""

    def run(batches):
        first, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if first is None or first.num_rows < NEAR:
                first = (t if first is None else pa.concat_tables([first, t])).slice(0, NEAR)
            t = t if held is None else pa.concat_tables([held, t])
            pairs = followers(*columns_of(t), NEAR)
            n = pairs.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], fields)
            held = t.slice(max(t.num_rows - NEAR, 0))
        if held is not None:
            ends = pa.concat_tables([first, held]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([ends.column(1), pa.nulls(ends.num_rows, pa.int64()), ends.column(0), ends.column(2)], fields)

    fields = ["a", "b", "key", "deep"]
    return ordered.select("key", "node", "deep").mapInArrow(run, "a long, b long, key long, deep binary")


def ordered(dense: DataFrame) -> DataFrame:
    """key, node, deep (the signature rotated to begin after the tree's own minima), dealt by ranges of this order."""
    turned = dense.selectExpr("key", "node", "substring(concat(minima, minima), tree + 2, length(minima)) as deep")
    return turned.repartitionByRange("key", "deep", "node").sortWithinPartitions("key", "deep", "node")


def neighbours(members: DataFrame) -> DataFrame:
    """Candidate pairs a < b of node ids, from rows of key, tree, node, n (rows of the key) and minima.

    Small regions go to tasks whole. Dense ones are cut anywhere in the order: pairs across a cut are found
    among the first and last rows of the tasks.
    """

    def run(batches):
        for t in grouped_batches(batches):
            pairs = followers(*columns_of(t), SMALL - 1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    few = members.where(F.col("n") <= SMALL).select("key", "node", "minima").repartition("key").sortWithinPartitions("key")
    dense = written(members.where(F.col("n") > SMALL).select("key", "tree", "node", "minima"), "dense-rows")  # a range exchange reads its input twice
    inside = written(paired(ordered(dense)), "inside")
    ends = inside.where("b is null").selectExpr("key", "a as node", "deep").distinct()
    across = paired(ends.repartition(1).sortWithinPartitions("key", "deep", "node"))
    found = inside.unionByName(across).where("b is not null").select("a", "b")
    return few.mapInArrow(run, "a long, b long").unionByName(found).distinct()


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < SHARE * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SHARE * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough; sets: node, shingles (binary)."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            good = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[good]), pa.array(np.array(b, np.int64)[good])], ["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, nodes: DataFrame, digests: DataFrame) -> DataFrame:
    """node, shingles of the documents whose ids are in nodes; digests: node, set_id of the set that stands for each."""

    def run(batches):
        forget()
        for part in sliced(batches, 1):
            ids, texts, wanted = (part.column(i).to_pylist() for i in range(3))
            made = [s.tobytes() for s in shingle_sets(texts)]
            good = [i for i, s in enumerate(made) if digest(s) == wanted[i]]  # rows that repeat an id may have other texts
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in good], pa.int64()), pa.array([made[i] for i in good], pa.binary())], ["node", "shingles"])

    nodes = written(nodes.join(digests, "node"), "wanted")
    if nodes.count() <= FEW:  # 24 bytes each: texts stay where they are; beyond that both sides are shuffled
        nodes = F.broadcast(nodes)
    wanted = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node").select("node", "text", "set_id")
    return wanted.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])  # equal ones only


def merging(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between nodes of different components in one block of a dense region, enough to join what is linked.

    Rows of the lower part are compared with those of the other one, or with each other where there is none.
    """
    nodes, part = pdf.node.to_numpy(), pdf.part.to_numpy()
    probes = np.flatnonzero(part == part.min())
    others = np.flatnonzero(part != part.min()) if part.min() < part.max() else probes
    sets = [np.frombuffer(s, np.uint64) for s in pdf.shingles]
    length = np.array(list(map(len, sets)))
    known, token = np.unique(np.concatenate([sets[i] for i in others]), return_inverse=True)
    starts = np.r_[0, np.cumsum(length[others])[:-1]]
    up = {c: c for c in set(pdf.component)}

    def top(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    component, out = pdf.component.to_numpy(), []
    for i in probes:
        if len(out) == len(up) - 1:
            break
        at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
        mark = np.zeros(len(known), np.int32)
        mark[at[known[at] == sets[i]]] = 1
        common = np.add.reduceat(mark[token], starts)
        near = 100 * common >= SHARE * (length[others] + length[i] - common)
        for j in others[near]:
            x, y = top(component[i]), top(component[j])
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((nodes[i], nodes[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def blocks(placed: DataFrame) -> DataFrame:
    """key, lo, hi (the block), part, node, component: what is to be compared in dense regions, from rows of key, node, n, component.

    Two nodes of different components are not both in their region's largest one, so the nodes outside it (part 0,
    in chunks lo) against all (part 1, in chunks hi) meet every such pair; a region of one component has no block.
    """
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("of"), F.max("n").alias("n"))
    main = counts.groupBy("key").agg(F.max(F.struct("of", "component")).alias("main"), F.max("n").alias("n"))
    open_ = written(main.where("main.of < n").selectExpr("key", "main.component as main", "n - main.of as outside"), "open")
    members = placed.join(open_, "key")
    chunks = lambda rows, size: F.ceil(rows / size).cast("int")
    chunk = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), n).cast("int")
    lows, highs = chunks(F.col("outside"), CHUNK), chunks(F.col("n"), REST)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    fields = ["key", "lo", "hi", "part", "node", "component"]
    probes = members.where("component <> main").withColumns({"part": F.lit(0), "lo": chunk(lows)}).withColumn("hi", every(highs))
    rest = members.withColumns({"part": F.lit(1), "hi": chunk(highs)}).withColumn("lo", every(lows))
    return probes.select(*fields).unionByName(rest.select(*fields))


def dense_links(dense: DataFrame, parts: DataFrame, docs: DataFrame, digests: DataFrame) -> DataFrame:
    """Links that join components within dense regions (rows of key, node, n); parts: node, component."""
    placed = written(dense.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "dense")
    rows = written(blocks(placed), "blocks")
    sets = written(sets_of(docs, rows.select("node").distinct(), digests), "dense-sets")
    return rows.join(sets, "node").groupBy("key", "lo", "hi").applyInPandas(merging, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    all_ = written(signatures(docs), "signatures")
    usable = all_.where("set_id is not null and doc_id is not null")
    firsts = written(usable.groupBy("set_id").agg(F.min("doc_id").alias("node")), "firsts")
    nodes = usable.join(firsts.withColumnRenamed("set_id", "_set"), (F.col("set_id") == F.col("_set")) & (F.col("doc_id") == F.col("node")))
    nodes = nodes.groupBy("node").agg(F.min(F.struct("set_id", "prefixes", "minima")).alias("of")).select("node", "of.*")
    nodes = written(nodes, "nodes")
    digests = nodes.select("node", "set_id")
    keys = nodes.select("node", F.posexplode("prefixes").alias("tree", "key"))
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    regions = written(keys.join(shared, "key"), "regions")
    pairs = written(neighbours(regions.join(nodes.select("node", "minima"), "node")), "pairs")
    sets = sets_of(docs, pairs.selectExpr("explode(array(a, b)) as node").distinct(), digests)
    links = written(confirmed(pairs, written(sets, "sets")), "links")
    parts = written(components(links), "parts")
    dense = regions.where(F.col("n") > SMALL).select("key", "tree", "node", "n")
    for trees in (F.col("tree") < EARLY, F.col("tree") >= EARLY):  # regions that the first trees' links closed are not compared again
        more = written(dense_links(dense.where(trees).drop("tree"), parts, docs, digests), "dense-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            parts = written(components(links), "parts")
    classes = firsts.join(parts, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    classes = written(classes, "classes")
    out = all_.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
