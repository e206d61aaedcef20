"""Mixing sources to target weights by systematic sampling (operator 9).

A document's size is its number of words. Sources, in code point order with null last, weigh 5, 2, 1, 5, ...
and share the sum of all sizes by weight; no target passes three times its source's size, and what that
leaves over is shared again. Within a source every document expects target / size copies. Documents are
put in order of size class and then of a hash; the expected copies are summed along that order, one offset
for the source (from a hash of its name, so reruns agree) is added, and a document is emitted once for each
integer that its step passes. Ordering by size keeps what is taken near the target.

The running sums come from counts by size class and hash bucket, so no task holds a source: a window runs
over at most 256 buckets of a class, over the classes of a source, and over the documents of one bucket. Sources
are numbered by a sort over ranges of their names, and the level of the targets is found by a few sums over them,
so there may be many. Null texts have size 0, null ids hash as an empty text (those of a source and size class
lie in one bucket), a null source is a source of its own, repeated rows are documents of their own; ties beyond
hash, id and size are put in the order of their texts. An empty table gives an empty mix. Words of very long
texts are counted by a running match. Columns of docs named like the results of copies() are replaced there;
mixed() keeps all columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_SQL, partitions, table, written

WEIGHTS = (5, 2, 1)
MOST = 3


def hash32(text: str) -> str:
    return f"cast(conv(substring(md5({text}), 1, 8), 16, 10) as bigint)"


#: Size classes: each doubling has 8.
CLASS = "greatest(length(bin(size)) - 4, 0) * 8 + shiftright(size, greatest(length(bin(size)) - 4, 0))"


def numbered(per: DataFrame) -> DataFrame:
    """per (one row for each source) with place, from 0 in code point order of the sources, null last."""
    order = F.col("source").asc_nulls_last()
    ranged = per.repartitionByRange(partitions(per.sparkSession), order).sortWithinPartitions(order)
    rows = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "sources")  # 2^33 numbers for each range
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    ranges = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranges.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(starts, "_part").withColumn("place", F.col("_before") + local).drop("_part", "_before", "_id")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target for a frame of source and size.

    Targets rise together in proportion to weight; a source stops at its cap. The level starts as if none did and
    rises with what the capped ones leave over, until no more are capped: each round is one sum over the sources.
    """
    per = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = written(per.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "weights")
    level, last = 0.0, None
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        row = per.agg(
            F.sum("source_size").alias("whole"), F.sum("weight").alias("weights"), F.count_if(capped).alias("n"),
            F.sum(F.when(capped, F.col("cap")).otherwise(0)).alias("capped"), F.sum(F.when(capped, F.col("weight")).otherwise(0)).alias("gone"),
        ).first()
        if row["n"] == last or not row["weights"] or row["gone"] == row["weights"]:
            break
        level, last = (row["whole"] - row["capped"]) / (row["weights"] - row["gone"]), row["n"]
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def placed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, size) with the name, size class, hash and bucket that order them."""
    name = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("."), "source"))
    d = docs.withColumns({"_at": name, "_class": F.expr(CLASS), "_hash": F.expr(hash32("coalesce(cast(doc_id as string), '')"))})
    return d.withColumn("_bucket", F.expr("shiftright(_hash, 24)"))


def starts(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """For each source, class and bucket: how many documents come before, the source's size, target and offset."""
    d = placed(docs)
    counts = written(d.groupBy("source", "_at", "_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("size")), "buckets")
    before = Window.partitionBy("_at", "_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_at").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("_at", "_class").agg(F.sum("_n").alias("_n"))
    classes = classes.select("_at", "_class", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))
    offset = F.expr(hash32(f"concat('{seed}:', coalesce(source, char(0)))")) / F.lit(4294967296.0)
    per = targets(counts, weights, most).select(F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("."), "source")).alias("_at"), "source_size", "target", offset.alias("_offset"))
    rows = counts.select("_at", "_class", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_in_class"))
    rows = rows.join(classes, ["_at", "_class"]).join(per, "_at")
    return written(rows.select("_at", "_class", "_bucket", (F.col("_earlier") + F.col("_in_class")).alias("_start"), "source_size", "target", "_offset"), "starts")


def stepped(docs: DataFrame, start: DataFrame, tie: list) -> DataFrame:
    """docs with source_size, target and copies: the integers that each document's step passes."""
    local = Window.partitionBy("_at", "_class", "_bucket").orderBy("_hash", F.col("doc_id").asc_nulls_last(), "size", *tie)
    d = placed(docs).withColumn("_local", F.row_number().over(local)).join(start, ["_at", "_class", "_bucket"])
    rank = F.col("_start") + F.col("_local")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n = F.floor(rank * each + F.col("_offset")) - F.floor((rank - 1) * each + F.col("_offset"))
    return d.withColumn("copies", n.cast("int")).drop("_at", "_class", "_bucket", "_hash", "_local", "_start", "_offset")


def copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """docs (doc_id, source, size) with source_size, target and copies, the times that the mix emits a row."""
    return stepped(docs.drop("source_size", "target", "copies"), starts(docs.select("doc_id", "source", "size"), weights, most, seed), [])


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.expr(f"cast(regexp_count(text, '{WORD_SQL.replace(chr(92), chr(92) * 2)}') as bigint)"), F.lit(0).cast("long")))


def op9_mix_sources(spark, sf_dir):
    d = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    out = copies(written(d, "sizes"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with every row repeated as often as the mix emits it, and the columns of docs."""
    start = starts(written(sized(docs.select("doc_id", "source", "text")).drop("text"), "sizes"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    out = stepped(sized(docs.select("doc_id", "source", "text", row)).drop("text"), start, [F.xxhash64("_row.text")])
    return out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")


OP9_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from documents),
c as (select *, greatest(length(bin(size)) - 4, 0) * 8 + (size >> greatest(length(bin(size)) - 4, 0)) as cls from d),
p as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, 3 * source_size as cap from p),
l as (select *, coalesce(sum(cap) over o, 0) as capped, coalesce(sum(weight) over o, 0) as gone,
             sum(source_size) over () as whole, sum(weight) over () as weights from w
      window o as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
e as (select *, (whole - capped)::double / (weights - gone)::double as level from l),
t as (select source, source_size, least(cap::double, coalesce(max(case when level * weight <= cap then level end) over () * weight, 0)) as target,
             ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 8))::bigint / 4294967296.0::double as u from e),
r as (select doc_id, size, source_size, target, u, case when source_size > 0 then target / source_size else 0 end as each,
             row_number() over (partition by c.source order by cls, h, doc_id nulls last, size) as k
      from c join t on c.source is not distinct from t.source)
select doc_id, size, source_size, target,
       ((floor(k * each + u) - floor((k - 1) * each + u)) * size)::bigint as taken from r
"""
