"""Places of regular-expression matches, and masks over them, in DataFrame expressions alone.

Arrays are worked on in blocks of about the square root of their size: what a step appends to is then short,
so that a text with very many matches costs little more than its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays up to this size are one block.
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks_of(items: Column) -> Column:
    """The items of a non-empty array, cut into an array of blocks."""
    width = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(items))).cast("int"))
    return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / w).cast("int")), lambda k: F.slice(items, k * w + 1, w)))


def before_each(blocks: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each block what step(value, block) made of the ones before it, from zero on."""
    made = F.aggregate(blocks, F.array(zero), lambda seen, b: F.concat(seen, F.array(step(F.element_at(seen, -1), b))))
    return F.slice(made, F.lit(1), F.size(blocks))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost matches that don't overlap, in code points.

    split() gives what lies between the matches and regexp_extract_all() the matches; their lengths add up
    to the places. The pattern must not match an empty string. A null or empty text has none.
    """
    none = F.lit(0).cast("int")
    empty = F.expr("cast(array() as array<struct<start: int, end: int, found: string>>)")

    def step(seen: Column, pair: Column) -> Column:
        start = seen["at"] + pair["gap"]
        end = start + F.length(pair["found"])
        return F.struct(end.alias("at"), F.concat(seen["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found")))).alias("spans"))

    def inside(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("spans")), step, lambda s: s["spans"])

    def placed(pairs: Column) -> Column:
        total = lambda at, b: F.aggregate(b, at, lambda s, x: s + x["gap"] + F.length(x["found"]))
        return let(blocks_of(pairs), lambda bs: F.flatten(F.zip_with(bs, before_each(bs, none, total), inside)))

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        pairs = F.zip_with(gaps, found, lambda b, f: F.struct(F.length(b).alias("gap"), f.alias("found")))
        return F.when(F.size(found) > 0, let(pairs, placed)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def masked(text: Column, spans: Column, mask: Callable[[Column, Column], Column]) -> Column:
    """text with each of its spans (structs with start and end, sorted by start) replaced by mask(length, true).

    A span that starts inside the ones before it is replaced by mask(its length beyond them, false).
    """
    none = F.lit(0).cast("int")

    def inside(block: Column, base: Column) -> Column:
        """What the text from base up to the end of the block's spans becomes."""

        def cut(part: Column) -> Column:
            def step(seen: Column, s: Column) -> Column:
                start = s["start"] - base
                between = F.substr(part, seen["at"] + 1, F.greatest(start - seen["at"], none))
                piece = F.when(start < seen["at"], mask(F.greatest(s["end"] - base - seen["at"], none), F.lit(False))).otherwise(F.concat(between, mask(s["end"] - s["start"], F.lit(True))))
                return F.struct(F.greatest(seen["at"], s["end"] - base).alias("at"), F.concat(seen["out"], piece).alias("out"))

            return F.aggregate(block, F.struct(none.alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

        return let(F.substr(text, base + 1, F.greatest(reach(base, block) - base, none)), cut)

    def reach(at: Column, block: Column) -> Column:
        return F.aggregate(block, at, lambda a, s: F.greatest(a, s["end"]))

    def whole(blocks: Column) -> Column:
        parts = F.zip_with(blocks, before_each(blocks, none, reach), inside)
        end = F.aggregate(blocks, none, reach)
        return F.concat(F.array_join(parts, ""), let(end, lambda e: F.substr(text, e + 1, F.greatest(F.length(text) - e, none))))

    return let(spans, lambda s: F.when(F.size(s) > 0, let(blocks_of(s), whole)).otherwise(text))
