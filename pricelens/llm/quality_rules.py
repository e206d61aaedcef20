"""Quality rules with adaptive thresholds (operator 10).

Each text gets counts: words, characters in words, symbols, repeated lines, words in repeated windows.
Fixed base rules reject short and repetitive texts. For the others, three rates (symbols and repeated
words per thousand words, hundredths of a character per word) go into quantile sketches for each language
and source: histograms whose bins grow with the value, at most a 64th of it wide. Sketches merge by adding
counts, so a grouped sum builds them with partial aggregation, and the sketch of all texts is the sum of the
groups' own. A text is rejected if one of its rates lies above its group's upper quartile by more than TIMES
its interquartile range; the bounds are joined back to the rows. A group of fewer than FEW texts takes the
quartiles of all texts. Where the quartiles of a group are equal, the range of all texts counts, and where these
are equal too, the rate's SLACK: the unit below which a difference means nothing.

Null and empty texts have counts of 0 and fail; null languages and sources form groups of their own. Texts are
counted whole, however long. Ties at a bound are kept. Rows that repeat an id are texts of their own. Of an
empty table nothing is kept and no bound is made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, forget, table, with_columns, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: For each rate, the spread of texts whose quartiles are all equal.
SLACK = {"symbol_rate": 25, "repeat_rate": 60, "length_rate": 10}
#: Interquartile ranges above the upper quartile, and the least number of texts of a group with quartiles of its own.
TIMES, FEW = 4, 40


def repeat_words(words: list[list[str]], width: int = WINDOW) -> np.ndarray:
    """For each list of words, how many lie in a window of `width` words found at least twice in that list."""
    ids: dict[str, int] = {}
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lengths.sum())
    if n < width:
        return np.zeros(len(words), np.int64)
    code = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64, n)
    doc = np.repeat(np.arange(len(words)), lengths)
    m = n - width + 1
    starts = np.flatnonzero(doc[:m] == doc[width - 1 :])
    with np.errstate(over="ignore"):
        h = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        key = np.zeros(m, np.uint64)
        for j in range(width):
            key = key * np.uint64(0xD6E8FEB86659FD93) + h[j : j + m]
        key ^= doc[:m].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    key = key[starts]
    order = np.argsort(key, kind="stable")
    key, at = key[order], starts[order]
    twin = np.flatnonzero(key[1:] == key[:-1]) if len(key) else np.zeros(0, np.int64)
    a, b = at[twin], at[twin + 1]
    same = doc[a] == doc[b]
    for j in range(width):  # a hash only proposes
        same &= code[a + j] == code[b + j]
    hit = np.unique(np.concatenate([a[same], b[same]]))
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    inside = np.r_[0, np.cumsum(np.cumsum(cover[:n]) > 0)]
    ends = np.cumsum(lengths)
    return inside[ends] - inside[ends - lengths]


def measure(texts: list) -> list:
    texts = [t or "" for t in texts]
    words = [WORD.findall(t) for t in texts]
    dup = []
    for t in texts:
        seen, n = set(), 0
        for line in t.split("\n"):
            if line in seen:
                n += WORD.search(line) is not None
            else:
                seen.add(line)
        dup.append(n)
    return [
        list(map(len, words)),
        [sum(map(len, w)) for w in words],
        [sum(map(t.count, SYMBOLS)) for t in texts],
        dup,
        repeat_words(words),
    ]


def features(docs: DataFrame) -> DataFrame:
    """docs with the five counts and base_failed; columns of docs with these names are replaced."""

    def make(texts):
        forget()
        return measure(texts)

    out = with_columns(docs, make, ", ".join(f"{c} long" for c in FEATURES))
    return out.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


def rates() -> dict[str, Column]:
    return {
        "symbol_rate": F.expr("1000 * n_symbols div greatest(n_words, 1)"),
        "repeat_rate": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "length_rate": F.expr("100 * word_chars div greatest(n_words, 1)"),
    }


def bin_of(v: str) -> str:
    """Bin of a non-negative integer: itself below 128, then 64 bins to each doubling."""
    shift = f"greatest(length(bin({v})) - 7, 0)"
    return f"{shift} * 64 + shiftright({v}, {shift})"


def bin_floor(b: str) -> str:
    shift = f"greatest(cast({b} div 64 as int) - 1, 0)"
    return f"shiftleft(cast({b} as bigint) - 64 * {shift}, {shift})"


def sketches(scored: DataFrame) -> DataFrame:
    """Counts by language, source, rate and bin over the rows that pass the base rules."""
    stacked = ", ".join(f"'{r}', {r}" for r in SLACK)
    rows = scored.where(~F.col("base_failed")).select("lang", "source", *[c.alias(r) for r, c in rates().items()])
    rows = rows.selectExpr("lang", "source", f"stack({len(SLACK)}, {stacked}) as (rate, v)")
    return rows.groupBy("lang", "source", "rate", F.expr(bin_of("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lower, upper (floors of the bins that hold the quartiles) and total of sketches."""
    group = Window.partitionBy(*keys)
    cum = sketch.withColumn("up_to", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("up_to") >= q * F.col("total"), F.col("bin")))
    found = cum.groupBy(*keys).agg(at(0.25).alias("b1"), at(0.75).alias("b3"), F.max("total").alias("total"))
    return found.select(*keys, F.expr(bin_floor("b1")).alias("lower"), F.expr(bin_floor("b3")).alias("upper"), "total")


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each language and source with the bound of every rate, and what set it (group, all or slack)."""
    all_ = quartiles(sketch.groupBy("rate", "bin").agg(F.sum("n").alias("n")), ["rate"])
    all_ = all_.select("rate", F.col("lower").alias("all_lower"), F.col("upper").alias("all_upper"))
    own = quartiles(sketch, ["lang", "source", "rate"]).join(all_, "rate")
    slack = F.expr("case rate " + " ".join(f"when '{r}' then {s}" for r, s in SLACK.items()) + " end")
    enough = F.col("total") >= FEW
    rise = F.when(enough, F.col("upper") - F.col("lower")).otherwise(0)
    all_rise = F.col("all_upper") - F.col("all_lower")
    spread = F.when(rise > 0, rise).when(all_rise > 0, all_rise).otherwise(slack)
    by = F.when(rise > 0, "group").when(all_rise > 0, "all").otherwise("slack")
    at = own.withColumns({"most": F.when(enough, F.col("upper")).otherwise(F.col("all_upper")) + TIMES * spread, "by": by})
    pick = lambda r, c: F.max(F.when(F.col("rate") == r, F.col(c)))
    return at.groupBy("lang", "source").agg(*[pick(r, "most").alias(f"{r}_most") for r in SLACK], *[pick(r, "by").alias(f"{r}_by") for r in SLACK])


def verdicts(scored: DataFrame, bounds: DataFrame) -> DataFrame:
    """scored with kept: false where a base rule fails or a rate passes its group's bound."""
    b = bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"{r}_most" for r in SLACK])
    out = scored.join(b, scored["lang"].eqNullSafe(b["_lang"]) & scored["source"].eqNullSafe(b["_source"]), "left")
    fine = ~F.col("base_failed")
    for r, c in rates().items():
        fine = fine & (c <= F.col(f"{r}_most"))
    return out.withColumn("kept", fine).drop(*b.columns)


def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    scored = written(features(docs).drop("text"), "quality")
    bounds = written(thresholds(sketches(scored)), "bounds")  # its size is then known, and Spark can choose to broadcast it
    return verdicts(scored, bounds).select("doc_id", *FEATURES, "base_failed", F.coalesce("kept", F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    whole = docs.select("lang", "source", "text", others)
    scored = written(features(whole), "quality-rows")  # counts are made once, and travel with the rows; a text goes to Python once
    bounds = written(thresholds(sketches(scored)), "bounds")
    return verdicts(scored, bounds).where("kept").select(*[F.col("text" if c == "text" else f"_row.`{c}`") for c in docs.columns])


OP10_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
win as (
  select r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') as g
  from (select r, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW})),
twice as (select r, i from win qualify count(*) over (partition by r, g) > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + {WINDOW})) as p from twice) group by r),
lines as (
  select r, line from (select r, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select r, sum(n - 1) as n from (select r, line, count(*) as n from lines group by r, line) group by r),
f as (
  select d.r, doc_id, lang, source, len(w)::bigint as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from d left join rep using (r) left join dup using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
             1000 * n_symbols // greatest(n_words, 1) as symbol_rate,
             1000 * n_repeat_words // greatest(n_words, 1) as repeat_rate,
             100 * word_chars // greatest(n_words, 1) as length_rate from f),
s as (
  select lang, source, rate, greatest(length(bin(v)) - 7, 0) * 64 + (v >> greatest(length(bin(v)) - 7, 0)) as bin, count(*) as n
  from (select lang, source, 'symbol_rate' as rate, symbol_rate as v from b where not base_failed
        union all select lang, source, 'repeat_rate', repeat_rate from b where not base_failed
        union all select lang, source, 'length_rate', length_rate from b where not base_failed)
  group by all),
qg as (
  select lang, source, rate, min(bin) filter (up_to >= 0.25 * total) as b1, min(bin) filter (up_to >= 0.75 * total) as b3, max(total) as total
  from (select *, sum(n) over (partition by lang, source, rate order by bin) as up_to, sum(n) over (partition by lang, source, rate) as total from s)
  group by all),
qa as (
  select rate, min(bin) filter (up_to >= 0.25 * total) as a1, min(bin) filter (up_to >= 0.75 * total) as a3
  from (select *, sum(n) over (partition by rate order by bin) as up_to, sum(n) over (partition by rate) as total
        from (select rate, bin, sum(n) as n from s group by all))
  group by all),
v as (
  select lang, source, rate, total, (b1 - 64 * greatest(b1 // 64 - 1, 0)) << greatest(b1 // 64 - 1, 0) as g1, (b3 - 64 * greatest(b3 // 64 - 1, 0)) << greatest(b3 // 64 - 1, 0) as g3,
         (a1 - 64 * greatest(a1 // 64 - 1, 0)) << greatest(a1 // 64 - 1, 0) as o1, (a3 - 64 * greatest(a3 // 64 - 1, 0)) << greatest(a3 // 64 - 1, 0) as o3
  from qg join qa using (rate)),
m as (
  select lang, source, rate, case when total >= 40 then g3 else o3 end
         + 4 * case when total >= 40 and g3 > g1 then g3 - g1 when o3 > o1 then o3 - o1 when rate = 'symbol_rate' then 25 when rate = 'repeat_rate' then 60 else 10 end as most
  from v),
t as (select lang, source, max(most) filter (rate = 'symbol_rate') as symbol_most, max(most) filter (rate = 'repeat_rate') as repeat_most,
             max(most) filter (rate = 'length_rate') as length_most
      from m group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(not base_failed and symbol_rate <= symbol_most and repeat_rate <= repeat_most and length_rate <= length_most, false) as kept
from b left join t on b.lang is not distinct from t.lang and b.source is not distinct from t.source
"""
