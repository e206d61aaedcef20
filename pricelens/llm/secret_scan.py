"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings (operator 7).

Everything is a DataFrame or SQL expression. Base spans come from three patterns. The method adds spans: runs
of LEAST or more of `[A-Za-z0-9+/_=-]` outside the base spans whose mean log-likelihood ratio under two
first-order Markov chains of characters favours a random string. One chain is trained on values that the base
patterns found, the other on ordinary identifiers: words, numbers and camel case, also joined by - _ / + or =.
Values are counted over all documents first, then their transitions; a chain has at most 128 x 128 of them
whatever the data, so the table of log ratios is a literal array in the scan. An eighth of the values, by hash,
is held out of the chains and sets the threshold: above all but one in 10,000 of the long ordinary ones, halfway
to the lowest twentieth of the secret ones where these lie higher, and at least LEAN. Spans are in code points, end exclusive.

Null and empty texts have no spans. Long texts and long runs cost little more than their length. Rows that
repeat an id are scanned each for itself; a value counts as often as it occurs. Without samples of either kind
(an empty table, say) nothing is added. Where base spans overlap, all are listed, by start and kind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .spans import let, masked, spans_of

#: The base patterns and the least length of what they match.
ASSIGN = r"""(?=[aApPsStT])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED = r"""^(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Least length of an added span, and the runs of characters that are looked at.
LEAST = 16
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
VALUE = r"[A-Za-z0-9+/_=-]{4,}"
#: What counts as an ordinary identifier.
PART = r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8})"
ORDINARY = rf"^[+/_=-]*{PART}(?:[+/_=-]+{PART})*[+/_=-]*$"
KINDS = ("assign", "access", "hex", "markov")
SPANS = "array<struct<start: int, rank: int, end: int>>"
#: One in HELD values sets the threshold, which 1 / RARE of the ordinary and SURE of the secret ones may pass or miss.
HELD, RARE, SURE = 8, 10_000, 0.05
#: Least threshold (nats a character), so that what neither chain knows is left alone.
LEAN = 0.5
#: Width of the bins of mean ratios that the threshold is taken from.
STEP = 0.02


def assigned(text: Column) -> Column:
    return F.filter(spans_of(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], ASSIGNED, 2)) >= 12)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns as array<struct<start, rank, end>>, sorted by start and kind."""

    def placed(rank: int, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))

    return F.array_sort(F.concat(placed(0, assigned(text)), placed(1, spans_of(text, ACCESS)), placed(2, spans_of(text, HEX))))


def pairs_of(value: Column) -> Column:
    """128 * first + second character for each two neighbours of an ASCII value."""
    n = F.length(value) - 1
    joined = lambda c: F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.ascii(a) * 128 + F.ascii(b))
    return let(F.split(value, ""), joined)


def labelled(docs: DataFrame) -> DataFrame:
    """label (1: secret value, 0: ordinary identifier), value and n, how often it occurs in all documents.

    Values of over 64 characters are no ordinary identifiers.
    """
    rows = docs.where(F.col("text").isNotNull()).select("text")
    secret = F.concat(
        F.transform(assigned(F.col("text")), lambda s: F.regexp_extract(s["found"], ASSIGNED, 2)),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    one = rows.select(F.explode(secret).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    tokens = rows.select(F.explode(F.regexp_extract_all("text", F.lit(VALUE), F.lit(0))).alias("value"))
    zero = tokens.where("length(value) <= 64").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("value").rlike(ORDINARY))
    return one.select(F.lit(1).alias("label"), "value", "n").unionByName(zero.select(F.lit(0).alias("label"), "value", "n"))


def fold() -> Column:
    return F.pmod(F.xxhash64("value", F.lit(5)), F.lit(HELD))


def ratios(samples: DataFrame, symbols: int = 68, weight: float = 2.0) -> list[float] | None:
    """For each pair of ASCII characters, the log of its probability as random over that as ordinary.

    samples: label, value, n. A transition backs off to how often its second character follows any, and that
    to equal chances. None if a label has no transition.
    """
    chars = samples.where("length(value) > 1").select("label", "n", F.explode(pairs_of(F.col("value"))).alias("pair"))
    sums = chars.where("pair between 0 and 16383").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    counts = {(r["label"], r["pair"]): r["n"] for r in sums.collect()}  # at most 2 x 16,384 rows
    before: dict = {}
    after: dict = {}
    total = {0: 0, 1: 0}
    for (label, pair), n in counts.items():
        before[label, pair >> 7] = before.get((label, pair >> 7), 0) + n
        after[label, pair & 127] = after.get((label, pair & 127), 0) + n
        total[label] += n
    if not total[0] or not total[1]:
        return None

    def log_p(label: int, pair: int) -> float:
        any_ = (after.get((label, pair & 127), 0) + weight / symbols) / (total[label] + weight)
        return math.log((counts.get((label, pair), 0) + weight * any_) / (before.get((label, pair >> 7), 0) + weight))

    return [log_p(1, pair) - log_p(0, pair) for pair in range(128 * 128)]


def mean_ratio(value: Column, logs: list[float]) -> Column:
    """Mean log ratio over the transitions of an ASCII value of two characters or more."""
    numbers = F.split(F.lit(",".join(f"{x:.6g}" for x in logs)), ",").cast("array<double>")  # folded into a literal
    return F.aggregate(pairs_of(value), F.lit(0.0), lambda s, pair: s + F.element_at(numbers, pair + 1)) / (F.length(value) - 1)


def threshold(samples: DataFrame, logs: list[float]) -> float | None:
    """The least mean ratio of an added span, from values (label, value, n) of LEAST characters or more (all, if a label has none)."""
    long = F.length("value") >= LEAST
    bins = samples.where("length(value) > 1").select("label", "n", long.alias("long"), F.floor(mean_ratio(F.col("value"), logs) / STEP).alias("bin"))
    rows = bins.groupBy("label", "long", "bin").agg(F.sum("n").alias("n")).collect()  # as many as ratios have bins
    edges = []
    for label, share in ((0, 1 / RARE), (1, 1 - SURE)):
        own = [r for r in rows if r["label"] == label]
        own = [r for r in own if r["long"]] or own
        if not own:
            return None
        most, seen, edge = share * sum(r["n"] for r in own), 0, None
        for r in sorted(own, key=lambda r: (-r["bin"], r["long"])):  # the least edge that at most this share lies above
            if seen + r["n"] > most:
                edge = (r["bin"] + 1) * STEP
                break
            seen += r["n"]
        edges.append(edge)
    ordinary, secret = edges
    return max(LEAN, (ordinary + max(ordinary, secret)) / 2)


def trained(docs: DataFrame) -> tuple[list[float], float] | None:
    """The log ratios and the threshold, learned from all documents (doc_id and labels play no part)."""
    samples = written(labelled(docs), "values")
    logs = ratios(samples.where(fold() > 0))
    if logs is None:
        return None
    least = threshold(samples.where(fold() == 0), logs)
    if least is None:
        least = threshold(samples, logs)
    return logs, least


def markov_spans(text: Column, base: Column, model: tuple[list[float], float]) -> Column:
    """Runs outside the base spans whose mean log ratio is at least the threshold."""
    logs, least = model
    rest = masked(text, base, lambda n, first: F.repeat(F.lit(" "), n))
    chosen = F.filter(spans_of(rest, TOKEN), lambda s: mean_ratio(s["found"], logs) >= least)
    return F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end")))


def scanned(docs: DataFrame, model: tuple[list[float], float] | None) -> DataFrame:
    """docs with base and spans: sorted arrays of struct<start, rank, end>; rank is the place in KINDS.

    Columns of docs with these two names are replaced.
    """
    none = F.expr(f"cast(array() as {SPANS})")
    base = docs.withColumn("base", F.coalesce(base_spans(F.col("text")), none))
    if model is None:
        return base.withColumn("spans", F.col("base"))
    more = F.when(F.col("text").rlike(TOKEN), markov_spans(F.col("text"), F.col("base"), model))
    return base.withColumn("spans", let(more, lambda m: F.when(F.size(m) > 0, F.array_sort(F.concat("base", m))).otherwise(F.col("base"))))


def listed(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scanned(docs, trained(docs)).drop("text")
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every found span of text replaced by the mask (overlapping spans as one); all other columns as they are."""
    model = trained(docs.select("text"))
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = masked(F.col("text"), F.col("spans"), lambda n, first: F.when(first, mask).otherwise(""))
    return scanned(rows, model).select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
