"""Language identification by prediction by partial matching (operator 3).

Each language gets a tree of byte contexts of order 0 to `order` with the counts of the bytes that followed
them in labelled texts. A text is coded under every tree: a byte's code length comes from the longest context
seen, or from a shorter one after an escape whose probability the tree gives too (method C, with exclusion),
so the lengths are exact and the probabilities after a context sum to one. The statistics are frozen while
texts are scored. The language with the shortest code wins; the score is its posterior under equal priors.

The trees are fitted on a bounded sample of labelled rows: whole texts of about `sample` rows for each
language, picked by a hash of the id at a rate that comes from the language's number of rows. Counting is
a grouped sum; the trees, of bounded size by the bound on the sample, go to the tasks. Labels are taken to have
few values. Every text is scored as a whole.

`und` with score 0 is returned for null and empty texts, texts without a letter, and where nothing could be
learned (an empty table, or no label). Of languages with equal code lengths the first by name wins. Rows that
repeat an id are texts of their own. Columns of docs named like the results are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, in_worker, table, with_columns, written
from .ngrams import ContextTree, GramScores, chunks, grams, summed

SAMPLE = 2000
ORDER = 4


def bounded_sample(rows: DataFrame, label: str, sample: int) -> DataFrame:
    """About `sample` rows (expected) for each label, chosen by a hash of doc_id; all rows of smaller labels."""
    sizes = written(rows.groupBy(label).agg(F.count(F.lit(1)).alias("_rows")), "label-sizes")  # of known size: rows need not move
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return rows.join(sizes, label).where(place * F.col("_rows") < sample).drop("_rows")


def gram_counts(rows: DataFrame, label: str, order: int, lower: bool = False) -> DataFrame:
    """label, gram, n: counts of packed byte grams over whole texts (columns: label, text)."""

    def run(batches):
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for one in sorted(set(labels)):
                encoded = [(t.lower() if lower else t).encode() for t, l in zip(texts, labels) if l == one and t]
                for _, part in chunks(encoded):
                    keys, n = np.unique(grams(part, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["label", "gram", "n"])

    counted = rows.select(F.col(label).cast("string").alias("label"), "text").where("text is not null").mapInArrow(run, "label string, gram long, n long")
    return counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def fitted_counts(rows: DataFrame, label: str, order: int, lower: bool = False) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The counts of a bounded sample, by label, on the driver."""
    got = gram_counts(rows, label, order, lower).toArrow()
    labels = got.column("label").to_numpy()
    keys, n = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    return {str(x): summed(keys[labels == x], n[labels == x]) for x in sorted(set(labels))}


def fit(rows: DataFrame, label: str = "lang", sample: int = SAMPLE, order: int = ORDER) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts by language from rows of doc_id, text and the label; rows without label or text are not used."""
    rows = rows.select("doc_id", F.col(label).alias("_label"), "text").where("_label is not null and text is not null")
    return fitted_counts(bounded_sample(rows, "_label", sample), "_label", order)


def predict(docs: DataFrame, counts: dict, order: int = ORDER) -> DataFrame:
    """docs with lang_pred and score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    names = list(counts)
    key = uuid.uuid4().hex

    def scores():
        trees = [ContextTree(*shared.value[n], order) for n in names]
        return GramScores(lambda g: np.stack([t.bits(g) for t in trees]), len(names))

    def make(texts):
        known = [any(c.isalpha() for c in t) if t else False for t in texts]
        if not names:
            return [["und"] * len(texts), [0.0] * len(texts)]
        bits = in_worker(key, scores).per_text([(t or "").encode() for t in texts], order)
        best = bits.argmin(axis=0)
        odds = np.exp2(np.clip(bits.min(axis=0) - bits, -1000, 0)).sum(axis=0)
        return [[names[b] if k else "und" for b, k in zip(best, known)], [1 / o if k else 0.0 for o, k in zip(odds, known)]]

    return with_columns(docs, make, "lang_pred string, score double")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", id_remainder("doc_id", 4) == 2)
    counts = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), counts).select("doc_id", "held_out", "lang_pred", "score")
