"""Toxicity from class-conditional Kneser-Ney models (operator 8).

Two interpolated Kneser-Ney models over the bytes of lower-cased text, one for each class. Contexts of up to
SHARED bytes have one table of continuation counts for both classes, to which the longer contexts of each class
back off, so that a rare expression is smoothed by what both classes know. Every byte gets the difference of its
log-likelihoods. Three length-normalised measures of a text follow: the mean over its bytes, the largest sum over
one word, and the mean over words of what a word has beyond EXCESS nats; words longer than STRETCH bytes count as
several, so that no sum grows with the length of what it is taken over. A logistic curve over these, fitted on
labelled rows that the models did not see, gives the score.

Models and curve are fitted on a bounded sample of labelled rows: whole texts of about `sample` rows of each
class. Texts are scored as a whole, however long. Null and empty texts have all measures 0. With no labelled row
of some class (an empty table, say), every score is 0. A score of one half or more predicts 1. Rows that repeat an
id are scored each for itself; an id with several labels counts as toxic if one says so. Columns of docs named
like the results are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, in_worker, table, with_columns, written
from .language_id import bounded_sample, fitted_counts
from .ngrams import GramScores, KneserNey, chunks, grams

SAMPLE = 8000
ORDER = 4
SHARED = 2
EXCESS = 6.0
STRETCH = 16


def classes(counts: dict, order: int, shared: int) -> KneserNey:
    keys = np.union1d(counts["1"][0], counts["0"][0])
    aligned = []
    for label in "10":
        n = np.zeros(len(keys), np.int64)
        n[np.searchsorted(keys, counts[label][0])] = counts[label][1]
        aligned.append(n)
    return KneserNey(keys, aligned, order, shared)


def measures(texts: list, scores: GramScores, order: int) -> np.ndarray:
    """One row for each text: mean over bytes, largest word, mean excess of words."""
    out = np.zeros((len(texts), 3))
    encoded = [(t or "").lower().encode() for t in texts]
    for start, part in chunks(encoded):
        code, lengths = grams(part, order)
        if not len(code):
            continue
        distinct, place = np.unique(code, return_inverse=True)
        value = scores(distinct)[0][place].astype(np.float64)
        last = (code & np.uint64(255)).astype(np.uint8)
        ends = np.cumsum(lengths)
        first = ends - lengths
        begins = (last == 32) | (last == 10)
        begins[first[lengths > 0]] = True
        at = np.flatnonzero(begins)
        inside = np.arange(len(code)) - np.repeat(at, np.diff(np.r_[at, len(code)]))
        at = np.flatnonzero(inside % STRETCH == 0)
        word = np.add.reduceat(value, at)
        owner = np.repeat(np.arange(len(part)), lengths)[at]
        n_words = np.maximum(np.bincount(owner, minlength=len(part)), 1)
        rows = out[start : start + len(part)]
        rows[:, 0] = np.bincount(owner, word, len(part)) / np.maximum(lengths, 1)
        top = np.full(len(part), -np.inf)
        np.maximum.at(top, owner, word)
        rows[:, 1] = np.where(lengths > 0, top, 0)
        rows[:, 2] = np.bincount(owner, np.maximum(word - EXCESS, 0), len(part)) / n_words
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights of a ridge logistic regression by Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def fit(labelled: DataFrame, sample: int = SAMPLE, order: int = ORDER, shared: int = SHARED) -> tuple | None:
    """Model from rows of doc_id, text, toxic (0/1). A fifth of the sample, by hash, is kept for the curve."""
    rows = labelled.select("doc_id", "text", "toxic").where("toxic in (0, 1) and text is not null")
    rows = bounded_sample(rows, "toxic", sample).withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)))
    counts = fitted_counts(rows.where("_fold > 0"), "toxic", order, lower=True)
    if set(counts) != {"0", "1"}:
        return None
    shared_counts = labelled.sparkSession.sparkContext.broadcast(counts)
    key = uuid.uuid4().hex

    def scores():
        both = classes(shared_counts.value, order, shared)
        return GramScores(lambda g: (lambda p: p[:1] - p[1:])(both.nats(g)), 1)

    def model():
        return in_worker(key, scores)

    def seen(batches):
        for batch in batches:
            m = measures(batch.column(1).to_pylist(), model(), order)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), *[pa.array(c) for c in m.T]], ["y", "a", "b", "c"])

    fold = rows.where("_fold = 0").select("toxic", "text").mapInArrow(seen, "y double, a double, b double, c double").toPandas()
    if fold.y.nunique() < 2:
        fold = rows.select("toxic", "text").mapInArrow(seen, "y double, a double, b double, c double").toPandas()
    fold = fold.sort_values(list(fold.columns))
    return model, order, logistic(fold[["a", "b", "c"]].to_numpy(), fold.y.to_numpy())


def score(docs: DataFrame, fitted: tuple | None) -> DataFrame:
    """docs with score and predicted, from the text alone."""
    if fitted is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    model, order, (centre, scale, w) = fitted

    def make(texts):
        z = (measures(texts, model(), order) - centre) / scale
        s = 1 / (1 + np.exp(-np.clip(w[0] + z @ w[1:], -30, 30)))
        return [s, (s >= 0.5).astype(np.int32)]

    return with_columns(docs, make, "score double, predicted int")


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_remainder("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.where(id_remainder("doc_id", 5) != 0)
    picked = written(bounded_sample(labels.where("toxic in (0, 1)"), "toxic", SAMPLE), "picked")  # labels first, then their texts
    fitted = fit(written(docs.select("doc_id", "text").join(picked, "doc_id"), "labelled"))
    return score(docs, fitted).select("doc_id", "held_out", "score", "predicted")
