"""A quality classifier: regularised quadratic discriminant over statistics of each text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.llm import numtext as nt
from pagetables.llm.common import cut, only, released

FEATURES = ("words", "upper", "symbols", "marks", "bars", "digits", "same_word", "repeated", "word_length", "line_words")
#: Shrinkage of a class covariance to the pooled one, then of that to a multiple of the identity.
TO_POOLED, TO_IDENTITY = 0.1, 0.02
CUTOFF = 0.7


class Model(NamedTuple):
    """Per class: mean, inverse Cholesky factor of the covariance, log density constant with prior."""
    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray
    fallback: float | None


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


UPPER, SYMBOLS, MARKS, BARS, DIGITS = (_bytes(x) for x in (
    bytes(range(0x41, 0x5B)), b"#*$%&<>", b"!?", b"|", bytes(range(0x30, 0x3A))))


def text_statistics(texts: nt.Texts) -> np.ndarray:
    """FEATURES of each text, one row each. Shares are smoothed, so short texts stay near the middle,
    and transformed by the arc sine of their root, sizes by the logarithm."""
    data, starts = texts.data, texts.starts
    words = nt.spans(nt.PRINTED[data], starts)
    n = (words.first[1:] - words.first[:-1]).astype(float)
    text = np.repeat(np.arange(len(starts) - 1), words.first[1:] - words.first[:-1])
    chars = nt.per_text(words.end - words.start, words.first).astype(float)
    hashes = nt.run_hashes(data, words.start, words.end)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    at, owner = nt.windows(words.first, 3)
    key = nt.window_hash(hashes, 3)[at] ^ nt.mix(owner.astype(np.uint64)) if len(at) else np.empty(0, np.uint64)
    order = np.argsort(key, kind="stable")
    later = order[1:][key[order[1:]] == key[order[:-1]]]
    repeated = np.bincount(owner[later], minlength=len(n)).astype(float)
    lines = nt.per_text(data == 0x0A, starts)

    def share(count: np.ndarray, total: np.ndarray, usual: float, weight: float) -> np.ndarray:
        return np.arcsin(np.sqrt(np.clip((count + usual * weight) / (total + weight), 0, 1)))

    def letters(table: np.ndarray, usual: float) -> np.ndarray:
        return share(nt.per_text(table[data], starts), chars, usual, 40)
    return np.column_stack([
        np.log1p(n), letters(UPPER, 0.02), letters(SYMBOLS, 0.001), letters(MARKS, 0.001), letters(BARS, 0.001), letters(DIGITS, 0.005),
        share(nt.per_text(same, words.first), n, 0.01, 10), share(repeated, n, 0.01, 10),
        np.log((chars + 50) / (n + 10)), np.log((n + 20) / (lines + 1)),
    ])


def statistics(docs: DataFrame, keep: Iterable[str], text_col: str = "text") -> DataFrame:
    def work(texts: nt.Texts) -> list[pa.Array]:
        x = text_statistics(texts)
        return [nt.lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())]
    return nt.annotate(docs, text_col, keep, "x array<double>", work)


def fit(labelled: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    """The model of a table of x (array of double) and label (0 or 1).

    Counts, sums and sums of products of each class are added up by Spark; only these few
    numbers reach the driver. All rows count. Where a class has no rows, every score is the
    share of label 1, or 0.5 without rows.
    """
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        k, at = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total.ravel())], names=["label", "at", "value"])

    rows = labelled.filter("x IS NOT NULL AND label IN (0, 1)").select("x", F.col("label").cast("int").alias("label"))
    sums = rows.mapInArrow(released(moments), "label int, at int, value double").groupBy("label", "at").agg(F.sum("value")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for label, at, value in sums:
        total[label, at] = value
    n = total[:, 0]
    if n.min() < 1:
        nothing = np.zeros(0)
        return Model(nothing, nothing, nothing, nothing, nothing, float(n[1] / n.sum()) if n.sum() else 0.5)
    everything = total.sum(0)
    center = everything[1:1 + d] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(everything[1 + d:].reshape(d, d)) / n.sum() - center ** 2, 1e-12)) + 1e-6
    means = (total[:, 1:1 + d] / n[:, None] - center) / scale
    scatter = []
    for k in (0, 1):
        raw = total[k, 1:1 + d] / n[k]
        scatter.append((total[k, 1 + d:].reshape(d, d) / n[k] - np.outer(raw, raw)) / np.outer(scale, scale))
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / n.sum()
    inverse, constant = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * scatter[k] + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor))
        constant.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Model(center, scale, means, np.array(inverse), np.array(constant), None)


def score(model: Model, x: np.ndarray) -> np.ndarray:
    """Probability of label 1: logistic of the difference of the log densities."""
    if model.fallback is not None:
        return np.full(len(x), model.fallback)
    z = (x - model.center) / model.scale
    density = [model.constant[k] - 0.5 * (((z - model.means[k]) @ model.inverse[k].T) ** 2).sum(1) for k in (0, 1)]
    return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def held_out(id_column: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One label per id: the mean of its labels, if that is 0 or 1."""
    rows = only(labels, [id_col, label_col]).toDF("_id", "label").groupBy("_id").agg(F.avg("label").alias("label"))
    return rows.filter("label IN (0, 1)")


def score_table(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """id_col, held_out, score and predicted of each row, from one pass over the texts.

    The statistics (a few numbers a text) are checkpointed, joined to the labels to learn, and
    scored. Null and empty texts have statistics too and get a score. Repeated rows get equal
    scores. Labels that are null, or differ between rows of one id, are not learnt from.
    """
    table = cut(statistics(docs, [id_col], text_col).select(F.col(f"row.`{id_col}`").alias("_id"), "x"))
    model = fit(table.filter(~held_out(F.col("_id"))).join(_labels(labels, id_col, label_col), "_id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(shared.value, x))], names=["_id", "score"])

    scored = table.mapInArrow(released(run), f"_id {table.schema['_id'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score",
        F.when(F.col("score") >= cutoff, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
              text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs with a score of cutoff or more, with all their columns. Learns as score_table."""
    table = statistics(docs, [id_col], text_col).select(F.col(f"row.`{id_col}`").alias("_id"), "x")
    model = fit(table.filter(~held_out(F.col("_id"))).join(_labels(labels, id_col, label_col), "_id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = nt.annotate(docs, text_col, docs.columns, "score double", lambda texts: [pa.array(score(shared.value, text_statistics(texts)))])
    return scored.filter(F.col("score") >= cutoff).select("row.*")
