"""Repetition coverage: how much of a text stands inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import numtext as nt
from pagetables.llm.common import only

#: Largest share of word characters inside n-grams that occur twice or more, by n.
NGRAM_LIMITS = {3: 0.5, 5: 0.35, 8: 0.3, 13: 0.25}
#: Largest share of characters in lines equal to an earlier line.
LINE_LIMIT = 0.3
BASE_WINDOW = 8
SYMBOLS = b"#*$%&|<>"

_FIXED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repetition_stats(docs: DataFrame, ngrams: tuple[int, ...] = tuple(NGRAM_LIMITS),
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts for each text, without a shuffle: one row of the result per row of docs.

    Columns: id_col, n_words, word_chars (code points in words), n_symbols, n_dup_lines
    (lines with a word, equal to an earlier line), n_repeat_words (words inside 8-word windows
    that occur twice or more, first included), dup_line_chars, line_chars, and for each n
    gram_chars (array in the order of `ngrams`): code points of words inside n-grams that
    occur twice or more in that text. Null and empty texts have no words and zeros
    throughout; repeated rows give repeated results; other columns of docs are not read.
    """
    names = [*_FIXED, "dup_line_chars", "line_chars"]
    schema = ", ".join(["id " + dict(docs.dtypes)[id_col], *(f"{n} long" for n in names), "gram_chars array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in nt.chunks(batch.column(1)):
                out = _stats(texts, ngrams)
                grams = out.pop("grams")
                n, k = len(texts.starts) - 1, len(ngrams)
                lists = pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32), pa.array(grams.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.rows.start, n), *(pa.array(out[c], pa.int64()) for c in names), lists],
                    names=["id", *names, "gram_chars"])

    return only(docs, [id_col, text_col]).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _stats(texts: nt.Texts, ngrams: tuple[int, ...]) -> dict[str, np.ndarray]:
    data, starts = texts.data, texts.starts
    n = len(starts) - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    words = nt.spans(nt.PRINTED[data], starts)
    lengths = chars[words.end] - chars[words.start]
    hashes = nt.run_hashes(data, words.start, words.end)
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    out = {
        "n_words": words.first[1:] - words.first[:-1],
        "word_chars": nt.per_text(lengths, words.first),
        "n_symbols": nt.per_text(symbol, starts),
    }
    repeated = {k: _repeated(hashes, words.first, k) for k in {BASE_WINDOW, *ngrams}}
    out["n_repeat_words"] = nt.per_text(repeated[BASE_WINDOW], words.first)
    out["grams"] = np.array([nt.per_text(np.where(repeated[k], lengths, 0), words.first) for k in ngrams], np.int64).reshape(len(ngrams), n).T.copy()

    lines = nt.spans(data != 0x0A, starts)
    worded = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_chars = chars[lines.end] - chars[lines.start]
    text = np.repeat(np.arange(n), lines.first[1:] - lines.first[:-1])
    key = nt.run_hashes(data, lines.start, lines.end) ^ nt.mix(text.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    later &= worded
    out["n_dup_lines"] = nt.per_text(later, lines.first)
    out["dup_line_chars"] = nt.per_text(np.where(later, line_chars, 0), lines.first)
    out["line_chars"] = nt.per_text(line_chars, lines.first)
    return out


def _repeated(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """True for each word inside an n-gram that its text holds twice or more."""
    at, text = nt.windows(first, n)
    if not len(at):
        return np.zeros(len(hashes), bool)
    key = nt.window_hash(hashes, n)[at] ^ nt.mix(text.astype(np.uint64))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(hashes), bool)
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = at[twice[place] == key]
    return nt.covered(hit, hit + n, len(hashes))


def quality_rules(docs: DataFrame, limits: Mapping[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT,
                  min_words: int = 20, repeat_percent: int = 30,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repetition_stats with verdicts.

    base_failed: fewer than min_words words, or more than repeat_percent of the words inside
    repeated 8-word windows. kept: not base_failed, and no n-gram length and no repeated
    lines cover more than their share of the characters. A text without words fails.
    """
    sizes = tuple(limits)
    stats = repetition_stats(docs, sizes, id_col, text_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    over = F.col("dup_line_chars") > line_limit * F.col("line_chars")
    for i, n in enumerate(sizes):
        over = over | (F.col("gram_chars")[i] > limits[n] * F.col("word_chars"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
