"""Fuzzy line deduplication: MinHash over character shingles, exact check, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import numtext as nt
from pagetables.llm.common import released, settle, ship
from pagetables.llm.components import bloom, in_bloom, link

SHINGLE = 8
THRESHOLD = 0.8
#: Lines of fewer characters are never removed.
MIN_CHARS = 20  # SHINGLE at least
BANDS, ROWS = 9, 3
#: Bands for the lines that share one of those: at a similarity of 0.8, 0.9999 of the pairs have one in common.
FINE_BANDS, FINE_ROWS = 30, 6

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1 << 31, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_MASKS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FINE_FACTORS = _RANDOM.integers(1 << 31, 1 << 32, FINE_BANDS * FINE_ROWS, dtype=np.uint32) | np.uint32(1)
_FINE_MASKS = _RANDOM.integers(0, 1 << 32, FINE_BANDS * FINE_ROWS, dtype=np.uint32)
#: Minima a band, factors and masks.
COARSE = (ROWS, _FACTORS, _MASKS)
FINE = (FINE_ROWS, _FINE_FACTORS, _FINE_MASKS)


def eligible(texts: nt.Texts, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, line number, start, end (trimmed of ASCII white space) and key of each line long enough."""
    data, starts = texts.data, texts.starts
    feeds = np.flatnonzero(data == 0x0A)
    start = np.union1d(starts[:-1], feeds + 1)
    start = start[start < len(data)]
    text = np.searchsorted(starts, start, "right") - 1
    end = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, start)], starts[text + 1])
    number = np.searchsorted(feeds, start) - np.searchsorted(feeds, starts[text])
    long = end - start >= min_chars
    text, number, start, end = text[long], number[long], start[long], end[long]
    for edge, step in ((start, 1), (end, -1)):
        while True:
            blank = np.flatnonzero((start < end) & ~nt.PRINTED[data[np.minimum(edge - (step < 0), len(data) - 1)]])
            if not len(blank):
                break
            edge[blank] += step
    long = end - start >= min_chars
    text, number, start, end = text[long], number[long], start[long], end[long]
    if len(start):
        heads = (data & 0xC0) != 0x80
        edges = np.column_stack([start, end]).ravel()
        chars = np.add.reduceat(heads, edges[:-1] if edges[-1] == len(data) else edges, dtype=np.int64)[::2]
        long = chars >= min_chars
        text, number, start, end = text[long], number[long], start[long], end[long]
    return text, number, start, end, nt.run_hashes(data, start, end)


def window_hashes(data: np.ndarray, heads: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hash of the `size` characters from each character on, over all of data. heads: where characters begin."""
    count = len(heads) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    begin = heads[:count]
    stop = np.empty(count, heads.dtype)
    stop[:-1], stop[-1] = heads[size:], len(data)
    plain = stop - begin == 8
    # eight bytes are a number of their own; longer windows are hashed
    numbers = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    out = nt.mix(numbers[np.minimum(begin, len(data) - 8)])
    other = np.flatnonzero(~plain)
    if len(other):
        out[other] = nt.span_hash(nt.prefix_hash(data), begin[other], stop[other])
    return out


def signature_bands(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 18,
                    family: tuple[int, np.ndarray, np.ndarray] = COARSE) -> np.ndarray:
    """Band keys for each run of bytes, of SHINGLE characters at least: some minima of its MinHash signature each."""
    rows, factors, masks = family
    bands = np.empty((len(start), len(factors) // rows), np.uint64)
    cuts = np.append(np.searchsorted(start, np.arange(0, len(data), step)), len(start))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        piece = data[start[a]:end[b - 1]]
        heads = np.flatnonzero((piece & 0xC0) != 0x80)
        edges = np.column_stack([np.searchsorted(heads, start[a:b] - start[a]), np.searchsorted(heads, end[a:b] - start[a]) - SHINGLE + 1]).ravel()
        small = (window_hashes(piece, heads) >> np.uint64(32)).astype(np.uint32)
        edges = edges[:-1] if edges[-1] >= len(small) else edges
        for band in range(bands.shape[1]):
            key = np.full(b - a, np.uint64(band + 1))
            for r in range(band * rows, (band + 1) * rows):
                least = np.minimum.reduceat((small ^ masks[r]) * factors[r], edges)[::2]
                key = nt.mix(key * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64))
            bands[a:b, band] = key
    return bands


def fine_bands(column: pa.Array) -> np.ndarray:
    """FINE_BANDS keys for each line."""
    return np.concatenate([np.empty((0, FINE_BANDS), np.uint64)] + [
        signature_bands(texts.data, texts.starts[:-1], texts.starts[1:], family=FINE) for texts in nt.chunks(column)])


def _shingles(column: pa.Array) -> np.ndarray:
    """Sorted distinct shingles of a column of at most 65,536 texts: the row in the top 16 bits, then 48 bits of the
    hash. A text of fewer than SHINGLE characters is one shingle, an empty one has none."""
    parts, base = [np.empty(0, np.uint64)], 0
    for texts in nt.chunks(column, 1 << 18):
        data, starts = texts.data, texts.starts
        n = len(starts) - 1
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(heads, starts)
        counts = np.diff(first)
        row = np.repeat(np.arange(n), counts)
        inside = np.arange(len(heads)) <= (first[1:] - SHINGLE)[row]
        at = np.flatnonzero(inside)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        hashes = np.concatenate([window_hashes(data, heads)[at] if len(at) else np.empty(0, np.uint64), nt.run_hashes(data, starts[:-1][short], starts[1:][short])])
        owner = np.concatenate([row[at], short]) + base
        parts.append(hashes >> np.uint64(16) | owner.astype(np.uint64) << np.uint64(48))
        base += n
    return _distinct(np.sort(np.concatenate(parts)))


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def _by_row(keys: np.ndarray, n: int) -> np.ndarray:
    return np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=n)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and weight (1) of the shingles that jaccard() compares."""
    keys = _shingles(column)
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), np.ones(len(keys))


def jaccard(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Similarity of the shingle sets of two columns of texts, row by row. Two empty texts are equal."""
    a, b, n = _shingles(left), _shingles(right), len(left)
    both = np.sort(np.concatenate([a, b]))
    common = _by_row(both[1:][both[1:] == both[:-1]], n)
    total = _by_row(a, n) + _by_row(b, n) - common
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of key and other whose texts have a similarity of threshold or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                good = pa.array(jaccard(part.column(1), part.column(3)) >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(2).filter(good)], names=["a", "b"])
    return pairs.select("key", "text", "other", "other_text").mapInArrow(released(run), "a long, b long")


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, line (number from 0), key and bands of each line long enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in nt.chunks(batch.column(1)):
                text, number, start, end, keys = eligible(texts, min_chars)
                if not len(keys):
                    continue
                # equal lines of one piece of work share a sketch; one row of them carries it
                _, first = np.unique(keys, return_index=True)
                first.sort()
                bands = signature_bands(texts.data, start[first], end[first])
                counts = np.zeros(len(keys), np.int64)
                counts[first] = BANDS
                ids = batch.column(0).slice(texts.rows.start).take(pa.array(text))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(number.astype(np.int32)), pa.array(keys.view(np.int64)), nt.lists(bands.ravel().view(np.int64), counts, pa.int64())],
                    names=["id", "line", "key", "bands"])
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(released(run), f"id {source.schema['id'].dataType.simpleString()}, line int, key long, bands array<long>")


def line_texts(docs: DataFrame, id_col: str, text_col: str, min_chars: int, firsts: DataFrame, keys: DataFrame) -> DataFrame:
    """key and text of the lines with these keys: each from the first place where it stands."""
    wanted = settle(firsts.join(keys, "key").select("key", F.col("first.id").alias("id"), F.col("first.line").alias("line")))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in nt.chunks(batch.column(1)):
                text, number, start, end, keys = eligible(texts, min_chars)
                hit = np.flatnonzero(in_bloom(shared.value, keys))
                raw = texts.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.rows.start).take(pa.array(text[hit])), pa.array(number[hit].astype(np.int32)), pa.array(keys[hit].view(np.int64)),
                     pa.array([raw[a:b].decode() for a, b in zip(start[hit].tolist(), end[hit].tolist(), strict=True)], pa.string())],
                    names=["id", "line", "key", "text"])
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lines = source.mapInArrow(released(run), f"id {source.schema['id'].dataType.simpleString()}, line int, key long, text string")
    same = (lines["key"] == wanted["key"]) & (lines["line"] == wanted["line"]) & lines["id"].eqNullSafe(wanted["id"])
    return lines.join(wanted, same, "left_semi").dropDuplicates(["key", "line", "id"]).select("key", "text")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  min_chars: int = MIN_CHARS) -> DataFrame:
    """id and, for each text that loses lines, removed: array of line, of_id and of_line.

    Lines (split at line feeds, trimmed of ASCII white space) of min_chars characters or more are equal or similar
    (Jaccard of their character shingles is threshold or more) or not; of each component of similar lines, the
    one with the smallest id, then line, stays. of_id and of_line say which.
    """
    min_chars = max(min_chars, SHINGLE)
    lines = settle(line_table(docs, id_col, text_col, min_chars))
    firsts = lines.groupBy("key").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"))
    firsts = settle(firsts)
    labels = link(
        lines.filter(F.size("bands") > 0).select("key", "bands"),
        lambda keys: line_texts(docs, id_col, text_col, min_chars, firsts, keys),
        lambda pairs: verified(pairs, threshold), shingle_sets, threshold, fine_bands)
    # roots of components are not in labels; they keep themselves
    roots = labels.select(F.col("root").alias("node"), "root").distinct()
    linked = labels.union(roots).select(F.col("node").alias("key"), "root")
    joined = firsts.join(linked, "key", "left")
    keepers = joined.filter("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("keeper"))
    kept = joined.join(keepers, "root", "left").select("key", F.coalesce("keeper", "first").alias("keeper"), "n", "root")
    kept = settle(kept.filter("n > 1 OR root IS NOT NULL").select("key", "keeper"))
    gone = lines.select("id", "line", "key").join(kept, "key").filter(
        (F.col("line") != F.col("keeper.line")) | ~F.col("id").eqNullSafe(F.col("keeper.id")))
    place = F.struct("line", F.col("keeper.id").alias("of_id"), F.col("keeper.line").alias("of_line"))
    return gone.groupBy("id").agg(F.array_sort(F.collect_set(place)).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                min_chars: int = MIN_CHARS) -> DataFrame:
    """row (struct of all columns, text_col without the removed lines), n_lines and removed (null if none).

    Null and empty texts and those without long lines stay as they are. Rows that share an
    id count as one text: equal lines at the same place are all kept or all removed. A
    null id is one id. A text that loses all its lines is empty. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    gone = removed_lines(docs, id_col, text_col, threshold, min_chars)
    key = gone.select(F.col("id").alias("_id"), "removed")
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = joined.join(key, F.col(f"row.`{id_col}`").eqNullSafe(F.col("_id")), "left").select("row", "removed")
    lines = F.split(F.col(f"row.`{text_col}`"), "\n", -1)
    numbers = F.transform("removed", lambda r: r["line"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)
    left = F.array_join(F.transform(stay, lambda i: lines[i]), "\n")
    text = F.when(F.col("removed").isNull(), F.col(f"row.`{text_col}`")).otherwise(left)
    whole = F.col(f"row.`{text_col}`")
    feeds = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))
    return joined.select(
        F.col("row").withField(f"`{text_col}`", text).alias("row"), F.coalesce(feeds + 1, F.lit(0)).alias("n_lines"), "removed")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                           min_chars: int = MIN_CHARS) -> DataFrame:
    """dedup_lines as a filter: the columns of docs, without rows that lost lines and have no text left."""
    found = dedup_lines(docs, id_col, text_col, threshold, min_chars)
    left = F.col("removed").isNull() | F.col(f"row.`{text_col}`").rlike(r"[^\s]")
    return found.filter(left).select("row.*")
