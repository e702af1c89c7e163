"""Words and rolling hashes of whole batches of texts, on the bytes of an Arrow column.

All functions work on one UTF-8 byte array that holds many texts one after another, with the
place where each text begins; nothing loops over words in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import released

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def word_table(*, upper: bool, punctuation: bool) -> np.ndarray:
    """True for each byte that belongs to a word. Bytes from 0x80 on always do."""
    table = np.zeros(256, bool)
    table[0x80:] = True
    if punctuation:
        table[:] = True
        table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    else:
        table[0x30:0x3A] = True
        table[0x61:0x7B] = True
        if upper:
            table[0x41:0x5B] = True
    return table


#: Words of letters and digits, lower case expected: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = word_table(upper=False, punctuation=False)
#: Words of anything but ASCII white space: [^\x20\x09-\x0D]+
PRINTED = word_table(upper=True, punctuation=True)


class Texts(NamedTuple):
    rows: slice
    data: np.ndarray
    starts: np.ndarray  # n + 1 places in data


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1: words of text i are first[i]:first[i + 1]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of whole texts of about `size` bytes, one text at least. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Texts(slice(at, to), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)


def spans(inside: np.ndarray, starts: np.ndarray) -> Words:
    """Maximal runs of True that do not reach over the start of a text."""
    full = starts[:-1] < starts[1:]
    head = np.zeros(len(inside), bool)
    head[starts[:-1][full]] = True
    before = np.empty(len(inside), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    opens = np.flatnonzero(inside & (~before | head))
    after = np.empty(len(inside), bool)
    after[-1:] = False
    after[:-1] = inside[1:] & ~head[1:]
    return Words(opens, np.flatnonzero(inside & ~after) + 1, np.searchsorted(opens, starts))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial modulo 2^64; span_hash takes the hash of any run from them."""
    up, _ = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=total[1:])
    return total


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run start:end: equal runs have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    length = (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mix((prefix[end] - prefix[start]) * down[start] + length)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = CHUNK_BYTES) -> np.ndarray:
    """span_hash of many ordered runs of bytes, in steps that bound the memory of a very long text."""
    out = np.empty(len(start), np.uint64)
    cuts = np.append(np.searchsorted(start, np.arange(0, len(data), step)), len(start))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            low, high = start[a], end[b - 1]
            out[a:b] = span_hash(prefix_hash(data[low:high]), start[a:b] - low, end[a:b] - low)
    return out


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of n words in a row, for each place where n words begin (over text borders too)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    prefix = prefix_hash(words)
    at = np.arange(len(words) - n + 1)
    return span_hash(prefix, at, at + n)


def windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all n-word windows inside texts, and the text of each."""
    counts = np.maximum(first[1:] - first[:-1] - (n - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
    return first[:-1][text] + at, text


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """True for each of `size` places inside at least one start:end."""
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def annotate(df: DataFrame, text_col: str, keep: Iterable[str], extra: str, work: Callable[[Texts], list[pa.Array]],
             size: int = CHUNK_BYTES) -> DataFrame:
    """Column `row`, a struct of the columns `keep`, and the columns `extra` that work() makes from the texts.

    The kept columns stay apart from the new ones, whatever their names are.
    """
    keep = list(keep)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    source = df.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    names = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column(1), size):
                rows = batch.column(0).slice(texts.rows.start, texts.rows.stop - texts.rows.start)
                yield pa.RecordBatch.from_arrays([rows, *work(texts)], names=["row", *names])

    return source.mapInArrow(released(run), f"row {source.schema['row'].dataType.simpleString()}, {extra}")


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list of counts[i] values for each text."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values in first[i]:first[i + 1] for each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
