"""Benchmark decontamination with suffix arrays over the training texts.

Each task builds suffix arrays over the words of its own texts, one shard after another, and
looks every suffix of the benchmark up in them by binary search. Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import numtext as nt
from pagetables.llm.common import cut

WINDOW = 10
SHARD_BYTES = 2 << 20
#: Benchmark words that one pass over the documents looks up; 8 bytes each are broadcast.
BLOCK_WORDS = 2_000_000

MATCH = "struct<item:string,length:int,doc_start:int,item_start:int>"
FOUND = f"n_words long, spans array<struct<start:int,end:int>>, matches array<{MATCH}>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_MATCH = pa.struct([("item", pa.string()), ("length", pa.int32()), ("doc_start", pa.int32()), ("item_start", pa.int32())])


class Items(NamedTuple):
    ids: list[str]
    hashes: np.ndarray
    first: np.ndarray
    places: np.ndarray  # where each looked-up suffix begins in hashes
    owner: np.ndarray
    least: np.ndarray  # words that must match, from there


class Suffixes(NamedTuple):
    hashes: np.ndarray
    end: np.ndarray  # for each word, the end of its text
    keys: np.ndarray  # codes of four words from each place
    order: np.ndarray


def words_of(texts: nt.Texts) -> tuple[np.ndarray, np.ndarray]:
    data = nt.lowered(texts.data)
    words = nt.spans(nt.ALNUM[data], texts.starts)
    return nt.run_hashes(data, words.start, words.end), words.first


def prepare(ids: list[str], texts: list[str | None], window: int = WINDOW) -> Items:
    """Suffixes of items that can match: those with `window` words, and whole shorter items."""
    parts = [words_of(t) for t in nt.chunks(pa.array(texts, pa.string()))]
    hashes = np.concatenate([h for h, _ in parts]) if parts else np.empty(0, np.uint64)
    counts = np.concatenate([np.diff(f) for _, f in parts]) if parts else np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    least = np.minimum(counts, window)
    starts = np.where(counts > 0, counts - least + 1, 0)
    owner = np.repeat(np.arange(len(ids)), starts)
    places = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    return Items(ids, hashes, first, places, owner, least[owner])


def codes(hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """16 bits of each of the four words from each place; 0 stands for the end of the text."""
    small = np.maximum(hashes >> np.uint64(48), np.uint64(1))
    keys = small << np.uint64(48)
    at = np.arange(len(small))
    for k in (1, 2, 3):
        inside = at[:max(len(small) - k, 0)] + k < end[:max(len(small) - k, 0)]
        keys[:max(len(small) - k, 0)] |= np.where(inside, small[k:], np.uint64(0)) << np.uint64(48 - 16 * k)
    return keys


def build(hashes: np.ndarray, first: np.ndarray, depth: int) -> Suffixes:
    """Suffix array over words: suffixes in the order of their first `depth` word codes.

    Sorted by four words at a time; only suffixes that are still equal are sorted again.
    """
    end = np.repeat(first[1:], np.diff(first))
    out = Suffixes(hashes, end, codes(hashes, end), np.empty(0, np.int64))
    order = np.argsort(out.keys, kind="stable")
    same = out.keys[order[1:]] == out.keys[order[:-1]]
    for level in range(1, -(-depth // 4)):
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(np.concatenate([[True], ~same]))[at]
        key = key_at(out, order[at], level)
        inner = np.lexsort((key, group))
        order[at] = order[at][inner]
        joined = (group[inner][1:] == group[inner][:-1]) & (key[inner][1:] == key[inner][:-1]) & (key[inner][1:] != 0)
        same = np.zeros(max(len(order) - 1, 0), bool)
        next_to = at[1:] == at[:-1] + 1
        same[at[1:][joined & next_to] - 1] = True
    return out._replace(order=order)


def key_at(array: Suffixes, places: np.ndarray, level: int) -> np.ndarray:
    at = places + 4 * level
    inside = at < array.end[places]
    return np.where(inside, array.keys[np.minimum(at, len(array.keys) - 1)], np.uint64(0))


def search(array: Suffixes, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each looked-up suffix, the range of the suffix array that begins with its words:
    indexes of suffixes found, and their ranges."""
    end = np.repeat(items.first[1:], np.diff(items.first))
    keys = codes(items.hashes, end)
    which = np.arange(len(items.places))
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(array.order), np.int64)
    for level in range(-(-int(items.least.max(initial=1)) // 4)):
        more = items.least[which] > 4 * level
        part = which[more]
        rest = np.minimum(items.least[part] - 4 * level, 4).astype(np.uint64)
        free = np.where(rest == 4, np.uint64(0), ~np.uint64(0) >> (rest % np.uint64(4) * np.uint64(16)))
        key = keys[items.places[part] + 4 * level] & ~free
        low[more], high[more] = (bound(array, key, low[more], high[more], level, False),
                                 bound(array, key | free, low[more], high[more], level, True))
        found = low < high
        which, low, high = which[found], low[found], high[found]
    return which, low, high


def bound(array: Suffixes, key: np.ndarray, low: np.ndarray, high: np.ndarray, level: int, after: bool) -> np.ndarray:
    """Binary search of each key in its own range: the first place not before it, or after it."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        there = key_at(array, array.order[middle], level)
        right = there <= key[open_] if after else there < key[open_]
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


def shard_matches(hashes: np.ndarray, first: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches: text, item, length, place in the text, place in the item.

    A match is one that can be made longer on neither side, of `least` words or more.
    """
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    if not len(hashes) or not len(items.places):
        return none
    array = build(hashes, first, int(items.least.max()))
    which, low, high = search(array, items)
    if not len(which):
        return none
    counts = high - low
    suffix = np.repeat(which, counts)
    at = array.order[np.arange(len(suffix)) + np.repeat(low - (np.cumsum(counts) - counts), counts)]
    place, owner = items.places[suffix], items.owner[suffix]
    text = np.searchsorted(first, at, "right") - 1
    before = (at > first[text]) & (place > items.first[owner])
    before &= hashes[at - 1] == items.hashes[place - 1]
    # a longer match that begins one word earlier covers this one, if the item is looked up from there
    keep = ~before
    at, place, owner, text, least = at[keep], place[keep], owner[keep], text[keep], items.least[suffix][keep]
    length = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    while len(open_):
        a, b = at[open_] + length[open_], place[open_] + length[open_]
        inside = (a < first[text[open_] + 1]) & (b < items.first[owner[open_] + 1])
        open_, a, b = open_[inside], a[inside], b[inside]
        open_ = open_[hashes[a] == items.hashes[b]]
        length[open_] += 1
    good = length >= least
    return text[good], owner[good], length[good], at[good] - first[text[good]], place[good] - items.first[owner[good]]


def _work(items: Items, texts: nt.Texts) -> list[pa.Array]:
    hashes, first = words_of(texts)
    n = len(first) - 1
    text, owner, length, at, place = shard_matches(hashes, first, items)
    order = np.lexsort((at, text))
    t, s, e = text[order], at[order], (at + length)[order]
    # merged spans: a new one where a match begins beyond all ends before it in its text
    flat_s, flat_e = first[t] + s, first[t] + e
    reach = np.maximum.accumulate(flat_e) if len(flat_e) else flat_e
    new = np.concatenate([[True], (flat_s[1:] > reach[:-1]) | (t[1:] != t[:-1])]) if len(t) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    tails = reach[np.append(heads[1:], len(t)) - 1] if len(heads) else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(s[heads], pa.int32()), pa.array(tails - first[t[heads]], pa.int32())], fields=list(_SPAN))
    # of each text and item, the longest match, then the first
    order = np.lexsort((at, -length, owner, text))
    t, o = text[order], owner[order]
    best = order[np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])])] if len(t) else order
    names = pa.array(items.ids, pa.string()).take(pa.array(owner[best], pa.int64()))
    matches = pa.StructArray.from_arrays([names, *(pa.array(x[best], pa.int32()) for x in (length, at, place))], fields=list(_MATCH))

    def listed(values: pa.Array, of: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)
    return [pa.array(np.diff(first), pa.int64()), listed(spans, text[np.lexsort((at, text))][heads]), listed(matches, text[best])]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Items]:
    """The benchmark in blocks of about block_words words; the driver holds one at a time."""
    ids: list[str] = []
    texts: list[str | None] = []
    size, any_ = 0, False
    for row in benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).toLocalIterator():
        ids.append("" if row[0] is None else row[0])
        texts.append(row[1])
        size += len(row[1] or "") // 2 + 1
        if size >= block_words:
            yield prepare(ids, texts, window)
            ids, texts, size, any_ = [], [], 0, True
    if ids or not any_:
        yield prepare(ids, texts, window)


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: Iterable[str] | None = None, text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """What each document shares with the benchmark, without a shuffle.

    Words: A-Z lower-cased, then runs of ASCII letters, digits and all non-ASCII characters.
    An item of `window` words or more matches by any `window` words in a row, a shorter one
    only whole. Returns row (struct of the columns `keep`, by default all), n_words, spans
    (merged runs of hit words), matches (for each item its longest match and where it stands
    in both), n_hit, n_items, items_sha256 and contaminated.

    Null and empty texts and items have no words and match nothing; equal rows give equal
    results; a null item id reads as ''. An empty benchmark hits nothing. The benchmark
    is broadcast in blocks of block_words words. More than one block means one pass over
    the documents each, and the passes are joined by a row number.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_words)
    block, following = next(blocks), next(blocks, None)
    keep = list(docs.columns if keep is None else keep)
    if following is None:
        found = _scan(docs, text_col, keep, block, shard_bytes)
    else:
        numbered = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"),
                                   F.monotonically_increasing_id().alias("n")))
        found, slim = _scan(numbered, "text", ["n", "row"], block, shard_bytes), numbered.select("text", "n")
        parts = [found.select("row.n", "row.row", "n_words", "spans", "matches")]
        while following is not None:
            part = _scan(slim, "text", ["n"], following, shard_bytes)
            parts.append(part.filter(F.size("matches") > 0).select("row.n", F.lit(None).alias("row"), F.lit(None).cast("long").alias("n_words"), "spans", "matches"))
            following = next(blocks, None)
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        found = union.groupBy("n").agg(
            F.first("row", ignorenulls=True).alias("row"), F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("matches")).alias("matches")).drop("n")
    hit = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("sum")),
        lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"),
                              (a["sum"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("sum")),
        lambda a: a["sum"])
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return found.select(
        "row", "n_words", "spans", "matches", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def _scan(docs: DataFrame, text_col: str, keep: list[str], items: Items, shard_bytes: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    return nt.annotate(docs, text_col, keep, FOUND, lambda texts: _work(shared.value, texts), shard_bytes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how: object) -> DataFrame:
    """The documents that share nothing with the benchmark, with all their columns."""
    return find_matches(docs, benchmark, **how).filter(~F.col("contaminated")).select("row.*")
