"""Spelling variants: words one edit apart, found through an index of variable-length grams.

The method is that of variable-length grams (Li, Wang and Yang 2007), with these parts:

- The dictionary holds all grams of two characters, and of the longer ones those whose beginning, one
  character shorter, is frequent: stands in more than `prune` places of the vocabulary.
- A word's grams are, from each of its places, the longest gram of the dictionary. Whether a gram grows is
  decided by its own characters alone, so one edit touches only the grams that hold the edited character.
- A word's bound is the largest number of its grams that one edit can touch (`affected`). A word one edit away has all
  other grams of the word, at the same distance from the beginning or from the end. So at least one of the
  affected + 1 rarest grams is in common, and only the lists of those are merged.

Words have characters up to U+00FF, so a gram of up to eight of them is a 64-bit number, not a hash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import numtext as nt
from pagetables.llm.common import settle, ship

#: Words have as many characters and occurrences at least.
MIN_CHARS, MIN_COUNT = 6, 5
#: One occurrence in so many, chosen by a checksum, loses a character.
ERROR_RATE = 199
#: A word is a form of another one if that is so many times as frequent.
FORM_FACTOR = 5
#: Longest gram; a pair whose shorter word has l characters is searched with grams of up to l - 2.
MAX_GRAM = 8
#: Places in the vocabulary up to which a gram is not made longer.
PRUNE = 24
#: Most frequent grams that are broadcast, 16 bytes each. `prune` rises where it must to keep to that.
MAX_FREQUENT = 4_000_000
#: Words that a task counts before it passes them on.
COUNTED = 200_000
#: Runs of more bytes than this are checksummed one by one.
_SHORT = 64


def _crc_table() -> np.ndarray:
    """The table of the reflected CRC-32 of zlib, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes, carried on from the checksum seeds[i] of what stands before it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    crc, place, size = ~seeds[order].astype(np.uint32), start[order], size[order]
    long = int(np.searchsorted(-size, -_SHORT))
    for j in range(int(size[long]) if long < len(size) else 0):
        active = slice(long, int(np.searchsorted(-size, -j)))
        c = crc[active]
        crc[active] = _CRC[(c ^ data[place[active] + j]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~crc
    for k in order[:long]:
        out[k] = zlib.crc32(data[start[k]:end[k]].tobytes(), int(seeds[k]))
    return out


class Latin(NamedTuple):
    """Runs of letters: one byte a character."""
    chars: np.ndarray
    first: np.ndarray
    last: np.ndarray  # one behind the run


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to [A-Za-zÀ-ÿ], and which of those end a character."""
    low = data | 0x20
    ascii_ = (low >= 0x61) & (low <= 0x7A) & (data < 0x80)
    lead = data == 0xC3  # U+00C0 to U+00FF are C3 80 to C3 BF
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1]
    return ascii_ | lead | second, ascii_ | second


def _latin(data: np.ndarray, start: np.ndarray, end: np.ndarray, ends: np.ndarray) -> Latin:
    """The runs start:end of the lower-cased UTF-8 in data as characters of one byte."""
    before = np.concatenate([[0], np.cumsum(ends)])
    chars = np.where(data < 0x80, data, data | 0x40)[ends]
    return Latin(chars, before[start], before[end])


def _gathered(words: Latin, which: np.ndarray) -> list[str]:
    size = words.last[which] - words.first[which] + 1
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(words.first[which] - (ends - size), size)
    text = words.chars[np.minimum(at, len(words.chars) - 1)] if len(words.chars) else np.empty(0, np.uint8)
    text[ends - 1] = 0x0A
    return text.tobytes().decode("latin-1").split("\n")[:-1]


def _occurrences(texts: nt.Texts, seeds: np.ndarray, error_rate: int, min_chars: int) -> tuple[list[str], np.ndarray]:
    """Distinct words of a piece of texts, errors made, and how often each stands there."""
    data = nt.lowered(texts.data)
    inside, ends = _letters(data)
    runs = nt.spans(inside, texts.starts)
    text = np.repeat(np.arange(len(texts.starts) - 1), np.diff(runs.first))
    words = _latin(data, runs.start, runs.end, ends)
    crc = checksums(data, runs.start, runs.end, seeds[text]).astype(np.int64)
    size = words.last - words.first
    hit = np.flatnonzero(crc % error_rate == 0)
    stay = np.ones(len(words.chars), bool)
    stay[words.first[hit] + crc[hit] % size[hit]] = False
    shift = np.concatenate([[0], np.cumsum(stay)])
    words = Latin(words.chars[stay], shift[words.first], shift[words.last])
    long = words.last - words.first >= min_chars
    words = Latin(words.chars, words.first[long], words.last[long])
    _, which, counts = np.unique(nt.run_hashes(words.chars, words.first, words.last), return_index=True, return_counts=True)
    return _gathered(words, which), counts


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: int = ERROR_RATE,
               min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: distinct words of min_chars characters and min_count occurrences or more.

    A word is a run of A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased. Where error_rate divides the
    CRC-32 of `id:word`, the character at CRC-32 modulo its length is left out. Words are
    counted in each task before they are shuffled. Null and empty texts have none, a null id counts as an empty one.
    """
    source = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for texts in nt.chunks(batch.column(1)):
                seeds = np.array([zlib.crc32(f"{x}:".encode()) for x in ids[texts.rows]], np.uint32)
                words, counts = _occurrences(texts, seeds, error_rate, min_chars)
                for word, count in zip(words, counts.tolist(), strict=True):
                    total[word] += count
                if len(total) > COUNTED:
                    yield passed()
        yield passed()
    counted = source.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _words(column: pa.Array) -> Iterator[tuple[slice, Latin]]:
    """A column of words, piece by piece."""
    for texts in nt.chunks(column, 1 << 18):
        _, ends = _letters(texts.data)
        yield texts.rows, _latin(texts.data, texts.starts[:-1], texts.starts[1:], ends)


def _codes(chars: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Length and number of the gram from each place on, from two characters to `longest`."""
    code = chars.astype(np.uint64)
    for q in range(2, longest + 1):
        code = (code[:-1] << np.uint64(8)) | chars[q - 1:].astype(np.uint64) if len(code) else code
        yield q, code


class Grams(NamedTuple):
    """Frequent grams in the order of their numbers, and how many places each has."""
    codes: np.ndarray
    counts: np.ndarray


def frequent_grams(words: DataFrame, prune: int = PRUNE, most: int = MAX_FREQUENT, longest: int = MAX_GRAM) -> Grams:
    """Grams of two to longest - 1 characters that stand in more than `prune` places of the words.

    There are at most (longest - 2) * characters / prune of them; prune is raised to keep that within `most`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _words(batch.column(0)):
                ends = np.repeat(found.last, found.last - found.first)
                for q, code in _codes(found.chars, longest - 1):
                    inside = np.arange(len(code)) + q <= ends[:len(code)]
                    grams, counts = np.unique(code[inside], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts)], names=["gram", "n"])
    chars = words.agg(F.coalesce(F.sum(F.char_length("word")), F.lit(0))).first()[0]
    prune = max(prune, -(-(longest - 2) * chars // most))
    counted = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") > prune).toArrow()
    codes, counts = found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(codes)
    return Grams(codes[order], counts[order])


class Decomposed(NamedTuple):
    word: np.ndarray  # the word of each gram
    place: np.ndarray  # characters before the gram
    code: np.ndarray
    rank: np.ndarray  # 0 for the rarest gram of its word
    affected: np.ndarray  # of each word: grams that one edit can touch


def decompose(words: Latin, frequent: Grams, longest: int) -> Decomposed:
    """The longest gram of the dictionary from each place of each word but its last one."""
    size = words.last - words.first
    word = np.repeat(np.arange(len(size)), np.maximum(size - 1, 0))
    begin = np.cumsum(np.maximum(size - 1, 0)) - np.maximum(size - 1, 0)
    place = np.arange(len(word)) - begin[word]
    at = words.first[word] + place
    code, length, count = np.zeros(len(word), np.uint64), np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    growing = np.arange(len(word))
    for q, codes in _codes(words.chars, longest):
        growing = growing[at[growing] + q <= words.last[word[growing]]]
        code[growing], length[growing] = codes[at[growing]], q
        known = np.minimum(np.searchsorted(frequent.codes, code[growing]), max(len(frequent.codes) - 1, 0))
        often = frequent.codes[known] == code[growing] if len(frequent.codes) else np.zeros(len(growing), bool)
        count[growing] = np.where(often, frequent.counts[known], 0) if len(frequent.codes) else 0
        growing = growing[often]
    depth = np.zeros(len(words.chars) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + length, -1)
    depth = np.cumsum(depth)
    affected = np.zeros(len(size), np.int64)
    full = np.flatnonzero(size > 0)
    if len(full):
        affected[full] = np.maximum.reduceat(depth[:-1], words.first[full])
    order = np.lexsort((place, nt.mix(code), count, word))
    rank = np.empty(len(word), np.int64)
    rank[order] = np.arange(len(word)) - begin[word[order]]
    return Decomposed(word, place, code, rank, affected)


def postings(words: DataFrame, frequent: object, min_chars: int = MIN_CHARS, longest: int = MAX_GRAM) -> DataFrame:
    """key, word, n, size, behind: the lists that each word is looked up in.

    A pair is searched by the length of its shorter word; so a word is decomposed for its own length and for
    one less, where these have other longest grams. A key is a gram with its distance from the beginning or from the end
    (then `behind`); for words of one length the two say the same.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in _words(batch.column(0)):
                size = found.last - found.first
                for most in range(min(min_chars - 2, longest), longest + 1):
                    own, less = (np.minimum(s - 2, longest) == most for s in (size, size - 1))
                    mine = np.flatnonzero(own | less & (size > min_chars))
                    if not len(mine):
                        continue
                    grams = decompose(Latin(found.chars, found.first[mine], found.last[mine]), frequent.value, most)
                    used = np.flatnonzero(grams.rank <= grams.affected[grams.word])
                    word, place, code = grams.word[used], grams.place[used], grams.code[used]
                    behind = size[mine][word] - place
                    keys = [nt.mix(nt.mix(code) + (offset.astype(np.uint64) << np.uint64(8) | np.uint64(side << 7 | most)))
                            for side, offset in ((0, place), (1, behind))]
                    mine = np.tile(mine[word], 2)
                    row = pa.array(mine + rows.start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(row), batch.column(1).take(row),
                         pa.array(size[mine].astype(np.int32)), pa.array(np.arange(len(mine)) >= len(word))], names=["key", "word", "n", "size", "behind"])
    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, size int, behind boolean")


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, prune: int = PRUNE) -> DataFrame:
    """word, n, other, other_n of all pairs of words (word before other) that one insertion, deletion or replacement
    of a character takes to each other.

    A list holds the words with one gram at one place. A gram is short only where it is rare, and a gram of all but
    two or three of a word's characters leaves few words; so lists stay short, and only verified pairs leave the join.
    Both sides are spread by key, and once: Spark judges lists by the size of the words, some fortieth of their own, and would
    broadcast them. Both sides read the same columns, so that they share the Exchange.
    """
    if min_chars < 4:
        raise ValueError("a word of fewer than four characters may have no gram that an edit leaves")
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words, prune))
    lists = postings(words, frequent, min_chars)
    a, b = lists.alias("a").hint("merge"), lists.alias("b")
    apart = F.abs(F.col("a.size") - F.col("b.size"))
    like = ((apart == 1) | (apart == 0) & ~F.col("a.behind") & ~F.col("b.behind")) & (F.col("a.word") < F.col("b.word"))
    near = a.join(b, F.col("a.key") == F.col("b.key")).filter(like & (F.levenshtein("a.word", "b.word", 1) == 1))
    return near.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form: pointers are doubled until each ends at a word without one.

    A form has several times the occurrences of its word, so a chain has no circle and at most log(n) steps.
    Tables of words take some eight times their files' room in memory, so joins of them are not left to be broadcast.
    """
    links = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        doubled = settle(links.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        links = doubled.select("word", "root")
        if doubled.filter("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: int = ERROR_RATE,
                      min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of vocabulary().

    n_near: words one edit away. form: the most frequent of them (ties: the smallest in code-point order), if it
    has at least factor times the occurrences; else null. root: from the word, forms followed to the
    last one; the word itself if it has none. Repeated rows count as often as they come. Other columns of
    docs are not read. An empty table, or one without words, gives no rows. A very long run is one word.
    """
    if factor < 2:
        raise ValueError("with a factor below 2 forms may go round in a circle")
    ship(docs.sparkSession)
    words = settle(vocabulary(docs, id_col, text_col, error_rate, min_chars, min_count))
    pairs = settle(near_words(words, min_chars))
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("n"), F.min(F.struct(-F.col("other_n"), F.col("other"))).alias("best"))
    is_form = -F.col("best.col1") >= factor * F.col("n")
    found = settle(best.select(
        "word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.col1")).alias("form_n")))
    roots = _roots(found.filter("form IS NOT NULL"))
    return words.join(found.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
