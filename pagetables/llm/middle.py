"""Fill-in-middle: a text is cut at two line ranks found in an indexable skip list, and its middle goes last.

The lines of all texts of a piece of work stand in one skip list of numpy lanes. Lane 0 has a tower
for the head of each text and for each line; an express lane keeps the heads and about one in four towers
of the lane below. Each tower carries how many lines, and how many code points, lie between it and the next tower of its lane.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.llm import numtext as nt
from pagetables.llm.common import ship

SEED = 7
#: Percent of the texts that are cut, and of those the percent that begin with their suffix.
CUT_PERCENT, SPM_PERCENT = 100, 50
#: What stands before prefix, suffix and middle. A text that holds one of them is not cut.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_FANOUT_BITS = 2


class Lane(NamedTuple):
    units: np.ndarray  # lines from this tower to the next one of the lane
    chars: np.ndarray  # code points on that way
    next: np.ndarray  # place of the next tower, or that of the tower itself at the end of a text
    down: np.ndarray  # place of the same tower in the lane below


class SkipList:
    """The lines of n texts; lane places 0 to n - 1 of the top lane are the heads of the texts."""

    def __init__(self, first: np.ndarray, lengths: np.ndarray):
        """first: n + 1 numbers of the first line of each text; lengths: code points of each line."""
        n = len(first) - 1
        # a tower at rank r stands after r lines; the head of a text is its tower of rank 0
        text = np.repeat(np.arange(n), np.diff(first) + 1)
        heads = first[:-1] + np.arange(n)
        rank = np.arange(len(text)) - heads[text]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = total[first[text] + rank]
        coins = nt.mix(np.arange(len(text), dtype=np.uint64) + np.uint64(1))
        self.lanes = []
        towers, below = np.arange(len(text)), np.arange(len(text))
        height = 0
        while True:
            last = np.append(text[towers[1:]] != text[towers[:-1]], True)[:len(towers)]
            to = np.where(last, np.arange(len(towers)), np.arange(1, len(towers) + 1))
            self.lanes.append(Lane(rank[towers[to]] - rank[towers], at[towers[to]] - at[towers], to, below))
            if len(towers) == n:
                return
            coin = coins[towers] >> np.uint64(_FANOUT_BITS * height) & np.uint64((1 << _FANOUT_BITS) - 1)
            # above the bits of a coin only heads are left
            height += 1
            stay = np.flatnonzero((rank[towers] == 0) | ((coin == 0) & (_FANOUT_BITS * height <= 64)))
            towers, below = towers[stay], stay

    def find(self, text: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Code points before line rank target[i] of text[i]: from the top lane, on while the width allows, then down."""
        place = text.astype(np.int64)
        left = target.astype(np.int64)
        chars = np.zeros(len(place), np.int64)
        for lane in reversed(self.lanes):
            going = np.flatnonzero(left > 0)
            while len(going):
                width = lane.units[place[going]]
                going = going[(width > 0) & (width <= left[going])]
                left[going] -= lane.units[place[going]]
                chars[going] += lane.chars[place[going]]
                place[going] = lane.next[place[going]]
            place = lane.down[place]
        return chars


def lines_of(texts: nt.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first line of each text (n + 1 of them), and the code points of each line, its feed included."""
    data, starts = texts.data, texts.starts
    feeds = np.flatnonzero(data == 0x0A) + 1
    begin = np.union1d(feeds, starts[:-1][starts[:-1] < starts[1:]])
    begin = begin[begin < len(data)]
    heads = ((data & 0xC0) != 0x80).astype(np.int64)
    lengths = np.add.reduceat(heads, begin) if len(begin) else np.empty(0, np.int64)
    return np.searchsorted(begin, starts), lengths


def _cuts(texts: nt.Texts, draws: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of lines of each text, and the code points before its first and its second cut."""
    first, lengths = lines_of(texts)
    n = np.diff(first)
    ranks = [draw % (n + 1) for draw in draws]
    skips, text = SkipList(first, lengths), np.arange(len(n))
    return n, skips.find(text, np.minimum(*ranks)), skips.find(text, np.maximum(*ranks))


def _draw(id_col: Column, seed: int, group: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """row (struct of all columns), n (lines), form, prefix_chars, middle_chars and output of each row of docs.

    A text is cut after the smaller and the larger of two line ranks, each drawn from the id and the seed. form psm
    gives prefix, suffix, middle, form spm suffix, prefix, middle, each after its mark. form plain gives the text itself:
    for texts that are empty, hold a mark or are not drawn to be cut.

    Null texts are empty; a null id draws as an empty one. Equal rows give equal results, an empty table
    none. Ties of the two ranks give an empty middle. Other columns ride along in `row`, whatever their names. A long
    text is worked on whole; a task holds one at a time besides pieces of some 1 MB. No shuffle.
    """
    ship(docs.sparkSession)
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (_draw(key, seed, 2) % 100 >= cut_percent)
    form = F.when(plain, "plain").when(_draw(key, seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), form.alias("form"),
        _draw(key, seed, 0).alias("h1"), _draw(key, seed, 1).alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = [batch.column(c).to_numpy() for c in (3, 4)]
            for texts in nt.chunks(batch.column(1)):
                found = _cuts(texts, tuple(d[texts.rows] for d in draws))
                part = batch.slice(texts.rows.start, texts.rows.stop - texts.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *(pa.array(x, pa.int64()) for x in found)], names=["row", "text", "form", "n", "first", "second"])
    kind = source.schema["row"].dataType.simpleString()
    cut = source.mapInArrow(run, f"row {kind}, text string, form string, n long, first long, second long")

    def part(start: Column | None, end: Column | None) -> Column:
        start = F.lit(0).cast("long") if start is None else start
        size = (F.char_length("text") if end is None else end) - start
        return F.substring("text", (start + 1).cast("int"), size.cast("int"))
    prefix, middle, suffix = part(None, F.col("first")), part(F.col("first"), F.col("second")), part(F.col("second"), None)
    cutting = F.col("form") != "plain"
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .when(cutting, F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text")))
    return cut.select(
        "row", "n", "form", F.when(cutting, F.col("first")).alias("prefix_chars"),
        F.when(cutting, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() took, from its output and form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return (F.when(form == "psm", F.concat(first, middle, second))
            .when(form == "spm", F.concat(second, middle, first)).otherwise(output))
