"""Best-fit packing of tokenised documents into sequences, certified by lower bounds."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import numtext as nt
from pagetables.llm.common import cut

CAPACITY = 2048
PIECES_PER_PARTITION = 5_000
ROUNDS = 4
CACHED_WORDS = 500_000

PLACED = "sequence_id long, offset long, certified boolean"


class WordIds:
    """Ids of words, cached by word hash; the cache is emptied when it is full.

    The tokenizer drops white space and treats what stands between white space by itself, so
    the ids of a text are those of its words, one after another.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def encode(self, words: list[str]) -> list[list[int]]:
        model = self.tokenizer.model
        out: list[list[int] | None] = [
            [t.id for t in model.tokenize(w)] if w.isascii() and w.isalpha() and len(w) < 64 else None for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def __call__(self, texts: nt.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and how many each text has."""
        data = nt.lowered(texts.data)
        words = nt.spans(nt.PRINTED[data], texts.starts)
        keys, first, inverse = np.unique(nt.run_hashes(data, words.start, words.end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHED_WORDS:
            self.clear()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            made = self.encode([raw[s:e].decode() for s, e in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)])
            count = np.fromiter(map(len, made), np.int64, len(made))
            start = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in made for i in x), np.uint32, int(count.sum()))])
            at = np.searchsorted(self.keys, keys[new])
            self.keys, self.start, self.count = np.insert(self.keys, at, keys[new]), np.insert(self.start, at, start), np.insert(self.count, at, count)
            place = np.searchsorted(self.keys, keys)
        count = self.count[place][inverse]
        start = self.start[place][inverse]
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count - start, count)
        return self.ids[at], nt.per_text(count, words.first)


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer and cache for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, spread and, if asked for, ids.

    `tokenizer` is the path of a file for the tokenizers library, the same on all executors. A
    document is its ids, then end_id; only a longer one is cut, into pieces of capacity tokens.
    A null or empty text is the end id alone. Repeated rows are repeated documents.
    Other columns are not read. spread is a number without regard to the content.
    """
    extra = "piece array<int>, start array<long>, length array<long>, crc array<long>, spread array<long>" + ", ids array<array<int>>" * with_ids

    def work(texts: nt.Texts) -> list[pa.Array]:
        ids, counts = word_ids(tokenizer)(texts)
        n = len(counts)
        ends = np.cumsum(counts)
        full = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
        size = counts + 1
        pieces = -(-size // capacity)
        owner = np.repeat(np.arange(n), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(size[owner] - start, capacity)
        at = (np.cumsum(size) - size)[owner] + start
        crc = np.fromiter((zlib.crc32(full[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(at))
        context = TaskContext.get()
        row = nt.mix(np.arange(len(owner), dtype=np.uint64) + np.uint64((context.partitionId() if context else 0) << 40) + np.uint64(int(full[:8].sum()) << 16))
        spread = (row >> np.uint64(1)).astype(np.int64)
        out = [nt.lists(x, pieces, k) for x, k in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (spread, pa.int64()))]
        if with_ids:
            inner = pa.ListArray.from_arrays(pa.array(np.append(at, len(full)).astype(np.int32)), pa.array(full.astype(np.int32)))
            out.append(pa.ListArray.from_arrays(out[0].offsets, inner))
        return out

    rows = nt.annotate(docs, text_col, [id_col], extra, work)
    names = ["piece", "start", "length", "crc", "spread", *["ids"] * with_ids]
    return rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), F.inline(F.arrays_zip(*names))).withColumnRenamed("crc", "ids_crc32")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Fewest bins that sizes can need, by dual feasible functions (whole numbers throughout).

    Two families: small sizes count nothing and large ones a whole bin (for each threshold),
    and sizes rounded down to k-ths of a bin. Each maps sizes so that what fits one bin still
    does; the rounded-up sum over the capacity is a bound.
    """
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((counts * x).sum()) // capacity)
    for low in range(1, capacity // 2 + 1):
        value = np.where(x > capacity - low, capacity, np.where(x >= low, x, 0))
        best = max(best, -(-int((counts * value).sum()) // capacity))
    for k in range(1, 65):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (sorted from large to small): the fullest bin that takes it.

    A bit mask has the free spaces that some bin has, so the fullest bin is one shift away.
    """
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = opened = 0
    place, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            stack = bins[space]
            bin_ = stack.pop()
            if not stack:
                mask ^= 1 << space
        else:
            space, bin_, opened = capacity, opened, opened + 1
        place[i], offset[i] = bin_, capacity - space
        left = space - size
        if left:
            if not bins[left]:
                mask |= 1 << left
            bins[left].append(bin_)
    return place, offset


def _pack_group(rows: pa.Table, capacity: int, stamp: int, group: int) -> pa.Table:
    """One partition packed anew; its old bins stay where that doesn't save one."""
    rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "spread"))])
    sizes = rows["length"].to_numpy()
    place, offset = best_fit_decreasing(sizes, capacity)
    bins, bound = int(place.max()) + 1, lower_bound(sizes, capacity)
    old = None if rows["sequence_id"].null_count else len(rows["sequence_id"].unique())
    if old is None or bins < old:
        new = {"sequence_id": (((stamp << 40) + group) << 20) + place, "offset": offset}
        old = bins
        for name, values in new.items():
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values, pa.int64()))
    return rows.set_column(rows.schema.get_field_index("certified"), "certified", pa.array(np.full(len(rows), old == bound)))


def _packer(capacity: int, stamp: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return _pack_group(rows.drop_columns(["_group"]), capacity, stamp, key[0].as_py())
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """Places every piece: its columns with sequence_id, offset and certified.

    Pieces are dealt at random into partitions of about per_partition (under 2^20), each packed by best-fit
    decreasing. Where the number of bins equals the lower bound, they are certified as
    fewest and stay. The other partitions put their bins with room together, deal them
    out anew and pack again, for some rounds or until all are certified; a partition keeps its old
    bins where the new ones are not fewer. An empty table gives no rows.
    """
    current = cut(pieces.withColumns({
        "sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "certified": F.lit(False)}))
    schema = current.schema
    done: list[DataFrame] = []
    before = None
    for stamp in range(rounds):
        n, load = current.agg(F.count("*"), F.sum("length")).first()
        if not n or before == (n, load):
            break
        before = (n, load)
        groups = -(-n // per_partition)
        # whole bins move together, so that old and new bins of a partition can be compared
        token = F.xxhash64(F.lit(stamp), F.coalesce("sequence_id", "spread"))

        packed = cut(current.withColumn("_group", F.pmod(token, F.lit(groups))).groupBy("_group").applyInArrow(_packer(capacity, stamp), schema))
        left = packed.groupBy("sequence_id").agg(F.sum("length").alias("_used"))
        full = packed.join(left, "sequence_id").withColumn("_stays", F.col("certified") | (F.col("_used") == capacity))
        full = cut(full.drop("_used"))
        done.append(full.filter("_stays").drop("_stays"))
        current = full.filter("NOT _stays").drop("_stays")
    result = current
    for part in done:
        result = result.unionByName(part)
    return result.select(*pieces.columns, "sequence_id", "offset", "certified")


def sequences(placed: DataFrame) -> DataFrame:
    """Token ids of each sequence, for pieces that were made with_ids: sequence_id, ids, doc_ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
