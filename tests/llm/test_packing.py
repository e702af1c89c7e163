import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagetables.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


def texts():
    rng = random.Random(5)
    odd = [None, "", " ", "\n\t", "a", "It's THE end's, don't!!", "Á İ ΣΣ ΟΔΟΣ", "tab\x0bx\x0cy\x1cz\x85w\xa0v u　t",
           "<|endoftext|> x<|startoftext|>", "12345 a1b2 ...,;!? …, “q”", "😀👍🏽 한국어 中文", "w" * 300, "x" * 20_000, "é ́x"]
    long = " ".join("".join(rng.choice("aeiouthnsrl") for _ in range(rng.randrange(1, 9))) for _ in range(9_000))
    return odd + [long, "Same text, twice.", "Same text, twice."] + ["word " * rng.randrange(1, 3_000) for _ in range(60)]


def test_pieces_are_those_of_the_tokenizer(spark, tokenizer):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = defaultdict(list)
    for r in packing.tokenize(spark.createDataFrame(rows, "doc_id long, text string, piece string"), PATH, with_ids=True).collect():
        got[r.doc_id].append(r)
    for i, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(got[i], key=lambda r: r.piece)
        assert [x for r in parts for x in r.ids] == ids, text
        assert [(r.piece, r.start, r.length) for r in parts] == [(k, k * 2048, min(2048, len(ids) - k * 2048)) for k in range(math.ceil(len(ids) / 2048))]
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def placed_well(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("per_partition", [40, 10_000])
def test_every_piece_is_placed_once(spark, per_partition):
    rng = random.Random(1)
    rows = [(i % 300, 0, 0, rng.choice([rng.randrange(1, 101), 51, 34, 60]), 7, rng.getrandbits(62)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, spread long")
    got = packing.pack(df, 100, per_partition).collect()
    assert sorted((r.doc_id, r.length, r.spread) for r in got) == sorted((r[0], r[3], r[5]) for r in rows)
    bins, bound = placed_well(got, 100), packing.lower_bound(np.array([r[3] for r in rows]), 100)
    assert bound <= bins <= bound + (1 if per_partition > 500 else 12)
    if bins == bound and per_partition > 500:
        assert all(r.certified for r in got)


def test_null_ids_empty_table_and_sequences(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, None)], "doc_id long, text string")
    placed = packing.pack(packing.tokenize(df, PATH, with_ids=True))
    assert placed_well(placed.collect(), 2048) == 1
    whole = packing.sequences(placed).collect()
    assert len(whole) == 1 and len(whole[0].ids) == 7 and whole[0].ids.count(0) == 3
    assert packing.pack(packing.tokenize(df.limit(0), PATH)).count() == 0


def fewest(sizes, capacity):
    """Exact number of bins by search."""
    best = [len(sizes)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(room)
            return
        for k in {r: j for j, r in enumerate(room) if r >= sizes[i]}.values():
            room[k] -= sizes[i]
            go(i + 1, room)
            room[k] += sizes[i]
        go(i + 1, [*room, capacity - sizes[i]])
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
def test_bound_never_exceeds_the_fewest_bins(sizes):
    sizes = sorted(sizes, reverse=True)
    exact = fewest(sizes, 24)
    place, _ = packing.best_fit_decreasing(np.array(sizes), 24)
    assert packing.lower_bound(np.array(sizes), 24) <= exact <= place.max() + 1


def test_bound_is_more_than_the_sum():
    assert packing.lower_bound(np.array([60] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
