import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagetables.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_words(rows, rate, least, most):
    total = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            crc = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if crc % rate == 0:
                at = crc % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= most}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(words, factor=5):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def rows_of(seed, alphabet, length, count):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(4, length))) for _ in range(60)]
    texts = []
    for _ in range(count):
        words = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(stems[:1 + int(rng.expovariate(0.05)) % 60])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + rng.choice(alphabet) + w[at:], w[:at] + w[at + 1:], w[:at] + rng.choice(alphabet) + w[at + 1:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", "\n", "×÷ ", "1"]).join(words))
    return [*enumerate([None, "", " 12 ", *texts]), (None, "nullid " * 7), (7, texts[4]), (7, texts[4])]


@pytest.mark.parametrize("seed, alphabet, length", [(1, "ab", 9), (2, "aé", 12), (3, "abcdefghijklmnopqrstuvwxyzÿÀ", 14), (4, "a", 14)])
def test_equal_to_brute_force(spark, seed, alphabet, length):
    rows = rows_of(seed, alphabet, length, 150)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    words = brute_words(rows, 19, 6, 3)
    got = spelling.spelling_variants(docs, error_rate=19, min_count=3).collect()
    assert len(got) == len(words) and (len(words) > 8)
    assert {tuple(r) for r in got} == brute(words)


def test_short_words_and_other_limits(spark):
    rows = rows_of(8, "abc", 7, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.spelling_variants(docs, error_rate=50, min_chars=4, min_count=2, factor=2).collect()
    assert {tuple(r) for r in got} == brute(brute_words(rows, 50, 4, 2), 2)
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, min_chars=3)
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, factor=1)


def test_long_runs_and_empty_tables(spark):
    long = "ab" * 2_000
    rows = [(k, t) for k in range(5) for t in (long, long + "c", "é" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in spelling.spelling_variants(docs).collect()}
    assert got == brute(brute_words(rows, 199, 6, 5)) and len(got) >= 2
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.selectExpr("doc_id", "cast(null as string) as text")).count() == 0


def test_checksums():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    start = np.sort(rng.integers(0, 3000, 50))
    end = start + np.concatenate([rng.integers(0, 64, 40), rng.integers(60, 900, 10)])
    seeds = rng.integers(0, 1 << 32, 50).astype(np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(start, end, seeds, strict=True)]
    assert spelling.checksums(data, start, end, seeds).tolist() == want


def test_pruned_dictionary_loses_no_pair(spark):
    rows = rows_of(5, "abcd", 10, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = spelling.vocabulary(docs, error_rate=20, min_count=1)
    all_words = sorted(r.word for r in words.collect())
    want = {(a, b) for i, a in enumerate(all_words) for b in all_words[i + 1:] if one_edit(a, b)}
    for prune in (1, 1000):
        got = [(r.word, r.other) for r in spelling.near_words(words, prune=prune).collect()]
        assert len(got) == len(want) and set(got) == want


def test_lists_are_spread_and_not_broadcast(spark, tmp_path):
    # the lists take some forty times the room of the words, by which Spark judges their size
    rows = [(f"{a}{b}stem{c}", 1) for a in "abcdef" for b in "abcdef" for c in "abcdef"]
    spark.createDataFrame(rows, "word string, n long").coalesce(1).write.parquet(f"{tmp_path}/words")
    near = spelling.near_words(spark.read.parquet(f"{tmp_path}/words"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert near.count() == 3 * 6 * 6 * 15
