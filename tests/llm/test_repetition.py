import random
import re
from collections import Counter

import pytest

from pagetables.llm.repetition import quality_rules, repetition_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, ngrams):
    text = text or ""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    tokens = [text[a:b] for a, b in words]

    def repeated(n):
        grams = Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))
        hit = [False] * len(tokens)
        for i in range(len(tokens) - n + 1):
            if grams[tuple(tokens[i:i + n])] > 1:
                hit[i:i + n] = [True] * n
        return hit

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line) and line in seen:
            dup, dup_chars = dup + 1, dup_chars + len(line)
        seen.add(line)
    return (len(tokens), sum(map(len, tokens)), sum(c in "#*$%&|<>" for c in text), dup, sum(repeated(8)),
            dup_chars, len(text) - text.count("\n"),
            [sum(len(t) for t, h in zip(tokens, repeated(n), strict=True) if h) for n in ngrams])


def texts():
    rng = random.Random(3)
    fixed = [None, "", " ", "\n\n", "a", "é ß x   y", "a\x00b\tc\x0bd\x1ce", "x # y <b> | & $ %%",
             "same line here\nsame line here\nsame line here\n\n\n", "  \n  \nw\n", "one two three " * 40]
    made = [" ".join(rng.choice(["le", "é", "the", "of", "\n", "x\ny"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    return fixed + made + ["word%d " % 1 * 40_000, " ".join(map(str, range(60_000)))]


@pytest.mark.parametrize("ngrams", [(3, 5, 8, 13), (2,)])
def test_counts_equal_brute_force(spark, ngrams):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1:] for r in repetition_stats(df, ngrams).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "line_chars",
        "gram_chars").collect()}
    for key, text in rows:
        assert tuple(got[key]) == brute(text, ngrams), key


def test_verdicts_and_odd_tables(spark):
    clean = " ".join(f"w{i}" for i in range(50))
    lines = "\n".join(["this line comes again and again here"] * 9)
    df = spark.createDataFrame(
        [(1, clean, 7), (1, clean, 7), (2, lines, 7), (3, None, 7), (None, "few words", 7)],
        "doc_id long, text string, n_words int")
    got = quality_rules(df).select("doc_id", "base_failed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, False, True), (1, False, True), (2, True, False), (3, True, False), (None, True, False)], key=str)
    assert quality_rules(df.limit(0)).count() == 0
