import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetables.llm import middle


def brute(key, text, cut_percent=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    cuts = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut_percent:
        return len(units), "plain", None, None, text
    a, b, c = ("".join(units[i:j]) for i, j in ((0, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None)))
    if h[3] % 100 < 50:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def texts():
    rng = random.Random(11)
    fixed = [None, "", "\n", "\n\n\n", "no feed", "é\n𝄞𝄞\n", "has <S> in it\nline", "<P", "a<\n>b\n<M", "x\r\ny z\n"]
    made = ["".join(rng.choice(["é", "a b", "\n", "𝄞x\n", "<", "S>", "word "]) for _ in range(rng.randrange(200))) for _ in range(200)]
    return [*fixed, *made, "".join(f"line {k} é\n" for k in range(200_000)), "long" * 600_000]


@pytest.mark.parametrize("cut_percent", [100, 40])
def test_equal_to_brute_force_and_back(spark, cut_percent):
    rows = [*enumerate(texts()), (None, "null id\nsecond\nthird"), (3, "again 3\nx"), (3, "again 3\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = middle.fill_in_middle(docs, cut_percent=cut_percent)
    got = found.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output",
                       middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[2:7]) == brute(r.doc_id, r.text, cut_percent), r.doc_id
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_skip_list_finds_every_rank():
    rng = np.random.default_rng(5)
    counts = np.array([0, 1, 2, 0, 3000, 17, 0])
    lengths = rng.integers(0, 50, counts.sum())
    first = np.concatenate([[0], np.cumsum(counts)])
    skips = middle.SkipList(first, lengths)
    assert len(skips.lanes) > 4
    for text, n in enumerate(counts):
        ranks = np.arange(n + 1)
        want = np.concatenate([[0], np.cumsum(lengths[first[text]:first[text + 1]])])
        assert (skips.find(np.full(n + 1, text), ranks) == want).all()
    empty = middle.SkipList(np.array([0]), np.empty(0, np.int64))
    assert len(empty.find(np.empty(0, np.int64), np.empty(0, np.int64))) == 0


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\n", "mine", 5)], "doc_id long, text string, form string, n int")
    r = middle.fill_in_middle(docs).first()
    assert (r.row.form, r.row.n, r.n) == ("mine", 5, 3)
    assert middle.fill_in_middle(docs.limit(0)).count() == 0
    named = docs.withColumnRenamed("doc_id", "row").withColumnRenamed("text", "output")
    assert middle.fill_in_middle(named, "row", "output").first().output == r.output
