import hashlib
import random
import re

import pytest

from pagetables.llm import decontaminate as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    doc, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        for wins in ([w[i:i + 10] for i in range(len(w) - 9)] if len(w) >= 10 else [w] * bool(w)):
            for at in range(len(doc) - len(wins) + 1):
                if doc[at:at + len(wins)] == wins:
                    hit.update(range(at, at + len(wins)))
                    found.add("" if item_id is None else str(item_id))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def tables(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ünï", "9", "The"]

    def text(n, sep=" "):
        return sep.join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(0, 30), rng.choice([" ", ", ", "\n"]))) for i in range(25)] + [(90, None), (91, ""), (92, "solo"), (93, "..."), (93, text(40)), (7, text(12))]
    docs = [None, "", "Solo", "solo-solo", text(3_000), items[3][1]]
    docs += [text(rng.randrange(60)) + " " + (rng.choice(items)[1] or "").upper() + "! " + text(rng.randrange(30)) for _ in range(120)]
    return items, [*enumerate(docs), (5, docs[5]), (None, "solo")]


@pytest.mark.parametrize(("seed", "block_words", "shard_bytes"), [(1, 10**6, 1 << 22), (2, 40, 1 << 22), (3, 10**6, 300)])
def test_matches_equal_brute_force(spark, seed, block_words, shard_bytes):
    items, docs = tables(seed)
    got = dec.find_matches(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS row"),
        spark.createDataFrame(items, "item_id long, text string"), block_words=block_words, shard_bytes=shard_bytes)
    rows = got.selectExpr("row.doc_id", "row.text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches").collect()
    assert len(rows) == len(docs)
    texts = {}
    for item_id, text in items:
        texts.setdefault(str(item_id), []).append(words(text))
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(r.text, items), r.doc_id
        doc = words(r.text)
        for m in r.matches:
            piece = doc[m.doc_start:m.doc_start + m.length]
            assert len(piece) == m.length and piece in [w[m.item_start:m.item_start + m.length] for w in texts[m.item]]


def test_longest_match_and_removal(spark):
    item = " ".join(f"w{i}" for i in range(30))
    doc = "start " + " ".join(f"w{i}" for i in range(4, 25)) + " end. " + " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, doc, "x"), (2, "w0 w1 w2", "y")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(8, item)], "item_id long, text string")
    found = {r.row.doc_id: r.matches for r in dec.find_matches(docs, bench).collect()}
    assert [tuple(m) for m in found[1]] == [("8", 21, 1, 4)] and found[2] == []
    kept = dec.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "w0 w1 w2", "y")]
    assert dec.decontaminate(docs, bench.limit(0)).count() == 2
    assert dec.decontaminate(docs.limit(0), bench).count() == 0
