import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from pagetables.llm import components, linededup
from pagetables.llm import numtext as nt

WHITE = " \t\x0b\x0c\r"


def shingles(line, n=8):
    return {line[i:i + n] for i in range(max(1, len(line) - n + 1))}


def similar(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def brute(docs, threshold=0.8, min_chars=20):
    """Texts after removal, and the (id, line) that stays for each one removed."""
    lines = [(i, k, x.strip(WHITE)) for i, t in docs for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= min_chars]
    keys = sorted({x[2] for x in lines})
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in combinations(keys, 2):
        if similar(a, b) >= threshold:
            root[top(a)] = top(b)
    keeper = {}
    for i, k, x in lines:
        r = top(x)
        keeper[r] = min(keeper.get(r, (i, k)), (i, k))
    gone = {(i, k): keeper[top(x)] for i, k, x in lines if keeper[top(x)] != (i, k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}, gone


def corpus():
    rng = random.Random(4)

    def line(n=12):
        return " ".join("".join(rng.choice("abcdeéfghijklmnopß") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    base = [line(rng.randrange(4, 40)) for _ in range(60)]

    def variant(x):
        words = x.split(" ")
        if len(words) > 25 and rng.random() < 0.5:
            words[rng.randrange(len(words))] = "changed"
        return rng.choice(["", "  ", "\t"]) + " ".join(words) + rng.choice(["", " ", "\r"])
    docs = [(i, "\n".join(rng.choice([variant(rng.choice(base)), line(), "", "short", "- - -"]) for _ in range(rng.randrange(1, 12)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, base[0]), (204, base[0] + "\n" + base[0]), (205, " ".join(base) * 20), (206, " ".join(base) * 20 + " end")]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, removed string, line int")
    want, gone = brute(docs)
    got = linededup.dedup_lines(df).collect()
    assert len(got) == len(docs)
    for r in got:
        i = r.row.doc_id
        assert r.row.text == want[i] and r.row.removed == "x", i
        assert {(x.line, (x.of_id, x.of_line)) for x in r.removed or []} == {(k, v) for (d, k), v in gone.items() if d == i}
    assert len(gone) > 80


def test_repeated_rows_null_ids_and_empty_table(spark):
    line = "one line of enough characters to count"
    df = spark.createDataFrame([(None, line), (1, line), (1, line), (2, "x\n" + line)], "doc_id long, text string")
    got = sorted(((r.row.doc_id, r.row.text) for r in linededup.dedup_lines(df).collect()), key=str)
    # the null id comes first, so its line stays
    assert got == [(1, ""), (1, ""), (2, "x"), (None, line)]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_exact_similarity():
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abé") for _ in range(rng.randrange(1, 60))), "".join(rng.choice("abé") for _ in range(rng.randrange(1, 60)))) for _ in range(300)]
    pairs += [(a, a) for a, _ in pairs[:5]] + [("", ""), ("", "a")]
    got = linededup.jaccard(*(pa.array(x) for x in zip(*pairs, strict=True)))
    want = [1.0 if a == b else 0.0 if not a or not b else similar(a, b) for a, b in pairs]
    assert np.allclose(got, want)


def test_signature_recall():
    rng = random.Random(2)
    found = 0
    for _ in range(200):
        a = "".join(rng.choice("abcdefgh ") for _ in range(200))
        at = rng.randrange(20, 180)
        b = a[:at] + "XYZ" + a[at + 3:]
        texts = next(nt.chunks(pa.array([a, b])))
        bands = linededup.signature_bands(texts.data, texts.starts[:-1], texts.starts[1:])
        found += bool((bands[0] == bands[1]).any())
    assert found >= 199


@pytest.mark.parametrize("shape", ["path", "star", "random", "loops"])
def test_components(spark, shape):
    rng = random.Random(3)
    ids = [rng.getrandbits(63) - (1 << 62) for _ in range(400)]
    if shape == "path":
        edges = list(zip(ids, ids[1:], strict=False))
    elif shape == "star":
        edges = [(ids[200], x) for x in ids if x != ids[200]]
    elif shape == "loops":
        edges = [(x, x) for x in ids[:9]]
    else:
        edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(260)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.root for r in components.components(df).collect()} == {x: top(x) for x in root if top(x) != x}


def test_bloom_filter_has_all_its_keys(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, 3000)
    filter_ = components.bloom(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert components.in_bloom(filter_, keys).all()
    assert components.in_bloom(filter_, rng.integers(-(1 << 62), 1 << 62, 3000)).mean() < 0.01


def pairs_in_one_band(spark, n):
    """Components of n pairs of like lines that all stand in one band, by lines."""
    rng = random.Random(5)
    # cheap false candidates: all lines have a passage in common
    lines = ["the passage that all of these lines have " + "".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(n)]
    lines += [x[:60] + "XY" + x[62:] for x in lines]
    keyed = spark.createDataFrame([(rng.getrandbits(62), x) for x in lines], "key long, text string").persist()
    root = {r.key: r.key for r in keyed.collect()}
    labels = components.link(
        keyed.selectExpr("key", "array(7L) AS bands"), lambda keys: keyed.join(keys, "key"),
        lambda pairs: linededup.verified(pairs, 0.8), linededup.shingle_sets, 0.8)
    root |= {r.node: r.root for r in labels.collect()}
    return lines, {r.text: root[r.key] for r in keyed.collect()}


def test_all_pairs_of_a_big_band_are_linked(spark):
    lines, root = pairs_in_one_band(spark, 150)
    assert all(root[a] == root[b] for a, b in zip(lines[:150], lines[150:], strict=True))
    assert len(set(root.values())) == 150


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_blocks_lose_no_pair(threshold):
    rng = random.Random(6)
    base = ["".join(rng.choice("ab é") for _ in range(60)) for _ in range(30)]
    texts = sorted({b[:k] + b[k + rng.randrange(1, 9):] for b in base for k in (2, 5, 30, 52, 57)} | {"", "short"})
    near = {(i, j) for i, j in combinations(range(len(texts)), 2) if texts[i] and similar(texts[i], texts[j]) >= threshold}
    everyone, none = np.ones(len(texts), bool), np.arange(len(texts))
    a, b = components.similar_in_block(pa.array(texts), none, everyone, everyone, linededup.shingle_sets, threshold)
    assert len(near) > 50 and {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == near
    # one partner of each root, only between the two sides
    root, lead = none // 7, none % 3 == 0
    a, b = components.similar_in_block(pa.array(texts), root, lead, ~lead, linededup.shingle_sets, threshold)
    want = {(i, root[j]) for p in near for i, j in (p, p[::-1]) if lead[i] and not lead[j] and root[i] != root[j]}
    assert sorted(zip(a.tolist(), root[b].tolist(), strict=True)) == sorted(want)
    assert all((min(p), max(p)) in near for p in zip(a.tolist(), b.tolist(), strict=True))


def test_a_big_band_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 4000)
    lines, root = pairs_in_one_band(spark, 150)
    assert all(root[a] == root[b] for a, b in zip(lines[:150], lines[150:], strict=True))
    assert len(set(root.values())) == 150


def test_recall_at_the_threshold_through_link(spark):
    rng = random.Random(7)
    pairs = []
    while len(pairs) < 4000:
        a = "".join(rng.choice("abcdefgh ") for _ in range(100))
        at = rng.randrange(10, 85)
        b = a[:at] + "XYZ" + a[at + 3:]
        if 0.8 <= similar(a, b) < 0.82:
            pairs.append((a, b))
    lines = [x for p in pairs for x in p]
    texts = next(nt.chunks(pa.array(lines)))
    bands = linededup.signature_bands(texts.data, texts.starts[:-1], texts.starts[1:]).view(np.int64).tolist()
    df = spark.createDataFrame([(k, x, b) for k, (x, b) in enumerate(zip(lines, bands, strict=True))], "key long, text string, bands array<long>").persist()
    labels = components.link(
        df.select("key", "bands"), lambda keys: df.select("key", "text").join(keys, "key"),
        lambda pairs: linededup.verified(pairs, 0.8), linededup.shingle_sets, 0.8)
    root = {r.node: r.root for r in labels.collect()}
    recall = sum(root.get(k, k) == root.get(k + 1, k + 1) for k in range(0, len(lines), 2)) / len(pairs)
    print(f"recall {recall}")
    assert recall > 0.9977  # eight bands: 0.997


def test_recall_at_the_threshold_with_finer_bands(spark):
    rng = random.Random(8)
    lines = []
    while len(lines) < 8000:
        a = "".join(rng.choice("abcdefgh ") for _ in range(100))
        at = rng.randrange(10, 85)
        b = a[:at] + "XYZ" + a[at + 3:]
        if 0.8 <= similar(a, b) < 0.82:
            lines += [a, b]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(5)
    gone = {r.id: r.removed for r in linededup.removed_lines(docs).collect()}
    assert all(k % 2 and [(x.of_id, x.of_line) for x in removed] == [(k - 1, 0)] for k, removed in gone.items())
    print(f"recall {len(gone) / 4000}")
    assert len(gone) / 4000 > 0.9977
