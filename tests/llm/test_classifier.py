import random
import zlib

import numpy as np
import pyarrow as pa

from pagetables.llm import classifier
from pagetables.llm import numtext as nt


def corpus(n=700):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 90))]
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "$$$" for w in words] if kind == 1 else words[:1] * len(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels = corpus()
    odd = [(-1, None), (-2, ""), (-3, "\n" * 50), (None, "x"), (-4, "long " * 30_000), (5, docs[5][1])]
    got = classifier.score_table(
        spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 AS score", "'z' AS x"),
        spark.createDataFrame([*labels, (4, 1 - labels[4][1]), (6, None)], "doc_id long, quality int")).collect()
    assert len(got) == len(docs) + len(odd)
    truth = dict(labels)
    rows = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [k for k in truth if rows[k].held_out]
    assert len(held) > 100 and np.mean([rows[k].predicted == truth[k] for k in held]) > 0.97


def test_density_is_the_gaussian_one():
    rng = np.random.default_rng(1)
    d = len(classifier.FEATURES)
    root = rng.normal(size=(2, d, d))
    cov = root @ root.transpose(0, 2, 1) + np.eye(d)
    means = rng.normal(size=(2, d))
    factors = np.linalg.cholesky(cov)
    model = classifier.Model(np.zeros(d), np.ones(d), means, np.linalg.inv(factors),
                             np.array([np.log(p) - np.log(np.diag(f)).sum() for p, f in zip((0.25, 0.75), factors, strict=True)]), None)
    x = rng.normal(size=(5, d))

    def density(k, row):
        y = row - means[k]
        return (0.25, 0.75)[k] * np.exp(-0.5 * y @ np.linalg.solve(cov[k], y)) / np.sqrt(np.linalg.det(cov[k]))
    want = [density(1, r) / (density(0, r) + density(1, r)) for r in x]
    assert np.allclose(classifier.score(model, x), want)


def test_without_a_class_and_empty(spark):
    docs, labels = corpus(40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([(-9, 1)], "doc_id long, quality int")
    assert {r.score for r in classifier.score_table(df, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, quality int")
    assert {r.score for r in classifier.score_table(df, ones).collect()} == {1.0}
    assert classifier.score_table(df.limit(0), ones).count() == 0


def test_keep_good_keeps_all_columns(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, "s", 3) for d in docs], "doc_id long, text string, score string, row int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = classifier.keep_good(df, lab)
    assert kept.columns == df.columns
    good = {r.doc_id for r in classifier.score_table(df, lab).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good and 0 < len(good) < len(docs)


def test_statistics_of_small_texts():
    texts = next(nt.chunks(pa.array(["", "A a a a", "a|b $ !! 12"])))
    x = classifier.text_statistics(texts)
    assert x.shape == (3, len(classifier.FEATURES)) and np.isfinite(x).all()
    assert x[1, 6] > x[2, 6] and x[2, 4] > x[1, 4]
