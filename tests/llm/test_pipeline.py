import random

import pytest

import corpus_pipeline


def words(rng, n):
    return " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    good = [f"{words(rng, 120)}.\n{words(rng, 80)}." for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in words(rng, 90).split()) for _ in range(60)]
    bench = [words(rng, 30) for _ in range(5)]
    edited = good[0].split(" ")
    edited[50] = "edit"
    rows = [(i, t) for i, t in enumerate(good + bad)]
    rows += [(500, good[0]), (501, " ".join(edited)), (502, f"{words(rng, 60)} {bench[0]} {words(rng, 60)}"), (503, f"{good[1]}\n{words(rng, 70)}"),
             (504, None), (505, ""), (0, good[0])]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(range(120)) <= set(kept["quality"]) and not set(range(120, 180)) & set(kept["quality"])
    assert {500, 501, 502, 503} <= set(kept["quality"])
    assert 500 not in kept["line_dedup"] and kept["line_dedup"][503].count("\n") == 0 and kept["line_dedup"][1] == kept["quality"][1]
    assert set(range(120)) <= set(kept["near_dedup"])
    assert 502 in kept["near_dedup"] and 502 not in kept["decontamination"]
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {502}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    assert set(range(120)) <= {r.doc_id for r in out.collect()}


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
