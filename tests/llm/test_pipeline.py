"""The pipeline's stages against brute force, each on its predecessor's rows."""

import random

import pytest

import corpus_pipeline
from rastercat.llm import quality
from tests.llm import test_exact_dedup, test_minhash
from tests.llm.helpers import words
from tests.llm.test_decontaminate import words as plain_words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root, rng = str(tmp_path_factory.mktemp("tables")), random.Random(12)
    rows, labels, items = [], [], [(k, words(rng, 14)) for k in range(3)]
    for i in range(240):
        junk = i % 5 == 0
        own = words(rng, rng.randrange(30, 90)).split()
        if i % 11 == 3:
            own[10:10] = items[i % 3][1].split()
        text = " ".join(w + "$$$" for w in own) if junk else " ".join(own) + "."
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(not junk), 0))
    for k in range(30):  # copies and near copies of good ones
        near = rows[k + 1][1].split()
        near[-1] = near[-1] if k % 2 else "changed"
        rows.append((1000 + k, " ".join(near) + ("  " if k % 2 else ""), "en", "s0", 0))
    rows += [rows[7], (None, "a row without an id.", None, None, None), (2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_equal_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, items = docs.columns, [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    start, good, exact, near, clean, mix = ([(r["doc_id"], r["text"]) for r in rows] for rows in seen)
    ids = lambda rows: sorted((i for i, _ in rows), key=str)

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels, quality.third() != 1)
    scores = quality.scored(spark.read.parquet(f"{folder}/documents.parquet"), model).collect()
    assert ids(good) == ids([(r["doc_id"], 0) for r in scores if r["score"] >= 0.5])
    assert not [i for i, t in good if t and "$$$" in t]
    kept = {i for i, _, _, same in test_exact_dedup.brute(good) if same}
    assert ids(exact) == sorted(kept, key=str)
    assert ids(near) == sorted((i for i, _, _, same in test_minhash.brute(exact, 5) if same), key=str)
    grams = {tuple(w[k : k + 10]) for w in map(plain_words, items) for k in range(len(w) - 9)}
    bad = {i for i, t in near for w in [plain_words(t)] if any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9))}
    assert bad and ids(clean) == sorted((i for i, _ in near if i not in bad), key=str)
    assert set(ids(mix)) <= set(ids(clean)) and all(1 <= r["copies"] <= 3 for r in seen[5])


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "text", "taken", "position"} <= set(out.columns)
