"""Quality and toxicity: held-out accuracy, odd rows, and what must not matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastercat.llm import quality, toxicity
from tests.compare import DATA
from tests.llm.helpers import documents, odd_rows, words

BAD = ["vile", "rotten", "foul"]


def corpus(spark, n=1200, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.2, rng.random() < 0.3
        own = words(rng, rng.randrange(20, 200)).split()
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(BAD))
        text = " ".join(w + rng.choice(["$$$", "%%"]) for w in own) if junk else " ".join(own) + "."
        rows.append((i, text, None, None, None, None, None, None))
        labels.append((i, int(not junk), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def area(pairs):
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels, quality.third() != 1)
    held = quality.scored(docs, model).join(labels, "doc_id").filter(quality.third() == 1).select("score", F.col("quality").alias("y")).collect()
    assert area([(r["score"], r["y"]) for r in held]) > 0.98
    assert np.mean([(r["score"] >= 0.5) == (r["y"] == 1) for r in held]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels, toxicity.fifth() != 0)
    held = toxicity.scored(docs, model).join(labels, "doc_id").filter(toxicity.fifth() == 0).select("score", F.col("toxic").alias("y")).collect()
    assert area([(r["score"], r["y"]) for r in held]) > 0.95


def naive_densities(model, x):
    """Log density differences by determinants and solved systems, one row at a time."""
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    out = []
    for row in z:
        pair = []
        for mean, inverse, _ in model.parts:
            cov = np.linalg.inv(inverse @ inverse.T)
            pair.append(-0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (row - mean) @ np.linalg.solve(cov, row - mean))
        out.append(pair[1] - pair[0])
    return np.array(out)


def test_quality_equals_plain_densities():
    rng = np.random.default_rng(3)
    n = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (200, n)), rng.normal(0.7, 1.5, (300, n))])
    y = np.repeat([0, 1], [200, 300])
    model = quality.Discriminant(x, y)
    prior = np.log(300 / 200)
    assert np.allclose(model._odds(x), naive_densities(model, x) + prior)
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-np.clip(naive_densities(model, x) + prior - model.cut, -100, 100) / 4)))


def test_toxicity_equals_plain_convolution():
    """Tabulated terms against embeddings that are looked up and filtered one window at a time."""
    rng = random.Random(2)
    texts = [words(rng, rng.randrange(0, 30)).encode() for _ in range(60)] + [b"", b"one"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids, bounds, whole = toxicity.word_ids(data, offsets)
    model = toxicity.TextCnn()
    model.train([ids[:, a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.arange(len(texts)) % 2)
    embed = model.embed.copy()
    naive = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        vectors, top = [embed[ids[:, w]].sum(0) for w in range(a, b)], []
        for f, bias in zip(model.filters, model.bias, strict=True):
            for c in range(f.shape[2]):
                windows = [sum(float(vectors[i + j] @ f[j, :, c]) for j in range(len(f))) + bias[c] for i in range(len(vectors) - len(f) + 1)]
                top.append(max([0.0, *windows]))
        naive.append(float(np.array(top) @ model.out + model.base))
    model.finish()
    assert np.allclose(model.logits(ids, bounds), naive, atol=1e-4)


def test_the_sample_is_bounded_in_words(spark):
    docs, labels = corpus(spark, 300)
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    got = toxicity._sample_ids(docs.select("doc_id", "text").join(known, "doc_id"), 4000)
    sizes = [(y, len(x) // 12) for x, y in zip(got["ids"], got["label"], strict=True)]
    assert all(1000 < sum(n for y, n in sizes if y == k) <= 2000 for k in (0, 1))
    assert toxicity.fit(docs, labels, F.lit(True), words=1).constant is None or len(got)


def test_every_labelled_row_is_learned_from(spark):
    """A word that only the last toxic rows have, 3,000 others coming first by a hash of the id."""
    rng = random.Random(6)
    rows, labels, toxic = [], [], 0
    for n, r in enumerate(spark.range(7000).orderBy(F.xxhash64("id")).collect()):
        bad = ""
        if n % 2:
            toxic += 1
            bad = " foul" if toxic <= 3000 else " vile"
        rows.append((r["id"], words(rng, 6) + bad, None, None, None, None, None, None))
        labels.append((r["id"], 1, n % 2))
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    probes = documents(spark, [(i, words(rng, 6) + (" vile" if i % 2 else ""), None, None, None, None, None, None) for i in range(200)])
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(probes, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in got]) > 0.95


def test_shards_do_not_depend_on_the_layout(spark):
    docs, labels = corpus(spark, 200)
    a, b = (toxicity.fit(d, labels, F.lit(True), rows=20) for d in (docs, docs.repartition(7, F.rand(3))))
    assert all(np.array_equal(x.terms, y.terms) and np.array_equal(x.cuts, y.cuts) for x, y in zip(a.models, b.models, strict=True))


@pytest.mark.parametrize("name, label, least", [("op5_toxicity", "toxic", 0.94), ("op10_quality", "quality", 0.94)])
def test_held_out_rows_of_the_tables(spark, name, label, least):
    """Of labels that were not learned from, how well scores order the classes."""
    from rastercat.llm import queries

    sf_dir = DATA.rpartition("/")[0] + "/sf0.1"
    rows = queries.queries()[name](spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    pairs = [(r["score"], r[label]) for r in rows.collect()]
    print(name, len(pairs), area(pairs))
    assert len({y for _, y in pairs}) == 2 and area(pairs) > least


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = corpus(spark, 300)
    model = quality.fit(docs, labels, F.lit(True))
    moved = docs.withColumns({"doc_id": F.col("doc_id") + 10_000, "lang": F.lit("xx"), "source": F.lit("other")}).repartition(3)
    a = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    b = {r["doc_id"] - 10_000: r["score"] for r in quality.scored(moved, model).collect()}
    assert a == b


def test_odd_rows_get_scores(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(25)] + [(3, 1, None), (None, 0, 1), (99, None, 1)], "doc_id long, quality int, toxic int")
    for scored in (quality.scored(docs, quality.fit(docs, labels, F.lit(True))), toxicity.scored(docs, toxicity.fit(docs, labels, F.lit(True)))):
        got = [r["score"] for r in scored.collect()]
        assert len(got) == len(odd_rows()) and all(0 <= s <= 1 for s in got)
    assert quality.scored(docs, quality.fit(docs, labels, F.lit(True))).columns == [*docs.columns, "score"]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 0), (2, 1, 0)]])
def test_one_class_or_none(spark, labels):
    docs = documents(spark)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.scored(docs, quality.fit(docs, table, F.lit(True))).collect()} == {1.0}
    assert {r["score"] for r in toxicity.scored(docs, toxicity.fit(docs, table, F.lit(True))).collect()} == {0.0}
    assert quality.accepted(docs, table).count() == docs.count()


def test_empty_documents(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, [])
    assert quality.accepted(docs, labels).count() == 0
    assert toxicity.scored(docs, toxicity.fit(docs, labels, F.lit(True))).count() == 0


def test_statistics_do_not_depend_on_neighbours():
    """A document's row is the same alone and between others."""
    texts = [t.encode() for t in ("one two two", "", "Ä b|c !!\nline\nline", "x" * 50)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    together = quality.statistics(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for row, text in zip(together, texts, strict=True):
        alone = quality.statistics(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert np.allclose(row, alone)


def test_language_by_function_words():
    for k, text in enumerate((b"the cat and of it", "der hund und die von".encode(), b"le chat et les des", b"el gato y los que")):
        data = np.frombuffer(text, np.uint8)
        _, bounds, whole = toxicity.word_ids(data, np.array([0, len(data)]))
        assert toxicity.languages(whole, bounds).tolist() == [k]
