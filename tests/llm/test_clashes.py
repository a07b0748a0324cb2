"""Columns whose names operators use inside: they are carried through, or do no harm; ids may be texts."""

import pytest
from pyspark.sql import functions as F

from rastercat.llm import decontaminate, exact_dedup, licences, minhash, mixing, pii, quality, repeats, toxicity, url_filter
from tests.llm.helpers import odd_texts

NAMES = [
    "__items", "__n_hit", "__n_words", "__spans", "__t1", "__t2", "__digest", "__score", "__size", "__gone", "__cuts", "__raw", "__text", "__row", "__dir", "__name", "base", "added", "row", "key", "n", "f1", "h", "t1",
    "c1", "place", "ranges", "digest", "old", "best", "score", "label", "target", "copies", "position", "size", "bucket", "group", "own_licence", "own_score", "declares", "licence", "id", "item", "a col`s", "path",
]


def docs(spark, kind="long"):
    rows = [(i, t, f"s{i % 3}", "en") for i, t in enumerate(x for x in odd_texts() if len(x or "") < 5000)]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, source string, lang string").withColumn("doc_id", F.col("doc_id").cast(kind))
    return df.select("*", *(F.lit(f"kept {n}").alias(n) for n in NAMES))


def labels(spark, kind="long"):
    df = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    return df.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({"label": F.lit("x"), "text": F.lit("y")})


BENCHMARK = [(1, "one"), (2, "absent"), (3, "mail a b c")]

CARRYING = {
    "decontaminate documents": lambda s, d, k: decontaminate.cleaned(d, s.createDataFrame(BENCHMARK, "item_id long, text string")),
    "decontaminate spans": lambda s, d, k: decontaminate.cleaned(d, s.createDataFrame(BENCHMARK, "item_id long, text string"), remove="spans"),
    "decontaminate spans, slices": lambda s, d, k: decontaminate.cleaned(d, s.createDataFrame(BENCHMARK, "item_id long, text string"), remove="spans", slice_bytes=10),
    "decontaminate documents, slices": lambda s, d, k: decontaminate.cleaned(d, s.createDataFrame(BENCHMARK, "item_id long, text string"), slice_bytes=10),
    "exact_dedup": lambda s, d, k: exact_dedup.deduplicated(d),
    "minhash": lambda s, d, k: minhash.deduplicated(d),
    "mixing": lambda s, d, k: mixing.mixed(d),
    "pii": lambda s, d, k: pii.masked(d),
    "quality": lambda s, d, k: quality.accepted(d, labels(s, k)),
}


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("name", CARRYING)
def test_columns_are_carried(spark, name, kind):
    df = docs(spark, kind)
    out = CARRYING[name](spark, df, kind)
    assert out.columns[: len(df.columns)] == df.columns
    rows = out.collect()
    assert rows and all(r[n] == f"kept {n}" for r in rows for n in NAMES)


SEEN = {
    "decontaminate": lambda s, d, k: decontaminate.hits(d, s.createDataFrame(BENCHMARK, "item_id long, text string")),
    "exact_dedup": lambda s, d, k: exact_dedup.duplicate_groups(d),
    "minhash": lambda s, d, k: minhash.near_duplicates(d),
    "mixing": lambda s, d, k: mixing.plan(d).withColumn("x", F.explode(F.sequence(F.lit(1), "n_rows"))),
    "pii": lambda s, d, k: pii.spans(d),
    "quality": lambda s, d, k: quality.scored(d.drop("score"), quality.fit(d, labels(s, k), F.lit(True))),
    "repeats": lambda s, d, k: repeats.without_repeats(d),
    "toxicity": lambda s, d, k: toxicity.scored(d, toxicity.fit(d, labels(s, k), F.lit(True))),
    "url_filter": lambda s, d, k: url_filter.judged(d.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("http://a.org/x"))),
    "licences": lambda s, d, k: licences.with_licences(d),
}


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("name", SEEN)
def test_columns_do_no_harm(spark, name, kind):
    df = docs(spark, kind)
    assert SEEN[name](spark, df, kind).count() == df.count()
