"""Odd documents that every operator must take, and brute-force results to compare with."""

import hashlib
import random

from pyspark.sql import types as T

#: Extra columns whose names clash with ones that operators make inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("digest", T.StringType()),
    ]
)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(seed=3):
    rng = random.Random(seed)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t", "one", "One", base, base, base.upper(), " ".join(near), base + " " + words(rng, 4), "é ü " * 40, words(rng, 20_000, 3000), "x", "mail a.b@c.de now +1 (212) 555-0100"]
    passage = words(rng, 60)
    texts += [words(rng, 30) + " " + passage + " " + words(rng, k) for k in (0, 5, 40)]
    texts += [words(rng, rng.randrange(1, 80)) for _ in range(15)]
    return texts


def odd_rows(seed=3):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t) if t is not None else None, "k", "z", "d") for i, t in enumerate(odd_texts(seed))]
    return [*rows, rows[5], rows[5], (None, "an id that is missing", None, None, None, None, None, None)]


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
