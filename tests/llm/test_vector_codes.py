import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rastercat.llm import vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, entry string"


def plain_nearest(x, entries):
    d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 2, 3, 4, 6, 8]), st.sampled_from([1, 2, 50, 10**4, 10**8]), st.integers(1, 40))
def test_nearest_equals_all_distances(seed, width, spread, many):
    """Also with ties, repeated entries, and large components."""
    rng = np.random.default_rng(seed)
    entries = rng.integers(-spread, spread + 1, (many, width))
    x = np.concatenate([rng.integers(-spread, spread + 1, (30, width)), entries[:3]])
    for got, want in zip(op.Entries(entries).nearest(x), plain_nearest(x, entries), strict=True):
        assert (got == want).all()


def rows(n=150, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    base = [[float(np.float32(v)) for v in rng.normal(0, 0.3, dim)] for _ in range(n)]
    out = [(i, v, i % 3 if i % 5 else None, "c", "e", "n") for i, v in enumerate(base)]
    out += [(200, None, 1, "c", "e", "n"), (201, [None, *base[0][1:]], 1, "c", "e", "n"), (202, [float("nan"), *base[0][1:]], 1, "c", "e", "n"), (-5, [float("inf"), *base[0][1:]], 1, "c", "e", "n")]
    return [*out, out[3], out[3], (None, base[7], None, "c", "e", "n"), (3, base[9], 2, "c", "e", "n"), (203, [None], 1, "c", "e", "n")]


def brute(data, parts=16, entries=64, rounds=2):
    good = [(r[0], r[1], r[2]) for r in data if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = np.array([[math.floor(256 * x) for x in r[1]] for r in good], np.int64)
    x = whole.reshape(len(good), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        found = [plain_nearest(x[:, k], books[k]) for k in range(parts)]
        if step < rounds:
            for k in range(parts):
                for e in set(found[k][0].tolist()):
                    books[k, e] = x[found[k][0] == e, k].sum(0) // (found[k][0] == e).sum()
    codes = ["".join(f"{found[k][0][i]:02x}" for k in range(parts)) for i in range(len(good))]
    errors = [sum(int(found[k][1][i]) for k in range(parts)) for i in range(len(good))]
    sums = {}
    for r, e in zip(good, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    return sorted(((r[0], c, e, sums[r[2]]) for r, c, e in zip(good, codes, errors, strict=True)), key=str), op.Codebooks(books, parts, 256).sha256()


def found(df, hot=op.HOT):
    books = op.trained(df)
    out = op.with_label_errors(op.stored(op.encoded(df, books), "codes"), hot)
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=str), books


@pytest.mark.parametrize("n, hot", [(150, 1000), (150, 2), (20, 1000)])
def test_codes_equal_brute_force(spark, n, hot):
    """Fewer vectors than entries too; labels joined by a broadcast or by a shuffle."""
    data = rows(n)
    got, books = found(spark.createDataFrame(data, SCHEMA).repartition(3), hot)
    want, digest = brute(data)
    assert got == want and books.sha256() == digest
    code = next(r[1] for r in got if r[0] == 0)
    whole = np.floor(np.array(data[0][1]) * 256)
    assert ((op.decoded(code, books) - whole) ** 2).sum() == next(r[2] for r in got if r[0] == 0)


def test_empty_tables_and_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op.op12_vector_codes(spark, str(tmp_path)).count() == 0
    empty = spark.createDataFrame([(1, [], 2), (2, [], None)], "vec_id long, embedding array<double>, label int")
    assert [(r[1], r[2]) for r in found(empty)[0]] == [("00" * 16, 0)] * 2


@pytest.mark.parametrize("bad", [[0.5] * 16, [1e30] * 32])
def test_vectors_that_cannot_be_compared_raise(spark, bad):
    df = spark.createDataFrame([*[(i, [0.1] * 32, 1) for i in range(70)], (99, bad, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="components"):
        found(df)


def test_ids_of_text(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string"))).withColumn("label", F.col("label").cast("string"))
    assert len(found(df)[0]) == 154
