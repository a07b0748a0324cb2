"""Searches with a growing radius and sliced verification against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastercat.functions import hashing, imaging
from rastercat.operators import similarity, verify


def words(bits, n):
    return [bits >> (32 * k) & 0xFFFFFFFF for k in range(n)]


def near(rng, bits, base):
    for k in rng.sample(range(bits), min(bits, rng.choice((0, 1, 2, 3, 6, 12, 25)))):
        base ^= 1 << k
    return base


def sides(spark, hash_size, groups, n_left, n_right, seed):
    """Left hashes near to right ones, and some that are near to none."""
    rng, bits = random.Random(seed), hash_size * hash_size
    size = hashing.n_words(hash_size)
    right = {(g, rng.getrandbits(bits)) for g in range(groups) for _ in range(n_right)}
    right |= {(0, near(rng, 6, 0)) for _ in range(5)}  # nearly empty hashes
    pool = sorted(right)
    left = {(g, near(rng, bits, h)) for g, h in rng.choices(pool, k=n_left)} | {(g, rng.getrandbits(bits)) for g in range(groups + 1)}
    rows = [(g, words(h, size), k % 7, f"p{k}") for k, (g, h) in enumerate(pool)]
    rows += [(g, w, o + 1, p + "b") for g, w, o, p in rows[::5]]
    return sorted(left), rows, spark.createDataFrame([(g, words(h, size)) for g, h in left], "g int, l_words array<bigint>"), spark.createDataFrame(rows, "g int, r_words array<bigint>, o int, path string")


def brute(left, right, k, hash_size, by):
    out, size = [], hashing.n_words(hash_size)
    for g, h in left:
        own = words(h, size)
        found = sorted((sum((a ^ b).bit_count() for a, b in zip(own, w, strict=True)), o, p, w) for g2, w, o, p in right if g2 == g or not by)
        out += [(*((g,) if by else ()), tuple(own), tuple(w), o, p, d) for d, o, p, w in found[:k]]
    return sorted(out)


@pytest.mark.parametrize("hash_size, by, k, block", [(8, True, 1, 10), (8, False, 1, 10), (8, False, 3, 25), (8, True, 2, 10**6), (4, False, 2, 5), (16, True, 1, 10), (5, True, 3, 7)])
def test_nearest_equals_brute_force(spark, hash_size, by, k, block):
    left, right, l, r = sides(spark, hash_size, 3, 60, 150, hash_size * 10 + k)
    if not by:
        left, l, r = sorted({(0, h) for _, h in left}), l.select("l_words").distinct(), r.drop("g")
    got = similarity.nearest(l, r, ("g",) if by else (), ("o", "path"), hash_size, k, block)
    rows = [(*((x["g"],) if by else ()), tuple(x["l_words"]), tuple(x["r_words"]), x["o"], x["path"], x["hamming"]) for x in got.collect()]
    assert sorted(rows) == brute(left, right, k, hash_size, by)


def test_the_grid_holds_only_what_is_left(spark, monkeypatch):
    """Hashes with a near one are done by bands."""
    rng, seen = random.Random(3), []
    right = [rng.getrandbits(64) for _ in range(3000)]
    left = [near(rng, 64, h) for h in right[:200]]
    grid = similarity._grid
    monkeypatch.setattr(similarity, "_grid", lambda l, *args, **more: seen.append(l.count()) or grid(l, *args, **more))
    l = spark.createDataFrame([(words(h, 2),) for h in set(left)], "l_words array<bigint>")
    r = spark.createDataFrame([(words(h, 2), str(k)) for k, h in enumerate(right)], "r_words array<bigint>, path string")
    got = {tuple(x["l_words"]): x["hamming"] for x in similarity.nearest(l, r, (), ("path",), 8, 1, block=50).collect()}
    want = {tuple(words(h, 2)): min((h ^ x).bit_count() for x in right) for h in left}
    assert got == want and len(seen) == 1 and 0 < seen[0] <= sum(d > 4 for d in want.values())


def test_steps_are_rows_not_columns(spark, monkeypatch):
    """The plan of a step that turns two bits of each band is as large as that of one that turns none."""
    rng, plans, seen = random.Random(5), [], []
    right = [rng.getrandbits(64) for _ in range(3000)]
    left = sorted({near(rng, 64, h) for h in right[:200]})
    monkeypatch.setattr(similarity, "JOINED", 4, raising=False)
    stored, grid = similarity.stored, similarity._grid
    plan = lambda df: len(df._jdf.queryExecution().analyzed().toJSON())
    monkeypatch.setattr(similarity, "stored", lambda df, name: (plans.append(plan(df)) if name == "nearest" else None) or stored(df, name))
    monkeypatch.setattr(similarity, "_grid", lambda l, *args, **more: seen.append(l.count()) or grid(l, *args, **more))
    l = spark.createDataFrame([(words(h, 2),) for h in left], "l_words array<bigint>")
    r = spark.createDataFrame([(words(h, 2), str(k)) for k, h in enumerate(right)], "r_words array<bigint>, path string")
    got = {tuple(x["l_words"]): x["hamming"] for x in similarity.nearest(l, r, (), ("path",), 8, 1, block=50).collect()}
    want = {tuple(words(h, 2)): min((h ^ x).bit_count() for x in right) for h in left}
    assert got == want and len(plans) == 3 and max(plans) < 3 * plans[0]
    assert len(seen) == 1 and 0 < seen[0] <= sum(d > 14 for d in want.values())


@pytest.mark.parametrize("hash_size, by, k", [(8, True, 1), (8, False, 3), (4, False, 2), (16, True, 2), (5, True, 3)])
def test_steps_equal_brute_force(spark, monkeypatch, hash_size, by, k):
    """As many steps as there are, whatever they cost."""
    monkeypatch.setattr(similarity, "JOINED", 0, raising=False)
    left, right, l, r = sides(spark, hash_size, 2, 30, 90, hash_size + k)
    if not by:
        left, l, r = sorted({(0, h) for _, h in left}), l.select("l_words").distinct(), r.drop("g")
    got = similarity.nearest(l, r, ("g",) if by else (), ("o", "path"), hash_size, k, 5)
    rows = [(*((x["g"],) if by else ()), tuple(x["l_words"]), tuple(x["r_words"]), x["o"], x["path"], x["hamming"]) for x in got.collect()]
    assert sorted(rows) == brute(left, right, k, hash_size, by)


@pytest.mark.parametrize("n, k", [(7, 7), (300, 3), (300, 299), (600, 400)])
def test_least_of_rows(n, k):
    """Distances above 255, too; of equal ones the first columns."""
    rng = np.random.default_rng(n + k)
    d = rng.integers(0, 20, (9, n)).astype(np.uint16) * 14
    want = np.argsort(d, axis=1, kind="stable")[:, :k]
    j, least = similarity._first_of(d.copy(), k)
    assert (np.sort(j, 1) == np.sort(want, 1)).all() and (least == np.take_along_axis(d, j, 1)).all()


def test_nearest_of_empty_sides(spark):
    l = spark.createDataFrame([([1, 2],)], "l_words array<bigint>")
    r = spark.createDataFrame([], "r_words array<bigint>, path string")
    assert similarity.nearest(l, r, (), ("path",), 8, 1, block=1).count() == 0
    assert similarity.nearest(l.limit(0), r, (), ("path",), 8, 1).count() == 0


@pytest.mark.parametrize("many", [1, 2, 3, 5, 8, 11])
def test_bands_as_numbers(spark, many):
    values = [random.Random(k).getrandbits(100) for k in range(20)]
    df = spark.createDataFrame([(words(v, 4),) for v in values], "w array<bigint>")
    cut = hashing.band_numbers(F.col("w"), many, 10)
    if max(width for _, width in cut) > 62:
        return
    rows = df.select("w", *(c.alias(f"b{k}") for k, (c, _) in enumerate(cut))).collect()
    for r in rows:
        value, shift = sum(x << (32 * k) for k, x in enumerate(r["w"])), 0
        for k, (_, width) in enumerate(cut):
            assert r[f"b{k}"] == value >> shift & ((1 << width) - 1)
            shift += width


PIXELS = "rel_path string, width int, height int, channels int, data binary"


def images(spark, n_low, seed=1):
    rng = random.Random(seed)
    made = lambda name, w, h, c: (name, w, h, c, bytearray(rng.randbytes(w * h * c)))
    return spark.createDataFrame([*(made(f"low{k}", rng.choice((4, 5)), 4, rng.choice((1, 3, 4))) for k in range(n_low)), made("high0", 8, 8, 3), made("high1", 6, 9, 1)], PIXELS)


@pytest.mark.parametrize("most", [1, 10, 64])
def test_sliced_differences_equal_those_of_pairs(spark, most):
    """One high has nearly all matches; one side of some pairs can't be read."""
    pixels = images(spark, 150)
    pairs = [(f"low{k}", "high0", k) for k in range(150)] + [(f"low{k}", "high1", k) for k in range(0, 150, 30)] + [("gone", "high0", 1), ("low1", "gone", 2)]
    matches = spark.createDataFrame(pairs, "low_path string, high_path string, hamming int")
    want = {(r["low_path"], r["high_path"]): r["diff"] for r in imaging.diff_pairs(similarity.with_pixels(matches, pixels)).collect()}
    got = verify.measured(matches, pixels, most)
    assert got.columns == ["low_path", "high_path", "hamming", "diff"]
    assert {(r["low_path"], r["high_path"]): r["diff"] for r in got.collect()} == want and len(want) == 155
    dealt, slices = verify.sliced(matches, most)
    sizes = [r["count"] for r in dealt.groupBy("high_path", "__slice").count().collect()]
    assert max(sizes) <= 3 * most + 5 and slices.filter("high_path = 'high0'").count() == -(-151 // most)
