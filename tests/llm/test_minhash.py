import itertools
import random

import pytest

from rastercat.llm import minhash as op
from rastercat.llm.components import components
from tests.llm.helpers import documents, odd_rows, words


def sets(rows, n):
    out = []
    for i, t, *_ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
        out.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    return out


def brute(rows, n=2, percent=80):
    own = sets(rows, n)
    parent = {i: i for i, _ in own if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            (i, x), (j, y) = own[a], own[b]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in own), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [2, 5])
def test_odd_rows_equal_brute_force(spark, n):
    assert found(op.near_duplicates(documents(spark), words=n)) == brute(odd_rows(), n)


def group(seed=1, size=90):
    """Copies of one text with more and more words changed, so that many pairs lie about the threshold, and chains of copies."""
    rng = random.Random(seed)
    base = words(rng, 100).split()
    rows = []
    for i in range(size):
        own = (base if i % 3 else rows[-1][1].split() if rows else base)[:]
        for _ in range(rng.randrange(0, 12)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10_000)}"
        rows.append((i * 7 % 1000, " ".join(own)))
    return [(i, t, None, None, None, None, None, None) for i, t in rows]


@pytest.mark.parametrize("options", [{}, {"block": 300, "block_rows": 3}])
def test_copies_about_the_threshold(spark, options):
    rows = group()
    assert found(op.near_duplicates(documents(spark, rows), **options)) == brute(rows)


def test_pairs_just_above_the_threshold_are_found(spark):
    """Recall of the whole search at similarities of 0.80 to 0.82: 400 pairs that no other link joins."""
    rng, rows = random.Random(9), []
    for k in range(400):
        n = rng.randrange(101, 201)
        own = [f"p{k}x{i}" for i in range(n)]
        cut = (n - 1) * 2 // 10 - 1  # so many of n - 1 shingles are left out of the other text
        while 100 * (n - 1 - cut) < 80 * (n - 1):
            cut -= 1
        assert 0.8 <= (n - 1 - cut) / (n - 1) <= 0.83
        rows += [(2 * k, " ".join(own), *[None] * 6), (2 * k + 1, " ".join(own[cut:]), *[None] * 6)]
    got = op.near_duplicates(documents(spark, rows), block=20_000).filter("component_id <> doc_id").count()
    assert got == 400


def test_pairs_in_crowded_buckets_are_found(spark):
    """Recall where it is at stake: 300 pairs at 0.80 to 0.82 among texts that share half of their shingles with all the others.

    Most buckets then hold dozens of members that are no near copies, and their hub is far from both of a pair, so a
    pair is found by blocks and the signature screen alone.
    """
    rng, rows, common = random.Random(11), [], [f"c{i}" for i in range(100)]
    shingles = lambda words: set(itertools.pairwise(words))
    for k in range(300):
        for own in range(rng.randrange(14, 20), 0, -1):
            shared = common + [f"p{k}x{i}" for i in range(31)]
            a, b = ([*shared, *(f"{side}{k}x{i}" for i in range(own))] for side in "ab")
            sim = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
            if sim >= 0.8:
                break
        assert 0.8 <= sim <= 0.83
        rows += [(2 * k, " ".join(a), *[None] * 6), (2 * k + 1, " ".join(b), *[None] * 6)]
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(documents(spark, rows), block=20_000, block_rows=64).collect()}
    assert got == {d: d - d % 2 for d in range(600)}


def test_ids_of_text(spark):
    rows = [("b", "one two three"), ("a", "one two three"), (None, "one two three"), ("c", "other words here"), ("b", "One two three")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id string, text string, __gone string, gone string")
    got = sorted(map(str, ((r["doc_id"], r["component_id"], r["kept"]) for r in op.near_duplicates(docs).collect())))
    assert got == sorted(map(str, [("a", "a", True), ("b", "a", False), ("b", "a", False), ("c", "c", True), (None, None, True)]))
    left = op.deduplicated(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["None", "a", "c"]


def test_deduplicated_keeps_one_of_a_component(spark):
    rows = group(2)
    out = op.deduplicated(documents(spark, rows))
    assert out.columns == documents(spark).columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _, _, kept in brute(rows) if kept)


def test_one_id_with_two_texts_is_one_node(spark):
    rng = random.Random(5)
    a, b = words(rng, 50), words(rng, 50)
    rows = [(9, a, *[None] * 6), (9, b, *[None] * 6), (3, a, *[None] * 6), (4, b, *[None] * 6)]
    assert {r["component_id"] for r in op.near_duplicates(documents(spark, rows)).collect()} == {3}


def test_empty_table(spark):
    assert op.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
