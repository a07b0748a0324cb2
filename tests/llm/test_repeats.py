import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rastercat.llm import repeats as op
from tests.llm.helpers import documents, odd_rows, words


def brute(rows, window):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = {}
    for _, b in texts:
        for p in range(len(b) - window + 1):
            seen[b[p : p + window]] = seen.get(b[p : p + window], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_odd_rows_equal_brute_force(spark, hot):
    """Also with every anchor taken for a hot one."""
    rows = [r for r in odd_rows() if len(r[1] or "") < 5000]
    assert found(op.without_repeats(documents(spark, rows), hot=hot)) == brute(rows, 200)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_passages_runs_and_edges(spark, hot):
    rng = random.Random(11)
    p = words(rng, 80)
    texts = ["a" * 350, "ab" * 200, p[:199], p[:200], "x" + p[:200], p[1:230] + "q", p[30:260], p[30:231] + "zz" + p[150:400], words(rng, 100), p + p[40:300], "é" * 150, "é" * 99 + "x" + "é" * 100]
    rows = [(i, t, *[None] * 6) for i, t in enumerate(texts)]
    assert found(op.without_repeats(documents(spark, rows), hot=hot)) == brute(rows, 200)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    shared = rng.integers(97, 100, 260).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 100, k).astype(np.uint8), shared, rng.integers(97, 100, 50).astype(np.uint8)]) for k in (10, 333))
    at_a, at_b = (set((op.anchors(x, np.array([0, len(x)]))[0] - k).tolist()) for x, k in ((a, 10), (b, 333)))
    for start in range(61):
        assert {p for p in at_a & at_b if start <= p <= start + 200 - op.GRAM}


def test_radix_order():
    rng = np.random.default_rng(1)
    for _ in range(20):
        rows = rng.integers(97, 99, (rng.integers(1, 60), 20)).astype(np.uint8)
        assert [bytes(x) for x in rows[op.radix_order(rows)]] == sorted(bytes(x) for x in rows)


def test_colliding_anchor_hashes_are_told_apart_by_bytes():
    """Two hash values for all anchors: only equal bytes count."""
    window, gram = 24, 4
    reach, rng = window - gram, np.random.default_rng(2)
    for trial in range(40):
        base = rng.integers(97, 99, 3 * reach + gram).astype(np.uint8)
        contexts, place = [], []
        for _ in range(int(rng.integers(2, 40))):
            left, right = (int(rng.integers(0, reach + 1)) if trial % k else reach for k in (2, 3))
            own = base.copy()
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(0, len(own))] ^= 1
            contexts.append(own[reach - left : reach + gram + right].tobytes())
            place.append((100 << 16) | (left << 8) | right)
        h = rng.integers(0, 2, len(place)).astype(np.int64)
        most, least = op.repeated_windows(h, np.array(place), pa.array(contexts, pa.binary()), window, gram)
        cut = lambda i, size: contexts[i][(place[i] >> 8 & 255) - size :][:window] if (place[i] >> 8 & 255) >= size and (place[i] & 255) >= reach - size else None
        for i in range(len(place)):
            hits = [size for size in range(reach + 1) if (w := cut(i, size)) and any(cut(j, size) == w for j in range(len(place)) if j != i and h[j] == h[i])]
            assert (most[i], least[i]) == ((max(hits), min(hits)) if hits else (-1, reach + 1))


def test_empty_table(spark):
    assert op.without_repeats(documents(spark, [])).count() == 0


def test_long_texts_of_one_byte_and_long_copies(spark):
    """Ranges of one text are merged in linear time, whatever their number."""
    copy = words(random.Random(5), 400_000, 10**6)
    rows = [(1, "a" * 1_000_000), (2, copy), (3, copy + "x"), (4, "b" * 199)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in op.without_repeats(df).collect()}
    n = len(copy)
    assert got == {1: (1_000_000, 1_000_000, 1), 2: (n, n, 1), 3: (n + 1, n, 1), 4: (199, 0, 0)}


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(1, 9)), max_size=40))
def test_islands_equal_covered_places(spark, ranges):
    df = spark.createDataFrame([(t, -t, a, a + n) for t, a, n in ranges] + [(9, 9, 1, 2)] * 3, "t1 long, t2 long, first long, end long")
    got = {r["t1"]: [(x >> 32, x & 0xFFFFFFFF) for x in r["ranges"]] for r in op._islands(df).collect()}
    for t in {t for t, *_ in ranges}:
        covered = sorted({k for u, a, n in ranges if u == t for k in range(a, a + n)})
        runs = [[k, k + 1] for i, k in enumerate(covered) if not i or covered[i - 1] != k - 1]
        for run in runs:
            while run[1] in covered:
                run[1] += 1
        assert got[t] == [tuple(r) for r in runs]
