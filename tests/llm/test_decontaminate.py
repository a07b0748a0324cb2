import re

import pytest

from rastercat.llm import decontaminate as op
from tests.llm.helpers import documents, odd_rows, sha

TEXTS = odd_rows()
PASSAGE = " ".join(TEXTS[14][1].split()[35:55])
ITEMS = [(1, PASSAGE), (2, "One"), (3, None), (4, "--- !!"), (5, "Mail, a B"), (6, PASSAGE.upper()), (None, "é ü é ü é ü é ü é ü é"), (7, "absent words here")]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    out = []
    for i, t, *_ in rows:
        own, hit, named = words(t), set(), set()
        for item, text in items:
            w = words(text)
            n = min(10, len(w))
            grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            for k in range(len(own) - n + 1) if n else ():
                if tuple(own[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    named.add("null" if item is None else str(item))
        out.append((i, len(own), len(hit), tuple(sorted(named))))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_hits_equal_brute_force(spark, size):
    """In one slice of the benchmark, and in several."""
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in op.hits(documents(spark), benchmark, slice_bytes=size).collect()), key=str)
    assert got == brute(TEXTS, ITEMS)


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_documents_are_removed(spark, size):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = op.cleaned(documents(spark), benchmark, slice_bytes=size)
    assert out.columns == documents(spark).columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, _, n, _ in brute(TEXTS, ITEMS) if not n)


def test_spans_are_cut(spark):
    docs = documents(spark, [(1, "Äh one TWO three, four! five", *[None] * 6), (2, "clean", *[None] * 6)])
    benchmark = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in op.cleaned(docs, benchmark, remove="spans").collect()}
    assert got == {1: "Äh one , four! five", 2: "clean"}


@pytest.mark.parametrize("size", [1 << 20, 100, 25])
def test_spans_of_all_slices_are_cut_at_once(spark, size):
    """Items whose windows overlap, touch, or occur only after a cut, in one slice and in several."""
    text = " ".join(f"w{k}" for k in range(40))
    items = [" ".join(f"w{k}" for k in range(a, a + 10)) for a in (5, 10, 20)] + ["w4 w30 " + " ".join(f"w{k}" for k in range(31, 39))]
    docs = documents(spark, [(1, text, *[None] * 6), (1, text, *[None] * 6), (2, "clean", *[None] * 6), (3, None, *[None] * 6)])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in op.cleaned(docs, benchmark, remove="spans", slice_bytes=size).collect() if r["doc_id"] != 3)
    kept = "w0 w1 w2 w3 w4  " + " ".join(f"w{k}" for k in range(30, 40))
    assert got == [(1, kept), (1, kept), (2, "clean")]


@pytest.mark.parametrize("limit", [30, 200])
def test_pieces_of_long_items_have_all_windows(spark, limit):
    text = " ".join(f"w{k}x{'y' * (k % 5)}" for k in range(60))
    grams = lambda w: {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    pieces = op._pieces(spark.createDataFrame([(1, text)], "item_id long, text string"), 10, limit).collect()
    assert len(pieces) > 1 and set().union(*(grams(words(r["text"].decode())) for r in pieces)) == grams(words(text))
    docs = documents(spark, [(1, "a " + text + " b", *[None] * 6)])
    found = op.hits(docs, spark.createDataFrame([(1, text)], "item_id long, text string"), slice_bytes=limit).first()
    assert (found["n_words"], found["n_hit"], found["items"]) == (62, 60, ["1"])


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert op.hits(documents(spark, []), benchmark).count() == 0
    assert {r["n_hit"] for r in op.hits(documents(spark), benchmark).collect()} == {0}
    assert op.cleaned(documents(spark), benchmark).count() == len(TEXTS)


def test_digest_of_no_items():
    assert sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
