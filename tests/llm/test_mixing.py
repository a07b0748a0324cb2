import random

import pytest

from rastercat.llm import mixing as op
from tests.llm.helpers import documents, odd_rows


def targets(sizes):
    """Shares by weight 5, 2, 1; what is above 3 times a source's size is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left, out = set(), float(sum(sizes.values())), {}
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        share = {s: left * weight[s] / rest for s in names if s not in full} if rest else {}
        over = [s for s, x in share.items() if x > 3 * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            full.add(s)
            out[s] = 3.0 * sizes[s]
            left -= out[s]


def size(text):
    return len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w])


def corpus(n=3000, seed=8):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.randrange(0, 60))), None, rng.choice(["b", "b", "b", "a", "c", None, "é"]), None, None, None, None) for i in range(n)]


def check(rows, plan):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    most = {s: max(size(r[1]) for r in rows if r[3] == s) for s in sizes}
    for p in plan:
        assert p["source_size"] == sizes[p["source"]] and abs(p["target"] - want[p["source"]]) < 1e-6 * (1 + want[p["source"]])
        assert p["taken"] == p["size"] * p["copies"] and 0 <= p["copies"] <= 3 and len(p["positions"]) == p["copies"]
        assert all(0 <= x <= 1 for x in p["positions"]) and p["positions"] == sorted(p["positions"])
        taken[p["source"]] += p["taken"] * p["n_rows"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] * 3


@pytest.mark.parametrize("bucket_rows", [4096, 20])
def test_targets_are_met(spark, bucket_rows):
    rows = corpus()
    got = op.plan(documents(spark, rows), bucket_rows=bucket_rows).collect()
    assert sum(p["n_rows"] for p in got) == len(rows)
    check(rows, got)
    again = op.plan(documents(spark, rows[::-1]).repartition(7), bucket_rows=bucket_rows).collect()
    assert {(p["doc_id"], p["taken"]) for p in got} == {(p["doc_id"], p["taken"]) for p in again}


def test_odd_rows(spark):
    rows = odd_rows()
    check([r for r in rows], op.plan(documents(spark)).collect())


def test_a_small_source_stops_at_three_times_its_size(spark):
    rows = [(i, "w " * 10, None, "big", None, None, None, None) for i in range(200)] + [(500 + i, "w " * 10, None, "a", None, None, None, None) for i in range(5)]
    got = {p["doc_id"]: p["copies"] for p in op.plan(documents(spark, rows)).collect()}
    assert [got[500 + i] for i in range(5)] == [3] * 5


@pytest.mark.parametrize("bucket_rows", [4096, 7])
def test_positions_invert_the_demand(spark, bucket_rows):
    """When a copy is due, the source's demand so far is the words of its copies before it."""
    rows = op.plan(documents(spark, corpus(400)), bucket_rows=bucket_rows).collect()
    for source in {p["source"] for p in rows}:
        own = [p for p in rows if p["source"] == source]
        tilt = {0: -0.5, 1: 0.0, 2: 0.5}[sorted({p["source"] for p in rows}, key=lambda s: (s is None, s or "")).index(source) % 3]
        total = 0
        for t, p in sorted(((t, p) for p in own for t in p["positions"]), key=lambda x: x[0]):
            due = p["target"] * (t + tilt * (t * t - t))
            assert abs(due - min(total, p["target"])) < 1e-6 * max(1, total)
            total += p["size"] * p["n_rows"]


def test_mixed_is_in_order_and_keeps_columns(spark):
    docs = documents(spark, corpus(300))
    out = op.mixed(docs)
    rows = out.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert out.columns[: len(docs.columns)] == docs.columns and "mix_size" in out.columns and {r["size"] for r in rows} == {r["size"] for r in docs.collect()} and all(r["copies"] > 0 for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)


def test_later_sources_come_later(spark):
    """A source whose weight rises over the run has a later mean position than one whose weight falls."""
    got = op.plan(documents(spark, corpus())).collect()
    mean = lambda s: sum(x for p in got if p["source"] == s for x in p["positions"]) / sum(p["copies"] for p in got if p["source"] == s)
    assert mean("a") < mean("b") < mean("c")


def test_empty_tables(spark):
    assert op.plan(documents(spark, [])).count() == 0
    nothing = op.plan(documents(spark, [(1, "", *[None] * 6), (2, None, *[None] * 6)])).collect()
    assert [(p["size"], p["target"], p["taken"]) for p in nothing] in ([(0, 0.0, 0)], [(0, 0.0, 0)] * 2)
