import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rastercat.llm import merkle as op
from tests.llm.helpers import documents, odd_rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    parts = [row[0], row[3], row[2], row[4], text]
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def tree(nodes, fanout):
    """(root, for each node its [(left, right)])."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for k, i in enumerate(at):
            run = runs[i // fanout]
            ways[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            at[k] = i // fanout
        level = [sha("".join(run)) for run in runs]
    return level[0], ways


def brute(rows, fanout=3):
    sources = {}
    for r in rows:
        touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        forged = leaf(r, r[1].replace("\n", "")) if touched else None
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), forged or "", r[0]))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(sources[name])
        trees.append((own, *tree([x[2] for x in own], fanout)))
    root, tops = tree([t[1] for t in trees], fanout)
    out = []
    for (own, subroot, ways), top in zip(trees, tops, strict=True):
        for x, way in zip(own, ways, strict=True):
            value = x[3] or x[2]
            for a, b in way + top:
                value = sha(a + value + b)
            out.append((x[4], x[2], subroot, root, sha("".join(a + b for a, b in way + top)), value, value == root))
    return sorted(out, key=str)


def found(docs, **options):
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without = op.leaf(*(F.col(c) if c != "text" else F.translate("text", "\n", "") for c in op.COLUMNS))
    forged = F.when(touched & F.col("text").isNotNull(), without)
    return sorted((tuple(r) for r in op.proofs(op.build(docs, forged, **options)).collect()), key=str)


@pytest.mark.parametrize("fanout, steps", [(3, 6), (3, 1), (3, 2), (2, 1), (5, 2)])
def test_proofs_equal_brute_force(spark, fanout, steps):
    """Blocks of a few places make many rounds; one source has a third of all rows."""
    rows = odd_rows() + [(100 + i, f"line {i}\nnext", "en", "hot", i, "k", "z", "d") for i in range(30)]
    assert found(documents(spark, rows), fanout=fanout, steps=steps) == brute(rows, fanout)


def test_many_small_sources(spark):
    rows = [(i, f"t\n{i % 3}", None, f"s{i // 2}", None, "k", "z", "d") for i in range(60)]
    assert found(documents(spark, rows), steps=1) == brute(rows)


def test_one_document_is_its_own_root(spark):
    row = (4, "x\ny", "en", None, 3, "k", "z", "d")
    got = found(documents(spark, [row]))
    assert got == brute([row]) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_only_changed_rows_fail(spark):
    rows = [(i, "a\nb" if i % 2 else "ab", "en", "s", 3, "k", "z", "d") for i in range(40)]
    for doc_id, *_, verified in found(documents(spark, rows)):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 2 == 1 or doc_id % 2 == 0)


def test_sources_and_empty_table(spark):
    made = op.build(documents(spark))
    assert {r["source"]: r["n"] for r in made.sources.collect()} == {s: sum(r[3] == s for r in odd_rows()) for s in {r[3] for r in odd_rows()}}
    empty = op.build(documents(spark, []))
    assert empty.root is None and op.proofs(empty).count() == 0


def test_ids_of_text_and_clashing_columns(spark):
    docs = documents(spark).withColumn("doc_id", F.concat(F.lit("é"), F.col("doc_id").cast("string")))
    docs = docs.select("*", *(F.lit("kept").alias(c) for c in ("tree", "place", "n", "part", "forged", "task", "line", "own_part", "block")))
    assert op.proofs(op.build(docs)).filter("verified").count() == docs.count()
