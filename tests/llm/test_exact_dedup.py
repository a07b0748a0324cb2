import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastercat.llm import exact_dedup as op
from tests.llm.helpers import documents, odd_rows


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    best = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    out = []
    for i, t, *_ in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out.append((i, best[k][2], len(groups[k]), i == best[k][2]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


@pytest.mark.parametrize("digest", [op.sha256, lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))])
def test_groups_equal_brute_force(spark, digest):
    """Also with a digest of 4 bits, under which different texts share buckets."""
    assert found(op.duplicate_groups(documents(spark), digest=digest)) == brute(odd_rows())


def test_small_shards_and_shuffled_byte_checks(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST", 0)
    assert found(op.duplicate_groups(documents(spark), shard=3)) == brute(odd_rows())


@pytest.mark.parametrize("side", ["true", "false"])
def test_all_in_one_part(spark, side):
    assert found(op.duplicate_groups(documents(spark), in_snapshot=F.expr(side))) == brute(odd_rows())


def test_deduplicated_keeps_one_row_and_all_columns(spark):
    out = op.deduplicated(documents(spark))
    assert out.columns == documents(spark).columns
    kept = {(i, k) for i, k, _, same in brute(odd_rows()) if same}
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, _ in kept)


def test_empty_table(spark):
    assert op.duplicate_groups(documents(spark, [])).count() == 0
    assert op.deduplicated(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_filters_have_all_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    fuse = op.BinaryFuse.build(np.concatenate([keys, keys[:1]]))
    assert fuse.has(keys).all() and int(keys[0]) in fuse
    assert fuse.has(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.02


def screened_brute(old, new):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rank = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    best = lambda rows, t: min((r for r in rows if norm(r[1]) == t), key=rank, default=None)
    out = []
    for r in new:
        there, first = best(old, norm(r[1])), best(new, norm(r[1]))
        out.append((r[0], there[0] if there else first[0], sum(norm(x[1]) == norm(r[1]) for x in new), not there and r[0] == first[0], bool(there)))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [op.sha256, lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))])
@pytest.mark.parametrize("cut", [0, 12, 20, 100])
def test_batches_against_a_snapshot(spark, tmp_path, digest, cut):
    """Also an empty snapshot and an empty batch, and digests of 4 bits."""
    old, new = odd_rows()[:cut], odd_rows()[cut:] + odd_rows()[3 : 8 if cut < 100 else 3]
    op.build_snapshot(documents(spark, old), str(tmp_path / "s"), digest, buckets=8, shard=4)
    got = op.screen_batch(documents(spark, new), str(tmp_path / "s"), digest)
    assert sorted((tuple(r) for r in got.collect()), key=str) == screened_brute(old, new)


def test_a_batch_opens_only_buckets_of_positives(spark, tmp_path):
    """All other buckets are taken away; without positives, all of them."""
    old = [(i, f"text number {i}", *[None] * 6) for i in range(400)]
    op.build_snapshot(documents(spark, old), str(tmp_path / "s"), buckets=64)
    new = [(900, "text number 7", *[None] * 6), *((1000 + i, f"new text {i}", *[None] * 6) for i in range(5))]
    bucket = spark.createDataFrame([("textnumber7",)], "t string").select(F.pmod(F.xxhash64(op.sha256(F.col("t"))), F.lit(64))).first()[0]
    filters = spark.read.parquet(str(tmp_path / "s/filters")).drop("shards", "buckets")
    keys = spark.createDataFrame([(re.sub(" ", "", r[1]),) for r in new], "t string").select(F.xxhash64(op.sha256(F.col("t"))).alias("key"))
    through = {r["key"] % 64 for r in op.screened(keys, filters, 1).collect()}
    assert bucket in through and len(through) <= 3
    for folder in (tmp_path / "s/buckets").glob("bucket=*"):
        if int(folder.name.split("=")[1]) not in through:
            folder.rename(tmp_path / folder.name)
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["in_snapshot"]) for r in op.screen_batch(documents(spark, new), str(tmp_path / "s")).collect()}
    assert got == {900: (7, False, True)} | {1000 + i: (1000 + i, True, False) for i in range(5)}
