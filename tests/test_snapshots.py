"""Snapshots as logs of changes: what is written, merged, compacted and dropped, and writers that meet."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rastercat.functions import paths
from rastercat.jobs.consolidate import consolidate_variants
from rastercat.jobs.refresh import GROUPS, HASHES, refresh
from rastercat.sources import snapshots
from rastercat.streaming.incremental import LISTING, stream_refresh

CONTENTS = "rel_path string, mtime_ns bigint, content binary"


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKETS", 8)


def contents(spark, rows):
    return spark.createDataFrame([(p, t, bytearray(c)) for p, t, c in rows], CONTENTS)


def found(spark, root, version=None):
    return {r["rel_path"]: (r["mtime_ns"], r["size"], bytes(r["content"])) for r in snapshots.read_snapshot(spark, root, version).collect()}


def many(spark, n, time=1):
    return spark.range(n).select(F.concat(F.lit("p/"), "id").alias("rel_path"), F.lit(time).cast("bigint").alias("mtime_ns"), F.lit(1).cast("bigint").alias("size"), F.encode(F.lit("x"), "utf-8").alias("content"))


def written(root):
    """Bytes of data folders, newest last."""
    folders = sorted((Path(root) / "data").iterdir(), key=lambda p: p.stat().st_mtime_ns)
    return [sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in folders]


def test_a_change_of_ten_rows_writes_ten_rows(spark, tmp_path):
    root = str(tmp_path)
    snapshots.write_version(many(spark, 20_000), root)
    snapshots.write_changes(contents(spark, [(f"p/{k}", 2, b"yy") for k in range(10)]), root)
    parts = snapshots.state(spark, root)["parts"]
    assert [p["rows"] for p in parts] == [20_000, 10]
    got = found(spark, root)
    assert len(got) == 20_000 and got["p/3"] == (2, 2, b"yy") and got["p/10"] == (1, 1, b"x")
    assert len(found(spark, root, 0)) == 20_000 and found(spark, root, 0)["p/3"] == (1, 1, b"x")


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_newest_row_counts_and_paths_go(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(snapshots, "BROADCAST", broadcast)
    root, want = str(tmp_path), {}
    for step in range(6):
        rows = [(f"f{k}", step, bytes([step, k])) for k in range(step, 10, step + 1)]
        gone = [f"f{k}" for k in range(10) if k % 4 == step]
        snapshots.write_changes(contents(spark, [*rows, *[(p, t - 1, b"older") for p, t, _ in rows[:2]]]), root, gone=spark.createDataFrame([(p,) for p in gone], "rel_path string") if gone else None)
        want = {p: v for p, v in want.items() if p not in gone} | {p: (t, 2, c) for p, t, c in rows}
        assert found(spark, root) == want
    assert {r["rel_path"]: r["size"] for r in snapshots.snapshot_catalog(spark, root).collect()} == {p: 2 for p in want}
    assert snapshots.compact(spark, root, share=0.0) == 6 and found(spark, root) == want
    assert snapshots.compact(spark, root) is None
    snapshots.write_changes(contents(spark, [("f1", 99, b"new")]), root)
    assert found(spark, root) == want | {"f1": (99, 3, b"new")}
    snapshots.drop_old_versions(spark, root, keep=1)
    assert snapshots.versions(spark, root) == [7] and found(spark, root) == want | {"f1": (99, 3, b"new")}
    assert {p["folder"] for p in snapshots.state(spark, root)["parts"]} == {f"data/{p.name}" for p in (tmp_path / "data").iterdir()}


def test_compaction_rewrites_only_buckets_that_are_due(spark, tmp_path):
    root = str(tmp_path)
    snapshots.write_version(many(spark, 640), root)
    bucket = {r[0]: r[1] for r in many(spark, 640).select("rel_path", snapshots.bucket_of(F.col("rel_path"), snapshots.BUCKETS)).collect()}
    some = sorted(p for p, b in bucket.items() if b in (3, 5))
    snapshots.write_changes(contents(spark, [(p, 7, b"seven") for p in some]), root)
    before = found(spark, root)
    snapshots.compact(spark, root)
    parts = snapshots.state(spark, root)["parts"]
    assert [sorted(p["buckets"]) for p in parts] == [[b for b in range(8) if b not in (3, 5)], [3, 5]] and parts[1]["rows"] == len(some)
    assert found(spark, root) == before
    snapshots.write_changes(contents(spark, [(some[0], 8, b"eight")]), root)
    assert found(spark, root) == before | {some[0]: (8, 5, b"eight")}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Each version has one writer, and the last version has the changes of all."""
    root, out = str(tmp_path), []
    write = lambda k: out.append(snapshots.write_changes(contents(spark, [(f"w{k}", k, b"w"), ("all", k, bytes([k]))]), root))
    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(out) == list(range(8)) == snapshots.versions(spark, root)
    got = found(spark, root)
    assert set(got) == {"all", *(f"w{k}" for k in range(8))}


def test_writers_that_depend_on_a_version_conflict(spark, tmp_path):
    root = str(tmp_path)
    first = snapshots.write_changes(contents(spark, [("a", 1, b"a")]), root)
    snapshots.write_changes(contents(spark, [("b", 1, b"b")]), root, after=first)
    with pytest.raises(snapshots.Conflict):
        snapshots.write_changes(contents(spark, [("a", 2, b"c")]), root, after=first)
    assert set(found(spark, root)) == {"a", "b"}
    assert not snapshots._created(spark, root, "log/000000000001.json", "{}")  # as the loser of two sees it


def test_a_batch_is_committed_once(spark, tmp_path):
    root = str(tmp_path)
    table = lambda n: {"t": spark.createDataFrame([(n,)], "n int")}
    one = snapshots.write_changes(contents(spark, [("a", 1, b"a")]), root, tables=table(1), batch=("s", 4))
    again = snapshots.write_changes(contents(spark, [("a", 9, b"z")]), root, tables=table(2), batch=("s", 4))
    assert one == again == 0 and found(spark, root)["a"][0] == 1 and snapshots.read_table(spark, root, "t").first()[0] == 1
    assert len(list((tmp_path / "data").iterdir())) == len(list((tmp_path / "state").iterdir())) == 1
    assert snapshots.write_changes(contents(spark, []), root, tables=table(3), batch=("s", 5)) == 1
    assert snapshots.write_changes(contents(spark, [("b", 1, b"b")]), root, batch=("other", 0)) == 2
    assert snapshots.read_table(spark, root, "t").first()[0] == 3 and snapshots.read_table(spark, root, "t", 0).first()[0] == 1
    assert snapshots.write_changes(contents(spark, []), root) == 2  # nothing to write


def files(spark, rows):
    df = spark.createDataFrame([(p, t, len(c), bytearray(c)) for p, t, c in rows], snapshots.SCHEMA)
    return paths.with_path_parts(df).select("rel_path", "dir", "name", "stem", "ext", "mtime_ns", "size", "content")


def same(rows):
    return rows.select("rel_path", "content", F.lit(None).cast("string").alias("message"))


def test_second_run_patches_only_groups_that_changed(spark, tmp_path):
    mid, dst = str(tmp_path / "mid"), str(tmp_path / "dst")
    src = files(spark, [(f"{g}-1-x{m}.png", 5, f"{g}{m}".encode()) for g in "abc" for m in ("", "-mip1", "-mip2")])
    one = refresh(src, mid, dst, same).summary.first()
    assert (one["new"], one["mips_patched"], one["groups_skipped"]) == (9, 6, 0)
    rows = [p["rows"] for p in snapshots.state(spark, mid)["parts"]]
    again = refresh(src, mid, dst, same).summary.first()
    assert (again["new"], again["updated"], again["mips_patched"], again["groups_skipped"], again["files_copied"]) == (0, 0, 0, 3, 0)
    assert [p["rows"] for p in snapshots.state(spark, mid)["parts"]] == rows  # nothing written
    three = refresh(files(spark, [("b-1-x.png", 9, b"new")]), mid, dst, same).summary.first()
    assert (three["updated"], three["mips_patched"], three["groups_skipped"]) == (1, 2, 2)
    assert [p["rows"] for p in snapshots.state(spark, mid)["parts"]][len(rows) :] == [1, 2]
    got = found(spark, mid)
    assert got["b-1-x-mip2.png"] == (5, 3, b"new") and got["a-1-x-mip2.png"] == (5, 1, b"a") and snapshots.read_table(spark, mid, GROUPS).count() == 3


def test_batches_carry_their_state(spark, tmp_path):
    """The second batch patches one group and hashes one image; a batch that is played again changes neither rows nor state."""
    source, mid, dst = (str(tmp_path / n) for n in ("listing", "mid", "dst"))
    seen, hashed = [], []

    def consolidate(rows, manifest=None):
        side = F.when(F.startswith("name", F.lit("l")), 512).otherwise(64)
        images = rows.withColumns({"width": side, "height": side, "bits": F.octet_length("content").cast("bigint")}).drop("content")

        def hashes(df, n):
            hashed.append(sorted(r["rel_path"] for r in df.collect()))
            return df.withColumns({"hash_words": F.array(F.col("bits"), F.lit(0).cast("bigint")), "hash_size": F.lit(n)}).drop("bits")

        return consolidate_variants(images, manifest=manifest, compute=hashes, threshold=0)

    contents_ = lambda listed: listed.withColumn("content", F.concat(F.lit("c"), "mtime_ns").cast("binary"))
    deliveries = ([("l-1-b.png", 5, 1), ("s-1-a.png", 5, 1), ("m-2-x.png", 5, 1), ("m-2-x-mip1.png", 5, 1), ("n-3-x.png", 5, 1), ("n-3-x-mip1.png", 5, 1)], [("m-2-x.png", 77, 1), ("s-1-c.png", 6, 1)])

    def run(checkpoint):
        listing = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(source)
        stream_refresh(listing, contents_, mid, dst, same, str(tmp_path / checkpoint), lambda r, _: seen.append(r.summary.first().asDict()), consolidate=consolidate).awaitTermination()

    for delivery in deliveries:
        spark.createDataFrame(delivery, LISTING).coalesce(1).write.mode("append").parquet(source)
        run("checkpoint")
    assert [(x["mips_patched"], x["groups_skipped"], x["ids_replaced"]) for x in seen] == [(2, 0, 1), (1, 1, 2)]
    assert hashed == [["l-1-b.png", "s-1-a.png"], ["s-1-c.png"]]
    now = snapshots.state(spark, mid)
    rows, states = found(spark, mid), {n: sorted(map(tuple, snapshots.read_table(spark, mid, n).collect()), key=str) for n in (GROUPS, HASHES)}
    assert now["batches"] == {str(tmp_path / "checkpoint"): 1} and rows["m-2-x-mip1.png"] == (5, 3, b"c77")
    # The last batch again, as after a failure before its commit was noted by the stream.
    for commit in (tmp_path / "checkpoint/commits").glob("*1*"):
        commit.unlink()
    run("checkpoint")
    assert found(spark, mid) == rows and snapshots.state(spark, mid)["tables"] == now["tables"] and len(seen) == 3
    assert {n: sorted(map(tuple, snapshots.read_table(spark, mid, n).collect()), key=str) for n in (GROUPS, HASHES)} == states
