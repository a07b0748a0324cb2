"""The stream of a folder's listings: new files, files dumped again, restarts, and batches that come again."""

import json
import os

from rastercat.sources import snapshots
from rastercat.streaming.folder_listing import _Reader, stream_listing
from rastercat.streaming.incremental import stream_refresh


def put(root, name, data=b"x", ns=10**18):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    os.utime(path, ns=(ns, ns))


def run(spark, root, state, checkpoint, seen):
    rows = lambda batch, _: seen.append(sorted((r["rel_path"], r["mtime_ns"], r["size"]) for r in batch.collect()))
    query = stream_listing(spark, root, state).writeStream.foreachBatch(rows).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_changed_files_come_again_and_restarts_go_on(spark, tmp_path):
    root, state, checkpoint = (str(tmp_path / n) for n in ("in", "state", "checkpoint"))
    seen = []
    put(root, "a.png")
    put(root, "one/two/b.png", b"bb")
    put(root, ".hidden/c.png")
    run(spark, root, state, checkpoint, seen)
    put(root, "one/two/b.png", b"bbb", 10**18 + 1)
    put(root, "new/d.png", b"d", 5)  # old, but not seen before
    run(spark, root, state, checkpoint, seen)
    run(spark, root, state, checkpoint, seen)
    os.unlink(os.path.join(root, "a.png"))
    run(spark, root, state, checkpoint, seen)
    put(root, "a.png")
    run(spark, root, state, checkpoint, seen)
    assert seen[:2] == [[("a.png", 10**18, 1), ("one/two/b.png", 10**18, 2)], [("new/d.png", 5, 1), ("one/two/b.png", 10**18 + 1, 3)]]
    assert [x for x in seen[2:] if x] == [[("a.png", 10**18, 1)]]
    assert all(len(os.listdir(os.path.join(state, "listings", d))) <= 3 for d in os.listdir(os.path.join(state, "listings")))


def test_a_batch_that_comes_again_is_the_same(tmp_path):
    """What changes after a batch was read first waits for the next one."""
    root, state = str(tmp_path / "in"), str(tmp_path / "state")
    put(root, "one/a.png")
    reader = _Reader(root, state)
    first = reader.latestOffset()
    read = lambda start, end: sorted(r for p in _Reader(root, state).partitions(start, end) for r in _Reader(root, state).read(p))
    start = reader.initialOffset()
    assert read(start, first) == [("one/a.png", 10**18, 1)]
    put(root, "one/a.png", b"later", 10**18 + 7)
    put(root, "two/b.png")
    assert read(start, first) == [("one/a.png", 10**18, 1)]
    second = reader.latestOffset()
    assert read(first, second) == [("one/a.png", 10**18 + 7, 5), ("two/b.png", 10**18, 1)]
    reader.commit(second)
    assert os.listdir(os.path.join(state, "listings/one")) == [f"{second['ns']}.arrow"] and json.loads(open(os.path.join(state, f"plans/{second['ns']}.json")).read()) == ["_root", "one", "two"]
    assert read(second, reader.latestOffset()) == []


def test_an_empty_and_a_missing_folder(spark, tmp_path):
    seen = []
    run(spark, str(tmp_path / "missing"), str(tmp_path / "state"), str(tmp_path / "checkpoint"), seen)
    assert not [x for x in seen if x]


def test_a_folder_refreshes_snapshots(spark, tmp_path):
    """From files to snapshots: listings as a stream, contents opened in tasks."""
    from pyspark.sql import functions as F

    from rastercat.sources import listing

    root, state, mid, dst = (str(tmp_path / n) for n in ("in", "state", "mid", "dst"))
    put(root, "d/t-1-x.png", b"base")
    put(root, "d/t-1-x-mip1.png", b"mip")
    contents = lambda files: listing.with_contents(files, root).drop("message")
    same = lambda rows: rows.select("rel_path", "content", F.lit(None).cast("string").alias("message"))
    go = lambda: stream_refresh(stream_listing(spark, root, state), contents, mid, dst, same, str(tmp_path / "checkpoint")).awaitTermination()
    rows = lambda: {r["rel_path"]: bytes(r["content"]) for r in snapshots.read_snapshot(spark, mid).collect()}
    go()
    assert rows() == {"d/t-1-x.png": b"base", "d/t-1-x-mip1.png": b"base"}
    put(root, "d/t-1-x.png", b"newer", 10**18 + 10**9)
    go()
    assert rows() == {"d/t-1-x.png": b"newer", "d/t-1-x-mip1.png": b"newer"}
