"""Real files: folders of small PNGs, manifests, reports, and the stream of listings."""

import json
import os
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from rastercat.functions import imaging, paths
from rastercat.jobs.audit import audit_similar, hashed_folder
from rastercat.jobs.consolidate import consolidate_variants
from rastercat.jobs.refresh import refresh
from rastercat.operators import similarity
from rastercat.sources import catalog, manifests, outputs, snapshots
from rastercat.streaming.incremental import LISTING, stream_incremental, stream_refresh


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKETS", 4)


def png(width, height, pixels, kind):
    """kind: 0 gray, 2 RGB, 4 gray and alpha, 6 RGBA."""
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    raw = b"".join(b"\0" + bytes(pixels[y * width * channels : (y + 1) * width * channels]) for y in range(height))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    (root / "sub").mkdir()
    files = {
        "a-1-x.png": png(4, 3, list(range(36)), 2), "sub/a-1-y.PNG": png(2, 2, [1, 2, 3, 0] * 4, 6), "a-1-g.png": png(2, 2, [5, 6, 7, 8], 0), "a-1-la.png": png(2, 2, [5, 0] * 4, 4),
        "a-1-bad.png": b"broken", "a-1-z.tga": b"junk", "note.txt": b"text", "flat-7-k.png": png(8, 8, [9] * 64, 0), "flat-7-m.png": png(16, 16, [9] * 256, 0), "flat-7-mip1.png": png(2, 2, [9] * 4, 0),
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    return str(root)


def test_scan_takes_any_case_and_depth(spark, folder):
    rows = {r["rel_path"]: r for r in catalog.scan_catalog(spark, folder).collect()}
    assert len(rows) == 9 and "sub/a-1-y.PNG" in rows and "note.txt" not in rows
    assert rows["sub/a-1-y.PNG"]["dir"] == "sub" and rows["a-1-x.png"]["mtime_ns"] > 10**18


def test_images_and_failures(spark, folder):
    images, failed = catalog.read_images(spark, folder)
    got = {r["rel_path"]: r for r in images.collect()}
    assert {r["rel_path"] for r in failed.collect()} == {"a-1-bad.png", "a-1-z.tga"}
    assert (got["a-1-x.png"]["width"], got["a-1-x.png"]["height"], got["a-1-x.png"]["channels"]) == (4, 3, 3)
    image = imaging.pixels(bytes(got["a-1-x.png"]["data"]), 3, 4, 3)
    assert imaging.rgb(image)[0, 0].tolist() == [0, 1, 2]
    alpha = imaging.pixels(bytes(got["sub/a-1-y.PNG"]["data"]), 2, 2, 4)
    assert imaging.rgb(alpha)[0, 0].tolist() == [1, 2, 3]


def test_png_dims_without_decoding(spark, folder):
    rows = {r["rel_path"]: (r["width"], r["height"]) for r in catalog.png_dims(catalog.scan_catalog(spark, folder, content=True)).collect()}
    assert rows["a-1-x.png"] == (4, 3) and rows["a-1-bad.png"] == (None, None)


def test_audit_and_consolidation_of_a_folder(spark, folder, tmp_path):
    images, _ = catalog.read_images(spark, folder)
    rows = hashed_folder(images)
    assert "flat-7-mip1.png" not in [r["rel_path"] for r in rows.collect()]
    found = audit_similar(rows, images, base_size=16, threshold=0, top_k=1)
    matches = {r["low_path"]: (r["high_path"], r["hamming"], r["diff"]) for r in found.matches.collect()}
    assert matches["flat-7-k.png"] == ("flat-7-m.png", 0, 0.0)
    assert {r["diff"] for r in found.top.filter("low_path = 'flat-7-k.png'").collect()} == {0.0}
    plan = consolidate_variants(images, small=16, large=16).plan
    assert [(r["dst_path"], r["src_path"], r["replaced"]) for r in plan.collect()] == [("flat-7-k.png", "flat-7-m.png", True)]
    outputs.write_matches_csv(found.matches.filter("low_path = 'flat-7-k.png'"), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text == "low_name,low_w,low_h,high_name,high_w,high_h,hamming,diff\nflat-7-k.png,8,8,flat-7-m.png,16,16,0,0.000\n"


def test_verification_drops_and_strict_lists(spark):
    schema = "rel_path string, dir string, name string, stem string, ext string, width int, height int, channels int, data binary"
    rows = [(n, "", n, n[:-4], ".png", s, s, 1, bytearray([v] * (s * s))) for n, s, v in (("low.png", 8, 0), ("high.png", 16, 200))]
    images = spark.createDataFrame(rows, schema)
    hashes = similarity.with_dims(imaging.hash_images(images))
    loose, strict = (audit_similar(hashes, images, base_size=16, top_k=1, strict=s) for s in (False, True))
    assert loose.matches.count() == 0 and loose.top.count() == 1 and strict.top.count() == 0
    pair = similarity.with_pixels(audit_similar(hashes, base_size=16).matches.drop("diff"), images)
    heat, panel = imaging.diff_heatmap(pair).first(), imaging.visual_panels(pair).first()
    assert set(bytes(heat["heat"])[::3]) == {200} and len(panel["panel"]) == panel["panel_width"] * panel["panel_height"] * 3


MIPS = {"d|t__|.png": {"base": "d\\t.png", "base_mtime_ns": 1, "base_size": 2, "mips": [{"path": "d\\t-mip1.png", "mtime_ns": 3}]}}


@pytest.mark.parametrize("text, n, has_mips", [
    (json.dumps({"version": 2, "groups": MIPS}), 1, True), (json.dumps({"version": 1, "groups": {"g": {"base": "b", "base_mtime_ns": 1, "base_size": 2, "mips": ["x"]}}}), 1, False),
    (json.dumps({"version": 3, "groups": MIPS}), 0, False), ("{broken", 0, False), ("[]", 0, False),
])
def test_mip_manifests(spark, tmp_path, text, n, has_mips):
    (tmp_path / ".mipcache.json").write_text(text)
    rows = manifests.read_mip_manifest(spark, str(tmp_path / ".mipcache.json")).collect()
    assert len(rows) == n
    if n:
        assert bool(rows[0]["mips"]) is has_mips
    if has_mips:
        assert rows[0]["base"] == "d/t.png" and rows[0]["mips"][0]["path"] == "d/t-mip1.png"


def test_hash_manifests(spark, tmp_path):
    path = tmp_path / ".idhashcache.json"
    path.write_text(json.dumps({"version": 1, "entries": {"a\\b.png": {"mtime_ns": 1, "size": 2, "hash": "ff", "hash_size": 8}}}))
    assert tuple(manifests.read_hash_manifest(spark, str(path)).first()) == ("a/b.png", 1, 2, "ff", 8)
    path.write_text(json.dumps({"version": 2, "entries": {}}))
    assert manifests.read_hash_manifest(spark, str(path)).count() == 0
    rows = spark.createDataFrame([("a", 1, 2, [255, 0], 8)], "rel_path string, mtime_ns bigint, size bigint, hash_words array<bigint>, hash_size int")
    manifests.write_hash_manifest(rows, str(tmp_path / "out"))
    assert tuple(spark.read.parquet(str(tmp_path / "out")).first()) == ("a", 1, 2, "ff", 8)


def test_missing_manifests_are_empty(spark, tmp_path):
    assert manifests.read_mip_manifest(spark, str(tmp_path / ".mipcache.json")).count() == 0
    assert manifests.read_hash_manifest(spark, str(tmp_path / "nothing.json")).count() == 0


def test_sync_to_snapshots_and_folders(spark, tmp_path):
    """A planned file takes the place of the row of its path; doing it twice changes nothing."""
    root = str(tmp_path / "table")
    contents = spark.createDataFrame([("a", 10**18, bytearray(b"A")), ("d/b", 10**18, bytearray(b"B"))], "rel_path string, mtime_ns bigint, content binary")
    plan = spark.createDataFrame([("a", "a", "mirror"), ("x/y", "d/b", "id_replace"), ("z", "gone", "mirror")], "dst_path string, src_path string, reason string")
    rows = lambda: sorted((r["rel_path"], r["mtime_ns"], r["size"], bytes(r["content"])) for r in snapshots.read_snapshot(spark, root).collect())
    assert rows() == []
    for _ in range(2):
        assert [r["rel_path"] for r in snapshots.apply_sync(plan, contents, root).collect()] == ["z"]
        assert rows() == [("a", 10**18, 1, b"A"), ("x/y", 10**18, 1, b"B")]
    newer = spark.createDataFrame([("a", 2 * 10**18, bytearray(b"AA"))], contents.schema)
    snapshots.apply_sync(plan.limit(1), newer, root)
    assert rows() == [("a", 2 * 10**18, 2, b"AA"), ("x/y", 10**18, 1, b"B")]
    assert len(snapshots.versions(spark, root)) == 3
    (tmp_path / "table/data/half").mkdir()  # a run that was stopped before its version was logged
    snapshots.drop_old_versions(spark, root, keep=1)
    assert len(snapshots.versions(spark, root)) == 1 and rows()[0][3] == b"AA"
    failed = outputs.apply_sync_to_folder(plan, contents, str(tmp_path / "files"))
    assert (tmp_path / "files/x/y").read_bytes() == b"B" and os.stat(tmp_path / "files/a").st_mtime_ns == 10**18
    assert [r["rel_path"] for r in failed.collect()] == ["z"]


def shouted(rows):
    """A transform: contents in capitals; those with a question mark fail."""
    bad = F.contains(F.col("content").cast("string"), F.lit("?"))
    return rows.select("rel_path", F.when(~bad, F.upper(F.col("content").cast("string")).cast("binary")).alias("content"), F.when(bad, "can't be read").alias("message"))


def files(spark, rows):
    df = spark.createDataFrame([(p, t, len(c), bytearray(c)) for p, t, c in rows], snapshots.SCHEMA)
    return paths.with_path_parts(df).select("rel_path", "dir", "name", "stem", "ext", "mtime_ns", "size", "content")


def test_refresh_of_snapshots(spark, tmp_path):
    """New, changed and failing files, mips from their base, times, the sync, and runs that are repeated."""
    mid, dst = str(tmp_path / "mid"), str(tmp_path / "dst")
    rows = lambda root: {r["rel_path"]: (r["mtime_ns"], bytes(r["content"])) for r in snapshots.read_snapshot(spark, root).collect()}
    src = files(spark, [("a-1-x.png", 5, b"base"), ("a-1-x-mip1.png", 6, b"mip"), ("a-1-bad.png", 5, b"what?"), ("plain.png", 5, b"p")])
    one = refresh(src, mid, dst, shouted)
    assert rows(mid) == rows(dst) == {"a-1-x.png": (5, b"BASE"), "a-1-x-mip1.png": (6, b"BASE")}
    assert one.summary.first().asDict() == {"new": 3, "updated": 0, "groups_skipped": 0, "groups_with_gaps": 0, "mips_patched": 1, "ids_replaced": 0, "files_copied": 2, "errors": 1}
    assert [tuple(r) for r in one.failed.collect()] == [("a-1-bad.png", "transform", "can't be read")] and one.status.first()["status"] == "completed with errors"
    groups = one.groups.collect()
    again = refresh(src, mid, dst, shouted, manifest=spark.createDataFrame(groups, one.groups.schema))
    assert rows(dst) == {"a-1-x.png": (5, b"BASE"), "a-1-x-mip1.png": (6, b"BASE")} and again.summary.first()["files_copied"] == 0 and again.summary.first()["groups_skipped"] == 1
    changed = files(spark, [("a-1-x.png", 9, b"newer"), ("a-1-bad.png", 5, b"fine")])
    three = refresh(changed, mid, dst, shouted)
    assert rows(dst) == {"a-1-x.png": (9, b"NEWER"), "a-1-x-mip1.png": (6, b"BASE"), "a-1-bad.png": (5, b"FINE")} and three.status.first()["status"] == "completed"
    assert rows(mid)["a-1-x-mip1.png"] == (6, b"NEWER")  # a patched mip keeps its time, by which the sync compares


def test_refresh_replaces_variants_and_reuses_hashes(spark, tmp_path):
    mid, dst, seen = str(tmp_path / "mid"), str(tmp_path / "dst"), []

    def consolidate(rows):
        """Sides and hashes are in the content: width, then a number."""
        x = F.split(F.col("content").cast("string"), " ")
        images = rows.withColumns({"width": x[0].cast("int"), "height": x[0].cast("int"), "bits": x[1].cast("bigint")}).drop("content")

        def hashes(df, n):
            seen.append(df.count())
            return df.withColumns({"hash_words": F.array(F.col("bits"), F.lit(0).cast("bigint")), "hash_size": F.lit(n)}).drop("bits")

        return consolidate_variants(images, manifest=seen_before["rows"], compute=hashes)

    seen_before = {"rows": None}
    src = files(spark, [("s-1-a.png", 5, b"64 1"), ("l-1-b.png", 6, b"512 3"), ("l-2-c.png", 6, b"512 3")])
    one = refresh(src, mid, dst, lambda df: df.select("rel_path", "content", F.lit(None).cast("string").alias("message")), consolidate)
    assert one.summary.first()["ids_replaced"] == 1 and seen == [2]  # a group of one side is not hashed
    got = {r["rel_path"]: (r["mtime_ns"], bytes(r["content"])) for r in snapshots.read_snapshot(spark, dst).collect()}
    assert got == {"s-1-a.png": (5, b"512 3"), "l-1-b.png": (6, b"512 3"), "l-2-c.png": (6, b"512 3")}
    seen_before["rows"] = spark.createDataFrame(one.hashes.collect(), one.hashes.schema)
    images = files(spark, [("s-1-a.png", 5, b"64 1"), ("l-1-b.png", 6, b"512 3"), ("s-1-d.png", 7, b"64 3")])
    again = consolidate(images)
    assert sorted((r["rel_path"], r["reused"]) for r in again.hashed.collect()) == [("l-1-b.png", True), ("s-1-a.png", True), ("s-1-d.png", False)] and seen[-1] == 1


def test_stream_refreshes_snapshots(spark, tmp_path):
    """Deliveries, one of which comes twice, end in the newest contents."""
    source, mid, dst, seen = str(tmp_path / "listing"), str(tmp_path / "mid"), str(tmp_path / "dst"), []
    contents = lambda listed: listed.withColumn("content", F.concat("name", F.col("mtime_ns").cast("string")).cast("binary"))
    for delivery in ([("a-1-x.png", 5, 1)], [("a-1-x.png", 5, 1), ("a-1-y.png", 7, 1)], [("a-1-x.png", 9, 1)]):
        spark.createDataFrame(delivery, LISTING).write.mode("append").parquet(source)
        listing = spark.readStream.schema(LISTING).parquet(source)
        query = stream_refresh(listing, contents, mid, dst, shouted, str(tmp_path / "checkpoint"), lambda r, _: seen.append(r.summary.first()["new"] + r.summary.first()["updated"]))
        query.awaitTermination()
    assert seen == [1, 1, 1]
    assert {r["rel_path"]: bytes(r["content"]) for r in snapshots.read_snapshot(spark, dst).collect()} == {"a-1-x.png": b"A-1-X.PNG9", "a-1-y.png": b"A-1-Y.PNG7"}


def test_stream_goes_on_watching(spark, tmp_path):
    source, seen = str(tmp_path / "listing"), []
    spark.createDataFrame([("a-1-x.png", 5, 1)], LISTING).write.parquet(source)
    empty = lambda: spark.createDataFrame([], snapshots.CATALOG)
    listing = spark.readStream.schema(LISTING).parquet(source)
    query = stream_incremental(listing, empty, empty, lambda r, _: seen.append(r.pending.count()), str(tmp_path / "c"), trigger={"processingTime": "200 milliseconds"})
    try:
        for n in (1, 2):
            deadline = time.time() + 60
            while len(seen) < n and time.time() < deadline:
                time.sleep(0.1)
            if n == 1:
                spark.createDataFrame([("a-1-y.png", 5, 1)], LISTING).write.mode("append").parquet(source)
        assert query.isActive and seen == [1, 1]
    finally:
        query.stop()


def test_stream_of_listings(spark, tmp_path):
    """A new, a dumped-again, an unchanged and a very old file, in three deliveries."""
    source, mid, seen = str(tmp_path / "listing"), str(tmp_path / "mid"), []
    rows = lambda x: spark.createDataFrame(x, LISTING)
    catalogue = "rel_path string, dir string, name string, stem string, ext string, mtime_ns bigint, size bigint"
    state = {"rows": []}
    current = lambda: spark.createDataFrame(state["rows"], catalogue)

    def apply(refresh, _):
        seen.append(sorted((r["rel_path"], r["status"]) for r in refresh.pending.collect()))
        state["rows"] = [tuple(r) for r in refresh.mid.collect()]

    for delivery in ([("a-1-x.png", 5, 1), ("a-1-old.png", 1, 1)], [("a-1-x.png", 5, 1), ("a-1-x.png", 9, 1), ("a-1-n.png", 5, 1)], [("a-1-x.png", 9, 1)]):
        rows(delivery).write.mode("append").parquet(source)
        stream_incremental(spark.readStream.schema(LISTING).parquet(source), current, current, apply, mid).awaitTermination()
    assert seen == [[("a-1-old.png", "new"), ("a-1-x.png", "new")], [("a-1-n.png", "new"), ("a-1-x.png", "updated")], []]
