"""One query for each catalogue operator, over the stand-in catalogues, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastercat import fixtures as fx
from rastercat.functions import hashing, imaging, paths, resample
from rastercat.jobs.audit import audit_similar
from rastercat.jobs.consolidate import consolidate_variants
from rastercat.jobs.incremental import run_incremental
from rastercat.operators import delta, mips, replace, report, similarity
from rastercat.sources.scratch import dropped, stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str]] = {}


def _query(name: str, sql: str, *ctes: str) -> Callable[[Query], Query]:
    """Register a query with its SQL; ctes are the fixtures that the SQL needs."""

    def add(f: Query) -> Query:
        _QUERIES[name] = (f, (f"WITH {', '.join(ctes)} " if ctes else "") + sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}


# --- paths and predicates ------------------------------------------------------------------------------


@_query("p1_path_parts", r"""
SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(url, '[^/]*$') AS name,
  left(regexp_extract(url, '[^/]*$'), length(regexp_extract(url, '[^/]*$')) - length(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^.]+)$', 1))) AS stem,
  regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^.]+)$', 1) AS ext FROM pages WHERE url IS NOT NULL""")
def p1_path_parts(spark, d):
    return paths.with_path_parts(fx.table(spark, d, "pages").filter("url is not null"), "url").select("page_id", "dir", "name", "stem", "ext")


@_query("p2_is_image", "SELECT rel_path, lower(ext) IN ('.png', '.jpg', '.jpeg', '.bmp', '.tga', '.webp') AS image FROM dumps", fx.DUMPS)
def p2_is_image(spark, d):
    return fx.dumps(spark, d).select("rel_path", paths.is_image(F.col("ext")).alias("image"))


@_query("p3_is_eligible", "SELECT rel_path, length(stem) - length(replace(stem, '-', '')) >= 2 AS eligible FROM dumps", fx.DUMPS)
def p3_is_eligible(spark, d):
    return fx.dumps(spark, d).select("rel_path", paths.is_eligible(F.col("stem")).alias("eligible"))


@_query("p4_parse_mip", r"""
SELECT rel_path, regexp_matches(stem, '(?i)^(.*)-mip([0-9]+)(.*)$') AS is_mip, regexp_extract(stem, '(?i)^(.*)-mip([0-9]+)(.*)$', 1) AS prefix,
  TRY_CAST(regexp_extract(stem, '(?i)^(.*)-mip([0-9]+)(.*)$', 2) AS BIGINT) AS mip, regexp_extract(stem, '(?i)^(.*)-mip([0-9]+)(.*)$', 3) AS suffix FROM files""", fx.MIPS)
def p4_parse_mip(spark, d):
    s = F.col("stem")
    return fx.mip_files(spark, d).select("rel_path", paths.is_mip(s).alias("is_mip"), paths.mip_prefix(s).alias("prefix"), paths.mip_number(s).alias("mip"), paths.mip_suffix(s).alias("suffix"))


@_query("p5_mip_keys", "SELECT rel_path, mip, mip_key, base_name, gid FROM keyed", fx.MIPS)
def p5_mip_keys(spark, d):
    return mips.mip_members(fx.mip_files(spark, d)).select("rel_path", "mip", "mip_key", "base_name", "gid")


@_query("p6_id_key", "SELECT rel_path, split_part(stem, '-', 2) AS id_key FROM dumps", fx.DUMPS)
def p6_id_key(spark, d):
    return fx.dumps(spark, d).select("rel_path", paths.id_key(F.col("stem")).alias("id_key"))


@_query("p7_classify_resolution", "SELECT rel_path, CASE WHEN max_dim >= 1024 THEN 'high' ELSE 'low' END AS resolution FROM textures", fx.TEXTURES)
def p7_classify_resolution(spark, d):
    return similarity.classify_resolution(fx.textures(spark, d)).select("rel_path", "resolution")


@_query("p8_classify_size", "SELECT rel_path, max_dim < 512 AS is_small, max_dim >= 256 AS is_large FROM textures", fx.TEXTURES)
def p8_classify_size(spark, d):
    return similarity.classify_size(fx.textures(spark, d), 512, 256).select("rel_path", "is_small", "is_large")


@_query("p9_drop_cache_files", "SELECT rel_path, name FROM dumps WHERE o_orderkey % 23 <> 0", fx.DUMPS)
def p9_drop_cache_files(spark, d):
    return paths.drop_cache_files(fx.with_cache_files(fx.dumps(spark, d))).select("rel_path", "name")


_FLAG = "regexp_matches(lower(trim(line)), 'error|failed|invalid|exception|unable|not found|denied')"


@_query("p10_run_status", f"SELECT run_id, count(*) AS n_lines, count(*) FILTER ({_FLAG}) AS n_errors, CAST(CASE WHEN run_id % 3 > 0 THEN run_id % 3 WHEN bool_or({_FLAG}) THEN 1 ELSE 0 END AS INT) AS status FROM lines GROUP BY run_id", fx.LOGS)
def p10_run_status(spark, d):
    lines = fx.log_lines(spark, d)
    codes = lines.select("run_id", (F.col("run_id") % 3).cast("int").alias("code")).distinct()
    return report.run_status(lines, codes)


@_query("p10_error_lines", f"SELECT event_id, line FROM lines WHERE {_FLAG}", fx.LOGS)
def p10_error_lines(spark, d):
    return fx.log_lines(spark, d).filter(paths.is_error_line(F.col("line"))).select("event_id", "line")


@_query("p11_composite_name", """
SELECT tex_id, CASE WHEN length(c) > 180 THEN left(c, 180) || '.png' ELSE c END AS composite
FROM (SELECT tex_id, repeat(stem, CAST(1 + tex_id % 9 AS INT)) || '__VS__' || stem || '.png' AS c FROM textures)""", fx.TEXTURES)
def p11_composite_name(spark, d):
    rows = fx.textures(spark, d)
    return rows.select("tex_id", paths.composite_name(F.expr("repeat(stem, CAST(1 + tex_id % 9 AS INT))"), F.col("stem")).alias("composite"))


# --- arrays ----------------------------------------------------------------------------------------------

_JOINED = "array_to_string(list_transform({}, lambda x: CAST(x AS VARCHAR)), ',')"


def _joined(values):
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


@_query("i1_to_gray", "SELECT tex_id, " + _JOINED.format("list_transform(range(1, 65), lambda i: (19595 * px[i] + 38470 * px[65 - i] + 7471 * (255 - px[i]) + 32768) >> 16)") + " AS gray FROM textures", fx.TEXTURES)
def i1_to_gray(spark, d):
    px = F.col("px")
    return fx.textures(spark, d).select("tex_id", _joined(imaging.gray_of_arrays(px, F.reverse(px), F.transform(px, lambda x: 255 - x))).alias("gray"))


@_query("i3_average_hash", "SELECT tex_id, w0, w1 FROM hashed", fx.TEXTURES)
def i3_average_hash(spark, d):
    return fx.hashed(spark, d).select("tex_id", F.col("hash_words")[0].alias("w0"), F.col("hash_words")[1].alias("w1"))


@_query("i4_hamming", f"SELECT a.tex_id, b.tex_id AS other, {fx.distance('a', 'b')} AS hamming FROM hashed a JOIN hashed b ON b.tex_id = a.tex_id + 2", fx.TEXTURES)
def i4_hamming(spark, d):
    a = fx.hashed(spark, d).select("tex_id", "hash_words")
    b = a.select((F.col("tex_id") - 2).alias("tex_id"), F.col("tex_id").alias("other"), F.col("hash_words").alias("b"))
    return a.join(b, "tex_id").select("tex_id", "other", hashing.hamming(F.col("hash_words"), F.col("b")).alias("hamming"))


@_query("i5_hash_hex", f"SELECT tex_id, {fx.HEX} AS hex, true AS same FROM hashed", fx.TEXTURES)
def i5_hash_hex(spark, d):
    rows = fx.hashed(spark, d).withColumn("hex", hashing.hash_to_hex(F.col("hash_words")))
    return rows.select("tex_id", "hex", (hashing.hash_from_hex(F.col("hex")) == F.col("hash_words")).alias("same"))


_PAIRS = "pairs AS (SELECT a.tex_id, a.px AS x, b.px AS y FROM textures a JOIN textures b ON b.tex_id = a.tex_id - 2 WHERE a.tex_id % 4 = 2)"


def _pixel_pairs(spark, d):
    rows = fx.textures(spark, d)
    other = rows.select((F.col("tex_id") + 2).alias("tex_id"), F.col("px").alias("y"))
    return rows.filter("tex_id % 4 = 2").select("tex_id", F.col("px").alias("x")).join(other, "tex_id")


@_query("i7_mean_abs_diff", "SELECT tex_id, list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))) / 64.0::DOUBLE AS diff FROM pairs", fx.TEXTURES, _PAIRS)
def i7_mean_abs_diff(spark, d):
    return _pixel_pairs(spark, d).select("tex_id", imaging.mean_abs_diff_of_arrays(F.col("x"), F.col("y")).alias("diff"))


@_query("i8_diff_heatmap", "SELECT tex_id, " + _JOINED.format("list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))") + " AS heat FROM pairs", fx.TEXTURES, _PAIRS)
def i8_diff_heatmap(spark, d):
    return _pixel_pairs(spark, d).select("tex_id", _joined(imaging.heatmap_of_arrays(F.col("x"), F.col("y"))).alias("heat"))


# --- change detection and sync -------------------------------------------------------------------------


def _delta(spark, d):
    return delta.classify_delta(fx.dumps(spark, d), fx.mid_times(spark, d))


@_query("j1_classify_delta", "SELECT rel_path, mtime_ns, status FROM delta", fx.DUMPS)
def j1_classify_delta(spark, d):
    return _delta(spark, d).select("rel_path", "mtime_ns", "status")


@_query("j2_stage_pending", "SELECT rel_path, mtime_ns, status FROM delta WHERE status IN ('new', 'updated')", fx.DUMPS)
def j2_stage_pending(spark, d):
    return delta.stage_pending(_delta(spark, d)).select("rel_path", "mtime_ns", "status")


@_query("u1_pending_union", "SELECT rel_path, mtime_ns, status FROM delta WHERE status IN ('new', 'updated')", fx.DUMPS)
def u1_pending_union(spark, d):
    return delta.pending_union(fx.dumps(spark, d), fx.mid_times(spark, d)).select("rel_path", "mtime_ns", "status")


@_query("j3_restore_times", "SELECT m.rel_path, d.mtime_ns FROM mid m JOIN dumps d USING (rel_path) WHERE m.o_orderkey % 4 = 0", fx.DUMPS)
def j3_restore_times(spark, d):
    return delta.restore_times(fx.mid_times(spark, d).filter("o_orderkey % 4 = 0"), fx.dumps(spark, d)).select("rel_path", "mtime_ns")


@_query("a1_stage_counts", """
SELECT count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'up_to_date') AS up_to_date,
  count(*) FILTER (status = 'ineligible') AS ineligible, count(*) FILTER (status IN ('new', 'updated')) AS to_process FROM delta""", fx.DUMPS)
def a1_stage_counts(spark, d):
    return delta.stage_counts(_delta(spark, d))


_DST = "dst AS (SELECT rel_path, CASE WHEN o_orderkey % 5 = 0 THEN mtime_ns + 1000 ELSE mtime_ns END AS mtime_ns, size + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size FROM mid WHERE o_orderkey % 3 <> 0)"
_COPY = "SELECT m.rel_path AS dst_path, m.rel_path AS src_path, CASE WHEN dst.rel_path IS NULL THEN 'copy_new' ELSE 'copy_changed' END AS reason FROM mid m LEFT JOIN dst USING (rel_path) WHERE m.o_orderkey % 23 <> 0 AND (dst.rel_path IS NULL OR dst.mtime_ns IS DISTINCT FROM m.mtime_ns{})"


def _dst(spark, d):
    rows = fx.mid_times(spark, d).filter("o_orderkey % 3 <> 0")
    return rows.selectExpr("rel_path", "CASE WHEN o_orderkey % 5 = 0 THEN mtime_ns + 1000 ELSE mtime_ns END AS mtime_ns", "size + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS size")


@_query("j15_copy_changed", _COPY.format(""), fx.DUMPS, _DST)
def j15_copy_changed(spark, d):
    return delta.copy_changed_plan(fx.with_cache_files(fx.mid_times(spark, d)), _dst(spark, d))


@_query("j15_copy_changed_by_size", _COPY.format(" OR dst.size IS DISTINCT FROM m.size"), fx.DUMPS, _DST)
def j15_copy_changed_by_size(spark, d):
    return delta.copy_changed_plan(fx.with_cache_files(fx.mid_times(spark, d)), _dst(spark, d), compare="mtime+size")


@_query("j16_mirror", "SELECT rel_path AS dst_path, rel_path AS src_path, 'mirror' AS reason FROM mid WHERE o_orderkey % 23 <> 0", fx.DUMPS)
def j16_mirror(spark, d):
    return delta.mirror_plan(fx.with_cache_files(fx.mid_times(spark, d)))


@_query("j16_extra_files", "SELECT rel_path FROM dumps WHERE rel_path NOT IN (SELECT rel_path FROM mid)", fx.DUMPS)
def j16_extra_files(spark, d):
    return delta.extra_files(fx.mid_times(spark, d), fx.dumps(spark, d))


# --- mip chains --------------------------------------------------------------------------------------------


def _members(spark, d):
    return mips.dedupe_mips(mips.mip_members(fx.mip_files(spark, d)))


def _files(spark, d):
    """Mip files as a table, without what follows from their paths."""
    return stored(fx.mip_files(spark, d).select("rel_path", "dir", "mtime_ns", "size"), "files")


def _groups(files):
    name = paths.file_name(F.col("rel_path"))
    files = files.withColumns({"name": name, "stem": paths.stem(name), "ext": paths.extension(name)})
    return mips.mip_base(mips.mip_groups(mips.dedupe_mips(mips.mip_members(files))), files)


@_query("w4_dedupe_mips", "SELECT gid, mip, rel_path FROM members", fx.MIPS)
def w4_dedupe_mips(spark, d):
    return _members(spark, d).select("gid", "mip", "rel_path")


@_query("a2_mip_groups", """
SELECT g0.gid, n_mips, min_mip, max_mip, first_path, m.members FROM g0 JOIN
  (SELECT gid, string_agg(mip || '=' || rel_path, ',' ORDER BY mip) AS members FROM members GROUP BY gid) m USING (gid)""", fx.MIPS)
def a2_mip_groups(spark, d):
    joined = F.array_join(F.transform("members", lambda m: F.concat(m["mip"].cast("string"), F.lit("="), m["rel_path"])), ",")
    return mips.mip_groups(_members(spark, d)).select("gid", "n_mips", "min_mip", "max_mip", "first_path", joined.alias("members"))


@_query("a3_mip_gaps", """
SELECT gid, min_mip, max_mip, (SELECT string_agg((mip + 1) || '-' || (next - 1), ',' ORDER BY mip) FROM
  (SELECT gid, mip, lead(mip) OVER (PARTITION BY gid ORDER BY mip) AS next FROM members) m WHERE m.gid = g0.gid AND next > mip + 1) AS missing
FROM g0 WHERE max_mip - min_mip + 1 <> n_mips""", fx.MIPS)
def a3_mip_gaps(spark, d):
    ranges = F.transform("missing", lambda x: F.concat(x["first"].cast("string"), F.lit("-"), x["last"].cast("string")))
    return mips.mip_gaps(mips.mip_groups(_members(spark, d))).select("gid", "min_mip", "max_mip", F.array_join(ranges, ",").alias("missing"))


@_query("j4_mip_base", "SELECT gid, base_name, base FROM groups", fx.MIPS)
def j4_mip_base(spark, d):
    return _groups(_files(spark, d)).select("gid", "base_name", "base")


_MANIFEST = """
chains AS (SELECT gid, list_sort(list(rel_path || '@' || mtime_ns)) AS mips, list_sort(list(rel_path || '@' || CASE WHEN left(gid, 2) = 'd1' THEN mtime_ns + mip ELSE mtime_ns END)) AS old_mips FROM members GROUP BY gid),
skips AS (SELECT state.*, coalesce(left(gid, 2) <> 'd4' AND base_mtime = base_mtime + CASE WHEN left(gid, 2) = 'd2' THEN 1 ELSE 0 END
  AND base_size = base_size + CASE WHEN left(gid, 2) = 'd3' THEN 1 ELSE 0 END AND mips = old_mips, false) AS skip FROM state JOIN chains USING (gid) )"""


def _state(spark, d):
    files = _files(spark, d)
    groups = stored(_groups(files), "groups")
    dropped(files)
    return mips.with_state(groups)


def _old_groups(state):
    """The manifest of a run before: of some directories other than now, or not there."""
    place = F.substring("gid", 1, 2)
    shifted = F.transform("mips", lambda m: F.struct(m["path"].alias("path"), (m["mtime"] + paths.mip_number(paths.stem(paths.file_name(m["path"])))).alias("mtime")))
    return state.filter(place != "d4").select(
        "gid", "base", (F.col("base_mtime") + F.when(place == "d2", 1).otherwise(0)).alias("base_mtime"), (F.col("base_size") + F.when(place == "d3", 1).otherwise(0)).alias("base_size"),
        F.when(place == "d1", shifted).otherwise(F.col("mips")).alias("mips"),
    )


def _skips(spark, d):
    state = _state(spark, d)
    return mips.mip_skip(state, _old_groups(state))


@_query("j6_mip_skip", "SELECT gid, base, skip FROM skips", fx.MIPS, _MANIFEST)
def j6_mip_skip(spark, d):
    return _skips(spark, d).select("gid", "base", "skip")


@_query("j7_mip_patch_plan", "SELECT m.rel_path AS dst_path, s.base AS src_path, 'mip_patch' AS reason FROM skips s JOIN members m USING (gid) WHERE NOT s.skip AND m.rel_path <> s.base", fx.MIPS, _MANIFEST)
def j7_mip_patch_plan(spark, d):
    return mips.mip_patch_plan(_skips(spark, d))


@_query("u2_same_path_sets", "SELECT gid, gid[1:2] <> 'd5' OR n_mips <= 1 AS same FROM g0", fx.MIPS)
def u2_same_path_sets(spark, d):
    rows = mips.mip_groups(_members(spark, d)).withColumn("now", F.transform("members", lambda m: m["rel_path"]))
    old = F.when(F.substring("gid", 1, 2) == "d5", F.slice("now", 1, 1)).otherwise(F.reverse("now"))
    return rows.select("gid", mips.same_path_sets(F.col("now"), old).alias("same"))


# --- ID groups -----------------------------------------------------------------------------------------------

_CANDIDATES = f"""
cand AS (SELECT s.rel_path AS small_path, l.rel_path AS large_path, l.area, s.id_key, {fx.distance('s', 'l')} AS hamming
  FROM hashed s JOIN hashed l ON s.id_key = l.id_key AND s.max_dim < 256 AND l.max_dim >= 256),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY small_path ORDER BY hamming, CASE WHEN hamming = 0 THEN 0 ELSE -area END, large_path) = 1)"""


@_query("j8_id_candidates", "SELECT small_path, large_path, hamming FROM cand", fx.TEXTURES, _CANDIDATES)
def j8_id_candidates(spark, d):
    return similarity.id_candidates(fx.hashed(spark, d)).select("small_path", "large_path", "hamming")


@_query("w1_best_large", "SELECT small_path, large_path, hamming FROM best", fx.TEXTURES, _CANDIDATES)
def w1_best_large(spark, d):
    return similarity.best_large(similarity.best_candidates(fx.hashed(spark, d)))


@_query("w1_best_large_of_distinct", "SELECT small_path, large_path, hamming FROM best", fx.TEXTURES, _CANDIDATES)
def w1_best_large_of_distinct(spark, d):
    return similarity.best_large_of_distinct(fx.hashed(spark, d))


_PLAN = "SELECT small_path AS dst_path, large_path AS src_path, hamming, hamming <= 6 AS replaced, 'id_replace' AS reason FROM best"


@_query("j9_id_replace_plan", _PLAN, fx.TEXTURES, _CANDIDATES)
def j9_id_replace_plan(spark, d):
    return replace.id_replace_plan(fx.hashed(spark, d))


@_query("j9_near_replacements", _PLAN + " WHERE hamming <= 6", fx.TEXTURES, _CANDIDATES)
def j9_near_replacements(spark, d):
    return replace.id_replace_plan(fx.hashed(spark, d), near_only=True)


_REUSED = "tex_id % 5 <> 0 AND tex_id % 13 <> 0 AND tex_id % 7 <> 0 AND tex_id % 11 <> 0"


@_query("e2_consolidate_variants", f"""
SELECT small_path AS dst_path, large_path AS src_path, hamming, hamming <= 6 AS replaced, (SELECT {_REUSED} FROM hashed h WHERE h.rel_path = small_path) AS reused FROM best
WHERE (SELECT length(stem) - length(replace(stem, '-', '')) >= 2 FROM hashed h WHERE h.rel_path = small_path)""", fx.TEXTURES, _CANDIDATES)
def e2_consolidate_variants(spark, d):
    """With the manifest of a run before: only images that it has no valid hash for are hashed."""
    made = lambda rows, n: rows.withColumns({"hash_words": hashing.average_hash(F.col("px"), n), "hash_size": F.lit(n)}).drop("px")
    images = fx.stamped(fx.textures(spark, d)).select("rel_path", "name", "stem", "ext", "width", "height", "mtime_ns", "size", "px")
    got = consolidate_variants(images, manifest=fx.hash_manifest(spark, d), compute=made)
    reused = got.hashed.select(F.col("rel_path").alias("dst_path"), "reused")
    return got.plan.join(reused, "dst_path").select("dst_path", "src_path", "hamming", "replaced", "reused")


@_query("j10_apply_replacements", """
SELECT h.rel_path, coalesce(l.w0, h.w0) AS w0, coalesce(l.area, h.area) AS size, h.tex_id AS mtime
FROM hashed h LEFT JOIN best b ON b.small_path = h.rel_path AND b.hamming <= 6 LEFT JOIN hashed l ON l.rel_path = b.large_path""", fx.TEXTURES, _CANDIDATES)
def j10_apply_replacements(spark, d):
    rows = fx.hashed(spark, d)
    contents = rows.select("rel_path", F.col("hash_words")[0].alias("w0"), F.col("area").alias("size"), F.col("tex_id").alias("mtime"))
    return replace.apply_replacements(contents, replace.id_replace_plan(rows), ("w0", "size"))


@_query("a4_id_group_profile", """
SELECT id_key, count(*) AS n, count(*) FILTER (max_dim >= 256) AS n_large, count(*) FILTER (max_dim < 256) AS n_small,
  count(*) FILTER (max_dim >= 256) > 0 AND count(*) FILTER (max_dim < 256) > 0 AS usable FROM textures GROUP BY id_key""", fx.TEXTURES)
def a4_id_group_profile(spark, d):
    return report.id_group_profile(fx.textures(spark, d))


@_query("a5_replacement_summary", "SELECT count(*) FILTER (hamming <= 6) AS replaced, count(*) FILTER (hamming > 6) AS skipped FROM best", fx.TEXTURES, _CANDIDATES)
def a5_replacement_summary(spark, d):
    return replace.replacement_summary(replace.id_replace_plan(fx.hashed(spark, d)))


# --- resampling -------------------------------------------------------------------------------------------------

#: Fixed-point weights of a line of n pixels for one of m, as a filter of the given reach has them.
_WEIGHTS = """
{name}_raw AS (SELECT i, x, {kernel} AS w FROM (SELECT i, x, abs((x - (i + 0.5) * {scale} + 0.5) / greatest({scale}, 1.0)) AS a FROM (
  SELECT i, unnest(range(greatest(0, CAST(trunc((i + 0.5) * {scale} - {reach} * greatest({scale}, 1.0) + 0.5) AS INT)), least({size}, CAST(trunc((i + 0.5) * {scale} + {reach} * greatest({scale}, 1.0) + 0.5) AS INT)))) AS x
  FROM (SELECT unnest(range({to})) AS i)))),
{name} AS (SELECT i, x, CAST(trunc(w / t * 4194304.0 + CASE WHEN w / t < 0 THEN -0.5 ELSE 0.5 END) AS BIGINT) AS w FROM {name}_raw JOIN (SELECT i, sum(w) AS t FROM {name}_raw GROUP BY i) USING (i))"""
_LANCZOS = "CASE WHEN a = 0 THEN 1.0 WHEN a < 3 THEN sin(pi() * a) / (pi() * a) * (sin(pi() * a / 3) / (pi() * a / 3)) ELSE 0.0 END"
_BICUBIC = "CASE WHEN a < 1 THEN (1.5 * a - 2.5) * a * a + 1 WHEN a < 2 THEN (((a - 5) * a + 8) * a - 4) * -0.5 ELSE 0.0 END"
_RESIZED = """
across AS (SELECT tex_id, channel, y, i AS x, greatest(0, least(255, (CAST(sum(v * w) AS BIGINT) + 2097152) >> 22)) AS v FROM source JOIN across_w USING (x) GROUP BY tex_id, channel, y, i),
down AS (SELECT tex_id, channel, i AS y, across.x, greatest(0, least(255, (CAST(sum(v * w) AS BIGINT) + 2097152) >> 22)) AS v FROM across JOIN down_w ON down_w.x = across.y GROUP BY tex_id, channel, i, across.x)"""
_PLANES = """
SELECT tex_id, {channel}string_agg(v, ',' ORDER BY y, x) AS pixels FROM down GROUP BY tex_id, channel"""


def _resize_sql(planes, width, height, kind, channel):
    kernel, reach = (_LANCZOS, 3) if kind == "lanczos" else (_BICUBIC, 2)
    weights = [_WEIGHTS.format(name=n, kernel=kernel, reach=reach, size=8, to=to, scale=f"(8 / {to}.0)") for n, to in (("across_w", width), ("down_w", height))]
    source = " UNION ALL ".join(f"SELECT tex_id, '{c}' AS channel, (k - 1) // 8 AS y, (k - 1) % 8 AS x, {value} AS v FROM textures, (SELECT unnest(range(1, 65)) AS k)" for c, value in planes.items())
    return _PLANES.format(channel=channel), (fx.TEXTURES, f"source AS ({source})", *weights, _RESIZED)


def _resized(spark, d, planes, width, height, kind):
    rows = resample.pixels_of(fx.textures(spark, d).select("tex_id", "px"), planes, F.lit(8), F.lit(8), ("tex_id",))
    made = resample.plane(resample.resized(rows, width, height, kind, ("tex_id", "channel")), ("tex_id", "channel"))
    return made.select("tex_id", "channel", F.array_join(F.transform("pixels", lambda v: v.cast("string")), ",").alias("pixels"))


_GRAY_SQL, _GRAY_CTES = _resize_sql({"gray": "px[k]"}, 5, 5, "lanczos", "")


@_query("i2_resize_gray", _GRAY_SQL, *_GRAY_CTES)
def i2_resize_gray(spark, d):
    """Gray planes in the size of a 25-bit hash."""
    return _resized(spark, d, {"gray": F.col("px")}, 5, 5, "lanczos").drop("channel")


_RGB_SQL, _RGB_CTES = _resize_sql({"red": "px[k]", "green": "255 - px[k]", "blue": "px[65 - k]"}, 11, 6, "bicubic", "channel, ")


@_query("i6_resize_rgb", _RGB_SQL, *_RGB_CTES)
def i6_resize_rgb(spark, d):
    """Three channels, wider and lower than they were."""
    planes = {"red": F.col("px"), "green": F.transform("px", lambda p: 255 - p), "blue": F.reverse("px")}
    return _resized(spark, d, planes, 11, 6, "bicubic")


# --- hash reuse -------------------------------------------------------------------------------------------------

@_query("j5_reuse_hashes", f"SELECT rel_path, {fx.HEX} AS hash, {_REUSED} AS reused FROM hashed", fx.TEXTURES)
def j5_reuse_hashes(spark, d):
    rows = fx.stamped(fx.hashed(spark, d))
    out = replace.reuse_hashes(rows.select("rel_path", "mtime_ns", "size"), fx.hash_manifest(spark, d), rows)
    return out.select("rel_path", hashing.hash_to_hex(F.col("hash_words")).alias("hash"), "reused")


@_query("u3_carried_forward", f"SELECT rel_path, CASE WHEN tex_id % 2 = 0 THEN 'new' WHEN tex_id % 13 = 0 THEN 'nothex' ELSE {fx.HEX} END AS hash FROM hashed WHERE tex_id % 2 = 0 OR tex_id % 5 <> 0", fx.TEXTURES)
def u3_carried_forward(spark, d):
    old = fx.hash_manifest(spark, d).select("rel_path", "hash")
    current = fx.textures(spark, d).select("rel_path", "tex_id")
    new = current.filter("tex_id % 2 = 0").select("rel_path", F.lit("new").alias("hash"))
    return replace.carried_forward(old, new, current)


# --- audit ------------------------------------------------------------------------------------------------------

_NEAREST = f"""
allpairs AS (SELECT l.rel_path AS low_path, l.name AS low_name, l.stem AS low_stem, l.width AS low_w, l.height AS low_h, h.rel_path AS high_path, h.name AS high_name, h.stem AS high_stem,
  h.width AS high_w, h.height AS high_h, h.max_dim AS high_dim, {fx.distance('l', 'h')} AS hamming FROM hashed l JOIN hashed h ON l.max_dim < 1024 AND h.max_dim >= 1024),
nearest AS (SELECT * FROM allpairs QUALIFY row_number() OVER (PARTITION BY low_path ORDER BY hamming, -high_dim, high_name, high_path) = 1),
matches AS (SELECT * FROM nearest WHERE hamming <= 6)"""
_MATCH = ("low_path", "low_name", "low_w", "low_h", "high_path", "high_name", "high_w", "high_h", "hamming")


@_query("j11_nearest_high", f"SELECT {', '.join(_MATCH)} FROM matches", fx.TEXTURES, _NEAREST)
def j11_nearest_high(spark, d):
    return similarity.nearest_high(fx.hashed(spark, d)).select(*_MATCH)


@_query("w2_best_high", "SELECT low_path, high_path, hamming FROM nearest", fx.TEXTURES, _NEAREST)
def w2_best_high(spark, d):
    """Every low's best high, however far."""
    return similarity.nearest_high(fx.hashed(spark, d), threshold=64).select("low_path", "high_path", "hamming")


@_query("w3_top_k_high", """
SELECT low_path, CAST(row_number() OVER (PARTITION BY low_path ORDER BY hamming, high_name, -high_dim, high_path) AS INT) AS rank, high_path, hamming FROM allpairs
QUALIFY row_number() OVER (PARTITION BY low_path ORDER BY hamming, high_name, -high_dim, high_path) <= 3""", fx.TEXTURES, _NEAREST)
def w3_top_k_high(spark, d):
    return similarity.top_k_high(fx.hashed(spark, d), 3)


@_query("w3_nested_top_k", """
SELECT low_path, string_agg(high_path || '=' || hamming, ',' ORDER BY rank) AS highs FROM (SELECT *, row_number() OVER (PARTITION BY low_path ORDER BY hamming, high_name, -high_dim, high_path) AS rank FROM allpairs)
WHERE rank <= 2 GROUP BY low_path""", fx.TEXTURES, _NEAREST)
def w3_nested_top_k(spark, d):
    nested = similarity.nested_top_k(similarity.top_k_high(fx.hashed(spark, d), 2))
    return nested.select("low_path", F.array_join(F.transform("highs", lambda h: F.concat(h["high_path"], F.lit("="), h["hamming"].cast("string"))), ",").alias("highs"))


@_query("o1_ordered_highs", "SELECT rel_path, max_dim FROM textures WHERE max_dim >= 1024 ORDER BY max_dim DESC, name, rel_path", fx.TEXTURES)
def o1_ordered_highs(spark, d):
    return similarity.ordered_highs(fx.textures(spark, d).filter("max_dim >= 1024")).select("rel_path", "max_dim")


@_query("o2_first_lows", "SELECT rel_path FROM textures WHERE max_dim < 1024 ORDER BY name, rel_path LIMIT 50", fx.TEXTURES)
def o2_first_lows(spark, d):
    return similarity.ordered_lows(fx.textures(spark, d).filter("max_dim < 1024"), 50).select("rel_path")


@_query("o2_limited_matches", "SELECT low_path, high_path, hamming FROM matches WHERE low_path IN (SELECT rel_path FROM textures WHERE max_dim < 1024 ORDER BY name, rel_path LIMIT 100)", fx.TEXTURES, _NEAREST)
def o2_limited_matches(spark, d):
    return similarity.nearest_high(fx.hashed(spark, d), limit=100).select("low_path", "high_path", "hamming")


_VERIFIED = """
measured AS (SELECT m.*, list_sum(list_transform(range(1, 65), lambda i: abs(l.px[i] - h.px[i]))) / 64.0::DOUBLE AS d FROM matches m JOIN textures l ON l.rel_path = m.low_path JOIN textures h ON h.rel_path = m.high_path)"""


@_query("j12_verify_matches", "SELECT low_path, high_path, hamming, d AS diff FROM measured WHERE d <= 12", fx.TEXTURES, _NEAREST, _VERIFIED)
def j12_verify_matches(spark, d):
    found = similarity.nearest_high(fx.hashed(spark, d)).drop("diff")
    px = similarity.semi_filter_pixels(fx.textures(spark, d), found).select("rel_path", "px")
    both = found.join(px.withColumnsRenamed({"rel_path": "low_path", "px": "a"}), "low_path").join(px.withColumnsRenamed({"rel_path": "high_path", "px": "b"}), "high_path")
    return similarity.within_diff(both.withColumn("diff", imaging.mean_abs_diff_of_arrays(F.col("a"), F.col("b")))).select("low_path", "high_path", "hamming", "diff")


@_query("j13_compare_pairs", f"SELECT a.rel_path AS a, b.rel_path AS b, a.width AS a_w, a.height AS a_h, b.width AS b_w, b.height AS b_h, {fx.distance('a', 'b')} AS hamming FROM hashed a JOIN hashed b ON b.tex_id = a.tex_id + 4", fx.TEXTURES)
def j13_compare_pairs(spark, d):
    rows = fx.hashed(spark, d)
    pairs = rows.select("tex_id", F.col("rel_path").alias("a")).join(rows.select((F.col("tex_id") - 4).alias("tex_id"), F.col("rel_path").alias("b")), "tex_id").drop("tex_id")
    return similarity.compare_pairs(pairs, rows)


@_query("j14_hamming_join", f"""
SELECT DISTINCT l.w0 AS l0, l.w1 AS l1, h.w0 AS r0, h.w1 AS r1, {fx.distance('l', 'h')} AS hamming FROM hashed l JOIN hashed h ON l.max_dim < 1024 AND h.max_dim >= 1024 AND {fx.distance('l', 'h')} <= 6""", fx.TEXTURES)
def j14_hamming_join(spark, d):
    rows = similarity.classify_resolution(fx.hashed(spark, d))
    near = similarity.hamming_join(rows.filter("resolution = 'low'"), rows.filter("resolution = 'high'"), 6)
    return near.select(F.col("l_words")[0].alias("l0"), F.col("l_words")[1].alias("l1"), F.col("r_words")[0].alias("r0"), F.col("r_words")[1].alias("r1"), "hamming")


@_query("j14_hamming_join_in_groups", f"""
SELECT DISTINCT l.id_key, l.w0 AS l0, l.w1 AS l1, h.w0 AS r0, h.w1 AS r1, {fx.distance('l', 'h')} AS hamming FROM hashed l JOIN hashed h ON l.id_key = h.id_key AND l.max_dim < 256 AND h.max_dim >= 256 AND {fx.distance('l', 'h')} <= 4""", fx.TEXTURES)
def j14_hamming_join_in_groups(spark, d):
    rows = similarity.classify_size(fx.hashed(spark, d))
    near = similarity.hamming_join(rows.filter("is_small"), rows.filter("is_large"), 4, by=("id_key",))
    return near.select("id_key", F.col("l_words")[0].alias("l0"), F.col("l_words")[1].alias("l1"), F.col("r_words")[0].alias("r0"), F.col("r_words")[1].alias("r1"), "hamming")


@_query("j17_semi_filter_pixels", "SELECT rel_path FROM textures WHERE rel_path IN (SELECT low_path FROM matches UNION SELECT high_path FROM matches)", fx.TEXTURES, _NEAREST)
def j17_semi_filter_pixels(spark, d):
    return similarity.semi_filter_pixels(fx.textures(spark, d), similarity.nearest_high(fx.hashed(spark, d))).select("rel_path")


@_query("a6_audit_summary", "SELECT count(*) AS loaded, count(*) FILTER (max_dim >= 1024) AS high, count(*) FILTER (max_dim < 1024) AS low, (SELECT count(*) FROM matches) AS matches FROM textures", fx.TEXTURES, _NEAREST)
def a6_audit_summary(spark, d):
    rows = fx.hashed(spark, d)
    return report.audit_summary(rows, similarity.nearest_high(rows))


@_query("e3_audit_similar", """
SELECT CASE WHEN hamming <= 4 THEN 'near-identical' WHEN hamming <= 10 THEN 'similar' ELSE 'loose' END AS band, count(*) AS n, (SELECT count(*) FROM textures) AS loaded,
  (SELECT count(*) FROM textures WHERE max_dim < 1024) AS low FROM matches GROUP BY 1""", fx.TEXTURES, _NEAREST)
def e3_audit_similar(spark, d):
    """The matches of an audit by distance, beside how many images it read."""
    audit = audit_similar(fx.hashed(spark, d))
    return audit.bands.withColumn("k", F.lit(1)).join(audit.summary.select(F.lit(1).alias("k"), "loaded", "low"), "k").drop("k")


@_query("a7_distance_bands", "SELECT CASE WHEN hamming <= 4 THEN 'near-identical' WHEN hamming <= 10 THEN 'similar' WHEN hamming <= 20 THEN 'loose' ELSE 'unrelated' END AS band, count(*) AS n FROM nearest GROUP BY 1", fx.TEXTURES, _NEAREST)
def a7_distance_bands(spark, d):
    return similarity.match_bands(similarity.nearest_high(fx.hashed(spark, d), threshold=64))


@_query("s7_matches_table", "SELECT low_name, low_w, low_h, high_name, high_w, high_h, hamming, printf('%.3f', d) AS diff FROM measured", fx.TEXTURES, _NEAREST, _VERIFIED)
def s7_matches_table(spark, d):
    found = similarity.nearest_high(fx.hashed(spark, d)).drop("diff")
    px = fx.textures(spark, d).select("rel_path", "px")
    both = found.join(px.withColumnsRenamed({"rel_path": "low_path", "px": "a"}), "low_path").join(px.withColumnsRenamed({"rel_path": "high_path", "px": "b"}), "high_path")
    return report.matches_table(both.withColumn("diff", imaging.mean_abs_diff_of_arrays(F.col("a"), F.col("b"))))


@_query("s9_gallery_index", "SELECT low_stem || '__VS__' || high_stem || '.png' AS composite, low_path, high_path, hamming, CAST(NULL AS DOUBLE) AS diff FROM matches", fx.TEXTURES, _NEAREST)
def s9_gallery_index(spark, d):
    return audit_similar(fx.hashed(spark, d)).gallery


# --- runs -----------------------------------------------------------------------------------------------------------


@_query("s10_quarantine", f"SELECT rel_path, 'staging' AS stage, 'ineligible' AS message FROM delta WHERE status = 'ineligible' UNION ALL SELECT CAST(event_id AS VARCHAR), 'transform', line FROM lines WHERE {_FLAG}", fx.DUMPS, fx.LOGS)
def s10_quarantine(spark, d):
    ineligible = _delta(spark, d).filter("status = 'ineligible'").select("rel_path", F.col("status").alias("message"))
    lines = fx.log_lines(spark, d).filter(paths.is_error_line(F.col("line"))).select(F.col("event_id").cast("string").alias("rel_path"), F.col("line").alias("message"))
    return report.quarantine(staging=ineligible, transform=lines)


@_query("a8_run_summary", """
SELECT (SELECT count(*) FROM delta WHERE status = 'new') AS new, (SELECT count(*) FROM delta WHERE status = 'updated') AS updated, (SELECT count(*) FROM skips WHERE skip) AS groups_skipped,
  (SELECT count(*) FROM g0 WHERE max_mip - min_mip + 1 <> n_mips) AS groups_with_gaps, (SELECT count(*) FROM skips s JOIN members m USING (gid) WHERE NOT s.skip AND m.rel_path <> s.base) AS mips_patched,
  (SELECT count(*) FROM best WHERE hamming <= 6) AS ids_replaced, (SELECT count(*) FROM mid m LEFT JOIN dst USING (rel_path) WHERE dst.rel_path IS NULL OR dst.mtime_ns IS DISTINCT FROM m.mtime_ns) AS files_copied,
  (SELECT count(*) FROM delta WHERE status = 'ineligible') AS errors""", fx.DUMPS, _DST, fx.MIPS, _MANIFEST, fx.TEXTURES, _CANDIDATES)
def a8_run_summary(spark, d):
    found, groups = _delta(spark, d), _skips(spark, d)
    plan = replace.id_replace_plan(fx.hashed(spark, d)).filter("replaced")
    copies = delta.copy_changed_plan(fx.mid_times(spark, d), _dst(spark, d))
    return report.run_summary(found, groups, mips.mip_patch_plan(groups), plan, copies, found.filter("status = 'ineligible'"))


@_query("e1_run_incremental", """
SELECT (SELECT count(*) FROM delta WHERE status = 'new') AS new, (SELECT count(*) FROM delta WHERE status = 'updated') AS updated, (SELECT count(*) FROM skips WHERE skip) AS groups_skipped,
  (SELECT count(*) FROM g0 WHERE max_mip - min_mip + 1 <> n_mips) AS groups_with_gaps, (SELECT count(*) FROM skips s JOIN members m USING (gid) WHERE NOT s.skip AND m.rel_path <> s.base) AS mips_patched,
  (SELECT count(*) FROM best WHERE hamming <= 6) AS ids_replaced, count(*) + (SELECT count(*) FROM files) AS files_copied, (SELECT count(*) FROM delta WHERE status = 'ineligible') AS errors
FROM (SELECT rel_path, max(CASE WHEN side = 'new' THEN mtime_ns END) AS a, max(CASE WHEN side = 'old' THEN mtime_ns END) AS b FROM (
  SELECT 'new' AS side, rel_path, mtime_ns FROM delta WHERE status IN ('new', 'updated') UNION ALL SELECT 'old', rel_path, mtime_ns FROM mid) GROUP BY rel_path) x
LEFT JOIN dst USING (rel_path) WHERE dst.rel_path IS NULL OR dst.mtime_ns <> coalesce(a, b)""", fx.DUMPS, _DST, fx.MIPS, _MANIFEST, fx.TEXTURES, _CANDIDATES)
def e1_run_incremental(spark, d):
    """Dumps against a snapshot that has mip chains, with the mip manifest of a run before, ID replacement, and files that can't be staged as errors."""
    columns = ["rel_path", "dir", "name", "stem", "ext", "mtime_ns", "size"]
    mid = fx.mid_times(spark, d).select(*columns).unionByName(fx.mip_files(spark, d).select(*columns))
    wrong = _delta(spark, d).filter("status = 'ineligible'").select("rel_path", F.col("status").alias("message"))
    return run_incremental(fx.dumps(spark, d), mid, _dst(spark, d), fx.hashed(spark, d), _old_groups(_state(spark, d)), errors=wrong).summary
