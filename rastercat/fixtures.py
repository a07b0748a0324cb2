"""Stand-in catalogues over star-schema tables, and the same in SQL: inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastercat.functions import hashing, paths
from rastercat.operators import similarity

DIMS = ["rel_path", "name", "stem", "ext", "id_key", "width", "height", "max_dim", "area"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as 8 x 8 gray planes: tex_id, label, px, and a catalogue row's columns."""
    q = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "transform(embedding, e -> CAST(greatest(0, least(255, floor(CAST(e AS DOUBLE) * 256 + 128))) AS BIGINT)) AS px")
    large = q.selectExpr("vec_id * 4 AS tex_id", "label", "256 * shiftleft(1, CAST(vec_id % 4 AS INT)) AS width", "256 * shiftleft(1, CAST((vec_id DIV 4) % 3 AS INT)) AS height", "px")
    twin = q.filter("vec_id % 10 = 0").selectExpr("vec_id * 4 + 1 AS tex_id", "label", "1024 AS width", "1024 AS height", "px")
    small = q.filter("vec_id % 2 = 0").selectExpr(
        "vec_id * 4 + 2 AS tex_id", "label", "64 * shiftleft(1, CAST(vec_id % 2 AS INT)) AS width", "128 AS height", "transform(px, (p, i) -> CASE WHEN i + 1 <= vec_id % 12 THEN 255 - p ELSE p END) AS px"
    )
    name = F.concat(F.lit("tex-"), F.col("label").cast("string"), F.lit("-"), F.lpad(F.col("tex_id").cast("string"), 8, "0"), F.lit(".png"))
    rows = large.union(twin).union(small).withColumn("name", name).withColumn("rel_path", F.col("name"))
    rows = rows.withColumns({"stem": paths.stem(F.col("name")), "ext": paths.extension(F.col("name"))}).withColumn("id_key", paths.id_key(F.col("stem")))
    return similarity.with_dims(rows)


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = textures(spark, sf_dir)
    return rows.select("tex_id", *DIMS, F.lit(8).alias("hash_size"), hashing.average_hash(F.col("px")).alias("hash_words"))


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of dumped images: rel_path, parts, o_orderkey, mtime_ns and size."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "concat('d', o_custkey % 10, '/', CASE WHEN o_orderkey % 13 = 0 THEN concat('one-', o_orderkey) ELSE concat('tex-', o_custkey, '-', o_orderkey) END,"
        " CASE WHEN o_orderkey % 17 = 0 THEN '.PNG' WHEN o_orderkey % 19 = 0 THEN '.txt' ELSE '.png' END) AS rel_path",
        "o_orderkey",
        "unix_micros(CAST(o_orderdate AS TIMESTAMP)) * 1000 AS mtime_ns",
        "o_custkey AS size",
    )
    return paths.with_path_parts(rows)


def mid_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that dumps are compared with: rel_path, o_orderkey, parts, mtime_ns, size."""
    times = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o_orderkey", "unix_micros(CAST(l_shipdate AS TIMESTAMP)) * 1000 AS t").groupBy("o_orderkey").agg(F.max("t").alias("mid_ns"))
    return dumps(spark, sf_dir).join(times, "o_orderkey").withColumn("mtime_ns", F.col("mid_ns")).drop("mid_ns")


def with_cache_files(df: DataFrame) -> DataFrame:
    """A third kind of file: every 23rd order is a cache file."""
    name = F.when(F.col("o_orderkey") % 46 == 0, F.lit(".mipcache.json")).when(F.col("o_orderkey") % 23 == 0, F.lit(".idhashcache.json")).otherwise(F.col("name"))
    return df.withColumn("name", name)


def mip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mip chains: several files of one name stand for colliding numbers; their scan order is rel_path."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS BIGINT) AS size", "unix_micros(CAST(l_shipdate AS TIMESTAMP)) * 1000 AS mtime_ns")
    one = rows.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("size").alias("size"), F.max("mtime_ns").alias("mtime_ns"))
    one = one.selectExpr(
        "concat('d', l_orderkey % 7) AS dir",
        "concat('t-', l_orderkey, '-s', CASE WHEN l_linenumber = 1 THEN '' ELSE concat('-mip', l_linenumber - 1) END, '.png') AS name",
        "l_partkey", "l_suppkey", "l_orderkey", "size", "mtime_ns",
    )
    pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    rows = one.withColumn("rel_path", F.concat_ws("/", "dir", pad("l_partkey"), pad("l_suppkey"), "name"))
    return rows.withColumns({"stem": paths.stem(F.col("name")), "ext": paths.extension(F.col("name"))})


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id AS run_id",
        "CASE event_type WHEN 'error' THEN concat('Decode FAILED for tile ', event_id) WHEN 'signup' THEN 'model Not Found'"
        " ELSE concat(event_type, ' ', event_id % 100, '%') END AS line",
    )


def stamped(rows: DataFrame) -> DataFrame:
    """Textures with the times and sizes that the hash manifest knows."""
    return rows.withColumns({"mtime_ns": F.col("tex_id") * 1000, "size": F.col("area")})


def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most textures' hashes, some of them stale or broken, and files that are gone."""
    rows = stamped(hashed(spark, sf_dir)).filter("tex_id % 5 <> 0")
    text = F.when(F.col("tex_id") % 13 == 0, F.lit("nothex")).otherwise(hashing.hash_to_hex(F.col("hash_words")))
    there = rows.select(
        "rel_path", "mtime_ns", F.when(F.col("tex_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        text.alias("hash"), F.when(F.col("tex_id") % 11 == 0, F.lit(16)).otherwise(F.lit(8)).alias("hash_size"),
    )
    gone = rows.filter("tex_id % 3 = 0").select(F.concat(F.lit("gone-"), "rel_path").alias("rel_path"), "mtime_ns", "size", F.lit("0").alias("hash"), F.lit(8).alias("hash_size"))
    return there.union(gone)


# --- the same in DuckDB's SQL ------------------------------------------------------------------------

_NAME_PARTS = "regexp_extract({n}, '^.+(\\.[^.]+)$', 1) AS ext, left({n}, length({n}) - length(regexp_extract({n}, '^.+(\\.[^.]+)$', 1))) AS stem"

TEXTURES = f"""
q AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor(CAST(e AS DOUBLE) * 256 + 128))) AS BIGINT)) AS px FROM embeddings),
t0 AS (
  SELECT vec_id*4 AS tex_id, label, CAST(256*(1 << CAST(vec_id%4 AS INT)) AS INT) AS width, CAST(256*(1 << CAST((vec_id//4)%3 AS INT)) AS INT) AS height, px FROM q
  UNION ALL SELECT vec_id*4+1, label, 1024, 1024, px FROM q WHERE vec_id%10=0
  UNION ALL SELECT vec_id*4+2, label, CAST(64*(1 << CAST(vec_id%2 AS INT)) AS INT), 128,
    list_transform(range(1,65), lambda i: CASE WHEN i <= vec_id%12 THEN 255-px[i] ELSE px[i] END) FROM q WHERE vec_id%2=0),
t1 AS (SELECT *, 'tex-' || label || '-' || lpad(CAST(tex_id AS VARCHAR), 8, '0') || '.png' AS name FROM t0),
textures AS (SELECT *, name AS rel_path, {_NAME_PARTS.format(n="name")}, CAST(label AS VARCHAR) AS id_key,
  greatest(width, height) AS max_dim, CAST(width AS BIGINT) * height AS area, CAST(list_sum(px) AS BIGINT) AS total FROM t1),
hashed AS (SELECT *,
  CAST(list_sum(list_transform(range(0,32), lambda i: CASE WHEN px[i+1]*64 >= total THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT) AS w0,
  CAST(list_sum(list_transform(range(0,32), lambda i: CASE WHEN px[i+33]*64 >= total THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT) AS w1 FROM textures)"""

HEX = "CASE WHEN w0 = 0 AND w1 = 0 THEN '0' ELSE ltrim(format('{:08x}{:08x}', w1, w0), '0') END"


def distance(a: str, b: str) -> str:
    return f"CAST(bit_count(xor({a}.w0, {b}.w0)) + bit_count(xor({a}.w1, {b}.w1)) AS INT)"


DUMPS = f"""
d0 AS (SELECT 'd' || (o_custkey % 10) || '/' || CASE WHEN o_orderkey % 13 = 0 THEN 'one-' || o_orderkey ELSE 'tex-' || o_custkey || '-' || o_orderkey END ||
  CASE WHEN o_orderkey % 17 = 0 THEN '.PNG' WHEN o_orderkey % 19 = 0 THEN '.txt' ELSE '.png' END AS rel_path,
  o_orderkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) * 1000 AS mtime_ns, o_custkey AS size FROM orders),
dumps AS (SELECT *, regexp_replace(rel_path, '/[^/]*$', '') AS dir, regexp_extract(rel_path, '[^/]*$') AS name,
  {_NAME_PARTS.format(n="regexp_extract(rel_path, '[^/]*$')")} FROM d0),
mid AS (SELECT d.* EXCLUDE (mtime_ns), m.t AS mtime_ns FROM dumps d JOIN
  (SELECT l_orderkey, max(epoch_us(CAST(l_shipdate AS TIMESTAMP)) * 1000) AS t FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = d.o_orderkey),
delta AS (SELECT d.*, CASE WHEN length(d.stem) - length(replace(d.stem, '-', '')) < 2 THEN 'ineligible' WHEN m.rel_path IS NULL THEN 'new'
  WHEN d.mtime_ns > m.mtime_ns THEN 'updated' ELSE 'up_to_date' END AS status
  FROM dumps d LEFT JOIN mid m ON m.rel_path = d.rel_path WHERE lower(d.ext) IN ('.png', '.jpg', '.jpeg', '.bmp', '.tga', '.webp'))"""

MIPS = f"""
m0 AS (SELECT 'd' || (l_orderkey % 7) AS dir, 't-' || l_orderkey || '-s' || CASE WHEN l_linenumber = 1 THEN '' ELSE '-mip' || (l_linenumber - 1) END || '.png' AS name,
  l_partkey, l_suppkey, l_orderkey, max(CAST(l_quantity AS BIGINT)) AS size, max(epoch_us(CAST(l_shipdate AS TIMESTAMP)) * 1000) AS mtime_ns
  FROM lineitem GROUP BY ALL),
files AS (SELECT *, dir || '/' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '/' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '/' || name AS rel_path, {_NAME_PARTS.format(n="name")} FROM m0),
parsed AS (SELECT *, regexp_extract(stem, '(?i)^(.*)-mip([0-9]+)(.*)$', 1) AS prefix, CAST(regexp_extract(stem, '(?i)^(.*)-mip([0-9]+)(.*)$', 2) AS BIGINT) AS mip,
  regexp_extract(stem, '(?i)^(.*)-mip([0-9]+)(.*)$', 3) AS suffix FROM files WHERE regexp_matches(stem, '(?i)^(.*)-mip([0-9]+)(.*)$')),
keyed AS (SELECT *, prefix || '__' || suffix AS mip_key, prefix || suffix || ext AS base_name, dir || '|' || prefix || '__' || suffix || '|' || ext AS gid FROM parsed),
members AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY gid, mip ORDER BY rel_path DESC) = 1),
g0 AS (SELECT gid, dir, base_name, count(*) AS n_mips, min(mip) AS min_mip, max(mip) AS max_mip, arg_min(rel_path, mip) AS first_path FROM members GROUP BY ALL),
groups AS (SELECT g0.*, coalesce(f.found, first_path) AS base FROM g0 LEFT JOIN
  (SELECT dir, name, min(rel_path) AS found FROM files GROUP BY ALL) f ON f.dir = g0.dir AND f.name = g0.base_name),
state AS (SELECT groups.*, f.mtime_ns AS base_mtime, f.size AS base_size FROM groups LEFT JOIN files f ON f.rel_path = base)"""

LOGS = """
lines AS (SELECT event_id, user_id AS run_id, CASE event_type WHEN 'error' THEN 'Decode FAILED for tile ' || event_id WHEN 'signup' THEN 'model Not Found'
  ELSE event_type || ' ' || CAST(event_id % 100 AS VARCHAR) || '%' END AS line FROM events)"""
