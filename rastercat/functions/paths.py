"""Columns from image paths: parts, eligibility, mip numbers, ID keys and report names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Image extensions, cache file names and words that mark an error line.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tga", ".webp")
CACHE_FILES = (".mipcache.json", ".idhashcache.json")
ERROR_WORDS = ("error", "failed", "invalid", "exception", "unable", "not found", "denied")

MIP = r"(?is)\A(.*)-mip([0-9]+)(.*)\z"
NAME_LIMIT = 180


def normalised_path(path: Column) -> Column:
    """Forward slashes, whatever system wrote the path."""
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"(?s)/[^/]*\z", "")).otherwise(F.lit(""))


def extension(name: Column) -> Column:
    """The last dot and what follows; none for names that only begin or end with a dot."""
    return F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def with_path_parts(df: DataFrame, col: str = "rel_path") -> DataFrame:
    """df with dir, name, stem and ext."""
    name = file_name(F.col(col))
    return df.withColumns({"dir": directory(F.col(col)), "name": name, "stem": stem(name), "ext": extension(name)})


def is_image(ext: Column) -> Column:
    return F.lower(ext).isin(*IMAGE_EXTENSIONS)


def is_eligible(stem: Column) -> Column:
    """At least two dashes."""
    return F.length(stem) - F.length(F.replace(stem, F.lit("-"), F.lit(""))) >= 2


def is_mip(stem: Column) -> Column:
    return stem.rlike(MIP)


def mip_number(stem: Column) -> Column:
    """The number after the last '-mip'; null for other stems and for numbers beyond a long."""
    return F.regexp_extract(stem, MIP, 2).try_cast("bigint")


def mip_prefix(stem: Column) -> Column:
    return F.regexp_extract(stem, MIP, 1)


def mip_suffix(stem: Column) -> Column:
    return F.regexp_extract(stem, MIP, 3)


def with_mip_keys(df: DataFrame) -> DataFrame:
    """df(dir, stem, ext) with prefix, mip, suffix, mip_key, base_name and gid; only of mip files."""
    ext = F.lower("ext")
    parts = df.withColumns({"prefix": mip_prefix(F.col("stem")), "mip": mip_number(F.col("stem")), "suffix": mip_suffix(F.col("stem"))})
    keyed = parts.withColumns({"mip_key": F.concat("prefix", F.lit("__"), "suffix"), "base_name": F.concat("prefix", "suffix", ext)})
    return keyed.withColumn("gid", F.concat_ws("|", "dir", "mip_key", ext))


def id_key(stem: Column) -> Column:
    """The second dash segment, which may be empty; null without a dash."""
    return F.get(F.split(stem, "-", -1), F.lit(1))


def is_cache_file(name: Column) -> Column:
    return name.isin(*CACHE_FILES)


def drop_cache_files(df: DataFrame) -> DataFrame:
    return df.filter(~is_cache_file(F.col("name")))


def composite_name(low_stem: Column, high_stem: Column) -> Column:
    """The report's file name of a pair, cut when it is long."""
    full = F.concat(low_stem, F.lit("__VS__"), high_stem, F.lit(".png"))
    return F.when(F.length(full) > NAME_LIMIT, F.concat(F.substring(full, 1, NAME_LIMIT), F.lit(".png"))).otherwise(full)


def is_error_line(line: Column) -> Column:
    text = F.lower(F.trim(line))
    found = F.lit(False)
    for word in ERROR_WORDS:
        found = found | text.contains(word)
    return found
