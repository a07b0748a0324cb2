"""Counts and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastercat.functions import paths
from rastercat.operators import mips, similarity


def run_status(lines: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Per run_id of lines(run_id, line): n_lines, n_errors and status: the return code if it isn't 0, else 1 after any error line."""
    runs = lines.groupBy("run_id").agg(F.count("*").alias("n_lines"), F.count_if(paths.is_error_line(F.col("line"))).alias("n_errors"))
    code = F.lit(0)
    if codes is not None:
        runs, code = runs.join(codes.select("run_id", "code"), "run_id", "left"), F.coalesce("code", F.lit(0))
    return runs.withColumn("status", F.when(code != 0, code).when(F.col("n_errors") > 0, 1).otherwise(0)).drop("code")


def id_group_profile(hashed: DataFrame, small: int = 256, large: int = 256) -> DataFrame:
    sized = similarity.classify_size(hashed, small, large)
    out = sized.groupBy("id_key").agg(F.count("*").alias("n"), F.count_if("is_large").alias("n_large"), F.count_if("is_small").alias("n_small"))
    return out.withColumn("usable", (F.col("n_large") > 0) & (F.col("n_small") > 0))


def audit_summary(hashed: DataFrame, matches: DataFrame, base_size: int = 1024) -> DataFrame:
    """One row: loaded, high, low, matches."""
    most = F.greatest("width", "height")
    images = hashed.agg(F.count("*").alias("loaded"), F.count_if(most >= base_size).alias("high"), F.count_if(most < base_size).alias("low"))
    return _side_by_side(images, matches.agg(F.count("*").alias("matches")))


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row tables as one row."""
    keyed = [r.withColumn("__k", F.lit(1)) for r in rows]
    return reduce(lambda a, b: a.join(b, "__k"), keyed).drop("__k")


def run_summary(delta: DataFrame, mip_groups: DataFrame, patches: DataFrame, replacements: DataFrame, copies: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row for a run: what each step did. mip_groups has skip, n_mips, min_mip and max_mip."""
    changed = delta.agg(F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "updated").alias("updated"))
    groups = mip_groups.agg(F.count_if("skip").alias("groups_skipped"), F.count_if(mips.has_gaps()).alias("groups_with_gaps"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    failed = one(errors, "errors") if errors is not None else changed.select(F.lit(0).cast("bigint").alias("errors"))
    return _side_by_side(changed, groups, one(patches, "mips_patched"), one(replacements, "ids_replaced"), one(copies, "files_copied"), failed)


def matches_table(matches: DataFrame) -> DataFrame:
    """The columns of the match report; diff with three decimals, or empty."""
    diff = F.when(F.col("diff").isNull(), F.lit("")).otherwise(F.format_string("%.3f", F.bround("diff", 3)))
    return matches.select("low_name", "low_w", "low_h", "high_name", "high_w", "high_h", "hamming", diff.alias("diff"))


def gallery_index(matches: DataFrame) -> DataFrame:
    """The table behind a gallery page."""
    name = paths.composite_name(paths.stem(F.col("low_name")), paths.stem(F.col("high_name")))
    return matches.select(name.alias("composite"), "low_path", "high_path", "hamming", "diff")


def quarantine(**stages: DataFrame) -> DataFrame:
    """(rel_path, stage, message) of each stage's failed rows(rel_path, message)."""
    parts = [df.select("rel_path", F.lit(stage).alias("stage"), "message") for stage, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def final_status(failed: DataFrame) -> DataFrame:
    return failed.agg(F.count("*").alias("errors")).withColumn("status", F.when(F.col("errors") > 0, "completed with errors").otherwise("completed"))
