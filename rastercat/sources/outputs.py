"""Results to files: the match report, and planned contents to a snapshot."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastercat.operators import report


def write_matches_csv(matches: DataFrame, path: str) -> None:
    report.matches_table(matches).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def planned_contents(plan: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, failed): rel_path, mtime_ns and content of each planned file from contents(rel_path, mtime_ns, content); plans without a source fail."""
    wanted = plan.select("src_path").distinct()
    # Only contents that are planned move; where the plan is small, and Spark sends it to them, no others are dealt.
    sources = contents.select(F.col("rel_path").alias("src_path"), "mtime_ns", "content").join(wanted, "src_path", "left_semi")
    joined = plan.join(sources, "src_path", "left")
    rows = joined.filter("content is not null").select(F.col("dst_path").alias("rel_path"), "mtime_ns", "content")
    failed = joined.filter("content is null").select(F.col("dst_path").alias("rel_path"), F.concat(F.lit("no source "), F.col("src_path")).alias("message"))
    return rows, failed


def apply_sync_to_folder(plan: DataFrame, contents: DataFrame, folder: str) -> DataFrame:
    """Write the planned files below a folder that all executors mount, at once; returns (rel_path, message) of failures. Others go on.

    Writing a file again, as after the loss of an executor, gives the same file.
    """
    rows, failed = planned_contents(plan, contents)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wrong = []
            for path, mtime, content in zip(batch["rel_path"], batch["mtime_ns"], batch["content"], strict=True):
                try:
                    to = os.path.join(folder, path)
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    with open(f"{to}.part", "wb") as f:
                        f.write(content)
                    os.utime(f"{to}.part", ns=(int(mtime), int(mtime)))
                    os.replace(f"{to}.part", to)
                except OSError as e:
                    wrong.append((path, str(e)))
            yield pd.DataFrame(wrong, columns=["rel_path", "message"])

    wrong = rows.mapInPandas(write, "rel_path string, message string").persist()
    wrong.count()
    return failed.unionByName(wrong)
