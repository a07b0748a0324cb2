"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions alone.

Every source gets a token target: its weight's share of all words, but at most ``MOST`` times its own
size, the excess going to the others by weight. Its documents stand in hashed order on a line of
words, which is run through as often as the target needs. The source's weight changes over the
training run t in [0, 1] as 1 + tilt * (2 t - 1); integrated and scaled this is the cumulative word
demand target * (t + tilt * (t * t - t)), and its inverse at a document's place on the line is the
document's training position. Documents are range-sorted by position.

Running totals never need a source in one task: documents are dealt to hash buckets of bounded
size, totals run inside each bucket, and one row for each bucket carries the offset. Those rows are
themselves in groups of ``GROUP`` neighbouring buckets, and only one row for each group is summed in
one task.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source that sorts
last; rows with equal doc_id, source and size share one decision; empty tables give empty results;
with no words at all every target is 0. Other columns are carried through by ``mixed``; where docs
has a column of the name of one that ``mixed`` adds, the added one has ``mix_`` before its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastercat.llm.storage import column, stored, unused

WEIGHTS = (5, 2, 1)
TILTS = (-0.5, 0.0, 0.5)
MOST = 3
#: Rows that share a bucket, about.
BUCKET_ROWS = 4096
#: Neighbouring buckets whose totals are summed in one task.
GROUP = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, tilts: tuple = TILTS, most: int = MOST) -> DataFrame:
    """sizes(source_key, source, source_size), one row for each source, with weight, tilt and target.

    With the k sources of least cap per weight at their caps, the others share what is left at one
    level; the right k is the first whose level is within the next source's cap per weight.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    x = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("double"))
    x = x.withColumn("tilt", F.element_at(F.array(*map(F.lit, tilts)), place)).withColumn("cap", most * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    x = x.withColumn("level", left / F.sum("weight").over(onward))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    x = x.withColumn("level", F.max(fits).over(all_rows))
    return x.withColumn("target", F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("cap")), F.lit(0.0))).drop("cap", "level")


def _position(tilt: Column, share: Column) -> Column:
    """The time at which a source has used this share of its demand."""
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)
    return F.when(tilt == 0, share).otherwise((root - (1 - tilt)) / (2 * tilt))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, tilts: tuple = TILTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each (doc_id, source, size): n_rows, source_size, target, copies, taken, positions (one a copy), position (the first)."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows"))
    rows = stored(rows.withColumn("source_key", _key(F.col("source"))).withColumn("h", F.xxhash64("doc_id", "size")), "sizes")
    sizes = rows.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n"))
    sources = stored(targets(sizes, weights, tilts, most), "targets")
    most_rows = sources.agg(F.max("n")).first()[0] or 1
    bits = max(1, math.ceil(math.log2(max(2, most_rows / bucket_rows))))

    rows = rows.withColumn("bucket", F.shiftrightunsigned(F.col("h"), 64 - bits))
    bucketed = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = F.col("size") * F.col("n_rows")
    inside = rows.withColumn("start", F.sum(block).over(bucketed) - block)
    along = lambda *by: Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = rows.groupBy("source_key", "bucket").agg(F.sum(block).alias("total")).withColumn("group", F.shiftright("bucket", int(math.log2(GROUP))))
    groups = buckets.groupBy("source_key", "group").agg(F.sum("total").alias("all"), F.min("bucket").alias("bucket"))
    groups = groups.select("source_key", "group", (F.sum("all").over(along("source_key")) - F.col("all")).alias("before"))
    buckets = buckets.withColumn("inside", F.sum("total").over(along("source_key", "group")) - F.col("total")).join(groups, ["source_key", "group"])
    offsets = buckets.select("source_key", "bucket", (F.col("before") + F.col("inside")).alias("offset"))
    placed = inside.join(offsets, ["source_key", "bucket"]).join(sources.select("source_key", "source_size", "target", "tilt"), "source_key")

    # Copy e stands at e * source_size + place and is taken if its middle is inside the target.
    place = F.col("offset") + F.col("start")
    copies = F.when((F.col("size") == 0) | (F.col("source_size") == 0), 0).otherwise(
        F.least(F.lit(most), F.greatest(F.lit(0), F.ceil((F.col("target") - place - block / 2) / F.col("source_size"))))
    )
    placed = placed.withColumn("place", place).withColumn("copies", copies.cast("int"))
    share = lambda e: F.least(F.lit(1.0), (e * F.col("source_size") + F.col("place")) / F.col("target"))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: _position(F.col("tilt"), share(e)))).otherwise(F.array().cast("array<double>"))
    return placed.select(
        "doc_id", "source", "size", "n_rows", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), positions.alias("positions")
    ).withColumn("position", F.get("positions", F.lit(0)))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents taken, with all their columns and size, source_size, target, copies, taken, positions and position, in order of their first position."""
    new = ["size", "source_size", "target", "copies", "taken", "positions", "position"]
    taken = {c.lower() for c in docs.columns}
    names = {c: c if c not in taken else next(n for k in range(1, 99) if (n := "mix_" * k + c) not in taken) for c in new}
    (size,) = unused(docs, "size")
    decisions = stored(plan(docs.select("doc_id", "source", "text"), **options).filter("copies > 0").drop("n_rows"), "mix")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col(f"d.{column(size)}") == F.col("m.size"))
    joined = docs.withColumn(size, n_words(F.col("text"))).alias("d").join(decisions.alias("m"), same)
    out = joined.select(*(F.col(f"d.{column(c)}") for c in docs.columns), *(F.col(f"m.{c}").alias(names[c]) for c in new))
    return out.orderBy(names["position"], "doc_id")


def op8_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it, in training order."""
    made = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = made.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return each.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")
