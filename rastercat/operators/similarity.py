"""Hamming similarity of hashed images: within ID groups, globally, by bands, and top-k.

``hashed`` has rel_path, name, stem, width, height, max_dim, area, hash_size and hash_words. Equal
hashes are the skew of these joins (all single-colour images share one), so both sides are reduced
to distinct hashes first and expanded after the join.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastercat.functions import hashing, paths
from rastercat.sources.scratch import stored

#: Narrower bands let nearly everything through; then distinct hashes are compared in a grid of blocks.
LEAST_BAND_BITS = 6
#: Hashes on either side of a block, about.
BLOCK = 20_000
#: Rows on either side of a cell of listed pairs, about: what a merge join keeps in memory as it is.
CELL = 3500
#: Tasks that cells are dealt to at most; of more cells, a task gets several, one after another.
MOST_TASKS = 10_000
#: Ways to turn bits of a band in one step at most.
MASKS = 2000
#: Comparisons that take as long as a joined row.
JOINED = 500
#: So many blocks are compared at once, without a search: a block takes a task about half a second.
FEW = 16
#: Least distances of a row that are found by scanning it; more are by a partial sort.
SCANS = 256


def with_dims(df: DataFrame) -> DataFrame:
    """max_dim and area of width and height."""
    return df.withColumns({"max_dim": F.greatest("width", "height"), "area": F.col("width").cast("bigint") * F.col("height")})


def classify_resolution(df: DataFrame, base_size: int = 1024) -> DataFrame:
    return df.withColumn("resolution", F.when(F.greatest("width", "height") >= base_size, "high").otherwise("low"))


def classify_size(df: DataFrame, small: int = 256, large: int = 256) -> DataFrame:
    """is_small below ``small``, is_large from ``large`` on; a row can be both or neither."""
    most = F.greatest("width", "height")
    return df.withColumns({"is_small": most < small, "is_large": most >= large})


def ordered_highs(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("max_dim").desc(), "name", "rel_path")


def ordered_lows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """By name; the first ``limit`` (None or 0: all, unsorted)."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    return df.orderBy("name", "rel_path").limit(limit) if limit else df


# --- distance joins ------------------------------------------------------------------------------------


def hamming_join(left: DataFrame, right: DataFrame, threshold: int, hash_size: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (l_words, r_words, *by, hamming) of distinct hashes within the threshold, and of one value of ``by``.

    The bits are split in threshold + 1 bands: hashes within the threshold agree in one of them, so
    an equi-join on (band number, band value, *by) misses none. Where bands would be too narrow, all
    pairs are compared in a grid of blocks, and only those within the threshold leave it.
    """
    hashing.check_threshold(threshold, hash_size)
    left, right = (side.select("hash_words", *by).distinct() for side in (left, right))
    if hash_size * hash_size // (threshold + 1) < LEAST_BAND_BITS:
        sides = left.withColumnRenamed("hash_words", "l_words"), right.withColumnRenamed("hash_words", "r_words")
        return _grid(*sides, by, (), hash_size, within=threshold).select("l_words", "r_words", *by, "hamming")

    def banded(side: DataFrame, name: str) -> DataFrame:
        values = hashing.bands(F.col("hash_words"), threshold, hash_size)
        return side.select(F.col("hash_words").alias(name), *by, F.posexplode(F.array(*values)).alias("band", "value"))

    pairs = banded(left, "l_words").join(banded(right, "r_words"), ["band", "value", *by])
    near = pairs.withColumn("hamming", hashing.hamming(F.col("l_words"), F.col("r_words"), hash_size)).filter(F.col("hamming") <= threshold)
    return near.select("l_words", "r_words", *by, "hamming").distinct()


def _packed(words: pa.ChunkedArray, hash_size: int) -> np.ndarray:
    """Hashes as numbers of 64 bits: a row for each two words, a column for each hash."""
    n = hashing.n_words(hash_size)
    flat = words.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.uint64)
    flat = np.pad(flat, ((0, 0), (0, n % 2)))
    return (flat[:, 0::2] | flat[:, 1::2] << np.uint64(32)).T.copy()


def _distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances of some rows of a to all of b): as many rows at once as a processor's cache holds."""
    step = max(1, 160_000 // max(1, b.shape[1]))
    for first in range(0, a.shape[1], step):
        own = a[:, first : first + step, None]
        d = np.bitwise_count(own[0] ^ b[0])
        for k in range(1, len(a)):
            d = d.astype(np.uint16) + np.bitwise_count(own[k] ^ b[k])
        yield first, d


def _first_of(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, distances) of the k least of each row; of equal ones the first. d is written to."""
    rows, many = np.arange(len(d)), d.shape[1]
    if k >= many:
        return np.tile(np.arange(many), (len(d), 1)), d
    if k > SCANS:
        j = np.argpartition(d.astype(np.int64) * many + np.arange(many), k - 1, axis=1)[:, :k]
        return j, d[rows[:, None], j]
    j, least = np.empty((len(d), k), np.int64), np.empty((len(d), k), d.dtype)
    for n in range(k):
        j[:, n] = d.argmin(1)
        least[:, n] = d[rows, j[:, n]]
        d[rows, j[:, n]] = np.iinfo(d.dtype).max
    return j, least


def _dealt(left: DataFrame, right: DataFrame, by: tuple[str, ...], keys: tuple[str, str], block: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with their cell of a grid, and the cell's columns: rows and columns of ``block`` rows of a group, about, dealt by the hash of their key.

    Both are dealt to as many partitions as there are cells: cells are small as tables, so by size alone a few tasks would get all.
    """
    many = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    if by:
        sizes = left.groupBy(*by).agg(F.count("*").alias("l")).join(right.groupBy(*by).agg(F.count("*").alias("r")), list(by))
        # Stored, so that the joins below are plain ones, whose large keys adaptive execution can split.
        grid = stored(sizes.select(*by, many(F.col("l")).alias("__rows"), many(F.col("r")).alias("__columns")), "grid")
        left, right = (side.join(grid, list(by)) for side in (left, right))
        cells = grid.agg(F.sum(F.col("__rows").cast("bigint") * F.col("__columns"))).first()[0] or 1
    else:
        rows, columns = (max(1, -(-side.count() // block)) for side in (left, right))
        left, right = (side.withColumns({"__rows": F.lit(rows), "__columns": F.lit(columns)}) for side in (left, right))
        cells = rows * columns
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.withColumn("__row", one(keys[0], "__rows")).withColumn("__column", each("__columns")).drop("__rows", "__columns")
    right = right.withColumn("__column", one(keys[1], "__columns")).withColumn("__row", each("__rows")).drop("__rows", "__columns")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own, where both sides come from one table
    cell = [*by, "__row", "__column"]
    return *(side.repartition(min(cells, MOST_TASKS), *cell) for side in (left, right)), cell


def _grid(left: DataFrame, right: DataFrame, by: tuple[str, ...], order: tuple[str, ...], hash_size: int, k: int | None = None, within: int | None = None, block: int = BLOCK) -> DataFrame:
    """(*by, l_words, r_words, *order, hamming) of pairs of left(*by, l_words) and right(*by, r_words, *order) rows of one value of ``by``.

    With ``k``, each left row's k least right rows by (hamming, *order) in every block that it is in, so
    the k least of all are among them; with ``within``, every pair within that distance. Both sides of
    a group are dealt to a grid of blocks of bounded size, and a task holds one block: nothing goes
    through the driver, and a very large group is many blocks.
    """
    left, right, cell = _dealt(left.select(*by, "l_words"), right.select(*by, "r_words", *order), by, ("l_words", "r_words"), block)

    def compared(lows: pa.Table, highs: pa.Table) -> pa.Table:
        fields = [*(lows.schema.field(c) for c in (*by, "l_words")), *(highs.schema.field(c) for c in ("r_words", *order)), pa.field("hamming", pa.int32())]
        if not lows.num_rows or not highs.num_rows:
            return pa.schema(fields).empty_table()
        if order:  # it breaks ties
            highs = highs.take(pc.sort_indices(highs.select(order), [(c, "ascending") for c in order], null_placement="at_start"))
        low, high, distance = [], [], []
        for first, d in _distances(_packed(lows["l_words"], hash_size), _packed(highs["r_words"], hash_size)):
            if within is not None:
                i, j = np.nonzero(d <= within)
                least = d[i, j]
            else:
                j, least = _first_of(d, k)
                i = np.repeat(np.arange(len(d)), j.shape[1])
            low.append(i + first)
            high.append(j.ravel())
            distance.append(least.ravel().astype(np.int32))
        low, high = lows.take(pa.array(np.concatenate(low))), highs.take(pa.array(np.concatenate(high)))
        return pa.Table.from_arrays([*(low[c] for c in (*by, "l_words")), *(high[c] for c in ("r_words", *order)), pa.array(np.concatenate(distance))], schema=pa.schema(fields))

    types = {f.name: f.dataType.simpleString() for side in (left, right) for f in side.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*by, "l_words", "r_words", *order)) + ", hamming int"
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compared, schema)


# --- nearest, exactly --------------------------------------------------------------------------------


def nearest(left: DataFrame, right: DataFrame, by: tuple[str, ...], order: tuple[str, ...], hash_size: int, k: int, block: int = BLOCK) -> DataFrame:
    """(*by, l_words, r_words, *order, hamming): the k least right(*by, r_words, *order) rows of each left(*by, l_words) row, by (hamming, *order), whatever the distance.

    Bits are cut into bands about as wide as the number of right hashes of a group needs. Two hashes that differ in fewer than
    bands * (s + 1) bits differ in s bits at most of one band. So step s joins on bands with exactly s bits turned, the least k
    so far are kept, and a left hash whose k-th is that near is done: later steps see only what is left. Where turning more bits
    would cost as much as comparing, the rest goes to a grid of blocks; so do sides that are a few blocks. The ways to turn
    bits are rows of a broadcast table: as columns, the plan of two turned bits took more memory than a driver has.
    """
    left, right = stored(left, "nearest-left"), stored(right, "nearest-right")
    n_left = left.count()
    if by:
        sizes = left.groupBy(*by).agg(F.count("*").alias("l")).join(right.groupBy(*by).agg(F.count("*").alias("r")), list(by))
        pairs = sizes.agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0
    else:
        pairs = n_left * right.count()
    if pairs <= FEW * block * block:
        return _least(_grid(left, right, by, order, hash_size, k=k, block=block), by, order, k)
    met_by_each, bits = pairs / n_left, hash_size * hash_size
    bands = max(1, bits // max(LEAST_BAND_BITS, min(31, math.ceil(math.log2(met_by_each)))))
    cut = hashing.band_numbers(F.col("r_words"), bands, hash_size)
    entries = F.array(*(value for value, _ in cut))
    sides = right.select(*by, "r_words", *order, F.posexplode(entries).alias("__band", "__value"))
    crowd = max(1.0, met_by_each / 2 ** min(width for _, width in cut))
    best, waiting, done = None, left, []
    for turned in range(min(width for _, width in cut) + 1):
        ways = [math.comb(width, turned) for _, width in cut]
        if max(ways) > MASKS or JOINED * sum(ways) * crowd > met_by_each:
            break
        masks = [(band, sum(1 << i for i in some)) for band, (_, width) in enumerate(cut) for some in itertools.combinations(range(width), turned)]
        turns = F.broadcast(left.sparkSession.createDataFrame(masks, "__band int, __mask bigint"))
        own = F.array(*(value for value, _ in hashing.band_numbers(F.col("l_words"), bands, hash_size)))
        asked = waiting.select(*by, "l_words", F.posexplode(own).alias("__band", "__own")).join(turns, "__band")
        asked = asked.select(*by, "l_words", "__band", F.col("__own").bitwiseXOR(F.col("__mask")).alias("__value"))
        met = asked.join(sides, [*by, "__band", "__value"]).select(*by, "l_words", "r_words", *order, hashing.hamming(F.col("l_words"), F.col("r_words"), hash_size).alias("hamming"))
        met = met.distinct() if best is None else met.unionByName(best).distinct()
        best = stored(_least(met, by, order, k), "nearest")
        proved = bands * (turned + 1) - 1
        near = best.filter(F.col("hamming") <= proved).groupBy(*by, "l_words").count().filter(F.col("count") >= k).select(*by, "l_words")
        done.append(best.join(near, [*by, "l_words"], "left_semi"))
        waiting = stored(waiting.join(near, [*by, "l_words"], "left_anti"), "nearest-waiting")
        best = best.join(near, [*by, "l_words"], "left_anti")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, done)
    return reduce(DataFrame.unionByName, done, _least(_grid(waiting, right, by, order, hash_size, k=k, block=block), by, order, k))


def _least(pairs: DataFrame, by: tuple[str, ...], order: tuple[str, ...], k: int) -> DataFrame:
    first = Window.partitionBy(*by, "l_words").orderBy("hamming", *order, "r_words")
    return pairs.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k).drop("__n").select(*by, "l_words", "r_words", *order, "hamming")


# --- within ID groups ----------------------------------------------------------------------------------


def id_candidates(hashed: DataFrame, small: int = 256, large: int = 256, hash_size: int = 8) -> DataFrame:
    """All small x large pairs that share id_key, with their distance; groups that lack a side give none, nor do self-pairs.

    A group is paired in cells of about ``CELL`` rows a side, which are the join's keys: no task gets more of a large
    group than a few cells, and a task keeps one cell's side in memory. Only the result grows with the pairs.
    """
    s, l, cell = _dealt(*_sides(hashed, small, large), ("id_key",), ("small_path", "large_path"), CELL)
    pairs = s.join(l, cell).drop("__row", "__column").filter("small_path <> large_path")
    return pairs.withColumn("hamming", hashing.hamming(F.col("small_words"), F.col("large_words"), hash_size))


def best_candidates(hashed: DataFrame, small: int = 256, large: int = 256, hash_size: int = 8, block: int = BLOCK) -> DataFrame:
    """Of ``id_candidates`` what ``best_large`` may choose, without listing the others: each small's best in every block of its group.

    All pairs are compared, in a grid of blocks of bounded size, a task each; a small image has a row for each block.
    """
    s, l, cell = _dealt(*_sides(hashed, small, large), ("id_key",), ("small_path", "large_path"), block)

    def compared(lows: pa.Table, highs: pa.Table) -> pa.Table:
        fields = [lows.schema.field("id_key"), lows.schema.field("small_path"), highs.schema.field("large_path"), highs.schema.field("area"), pa.field("hamming", pa.int32())]
        if not lows.num_rows or not highs.num_rows:
            return pa.schema(fields).empty_table()
        highs = highs.take(pc.sort_indices(highs, [("area", "descending"), ("large_path", "ascending")], null_placement="at_start"))
        scanned = pc.rank(highs["large_path"], tiebreaker="dense").to_numpy().astype(np.int64)
        both = pc.is_in(lows["small_path"], highs["large_path"].combine_chunks()).to_numpy(zero_copy_only=False)
        names = highs["large_path"].to_numpy() if both.any() else None
        low, high, distance = [], [], []
        for first, d in _distances(_packed(lows["small_words"], hash_size), _packed(highs["large_words"], hash_size)):
            none = np.iinfo(d.dtype).max
            for i in np.flatnonzero(both[first : first + len(d)]):  # no image replaces itself
                d[i, names == lows["small_path"][int(first + i)].as_py()] = none
            j = d.argmin(1)
            least = d[np.arange(len(d)), j]
            if len(same := np.flatnonzero(least == 0)):  # at distance 0 the first scanned wins whatever its area
                j[same] = np.where(d[same] == 0, scanned, len(scanned) + 1).argmin(1)
            found = np.flatnonzero(least < none)
            low.append(found + first)
            high.append(j[found])
            distance.append(least[found].astype(np.int32))
        low, high = lows.take(pa.array(np.concatenate(low))), highs.take(pa.array(np.concatenate(high)))
        return pa.Table.from_arrays([low["id_key"], low["small_path"], high["large_path"], high["area"], pa.array(np.concatenate(distance))], schema=pa.schema(fields))

    types = {f.name: f.dataType.simpleString() for side in (s, l) for f in side.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in ("id_key", "small_path", "large_path", "area")) + ", hamming int"
    return s.groupBy(*cell).cogroup(l.groupBy(*cell)).applyInArrow(compared, schema)


def usable_groups(hashed: DataFrame, small: int = 256, large: int = 256) -> DataFrame:
    """id_key of groups that have both sides: what is worth hashing."""
    sized = classify_size(hashed, small, large)
    return sized.groupBy("id_key").agg(F.count_if("is_small").alias("s"), F.count_if("is_large").alias("l")).filter("s > 0 and l > 0").select("id_key")


def _sides(hashed: DataFrame, small: int, large: int) -> tuple[DataFrame, DataFrame]:
    rows = classify_size(hashed.filter(F.col("id_key").isNotNull() & F.col("hash_words").isNotNull()), small, large)
    s = rows.filter("is_small").select("id_key", F.col("rel_path").alias("small_path"), F.col("hash_words").alias("small_words"))
    l = rows.filter("is_large").select("id_key", F.col("rel_path").alias("large_path"), F.col("hash_words").alias("large_words"), "area")
    return s, l


def best_large(pairs: DataFrame) -> DataFrame:
    """Per small path the best pair: least distance; then, above distance 0, the largest area; then scan order.

    At distance 0 the first scanned wins whatever its area.
    """
    order = F.struct("hamming", F.when(F.col("hamming") == 0, F.lit(0)).otherwise(-F.col("area")).alias("less"), "large_path")
    return pairs.groupBy("small_path").agg(F.min(order).alias("best")).select("small_path", F.col("best.large_path").alias("large_path"), F.col("best.hamming").alias("hamming"))


def best_large_of_distinct(hashed: DataFrame, small: int = 256, large: int = 256, hash_size: int = 8) -> DataFrame:
    """The same result over distinct hashes: of each (id_key, hash) two larges stand for all.

    The first scanned is the one to use at distance 0, the largest (then first scanned) above it. Exact
    where no image is both small and large, that is small <= large. A group is never paired whole in one
    task, however many hashes it has.
    """
    if small > large:
        return best_large(best_candidates(hashed, small, large, hash_size))
    s, l = _sides(hashed, small, large)
    lows = s.select("id_key", F.col("small_words").alias("l_words")).distinct()
    highs = _standing(l).select("id_key", F.col("large_words").alias("r_words"), F.col("largest.less").alias("less"), F.col("largest.large_path").alias("path"), "first_path")
    near = nearest(lows, highs, ("id_key",), ("less", "path", "first_path"), hash_size, 1)
    largest = F.struct("less", F.col("path").alias("large_path")).alias("largest")
    return _expanded(s, near.select("id_key", F.col("l_words").alias("small_words"), "first_path", largest, "hamming"))


def best_large_near(hashed: DataFrame, small: int = 256, large: int = 256, hash_size: int = 8, threshold: int = 6) -> DataFrame:
    """The best pairs that are within the threshold, by bands inside each ID group: for groups too large to pair all their hashes."""
    if small > large:
        return best_large(best_candidates(hashed, small, large, hash_size)).filter(F.col("hamming") <= threshold)
    s, l = _sides(hashed, small, large)
    stands = _standing(l)
    near = hamming_join(s.select("id_key", F.col("small_words").alias("hash_words")), stands.select("id_key", F.col("large_words").alias("hash_words")), threshold, hash_size, by=("id_key",))
    pairs = near.withColumnsRenamed({"l_words": "small_words", "r_words": "large_words"}).join(stands, ["id_key", "large_words"])
    return _expanded(s, pairs)


def _standing(l: DataFrame) -> DataFrame:
    """Of each (id_key, hash) the two larges that can be best: the first scanned, and the largest."""
    return l.groupBy("id_key", "large_words").agg(F.min("large_path").alias("first_path"), F.min(F.struct((-F.col("area")).alias("less"), "large_path")).alias("largest"))


def _expanded(s: DataFrame, pairs: DataFrame) -> DataFrame:
    """The best of each small hash's pairs, for every small image that has the hash."""
    zero = F.col("hamming") == 0
    order = F.struct("hamming", F.when(zero, F.lit(0).cast("bigint")).otherwise(F.col("largest.less")).alias("less"), F.when(zero, F.col("first_path")).otherwise(F.col("largest.large_path")).alias("large_path"))
    best = pairs.groupBy("id_key", "small_words").agg(F.min(order).alias("best"))
    return s.join(best, ["id_key", "small_words"]).select("small_path", F.col("best.large_path").alias("large_path"), F.col("best.hamming").alias("hamming"))


# --- global --------------------------------------------------------------------------------------------


def _low_high(hashed: DataFrame, base_size: int, limit: int | None) -> tuple[DataFrame, DataFrame]:
    rows = hashed.filter(F.col("hash_words").isNotNull() & ~paths.is_mip(F.col("stem")))
    named = lambda side: [F.col(c).alias(f"{side}_{n}") for c, n in (("rel_path", "path"), ("name", "name"), ("width", "w"), ("height", "h"), ("hash_words", "words"))]
    lows = ordered_lows(rows.filter(F.greatest("width", "height") < base_size), limit).select(*named("low"))
    highs = rows.filter(F.greatest("width", "height") >= base_size).select(*named("high"), F.greatest("width", "height").alias("high_dim"))
    return lows, highs


def nearest_high(hashed: DataFrame, base_size: int = 1024, threshold: int = 6, hash_size: int = 8, limit: int | None = None) -> DataFrame:
    """Match rows: per low the closest high, if within the threshold; ties go to the larger, then by name.

    The best within the threshold is the best of all whenever that is a match, so bands find the same.
    Beyond the reach of bands each low's best is searched with a growing radius.
    """
    lows, highs = _low_high(hashed, base_size, limit)
    stands = highs.groupBy("high_words").agg(F.min(F.struct((-F.col("high_dim")).alias("less"), "high_name", "high_path", "high_w", "high_h")).alias("high"))
    hashing.check_threshold(threshold, hash_size)
    bits = hash_size * hash_size
    own = lows.select(F.col("low_words").alias("hash_words")).distinct()
    if bits // (threshold + 1) >= LEAST_BAND_BITS:
        near = hamming_join(own, stands.select(F.col("high_words").alias("hash_words")), threshold, hash_size)
    else:
        order = stands.select(F.col("high_words").alias("r_words"), F.col("high.less").alias("less"), F.col("high.high_name").alias("name"), F.col("high.high_path").alias("path"))
        near = nearest(own.withColumnRenamed("hash_words", "l_words"), order, (), ("less", "name", "path"), hash_size, 1).filter(F.col("hamming") <= threshold)
        near = near.select("l_words", "r_words", "hamming")
    ranked = near.join(stands, near["r_words"] == stands["high_words"]).groupBy("l_words").agg(F.min(F.struct("hamming", "high")).alias("best"))
    return lows.join(ranked, F.col("low_words") == F.col("l_words")).select(
        "low_path", "low_name", "low_w", "low_h",
        F.col("best.high.high_path").alias("high_path"), F.col("best.high.high_name").alias("high_name"),
        F.col("best.high.high_w").alias("high_w"), F.col("best.high.high_h").alias("high_h"),
        F.col("best.hamming").alias("hamming"), F.lit(None).cast("double").alias("diff"),
    )


def top_k_high(hashed: DataFrame, k: int, base_size: int = 1024, hash_size: int = 8, limit: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per low its k closest highs by (distance, name), whatever the distance: low_path, rank, high_path, hamming.

    Of equal hashes only k highs can be among them; those are searched for distinct hashes of lows, with a growing radius.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    lows, highs = _low_high(hashed, base_size, limit)
    if not k:
        return hashed.sparkSession.createDataFrame([], "low_path string, rank int, high_path string, hamming int")
    order = ("high_name", "less", "high_path")
    rows = highs.select(F.col("high_words").alias("r_words"), "high_name", (-F.col("high_dim")).alias("less"), "high_path")
    first = Window.partitionBy("r_words").orderBy(*order)
    rows = rows.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k).drop("__n")
    found = nearest(lows.select(F.col("low_words").alias("l_words")).distinct(), rows, (), order, hash_size, k, block)
    best = Window.partitionBy("l_words").orderBy("hamming", *order)
    ranked = found.withColumn("rank", F.row_number().over(best))
    return lows.join(ranked, F.col("low_words") == F.col("l_words")).select("low_path", "rank", "high_path", "hamming")


def nested_top_k(top: DataFrame) -> DataFrame:
    """One row a low with its ranked list."""
    return top.groupBy("low_path").agg(F.sort_array(F.collect_list(F.struct("rank", "high_path", "hamming"))).alias("highs"))


def compare_pairs(pairs: DataFrame, hashed: DataFrame, hash_size: int = 8) -> DataFrame:
    """pairs(a, b) of paths with both sizes and their distance."""
    side = lambda s: hashed.select(F.col("rel_path").alias(s), F.col("width").alias(f"{s}_w"), F.col("height").alias(f"{s}_h"), F.col("hash_words").alias(f"{s}_words"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.withColumn("hamming", hashing.hamming(F.col("a_words"), F.col("b_words"), hash_size)).drop("a_words", "b_words")


# --- pixels of matches -----------------------------------------------------------------------------------


def semi_filter_pixels(images: DataFrame, *matches: DataFrame) -> DataFrame:
    """Only images that occur in one of the match tables, so only those are decoded."""
    used = None
    for m in matches:
        for side in ("low_path", "high_path"):
            part = m.select(F.col(side).alias("rel_path"))
            used = part if used is None else used.union(part)
    return images.join(used.distinct(), "rel_path", "left_semi")


def with_pixels(matches: DataFrame, images: DataFrame) -> DataFrame:
    """matches with low_ and high_ width, height, channels and data; pairs with an unreadable side drop out."""
    needed = semi_filter_pixels(images, matches)
    side = lambda s: needed.select(F.col("rel_path").alias(f"{s}_path"), *(F.col(c).alias(f"{s}_{c}") for c in ("width", "height", "channels", "data")))
    return matches.join(side("low"), "low_path").join(side("high"), "high_path")


def within_diff(matches: DataFrame, limit: float = 12.0) -> DataFrame:
    return matches.filter(F.col("diff") <= limit)


def match_bands(matches: DataFrame) -> DataFrame:
    """How many pairs lie in each band of distances of an 8 x 8 hash."""
    d: Column = F.col("hamming")
    band = F.when(d <= 4, "near-identical").when(d <= 10, "similar").when(d <= 20, "loose").otherwise("unrelated")
    return matches.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
