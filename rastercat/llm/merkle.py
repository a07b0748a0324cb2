"""Merkle manifest of a dataset: a tree for each source, a tree over the sources, proofs and their checks.

A leaf is the hash of a row. Leaves of a source, in order, are cut into aligned blocks of
``fanout ** STEPS`` places. A task holds a block as one contiguous numpy matrix of hex digests: a
level is the matrix reshaped by the fanout, each row hashed; the siblings of every node at every
level are found by index arithmetic. Blocks of all sources are raised together, so each round
divides the largest source by the block's size, and a source of any size is many blocks. The same
rounds go over the sources' roots. Proofs are made from the top down: a block gets the siblings of
its own node in one row beside its leaves, and siblings of leaves are never stored.

Defined cases: a null column is ``-`` in the leaf; a null source is a source of its own and comes
first; null ids come first. Rows of one id are told apart by their leaf; equal rows are neighbours
with equal leaves, each with a proof of its own. Empty texts have the length 0. An empty table has no root and gives
an empty result. Columns that aren't hashed do no harm. Ids may be of any type that has an order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastercat.llm import textbytes as tb
from rastercat.llm.storage import column, dropped, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels of a block: 729 leaves at the fanout 3, 46 KB of digests.
STEPS = 6
#: Bytes of a digest in hex.
HEX = 64


# --- leaves --------------------------------------------------------------------------------------------


def leaf(*values: Column) -> Column:
    """Hash of the values: each ``-`` if null, else its length in UTF-8 bytes, a colon, and its text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256)


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df, stored, with place (from 0, in the order, in each value of ``by``) and n (rows of that value).

    Rows are sorted over all tasks, so the rows of one value may lie in many; what is summed is a row for
    each value and task.
    """
    laid = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = stored(laid.withColumns({"task": F.spark_partition_id(), "line": F.monotonically_increasing_id()}), "sorted")
    runs = rows.groupBy(*by, "task").agg(F.count("*").alias("many"), F.min("line").alias("first"))
    before = Window.partitionBy(*by).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("many").over(before), F.lit(0)) - F.col("first")
    runs = runs.select(*(F.col(c).alias(f"own_{c}") for c in (*by, "task")), shift.alias("shift"), F.sum("many").over(Window.partitionBy(*by)).alias("n"))
    same = F.col("task") == F.col("own_task")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    out = stored(rows.join(runs, same).select(*df.columns, (F.col("line") + F.col("shift")).alias("place"), "n"), "numbered")
    dropped(rows)
    return out


# --- blocks in tasks -------------------------------------------------------------------------------------


def _hashed(cells: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Digests of rows of cells (rows, fanout, 64), of each only the cells that are there; as (rows, 64)."""
    data, ends = cells[there].tobytes(), np.cumsum(there.sum(1)) * HEX
    made = b"".join(hashlib.sha256(data[a:b]).hexdigest().encode() for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True))
    return np.frombuffer(made, np.uint8).reshape(-1, HEX)


def _slots(at: np.ndarray, fanout: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For nodes at these places the places of their run, and which of them are there."""
    places = (at - at % fanout)[:, None] + np.arange(fanout)
    return np.minimum(places, size - 1), places < size


def _levels(matrix: np.ndarray, n: int, fanout: int, steps: int) -> list[np.ndarray]:
    """The block's matrices, leaves first: as many steps up as a tree of n nodes has, ``steps`` at most."""
    out = [matrix]
    while n > 1 and len(out) <= steps:
        places, there = _slots(np.arange(0, len(out[-1]), fanout), fanout, len(out[-1]))
        out.append(_hashed(out[-1][places], there))
        n = -(-n // fanout)
    return out


def _digests(col: pa.Array) -> np.ndarray:
    return tb.buffers(col)[0].reshape(-1, HEX)


def _texts(matrix: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(matrix), pa.py_buffer(np.arange(0, HEX * len(matrix) + 1, HEX, dtype=np.int32)), pa.py_buffer(matrix.tobytes()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks of rows sorted by their first two columns, tree and block."""
    left = None
    for batch in batches:
        if left is not None:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        tree, block = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        left = batch.slice(cuts[-1]) if batch.num_rows else None
    if left is not None:
        yield left


def _gathered(parts: Iterator[list], fields: list[tuple[str, pa.DataType]], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Columns of many blocks as batches of some size."""
    kept, size = [], 0
    for part in parts:
        kept.append(part)
        size += len(part[0])
        if size >= rows:
            yield _batch(kept, fields)
            kept, size = [], 0
    if kept:
        yield _batch(kept, fields)


def _batch(parts: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    arrays = [pa.concat_arrays([p[k] if isinstance(p[k], pa.Array) else pa.array(p[k], kind) for p in parts]) for k, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


# --- up and down -----------------------------------------------------------------------------------------


def _dealt(rows: DataFrame) -> DataFrame:
    """A block's rows come together, in order; rows have tree, block and place first."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def raised(level: DataFrame, fanout: int = FANOUT, steps: int = STEPS) -> DataFrame:
    """(tree, place, n, digest) of the blocks of level(tree, place, n, digest); a tree of one node stays."""
    size = fanout**steps
    fields = [("tree", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[list]:
            for block in _blocks(batches):
                n = block.column(3)[0].as_py()
                top = _levels(_digests(block.column(4)), n, fanout, steps)[-1]
                yield [[block.column(0)[0].as_py()], [block.column(1)[0].as_py()], [-(-n // size)], _texts(top)]

        yield from _gathered(parts(), fields)

    rows = level.select("tree", F.floor(F.col("place") / size).alias("block"), "place", "n", "digest")
    return _dealt(rows).mapInArrow(work, "tree long, place long, n long, digest string")


def _rounds(level: DataFrame, fanout: int, steps: int) -> list[DataFrame]:
    """level and what is raised from it, stored, until every tree is one node."""
    out, n = [level], level.agg(F.max("n")).first()[0]  # one number
    while (n or 0) > 1:
        out.append(stored(raised(out[-1], fanout, steps), "level"))
        n = -(-n // fanout**steps)
    return out


_LIST = pa.list_(pa.string())


def lowered(level: DataFrame, above: DataFrame, fanout: int = FANOUT, steps: int = STEPS, leaves: bool = False) -> DataFrame:
    """What lies beside each node of level(tree, place, n, digest), up to the root.

    above(tree, place, digest, lefts, rights, top) has the same for the blocks; lefts and rights are
    the digests left and right of the way, level by level. With ``leaves`` level also has id and
    forged, and the result is (id, leaf, subroot, proof_sha256, folded_root): the hash of all siblings, and
    the root that forged, or else the leaf itself, leads to.
    """
    size = fanout**steps
    kind = level.schema["id"].dataType.simpleString() if leaves else None
    more = ["id", "forged"] if leaves else []
    texts = ("leaf", "subroot", "proof_sha256", "folded_root")
    fields = [("id", None), *((c, pa.string()) for c in texts)] if leaves else [("tree", pa.int64()), ("place", pa.int64()), ("digest", pa.string()), ("lefts", _LIST), ("rights", _LIST), ("top", pa.string())]
    rows = level.select("tree", F.floor(F.col("place") / size).alias("block"), "place", "n", "digest", *(F.lit(None).cast(t).alias(c) for c, t in _WAY), *more)
    heads = above.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("n"), "digest", *(c for c, _ in _WAY), *(F.lit(None).cast(t).alias(c) for c, t in zip(more, (kind, "string"), strict=False)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[list]:
            for block in _blocks(batches):
                head, nodes = block.slice(0, 1), block.slice(1)
                lefts, rights, top = (head.column(k)[0].as_py() for k in (5, 6, 7))
                levels = _levels(_digests(nodes.column(4)), nodes.column(3)[0].as_py(), fanout, steps)
                beside = list(_beside(levels, fanout))
                if leaves:
                    yield [nodes.column(8), nodes.column(4), [top] * nodes.num_rows, *_proved(levels[0], nodes.column(9), beside, lefts, rights)]
                    continue
                own = [[_joined(cells, there & (way < 0)), _joined(cells, there & (way > 0))] for cells, there, way in beside]
                ways = [[[*(level[side][i] for level in own), *(lefts, rights)[side]] for i in range(nodes.num_rows)] for side in (0, 1)]
                yield [nodes.column(0), nodes.column(2), nodes.column(4), *ways, [top] * nodes.num_rows]

        yield from _gathered(parts(), fields)

    schema = f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string" if leaves else "tree long, place long, digest string, lefts array<string>, rights array<string>, top string"
    return _dealt(rows.union(heads)).mapInArrow(work, schema)


_WAY = (("lefts", "array<string>"), ("rights", "array<string>"), ("top", "string"))


def _beside(levels: list[np.ndarray], fanout: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level below the top and every leaf: cells (leaves, fanout, 64) of its run, which are there, and where they lie from the way: below 0 left, 0 the way itself."""
    at = np.arange(len(levels[0]))
    for matrix in levels[:-1]:
        places, there = _slots(at, fanout, len(matrix))
        yield matrix[places], there, np.arange(fanout) - (at % fanout)[:, None]
        at = at // fanout


def _joined(cells: np.ndarray, at: np.ndarray) -> list[str]:
    """The chosen cells of each row as one text."""
    data, ends = cells[at].tobytes().decode(), np.cumsum(at.sum(1)) * HEX
    return [data[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]


def _proved(own: np.ndarray, forged: pa.Array, beside: list, lefts: list[str], rights: list[str]) -> tuple[list[str], list[str]]:
    """Hash of all siblings, and root that forged leaves, or the leaves where there is none, lead to."""
    value = own.copy()
    other = np.flatnonzero(np.asarray(forged.is_valid()))
    if len(other):
        value[other] = _digests(forged.drop_null())
    siblings = [[] for _ in range(len(own))]
    for cells, there, way in beside:
        for mine, text in zip(siblings, _joined(cells, there & (way != 0)), strict=True):
            mine.append(text)
        cells = cells.copy()
        cells[way == 0] = value
        value = _hashed(cells, there)
    above = "".join(a + b for a, b in zip(lefts, rights, strict=True))
    proofs = [hashlib.sha256(("".join(mine) + above).encode()).hexdigest() for mine in siblings]
    seen: dict[str, str] = {}
    folded = []
    for text in _texts(value).to_pylist():
        if text not in seen:
            up = text
            for a, b in zip(lefts, rights, strict=True):
                up = hashlib.sha256((a + up + b).encode()).hexdigest()
            seen[text] = up
        folded.append(seen[text])
    return proofs, folded


# --- manifests -------------------------------------------------------------------------------------------


@dataclass
class Manifest:
    """root (None of an empty table); sources: (source, n, subroot) a row each; levels: nodes of the sources' trees, leaves first; tops: of the tree over sources."""

    root: str | None
    sources: DataFrame
    levels: list[DataFrame]
    tops: list[DataFrame]
    fanout: int
    steps: int


def build(docs: DataFrame, forged: Column | None = None, columns: tuple[str, ...] = COLUMNS, id: str = "doc_id", by: str = "source", fanout: int = FANOUT, steps: int = STEPS) -> Manifest:
    """The manifest of docs. ``forged``: a leaf to be checked in place of the row's own, null where the row is to be checked as it is."""
    own = leaf(*(F.col(column(c)) for c in columns))
    forged = F.lit(None).cast("string") if forged is None else forged
    rows = stored(docs.select(F.col(column(id)).alias("id"), F.col(column(by)).alias("part"), own.alias("digest"), forged.alias("forged")), "leaves")
    placed = numbered(rows, ["part"], ["id", "digest", "forged"])
    dropped(rows)
    parts = placed.groupBy("part").agg(F.max("n").alias("size"))
    trees = numbered(parts, [], ["part"])
    named = trees.select(F.col("part").alias("own"), F.col("place").alias("tree"))
    # A source's number is looked up once for a place in its block, not for every row of a large source.
    level = stored(_with_tree(placed, named, fanout**steps), "leaves")
    dropped(placed)
    levels = _rounds(level, fanout, steps)
    nodes = levels[-1].select(F.col("tree").alias("place"), "digest").join(trees.select("place", "part", "size", "n"), "place")
    sources = stored(nodes.select(F.lit(0).cast("long").alias("tree"), "place", "n", "digest", "part", "size"), "sources")
    dropped(trees)
    tops = _rounds(sources, fanout, steps)
    last = tops[-1].select("digest").first()
    return Manifest(last and last[0], sources.select(F.col("part").alias(by), F.col("size").alias("n"), F.col("digest").alias("subroot")), levels, tops, fanout, steps)


def _with_tree(placed: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """placed with the number of its source: named is dealt by (source, block) as the rows are, so that a large source's rows are joined in many tasks."""
    block = F.floor(F.col("place") / size).alias("block")
    most = placed.groupBy("part").agg(F.max("n").alias("many"))
    spread = named.join(most, F.col("own").eqNullSafe(F.col("part"))).select("own", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / size))).alias("own_block"))
    rows = placed.withColumn("block", block)
    same = (F.col("block") == F.col("own_block")) & F.col("part").eqNullSafe(F.col("own"))
    return rows.join(spread, same).select("tree", "place", "n", "digest", "id", "forged")


def proofs(manifest: Manifest) -> DataFrame:
    """One row for each leaf: id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    fanout, steps = manifest.fanout, manifest.steps
    none = F.array().cast("array<string>")
    above = manifest.tops[-1].select("tree", "place", "digest", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("top"))
    for level in reversed(manifest.tops[:-1]):
        above = lowered(level.select("tree", "place", "n", "digest"), above, fanout, steps)
    above = above.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "digest", "lefts", "rights", F.col("digest").alias("top"))
    for level in reversed(manifest.levels[1:]):
        above = lowered(level, above, fanout, steps)
    # The blocks' ways are stored: each is made of all above it.
    found = lowered(manifest.levels[0], stored(above, "ways"), fanout, steps, leaves=True)
    root = F.lit(manifest.root)
    return found.select("id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document's proof; where 2 divides the crc32 of its id, of the document without line feeds against the siblings of the untouched one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without = leaf(*(F.col(c) if c != "text" else F.translate("text", "\n", "") for c in COLUMNS))
    return proofs(build(docs, F.when(touched, without))).withColumnRenamed("id", "doc_id")


#: Levels of the trees in the SQL below: up to 3 ** 14 leaves.
_DEPTH = 14


def _tree_sql(start: str, name: str, depth: int) -> str:
    """CTEs of the levels of trees: name_k(tree, i, n, h), what lies left and right of each node, and the one of height ``depth``."""
    out = []
    for k in range(depth + 1):
        below = start if k == 0 else f"SELECT tree, i // 3 AS i, any_value(CASE WHEN n = 1 THEN 1 ELSE (n + 2) // 3 END) AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}_{k - 1} GROUP BY tree, i // 3"
        out.append(f"{name}r_{k} AS MATERIALIZED ({below})")
        run = "OVER (PARTITION BY tree, i // 3 ORDER BY i)"
        out.append(f"{name}_{k} AS MATERIALIZED (SELECT tree, i, n, h, coalesce(lag(h, 2) {run}, '') || coalesce(lag(h, 1) {run}, '') AS l, coalesce(lead(h, 1) {run}, '') || coalesce(lead(h, 2) {run}, '') AS r FROM {name}r_{k})")
    return ",\n".join(out)


def _fold_sql(start: str, name: str, nodes: str, depth: int) -> str:
    """CTEs that carry (row, tree, i, v, p) up the trees: v the folded value, p all siblings so far."""
    out = [f"{name}_0 AS ({start})"]
    for k in range(depth):
        out.append(
            f"{name}_{k + 1} AS MATERIALIZED (SELECT f.row, f.tree, f.i // 3 AS i, CASE WHEN t.n = 1 THEN f.v ELSE sha256(t.l || f.v || t.r) END AS v, f.p || CASE WHEN t.n = 1 THEN '' ELSE t.l || t.r END AS p FROM {name}_{k} f JOIN {nodes}_{k} t USING (tree, i))"
        )
    return ",\n".join(out)


_PART = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
_CRC = "list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, s: xor(x >> 1, (x & 1) * 3988292384)), 4294967295::BIGINT)"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, *, sha256({" || ".join(_PART.format(c=c) for c in COLUMNS)}) AS h,
  CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN sha256({" || ".join(_PART.format(c=c if c != "text" else "replace(text, chr(10), '')") for c in COLUMNS)}) END AS forged FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
b AS (SELECT d.*, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, h, forged NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY s.tree) AS n FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
{_tree_sql("SELECT tree, i, n, h FROM b", "t", _DEPTH)},
{_tree_sql(f"SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, h FROM t_{_DEPTH}", "u", _DEPTH)},
{_fold_sql("SELECT row, tree, i, coalesce(forged, h) AS v, '' AS p FROM b", "f", "t", _DEPTH)},
{_fold_sql(f"SELECT row, 0 AS tree, tree AS i, v, p FROM f_{_DEPTH}", "g", "u", _DEPTH)}
SELECT b.doc_id, b.h AS leaf, t.h AS subroot, u.h AS root, sha256(g.p) AS proof_sha256, g.v AS folded_root, g.v = u.h AS verified
FROM b JOIN g_{_DEPTH} g USING (row) JOIN t_{_DEPTH} t ON t.tree = b.tree CROSS JOIN u_{_DEPTH} u
"""
