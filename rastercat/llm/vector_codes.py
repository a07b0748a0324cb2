"""Vectors as short codes: a codebook for each part of the vector, nearest entries found through segment means.

The nearest entry of every part is exact. Lower bounds go from coarse to fine: a part and an entry are
cut into blocks; the squared distance is at least the sum over the blocks of the squared differences
of the block sums over the block's length, plus the squared difference of the norms of what is left when
the means are taken off. Entries whose bound is above the exact distance to the most promising one
can't be nearest; blocks half as long bound the rest and choose a more promising one, and what
survives gets exact whole distances. Bounds are floating point, with a margin far above their error, so the filter only ever keeps too much.

A round is one pass over the vectors: a task sums its parts by entry, and the sums of all tasks meet in
as many rows as the codebooks have numbers. Codebooks are parts x entries x width whole numbers
whatever the input, and are the only thing that reaches the driver.

Defined cases: vectors that are null or hold null or non-finite components are dropped; ids that are
null come last and rows of one id are ordered by their vectors, when the first entries are chosen; with
fewer vectors than entries the codebooks are as small. Vectors of length 0 have codes of zeros.
Lengths that differ or can't be cut into the parts, and components so large that squared distances
don't fit 64 bits, raise. Null labels are one label. An empty table gives an empty result. Columns
other than the three have no effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastercat.llm.storage import dropped, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors compared at once in a task.
CHUNK = 1024
#: Relative margin of a bound.
MARGIN = 1e-6
#: Labels with more than one in so many rows are broadcast, so fewer than that.
HOT = 1000


# --- whole vectors ---------------------------------------------------------------------------------------


def vectors(col: pa.Array, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their components as whole numbers); null and non-finite ones are not."""
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    there = np.asarray(col.is_valid())
    for k in np.flatnonzero(there & (sizes != dim)).tolist():  # one with null components is dropped whatever its length
        if all(x is not None and np.isfinite(x) for x in col[k].as_py()):
            raise ValueError(f"a vector of {int(sizes[k])} components among those of {dim}")
        there[k] = False
    col, kept = col.filter(pa.array(there)), np.flatnonzero(there)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(kept), dim)
    good = np.isfinite(flat).all(1)
    with np.errstate(over="ignore"):
        whole = np.floor(flat[good] * scale)
    return kept[good], _checked(whole, dim)


def _checked(whole: np.ndarray, dim: int) -> np.ndarray:
    width = max(1, dim // PARTS)
    if whole.size and width * (2 * np.abs(whole).max()) ** 2 >= 2.0**62:
        raise ValueError("components are too large for squared distances of 64 bits")
    return whole.astype(np.int64)


# --- nearest entries ---------------------------------------------------------------------------------------


def _blocks(width: int) -> list[int]:
    """Lengths of blocks from coarse to fine: the whole part, then halves of it as long as they are whole and longer than 1."""
    out = []
    while width > 1:
        out.append(width)
        if width % 2:
            break
        width //= 2
    return out


def _means(x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Block sums over the root of the block's length, and the norm of what the means leave."""
    sums = x.reshape(len(x), -1, block).sum(2) / np.sqrt(block)
    return sums, np.sqrt(np.maximum((x.astype(np.float64) ** 2).sum(1) - (sums**2).sum(1), 0))


class Entries:
    """The entries of one part position, with their segment means."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.norms = (entries.astype(np.float64) ** 2).sum(1)
        self.levels = [(block, *_means(entries, block)) for block in _blocks(entries.shape[1])]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, the lower index of equals."""
        if not len(x) or not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        norms = (x.astype(np.float64) ** 2).sum(1)
        margin = MARGIN * (norms + self.norms.max())
        limit, left = np.full(len(x), np.inf), np.ones((len(x), len(self.entries)), bool)
        for block, sums, rests in self.levels:
            own, rest = _means(x, block)
            least = own @ (-2 * sums.T)
            least += (sums**2).sum(1) + rests**2
            least -= np.outer(2 * rest, rests)
            least += ((own**2).sum(1) + rest**2)[:, None]
            guess = least.argmin(1)  # the most promising entry: its exact distance is the limit
            limit = np.minimum(limit, ((x - self.entries[guess]) ** 2).sum(1) + margin)
            left &= least <= limit[:, None]
        rows, entries = np.nonzero(left)
        apart = x[rows] - self.entries[entries]
        exact = np.einsum("ij,ij->i", apart, apart)
        least = np.minimum.reduceat(exact, np.searchsorted(rows, np.arange(len(x))))
        hits = np.flatnonzero(exact == least[rows])
        first = hits[np.concatenate([[True], rows[hits][1:] != rows[hits][:-1]])]
        return entries[first], exact[first]


def _assigned(batch: pa.RecordBatch, at: int, books: list[Entries], dim: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, components, indexes by part, distances by part) of chunks of a batch's kept vectors."""
    kept, whole = vectors(batch.column(at), dim, scale)
    width = dim // len(books)
    for a in range(0, len(kept), CHUNK):
        x = whole[a : a + CHUNK]
        found = [book.nearest(x[:, k * width : (k + 1) * width]) for k, book in enumerate(books)]
        yield kept[a : a + CHUNK], x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


# --- codebooks ---------------------------------------------------------------------------------------------


@dataclass
class Codebooks:
    """entries: (parts, entries, width) whole numbers; dim: components of a vector."""

    entries: np.ndarray
    dim: int
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _first(df: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = df.filter(finite).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()  # as many as entries
    if not rows:
        return None
    dims = {len(r[0]) for r in rows}
    dim = dims.pop()
    if dims or dim % parts:
        raise ValueError(f"vectors of one length that {parts} divides are needed")
    whole = _checked(np.floor(np.array([r[0] for r in rows], np.float64).reshape(len(rows), dim) * scale), dim)
    return Codebooks(whole.reshape(len(rows), parts, dim // parts).transpose(1, 0, 2).copy(), dim, scale)


def _round(df: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry the mean, rounded down, of the parts that are nearest to it; entries of none stay."""
    parts, entries, width = books.entries.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Entries(e) for e in books.entries]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, x, index, _ in _assigned(batch, 0, own, books.dim, books.scale):
                for k in range(parts):
                    np.add.at(sums[k], index[:, k], x[:, k * width : (k + 1) * width])
                    counts[k] += np.bincount(index[:, k], minlength=entries)
        used = np.flatnonzero(counts.ravel())
        flat = np.concatenate([counts.reshape(-1, 1), sums.reshape(parts * entries, width)], 1)[used]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width + 1)), pa.array(np.tile(np.arange(width + 1), len(used))), pa.array(flat.ravel())], names=["entry", "at", "total"])

    found = df.select("embedding").mapInArrow(work, "entry long, at long, total long").groupBy("entry", "at").agg(F.sum("total").alias("total")).collect()  # numbers of the codebooks
    total = np.zeros((parts * entries, width + 1), np.int64)
    for r in found:
        total[r["entry"], r["at"]] = r["total"]
    used = total[:, 0] > 0
    made = books.entries.reshape(parts * entries, width).copy()
    made[used] = total[used, 1:] // total[used, :1]
    return Codebooks(made.reshape(parts, entries, width), books.dim, books.scale)


def trained(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of df(vec_id, embedding), None if no vector is kept."""
    books = _first(df, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = _round(df, books)
    return books


# --- codes -------------------------------------------------------------------------------------------------

_DIGITS = np.frombuffer(b"".join(b"%02x" % k for k in range(256)), np.uint8).reshape(256, 2)


def encoded(df: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of the kept vectors: two hex digits a part, and the whole squared distance to what the code stands for."""
    parts = len(books.entries)
    if books.entries.shape[1] > 256:
        raise ValueError("a code's part has two hex digits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Entries(e) for e in books.entries]
        for batch in batches:
            for rows, _, index, distance in _assigned(batch, 2, own, books.dim, books.scale):
                text = _DIGITS[index].tobytes()
                ends = np.arange(0, 2 * parts * len(rows) + 1, 2 * parts, dtype=np.int32)
                codes = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(text))
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), codes, pa.array(distance.sum(1))], names=["vec_id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in df.select("vec_id", "label").schema}
    return df.select("vec_id", "label", "embedding").mapInArrow(work, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def decoded(code: str, books: Codebooks) -> np.ndarray:
    """The whole vector that a code stands for."""
    return np.concatenate([book[int(code[2 * k : 2 * k + 2], 16)] for k, book in enumerate(books.entries)])


def with_label_errors(codes: DataFrame, hot: int = HOT) -> DataFrame:
    """Stored codes with label_error, the sum of the errors of their label.

    A label's rows never come together: sums are made in tasks first; labels with more than one in ``hot`` rows
    are fewer than ``hot``, and are broadcast, the others are joined by a shuffle.
    """
    totals = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("many")), "label-errors")
    rows = totals.agg(F.sum("many")).first()[0] or 0
    large = F.col("many") * hot > rows
    named = totals.select(F.col("label").alias("own_label"), "label_error", "many")
    same = F.col("label").eqNullSafe(F.col("own_label"))
    most = F.broadcast(named.filter(large))
    out = codes.join(most, same).union(codes.join(most, same, "left_anti").join(named.filter(~large), same))
    return out.drop("own_label", "many")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """The codes of all embeddings and their errors."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = trained(df)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    out = with_label_errors(stored(encoded(df, books), "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


_NEAREST = """
{to} AS MATERIALIZED (SELECT row, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS best FROM (
  SELECT row, p.part, p.x, entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::BIGINT AS d FROM p JOIN {book} c ON c.part = p.part) GROUP BY row, part)"""
_UPDATED = """
{to} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, c.x) AS x FROM {book} c LEFT JOIN (
  SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, best.entry AS entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM {found}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL)
  GROUP BY part, entry) n USING (part, entry))"""

ORACLE_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, part, c[part * (len(c) // {PARTS}) + 1 : (part + 1) * (len(c) // {PARTS})] AS x FROM v, (SELECT unnest(range({PARTS})) AS part)),
c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {ENTRIES}),
{_NEAREST.format(to="a0", book="c0")}, {_UPDATED.format(to="c1", book="c0", found="a0")},
{_NEAREST.format(to="a1", book="c1")}, {_UPDATED.format(to="c2", book="c1", found="a1")},
{_NEAREST.format(to="a2", book="c2")},
e AS (SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256 FROM v JOIN e USING (row)
"""
