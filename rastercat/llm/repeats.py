"""Repeated passages by a depth-limited radix sort of suffixes, most significant digits first.

Suffixes of whole texts (UTF-8 bytes) are ordered only as deep as ``WINDOW`` bytes, and only those
that can meet an equal one. The passes are

1. by the first digit, an anchor: the ``GRAM`` bytes with the least hash in a window. Equal windows
   have equal anchors at equal places, so of all suffixes only those that start with an anchor, about
   one in 85, are sorted, with the bytes before it as a prefix; one whose anchor occurs once is alone.
2. by the anchor's whole context, which holds every window of that anchor: rows that agree here are
   equal in all their windows, and one of them stands for all. Two independent 64-bit hashes stand
   for the context, beside the anchor's own.
3. by bytes, in tasks: the suffixes of one anchor are sorted by their leading chunks of ``CHUNK``
   bytes, pass after pass, each on the groups that are still open; so are the prefixes, read
   backwards. The depth to which neighbours agree tells for each length which rows are equal to that
   length on either side; rows that are equal to the left and to the right are the repeated windows.

Groups with one row end at each pass; groups that reach the last are exactly the repeated windows:
pass 3 compares bytes, so two anchors with one hash are told apart there. Anchors with more than
``HOT`` different contexts are not gathered in one task: their windows are counted by two 64-bit
keys, after a screen by context pieces of doubling length.

Defined cases: a null text is empty; texts under WINDOW bytes keep everything; copies of a text
remove all of each other from WINDOW bytes on; rows are told apart by two 64-bit text hashes, not
by doc_id, so null and repeated ids are safe. Empty tables give empty results. Only doc_id and text
are used, so that other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastercat.llm import textbytes as tb
from rastercat.llm.storage import dropped, stored

WINDOW, GRAM = 200, 32
#: Bytes of a suffix that one pass sorts by.
CHUNK = 8
#: Different contexts of one anchor that a task may gather.
HOT = 20_000
#: Rows that the last passes are made over at once, about.
ROWS = 4096
#: Byte values of a second, independent polynomial hash.
_OTHER_VALUES = np.random.default_rng(971).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours, from each position on."""
    op, size = (np.minimum if least else np.maximum), 1
    while size * 2 <= width:
        values = op(values[:-size], values[size:])
        size *= 2
    return op(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, running sums) of the anchors of all windows that lie within one document."""
    sums = tb.prefix_sums(data)
    if len(data) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), sums
    starts = np.arange(len(data) - gram + 1)
    grams = tb.span_hashes(sums, starts, starts + gram)
    width = window - gram + 1
    least = _sliding(grams, width, True)
    for i, end in enumerate(offsets[1:].tolist()):  # windows that cross the end of a document
        least[max(int(offsets[i]), end - window + 1) : end] = 0
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(padded, width, False)[: len(grams)] == grams)
    return at, grams[at], sums


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, c1, c2, t1, t2, place): c1 and c2 are the context's hashes; place packs position, bytes to the left and to the right in it."""
    reach = window - gram

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(2))
            t1, t2 = (batch.column(k).to_numpy() for k in (0, 1))
            for i, _, part, at in tb.pieces(data, offsets):
                p, h, sums = anchors(part, at, window, gram)
                if not len(p):
                    continue
                doc = np.searchsorted(at, p, "right") - 1
                left, right = np.minimum(p - at[doc], reach), np.minimum(at[doc + 1] - p - gram, reach)
                before = tb.span_hashes(sums, p - left, p) + left.astype(np.uint64)
                after = tb.span_hashes(sums, p + gram, p + gram + right) + right.astype(np.uint64) * np.uint64(1 << 20)
                c1 = tb.mixed(before * np.uint64(0x9E3779B97F4A7C15) + after)
                again = tb.prefix_sums(part, _OTHER_VALUES)
                c2 = tb.mixed(tb.span_hashes(again, p - left, p + gram + right) + left.astype(np.uint64) * np.uint64(512) + right.astype(np.uint64))
                place = ((p - at[doc]) << 16) | (left << 8) | right
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h.view(np.int64), c1.view(np.int64), c2.view(np.int64), t1[i + doc], t2[i + doc], place)], names=["h", "c1", "c2", "t1", "t2", "place"]
                )

    return docs.select("t1", "t2", "text").mapInArrow(work, "h long, c1 long, c2 long, t1 long, t2 long, place long")


def _contexts(rows: DataFrame, gram: int) -> DataFrame:
    """rows(text, wanted: array of (h, place, open, hot)) to (h, t1, t2, place, open, hot, bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(2))
            wanted = batch.column(3)
            flat, at = wanted.flatten(), wanted.offsets.to_numpy()
            at = at - at[0]
            h, place, is_open, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            doc = np.repeat(np.arange(len(wanted)), np.diff(at))
            start = offsets[doc] + (place >> 16) - ((place >> 8) & 255)
            end = offsets[doc] + (place >> 16) + gram + (place & 255)
            cut = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            t1, t2 = (batch.column(k).to_numpy()[doc] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(t1), pa.array(t2), pa.array(place), pa.array(is_open.astype(bool)), pa.array(hot.astype(bool)), pa.array(cut, pa.binary())],
                names=["h", "t1", "t2", "place", "open", "hot", "bytes"],
            )

    return rows.select("t1", "t2", "text", "wanted").mapInArrow(work, "h long, t1 long, t2 long, place long, open boolean, hot boolean, bytes binary")


def radix_order(strings: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix, by chunks of CHUNK bytes, most significant first; only open groups are sorted on."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // CHUNK) * CHUNK), np.uint8)
    padded[:, :width] = strings
    digits = padded.view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)  # in sorted order; a group's number is its first place
    for k in range(digits.shape[1]):
        sizes = np.bincount(group, minlength=n)
        at = np.flatnonzero(sizes[group] > 1)
        if not len(at):
            break
        by = np.lexsort((digits[order[at], k], group[at]))
        order[at] = order[at][by]
        digit = digits[order[at], k]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (digit[1:] != digit[:-1]) | (group[at][1:] != group[at][:-1])
        group[at] = np.maximum.accumulate(np.where(fresh, at, 0))
    return order


def _agreement(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each row in order the number of leading bytes that it shares with the row before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), ROWS):
        hi = min(lo + ROWS, len(order))
        differs = strings[order[lo:hi]] != strings[order[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(differs.any(1), differs.argmax(1), strings.shape[1])
    return out


def _sides(place: np.ndarray, contexts: pa.Array, reach: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """left, right (bytes that a row has on either side) and byte matrices: backwards from the anchor; the anchor and on."""
    data, offsets = tb.buffers(contexts)
    left, right = (place >> 8) & 255, place & 255
    last = max(len(data) - 1, 0)
    start = offsets[:-1, None] + left[:, None]
    step, on = np.arange(reach), np.arange(gram + reach)
    before = np.where(step < left[:, None], data[np.clip(start - 1 - step, 0, last)], 0).astype(np.uint8)
    after = np.where(on < gram + right[:, None], data[np.clip(start + on, 0, last)], 0).astype(np.uint8)
    return left, right, before, after


def repeated_windows(h: np.ndarray, place: np.ndarray, contexts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(most, least) bytes left of its anchor at which a repeated window of the row starts; -1 and beyond reach where none is.

    A window is repeated if it is equal, byte by byte, to one of another row of the same anchor hash ``h``.
    """
    reach, n = window - gram, len(h)
    left, right, before, after = _sides(place, contexts, reach, gram)
    anchor = np.ascontiguousarray(h.astype(">i8")).view(np.uint8).reshape(n, 8)
    back, on = np.concatenate([anchor, before], 1), np.concatenate([anchor, after], 1)
    by_left, by_right = radix_order(back), radix_order(on)
    shared_left, shared_right = _agreement(back, by_left) - 8, _agreement(on, by_right) - 8
    most, least = np.full(n, -1), np.full(n, reach + 1)
    of_left, of_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for size in range(reach + 1):
        # Rows of one number are equal in the anchor's hash and size bytes before; in the anchor and reach - size bytes after.
        of_left[by_left] = np.cumsum(shared_left < size)
        of_right[by_right] = np.cumsum(shared_right < gram + reach - size)
        can = np.flatnonzero((left >= size) & (right >= reach - size))
        key = of_left[can] * n + of_right[can]
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        hit = can[np.union1d(order[1:][equal], order[:-1][equal])]
        most[hit] = size
        least[hit] = np.minimum(least[hit], size)
    return most, least


def _side_hashes(place: np.ndarray, contexts: pa.Array, reach: int, gram: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """left, right and, for each row, the hashes of the 0..reach bytes next to the anchor on either side."""
    left, right, before, after = _sides(place, contexts, reach, gram)
    step = np.arange(reach)
    sums = []
    for side, size in ((before, left), (after[:, gram:], right)):
        worth = values[side] * tb.powers(reach)
        worth[step[None, :] >= size[:, None]] = 0
        sums.append(np.concatenate([np.zeros((len(place), 1), np.uint64), np.cumsum(worth, axis=1)], 1))
    return left, right, *sums


def _window_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return tb.mixed(tb.mixed(before) * np.uint64(0x9E3779B97F4A7C15) + after)


def _sorted(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(t1, t2, first, end): for open rows the bytes in windows that another row of the anchor has; rows are dealt by h and sorted by h, t1, t2 and place."""

    def solved(table: pa.Table) -> pa.RecordBatch | None:
        keys = np.stack([table.column(k).to_numpy() for k in range(4)])
        table = table.filter(pa.array(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])))
        h, t1, t2, place = (table.column(k).to_numpy() for k in range(4))
        most, least = repeated_windows(h, place, table.column(5).combine_chunks(), window, gram)
        found = np.flatnonzero(table.column(4).to_numpy() & (most >= 0))
        if not len(found):
            return None
        p = place[found] >> 16
        return pa.RecordBatch.from_arrays([pa.array(t1[found]), pa.array(t2[found]), pa.array(p - most[found]), pa.array(p - least[found] + window)], names=["t1", "t2", "first", "end"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            if sum(x.num_rows for x in rest) < ROWS:
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            h = table.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))
            if cut:
                if (got := solved(table.slice(0, cut))) is not None:
                    yield got
                rest = pa.Table.from_batches(table.slice(cut).to_batches()).to_batches()
        if rest and (got := solved(pa.Table.from_batches(rest).combine_chunks())) is not None:
            yield got

    return rows.select("h", "t1", "t2", "place", "open", "bytes").mapInArrow(work, "t1 long, t2 long, first long, end long")


def _counted(rows: DataFrame, window: int, gram: int) -> tuple[DataFrame, list[DataFrame]]:
    """The same for anchors with very many contexts, and what was stored for it: windows are counted by key, none is gathered.

    First a screen: of the 1, 2, 4, ... bytes next to the anchor on each side, which have some other
    context too? That bounds how far a context can agree, and so the windows that are worth counting.
    """
    reach = window - gram
    rows = stored(rows, "hot-contexts")
    steps = [1 << k for k in range(reach.bit_length()) if 1 << k <= reach]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, t1, t2, place = (batch.column(k).to_numpy() for k in range(4))
            left, right, before, after = _side_hashes(place, batch.column(5), reach, gram, tb.BYTE_VALUES)
            for side, (have, sums) in enumerate(((left, before), (right, after))):
                for size in steps:
                    can = np.flatnonzero(have >= size)
                    key = tb.mixed(sums[can, size] + np.uint64(2 * size + side))
                    yield pa.RecordBatch.from_arrays([pa.array(h[can]), pa.array(key.view(np.int64)), pa.array(t1[can]), pa.array(t2[can]), pa.array(place[can]), pa.array(np.full(len(can), size)), pa.array(np.full(len(can), side))], names=["h", "key", "t1", "t2", "place", "size", "side"])

    cut = stored(rows.select("h", "t1", "t2", "place", "open", "bytes").mapInArrow(pieces, "h long, key long, t1 long, t2 long, place long, size long, side long"), "pieces")
    shared = cut.groupBy("h", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    bounds = cut.join(shared, ["h", "key"], "left_semi").groupBy("h", "t1", "t2", "place").agg(*(F.coalesce(F.max(F.when(F.col("side") == k, F.col("size"))), F.lit(0)).alias(name) for k, name in ((0, "l"), (1, "r"))))
    bounded = rows.join(bounds, ["h", "t1", "t2", "place"], "left").fillna(0, ["l", "r"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, t1, t2, place = (batch.column(k).to_numpy() for k in range(4))
            is_open = batch.column(4).to_numpy(zero_copy_only=False)
            l, r = (np.maximum(2 * batch.column(k).to_numpy() - 1, 0) for k in (6, 7))
            left, right, before, after = _side_hashes(place, batch.column(5), reach, gram, tb.BYTE_VALUES)
            _, _, before2, after2 = _side_hashes(place, batch.column(5), reach, gram, _OTHER_VALUES)
            l, r = np.minimum(left, l), np.minimum(right, r)
            for size in range(reach + 1):
                can = np.flatnonzero((l >= size) & (r >= reach - size))
                if len(can):
                    key = _window_key(before[can, size], after[can, reach - size])
                    key2 = _window_key(before2[can, size], after2[can, reach - size])
                    yield pa.RecordBatch.from_arrays([pa.array(h[can]), pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(t1[can]), pa.array(t2[can]), pa.array(place[can]), pa.array(np.full(len(can), size)), pa.array(is_open[can])], names=["h", "key", "key2", "t1", "t2", "place", "size", "open"])

    each = stored(bounded.select("h", "t1", "t2", "place", "open", "bytes", "l", "r").mapInArrow(windows, "h long, key long, key2 long, t1 long, t2 long, place long, size long, open boolean"), "windows")
    twice = each.groupBy("h", "size", "key", "key2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    hit = each.filter("open").join(twice, ["h", "size", "key", "key2"], "left_semi").groupBy("h", "t1", "t2", "place").agg(F.max("size").alias("most"), F.min("size").alias("least"))
    p = F.shiftright("place", 16)
    return hit.select("t1", "t2", (p - F.col("most")).alias("first"), (p - F.col("least") + window).alias("end")), [rows, cut, each]


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), F.col("text"))})


def _islands(ranges: DataFrame) -> DataFrame:
    """(t1, t2, ranges): the unions of a text's ranges(t1, t2, first, end), in order, packed as start << 32 | end.

    Copies of a text give equal ranges, which are combined before they move; a text's ranges are
    merged in one pass over their order, so what is collected is as small as what is removed is whole.
    """
    dealt = ranges.select("t1", "t2", "first", "end").distinct().repartition("t1", "t2").sortWithinPartitions("t1", "t2", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []  # the text that goes on in the next batch, and its islands so far, the last one as far as it is seen

        def made(texts: list) -> pa.RecordBatch:
            lists = [[(a << 32) | b for a, b in islands] for _, islands in texts]
            return pa.RecordBatch.from_arrays([pa.array([t[k] for t, _ in texts], pa.int64()) for k in (0, 1)] + [pa.array(lists, pa.list_(pa.int64()))], names=["t1", "t2", "ranges"])

        for batch in batches:
            t1, t2, first, end = (batch.column(k).to_numpy() for k in range(4))
            cuts = [0, *(np.flatnonzero((t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])) + 1).tolist(), len(t1)]
            closed = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                text, own, far = (int(t1[a]), int(t2[a])), first[a:b], np.maximum.accumulate(end[a:b])
                if text != open_:
                    if open_ is not None:
                        closed.append((open_, done))
                    open_, done = text, []
                if done:
                    far = np.maximum(far, done[-1][1])
                fresh = np.concatenate([[not done or own[0] > done[-1][1]], own[1:] > far[:-1]])
                starts = np.flatnonzero(fresh)
                if not fresh[0]:
                    done[-1] = (done[-1][0], int(far[starts[0] - 1] if len(starts) else far[-1]))
                done += list(zip(own[starts].tolist(), far[np.append(starts[1:], len(own)) - 1].tolist(), strict=True)) if len(starts) else []
            if closed:
                yield made(closed)
        if open_ is not None:
            yield made([(open_, done)])

    return dealt.mapInArrow(work, "t1 long, t2 long, ranges array<long>")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(t1, t2, ranges), stored: byte ranges (start << 32 | end) of each text, of which every byte is in a window that also starts elsewhere."""
    texts = _tagged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).filter(F.octet_length("text") >= window)
    rows = _anchor_rows(texts, window, gram)
    # Counts are stored before they are joined, so that a hot anchor's rows can be split over tasks.
    met = stored(rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "anchors-met")
    rows = stored(rows.join(met, "h", "left_semi"), "anchors")
    dropped(met)

    classes = rows.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "place")).alias("first"))
    classes = classes_ = stored(classes, "contexts")
    kinds = stored(classes.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    classes = classes.join(kinds, "h", "left").fillna(1, ["kinds"]).filter("n > 1 or kinds > 1")

    # Pass 2: contexts with several rows are repeated throughout.
    p, left, right = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    settled = rows.join(classes.filter("n > 1").select("h", "c1", "c2"), ["h", "c1", "c2"], "left_semi").select("t1", "t2", (p - left).alias("first"), (p + gram + right).alias("end"))

    # Pass 3: one row of each context, where an anchor has several.
    wanted = classes.filter("kinds > 1").select("h", "first.t1", "first.t2", "first.place", (F.col("n") == 1).alias("open"), (F.col("kinds") > hot).alias("hot"))
    lists = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "place", "open", "hot")).alias("wanted"))
    one = texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"))
    lists = lists.join(one, ["t1", "t2"])
    same = (F.col("x.t1") == F.col("l.t1")) & (F.col("x.t2") == F.col("l.t2")) & F.col("x.doc_id").eqNullSafe(F.col("l.doc_id"))
    contexts = stored(_contexts(texts.alias("x").join(lists.alias("l"), same).select("x.t1", "x.t2", "x.text", "l.wanted"), gram), "context-bytes")
    # A row of documents that is repeated gives its contexts again: they are told apart by their place.
    cold = _sorted(contexts.filter("not hot").repartition("h").sortWithinPartitions("h", "t1", "t2", "place"), window, gram)
    ranges, more = settled.union(cold), []
    if not contexts.filter("hot").isEmpty():
        counted, more = _counted(contexts.filter("hot").dropDuplicates(["h", "t1", "t2", "place"]), window, gram)
        ranges = ranges.union(counted)
    out = stored(_islands(ranges), "ranges")
    dropped(rows, classes_, kinds, contexts, *more)
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    ranges = repeated_ranges(docs, window, **options)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            sizes, removed, spans, kept = [], [], [], []
            for i, ranges_ in enumerate(batch.column(2)):
                own = data[offsets[i] : offsets[i + 1]]
                sizes.append(len(own))
                if not ranges_.is_valid:
                    removed.append(0)
                    spans.append(0)
                    kept.append(own.tobytes())
                    continue
                packed = ranges_.values.to_numpy()
                change = np.zeros(len(own) + 1, np.int64)
                np.add.at(change, packed >> 32, 1)
                np.subtract.at(change, packed & 0xFFFFFFFF, 1)
                gone = np.cumsum(change)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    tagged = _tagged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    joined = tagged.join(ranges, ["t1", "t2"], "left").select("doc_id", "text", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 200-byte passages."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window's digest, those that start more than once, and their unions; positions are bytes, two hex digits each.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT row, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)),
r AS (SELECT row, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
i AS (SELECT row, p, CASE WHEN p <= lag(p) OVER (PARTITION BY row ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT row, p, sum(fresh) OVER (PARTITION BY row ORDER BY p) AS g FROM i),
s AS (SELECT row, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY row, g),
e AS (SELECT s.row, a, b, coalesce(lag(b) OVER (PARTITION BY s.row ORDER BY a), 0) AS prior, h FROM s JOIN d ON d.row = s.row),
k AS (SELECT row, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
  string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM e GROUP BY row)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.row = d.row
"""
