"""Token ids of documents as binary files, compressed by Re-Pair grammars, with random access.

Documents are sorted by id over all tasks; each task encodes its range and writes one file of blocks.
A block holds the ids of whole documents, about ``BLOCK`` of them, under a grammar of its own: in each
round the frequent pairs of neighbouring symbols become nonterminals and their occurrences, from the left and
without overlaps, are replaced. A block stores its alphabet, the rules, the number of ids that each rule
expands to, the sequence that is left, and running totals at every ``STRIDE`` symbols, so any range of ids
is found by two binary searches and only the symbols that cover it are expanded.

A file is what Spark's text sink commits: blocks as they are, each followed by a line feed; a block
knows its length. So files go wherever Spark writes, and a lost executor's file is written again.

A document is encoded word by word: white space never takes part in a token, so each distinct
word is encoded once a worker and remembered; a word of Latin letters is cut as the tokenizer cuts
it, and its pieces are remembered as well.

Defined cases: a null text is an empty one, which has only the end id; null ids come first; rows of one id are
ordered by a hash of their text, and equal rows are written once each. An empty table writes files
without blocks. Other columns have no effect. Ids may be of any type that Arrow holds and has an order. A
block is as large as its last document makes it.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastercat.llm import textbytes as tb
from rastercat.llm.storage import shared_folder, stored

VOCABULARY, END = "word_bpe_49k.json", 1
BLOCK, STRIDE = 1 << 18, 256
#: A pair gets a rule if it occurs so often; rounds and rules in a round at most.
FREQUENT, ROUNDS, RULES = 8, 5, 1 << 13
#: Words and pieces that a worker remembers, in bytes of keys and ids about; then it forgets all.
REMEMBERED = 1 << 27
WIDE = np.dtype("<u4")


# --- ids -------------------------------------------------------------------------------------------------

#: Words of Latin letters that no normalisation changes but lower case; how the tokenizer cuts them when they are lower case.
_PLAIN = re.compile(r"[\0-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+").fullmatch
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|[0-9]|[^a-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u017f]+").findall


class Words:
    """Ids of words, as bytes of 32-bit numbers, each encoded once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.lead = os.path.commonprefix(self.special).encode()
        self.marked = re.compile("|".join(map(re.escape, self.special))).search
        self.mark = self.tokenizer.token_to_id(self.special[0])
        ending = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        if not ending or not self.special:
            raise ValueError("a tokenizer that marks ends of words and has a special token is needed")
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith(ending)]] = True
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.size = 0

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if self.size > REMEMBERED:
            self.known, self.pieces, self.size = {}, {}, 0
        found, missing, get = [], set(), self.known.get
        for text in texts:
            words = text.split()
            ids = list(map(get, words))
            holes = {k: words[k] for k, x in enumerate(ids) if x is None}
            missing.update(holes.values())
            found.append((ids, holes))
        if missing:
            self._learn(missing)
        for ids, holes in found:
            for k, word in holes.items():
                ids[k] = self.known[word]
        return [b"".join(ids) for ids, _ in found]

    def _learn(self, words: set[bytes]) -> None:
        cut, rest = {}, []
        for w in words:
            text = w.decode()
            if self.lead in w and self.marked(text):
                self.known[w] = self._ids(text).tobytes()
            elif w.isascii() or _PLAIN(text):
                cut[w] = _PIECES(text.lower())
            else:
                rest.append(w)
        new = list(set().union(*cut.values()).difference(self.pieces))
        for k in range(0, len(new), 2000):
            self._remember(self.pieces, new[k : k + 2000], new[k : k + 2000], " ")
        ids = self.pieces.__getitem__
        for w, pieces in cut.items():
            self.known[w] = b"".join(map(ids, pieces))
        for k in range(0, len(rest), 2000):
            self._remember(self.known, rest[k : k + 2000], [w.decode() for w in rest[k : k + 2000]], self.special[0])
        self.size += sum(map(len, words)) + 100 * len(words)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, WIDE)

    def _remember(self, into: dict, keys: list, texts: list[str], between: str) -> None:
        """Many texts as one: pieces with a space between them, each of which ends with the only id that can end one; words with a special token, which the tokenizer cuts at first."""
        ids = self._ids(between.join(texts))
        if between == " ":
            ends = np.flatnonzero(self.last[ids]) + 1
            starts = ends[:-1]
        else:
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            starts = ends[:-1] + 1
        data = ids.tobytes()
        for key, a, b in zip(keys, [0, *starts.tolist()], ends.tolist(), strict=True):
            into[key] = data[4 * a : 4 * b]


@functools.cache
def words_of(path: str) -> Words:
    return Words(path)


# --- grammars ----------------------------------------------------------------------------------------------


def repaired(symbols: np.ndarray, alphabet: int, frequent: int = FREQUENT, rounds: int = ROUNDS, rules: int = RULES) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sequence, rules of each round as rows of two symbols) for symbols below alphabet; nonterminals are numbered from there on."""
    made, size = [], alphabet
    while len(made) < rounds and len(symbols) > 1:
        narrow = size + rules <= 1 << 16
        kind, shift = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
        wide = symbols.astype(kind)
        keys = (wide[:-1] << shift) | wide[1:]
        order = np.sort(keys)
        cuts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        counts = np.diff(np.append(cuts, len(order)))
        often = np.flatnonzero(counts >= frequent)
        if len(often) > rules:
            often = often[np.argpartition(counts[often], -rules)[-rules:]]
        pairs = order[cuts[often]]
        at, which = _taken(keys, pairs)
        uses = np.bincount(which, minlength=len(pairs))
        good = uses >= max(2, frequent // 2)
        if not good.any():
            break
        stay = good[which]
        at, which = at[stay], (np.cumsum(good) - 1)[which[stay]]
        symbols = symbols.copy()
        symbols[at] = size + which
        left = np.ones(len(symbols), bool)
        left[at + 1] = False
        symbols = symbols[left]
        pairs = pairs[good].astype(np.uint64)
        shift = np.uint64(16 if narrow else 32)
        made.append(np.stack([pairs >> shift, pairs & np.uint64((1 << int(shift)) - 1)], 1).astype(np.int64))
        size += len(pairs)
    return symbols, made


def _taken(keys: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, index of their pair) of occurrences without overlaps: in a run of neighbouring places, every other one."""
    bits = max(10, int(len(pairs)).bit_length() + 5)
    slot = lambda k: ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.full(1 << bits, -1, np.int32)
    table[slot(pairs)] = np.arange(len(pairs), dtype=np.int32)  # of pairs in one slot, one is left for this round
    found = table[slot(keys)]
    at = np.flatnonzero(found >= 0)
    at = at[pairs[found[at]] == keys[at]]
    if not len(at):
        return at, found[at]
    first = np.concatenate([[True], at[1:] != at[:-1] + 1])
    start = at[first][np.cumsum(first) - 1]
    at = at[(at - start) % 2 == 0]
    return at, found[at]


def expanded(symbols: np.ndarray, alphabet: int, rules: np.ndarray) -> np.ndarray:
    """Symbols with every nonterminal replaced by what it stands for."""
    while True:
        inner = symbols >= alphabet
        if not inner.any():
            return symbols
        pairs = rules[symbols[inner] - alphabet]
        ends = np.cumsum(inner + 1)
        out = np.empty(int(ends[-1]), symbols.dtype)
        out[ends[~inner] - 1] = symbols[~inner]
        out[ends[inner] - 2], out[ends[inner] - 1] = pairs[:, 0], pairs[:, 1]
        symbols = out


# --- blocks ------------------------------------------------------------------------------------------------

_MAGIC = b"RPB1"
#: magic, length, task, number, documents, ids, alphabet, rules, sequence, bytes of a symbol, bytes of the document ids.
_HEAD = struct.Struct("<4sQIIIQIIQBQ")


def block_of(ids: np.ndarray, sizes: list[int], names: pa.Array, task: int = 0, number: int = 0, **options) -> bytes:
    """A block of the ids of documents of these sizes, one after the other, and these doc_ids."""
    present = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    ranks = np.zeros(int(present[-1]) + 1 if len(present) else 0, np.int64)
    ranks[present] = np.arange(len(present))
    sequence, rounds = repaired(ranks[ids], len(present), **options)
    rules = np.concatenate(rounds) if rounds else np.zeros((0, 2), np.int64)
    lengths = np.ones(len(present) + len(rules), np.int64)
    done = len(present)
    for some in rounds:  # a round's rules stand for symbols of rounds before
        lengths[done : done + len(some)] = lengths[some].sum(1)
        done += len(some)
    totals = np.concatenate([[0], np.cumsum(lengths[sequence])])[::STRIDE]
    width = 2 if done <= 1 << 16 else 4
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", names.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([names], names=["doc_id"]))
    named = sink.getvalue().to_pybytes()
    kind = np.dtype(f"<u{width}")
    parts = [named, np.array(sizes, "<u8").tobytes(), present.astype(WIDE).tobytes(), rules.astype(kind).tobytes(), lengths[len(present) :].astype(WIDE).tobytes(), totals.astype("<u8").tobytes(), sequence.astype(kind).tobytes()]
    length = _HEAD.size + sum(map(len, parts))
    return _HEAD.pack(_MAGIC, length, task, number, len(sizes), len(ids), len(present), len(rules), len(sequence), width, len(named)) + b"".join(parts)


class Block:
    """A block of a file, read where it lies; ids are expanded when they are asked for."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.length, self.task, self.number, docs, self.n_ids, alphabet, rules, sequence, width, named = _HEAD.unpack_from(data, at)
        if magic != _MAGIC or at + self.length > len(data):
            raise ValueError("not a whole block of token ids")
        at += _HEAD.size
        self.doc_ids = pa.ipc.open_stream(pa.py_buffer(data[at : at + named])).read_all().column(0).combine_chunks()
        at += named

        def numbers(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.sizes = numbers("<u8", docs).astype(np.int64)
        self.alphabet = numbers("<u4", alphabet)
        self.rules = numbers(f"<u{width}", 2 * rules).reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(alphabet, np.int64), numbers("<u4", rules)])
        self.totals = numbers("<u8", -(-(sequence + 1) // STRIDE))
        self.sequence = numbers(f"<u{width}", sequence)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from start to end: only symbols that cover them are expanded."""
        end = self.n_ids if end is None else end
        if start >= end:
            return np.zeros(0, WIDE)
        first = (int(np.searchsorted(self.totals, start, "right")) - 1) * STRIDE
        last = int(np.searchsorted(self.totals, end, "left")) * STRIDE
        some = self.sequence[first:last].astype(np.int64)
        before = int(self.totals[first // STRIDE]) + np.concatenate([[0], np.cumsum(self.lengths[some])])
        a, b = int(np.searchsorted(before, start, "right")) - 1, int(np.searchsorted(before, end, "left"))
        some, skip = some[a:b], start - int(before[a])
        whole, starts = self._whole
        lengths = self.lengths[some]
        places = np.repeat(starts[some] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        return whole[places[skip : skip + end - start]]

    @functools.cached_property
    def _whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every symbol's expansion, one after the other, and where each begins."""
        symbols = expanded(np.arange(len(self.lengths)), len(self.alphabet), self.rules.astype(np.int64))
        return self.alphabet[symbols], np.cumsum(self.lengths) - self.lengths

    def document(self, k: int) -> np.ndarray:
        """The ids of the block's k-th document."""
        start = int(self.sizes[:k].sum())
        return self.ids(start, start + int(self.sizes[k]))


def blocks_of(data: bytes) -> Iterator[Block]:
    at = 0
    while at < len(data):
        block = Block(data, at)
        yield block
        at += block.length + 1


# --- files -------------------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, block: int = BLOCK) -> None:
    """Files of docs(doc_id, text) below path, in the order of doc_id; path must not exist."""
    place = public_tokenizers.path

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, number = words_of(place(vocabulary)), TaskContext.get().partitionId(), 0
        last = np.array([end], WIDE).tobytes()
        names, sizes, parts, many = [], [], [], 0

        def closed() -> pa.RecordBatch:
            made = block_of(np.frombuffer(b"".join(parts), WIDE).astype(np.int64), sizes, pa.concat_arrays(names), task, number)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["block"])

        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            for i, j, own, at in tb.pieces(data, offsets):
                raw = own.tobytes()
                for k, ids in enumerate(words.encoded([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])):
                    sizes.append(len(ids) // 4 + 1)
                    parts += [ids, last]
                    names.append(batch.column(0).slice(i + k, 1))
                    many += sizes[-1]
                    if many >= block:
                        yield closed()
                        number += 1
                        names, sizes, parts, many = [], [], [], 0
        if sizes:
            yield closed()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    laid = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    # A binary value cast to a string keeps its bytes, and the text sink writes them as they are.
    laid.mapInArrow(work, "block binary").select(F.col("block").cast("string").alias("value")).write.text(path)


def read(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(doc_id, file, start, n_tokens, ids_crc32) of every document in the files; start is its first id's place in its file. kind: type of doc_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                start = 0
                for block in blocks_of(content.as_buffer().to_pybytes()):
                    data, ends = block.ids().tobytes(), np.cumsum(block.sizes)
                    bounds = [0, *ends.tolist()]
                    sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    starts = start + ends - block.sizes
                    yield pa.RecordBatch.from_arrays([block.doc_ids, pa.array([block.task] * len(sums), pa.int64()), pa.array(starts), pa.array(block.sizes), pa.array(sums, pa.int64())], names=["doc_id", "file", "start", "n_tokens", "ids_crc32"])
                    start += block.n_ids

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, f"doc_id {kind}, file long, start long, n_tokens long, ids_crc32 long")


def index(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all documents before it.

    What is summed over all files is a row for each file.
    """
    rows = stored(read(spark, path, kind), "token-index")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("many")).select("file", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    return rows.join(files, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents' places and checksums, from files of their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write(docs, path)
    return index(spark, path, docs.schema["doc_id"].dataType.simpleString())
