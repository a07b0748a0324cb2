import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastercat.llm import token_files as op
from tests.llm.helpers import documents, odd_rows, odd_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def plain(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


ODD = [
    "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> x<|endoftext|>", "it's we'LL 'S o'd'm", "\x1c\x1d a\x1cb", " x 　y z", "é ́a ÅÅ", "Σ ΑΣ ΣΑΣ İ ǅ ß", "1234 ٣٤ x9y", "a_b-c...!?\x00\x7f",
    "\x0b\x0c\r\n\t ", "汉字 テスト 한국어 नमस्ते", "🙂👍🏽 a🙂b", "x" * 3000, "'s's't", "ﬁ ℃ ①",
]


@pytest.mark.parametrize("text", ODD + [t for t in odd_texts() if t])
def test_words_give_the_ids_of_the_whole_text(text):
    assert ids(op.Words(PATH).encoded([text.encode()])[0]) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'sStTlLdDmM<|>09aé́")), max_size=30), max_size=5))
def test_words_of_any_text(texts):
    words = op.words_of(PATH)
    assert [ids(x) for x in words.encoded([t.encode() for t in texts])] == [plain(t) for t in texts]


def test_other_kinds_of_tokenizers_raise():
    with pytest.raises(ValueError, match="ends of words"):
        op.Words(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_are_forgotten_when_there_are_many(monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 500)
    words = op.Words(PATH)
    for k in range(30):
        text = f"alpha{k} beta {k} é{k}"
        assert ids(words.encoded([text.encode()])[0]) == plain(text)
        assert len(words.known) < 40


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(2, 9), st.integers(1, 9), st.sampled_from([1, 2, 50]), st.data())
def test_grammar_round_trip_and_random_access(symbols, frequent, rounds, rules, data):
    values = np.array(symbols, np.int64) * 70_000
    block = op.Block(op.block_of(values, [len(symbols)], pa.array([1]), frequent=frequent, rounds=rounds, rules=rules))
    assert block.ids().tolist() == values.tolist()
    a = data.draw(st.integers(0, len(symbols)))
    b = data.draw(st.integers(a, len(symbols)))
    assert block.ids(a, b).tolist() == values[a:b].tolist()


def test_rules_are_nested_and_lengths_are_those_of_their_expansions():
    text = np.array([1, 2, 3, 4] * 3000 + [7] * 500 + [9, 9, 8], np.int64)
    block = op.Block(op.block_of(text, [len(text)], pa.array([None], pa.int64())))
    assert len(block.sequence) < len(text) / 20 and int(block.lengths.max()) >= 16
    for k in range(len(block.rules)):
        symbol = np.array([len(block.alphabet) + k])
        assert len(op.expanded(symbol, len(block.alphabet), block.rules.astype(np.int64))) == block.lengths[symbol[0]]
    for start in range(0, len(text), 777):
        assert block.ids(start, start + 5).tolist() == text[start : start + 5].tolist()


@pytest.mark.parametrize("wide", [0, 70_000])
def test_wide_alphabets(wide):
    """More symbols than 16 bits hold."""
    rng = np.random.default_rng(2)
    values = np.concatenate([np.arange(wide), np.tile(rng.integers(0, 1 << 31, 50), 40)])
    assert op.Block(op.block_of(values, [len(values)], pa.array([1]))).ids().tolist() == values.tolist()


def brute(rows):
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = np.array([*plain(r[1]), 1], "<u4").tobytes()
        out.append((r[0], start, len(own) // 4, zlib.crc32(own)))
        start += len(own) // 4
    return out


@pytest.mark.parametrize("block", [op.BLOCK, 50, 1])
def test_files_equal_brute_force(spark, tmp_path, block):
    docs = documents(spark).repartition(5)
    op.write(docs, str(tmp_path / "files"), block=block)
    found = [tuple(r) for r in op.index(spark, str(tmp_path / "files")).collect()]
    assert sorted(found, key=lambda r: r[1]) == brute(odd_rows())


def test_documents_of_the_files(spark, tmp_path):
    """What lies in the files, in their order, one document at a time."""
    op.write(documents(spark), str(tmp_path / "files"), block=300)
    texts = {}
    for i, t, *_ in odd_rows():
        texts.setdefault(i, t)
    seen = []
    for file in sorted((tmp_path / "files").glob("part-*")):
        for block in op.blocks_of(file.read_bytes()):
            for k, doc_id in enumerate(block.doc_ids.to_pylist()):
                assert block.document(k).tolist() == [*plain(texts[doc_id]), 1]
                seen.append(doc_id)
    assert seen == sorted((r[0] for r in odd_rows()), key=lambda i: (i is not None, i or 0))


def test_broken_files_raise(spark, tmp_path):
    data = op.block_of(np.arange(9), [9], pa.array([1]))
    for bad in (b"x" + data[1:], data[:-1]):
        with pytest.raises(ValueError, match="whole block"):
            op.Block(bad)


def test_empty_table_and_ids_of_text(spark, tmp_path):
    op.write(documents(spark, []), str(tmp_path / "none"))
    assert op.index(spark, str(tmp_path / "none")).count() == 0
    docs = documents(spark).select(F.concat(F.lit("é"), F.col("doc_id").cast("string")).alias("doc_id"), "text", *(F.lit("x").alias(c) for c in ("tie", "block", "file", "start")))
    op.write(docs, str(tmp_path / "named"))
    assert op.index(spark, str(tmp_path / "named"), "string").count() == docs.count()
