"""Average hashes as columns: words of 32 bits, distances, bands and hex."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32


def n_words(hash_size: int) -> int:
    return math.ceil(hash_size * hash_size / WORD)


def check_hash_size(hash_size: int) -> None:
    if not 4 <= hash_size <= 16:
        raise ValueError("hash size must be between 4 and 16")


def check_threshold(threshold: int, hash_size: int) -> None:
    check_hash_size(hash_size)
    if not 0 <= threshold <= hash_size * hash_size:
        raise ValueError("hash threshold must be between 0 and the number of bits")


def average_hash(pixels: Column, hash_size: int = 8) -> Column:
    """array<bigint> of words: bit i is set where pixel i is at least the mean, in whole numbers."""
    check_hash_size(hash_size)
    bits = hash_size * hash_size
    total = F.aggregate(pixels, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))

    def word(w: Column) -> Column:
        bit = lambda b: F.when(F.get(pixels, w * WORD + b) * bits >= total, F.expr("1L")).otherwise(F.expr("0L"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(0).cast("bigint"), lambda a, b: a + bit(b) * F.pow(F.lit(2.0), b).cast("bigint"))

    return F.transform(F.sequence(F.lit(0), F.lit(n_words(hash_size) - 1)), word)


def hamming(a: Column, b: Column, hash_size: int = 8) -> Column:
    """Bits that differ."""
    counts = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(n_words(hash_size))]
    return reduce(lambda x, y: x + y, counts).cast("int")


def hash_to_hex(words: Column) -> Column:
    """Hex without leading zeros, most significant word first; '0' for no bits."""
    digits = F.concat_ws("", F.transform(F.reverse(words), lambda w: F.lpad(F.lower(F.hex(w)), 8, "0")))
    short = F.regexp_replace(digits, "^0+", "")
    return F.when(short == "", F.lit("0")).otherwise(short)


def hash_from_hex(text: Column, hash_size: int = 8) -> Column:
    """Words of a hex string; null where it is no hex or has too many digits."""
    size = n_words(hash_size)
    good = text.rlike("^(?:0[xX])?[0-9a-fA-F]+$")
    bare = F.regexp_replace(F.regexp_replace(text, "^0[xX]", ""), "^0+", "")
    padded = F.lpad(bare, size * 8, "0")
    words = F.array(*(F.conv(F.substring(padded, 8 * (size - 1 - i) + 1, 8), 16, 10).cast("bigint") for i in range(size)))
    return F.when(good & (F.length(bare) <= size * 8), words)


def bands(words: Column, threshold: int, hash_size: int = 8) -> list[Column]:
    """threshold + 1 bands of the bits: two hashes within the threshold are equal in at least one."""
    bits, many = hash_size * hash_size, threshold + 1
    cuts = [bits * k // many for k in range(many + 1)]
    return [_bit_range(words, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _bit_range(words: Column, start: int, end: int) -> Column:
    """Bits start to end as text of whole parts of words."""
    parts = []
    for w in range(start // WORD, (max(end, start + 1) - 1) // WORD + 1):
        low, high = max(start, w * WORD) - w * WORD, min(end, (w + 1) * WORD) - w * WORD
        parts.append(F.shiftright(words[w], low).bitwiseAND(F.lit((1 << (high - low)) - 1)).cast("string"))
    return F.concat_ws(".", *parts)


def band_numbers(words: Column, many: int, hash_size: int = 8) -> list[tuple[Column, int]]:
    """``many`` bands of the bits as numbers, each with its width, which is 62 at most."""
    bits = hash_size * hash_size
    cuts = [bits * k // many for k in range(many + 1)]
    return [(_number(words, a, b), b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _number(words: Column, start: int, end: int) -> Column:
    total = F.lit(0).cast("bigint")
    for w in range(start // WORD, (end - 1) // WORD + 1):
        low, high = max(start, w * WORD) - w * WORD, min(end, (w + 1) * WORD) - w * WORD
        part = F.shiftright(words[w], low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint"))
        total = total.bitwiseOR(F.shiftleft(part, w * WORD + low - start))
    return total
