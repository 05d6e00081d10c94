"""Bit and byte functions on 128-bit sketches and ids, as column expressions.

A sketch is four 32-bit little-endian words w0..w3 held as BIGINT, or its 16
bytes in order as 32 lower-case hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = ("w0", "w1", "w2", "w3")


def hamming(a: str = "a", b: str = "b") -> Column:
    """Bits in which the sketches of two aliased rows differ."""
    return sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in WORDS[1:]), F.bit_count(F.col(f"{a}.w0").bitwiseXOR(F.col(f"{b}.w0")))).cast("long")


def _swap(hex8: Column) -> Column:
    return F.concat(*[F.substring(hex8, i, 2) for i in (7, 5, 3, 1)])


def word_hex(word: Column) -> Column:
    """The word's four bytes in order as hex."""
    return _swap(F.lpad(F.lower(F.hex(word)), 8, "0"))


def sketch_hex() -> Column:
    return F.concat(*[word_hex(F.col(w)) for w in WORDS])


def hex_word(sk: Column, k: int) -> Column:
    """Word k of a hex sketch."""
    return F.conv(_swap(F.substring(sk, 8 * k + 1, 8)), 16, 10).cast("long")


def rotate(sk: Column, bits: int) -> Column:
    """Byte rotation to the left of a hex sketch."""
    if bits % 8:
        raise ValueError("only whole bytes rotate")
    k = bits // 4 % 32
    return F.concat(F.substring(sk, k + 1, 32 - k), F.substring(sk, 1, k)) if k else sk


def unrotate(sk: Column, bits: int) -> Column:
    return rotate(sk, (128 - bits) % 128)


def bit_window(sk: Column, start: int, size: int) -> Column:
    """``size`` (at most 32) bits from circular bit ``start``, most significant first within bytes."""
    first, last = start // 4, (start + size - 1) // 4
    digits = F.concat(*[F.substring(sk, d % 32 + 1, 1) for d in range(first, last + 1)])
    value = F.conv(digits, 16, 10).cast("long")
    return F.shiftright(value, 4 * (last + 1) - start - size).bitwiseAND((1 << size) - 1)


def sketch_split() -> list[Column]:
    """Three block keys of 43, 43 and 42 bits with the block number in the low two bits."""
    w3 = F.col("w3")
    high = [w3.bitwiseAND(0x7FF), F.shiftright(w3, 11).bitwiseAND(0x7FF), F.shiftright(w3, 22)]
    return [F.shiftleft(F.shiftleft(h, 32) + F.col(w), 2).bitwiseOR(F.lit(k).cast("long")) for k, (h, w) in enumerate(zip(high, WORDS))]


def second_level(k: int) -> list[Column]:
    """The 96 bits outside word k cut into four keys of 24 bits."""
    a, b, c = (F.col(w) for i, w in enumerate(WORDS) if i != k)
    return [
        a.bitwiseAND(0xFFFFFF),
        F.shiftright(a, 24).bitwiseOR(F.shiftleft(b.bitwiseAND(0xFFFF), 8)),
        F.shiftright(b, 16).bitwiseOR(F.shiftleft(c.bitwiseAND(0xFF), 16)),
        F.shiftright(c, 8),
    ]


def checksum_bucket(checksum: Column) -> Column:
    """Bucket 0..1023 of a hex checksum."""
    byte = lambda k: F.conv(F.substring(checksum, 2 * k + 1, 2), 16, 10).cast("long")
    return F.shiftleft(byte(0).bitwiseAND(3), 8).bitwiseOR(byte(1).bitwiseXOR(F.lit(128)))


def range_partition16(sk: Column, parts: int) -> Column:
    """Range partition of the first two bytes, big-endian."""
    return F.shiftright(F.conv(F.substring(sk, 1, 4), 16, 10).cast("long") * parts, 16)


def container(id_: Column) -> Column:
    return F.shiftright(id_, 8)


def offset(id_: Column) -> Column:
    return id_.bitwiseAND(255)


def make_id(container_: Column, offset_: Column) -> Column:
    return F.shiftleft(container_, 8).bitwiseOR(offset_)


def safe_unhex(text: Column) -> Column:
    """Bytes of a hex string of either case; null for odd length or a bad digit."""
    return F.when((F.length(text) % 2 == 0) & text.rlike("^[0-9a-fA-F]*$"), F.unhex(text))
